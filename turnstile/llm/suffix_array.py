"""Suffix arrays by two-stage sorting, to a fixed depth.

Stage one sorts directly only suffixes that are smaller than their successor
(by their first ``depth`` bytes). Stage two induces all others, which are larger
than their successor: scanning the buckets of first bytes upwards, the
predecessor of each suffix met goes to the end of its own bucket, in order.

The order is that of the first ``depth`` bytes, which is all that a search for
equal strings of that length needs. A suffix without an ascent in its first
``depth`` bytes is sorted directly too: further bytes would decide its kind.
"""

from __future__ import annotations

import numpy as np


def _next_true(flags: np.ndarray) -> np.ndarray:
    """For each place the first true one at or after it; ``len(flags)`` if none."""
    n = len(flags)
    at = np.where(flags, np.arange(n), n)
    return np.minimum.accumulate(at[::-1])[::-1]


def two_stage_order(text: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """The ``wanted`` places (a mask) of ``text`` (uint8) in the order of their suffixes to ``depth``.

    Suffixes whose first ``depth`` bytes agree are adjacent.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(text[1:].astype(np.int16) - text[:-1])
    step[-1] = -1  # the end is smaller than any byte
    change = _next_true(step != 0)
    smaller = step[change] > 0
    ascent = _next_true(step > 0)
    far = ascent + 1 - np.arange(n) > depth - 1
    direct = smaller | far

    # What is induced needs its successors, up to one that is sorted directly.
    need = wanted.copy()
    front = np.flatnonzero(need & ~direct)
    while len(front):
        front = front[front + 1 < n] + 1
        front = front[~need[front]]
        need[front] = True
        front = front[~direct[front]]
    induced = need & ~direct

    padded = np.concatenate((text, np.zeros(depth, np.uint8)))
    windows = np.lib.stride_tricks.sliding_window_view(padded, depth)
    seeds = np.flatnonzero(need & direct)
    keys = np.ascontiguousarray(windows[seeds]).view(f"S{depth}").ravel()
    seeds = seeds[np.argsort(keys, kind="stable")]
    edges = np.searchsorted(text[seeds], np.arange(257))

    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    order = []
    for c in range(256):
        layer = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        bucket = []
        while len(layer):  # runs of one byte: predecessors in the same bucket
            bucket.append(layer)
            before = layer[layer > 0] - 1
            layer = before[induced[before] & (text[before] == c)]
        bucket.append(seeds[edges[c] : edges[c + 1]])
        whole = np.concatenate(bucket)
        if not len(whole):
            continue
        order.append(whole)
        before = whole[whole > 0] - 1
        before = before[induced[before]]
        heads = text[before]
        later = heads > c
        before, heads = before[later], heads[later]
        by_head = np.argsort(heads, kind="stable")
        before, heads = before[by_head], heads[by_head]
        cuts = np.flatnonzero(np.diff(heads)) + 1
        for part in np.split(before, cuts) if len(before) else ():
            waiting[text[part[0]]].append(part)
    found = np.concatenate(order) if order else np.zeros(0, np.int64)
    return found[wanted[found]]


def adjacent_prefixes(text: np.ndarray, order: np.ndarray, depth: int, rows: int = 1 << 15) -> np.ndarray:
    """Common prefix, to ``depth``, of each suffix with the one before it; 0 for the first."""
    out = np.zeros(len(order), np.int64)
    padded = np.concatenate((text, np.zeros(depth, np.uint8)))
    windows = np.lib.stride_tricks.sliding_window_view(padded, depth)
    for a in range(1, len(order), rows):
        part = slice(a, min(a + rows, len(order)))
        before = slice(a - 1, part.stop - 1)
        differ = windows[order[part]] != windows[order[before]]
        first = differ.argmax(axis=1)
        out[part] = np.where(differ[np.arange(len(first)), first], first, depth)
        room = len(text) - np.maximum(order[part], order[before])
        out[part] = np.minimum(out[part], room)
    return out
