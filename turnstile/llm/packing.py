"""Cost-balanced packing: documents become token sequences of one length and near-equal cost.

A document costs what a transformer spends on it, a linear part and a quadratic
one of its attention. Documents are taken from the longest to the shortest, and
each goes to the sequence that costs least so far and has room for it. What has
no room anywhere is cut, so no sequence is padded.

Everything happens in one stage without a shuffle: a task packs window after
window of its rows (about a thousand sequences each), hands what doesn't fill a
sequence on to the next window, and splits its last rest over sequences of powers
of two, which need no padding either. A window is a few MB of ids whatever the
table; a lost executor costs its tasks alone. What a rerun packs depends on the
rows of each task, so it is the same for the same files and settings.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstile.llm.common import Sink, bound_batches, rows_of

#: Tokens that a window gathers before it is packed.
WINDOW = 1 << 21

_OUT = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
])
_DDL = "doc_id long, start long, ids binary, doc_tokens long, sequence_id long, offset long"

#: A piece: a document's number in the window, where the piece starts in it, its length.
Piece = tuple[int, int, int]


def cost_of(length: int, hidden: int) -> float:
    """Cost of a document of ``length`` in a sequence, in units of one token's linear part.

    A layer of width d spends 24 d^2 operations a token on its matrices and 4 d a
    token and position on attention, hence a quadratic part of 1 / (6 d).
    """
    return length + length * length / (6.0 * hidden)


def pack_pieces(pieces: list[Piece], rooms: list[int], hidden: int) -> list[list[Piece]]:
    """Pieces by sequence; ``rooms`` are the sequences' capacities and together at most the pieces' total.

    Pieces go from the longest to the shortest (ties: as given) to the sequence of
    lowest cost (ties: the first) that has room. Where none has, a piece is cut: the
    roomiest sequence is filled by its head and its tail waits its turn by length.
    What is left when all are full isn't in the result.
    """
    waiting = [(-n, k, (doc, start, n)) for k, (doc, start, n) in enumerate(pieces)]
    heapq.heapify(waiting)
    number = len(waiting)
    free = [(0.0, i) for i, room in enumerate(rooms) if room]
    heapq.heapify(free)  # by cost: sequences that aren't known to lack room for what comes next
    left, cost = list(rooms), [0.0] * len(rooms)
    aside: list[tuple[int, int]] = []  # by room, the roomiest first: sequences that lacked room for a longer piece
    out: list[list[Piece]] = [[] for _ in rooms]
    while waiting:
        _, _, (doc, start, n) = heapq.heappop(waiting)
        while aside and -aside[0][0] >= n:
            i = heapq.heappop(aside)[1]
            heapq.heappush(free, (cost[i], i))
        while free and left[free[0][1]] < n:
            i = heapq.heappop(free)[1]
            heapq.heappush(aside, (-left[i], i))
        if free:
            i = heapq.heappop(free)[1]
        elif aside:
            i = heapq.heappop(aside)[1]
            number += 1
            heapq.heappush(waiting, (left[i] - n, number, (doc, start + left[i], n - left[i])))
            n = left[i]
        else:
            break
        out[i].append((doc, start, n))
        left[i] -= n
        cost[i] += cost_of(n, hidden)
        if left[i]:
            heapq.heappush(free, (cost[i], i))
    return out


class Window:
    """Documents of a task that wait to be packed: what of them is left, as pieces."""

    def __init__(self, capacity: int, hidden: int):
        self.capacity, self.hidden = capacity, hidden
        self.docs: list[tuple[int | None, np.ndarray, int]] = []  # id, ids from ``first`` on, all its tokens
        self.firsts: list[int] = []
        self.tokens = 0

    def add(self, doc_id: int | None, ids: np.ndarray, first: int, total: int) -> None:
        self.docs.append((doc_id, ids, total))
        self.firsts.append(first)
        self.tokens += len(ids)

    def pack(self, last: bool) -> Iterator[list[tuple[int | None, int, np.ndarray, int]]]:
        """Full sequences as lists of (id, start, ids, all its tokens); with ``last`` also those of the rest."""
        rooms = [self.capacity] * (self.tokens // self.capacity)
        rest = self.tokens % self.capacity
        if last:
            rooms += [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
        docs, firsts = self.docs, self.firsts
        packed = pack_pieces([(k, 0, len(ids)) for k, (_, ids, _) in enumerate(docs)], rooms, self.hidden)
        self.docs, self.firsts, self.tokens = [], [], 0
        used: dict[int, list[tuple[int, int]]] = {}
        for sequence in packed:
            for k, start, n in sequence:
                if n < len(docs[k][1]):
                    used.setdefault(k, []).append((start, n))
                else:
                    used[k] = []
            yield [(docs[k][0], firsts[k] + start, docs[k][1][start : start + n], docs[k][2]) for k, start, n in sequence]
        for k, (doc_id, ids, total) in enumerate(docs):  # heads are placed first, so what stays is a tail
            at = sum(n for _, n in used[k]) if k in used else 0
            if (k not in used or used[k]) and at < len(ids):
                self.add(doc_id, ids[at:], firsts[k] + at, total)


@lru_cache(maxsize=2)
def encoder(path: str) -> Callable[[str], np.ndarray]:
    """Ids of a text under the byte-level BPE vocabulary of a ``tokenizers`` file, specials of the text included.

    A vocabulary whose ids are merge ranks (beside it lies a ``.tiktoken`` file) is applied by
    tiktoken, which gives the same ids in a sixth of the time; others by ``tokenizers``.
    """
    import json
    import os

    ranks = path.removesuffix(".json") + ".tiktoken"
    if not os.path.exists(ranks):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        return lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as lines:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    with open(path, encoding="utf-8") as file:
        special = {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}
    coder = tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens=special)
    return lambda text: coder.encode_to_numpy(text, allowed_special="all")


def pack_rows(
    rows: Iterable[tuple[int | None, str | None]], encode: Callable[[str], np.ndarray], capacity: int, end: int, hidden: int, window: int
) -> Iterator[list[tuple[int | None, int, np.ndarray, int]]]:
    """Sequences of the rows ``(id, text)`` of a task, window by window."""
    held = Window(capacity, hidden)
    for doc_id, text in rows:
        ids = np.append(encode(text) if text else np.empty(0, np.uint32), np.uint32(end)).astype("<u4", copy=False)
        whole = len(ids) - len(ids) % capacity
        for start in range(0, whole, capacity):  # what fills a sequence alone
            yield [(doc_id, start, ids[start : start + capacity], len(ids))]
        if whole < len(ids):
            held.add(doc_id, ids[whole:].copy() if whole else ids, whole, len(ids))
        if held.tokens >= max(window, capacity):
            yield from held.pack(last=False)
    yield from held.pack(last=True)


def pack(
    docs: DataFrame,
    vocabulary: str,
    capacity: int = 2048,
    end: int = 1,
    hidden: int = 4096,
    window: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pieces of all documents in sequences of at most ``capacity`` tokens, none padded.

    Columns ``doc_id, start, length, ids`` (unsigned 32 bit, little endian),
    ``doc_tokens, sequence_id, offset``. ``hidden`` is the model's width, which sets
    what attention costs. A task's sequences are full but for at most one of each
    smaller power of two.

    A null or empty text is the end token alone. A null id is kept as null; repeated
    rows are packed each; other columns, whatever their names, aren't read. An empty
    table has no pieces. A very long text is one value in memory and its full
    sequences leave at once; only its rest waits in the window.
    """
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink = Sink(_OUT)
        number = TaskContext.get().partitionId() << 32
        for sequence in pack_rows(rows_of(batches, "id", "text"), encoder(vocabulary), capacity, end, hidden, window):
            offset, full = 0, False
            for doc_id, start, ids, total in sequence:
                full = sink.add(doc_id, start, ids.tobytes(), total, number, offset, weight=4 * len(ids))
                offset += len(ids)
            number += 1
            if full:
                yield sink.flush()
        if len(sink):
            yield sink.flush()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    packed = rows.mapInArrow(run, _DDL)
    length = (F.octet_length("ids") / 4).cast("long").alias("length")
    return packed.select("doc_id", "start", length, "ids", "doc_tokens", "sequence_id", "offset")
