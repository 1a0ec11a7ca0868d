"""Benchmark decontamination with an Aho-Corasick automaton.

Items are normalised to lower-case words; a window is ``WINDOW`` consecutive
words of an item, or the whole of a shorter one. A window of 13 words holds one of
the blocks of 7 words that follow each other from the item's start, so the
automaton's patterns are these blocks, as sequences of word numbers (about one node
a word instead of 13), and shorter items as a whole. It reads a document's words
once, whatever the number of items; where it finds a block, the item's words to
both sides say how far the two agree, and that run is hit if it is as long as a
window. Places are word numbers, which map back to offsets of the original text.

The items are the query set. Their normalised size is measured first: one
automaton holds at most ``max_bytes`` of it (measured: about 25 MB of a worker's
memory for each MB of items), and a larger set is dealt over several automata, each
of which the documents' rows pass in turn without a shuffle, so what is sent to the
executors at once stays bounded. A worker keeps its automaton for its next task.
"""

from __future__ import annotations

import hashlib
import pickle
import re
import uuid
from collections.abc import Iterable, Iterator, Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnstile.llm.common import Sink, bound_batches, rows_of, utf8

WINDOW = 13
#: A word's number is cut in two at this base; the lower parts begin at ``LOW``.
FAN, LOW = 256, 1 << 24
#: Fixed values of the contract: bytes that never belong to a word, after lower-casing A-Z.
GAPS = bytes(b for b in range(128) if not (0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A))
TO_SPACE = bytes(0x20 if b in set(GAPS) else b for b in range(256))
IN_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words_of(text: bytes) -> list[bytes]:
    return text.lower().translate(TO_SPACE).split()


def _symbols(numbers: Sequence[int]) -> tuple[int, ...]:
    """Two symbols a word, from ranges apart: a node then has at most ``FAN`` children for each, which are tried in turn."""
    own = np.array(numbers, np.int64)
    out = np.empty(2 * len(own), np.int64)
    out[0::2], out[1::2] = own // FAN, own % FAN + LOW
    return tuple(out.tolist())


class Windows:
    """The automaton over the windows of some items."""

    def __init__(self, items: Iterable[tuple[str, bytes]], window: int = WINDOW):
        self.numbers: dict[bytes, int] = {}
        self.items: list[tuple[str, tuple[int, ...]]] = []
        blocks: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        for name, text in dict.fromkeys(items):
            words = tuple([self.numbers.setdefault(w, len(self.numbers) + FAN) for w in words_of(text)])
            block = len(words) if len(words) < window else (window + 1) // 2
            for at in range(0, len(words) - block + 1, max(block, 1)) if words else ():
                blocks.setdefault(words[at : at + block], []).append((len(self.items), at))
            self.items.append((name, words))
        self.window = window
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for words, own in blocks.items():
            self.automaton.add_word(_symbols(words), (len(words), own))
        if blocks:
            self.automaton.make_automaton()
        self.empty = not blocks

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged spans (from, to) of hit words, and the items with an occurring window."""
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        if self.empty or not words:
            return spans, found
        get = self.numbers.get
        own = [get(w, 0) for w in words]
        seen: dict[tuple[int, int], int] = {}  # how far an item has been compared at one shift
        for end, (n, owners) in self.automaton.iter(_symbols(own)):
            start = end // 2 - n + 1
            for item, at in owners:
                if seen.get((item, start - at), -1) >= start:
                    continue
                name, theirs = self.items[item]
                low, high = 0, n
                while low < min(start, at) and own[start - low - 1] == theirs[at - low - 1]:
                    low += 1
                while start + high < len(own) and at + high < len(theirs) and own[start + high] == theirs[at + high]:
                    high += 1
                seen[item, start - at] = start + high - 1
                if low + high >= min(self.window, len(theirs)):
                    spans.append((start - low, start + high))
                    found.add(name)
        return merge(spans), found


#: The last automaton that this worker built, under its broadcast's token.
_BUILT: dict[str, Windows] = {}


def _windows(token: str, items: list[tuple[str, bytes]], window: int) -> Windows:
    if token not in _BUILT:
        _BUILT.clear()
        _BUILT[token] = Windows(items, window)
    return _BUILT[token]


def merge(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _item_groups(benchmark: DataFrame, item_col: str, text_col: str, max_bytes: int) -> Iterator[list[tuple[str, bytes]]]:
    """Items in groups of about ``max_bytes`` at most; one group at a time is on the driver."""
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("i"), utf8(text_col).alias("t"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("b")).first().b
    groups = max(1, -(-total // max_bytes))
    for g in range(groups):
        rows = items if groups == 1 else items.where(F.pmod(F.xxhash64("i", "t"), F.lit(groups)) == g)
        yield [(r.i, bytes(r.t)) for r in rows.collect()]


def find_windows(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    window: int = WINDOW,
    max_bytes: int = 8 << 20,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """All rows and columns of ``docs`` with what the benchmark's windows hit.

    Adds ``n_words``, ``n_hit``, ``n_items`` (long), ``items`` (sorted item ids,
    as strings), ``items_sha256``, ``contaminated`` (a hit, and 20 hits or more
    to 400 words: ``20 * n_hit >= n_words``), and ``spans``: the hit runs as
    byte offsets (from, to) into the original UTF-8 text.

    A null text has no words. A null item id counts as an item with the empty
    id; items without words have no window; repeated items count once. Columns
    of ``docs`` with the added names are replaced. Empty tables are fine. A very
    long text is scanned whole in its task, its words one list in memory.
    """
    bound_batches(docs.sparkSession)
    added = T.StructType.fromDDL(
        "n_words long, n_hit long, n_items long, items array<string>, items_sha256 string, "
        "contaminated boolean, spans array<struct<start:long,stop:long>>"
    )
    plain = docs.drop(*added.names)
    context = docs.sparkSession.sparkContext
    state = T.StructType.fromDDL("__hit_text binary, __hit_spans binary, __hit_items binary")
    rows = plain.select("*", utf8(text_col).alias("__hit_text"), F.lit(b"").alias("__hit_spans"), F.lit(b"").alias("__hit_items"))
    own, n = plain.columns, len(plain.columns)
    kept, found_names = [*own, *state.names], [*own, *added.names]

    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    digest = pa.schema(
        [("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items", pa.list_(pa.string())), ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("spans", span)]
    )
    passed_on = pa.schema([("s", pa.binary()), ("i", pa.binary())])

    def scanned(rows: DataFrame, items: list[tuple[str, bytes]], last: bool) -> DataFrame:
        """One automaton's pass over the rows; the last one also sums up."""
        sent = context.broadcast(items)
        token = uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = _windows(token, sent.value, window)
            for batch in batches:
                sink = Sink(digest if last else passed_on)
                for text, spans, found in rows_of([batch], "__hit_text", "__hit_spans", "__hit_items"):
                    words = words_of(text)
                    hit, ids = automaton.scan(words)
                    if spans:
                        hit, ids = merge([*pickle.loads(spans), *hit]), ids | pickle.loads(found)
                    if last:
                        n_hit, names = sum(b - a for a, b in hit), sorted(ids)
                        sha = hashlib.sha256(",".join(names).encode()).hexdigest()
                        sink.add(len(words), n_hit, len(names), names, sha, n_hit > 0 and 20 * n_hit >= len(words), _offsets(text, hit))
                    else:
                        sink.add(pickle.dumps(hit) if hit else b"", pickle.dumps(ids) if hit else b"")
                out = sink.flush()
                carried = [batch.column(i) for i in range(n if last else n + 1)]
                yield pa.RecordBatch.from_arrays(carried + out.columns, names=found_names if last else kept)

        return rows.mapInArrow(run, T.StructType([*plain.schema.fields, *(added if last else state).fields]))

    held: list[tuple[str, bytes]] | None = None
    for items in _item_groups(benchmark, item_col, item_text_col, max_bytes):
        if held is not None:
            rows = scanned(rows, held, last=False)
        held = items
    return scanned(rows, held or [], last=True)


def _offsets(text: bytes, spans: list[tuple[int, int]]) -> list[dict]:
    """Byte offsets of runs of words in the original text."""
    if not spans:
        return []
    places = [m.span() for m in IN_WORD.finditer(text)]
    return [{"start": places[a][0], "stop": places[b - 1][1]} for a, b in spans]
