"""Suffix-array dedup of repeated byte strings across a corpus.

A byte goes if a string of ``DEPTH`` bytes over it also starts earlier: in a
document with a smaller id, or earlier in the same one.

Equal strings have to meet in one place, and no task can hold a corpus' suffix
array. So every window of ``DEPTH`` bytes is named by its anchor: of its
substrings of ``GRAM`` bytes the one with the smallest hash, the first of equals.
Equal windows have equal anchors at equal distances. Consecutive windows with
one anchor form a segment.

1. Anchors that stand once in the corpus can't hold a repeat; their hashes are
   counted, and only segments of repeated anchors go on.
2. Segments with one content (a 128-bit hash) are one class: all but the first
   repeat the first as a whole. The first is the class' representative.
3. Representatives with one anchor but several contents may share some of their
   windows. They meet by anchor, and a suffix array over them, built by
   two-stage sorting (:mod:`turnstile.llm.suffix_array`), puts equal windows next
   to each other: adjacent common prefixes of ``DEPTH`` bytes say which. Of each
   run of equal windows all but the first in the order of documents repeat.
4. An anchor with more than ``GROUP`` different contents, such as the edge of a
   passage that a third of all documents quote, never lies in one task: its
   segments are cut again by anchors of ``LONG_GRAM`` bytes and go through steps 2
   and 3 once more. Where even such an anchor has more than ``GROUP`` contents, its
   windows are anchors of their own: each is a class by its hash.

What goes to a document is the runs of windows that repeat; their union is cut.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstile.llm.common import Sink, bound_batches, discard, map_rows, materialize, rows_of, utf8
from turnstile.llm.repeats import only_repeated
from turnstile.llm.suffix_array import adjacent_prefixes, two_stage_order

DEPTH = 100
GRAM, LONG_GRAM = 32, 64
REACH = DEPTH - GRAM + 1
GROUP = 4096
#: Bytes of segments in one suffix array.
BLOCK = 2 << 20
#: Bytes of a text whose anchors are sought at once.
CHUNK = 1 << 22
_PLACE = np.uint64((1 << 24) - 1)
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A hash of every ``gram`` consecutive bytes of each row, by doubling (``gram`` is a power of two)."""
    h = data.astype(np.uint64)
    h += np.uint64(1)
    h *= _A
    h ^= h >> np.uint64(29)
    width = 1
    while width < gram:
        right = h[..., width:]
        h = (h[..., :-width] * _B + (right ^ (right >> np.uint64(31)))) * _C
        h ^= h >> np.uint64(32)
        width *= 2
    return h


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    least, have = values, 1
    while 2 * have <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    more = width - have
    return np.minimum(least[: len(least) - more], least[more:]) if more else least


def anchors(text: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hash, place) of a text's anchors, in portions.

    A place packs the anchor's byte and the first and last start of its windows,
    counted back from it: ``byte << 14 | first << 7 | last``.
    """
    whole = np.frombuffer(text, np.uint8)
    for base in range(0, max(len(whole) - DEPTH + 1, 0), CHUNK):
        data = whole[base : base + CHUNK + DEPTH - 1]
        if len(data) < DEPTH:
            break
        h = _gram_hashes(data)
        least = _sliding_least((h & ~_PLACE) | np.arange(len(h), dtype=np.uint64), REACH)
        p = (least & _PLACE).astype(np.int64)
        cut = np.flatnonzero(np.concatenate(([True], p[1:] != p[:-1])))
        last = np.concatenate((cut[1:], [len(p)])) - 1
        own = p[cut]
        yield h[own].view(np.int64), (own + base) << 14 | (own - cut) << 7 | (own - last)


def unpack(place):
    """(anchor, first start, last start)."""
    p = place >> 14
    return p, p - (place >> 7 & 127), p - (place & 127)


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``name`` (hash of id and text, the same in every scan), ``doc_id``, ``t``."""
    text = utf8(text_col)
    doc = F.col(id_col).cast("long")
    return docs.select(F.xxhash64(doc, text).alias("name"), doc.alias("doc_id"), text.alias("t"))


_LONG = pa.int64()


def _anchor_rows(source: DataFrame, names: bool) -> DataFrame:
    columns = ["h", "name", "place"] if names else ["h"]
    inputs = ["name", "t"] if names else ["t"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        count = 0

        def handed() -> pa.RecordBatch:
            arrays = [pa.array(np.concatenate(x)) for x in zip(*held, strict=True)]
            held.clear()
            return pa.RecordBatch.from_arrays(arrays, names=columns)

        for row in rows_of(batches, *inputs):
            for h, place in anchors(row[-1]):
                held.append((h, np.full(len(h), row[0], np.int64), place) if names else (h,))
                count += len(h)
            if count > 100_000:
                yield handed()
                count = 0
        if held:
            yield handed()

    return source.select(*inputs).mapInArrow(run, ", ".join(f"{c} long" for c in columns))


def _content(data: bytes) -> tuple[int, int]:
    """A 128-bit hash, as two longs."""
    return struct.unpack(">qq", xxhash.xxh3_128_digest(data))


def _segment(text: bytes, place: int) -> bytes:
    _, a, b = unpack(place)
    return text[a : b + DEPTH]


_FIRST = ("last", "doc_id", "name", "place")


def _occurrences(source: DataFrame, found: DataFrame) -> DataFrame:
    """Segments of ``found(h, name, place)`` with the hash of their contents."""
    own = found.groupBy("name").agg(F.collect_set(F.struct("h", "place")).alias("own"))
    joined = source.join(own, "name").select("name", "doc_id", "t", F.col("own.h").alias("hs"), F.col("own.place").alias("places"))

    def row(name, doc, text, hs, places) -> Iterable[tuple]:
        p, a, b = unpack(np.array(places))
        # Names are 64 bits: the anchors themselves say whether the places are this text's.
        if b.max() + DEPTH > len(text):
            return
        grams = np.lib.stride_tricks.sliding_window_view(np.frombuffer(text, np.uint8), GRAM)
        for i in range(0, len(p), 4096):
            part = slice(i, i + 4096)
            own = _gram_hashes(grams[p[part]])[:, 0].view(np.int64)
            for h, place, first, last, found in zip(hs[part], places[part], a[part].tolist(), b[part].tolist(), own.tolist(), strict=True):
                if found == h:
                    x, y = _content(text[first : last + DEPTH])
                    yield x, y, h, doc, name, place

    names = ["x", "y", "h", "doc_id", "name", "place"]
    return map_rows(joined, ["name", "doc_id", "t", "hs", "places"], pa.schema([(n, _LONG) for n in names]), ", ".join(f"{n} long" for n in names), row)


def _of_text(source: DataFrame, own: DataFrame, how: str = "inner") -> DataFrame:
    """``source`` with the rows of ``own`` for its texts: names are 64 bits, so ids decide too."""
    theirs = own.withColumnRenamed("doc_id", "own_id").withColumnRenamed("name", "own_name")
    return source.join(theirs, (F.col("name") == F.col("own_name")) & F.col("doc_id").eqNullSafe(F.col("own_id")), how).drop("own_id", "own_name")


def _contents(source: DataFrame, reps: DataFrame) -> DataFrame:
    """``reps(h, last, doc_id, name, place)`` with their bytes; repeated rows of the input repeat them."""
    own = reps.groupBy("doc_id", "name").agg(F.collect_set(F.struct("h", "place")).alias("own"))
    joined = _of_text(source, own).select("name", "doc_id", "t", F.col("own.h").alias("hs"), F.col("own.place").alias("places"))

    def row(name, doc, text, hs, places) -> Iterable[tuple]:
        for h, place in zip(hs, places, strict=True):
            if unpack(place)[2] + DEPTH <= len(text):
                yield h, doc is None, doc, name, place, _segment(text, place)

    return _with_bytes(joined, ["name", "doc_id", "t", "hs", "places"], row)


def _with_bytes(df: DataFrame, inputs: list[str], row: Callable[..., Iterable[tuple]]) -> DataFrame:
    """``h, last, doc_id, name, place, s`` of each row that ``row`` yields, in batches of bounded bytes."""
    schema = pa.schema([("h", _LONG), ("last", pa.bool_()), ("doc_id", _LONG), ("name", _LONG), ("place", _LONG), ("s", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink = Sink(schema)
        for values in rows_of(batches, *inputs):
            for out in row(*values):
                if sink.add(*out, weight=len(out[-1])):
                    yield sink.flush()
        if len(sink):
            yield sink.flush()

    return df.select(*inputs).mapInArrow(run, "h long, last boolean, doc_id long, name long, place long, s binary")


def _finer(contents: DataFrame) -> DataFrame:
    """Segments cut again, at anchors of ``LONG_GRAM`` bytes."""

    def row(h, last, doc, name, place, s) -> Iterable[tuple]:
        _, first, end = unpack(place)
        own = _gram_hashes(np.frombuffer(s, np.uint8), LONG_GRAM)
        least = _sliding_least((own & ~_PLACE) | np.arange(len(own), dtype=np.uint64), DEPTH - LONG_GRAM + 1)
        at = (least & _PLACE).astype(np.int64)[: end - first + 1]
        cut = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1]))).tolist()
        for a, b in zip(cut, [*cut[1:], len(at)], strict=True):
            p = int(at[a])
            key = xxhash.xxh64_intdigest(own[p].tobytes(), h & (1 << 64) - 1) - (1 << 63)
            yield key, last, doc, name, (first + p) << 14 | (p - a) << 7 | (p - b + 1), s[a : b - 1 + DEPTH]

    return _with_bytes(contents, ["h", "last", "doc_id", "name", "place", "s"], row)


def repeated_windows(segments: list[bytes], starts: np.ndarray, rank: np.ndarray, first_start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which windows of some segments aren't the first of their kind.

    ``starts`` says how many windows each segment has, ``rank`` orders their
    documents and ``first_start`` is the text's place of the first window. Gives
    (segment, window within it) of each window with an equal, earlier one.
    """
    text = np.frombuffer(b"".join(segments), np.uint8)
    lengths = np.fromiter(map(len, segments), np.int64, len(segments))
    begin = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    wanted = np.zeros(len(text), bool)
    owner = np.repeat(np.arange(len(segments)), starts)
    inside = np.arange(len(owner)) - np.repeat(np.concatenate(([0], np.cumsum(starts)[:-1])), starts)
    wanted[begin[owner] + inside] = True
    order = two_stage_order(text, wanted, DEPTH)
    kind = np.cumsum(adjacent_prefixes(text, order, DEPTH) < DEPTH)
    own = np.searchsorted(begin, order, "right") - 1
    within = order - begin[own]
    by = np.lexsort((first_start[own] + within, rank[own], kind))
    kind = kind[by]
    later = by[np.concatenate(([False], kind[1:] == kind[:-1]))] if len(by) else by
    return own[later], within[later]


def _runs(own: np.ndarray, within: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(segment, from, to) of consecutive windows."""
    by = np.lexsort((within, own))
    own, within = own[by], within[by]
    if not len(own):
        return
    new = np.concatenate(([True], (own[1:] != own[:-1]) | (within[1:] != within[:-1] + 1)))
    first = np.flatnonzero(new)
    stop = np.concatenate((first[1:], [len(own)])) - 1
    yield from zip(own[first].tolist(), within[first].tolist(), within[stop].tolist(), strict=True)


def _by_suffixes(contents: DataFrame) -> DataFrame:
    """``doc_id, name, lo, hi``: windows that repeat one of another representative of their anchor."""
    dealt = contents.repartition("h").sortWithinPartitions("h", *_FIRST)
    schema = pa.schema([("doc_id", _LONG), ("name", _LONG), ("lo", _LONG), ("hi", _LONG)])

    def solved(rows: list[tuple]) -> Iterator[tuple]:
        _, last, doc, name, place, _ = (list(x) for x in zip(*rows, strict=True))
        place = np.array(place)
        _, a, b = unpack(place)
        rank = np.lexsort((np.array(name), np.array([d or 0 for d in doc]), np.array(last)))
        ranks = np.empty(len(rank), np.int64)
        ranks[rank] = np.arange(len(rank))
        # Segments of one text share a rank.
        key = [(last[i], doc[i], name[i]) for i in rank.tolist()]
        new = np.array([i > 0 and key[i] != key[i - 1] for i in range(len(key))])
        ranks = np.cumsum(new)[ranks]
        for i, lo, hi in _runs(*repeated_windows([r[5] for r in rows], b - a + 1, ranks, a)):
            yield doc[i], name[i], int(a[i]) + lo, int(a[i]) + hi

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink = Sink(schema)
        held: list[tuple] = []
        size = 0
        for row in rows_of(batches, "h", "last", "doc_id", "name", "place", "s"):
            if size >= BLOCK and row[0] != held[-1][0]:
                for out in solved(held):
                    if sink.add(*out):
                        yield sink.flush()
                held, size = [], 0
            if held and row[:5] == held[-1][:5]:  # a row that the input holds more than once
                continue
            held.append(row)
            size += len(row[5])
        if held:
            for out in solved(held):
                if sink.add(*out):
                    yield sink.flush()
        if len(sink):
            yield sink.flush()

    return dealt.mapInArrow(run, "doc_id long, name long, lo long, hi long")


def _by_windows(contents: DataFrame) -> DataFrame:
    """As :func:`_by_suffixes`, for anchors with very many contents: window by window."""

    def row(last, doc, name, place, s) -> Iterable[tuple]:
        _, a, b = unpack(place)
        for i in range(b - a + 1):
            yield *_content(s[i : i + DEPTH]), last, doc, name, a + i

    schema = pa.schema([("x", _LONG), ("y", _LONG), ("last", pa.bool_()), ("doc_id", _LONG), ("name", _LONG), ("place", _LONG)])
    ddl = "x long, y long, last boolean, doc_id long, name long, place long"
    windows = materialize(map_rows(contents, ["last", "doc_id", "name", "place", "s"], schema, ddl, row), "windows")
    first = materialize(windows.groupBy("x", "y").agg(F.min(F.struct(*_FIRST)).alias("first")), "first-windows")
    later = windows.join(first, ["x", "y"]).where(F.struct(*_FIRST) != F.col("first"))
    return later.select("doc_id", "name", F.col("place").alias("lo"), F.col("place").alias("hi"))


def _spans(segments: DataFrame) -> DataFrame:
    """``doc_id, name, lo, hi``: the windows of whole segments."""
    p = F.shiftright("place", 14)
    low, high = F.shiftright("place", 7).bitwiseAND(F.lit(127)), F.col("place").bitwiseAND(F.lit(127))
    return segments.select("doc_id", "name", (p - low).alias("lo"), (p - high).alias("hi"))


def _by_longer_anchors(contents: DataFrame) -> list[DataFrame]:
    """As :func:`_by_suffixes`, for anchors with very many contents."""
    finer = materialize(_finer(contents).withColumn("x", F.md5("s")), "finer-segments")
    first = materialize(finer.groupBy("h", "x").agg(F.min(F.struct(*_FIRST)).alias("first"), F.first("s").alias("s")), "finer-classes")
    whole = finer.join(first.select("h", "x", "first"), ["h", "x"]).where(F.struct(*_FIRST) != F.col("first"))
    sizes = materialize(first.groupBy("h").agg(F.count("*").alias("contents")).where("contents > 1"), "finer-sizes")
    reps = first.join(sizes, "h").select("h", "contents", "first.*", "s")
    parts = [materialize(_spans(whole), "finer-repeats"), materialize(_by_suffixes(reps.where(F.col("contents") <= GROUP).drop("contents")), "finer-suffix-repeats")]
    if sizes.where(F.col("contents") > GROUP).limit(1).count():
        parts.append(materialize(_by_windows(reps.where(F.col("contents") > GROUP)), "window-repeats"))
    discard(finer, first)
    return parts


def repeated_starts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, name, lo, hi``: starts, by document, of strings that also start earlier."""
    source = _named(docs, id_col, text_col)
    found = only_repeated(_anchor_rows(source, False), _anchor_rows(source, True), "anchors")
    seen = materialize(_occurrences(source, found), "segments")
    discard(found)
    seen_rows = seen.withColumn("last", F.col("doc_id").isNull())
    classes = seen_rows.groupBy("x", "y").agg(F.min(F.struct(*_FIRST)).alias("first"), F.min("h").alias("h"), F.count("*").alias("n"))
    classes = materialize(classes, "segment-classes")
    later = seen_rows.join(classes.where("n > 1").select("x", "y", "first"), ["x", "y"]).where(F.struct(*_FIRST) != F.col("first"))
    # Each part is written by itself, so that its shuffles go before the next one's begin.
    whole = materialize(_spans(later), "whole-repeats")
    discard(seen)
    sizes = materialize(classes.groupBy("h").agg(F.count("*").alias("contents")).where("contents > 1"), "anchor-sizes")
    reps = classes.join(sizes, "h").select("h", "contents", "first.*")
    parts = [whole, materialize(_by_suffixes(_contents(source, reps.where(F.col("contents") <= GROUP))), "suffix-repeats")]
    if sizes.where(F.col("contents") > GROUP).limit(1).count():
        parts += _by_longer_anchors(_contents(source, reps.where(F.col("contents") > GROUP)))
    discard(classes)
    return reduce(DataFrame.unionByName, parts)


def dedup_bytes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs`` with what is left of its UTF-8 bytes.

    Columns: ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans`` (maximal runs
    removed), ``kept_sha256`` and ``kept`` (the bytes left; a cut may fall inside
    a character).

    A null text is empty; a text under ``DEPTH`` bytes loses nothing. Null ids
    come last in the order of documents. Rows with one id and one text are one
    document and never remove each other; of texts with one id the order is that
    of their names. Other columns are not read. An empty table stays empty. A very
    long text is one value where it is cut into segments and where it is put together
    again; between the two its segments are rows.
    """
    bound_batches(docs.sparkSession)
    ranges = repeated_starts(docs, id_col=id_col, text_col=text_col)
    own = ranges.groupBy("doc_id", "name").agg(F.collect_set(F.struct("lo", "hi")).alias("own"))
    source = _named(docs, id_col, text_col)
    joined = _of_text(source, own, "left").select("doc_id", "t", F.col("own.lo").alias("lo"), F.col("own.hi").alias("hi"))

    def row(doc, text, lo, hi) -> Iterable[tuple]:
        kept, n_spans, end = [], 0, 0
        for a, b in sorted(zip(lo or (), hi or (), strict=True)):
            b = min(b + DEPTH, len(text))
            if a > end or not n_spans:
                kept.append(text[end:a])
                n_spans += 1
                end = b
            else:
                end = max(end, b)
        kept.append(text[end:])
        left = b"".join(kept)
        yield doc, len(text), len(text) - len(left), n_spans, hashlib.sha256(left).hexdigest(), left

    schema = pa.schema([("doc_id", _LONG), ("n_bytes", _LONG), ("n_removed", _LONG), ("n_spans", _LONG), ("kept_sha256", pa.string()), ("kept", pa.binary())])
    return map_rows(joined, ["doc_id", "t", "lo", "hi"], schema, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary", row)
