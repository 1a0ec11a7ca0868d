"""Substring dedup by sliding sentence spans.

A sentence ends at a line's end or at ``. ! ?`` before white space. Text without
such ends is common, so a sentence of over ``LONGEST`` words is cut further,
before words that are the smallest of some ``WITHIN`` consecutive ones: that
depends on the words around alone, so that one passage is cut alike wherever it
stands, into parts of at most ``WITHIN`` words.

A span is a run of at least ``SPAN`` consecutive sentences with at least
``LEAST`` words. Every span of a text is hashed, lower-cased and with single
blanks; of equal spans, anywhere, the first stays (smallest id, then place) and
the sentences under every other one are removed from their texts, from their first
word to their last; white space stays. Any passage of
50 words holds a whole span.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstile.llm.common import bound_batches, map_rows, materialize, rows_of
from turnstile.llm.repeats import first_in_order, keyed_texts, only_repeated

SPAN = 3
LEAST = 15
LONGEST = 12
WITHIN = 6
#: Fixed patterns: where sentences end, and what a word is.
SPLIT = re.compile(rb"(?<=[.!?])(?=[\x20\x09-\x0D])|\n")
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def cuts(words: list[bytes]) -> list[int]:
    """Words of a long sentence before which it is cut: the first smallest of each ``WITHIN`` consecutive ones."""
    found, at = [], -1
    for i in range(len(words) - WITHIN + 1):
        if at < i:  # the last smallest one has left
            part = words[i : i + WITHIN]
            at = i + part.index(min(part))
            found.append(at)
        elif words[i + WITHIN - 1] < words[at]:
            at = i + WITHIN - 1
            found.append(at)
    return found[1:] if found and not found[0] else found


def sentences(text: bytes) -> list[list[bytes]]:
    """Lower-cased words of each sentence with a word; together they hold all words."""
    out = []
    for part in SPLIT.split(text.lower()):
        words = part.split()
        if len(words) > LONGEST:
            edges = [0, *cuts(words), len(words)]
            out += [words[i:j] for i, j in zip(edges, edges[1:], strict=False)]
        elif words:
            out.append(words)
    return out


def places(text: bytes, parts: list[list[bytes]]) -> Iterator[tuple[int, int]]:
    """(from, to) of each sentence in the text: from its first word to its last."""
    found = WORD.finditer(text)
    for words in parts:
        own = [m.span() for m in islice(found, len(words))]
        yield own[0][0], own[-1][1]


def spans(parts: list[list[bytes]]) -> Iterator[tuple[int, int]]:
    """(first, last) sentence of each span: the shortest from each sentence on."""
    size, last = 0, -1
    for first in range(len(parts)):
        if first:
            size -= len(parts[first - 1])
        while last + 1 < len(parts) and (size < LEAST or last - first + 1 < SPAN):
            last += 1
            size += len(parts[last])
        if size < LEAST or last - first + 1 < SPAN:
            return
        yield first, last


def span_hashes(text: bytes) -> tuple[list[bytes], list[tuple[int, int]]]:
    """A hash for each span of a text, and the spans."""
    parts = sentences(text)
    joined = list(map(b" ".join, parts))
    own = list(spans(parts))
    return [xxhash.xxh3_128_digest(b"\n".join(joined[i : j + 1])) for i, j in own], own


def _span_rows(source: DataFrame, whole: bool) -> DataFrame:
    """``h`` of every span, or its 128 bits, document and sentences."""
    inputs = ["doc_id", "key", "t"] if whole else ["t"]
    columns = ["h", "g", "doc_id", "key", "at", "end"] if whole else ["h"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests: list[bytes] = []
        own: list[tuple[int, int]] = []
        docs: list[tuple] = []

        def handed() -> pa.RecordBatch:
            both = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
            arrays = [pa.array(np.ascontiguousarray(both[:, 0]))]
            if whole:
                at, n = np.array(own, np.int64).reshape(-1, 2), [d[2] for d in docs]
                take = pa.array(np.repeat(np.arange(len(docs)), n))
                ids = [pa.array([d[k] for d in docs], pa.int64()).take(take) for k in (0, 1)]
                arrays += [pa.array(np.ascontiguousarray(both[:, 1])), *ids, *(pa.array(np.ascontiguousarray(at[:, k])) for k in (0, 1))]
            for x in (digests, own, docs):
                x.clear()
            return pa.RecordBatch.from_arrays(arrays, names=columns)

        for row in rows_of(batches, *inputs):
            found, places_ = span_hashes(row[-1])
            digests += found
            if whole:
                own += places_
                docs.append((row[0], row[1], len(found)))
            if len(digests) > 50_000:
                yield handed()
        if digests:
            yield handed()

    return source.select(*inputs).mapInArrow(run, ", ".join(f"{c} long" for c in columns))


def repeated_sentences(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``key`` and ``later``: (first, last) sentences of spans that aren't the first of their kind."""
    source = keyed_texts(docs, id_col, text_col)

    found = only_repeated(_span_rows(source, False), _span_rows(source, True), "spans")
    # Written, so that the join reads both sides as they are dealt and Spark can split a hot run.
    first = materialize(found.groupBy("h", "g").agg(F.min(first_in_order("at")).alias("first")), "first-spans")
    later = found.join(first, ["h", "g"]).where(first_in_order("at") != F.col("first"))
    return later.groupBy("doc_id", "key").agg(F.collect_set(F.struct("at", "end")).alias("later"))


def dedup_sentences(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs`` with what is left of its text.

    Columns: ``doc_id``, ``n_sentences``, ``n_removed``, ``n_bytes``,
    ``n_removed_bytes`` (long), ``kept_sha256`` and ``kept_text``.

    A null text is empty. A text too short for a span stays whole. Null ids come last in the order of documents. Rows with one id
    and one text are one document and never remove each other. Other columns are
    not read. An empty table gives an empty table. A very long text is one value
    where it is cut and where it is put together again; its spans are rows.
    """
    bound_batches(docs.sparkSession)
    removed = repeated_sentences(docs, id_col=id_col, text_col=text_col)
    source = keyed_texts(docs, id_col, text_col)
    found = removed.select(F.col("doc_id").alias("own_id"), F.col("key").alias("own_key"), F.col("later.at").alias("at"), F.col("later.end").alias("end"))
    joined = source.join(found, F.col("key").eqNullSafe(F.col("own_key")) & F.col("doc_id").eqNullSafe(F.col("own_id")), "left")

    def row(doc, text, at, end) -> Iterable[tuple]:
        parts = sentences(text)
        gone = {k for i, j in zip(at or (), end or (), strict=True) for k in range(i, j + 1)}
        left = text
        if gone:
            kept, last = [], 0
            for k, (a, b) in enumerate(places(text, parts)):
                if k in gone:
                    kept.append(text[last:a])
                    last = b
            left = b"".join([*kept, text[last:]])
        yield doc, len(parts), len(gone), len(text), len(text) - len(left), hashlib.sha256(left).hexdigest(), left.decode("utf-8", "replace")

    long = pa.int64()
    schema = pa.schema(
        [("doc_id", long), ("n_sentences", long), ("n_removed", long), ("n_bytes", long), ("n_removed_bytes", long), ("kept_sha256", pa.string()), ("kept_text", pa.string())]
    )
    return map_rows(
        joined,
        ["doc_id", "t", "at", "end"],
        schema,
        "doc_id long, n_sentences long, n_removed long, n_bytes long, n_removed_bytes long, kept_sha256 string, kept_text string",
        row,
    )
