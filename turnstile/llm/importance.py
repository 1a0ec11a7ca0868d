"""Target-distribution importance resampling with hashed n-grams.

Documents that look like a target are drawn more often: a hashed bag of n-grams
gives each bucket a gain, the log ratio of its share of the target to its share of
the corpus; a document's gains add up, and Gumbel noise makes the highest scores a
sample without replacement by those weights.

DuckDB runs inside each task over small blocks of texts: SQL takes the words apart,
a window puts n-grams together and a registered zlib function hashes them. Each
document's bucket counts are spilled to Parquet in the shared folder, so texts are
read once; Spark adds the buckets up (a few thousand numbers) and scores from the
spilled counts. Ranks come from a range-partitioned sort of the upper end alone.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnstile.llm.common import Sink, bound_batches, discard, materialize, rows_of

#: Fixed values of the contract: words, buckets, draws.
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS, PERCENT, LEAST_WORDS, SEED = 10_000, 5, 20, 42

#: Bytes of text in one block of SQL, and of one part of a longer text.
BLOCK = 2 << 20

_GAP = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
_NEXT_TWO = re.compile(rb"(?:[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+){1,2}")
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

#: ``tail`` words at the end of a part are those of the next part; n-grams may end in them, none starts there.
_SQL = rf"""
WITH doc AS (
  SELECT r, tail, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS}') AS w FROM block),
word AS (SELECT r, len(w) - tail AS own, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM doc),
gram AS (
  SELECT r, i, own, w, w || ' ' || lead(w, 1) OVER s AS w2, w || ' ' || lead(w, 1) OVER s || ' ' || lead(w, 2) OVER s AS w3
  FROM word WINDOW s AS (PARTITION BY r ORDER BY i))
SELECT r, crc32(w) AS a, crc32(w2) AS b, crc32(w3) AS c FROM gram WHERE i <= own
"""

_SPILL = pa.schema([("doc_id", pa.int64()), ("n_features", pa.int64()), ("buckets", pa.binary()), ("counts", pa.binary())])
_SPILL_DDL = "doc_id long, n_features long, buckets binary, counts binary"


def _crc32(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    """zlib's CRC of each string's UTF-8 bytes."""
    out: list[int] = []
    crc = zlib.crc32
    for part in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        _, offsets, data = part.buffers()
        ends = np.frombuffer(offsets, np.int32)[part.offset : part.offset + len(part) + 1].tolist()
        data = data.to_pybytes() if data is not None else b""
        out += [crc(data[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
    return pa.array(np.array(out, np.int64))


def _connection():
    """A DuckDB of this task alone, in memory, with the CRC function."""
    import duckdb

    connection = duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "temp_directory": "", "preserve_insertion_order": False})
    connection.create_function("crc32", _crc32, ["VARCHAR"], "BIGINT", type="arrow")
    return connection


def _keys(connection, rows: list[int], tails: list[int], texts: list[bytes], buckets: int) -> np.ndarray:
    """``row * buckets + bucket`` of every feature of a block of texts."""
    block = pa.table({"r": pa.array(rows, pa.int32()), "tail": pa.array(tails, pa.int32()), "text": pa.array(texts, pa.binary()).cast(pa.string())})
    connection.register("block", block)
    found = connection.sql(_SQL).to_arrow_table()
    r = found["r"].to_numpy().astype(np.int64) * buckets
    keys = []
    for name in "abc":
        column = found[name].combine_chunks()
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        there = column.is_valid().to_numpy(zero_copy_only=False)
        keys.append(r[there] + column.fill_null(0).to_numpy(zero_copy_only=False)[there] % buckets)
    connection.unregister("block")
    return np.concatenate(keys)


def _packed(buckets: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    """Buckets and counts in 16 bits each; a count beyond that is spread over entries of its bucket."""
    if len(counts) and counts.max() > 0xFFFF:
        times = -(-counts // 0xFFFF)
        last = np.cumsum(times) - 1
        spread = np.full(int(times.sum()), 0xFFFF, np.int64)
        spread[last] = counts - (times - 1) * 0xFFFF
        buckets, counts = np.repeat(buckets, times), spread
    return buckets.astype("<u2").tobytes(), counts.astype("<u2").tobytes()


def parts_of(text: bytes, size: int) -> Iterator[tuple[bytes, int]]:
    """A long text in parts cut between words, each with the next two words, and how many those are."""
    start = 0
    while start < len(text):
        gap = _GAP.search(text, start + size)
        end = gap.start() if gap else len(text)
        after = _NEXT_TWO.match(text, end)
        if not after:
            yield text[start:], 0
            return
        yield text[start : after.end()], len(_WORD.findall(after[0]))
        start = end


def spill_counts(texts: DataFrame, buckets: int) -> DataFrame:
    """Of each row ``id, text``: features, and its buckets in order with their counts (little endian, 16 bits)."""
    bound_batches(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink, connection = Sink(_SPILL, nbytes=4 << 20), _connection()
        ids: list[int | None] = []
        held: list[bytes] = []
        size = 0

        def emit(doc_id: int | None, found: np.ndarray, counts: np.ndarray) -> bool:
            a, b = _packed(found, counts)
            return sink.add(doc_id, int(counts.sum()), a, b, weight=len(a) + len(b))

        def settle() -> Iterator[pa.RecordBatch]:
            keys = np.sort(_keys(connection, list(range(len(held))), [0] * len(held), held, buckets)) if held else np.empty(0, np.int64)
            new = np.flatnonzero(np.diff(keys, prepend=-1))
            counts, keys = np.diff(new, append=len(keys)), keys[new]
            edges = np.searchsorted(keys, np.arange(len(held) + 1) * buckets)
            for k, doc_id in enumerate(ids):
                own = slice(edges[k], edges[k + 1])
                if emit(doc_id, keys[own] % buckets, counts[own]):
                    yield sink.flush()
            ids.clear()
            held.clear()

        for doc_id, text in rows_of(batches, "id", "text"):
            data = text or b""
            if len(data) > BLOCK:
                total = np.zeros(buckets, np.int64)
                for part, tail in parts_of(data, BLOCK):
                    total += np.bincount(_keys(connection, [0], [tail], [part], buckets), minlength=buckets)
                found = np.flatnonzero(total)
                if emit(doc_id, found, total[found]):
                    yield sink.flush()
                continue
            ids.append(doc_id)
            held.append(data)
            size += len(data)
            if size >= BLOCK or len(held) >= 4096:
                yield from settle()
                size = 0
        yield from settle()
        if len(sink):
            yield sink.flush()
        connection.close()

    return texts.mapInArrow(run, _SPILL_DDL)


def _entries(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets, counts and the rows' edges of a spilled batch, without a loop over rows."""
    values = []
    for name in ("buckets", "counts"):
        column = batch.column(batch.schema.get_field_index(name)).cast(pa.binary())
        _, offsets, data = column.buffers()
        ends = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
        data = data.to_pybytes()[ends[0] : ends[-1]] if data is not None else b""
        values.append(np.frombuffer(data, "<u2").astype(np.int64))
    return values[0], values[1], (ends - ends[0]) // 2


def bucket_totals(spilled: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket occurs: tasks send at most one row a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            found, counts, _ = _entries(batch)
            np.add.at(total, found, counts) if len(found) < buckets else np.add(total, np.bincount(found, counts, buckets).astype(np.int64), out=total)
        there = np.flatnonzero(total)
        yield pa.record_batch({"bucket": pa.array(there, pa.int64()), "n": pa.array(total[there], pa.int64())})

    sums = spilled.select("buckets", "counts").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for row in sums:
        out[row.bucket] = row.n
    return out


def gains_of(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of each bucket's shares, one added to every count."""
    n, size, wanted = len(corpus), float(corpus.sum()), float(target.sum())
    ratio = [(t + 1.0) * (size + n) / ((s + 1.0) * (wanted + n)) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)]
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], np.int64)


def weigh(spilled: DataFrame, gains: np.ndarray) -> DataFrame:
    """``doc_id, n_features, weight``: the gains of a document's features, added up. The gains are as many as buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, counts, edges = _entries(batch)
            sums = np.concatenate([[0], np.cumsum(gains[found] * counts)])
            weight = pa.array(sums[edges[1:]] - sums[edges[:-1]] if batch.num_rows else [], pa.int64())
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "n_features": batch.column("n_features"), "weight": weight})

    return spilled.mapInArrow(run, "doc_id long, n_features long, weight long")


def gumbel(doc_id: Column, seed: int) -> Column:
    """Thousandths of a Gumbel variable that follows from seed and id alone; a null id is like an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def features_of(words: int) -> int:
    """Runs of one to three words in a text of so many."""
    return max(words, 0) + max(words - 1, 0) + max(words - 2, 0)


def _ranked(scored: DataFrame, drawn: int, percent: int) -> DataFrame:
    """The ``drawn`` highest scores with their ranks; ties by id (null last), then by row.

    A quantile a percent lower than needed cuts the rest off (its error is a hundredth of that), so only
    that much is sorted: by ranges over score, id and row, so that ties of any number are split. Ranks are
    places within a range after the rows of the ranges before it; the ranges' counts are all the driver sees.
    """
    spark = scored.sparkSession
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row")]
    cut = scored.agg(F.percentile_approx("score", max(0.0, 0.99 - percent / 100), 10_000)).first()[0]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = scored.where(F.col("score") >= cut).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = materialize(ranges.withColumn("place", F.monotonically_increasing_id()), "importance-ranked")
    part = F.shiftright("place", 33)
    before, offsets = 0, []
    for p, n in sorted((r.part, r.n) for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()):
        offsets.append((p, before))
        before += n
    offset = F.broadcast(spark.createDataFrame(offsets, "part long, before long"))
    ranked = placed.withColumn("part", part).join(offset, "part")
    place = F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("before") + 1
    return ranked.withColumn("rank", place).where(F.col("rank") <= drawn).drop("part", "before", "place")


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    buckets: int = BUCKETS,
    seed: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text_col: str = "text",
) -> DataFrame:
    """Every document's ``doc_id, n_features, weight, score, rank``; rank is null where it isn't drawn.

    Of the documents with ``least_words`` words or more, ``percent`` in a hundred (rounded
    down) are drawn by the highest scores, ties to the smaller id. At most 65,536 buckets.

    A null or empty text has no features, weight 0 and isn't drawn. Rows with a null id
    share their noise and come last among ties; repeated rows each count, are each ranked, and
    share a score, as do rows of one id and weight. No target, or an empty one, has no features: every
    gain is then that of one count more. An empty table gives an empty result. A very long text is
    taken apart in parts of 2 MB that lose no n-gram. Other columns aren't read.
    """
    if buckets > 1 << 16:
        raise ValueError("buckets are stored in 16 bits")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    aims = target.select(F.lit(None).cast("long").alias("id"), F.col(target_text_col).cast("binary").alias("text"))
    spilled = materialize(spill_counts(texts, buckets), "importance-counts")
    wanted = bucket_totals(spill_counts(aims, buckets), buckets)
    gains = gains_of(bucket_totals(spilled, buckets), wanted)
    score = (F.col("weight") + gumbel(F.col("doc_id"), seed)).alias("score")
    weighed = weigh(spilled, gains).select("doc_id", "n_features", "weight", score, F.monotonically_increasing_id().alias("row"))
    scored = materialize(weighed, "importance-scored")
    discard(spilled)
    asked = F.col("n_features") >= max(features_of(least_words), 0)
    drawn = percent * scored.where(asked).count() // 100
    columns = ["doc_id", "n_features", "weight", "score"]
    if not drawn:
        return scored.select(*columns, F.lit(None).cast("long").alias("rank"))
    ranked = materialize(_ranked(scored.where(asked), drawn, percent), "importance-drawn")
    last = ranked.where(F.col("rank") == drawn).first()
    # What comes after the last one drawn, in the same order: no join with the drawn.
    same = F.col("score") == last.score
    later_id = F.col("doc_id").isNull() if last.doc_id is not None else F.lit(False)
    if last.doc_id is not None:
        later_id = later_id | (F.col("doc_id") > last.doc_id)
    after = (F.col("score") < last.score) | (same & later_id) | (same & F.col("doc_id").eqNullSafe(F.lit(last.doc_id).cast("long")) & (F.col("row") > last.row))
    rest = scored.where(~asked | after).select(*columns, F.lit(None).cast("long").alias("rank"))
    return ranked.select(*columns, F.col("rank").cast("long").alias("rank")).unionByName(rest)
