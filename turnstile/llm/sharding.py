"""Sharding by a two-pass external shuffle, in DataFrame operations only.

Law ``key``: a row's shard depends on its id and the number of shards alone. The
shard is the one whose seeded hash with the id is largest, so one more shard
takes rows only into itself (rendezvous hashing; its cost is one hash per shard
and row, which suits hundreds of shards).

Pass one scatters the rows of a shard over memory-sized buckets by a second
seeded hash; pass two brings a bucket into one task, puts it in the order of that
hash and permutes it by a Fisher-Yates shuffle whose draws are hashes of seed,
shard, bucket and step. A row's slot is its place in its bucket after the buckets
before it, so slots are a function of the rows and the seed: neither the layout of
the input nor the number of partitions enters. The number of buckets follows from
the bytes and the rows, so it grows with the data and a task's memory does not.

Equal rows share their hash. Where they crowd a bucket they are counted first, with
partial sums where they are read, and each copy is scattered under its number.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnstile.llm.common import materialize

#: Bytes of a shuffle's task, and the most tasks.
TASK_BYTES = 64 << 20
MOST_TASKS = 1 << 16


def _best(id_col: str, shards: int, seed: int) -> Column:
    """The (hash, shard) of the winning shard."""
    draws = [F.struct(F.xxhash64(F.lit(seed), F.lit(i), F.col(id_col)).alias("h"), F.lit(i).alias("s")) for i in range(shards)]
    return F.greatest(*draws) if shards > 1 else draws[0]


def fisher_yates(n: Column, *seeds: Column) -> Column:
    """A permutation of 0 to ``n`` - 1: the inside-out Fisher-Yates shuffle, its draws seeded by hashes."""

    def step(done: Column, i: Column) -> Column:
        j = F.pmod(F.xxhash64(*seeds, i), i + 1).cast("int")
        moved = F.concat(F.slice(done, 1, j), F.array(i), F.slice(done, j + 2, i - j - 1), F.array(F.get(done, j)))
        return F.when(j == i, F.concat(done, F.array(i))).otherwise(moved)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.array().cast("array<int>"), step)


def shard_records(
    docs: DataFrame,
    shards: int = 24,
    *,
    seed: int = 10,
    bucket_bytes: int = 4 << 20,
    bucket_rows: int = 1024,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """All rows and columns of ``docs`` with ``size``, ``shard``, ``slot`` and ``grown_shard``.

    ``size`` is the text's UTF-8 bytes plus 8; slots of a shard run from 0
    without gaps; ``grown_shard`` is the shard if there were one more.
    ``bucket_bytes`` and ``bucket_rows`` are what one Fisher-Yates shuffle holds
    on average.

    A null text has no bytes; null ids are one id and share a shard, as the law
    wants. Repeated rows each have a slot, however many they are. Columns of
    ``docs`` named like the four above are replaced; columns must be of types
    that Spark can group by. An empty table stays empty. A very long text is one
    value in its bucket.
    """
    own = ("size", "shard", "slot", "grown_shard")
    plain = docs.drop(*own)
    # Names without dots or clashes while at work.
    given = plain.columns
    names = [c if c in (id_col, text_col) else f"__column_{i}" for i, c in enumerate(given)]
    plain = plain.toDF(*names)
    size = (F.coalesce(F.octet_length(text_col), F.lit(0)) + 8).cast("long")
    # A row a shard comes to the driver: each shard gets buckets for its own rows and bytes, so that an id with many texts crowds none.
    chosen = plain.select(_best(id_col, shards, seed)["s"].alias("shard"), size.alias("bytes"))
    totals = chosen.groupBy("shard").agg(F.count("*").alias("rows"), F.sum("bytes").alias("bytes")).collect()
    needed = {t.shard: max(1, math.ceil(t.bytes / bucket_bytes), math.ceil(t.rows / bucket_rows)) for t in totals}
    buckets = F.array(*[F.lit(needed.get(s, 1)) for s in range(shards)])
    tasks = min(MOST_TASKS, max(1, math.ceil(sum(t.bytes for t in totals) / TASK_BYTES)))

    def placed(rows: DataFrame, copy: Column) -> DataFrame:
        h = F.xxhash64(F.lit(seed + 1), *[F.col(c) for c in names], copy)
        best = rows.withColumn("__shard_best", _best(id_col, shards, seed)).withColumn("__shard_h", h)
        own = best.withColumn("shard", F.col("__shard_best.s"))
        return own.withColumn("__shard_bucket", F.pmod("__shard_h", F.get(buckets, F.col("shard"))).cast("int"))

    def counted(rows: DataFrame) -> DataFrame:
        return materialize(rows.groupBy("shard", "__shard_bucket").agg(F.count("*").alias("n")), "shard-counts")

    rows = placed(plain, F.lit(1))
    counts = counted(rows)
    fullest = counts.agg(F.max("n").alias("n")).first().n or 0
    if fullest > 4 * bucket_rows:  # rows alike in all columns have one hash
        copies = plain.groupBy(*names).agg(F.count("*").alias("__shard_n"))
        numbered = copies.withColumn("__shard_copy", F.explode(F.sequence(F.lit(1), F.col("__shard_n").cast("int"))))
        rows = placed(numbered, F.col("__shard_copy"))
        counts = counted(rows)

    before = W.partitionBy("shard").orderBy("__shard_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("shard", "__shard_bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__shard_before"))
    more = F.struct(F.xxhash64(F.lit(seed), F.lit(shards), F.col(id_col)).alias("h"), F.lit(shards).alias("s"))
    grown = F.greatest(F.col("__shard_best"), more)["s"]
    record = F.struct("__shard_h", *[F.col(c) for c in names], size.alias("size"), grown.alias("grown_shard"))
    gathered = (
        rows.select("shard", "__shard_bucket", record.alias("record"))
        .repartition(tasks, "shard", "__shard_bucket")
        .groupBy("shard", "__shard_bucket")
        .agg(F.array_sort(F.collect_list("record")).alias("rows"))
        .join(offsets, ["shard", "__shard_bucket"])
    )
    order = fisher_yates(F.size("rows"), F.lit(seed), F.col("shard"), F.col("__shard_bucket"))
    dealt = gathered.withColumn("order", order).select(
        "shard", "__shard_before", F.posexplode(F.transform("order", lambda i: F.get("rows", i))).alias("__shard_at", "row")
    )
    return dealt.select(
        *[F.col("row")[c].alias(shown) for c, shown in zip(names, given, strict=True)],
        F.col("row.size").alias("size"),
        "shard",
        (F.col("__shard_before") + F.col("__shard_at")).alias("slot"),
        F.col("row.grown_shard").alias("grown_shard"),
    )


def write_shards(records: DataFrame, path: str) -> DataFrame:
    """Write sharded records to ``path``, one folder a shard, and read them back.

    The tasks that permuted the buckets write them, each bucket's rows in the
    order of their slots; nothing is shuffled again and no task holds a shard.
    """
    records.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return records.sparkSession.read.schema(records.schema).parquet(path).select(*records.columns)
