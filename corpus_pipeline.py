"""The training-corpus pipeline: rules, near-duplicates, decontamination, mixing, sharding.

``STAGES`` lists the stages in order; each takes ``(spark, docs, sf_dir)`` and
returns a DataFrame, which is written as Parquet and read as the next one's
documents. All but the last return the columns they were given. A document that
a source yields more than once stands in the mix more than once, under its id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstile.llm import decontam, mixing, quality, sharding, simhash
from turnstile.llm.common import broadcast_if_small, materialize, under_safe_names, utf8

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: What the stages read of a document; all else passes through under other names.
READ = ("doc_id", "text")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects, columns as they were.

    A null or empty text has no words and goes. Rows are judged one by one, so
    repeats fare alike; ids aren't looked at.
    """
    return under_safe_names(docs, READ, lambda safe: quality.cascade(safe).where("kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the one with the smallest id, null last.

    SimHash fingerprints and their pivots find the candidates; near copies agree to
    0.8 or more in their five-word shingles, directly or over others. Texts without
    words are copies of each other. Rows that share an id and a text (repeats) leave
    one row; different texts of one id, or without an id, are judged by their texts.
    """

    def named(row_id: str) -> Column:
        return F.xxhash64(F.col(row_id).isNull(), F.col(row_id).cast("long"))

    def one(safe: DataFrame) -> DataFrame:
        chosen, rows = simhash.one_of_each(safe)
        by = ["__row_key", "__row_id"]
        keyed = rows.groupBy(F.col("key").alias(by[0]), named("doc_id").alias(by[1])).agg(F.count("*").alias("n"))
        kept = chosen.select(F.col("key").alias(by[0]), named("doc_id").alias(by[1])).withColumn("kept", F.lit(True))
        judged = materialize(keyed.join(kept, by, "left").select(*by, "n", F.coalesce("kept", F.lit(False)).alias("kept")), "near-copies-judged")
        texts = safe.withColumn(by[0], F.xxhash64(utf8("text"))).withColumn(by[1], named("doc_id"))
        # What goes and what is repeated is far less than what stays, so texts that stay need not be dealt.
        other = judged.where("NOT kept OR n > 1").select(*by)
        alone = texts.join(broadcast_if_small(other, 24), by, "left_anti")
        repeated = texts.join(broadcast_if_small(judged.where("kept AND n > 1").select(*by), 24), by, "left_semi")
        # Repeats differ in other columns at most: the least of their hashes names the row, and one of equal rows stays.
        repeated = repeated.withColumn("__row_hash", F.xxhash64(F.to_json(F.struct(*[c for c in safe.columns if c != "text"])))).dropDuplicates([*by, "__row_hash"])
        least = materialize(repeated.groupBy(*by).agg(F.min("__row_hash").alias("__row_hash")), "near-copies-least")
        return alone.unionByName(repeated.join(broadcast_if_small(least, 32), [*by, "__row_hash"], "left_semi").drop("__row_hash"))

    return under_safe_names(docs, READ, one)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark doesn't contaminate, columns as they were.

    A null text has no words and stays; repeats fare alike.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return under_safe_names(docs, READ, lambda safe: decontam.find_windows(safe, benchmark).where(~F.col("contaminated")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources: rows as often as it takes them, columns as they were.

    A null source is a source, the last; a null text has no words and follows its
    source's rate; of repeated rows as many come as the mix needs.
    """
    return mixing.take_mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their shard and slot, and the text's ``size``.

    Null ids share a shard; repeats each have a slot. The four columns of the
    operator replace those of their names, as this stage's result is theirs.
    """
    return sharding.shard_records(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality", keep_quality),
    ("near_copies", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("mix", mix_sources),
    ("shard", shard),
]

#: The hashes of near-duplicates, mixing and sharding have no DuckDB counterpart.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
