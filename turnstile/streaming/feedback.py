"""Feedback that takes effect exactly once, though batches may be run again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstile.sources.sinks import manifest, read_version, upsert_batches

KEYS = ["conv_id", "turn"]


def apply_feedback(root: str, act: Callable[[DataFrame], DataFrame], parts: int = 16):
    """A ``foreachBatch`` writer for items ``conv_id, turn, ...``.

    ``act`` gets the items that are new and those that earlier batches left open, and gives
    ``conv_id, turn, settled, effect``. Items and effects are one table of snapshots under
    ``root``, and a batch is published with them or not at all: a batch that is run
    again finds itself in the manifest and applies nothing, one that died before
    finds nothing of itself. Settled items are only known again, whatever comes.
    """
    publish = upsert_batches(root, KEYS, "attempt", parts=parts)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        base = manifest(spark, root)
        if base and base.batches.get("stream", -1) >= batch_id:
            return
        items = batch.dropDuplicates(KEYS)
        columns = [c for c in items.columns if c not in KEYS]
        item = F.struct(*columns).alias("item")
        if base:
            ledger = read_version(spark, root, base).drop("part")
            known = ledger.select(*KEYS)
            fresh = items.join(known, KEYS, "left_anti").select(*KEYS, item, F.lit(0).cast("long").alias("attempt"))
            waiting = ledger.where("NOT settled").select(*KEYS, "item", "attempt")
            due = fresh.unionByName(waiting)
        else:
            due = items.select(*KEYS, item, F.lit(0).cast("long").alias("attempt"))
        done = act(due.select(*KEYS, "item.*")).select(*KEYS, "settled", "effect")
        publish(due.join(done, KEYS).select(*KEYS, "item", (F.col("attempt") + 1).alias("attempt"), "settled", "effect"), batch_id)

    return write
