"""The review queue: pairs of people in the band between stranger and match.

All keys meet once, in blocks: each pair of blocks is one product of matrices, of
which only the best cosine of each two keys leaves, and only where it reaches the
band. Clothes are looked at for the pairs that stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (as pa.compute)
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnstile.operators.search import review_queue_sql
from turnstile.plans.dialect import DUCKDB
from turnstile.plans.registry import cut, frames
from turnstile.settings import Settings

#: Templates of one block, two of which meet in a task. Rows are sent once a block, so blocks grow with
#: the table, from ``BLOCK`` to ``BLOCK_ROWS`` templates, before there are more than ``BLOCKS`` of them.
BLOCK = 2048
BLOCKS = 24
BLOCK_ROWS = 65_536
#: Products held at once.
HELD = 1 << 22

_BEST = pa.schema([("key_a", pa.int64()), ("key_b", pa.int64()), ("cosine", pa.float64())])
_LIKE = pa.schema([("key_a", pa.int64()), ("key_b", pa.int64()), ("likeness", pa.float64())])


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    whole = column.combine_chunks()
    return whole.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(whole), -1)


def key_maxima(table: pa.Table, low: int, high: int, floor: float) -> Iterator[tuple[int, int, float]]:
    """The best cosine of each two keys between the rows of two blocks, where it reaches ``floor``."""

    def side(block: int) -> tuple[np.ndarray, np.ndarray]:
        rows = table.filter(pa.compute.equal(table["block"], block)).sort_by("key")
        return rows["key"].to_numpy(), _vectors(rows["vec"]) if rows.num_rows else np.zeros((0, 0))

    def firsts(keys: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1))

    (keys_a, a), (keys_b, b) = side(low), side(high)
    if not len(keys_a) or not len(keys_b):
        return
    first_b = firsts(keys_b)
    step = max(1, HELD // len(keys_b))
    for s in range(0, len(keys_a), step):  # a key that is cut here gives two rows, of which the better one counts
        own = keys_a[s : s + step]
        first = firsts(own)
        best = np.maximum.reduceat(np.maximum.reduceat(a[s : s + step] @ b.T, first, axis=0), first_b, axis=1)
        for i, j in zip(*np.nonzero(best >= floor), strict=True):
            one, other = int(own[first[i]]), int(keys_b[first_b[j]])
            if one < other or (one > other and low != high):
                yield min(one, other), max(one, other), float(best[i, j])


def closest_keys(templates: DataFrame, floor: float) -> DataFrame:
    """``key_a, key_b, cosine`` of all pairs of keys whose closest templates reach ``floor``."""
    rows = templates.where("vec IS NOT NULL").select("key", "id", "vec")
    n = rows.count()
    blocks = max(1, min(-(-n // BLOCK), BLOCKS), -(-n // BLOCK_ROWS))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("long"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    dealt = dealt.select("key", "vec", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        found = list(key_maxima(table, key[0].as_py(), key[1].as_py(), floor))
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*found, strict=True) if found else [[]] * 3, _BEST, strict=True)], schema=_BEST)

    met = dealt.groupBy("low", "high").applyInArrow(meet, "key_a long, key_b long, cosine double")
    return met.groupBy("key_a", "key_b").agg(F.max("cosine").alias("cosine"))


def best_likeness(pairs: DataFrame, templates: DataFrame) -> DataFrame:
    """The best clothing overlap of each pair of keys; pairs where a side has none aren't in it."""
    looks = templates.where("appearance IS NOT NULL").select("key", "appearance")
    sides = [pairs.select("key_a", "key_b", F.col(f"key_{s}").alias("key"), F.lit(s).alias("side")).join(looks, "key") for s in "ab"]

    def like(key: tuple, table: pa.Table) -> pa.Table:
        a, b = (table.filter(pa.compute.equal(table["side"], s)) for s in "ab")
        if not a.num_rows or not b.num_rows:
            return pa.Table.from_arrays([pa.array([], f.type) for f in _LIKE], schema=_LIKE)
        x, y = _vectors(a["appearance"]), _vectors(b["appearance"])
        most = max(float(np.minimum(row, y).sum(axis=1).max()) for row in x)
        return pa.Table.from_arrays([pa.array([v], f.type) for v, f in zip((key[0].as_py(), key[1].as_py(), most), _LIKE, strict=True)], schema=_LIKE)

    both = sides[0].unionByName(sides[1])
    return both.groupBy("key_a", "key_b").applyInArrow(like, "key_a long, key_b long, likeness double")


@frames("templates", "cannot_link", oracle=lambda: review_queue_sql(DUCKDB))
def review_queue(k: Settings, templates: DataFrame, cannot_link: DataFrame) -> DataFrame:
    """Pairs of keys in the review band, measured clothes first, and how many were dropped."""
    band = closest_keys(templates, k.review_floor).where(F.col("cosine") < k.match_threshold)
    apart = cannot_link.select(F.col("a").alias("key_a"), F.col("b").alias("key_b"))
    pairs = cut(band.join(apart, ["key_a", "key_b"], "left_anti"))
    considered = pairs.count()
    queue = pairs.join(best_likeness(pairs, templates), ["key_a", "key_b"], "left")
    order = [F.col("likeness").isNull(), F.round("likeness", 9).desc(), F.round("cosine", 9).desc(), F.col("key_a"), F.col("key_b")]
    top = queue.orderBy(*order).limit(k.review_limit)
    place = F.row_number().over(W.orderBy(*order)).cast("long")  # over the limit's rows alone
    counted = F.lit(considered).cast("long")
    return top.select(
        "key_a", "key_b", F.round("cosine", 6).alias("cosine"), F.round("likeness", 6).alias("likeness"), place.alias("place"),
        counted.alias("considered"), F.greatest(counted - k.review_limit, F.lit(0).cast("long")).alias("dropped"),
    )
