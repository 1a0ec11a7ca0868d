"""Exact search that leaves pairs out: cells with centres and radii.

The rows that answer are dealt to their nearest of a bounded number of centres. By
the inequality of Cauchy and Schwarz no row g of a cell with centre c and radius r
scores more with a probe p than p.c + |p| r. A probe first meets the cell that promises
most, and then only cells that may still hold a better row or an equal one. What is
left out can't matter, so the result is that of the full product; where too little
can be left out the full product is what runs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnstile.operators.search import cosine_top1
from turnstile.plans.dialect import DUCKDB
from turnstile.plans.registry import apply, cut, frames
from turnstile.settings import Settings

#: Centres at most: a sample of the rows that answer, as many as their square root.
MOST_CENTRES = 1024
#: Rows of a cell that one task meets at once; larger cells are cut.
CELL_ROWS = 4096
#: Rows of probes and cells that a task makes at once.
ASKED = 8_192
#: Share of all pairs from which the full product is run.
NOTHING_LEFT_OUT = 0.9
#: Sums of products differ by their order of summation.
SLACK = 1e-9


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), float)


class Cells:
    """The centres, radii and sizes of a gallery's cells; as many numbers as centres, whatever the gallery."""

    def __init__(self, gallery: DataFrame, centres: int = 0):
        rows = gallery.select("id", "key", "vec").where("vec IS NOT NULL")
        self.total = rows.count()
        wanted = centres or min(MOST_CENTRES, max(1, math.isqrt(self.total)))
        sample = rows.orderBy(F.xxhash64("id"), "id").limit(wanted).collect()
        self.centres = _matrix(pd.Series([r.vec for r in sample])) if sample else np.zeros((0, 1))
        own = self.centres

        def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    vectors = _matrix(batch["vec"])
                    squares = (own**2).sum(axis=1)[None, :] - 2 * vectors @ own.T
                    cell = squares.argmin(axis=1)
                    away = np.linalg.norm(vectors - own[cell], axis=1)
                    yield batch.assign(cell=cell.astype("int64"), away=away)

        self.rows = cut(rows.mapInPandas(deal, "id long, key long, vec array<double>, cell long, away double")) if sample else None
        self.radius, self.size = np.zeros(len(own)), np.zeros(len(own), np.int64)
        for r in self.rows.groupBy("cell").agg(F.max("away").alias("radius"), F.count("*").alias("n")).collect() if sample else ():
            self.radius[r.cell], self.size[r.cell] = r.radius, r.n

    def blocks(self) -> np.ndarray:
        """Parts of each cell."""
        return self.__dict__.get("parts", np.maximum(1, -(-self.size // CELL_ROWS)))

    def _meets(self, batch: pd.DataFrame, first: bool) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
        """Some of the probes at a time, with the places of probes and the cells they have to meet."""
        parts = self.blocks()
        step = max(1, ASKED if first else ASKED // max(1, int(parts.sum())))
        for a in range(0, len(batch), step):
            some = batch.iloc[a : a + step]
            vectors = _matrix(some["vec"])
            dots = vectors @ self.centres.T
            # The first cell is where the closest centre is: it gives the highest bar.
            top = np.where(self.size > 0, dots, -np.inf).argmax(axis=1)
            if first:
                yield some, np.arange(len(some)), top
                continue
            promise = np.where(self.size > 0, dots + np.linalg.norm(vectors, axis=1)[:, None] * self.radius + SLACK, -np.inf)
            meets = promise >= some["best"].fillna(-np.inf).to_numpy(float)[:, None]
            meets[np.arange(len(some)), top] = False
            yield some, *np.nonzero(meets)

    def __getstate__(self) -> dict:
        """What tasks need: numbers of cells, no tables."""
        return {"centres": self.centres, "radius": self.radius, "size": self.size, "parts": self.blocks()}

    def open_to(self, probes: DataFrame, first: bool) -> DataFrame:
        """``probe, vec, cell, block`` of the cells that probes have to meet.

        The most promising cell alone with ``first``; otherwise all others that may hold what is as good as ``best``.
        """
        cells = self

        def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            parts = cells.blocks()
            for batch in batches:
                for some, at, cell in cells._meets(batch, first):
                    times = parts[cell]
                    at, cell = np.repeat(at, times), np.repeat(cell, times)
                    block = np.concatenate([np.arange(n) for n in times]) if len(times) else np.zeros(0, np.int64)
                    yield pd.DataFrame({"probe": some["probe"].to_numpy()[at], "vec": some["vec"].to_numpy()[at], "cell": cell.astype("int64"), "block": block.astype("int64")})

        return probes.mapInPandas(choose, "probe long, vec array<double>, cell long, block long")

    def pairs(self, probes: DataFrame) -> int:
        """Pairs that ``open_to`` (not ``first``) leads to, about where cells are cut; nothing but the sums is made."""
        cells = self

        def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            parts = cells.blocks()
            rows = -(-cells.size // parts) * parts
            for batch in batches:
                yield pd.DataFrame({"n": [sum(int(rows[cell].sum()) for _, _, cell in cells._meets(batch, False))]})

        return int(probes.mapInPandas(add, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])

    def met(self, asked: DataFrame) -> DataFrame:
        """The best row of each probe among the cells it meets: cosine, then the lowest id."""
        parts = F.element_at(F.array(*[F.lit(int(n)) for n in self.blocks()]), (F.col("cell") + 1).cast("int"))
        rows = self.rows.withColumn("block", F.pmod(F.xxhash64("id"), parts).cast("long"))
        pairs = asked.join(rows.withColumnRenamed("vec", "other"), ["cell", "block"]).where("id <> probe")
        best = F.max(F.struct(_dot("vec", "other").alias("cosine"), (-F.col("id")).alias("back"), "key"))
        return pairs.groupBy("probe").agg(best.alias("top"))


def _dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def _search(probes: DataFrame, gallery: DataFrame, centres: int) -> tuple[DataFrame | None, int, int]:
    """The best row of each probe (None where too little can be left out), pairs met, and all pairs."""
    cells = Cells(gallery, centres)
    asking = cut(probes.where("vec IS NOT NULL").select(F.col("id").alias("probe"), "vec"))
    everything = asking.count() * cells.total
    if not everything:
        return None, 0, 0
    first = cut(cells.met(cells.open_to(asking, True)))
    bar = asking.join(first.select("probe", F.col("top.cosine").alias("best")), "probe", "left")
    met = cells.pairs(bar) + int(asking.count() * cells.size.mean())
    if met > NOTHING_LEFT_OUT * everything:
        return None, everything, everything
    tops = first.unionByName(cells.met(cells.open_to(bar, False))).groupBy("probe").agg(F.max("top").alias("top"))
    return tops, met, everything


@frames("probes", "gallery", oracle=lambda: cosine_top1(DUCKDB))
def cosine_top1_cells(k: Settings, probes: DataFrame, gallery: DataFrame, centres: int = 0) -> DataFrame:
    """Each probe's closest other template, as ``cosine_top1`` gives it, without the pairs that bounds rule out."""
    tops, _, _ = _search(probes, gallery, centres)
    if tops is None:
        return apply("cosine_top1", k, probes=probes, gallery=gallery)
    return tops.select("probe", (-F.col("top.back")).alias("id"), F.col("top.key").alias("key"), F.round("top.cosine", 6).alias("cosine"))


@frames("probes", "gallery")
def search_pruning(k: Settings, probes: DataFrame, gallery: DataFrame, centres: int = 0) -> DataFrame:
    """What the bounds spare: pairs met (about, where cells are cut), all pairs, and the share left out."""
    _, met, everything = _search(probes, gallery, centres)
    share = 1 - met / everything if everything else 0.0
    return probes.sparkSession.createDataFrame([(met, everything, round(share, 6))], "met long, pairs long, left_out double")
