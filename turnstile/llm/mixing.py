"""Mixing sources to target weights by Pareto order sampling.

A source that is to yield ``r`` times its size first gets ``floor(r)`` whole
copies of each of its documents. The rest is a sample of fixed size, in words:
each document draws ``U`` from a seeded hash, and documents are taken in the
order of ``odds(U) / odds(p)``, ``p`` being the inclusion probability, until the
words missing are there. A document's inclusion odds are those of the source,
times its own ``tilt`` where one is given, so that samples may prefer some
documents and no document ever gets more than one copy beyond the whole ones.

No source is ever sorted as a whole: the Pareto variable is mapped to (0, 1),
counted in ``CELLS`` equal cells per source (partial sums, then a shuffle of at
most sources x cells rows), and only the one cell where a source's sample ends
is ranked. A source with a third of all rows has about one in ``CELLS`` of its
distinct rows there: repeated rows are counted first. What comes out is one place
a source where its sample ends, so every row is decided where it is read. Where
that place falls among repeated rows, they are numbered task by task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnstile.llm.common import materialize, under_safe_names, word_count

#: Cells of the Pareto variable per source.
CELLS = 4096


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: int = 2
) -> DataFrame:
    """Targets of sources from ``sizes(source, source_size)``, one row a source.

    Sources by code point, null last, weigh ``weights``, repeating, and share
    ``share`` times all sizes. A target stops at ``most`` times its source's
    size; the excess goes to the others by weight, until none is above. That is
    the level ``l`` at which the targets ``min(most * size, l * weight)`` reach
    the sum, found in one pass over the sources in the order of the level at
    which each is full. Sources are a dimension: their number doesn't grow with
    the documents, and the windows below see one row each.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]),
        ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"),
    )
    full = F.col("source_size") * F.lit(float(most))
    weighed = sizes.withColumn("weight", weight).withColumn("level", full / F.col("weight"))
    order = W.orderBy("level", F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    rest = order.rowsBetween(0, W.unboundedFollowing)
    levels = weighed.withColumn(
        "at",
        (F.sum(F.col("source_size").cast("double")).over(W.partitionBy()) * F.lit(float(share)) - F.coalesce(F.sum(full).over(before), F.lit(0.0)))
        / F.sum("weight").over(rest),
    )
    # The first source that isn't full at its own level sets the level of all that follow.
    place = F.row_number().over(order)
    first = F.min(F.when(F.col("at") <= F.col("level"), F.struct("place", "at"))).over(W.partitionBy())
    levels = levels.withColumn("place", place).withColumn("first", first)
    target = F.when(F.col("place") < F.col("first.place"), full).otherwise(F.least(full, F.col("first.at") * F.col("weight")))
    target = F.coalesce(target, full)
    return levels.select("source", "source_size", target.alias("target"))


def _cuts(digest: DataFrame) -> DataFrame:
    """Where each source's sample ends: the last of its rows to come in, and how many of those equal to it do."""
    groups = (
        digest.where(F.col("__mix_cell") == F.col("__mix_last"))
        .groupBy("__mix_source", "__mix_at", "__mix_tie")
        .agg(F.count("*").alias("n"), F.max("size").alias("size"), F.first("__mix_need").alias("need"), F.first("__mix_before").alias("before"))
    )
    order = W.partitionBy("__mix_source").orderBy("__mix_at", "__mix_tie").rowsBetween(W.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum(F.col("n") * F.col("size")).over(order), F.lit(0))
    # A row is in if its middle is: the error is half a document at most.
    room = F.col("need") - F.col("start")
    k = F.when(F.col("size") > 0, F.floor(room / F.col("size") + 0.5)).otherwise(F.when(room >= 0, F.col("n")).otherwise(0))
    some = groups.withColumn("start", start).withColumn("k", F.greatest(F.lit(0), F.least("n", k))).where("k > 0")
    ends = some.groupBy("__mix_source").agg(F.max(F.struct("__mix_at", "__mix_tie", "k", "n")).alias("end"))
    return ends.select(F.col("__mix_source").alias("__mix_key"), F.col("end.__mix_at").alias("__mix_end"), F.col("end.__mix_tie").alias("__mix_end_tie"), F.col("end.k").alias("__mix_k"), F.col("end.n").alias("__mix_n"))


def mix(
    docs: DataFrame,
    *,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    most: int = 2,
    seed: int = 20,
    tilt: Column | None = None,
    columns: Sequence[str] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """All rows of ``docs`` with ``size``, ``source_size``, ``target`` and ``copies``.

    ``copies`` says how often the mix takes the row; 0 means never. ``tilt``, a
    positive column over ``docs``, multiplies a row's inclusion odds (it may
    refer to ``size``); none means 1. ``columns`` are those of ``docs`` that are
    wanted; without the text among them it is read only once.

    Nulls: a null text has size 0; a null source is a source of its own, the
    last; a null id is an id. Rows of size 0 follow their source's rate and add
    no words. Repeated rows tie; a sample that ends among them takes as many as
    it needs. Columns of ``docs`` named like the four above are replaced; all
    other columns stay. An empty table gives an empty table. A very long text is
    counted as one value and moves only if it is among ``columns``. Rows of one id and
    text that differ elsewhere tie: which of them a sample takes follows their places.
    """
    own = {"size", "source_size", "target", "copies"}
    names = [c for c in (docs.columns if columns is None else columns) if c.lower() not in own]
    tie = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))
    sized = docs.drop(*own).withColumn("size", word_count(text_col))
    keyed = (
        sized.withColumn("__mix_tie", tie)
        .withColumn("__mix_tilt", F.coalesce(tilt if tilt is not None else F.lit(1.0), F.lit(1.0)).cast("double"))
        .withColumn("__mix_of", F.col(source_col))
    )
    worked = ("__mix_of", "size", "__mix_tie", "__mix_tilt")
    digest = materialize(keyed.select(*([] if columns is None else names), *worked), "mix-digest")
    if columns is not None:
        keyed = digest
    targets = source_targets(digest.groupBy(F.col("__mix_of").alias("source")).agg(F.sum("size").alias("source_size")), weights, share, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = (
        targets.withColumn("__mix_whole", F.floor(rate))
        .withColumn("__mix_part", rate - F.floor(rate))
        .withColumn("__mix_need", F.col("target") - F.floor(rate) * F.col("source_size"))
        .withColumnRenamed("source", "__mix_source")
    )
    plan = materialize(plan, "mix-plan")

    def with_cell(rows: DataFrame, aim: DataFrame) -> DataFrame:
        """Adds each row's plan, and its Pareto variable q / (1 + q)."""
        u = (F.shiftrightunsigned("__mix_tie", 11).cast("double") + 0.5) / float(1 << 53)
        odds = F.col("__mix_part") / (1 - F.col("__mix_part")) * F.col("__mix_tilt")
        q = u / (1 - u) / odds
        joined = rows.join(aim, F.col("__mix_of").eqNullSafe(F.col("__mix_source")))
        at = F.when(F.col("__mix_part") > 0, q / (1 + q))
        return joined.withColumn("__mix_at", at).withColumn("__mix_cell", F.floor(at * CELLS))

    cells = with_cell(digest, plan).groupBy("__mix_source", "__mix_cell").agg(F.sum("size").alias("words"), F.first("__mix_need").alias("need"))
    run = F.sum("words").over(W.partitionBy("__mix_source").orderBy("__mix_cell"))
    last = (
        cells.where(F.col("__mix_cell").isNotNull())
        .withColumn("run", run)
        .where(F.col("run") >= F.col("need"))
        .groupBy("__mix_source")
        .agg(F.min("__mix_cell").alias("__mix_last"), F.min_by(F.col("run") - F.col("words"), "__mix_cell").alias("__mix_before"))
        .withColumnRenamed("__mix_source", "__mix_key")
    )
    # Rounding can leave a source without such a cell: then every row of it is in.
    aim = materialize(
        plan.join(last, F.col("__mix_source").eqNullSafe(F.col("__mix_key")), "left").drop("__mix_key")
        .withColumn("__mix_last", F.coalesce("__mix_last", F.lit(CELLS + 1)))
        .withColumn("__mix_before", F.coalesce("__mix_before", F.lit(0))),
        "mix-aim",
    )
    cuts = _cuts(with_cell(digest, aim))
    aim = materialize(aim.join(cuts, F.col("__mix_source").eqNullSafe(F.col("__mix_key")), "left").drop("__mix_key"), "mix-ends")
    placed = with_cell(keyed, aim)
    at_end = (F.col("__mix_cell") == F.col("__mix_last")) & (F.col("__mix_at") == F.col("__mix_end")) & (F.col("__mix_tie") == F.col("__mix_end_tie"))
    before = (F.col("__mix_at") < F.col("__mix_end")) | ((F.col("__mix_at") == F.col("__mix_end")) & (F.col("__mix_tie") < F.col("__mix_end_tie")))
    taken = F.when(F.col("__mix_cell") != F.col("__mix_last"), F.col("__mix_cell") < F.col("__mix_last")).otherwise(before | at_end)
    shown = [*names, "size", "source_size", "target"]
    copies = lambda more: (F.col("__mix_whole") + F.when(more, 1).otherwise(0)).cast("long").alias("copies")
    if not aim.where("__mix_k < __mix_n").limit(1).count():
        return placed.select(*shown, copies(taken))
    # Some of several equal rows: each task's are numbered after those of the tasks before.
    torn = F.coalesce(at_end & (F.col("__mix_k") < F.col("__mix_n")), F.lit(False))
    crowd = materialize(placed.where(torn).select(*shown, "__mix_source", "__mix_whole", "__mix_k", F.spark_partition_id().alias("__mix_task")), "mix-crowd")
    by_task = crowd.groupBy("__mix_source", "__mix_task").agg(F.count("*").alias("n"))
    earlier = W.partitionBy("__mix_source").orderBy("__mix_task").rowsBetween(W.unboundedPreceding, -1)
    offsets = by_task.select(F.col("__mix_source").alias("__mix_key"), F.col("__mix_task").alias("__mix_own"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__mix_first"))
    within = W.partitionBy("__mix_source", "__mix_task").orderBy(F.lit(0))
    numbered = crowd.withColumn("__mix_number", F.row_number().over(within)).join(
        F.broadcast(offsets) if offsets.count() < 100_000 else offsets,
        F.col("__mix_source").eqNullSafe(F.col("__mix_key")) & (F.col("__mix_task") == F.col("__mix_own")),
    )
    some = numbered.select(*shown, copies(F.col("__mix_first") + F.col("__mix_number") <= F.col("__mix_k")))
    return placed.where(~torn).select(*shown, copies(taken)).unionByName(some)


def take_mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as :func:`mix` takes it, columns as before."""

    def repeated(safe: DataFrame) -> DataFrame:
        mixed = mix(safe, **options).where(F.col("copies") > 0)
        return mixed.withColumn("__mix_n", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))

    read = [options.get(f"{c}_col", d) for c, d in (("id", "doc_id"), ("text", "text"), ("source", "source"))]
    return under_safe_names(docs, read, repeated)
