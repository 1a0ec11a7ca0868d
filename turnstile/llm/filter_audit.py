"""Filter interaction audit: what each filter removes in every order of application.

A relational word pipeline measures the documents: words are exploded, counted by
(document, word), and again by document for totals and distinct words. The other
flags are joined to that from outside, and one aggregate counts, a part, the 32
combinations of the five flags in 32 conditional columns (again for good and for
toxic documents). All orders and steps follow from those counts, so no order reads
the documents again.

Texts are dealt once, by a row number, so both word aggregates work where the rows
lie and no copy or id is hot. Copies meet as counts of 128-bit text hashes.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnstile.llm.common import discard, materialize

#: Fixed values of the contract: the filters, and white space between words.
FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_UPPER = 200, 50, 3
SPACE, SYMBOL = r"[\x20\x09-\x0D]+", r"[#$%&*|]"

#: Bytes of text that one task of the word aggregates handles.
TASK_BYTES = 4 << 20

_COMBINATIONS = 1 << len(FILTERS)


def measure(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """A row a document: ``row, doc_id, part_key, hash_a, hash_b, marks, n_words, n_distinct``, as a table.

    ``marks`` has bit 1 if upper case letters are too many and bit 2 for a symbol.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // TASK_BYTES + 1)
    upper = 100 * F.regexp_count(text, F.lit("[A-Z]")) > MOST_UPPER * F.char_length(text)
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).cast("long").alias("doc_id"),
        F.xxhash64(_part(part_col)).alias("part_key"),
        F.xxhash64(text).alias("hash_a"),
        F.xxhash64(F.lit("again"), text).alias("hash_b"),
        (F.when(upper, 1).otherwise(0) + F.when(text.rlike(SYMBOL), 2).otherwise(0)).cast("long").alias("marks"),
        text.alias("text"),
    ).repartition(parts, "row")
    kept = ["doc_id", "part_key", "hash_a", "hash_b", "marks"]
    # A text always has an item, if only an empty one, so no document is lost.
    words = rows.select("row", *kept, F.explode(F.split("text", SPACE)).alias("word"))
    carried = [F.first(c).alias(c) for c in kept]  # the same in all rows of a document
    by_word = words.groupBy("row", "word").agg(F.count("*").alias("n"), *carried)
    word = F.col("word") != ""
    by_doc = by_word.groupBy("row").agg(
        F.sum(F.when(word, F.col("n")).otherwise(0)).alias("n_words"), F.count(F.when(word, 1)).alias("n_distinct"), *carried
    )
    return materialize(by_doc, "audit-measures")


def _part(part_col: str) -> Column:
    return F.coalesce(F.col(part_col).cast("string"), F.lit(""))


def flag(measured: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``part_key, pattern, good, toxic`` of every document; ``pattern`` has a bit for each filter that it fails."""
    copies = measured.groupBy("hash_a", "hash_b").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    copies = materialize(copies, "audit-copies")
    label = labels.groupBy(F.col(id_col).cast("long").alias("doc_id"))
    marked = materialize(label.agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic")).where("doc_id IS NOT NULL"), "audit-labels")
    joined = measured.join(copies, ["hash_a", "hash_b"], "left").join(marked, "doc_id", "left")
    fails = [
        F.col("n_words") < LEAST_WORDS,
        100 * F.col("n_distinct") < LEAST_DISTINCT * F.col("n_words"),
        F.col("marks").bitwiseAND(F.lit(1)) > 0,
        F.col("marks").bitwiseAND(F.lit(2)) > 0,
        F.coalesce(F.col("first_id") < F.col("doc_id"), F.lit(False)),
    ]
    pattern = sum((F.when(fail, 1 << k).otherwise(0) for k, fail in enumerate(fails)), F.lit(0))
    return joined.select(
        "part_key", pattern.alias("pattern"), F.coalesce(F.col("quality") == 1, F.lit(False)).alias("good"), F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("toxic")
    )


def combinations(flagged: DataFrame) -> DataFrame:
    """Conditional counts a part: arrays of 32 for all, good and toxic documents, by the flags' pattern."""
    counts = []
    for name, which in (("all", F.lit(True)), ("good", F.col("good")), ("toxic", F.col("toxic"))):
        counts += [F.count(F.when((F.col("pattern") == p) & which, 1)).alias(f"{name}_{p}") for p in range(_COMBINATIONS)]
    table = flagged.groupBy("part_key").agg(*counts)
    return table.select("part_key", *(F.array(*(f"{name}_{p}" for p in range(_COMBINATIONS))).alias(name) for name in ("all", "good", "toxic")))


def _of(counts: str, holds: Column | None = None, none_of: Column | None = None, some_of: Column | None = None) -> Column:
    """Sum of the counts of the patterns that have all bits of ``holds``, none of ``none_of``, some of ``some_of``."""

    def taken(p: Column) -> Column:
        ok = F.lit(True)
        if holds is not None:
            ok = ok & (p.bitwiseAND(holds) == holds)
        if none_of is not None:
            ok = ok & (p.bitwiseAND(none_of) == 0)
        if some_of is not None:
            ok = ok & (p.bitwiseAND(some_of) > 0)
        return ok

    each = F.transform(F.col(counts), lambda n, p: F.when(taken(p), n).otherwise(F.lit(0).cast("long")))
    return F.aggregate(each, F.lit(0).cast("long"), lambda a, n: a + n)


def _fair_share(bit: Column) -> Column:
    """Removals by a filter over all orders: of m failing filters each comes first in 120 / m orders."""
    share = F.array(*(F.lit(0 if not p else 120 // p.bit_count()) for p in range(_COMBINATIONS)))
    each = F.transform("all", lambda n, p: F.when(p.bitwiseAND(bit) > 0, n * F.element_at(share, p + 1)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(each, F.lit(0).cast("long"), lambda a, n: a + n)


def audit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang"
) -> DataFrame:
    """A row per part, order of the filters and step, with what its filter did there.

    Columns ``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley``.

    A null text is empty, as are its words; a null part is the part of the empty string. A
    null id is no smaller than any other, never a copy and without labels. Repeated rows count
    each and aren't copies of each other, having one id. An id labelled twice has the larger labels; null
    labels are none. Empty documents give an empty result, empty labels lose no good and no toxic
    documents. A very long text is one value, its words are rows; one task handles them. Texts and parts
    count as identical if their hashes of 128 and of 64 bits are. Other columns aren't read.
    """
    measured = measure(docs, id_col, text_col, part_col)
    parts = materialize(docs.select(_part(part_col).alias("part")).distinct().select("part", F.xxhash64("part").alias("part_key")), "audit-parts")
    table = materialize(combinations(flag(measured, labels)), "audit-combinations")
    discard(measured)
    steps = []
    for order in permutations(range(len(FILTERS))):
        name = "".join(FILTERS[k] for k in order)
        before = 0
        for step, k in enumerate(order, 1):
            steps.append(F.struct(F.lit(name).alias("filter_order"), F.lit(step).alias("step"), F.lit(1 << k).alias("bit"), F.lit(before).alias("before")))
            before |= 1 << k
    each = table.join(parts, "part_key").select("*", F.explode(F.array(*steps)).alias("s")).select("*", "s.*")
    bit, before = F.col("bit"), F.col("before")
    removed = {name: _of(name, holds=bit, none_of=before) for name in ("all", "good", "toxic")}
    return each.select(
        "part",
        "filter_order",
        "step",
        _of("all", none_of=before.bitwiseOR(bit)).alias("kept"),
        removed["all"].alias("removed"),
        _of("all", holds=bit, some_of=before).alias("redundant"),
        F.element_at("all", bit + 1).alias("unique_fails"),
        removed["good"].alias("good_lost"),
        removed["toxic"].alias("toxic_lost"),
        _fair_share(bit).alias("shapley"),
    )
