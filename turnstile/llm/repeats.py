"""What keys stand more than once, and where: shared by the substring operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnstile.llm.common import discard, materialize, utf8


def keyed_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id``, ``key``, ``t``: a row's name is its id and its text's hash.

    The name comes from the contents, so it is the same in every scan; rows with
    one name are one document repeated.
    """
    text = utf8(text_col)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("t"))


def first_in_order(*more: str) -> Column:
    """A struct whose smallest value is the first place: by id, null last, then name, then ``more``."""
    return F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key", *more)


def only_repeated(short: DataFrame, rows: DataFrame, name: str) -> DataFrame:
    """``rows`` whose ``h`` stands twice or more in ``short(h)``, as a table.

    The first pass moves the hashes alone and keeps those seen twice; the second
    joins whole rows with them. A hot key is a sum in the first and an ordinary
    join key in the second, which Spark can split.
    """
    twice = materialize(short.groupBy("h").count().where("count > 1").select("h"), f"{name}-twice")
    found = materialize(rows.join(twice, "h", "left_semi"), name)
    discard(twice)
    return found
