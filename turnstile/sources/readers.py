"""Readers: frames from folders of images, manifests and zones from JSON."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from turnstile.functions.columns import jpeg_dims


def _dims(images: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([jpeg_dims(None if x is None else bytes(x)) or (None, None) for x in images], columns=["w", "h"])


def read_frames(spark: SparkSession, root: str, *, stream: bool = False, per_batch: int = 1_000) -> DataFrame:
    """Frames under ``root/<run_id>/<seq>.jpg``: run_id, seq, t (when it was written), image, w, h.

    A batch, or a stream of at most ``per_batch`` new files at a time. Sizes come
    from the header alone; a file that is no JPEG has none, and stays.
    """
    reader = spark.readStream.option("maxFilesPerTrigger", per_batch) if stream else spark.read
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = reader.schema(schema).format("binaryFile").option("pathGlobFilter", "*.jpg").option("recursiveFileLookup", "true").load(root)
    place = r"([^/]+)/([0-9]+)\.jpg$"
    dims = pandas_udf(_dims, "w int, h int")("content")
    return files.select(
        F.regexp_extract("path", place, 1).alias("run_id"),
        F.regexp_extract("path", place, 2).cast("long").alias("seq"),
        F.col("modificationTime").alias("t"),
        F.col("content").alias("image"),
        dims["w"].alias("w"),
        dims["h"].alias("h"),
    )


CLIP = "label string, path string, actualUnique long, tags array<string>, notes string"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Clips of a JSON manifest ``{"clips": [...]}``, as ``manifest_validate`` takes them: clip (its place), label, path, actual, tags.

    What is missing or of another type is null, or without tags an empty list, and is judged there. A
    manifest of another version than 1 (none given is 1) is an error.
    """
    whole = spark.read.schema(f"version string, clips array<struct<{', '.join(f.replace(' ', ':', 1) for f in CLIP.split(', '))}>>").option("multiLine", True).json(path)
    known = F.coalesce(F.col("version"), F.lit("1")) == "1"
    whole = whole.select(F.when(known, F.col("clips")).otherwise(F.raise_error(F.concat(F.lit("manifest version not supported: "), "version"))).alias("clips"))
    clips = whole.select(F.posexplode("clips").alias("clip", "c"))
    return clips.select(
        F.col("clip").cast("long").alias("clip"),
        F.col("c.label").alias("label"),
        F.col("c.path").alias("path"),
        F.col("c.actualUnique").alias("actual"),
        F.coalesce("c.tags", F.array().cast("array<string>")).alias("tags"),
    )


def read_zones(spark: SparkSession, path: str) -> DataFrame:
    """Zones of JSON lines ``{"label", "mode", "points": [[x, y], ...]}``, as the ``corners`` of the zone operators; a mode not given is ``faces``."""
    zones = spark.read.schema("label string, mode string, points array<array<double>>").json(path)
    # Zones are a dimension of a few rows: their order is that of their labels.
    numbered = zones.select("label", F.coalesce("mode", F.lit("faces")).alias("mode"), "points").withColumn("zn", F.xxhash64("label"))
    return numbered.select("label", "zn", "mode", F.posexplode("points").alias("i", "p")).select(
        "label", "zn", "mode", (F.col("i") + 1).cast("long").alias("i"), F.col("p")[0].alias("x"), F.col("p")[1].alias("y")
    )
