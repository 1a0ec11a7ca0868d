"""Snapshots on plain files, published by manifest.

A table is a folder of data folders and of manifests. A manifest is a small JSON
file that names, for each part of the table, the data folder that holds it, and
which batches of which writers are in it. A writer first writes the parts that
change into a new data folder, which no manifest names, and then publishes the
next manifest by one rename that fails if the number is taken. So a reader sees a
whole version or the one before, a crash between the two steps leaves the table as
it was, and parts that a batch doesn't touch are neither read nor written.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Folders without a manifest that are younger than this may belong to a write under way.
GRACE_SECONDS = 86_400


class SnapshotConflict(RuntimeError):
    """Another writer published the version that this one was to become."""


@dataclass(frozen=True)
class Manifest:
    """A version: its number, schema, data folder by part, and the last batch of each writer."""

    number: int = 0
    schema: str = ""
    parts: dict[str, str] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)


class _Files:
    """What is needed of Hadoop's file systems, so that any store that Spark reads will do."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark.sparkContext._jvm, root.rstrip("/")
        self.gateway, self.conf = spark.sparkContext._gateway, spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.path("").getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> dict[str, int]:
        """Entries of a folder with the times they changed (milliseconds)."""
        path = self.path(folder)
        return {s.getPath().getName(): s.getModificationTime() for s in self.fs.listStatus(path)} if self.fs.exists(path) else {}

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> bool:
        """Write a file under another name and rename it; false if the name is taken."""
        waiting = self.path(f"_manifests/.{uuid.uuid4().hex}")
        stream = self.fs.create(waiting, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        jfs = self.jvm.org.apache.hadoop.fs
        context = jfs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        try:
            context.rename(waiting, self.path(name), self.gateway.new_array(jfs.Options.Rename, 0))
        except Exception as error:  # py4j's and PySpark's errors alike
            self.fs.delete(waiting, False)
            if "FileAlreadyExists" in str(error) + str(getattr(error, "java_exception", "")):
                return False
            raise
        return True

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


def _numbers(files: _Files) -> list[int]:
    return sorted(int(n.removesuffix(".json")) for n in files.names("_manifests") if n.endswith(".json") and not n.startswith("."))


def _name(number: int) -> str:
    return f"_manifests/{number:020d}.json"


def manifest(spark: SparkSession, root: str, number: int | None = None) -> Manifest | None:
    """The manifest of a version, the newest unless a number is given; None where the table has none."""
    files = _Files(spark, root)
    numbers = _numbers(files)
    if number is None and not numbers:
        return None
    if number is not None and number not in numbers:
        raise FileNotFoundError(f"no version {number} under {root}")
    return Manifest(**json.loads(files.read(_name(numbers[-1] if number is None else number))))


def _written(df: DataFrame, files: _Files, by: str | None) -> dict[str, str]:
    """Write ``df`` into a new data folder; its folder by part. Columns stay in the files, the one it is cut by too."""
    folder = f"data/{uuid.uuid4().hex}"
    if by is None:
        df.write.parquet(f"{files.root}/{folder}")
        return {"": folder}
    df.withColumn("__part", F.col(by)).write.partitionBy("__part").parquet(f"{files.root}/{folder}")
    return {name: f"{folder}/{name}" for name in files.names(folder) if name.startswith("__part=")}


def write_snapshot(
    df: DataFrame, root: str, by: str | None = None, carry: bool = False, base: Manifest | None = None, batch: tuple[str, int] | None = None
) -> int:
    """Publish ``df`` as the version after ``base`` (the newest unless given); its number.

    With ``by`` the table is cut into parts; with ``carry`` the parts that ``df`` has no
    rows of are those of the version before, by name alone. ``batch`` is noted as the
    last one of its writer. SnapshotConflict if another writer was faster.
    """
    spark = df.sparkSession
    files = _Files(spark, root)
    base = base or manifest(spark, root) or Manifest()
    parts = (dict(base.parts) if carry else {}) | _written(df, files, by)
    batches = dict(base.batches) | ({batch[0]: batch[1]} if batch else {})
    new = Manifest(base.number + 1, df.schema.json(), parts, batches)
    if not files.publish(_name(new.number), json.dumps(new.__dict__)):
        raise SnapshotConflict(f"version {new.number} under {root} is another writer's")
    return new.number


def read_version(spark: SparkSession, root: str, version: Manifest, parts: set[str] | None = None) -> DataFrame:
    """The rows of a version, or of those of its parts that are named (``__part=<value>``)."""
    schema = StructType.fromJson(json.loads(version.schema))
    paths = [f"{root.rstrip('/')}/{folder}" for name, folder in sorted(version.parts.items()) if parts is None or name in parts]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read_snapshot(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The newest version, or the one of that number; it stays readable while newer ones are written."""
    found = manifest(spark, root, version)
    if found is None:
        raise FileNotFoundError(f"no snapshot under {root}")
    return read_version(spark, root, found)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows by key, the last by ``order`` winning; new rows win ties."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    last = W.partitionBy(*keys).orderBy(F.col(order).desc_nulls_last(), F.col("__new").desc())
    return both.withColumn("__rn", F.row_number().over(last)).where("__rn = 1").drop("__rn", "__new")


def prune_snapshots(spark: SparkSession, root: str, keep: int, grace: float = GRACE_SECONDS) -> None:
    """Drop all but the newest ``keep`` versions and the data that no version left names.

    Data that a dropped version named goes at once; what none ever named (a writer
    that died, or one under way) only once it is older than ``grace`` seconds.
    """
    files = _Files(spark, root)
    numbers = _numbers(files)
    gone, kept = ([Manifest(**json.loads(files.read(_name(n)))) for n in part] for part in (numbers[:-keep], numbers[-keep:]))
    needed = {folder for m in kept for folder in m.parts.values()}
    roots = {folder.split("/")[1] for folder in needed}
    for number in numbers[:-keep]:  # first, so that no version names what is missing
        files.delete(_name(number))
    for folder in {f for m in gone for f in m.parts.values()} - needed:
        files.delete(folder)
    named = {f.split("/")[1] for m in gone for f in m.parts.values()}
    now = files.jvm.System.currentTimeMillis()
    for name, changed in files.names("data").items():
        if name not in roots and (name in named or now - changed > grace * 1000):
            files.delete(f"data/{name}")


def upsert_batches(root: str, keys: list[str], order: str, parts: int = 64, keep: int = 3, writer: str = "stream", tries: int = 5):
    """A ``foreachBatch`` writer: each batch becomes a new version, once.

    Rows lie in ``parts`` parts by a hash of their keys; a batch reads and writes those
    it touches. A batch that the table holds already (the manifest knows each writer's
    last one) changes nothing, so replays after a crash are harmless. Several writers
    may share a table: who loses the race begins again from the newer version.
    """
    part = F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")

    def attempt(new: DataFrame, touched: set[str], batch_id: int) -> bool:
        spark = new.sparkSession
        base = manifest(spark, root) or Manifest()
        if base.batches.get(writer, -1) >= batch_id:
            return True
        old = read_version(spark, root, base, touched) if base.schema else new.limit(0)
        try:
            number = write_snapshot(upsert(old, new, keys, order), root, "part", carry=True, base=base, batch=(writer, batch_id))
        except SnapshotConflict:
            return False
        if number % keep == 0:
            prune_snapshots(spark, root, keep)
        return True

    def write(batch: DataFrame, batch_id: int) -> None:
        new = batch.withColumn("part", part)
        touched = {f"__part={r.part}" for r in new.select("part").distinct().collect()}  # at most ``parts``
        if not any(attempt(new, touched, batch_id) for _ in range(tries)):
            raise SnapshotConflict(f"{tries} writers were faster under {root}; the batch will be run again")

    return write


def settle(queue: DataFrame, answers: DataFrame, keys: list[str], chunk: int = 500) -> tuple[DataFrame, DataFrame]:
    """What a sink accepted of a ``queue(run_id, keys, tries)`` sent in chunks, and what is queued again.

    ``answers(run_id, chunk, ok)`` says which chunks were taken; rows of a chunk that was
    refused or not answered go back with one try more, however often, and are sent in
    front of newer ones: no row is lost. Chunks follow tries, then ``keys``.
    """
    place = W.partitionBy("run_id").orderBy(F.col("tries").desc(), *keys)
    number = F.floor((F.row_number().over(place) - 1) / chunk)
    sent = queue.withColumn("chunk", number).join(answers, ["run_id", "chunk"], "left")
    taken = F.coalesce("ok", F.lit(False))
    again = sent.where(~taken).withColumn("tries", F.col("tries") + 1)
    return sent.where(taken).drop("chunk", "ok"), again.drop("chunk", "ok")
