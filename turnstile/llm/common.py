"""Shared helpers of the training-data operators.

Intermediate tables go to the folder that the cluster names in
``spark.checkpoint.dir``: every executor sees it, so a lost executor never
takes the only copy with it. The setting is read from the session; a local
folder is made only where it is unset and everything runs in one process (tests).
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed patterns of the contracts: a word is a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Python's ``bytes.split()`` splits at exactly those six bytes and
#: ``bytes.lower()`` changes A-Z only, so ``text.lower().split()`` on UTF-8
#: bytes yields the lower-cased words of the contracts.


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    Only a session in one process (``local[...]``, as in tests) may leave it
    unset and gets a local one; elsewhere a local folder would hold a part of
    each table on every machine, so that is an error.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="turnstile-"))
        root = context.getCheckpointDir()
    return root.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage, so that later jobs neither repeat the work nor depend on
    the executors that did it. The table goes when the application ends.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    release(spark)
    table = spark.read.schema(df.schema).parquet(path)
    table._shared_path = path
    return table


def shared_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder; what is written there goes when the application ends."""
    path = f"{shared_dir(spark)}/turnstile/{name}-{uuid.uuid4().hex}"
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


#: Bytes up to which a table of keys is sent to every executor.
BROADCAST_BYTES = 64 << 20


def broadcast_if_small(table: DataFrame, row_bytes: int) -> DataFrame:
    """``table`` as a broadcast side while its counted rows of ``row_bytes`` stay under ``BROADCAST_BYTES``, else as it is.

    Beyond that Spark deals both sides of the join; the result is the same.
    """
    return F.broadcast(table) if table.count() * row_bytes <= BROADCAST_BYTES else table


def bound_batches(spark: SparkSession, rows: int = 1024, nbytes: int = 8 << 20) -> None:
    """Smaller Arrow batches than the defaults, as rows here are whole texts.

    A batch stands in memory several times on its way to Python and back, in
    each of an executor's tasks at once. Settings that are smaller already stay.
    """
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", nbytes)):
        key = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(key)  # a number, or a size such as 64m
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing will read again."""
    for table in tables:
        spark = table.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table._shared_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished jobs, which stay until the driver's plans are collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def utf8(column: str | Column) -> Column:
    """A text column as UTF-8 bytes, null as empty."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.cast("binary"), F.lit(b""))


def word_count(column: str | Column) -> Column:
    """Words of a text, null as 0; stays on the JVM."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.regexp_count(column, F.lit(WORD)), F.lit(0)).cast("long")


def rows_of(batches: Iterable[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """Rows of Arrow batches, one value at a time, so that only one text is copied."""
    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
        for i in range(batch.num_rows):
            yield tuple(c[i].as_py() for c in columns)


def hashed_sample(df: DataFrame, rows: int, draw: Column) -> DataFrame:
    """The ``rows`` rows with the smallest ``draw``, a seeded xxhash64.

    The rows are counted first and a threshold lets about twice as many pass, so
    what the tasks send is bounded by ``rows`` and not by their number. A table
    whose hashes leave too few is drawn as a whole. Counts read no column but
    those of ``draw``.
    """
    total = df.count()
    if total > 8 * rows:
        most = int(-(1 << 63) + (1 << 64) * (2 * rows + 64) / total)
        if df.where(draw < F.lit(most)).count() >= rows:
            df = df.where(draw < F.lit(most))
    return df.orderBy(draw).limit(rows)


class Sink:
    """Collects output rows and hands them over in batches of bounded size."""

    def __init__(self, schema: pa.Schema, rows: int = 20_000, nbytes: int = 8 << 20):
        self.schema, self.limit, self.nbytes = schema, rows, nbytes
        self.columns: list[list] = [[] for _ in schema]
        self.used = 0

    def add(self, *values, weight: int = 0) -> bool:
        """Add a row; true if the batch is full. ``weight`` is its size in bytes."""
        for column, value in zip(self.columns, values, strict=True):
            column.append(value)
        self.used += weight
        return len(self.columns[0]) >= self.limit or self.used >= self.nbytes

    def flush(self) -> pa.RecordBatch:
        arrays = [pa.array(c, type=f.type) for c, f in zip(self.columns, self.schema, strict=True)]
        self.columns, self.used = [[] for _ in self.schema], 0
        return pa.RecordBatch.from_arrays(arrays, schema=self.schema)

    def __len__(self) -> int:
        return len(self.columns[0])


def under_safe_names(docs: DataFrame, keep: Iterable[str], decide: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``decide`` over ``docs`` whose columns but ``keep`` have names that no operator adds.

    What is left comes back with the columns of ``docs``, in their order and under
    their names, so that a column which is called like a verdict stays as it was.
    """
    kept = set(keep)
    safe = [c if c in kept else f"__column_{i}" for i, c in enumerate(docs.columns)]
    return decide(docs.toDF(*safe)).select(*safe).toDF(*docs.columns)


def map_rows(
    df: DataFrame, names: list[str], schema: pa.Schema, ddl: str, row: Callable[..., Iterable[tuple]]
) -> DataFrame:
    """``mapInArrow`` where ``row(*values)`` yields the output rows of one input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink = Sink(schema)
        for values in rows_of(batches, *names):
            for out in row(*values):
                if sink.add(*out):
                    yield sink.flush()
        if len(sink):
            yield sink.flush()

    return df.select(*names).mapInArrow(run, ddl)
