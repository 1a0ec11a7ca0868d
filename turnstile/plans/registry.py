"""The registry of operators: SQL texts, and functions of DataFrames."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession

from turnstile.plans.dialect import DUCKDB, Dialect
from turnstile.settings import DEFAULTS, FIXTURE, Settings

Text = Callable[[Dialect], str]
Prepare = Callable[[SparkSession, Dialect], dict[str, DataFrame]]
_TEXTS: dict[str, Text] = {}
_PREPARED: dict[str, Prepare] = {}


@dataclass(frozen=True)
class Frames:
    """An operator that is a function of settings and of the domain views it names; its oracle is a DuckDB text."""

    run: Callable[..., DataFrame]
    views: tuple[str, ...]
    oracle: Callable[[], str] | None


_FRAMES: dict[str, Frames] = {}


def sql(text: Text) -> Text:
    """Register an operator under its function's name."""
    if text.__name__ in _TEXTS:
        raise ValueError(f"{text.__name__} is registered twice")
    _TEXTS[text.__name__] = text
    return text


def sql_over(prepare: Prepare) -> Callable[[Text], Text]:
    """Register an operator whose text reads, in Spark, relations that ``prepare`` computes first."""

    def register(text: Text) -> Text:
        _PREPARED[text.__name__] = prepare
        return sql(text)

    return register


def run_text(spark: SparkSession, name: str, d: Dialect) -> DataFrame:
    """The result of an operator's text; the plan is analysed here and keeps what it needs."""
    named = {view: (f"turnstile_{view}_{uuid.uuid4().hex}", df) for view, df in (_PREPARED[name](spark, d) if name in _PREPARED else {}).items()}
    for relation, df in named.values():
        df.createOrReplaceTempView(relation)
    try:
        return _longs(spark.sql(_TEXTS[name](replace(d, views={**d.views, **{view: relation for view, (relation, _) in named.items()}}))))
    finally:
        for relation, _ in named.values():
            spark.catalog.dropTempView(relation)


def frames(*views: str, oracle: Callable[[], str] | None = None) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """Register ``run(settings, **views)`` under its name."""

    def register(run: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if run.__name__ in _TEXTS or run.__name__ in _FRAMES:
            raise ValueError(f"{run.__name__} is registered twice")
        _FRAMES[run.__name__] = Frames(run, views, oracle)
        return run

    return register


def cut(df: DataFrame) -> DataFrame:
    """``df`` as it is now, its lineage cut: a table written once in the folder that the cluster shares.

    The folder is that of ``spark.checkpoint.dir``; one of its own only where everything runs
    in one process and none is named. The table goes when the application ends.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="turnstile-"))
        root = context.getCheckpointDir()
    place = f"{root.rstrip('/')}/turnstile/cut-{uuid.uuid4().hex}"
    df.write.parquet(place)
    path = context._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(place)


def _longs(df: DataFrame) -> DataFrame:
    """Ordinals are INT in Spark and BIGINT elsewhere."""
    return df.select(*[df[c].cast("long").alias(c) if t == "int" else df[c] for c, t in df.dtypes])


def spark_query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    """The operator over the given tables, as the driver calls it."""

    if name in _FRAMES:
        return _frames_query(name)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run_text(spark, name, Dialect(spark=True, root=sf_dir, k=FIXTURE))

    run.__name__, run.__doc__ = name, _TEXTS[name].__doc__
    return run


def _frames_query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    from turnstile.sources import bindings

    operator = _FRAMES[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = Dialect(spark=True, root=sf_dir, k=FIXTURE)
        return operator.run(FIXTURE, **{v: spark.sql(f"SELECT * FROM {getattr(bindings, v)(d)} AS v0") for v in operator.views})

    run.__name__, run.__doc__ = name, operator.run.__doc__
    return run


def apply(name: str, settings: Settings = DEFAULTS, **views: DataFrame) -> DataFrame:
    """The operator over a user's own tables, which stand for the domain views it reads.

    ``apply("nms", Settings(nms_iou=0.5), boxes=df)``. The columns of each view are
    those of its binding in :mod:`turnstile.sources.bindings` that the operator
    names. A view that an operator derives from another (zones' ``edges``, say) may
    be given itself. The tables are lazily read; nothing is collected.
    """
    if not views:
        raise ValueError(f"{name} needs the tables it is to be applied to")
    if name in _FRAMES:
        missing = [v for v in _FRAMES[name].views if v not in views]
        if missing:
            raise ValueError(f"{name} reads {missing}, which were not named")
        return _FRAMES[name].run(settings, **{v: views[v] for v in _FRAMES[name].views})
    spark = next(iter(views.values())).sparkSession
    named = {}
    for view, df in views.items():
        named[view] = f"turnstile_{view}_{uuid.uuid4().hex}"
        df.createOrReplaceTempView(named[view])
    try:  # the plan is analysed here and keeps what it needs
        return run_text(spark, name, Dialect(spark=True, k=settings, views=named))
    finally:
        for view in named.values():
            spark.catalog.dropTempView(view)


def names() -> list[str]:
    return [*_TEXTS, *_FRAMES]


def oracles() -> dict[str, str]:
    """The DuckDB text of every operator that has one."""
    return {name: text(DUCKDB) for name, text in _TEXTS.items()} | {name: f.oracle() for name, f in _FRAMES.items() if f.oracle}
