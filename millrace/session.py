"""Where jobs keep state that must survive the loss of an executor."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_watched: list[list[str]] = []


#: Instants are UTC throughout; of a member that a JSON object repeats, the last one counts.
SETTINGS = {"spark.sql.session.timeZone": "UTC", "spark.sql.variant.allowDuplicateKeys": "true"}


def session(app: str = "millrace", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings every job here relies on (``SETTINGS``, AQE, skew joins)."""
    builder = (
        SparkSession.builder.appName(app)
        .config(map=SETTINGS)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), str(value))
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """The settings that results depend on, for sessions created elsewhere."""
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach: ``spark.checkpoint.dir``, or the context's checkpoint folder where the
    application has set one itself."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    return named.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; nothing is ever overwritten."""
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    if _watched:
        _watched[-1].append(path)
    return path


def release(spark: SparkSession, *paths: str) -> None:
    """Remove folders of :func:`fresh_path` whose rows nobody will read again."""
    root = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    for path in paths:
        if not path.startswith(root):
            raise ValueError(f"not an intermediate result: {path}")
        target = hadoop(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Intermediate results written inside are removed on leaving. For work that ends in a write of its own, such as
    a micro-batch; a failure leaves nothing behind either, since the work is done anew."""
    made: list[str] = []
    _watched.append(made)
    try:
        yield
    finally:
        _watched[:] = [paths for paths in _watched if paths is not made]  # equal lists are not the same
        release(spark, *made)


def by_shuffle(df: DataFrame) -> DataFrame:
    """A side of a join that is never collected on the driver, for rows that may be as many as the streams.

    Of rows that are made of others - exploded ones, texts, what Python gives - the planner only knows the size of the files
    they come from, far too little, and would broadcast them.
    """
    return df.hint("merge")


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate result to the shared folder and go on from there.

    For results that are read several times: later stages neither compute it again nor lose it with an
    executor.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settle_alone(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """Like :func:`settle`, for what ``make`` returns; intermediate results written by ``make`` are removed once it is there.

    For steps whose own intermediate results nobody reads again, so that disk follows what is still needed.
    """
    path = fresh_path(spark, name)
    with passing(spark):
        df = make()
        df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
