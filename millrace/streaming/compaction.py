"""Followed compaction: a keyed log kept small while it grows, generation by generation."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from millrace.operators.model import compact_log
from millrace.session import passing, settle

POINTERS = "_pointers"


def _files(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def current(spark: SparkSession, path: str) -> dict | None:
    """What the newest pointer names: the generation's ``base`` and the ``deltas`` after it as folders, the ``batch`` it was
    made by, ``keep_after`` and the rows of both."""
    files, folder = _files(spark, f"{path}/{POINTERS}")
    if not files.exists(folder):
        return None
    numbers = [s.getPath().getName() for s in files.listStatus(folder)]
    numbers = [int(n) for n in numbers if n.isdigit()]
    if not numbers:
        return None
    return json.loads(spark.read.text(f"{path}/{POINTERS}/{max(numbers)}", wholetext=True).first()[0])


def _point(spark: SparkSession, path: str, pointer: dict) -> None:
    """A pointer appears whole, by one renaming; the newest one counts."""
    number = pointer["batch"]
    pending = f"{path}/_pending-{number}"
    spark.createDataFrame([(json.dumps(pointer),)], "value string").coalesce(1).write.mode("overwrite").text(pending)
    files, source = _files(spark, pending)
    target = _files(spark, f"{path}/{POINTERS}/{number}")[1]
    files.mkdirs(target.getParent())
    if not files.rename(source, target):
        raise OSError(f"a generation could not be made current: {target}")


def _sweep(spark: SparkSession, path: str, pointer: dict) -> None:
    """Folders that neither this generation nor the one before names go, those of failed attempts, too; and old pointers."""
    wanted = {pointer["base"], *pointer["deltas"], *pointer["before"]}
    files, root = _files(spark, path)
    for status in files.listStatus(root):
        if status.getPath().getName().startswith(("base-", "delta-", "_pending-")) and status.getPath().getName() not in wanted:
            files.delete(status.getPath(), True)
    for status in files.listStatus(_files(spark, f"{path}/{POINTERS}")[1]):
        if int(status.getPath().getName()) < pointer["batch"] - 1:
            files.delete(status.getPath(), True)


def _stored(spark: SparkSession, path: str, schema: T.StructType, folders: list[str]) -> DataFrame:
    return spark.read.schema(schema).parquet(*(f"{path}/{folder}" for folder in folders))


def compacted(spark: SparkSession, path: str, schema: T.StructType, key: str, value: str, ts: str, order: str = "offset") -> DataFrame:
    """The compacted log as it stands, equal to :func:`millrace.operators.model.compact_log` over all records so far: of those
    up to ``keep_after`` the last one per key, unless it is a deletion, and every later one."""
    pointer = current(spark, path)
    if pointer is None:
        return spark.createDataFrame([], schema)
    names = [c.name for c in schema]
    stored = _stored(spark, path, schema, [*filter(None, [pointer["base"]]), *pointer["deltas"]])
    return compact_log(stored, key, value, ts, F.lit(pointer["keep_after"]), order).select(*names)


def compact_stream(
    records: DataFrame,
    *,
    path: str,
    key: str,
    value: str,
    ts: str,
    retention: int,
    checkpoint: str,
    order: str = "offset",
    share: float = 0.5,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Follow a keyed log and keep it compacted below ``path``; read it by :func:`compacted`.

    A record is superseded once a later one of its key is older than ``retention`` (in units of ``ts``, a number), counted from
    the newest record seen; a deletion is kept as long, so that readers who lag by less than that see it, and then goes with
    what it deleted. Every micro-batch adds a folder of its own; as soon as these hold ``share`` of the base's rows, base
    and folders become the next base, so that a record is rewritten some log n times rather than in every micro-batch. Writing
    is outside any state store, and a hot key costs one row per task and generation.

    A pointer, which appears whole, names the folders that count: readers see one generation or the next, and a micro-batch
    that is run again replaces folders nobody has seen. Folders of the generation before stay for readers who have
    begun; older ones are removed. Records of a key come in the order of ``order``.
    """
    schema = records.schema
    names = [c.name for c in schema]

    def follow(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        pointer = current(spark, path) or {"batch": -1, "base": None, "deltas": [], "keep_after": None, "base_rows": 0, "delta_rows": 0, "before": []}
        if pointer["batch"] >= number:
            return  # it was made current before the batch was noted as done
        delta = f"delta-{number}"
        batch.select(*names).write.mode("overwrite").parquet(f"{path}/{delta}")
        seen = _stored(spark, path, schema, [delta]).agg(F.count("*").alias("n"), F.max(ts).alias("last")).first()
        if not seen["n"]:
            _point(spark, path, {**pointer, "batch": number})
            return
        ends = [x for x in (pointer["keep_after"], None if seen["last"] is None else seen["last"] - retention) if x is not None]
        after = {**pointer, "batch": number, "deltas": [*pointer["deltas"], delta], "keep_after": max(ends, default=None)}
        after["delta_rows"] += seen["n"]
        if after["keep_after"] is not None and after["delta_rows"] >= share * after["base_rows"]:
            folders = [*filter(None, [after["base"]]), *after["deltas"]]
            base = f"base-{number}"
            with passing(spark):
                whole = compact_log(_stored(spark, path, schema, folders), key, value, ts, F.lit(after["keep_after"]), order)
                settle(whole.select(*names), "generation").write.mode("overwrite").parquet(f"{path}/{base}")
            rows = _stored(spark, path, schema, [base]).count()
            after |= {"base": base, "deltas": [], "base_rows": rows, "delta_rows": 0, "before": folders}
        _point(spark, path, after)
        _sweep(spark, path, after)

    return (
        records.writeStream.foreachBatch(follow)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
