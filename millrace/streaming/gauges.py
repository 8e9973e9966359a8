"""Distributions and gauges kept while events arrive: sketches of sizes and latencies, open connections, newest offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.operators.observe import active_connections
from millrace.session import passing, settle
from millrace.streaming.compaction import _files

#: Size of a sketch. It holds a few times as many values, however many it has seen.
SKETCH = 1000


def rank_error(k: int = SKETCH) -> float:
    """How far, as a share of all values, the rank of a sketched quantile may be off (99 % confidence; published for
    KLL sketches). Merging keeps it."""
    return 2.296 / k**0.9723


def sketch_stream(
    messages: DataFrame, ts: str, interval: str, lateness: str, keys: tuple[str, ...], value: Column, k: int = SKETCH
) -> DataFrame:
    """Per tumbling interval and key: count, total, largest and a quantile sketch of a whole-number value.

    Sketches combine before the shuffle and are all the state there is: one per key and interval still open. Values that are
    null don't count. For batches, too.
    """
    held = value.cast("bigint")
    return (
        messages.withWatermark(ts, lateness)
        .groupBy(F.window(ts, interval).alias("w"), *keys)
        .agg(
            F.count(held).alias("count"),
            F.sum(held).alias("total"),
            F.max(held).alias("max"),
            F.kll_sketch_agg_bigint(held, k).alias("sketch"),
        )
        .select(F.col("w.start").alias("window_start"), *keys, "count", "total", "max", "sketch")
    )


def merged_sketches(sketches: DataFrame, keys: tuple[str, ...], quantiles: dict[str, float], k: int = SKETCH) -> DataFrame:
    """Sketches of any windows and streams put together per ``keys``: count, total, mean, largest, and the named
    quantiles, whose ranks are within :func:`rank_error`. Keys without a value have null quantiles."""
    # A sketch of nothing has no quantiles.
    some = F.when(F.col("count") > 0, F.col("sketch"))
    whole = sketches.groupBy(*keys).agg(
        F.sum("count").alias("count"),
        F.sum("total").alias("total"),
        F.max("max").alias("max"),
        F.kll_merge_agg_bigint(some, k).alias("_s"),
    )
    found = [F.when(F.col("count") > 0, F.kll_sketch_get_quantile_bigint("_s", F.lit(float(q)))).alias(name) for name, q in quantiles.items()]
    return whole.select(*keys, "count", "total", (F.col("total") / F.nullif("count", F.lit(0))).alias("mean"), "max", *found)


def _batches(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the micro-batches whose folders below ``path`` are written whole."""
    files, folder = _files(spark, path)
    if not files.exists(folder):
        return []
    names = [status.getPath().getName() for status in files.listStatus(folder)]
    numbers = [int(name.removeprefix("batch=")) for name in names if name.startswith("batch=")]
    return sorted(n for n in numbers if files.exists(_files(spark, f"{path}/batch={n}/_SUCCESS")[1]))


def _forget(spark: SparkSession, path: str, number: int) -> None:
    """Remove what micro-batches before the one before ``number`` carried over; that one is needed should this run again."""
    for old in _batches(spark, path):
        if old < number - 1:
            files, folder = _files(spark, f"{path}/batch={old}")
            files.delete(folder, True)


def connections_stream(
    events: DataFrame,
    *,
    path: str,
    keys: list[str],
    order: str,
    delta: Column,
    lateness: int,
    checkpoint: str,
    slice_rows: int | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Connections open after each connect (+1) and disconnect (-1), as :func:`millrace.operators.observe.active_connections`
    has them, of events that come late, out of order or again. Read by :func:`connections` and :func:`open_connections`.

    ``order`` is a whole number that grows with time and names an event within its key. An event waits until one that is
    ``lateness`` beyond it has been seen; by then those before it are there, it gets its place and never changes. Of rows with
    the same key and order one counts. What comes later than that doesn't count, as behind any watermark, and neither
    do rows with a null key or order; a null change is none.

    Carried from one micro-batch to the next: the events that wait, one total per key, and how far events are placed. The work
    is the sliced running total of the batch, so a hot key takes many tasks. A micro-batch writes folders of its own
    and starts from those of the one before; run again, it replaces its own.
    """

    def follow(batch: DataFrame, number: int) -> None:
        with passing(batch.sparkSession):
            place(batch, number)

    def place(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        named = [F.col(key).isNotNull() for key in [*keys, order]]
        rows = batch.select(*keys, F.col(order).cast("bigint").alias(order), F.coalesce(delta, F.lit(0)).cast("bigint").alias("delta"))
        for known in named:
            rows = rows.where(known)
        totals, mark = None, None
        if number > 0:
            rows = rows.unionByName(spark.read.schema(rows.schema).parquet(f"{path}/waiting/batch={number - 1}"))
            totals = spark.read.schema(rows.drop(order, "delta").withColumn("open", F.lit(0).cast("bigint")).schema)
            totals = totals.parquet(f"{path}/open/batch={number - 1}")
            mark = spark.read.schema("mark bigint").parquet(f"{path}/marks/batch={number - 1}").first()["mark"]
        if mark is not None:
            rows = rows.where(F.col(order) > mark)
        # Of unlike rows of one event the lesser change counts, so that a batch that is run again finds the same.
        rows = settle(rows.groupBy(*keys, order).agg(F.min("delta").alias("delta")), "arrived")
        last = rows.agg(F.max(order)).first()[0]
        ends = [x for x in (mark, None if last is None else last - lateness) if x is not None]
        mark = max(ends, default=None)
        placed = F.coalesce(F.col(order) <= F.lit(mark).cast("bigint"), F.lit(False))
        now = rows.where(placed)
        active = active_connections(now, keys, order, F.col("delta"), slice_rows)
        change = now.groupBy(*keys).agg(F.sum("delta").alias("open"))
        if totals is not None:
            active = active.join(totals, keys, "left").withColumn("active", F.col("active") + F.coalesce("open", F.lit(0))).drop("open")
            change = change.unionByName(totals).groupBy(*keys).agg(F.sum("open").alias("open"))
        active.write.mode("overwrite").parquet(f"{path}/active/batch={number}")
        rows.where(~placed).write.mode("overwrite").parquet(f"{path}/waiting/batch={number}")
        change.write.mode("overwrite").parquet(f"{path}/open/batch={number}")
        spark.createDataFrame([(mark,)], "mark bigint").write.mode("overwrite").parquet(f"{path}/marks/batch={number}")
        for carried in ("waiting", "open", "marks"):
            _forget(spark, f"{path}/{carried}", number)

    return (
        events.writeStream.foreachBatch(follow)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def connections(spark: SparkSession, path: str) -> DataFrame:
    """Every event placed so far with the connections ``active`` after it."""
    return spark.read.parquet(f"{path}/active").drop("batch")


def open_connections(spark: SparkSession, path: str) -> DataFrame:
    """Connections open per key, as of the newest micro-batch that is written whole."""
    return spark.read.parquet(f"{path}/open/batch={_batches(spark, f'{path}/open')[-1]}")


def gauge_stream(
    served: DataFrame, *, path: str, keys: tuple[str, ...], checkpoint: str, order: str = "offset", ts: str = "ts_ms", trigger: dict | None = None
) -> StreamingQuery:
    """The newest offset served and its time, per key, kept by one streaming aggregation; read by :func:`gauges`.

    The state is a row per key. A record that comes again, or after a newer one, changes nothing. Every micro-batch writes all
    gauges as a folder of its own; older folders go.
    """
    newest = served.groupBy(*keys).agg(F.max(order).alias("last_offset"), F.max_by(ts, order).alias("at_ms"))

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        _forget(batch.sparkSession, path, number)

    return (
        newest.writeStream.foreachBatch(write)
        .outputMode("complete")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def gauges(spark: SparkSession, path: str, now_ms: Column) -> DataFrame:
    """Per key the age of the newest record served and its offset, as :func:`millrace.operators.positions.latest_gauge`."""
    found = spark.read.parquet(f"{path}/batch={_batches(spark, path)[-1]}")
    return found.withColumn("latency_ms", now_ms - F.col("at_ms")).drop("at_ms")
