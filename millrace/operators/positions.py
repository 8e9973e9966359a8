"""Consumer positions, landing ranges and message counts over the stream log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.offsets import format_offset_spec
from millrace.sources.log import bounded_offset_scan

MAX_RECORDS_PER_PARTITION = 100_000
POLL_MIN, POLL_MAX = 10, 5000


def log_ends(log: DataFrame, keys: tuple[str, ...] = ("partition",)) -> DataFrame:
    """``(keys, begin, end)`` of each partition; the end is one past the last offset."""
    return log.groupBy(*keys).agg(F.min("offset").alias("begin"), (F.max("offset") + 1).alias("end"))


def latest_offsets(log: DataFrame) -> DataFrame:
    """One past the last offset of each partition, from the log's own rows."""
    return latest_of(log_ends(log))


def latest_of(ends: DataFrame) -> DataFrame:
    """The same from ends kept beside a log (``stored_ends``)."""
    return ends.select("partition", F.col("end").alias("latest"))


def committed_offsets(ends: DataFrame, commits: DataFrame) -> DataFrame:
    """Committed position of each partition, else the beginning of its log."""
    return ends.join(commits.select("partition", "next_offset"), "partition", "left").select(
        "partition", F.coalesce("next_offset", "begin").alias("committed")
    )


def start_positions(ends: DataFrame, groups: DataFrame, commits: DataFrame) -> DataFrame:
    """Where each consumer group starts reading its stream: its commit, else the begin or end of the log by
    its mode.

    ``ends(stream, partition, begin, end)``, ``groups(stream, consumer, mode)`` with mode EARLIEST or LATEST (the
    default), ``commits(stream, consumer, partition, next_offset)``.
    """
    wanted = groups.join(ends, "stream")
    mode = F.coalesce(F.upper("mode"), F.lit("LATEST"))
    default = F.when(mode == "EARLIEST", F.col("begin")).otherwise(F.col("end"))
    return wanted.join(commits, ["stream", "consumer", "partition"], "left").select(
        "stream", "consumer", "partition", F.coalesce("next_offset", default).alias("position")
    )


def resume_read(log: DataFrame, positions: DataFrame) -> DataFrame:
    """Records at or after the stored position of their partition, read as a bounded range that has no end."""
    return bounded_offset_scan(log, positions.select("partition", F.col("position").alias("start"), F.lit((1 << 63) - 1).alias("end")))


def plan_landing(latest: DataFrame, committed: DataFrame, cap: int = MAX_RECORDS_PER_PARTITION) -> DataFrame:
    """Ranges to land now: from the committed position, at most ``cap`` records per partition.

    ``run_again`` says whether the range was cut short. Partitions with nothing new are left out; an empty
    plan means there is nothing to land.
    """
    start = F.coalesce("committed", F.lit(0))
    return (
        latest.join(committed, "partition", "left")
        .select("partition", start.cast("bigint").alias("start"), "latest")
        .where("latest > start")
        .select(
            "partition",
            "start",
            F.least(F.col("latest"), F.col("start") + cap).cast("bigint").alias("end"),
            (F.col("latest") > F.col("start") + cap).alias("run_again"),
        )
    )


def landing_summary(plan: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The plan as one landing unit: range text, offset count and whether to run again."""
    return plan.groupBy(*keys).agg(
        format_offset_spec(F.col("partition"), F.col("start"), F.col("end")).alias("offsets"),
        F.sum(F.col("end") - F.col("start")).alias("offset_count"),
        F.max("run_again").alias("run_again"),
    )


def message_count(ends: DataFrame, keys: tuple[str, ...] = ("stream",)) -> DataFrame:
    """Messages held per stream, by offset arithmetic."""
    return ends.groupBy(*keys).agg(F.sum(F.col("end") - F.col("begin")).alias("messages"))


def landed_counts(landed: DataFrame, plan: DataFrame, body: str, keys: tuple[str, ...]) -> DataFrame:
    """Per landing: offsets covered, rows really landed, and their bytes.

    The two counts differ on compacted logs, where offsets have holes.
    """
    rows = landed.groupBy(*keys).agg(
        F.count("*").alias("row_count"), F.sum(F.octet_length(body)).cast("bigint").alias("bytes")
    )
    spans = plan.groupBy(*keys).agg(F.sum(F.col("end") - F.col("start")).alias("offset_count"))
    return spans.join(rows, list(keys), "left").select(
        *keys, "offset_count", F.coalesce("row_count", F.lit(0)).alias("row_count"), F.coalesce("bytes", F.lit(0)).alias("bytes")
    )


def commit_positions(received: DataFrame, ts: str, interval: str) -> DataFrame:
    """Per tumbling interval, the position each partition may be committed at."""
    return (
        received.groupBy(F.window(ts, interval).alias("w"), "partition")
        .agg((F.max("offset") + 1).alias("next_offset"))
        .select(F.col("w.start").alias("window_start"), "partition", "next_offset")
    )


def consumer_lag(ends: DataFrame, commits: DataFrame, keys: tuple[str, ...] = ("stream", "partition")) -> DataFrame:
    """Committed offset and distance from the end, per consumer group and partition."""
    return commits.join(ends.select(*keys, "end"), list(keys), "left").select(
        "consumer", *keys, "next_offset", "end", (F.col("end") - F.col("next_offset")).alias("lag")
    )


def demand_limit(requested, low: int = POLL_MIN, high: int = POLL_MAX):
    """Records to fetch for an outstanding demand: NULL for a negative one, 0 after a cancel."""
    return F.when(requested < 0, F.lit(None)).when(requested == 0, 0).otherwise(
        F.least(F.greatest(requested, F.lit(low)), F.lit(high))
    )


def latest_gauge(served: DataFrame, keys: tuple[str, ...], now_ms) -> DataFrame:
    """Per partition: age of the newest record served and its offset."""
    return served.groupBy(*keys).agg(
        F.max_by(now_ms - F.col("ts_ms"), F.col("offset")).alias("latency_ms"), F.max("offset").alias("last_offset")
    )
