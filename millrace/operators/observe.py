"""Counters, distributions and gauges over ingest, serve and landing events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.agents import agent_products
from millrace.operators.ordered import running_total


def ingest_counters(outcomes: DataFrame, keys: tuple[str, ...] = ("stream",)) -> DataFrame:
    """Messages sent, refused by validation and failed in sending, with the bytes sent.

    ``outcomes(keys, outcome, body)`` with outcome success / validation_failure / send_failure.
    """
    sent = F.col("outcome") == "success"
    return outcomes.groupBy(*keys).agg(
        F.count_if(sent).alias("send_success"),
        F.count_if(F.col("outcome") == "validation_failure").alias("validation_failures"),
        F.count_if(F.col("outcome") == "send_failure").alias("send_failures"),
        F.coalesce(F.sum(F.when(sent, F.octet_length("body"))), F.lit(0)).cast("bigint").alias("bytes"),
    )


def serve_counters(events: DataFrame, keys: tuple[str, ...] = ("stream", "consumer")) -> DataFrame:
    """Messages and bytes served, commits by verdict, rebalances, transport errors and unknown streams.

    ``events(keys, kind, bytes)`` with kind message / commit_success / commit_failure / rebalance /
    transport_error / stream_not_found.
    """
    kinds = ("commit_success", "commit_failure", "rebalance", "transport_error", "stream_not_found")
    is_message = F.col("kind") == "message"
    return events.groupBy(*keys).agg(
        F.count_if(is_message).alias("messages"),
        F.coalesce(F.sum(F.when(is_message, F.col("bytes"))), F.lit(0)).cast("bigint").alias("bytes"),
        *[F.count_if(F.col("kind") == k).alias(k) for k in kinds],
    )


def _counted(df: DataFrame, keys: tuple[str, ...], value: Column) -> DataFrame:
    return df.groupBy(*keys, value.alias("_v")).agg(F.count("*").alias("_n"))


def size_distribution(messages: DataFrame, keys: tuple[str, ...], size: Column) -> DataFrame:
    """Count, total, largest and exact percentiles of a whole-number size.

    Equal sizes are counted before the shuffle, so a percentile sees one row per distinct size.
    """
    counted = _counted(messages, keys, size).groupBy(*keys).agg(
        F.sum("_n").alias("count"),
        F.sum(F.col("_v") * F.col("_n")).cast("bigint").alias("total"),
        F.max("_v").cast("bigint").alias("max"),
        F.expr("percentile(_v, array(0.5D, 0.95D, 0.99D), _n)").alias("_p"),
    )
    return counted.select(*keys, "count", "total", "max", *[F.col("_p")[i].alias(n) for i, n in enumerate(("p50", "p95", "p99"))])


def size_histogram(messages: DataFrame, keys: tuple[str, ...], size: Column, width: int) -> DataFrame:
    """Messages per size bucket of fixed width."""
    bucket = (F.floor(size / width) * width).cast("bigint").alias("bucket")
    return messages.groupBy(*keys, bucket).agg(F.count("*").alias("messages"))


def latency_percentiles(timings: DataFrame, keys: tuple[str, ...], ms: Column) -> DataFrame:
    """Mean, largest and 99th percentile per timer, in whole milliseconds."""
    return _counted(timings, keys, ms).groupBy(*keys).agg(
        F.sum("_n").alias("count"),
        (F.sum(F.col("_v") * F.col("_n")) / F.sum("_n")).alias("mean_ms"),
        F.max("_v").cast("bigint").alias("max_ms"),
        F.expr("percentile(_v, 0.99, _n)").alias("p99_ms"),
    )


def active_connections(events: DataFrame, keys: list[str], order: str, delta: Column, slice_rows: int | None = None) -> DataFrame:
    """Connections open after each connect (+1) and disconnect (-1), per key, in event order."""
    return running_total(events, keys, order, delta, "active", **({"width": slice_rows} if slice_rows else {}))


def client_versions(requests: DataFrame, products: list[str]) -> DataFrame:
    """Requests per stream, tracked product and its version (dots as dashes).

    ``requests(uri, user_agent)``. The first token of a product counts; the stream is the path step after
    ``/roads/`` in the URI.
    """
    stream = F.regexp_extract("uri", "^/roads/([^/]+)/", 1)
    # A tracked token counts where its product is met for the first time.
    tracked = F.filter(
        "_tokens", lambda t, i: t["product"].isin(*products) & (F.array_position("_names", t["product"]) == i + 1)
    )
    return (
        requests.select(F.when(stream != "", stream).alias("stream"), agent_products(F.col("user_agent")).alias("_tokens"))
        .withColumn("_names", F.col("_tokens.product"))
        .select("stream", F.explode(tracked).alias("t"))
        .groupBy("stream", F.col("t.product").alias("product"), F.replace("t.version", F.lit("."), F.lit("-")).alias("version"))
        .agg(F.count("*").alias("requests"))
    )


def error_counters(requests: DataFrame, body: str = "body") -> DataFrame:
    """Requests whose body is not JSON at all, by URI."""
    return requests.where(F.try_parse_json(F.col(body)).isNull()).groupBy("uri").agg(F.count("*").alias("unreadable"))
