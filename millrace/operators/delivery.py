"""Delivery quality of probe messages: end states, order, gaps, duplicates, transit times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.operators.ordered import previous_value, running
from millrace.session import settle

GROUPS = 2520
LIFETIME_MS = 60_000
# Send outcomes, and whether a message in that state counts as on its way.
SEND_STATES = {"SENT": False, "SEND_FAILURE": False, "SEND_SUCCESS": True, "SEND_REJECTED": False}


def probe_group(seq: Column, groups: int = GROUPS) -> Column:
    return F.abs(seq % groups).cast("int")


def own_messages(received: DataFrame, origin: str) -> DataFrame:
    """A probe only looks at messages it sent itself."""
    return received.where(F.col("origin") == origin)


def first_receipts(received: DataFrame) -> DataFrame:
    """First receipt per message; later copies are ignored. Aggregates before the shuffle."""
    return received.groupBy("origin", "seq").agg(
        F.min("recv_ms").alias("recv_ms"), F.min_by("payload", "recv_ms").alias("recv_payload")
    )


def correlate_delivery(sent: DataFrame, received: DataFrame, lifetime_ms: int = LIFETIME_MS) -> DataFrame:
    """Sent messages with their first receipt, if it came within the lifetime.

    ``sent(origin, seq, sent_ms, payload, send_state)``, ``received(origin, seq, recv_ms, payload)``.
    """
    first = first_receipts(received)
    in_time = F.col("recv_ms") - F.col("sent_ms") <= lifetime_ms
    return (
        sent.join(first, ["origin", "seq"], "left")
        .withColumn("in_time", F.coalesce(in_time, F.lit(False)))
        .withColumn("recv_ms", F.when(F.col("in_time"), F.col("recv_ms")))
        .withColumn("intact", F.when(F.col("in_time"), F.crc32("recv_payload") == F.crc32("payload")))
        .withColumn("transit_ms", F.col("recv_ms") - F.col("sent_ms"))
        .drop("recv_payload", "in_time")
    )


def delivery_order(correlated: DataFrame, groups: int = GROUPS, slice_seqs: int | None = None) -> DataFrame:
    """End state of each message: ``state``.

    A received message is in order when the nearest earlier message of its group that was on its way by then
    had already arrived. Sent messages are on their way; one whose sending failed is only if it arrived all the
    same, and is passed over until it does.
    """
    sent = F.lit(False)
    for state, on_way in SEND_STATES.items():
        if on_way:
            sent = sent | (F.col("send_state") == state)
    # A group holds every groups-th sequence number.
    width = slice_seqs or groups * 100_000
    grouped = correlated.withColumn("group", probe_group(F.col("seq"), groups))
    keys = ["origin", "group"]
    before = F.when(sent, F.struct("seq", "recv_ms"))
    arrived = F.coalesce(F.col("_before.recv_ms") <= F.col("recv_ms"), F.lit(False))
    ordered = settle(
        previous_value(grouped, keys, "seq", before, "_before", width)
        .withColumn("_in_order", F.col("_before").isNull() | arrived)
        .withColumn("_since", F.coalesce("_before.seq", F.lit(-(1 << 62))))
        .withColumn("_stray", F.col("recv_ms").isNotNull() & ~sent)
        .drop("_before"),
        "delivery-order",
    )
    # A message behind one that is late may still follow a stray: one that failed to be sent, yet arrived.
    # Only late ones and strays are looked at again.
    late = F.col("recv_ms").isNotNull() & ~F.col("_in_order")
    again = running(
        ordered.where(late | F.col("_stray")),
        [*keys, "_since"], "seq", F.when(F.col("_stray"), F.col("recv_ms")), "_first_stray", F.min, False, width,
    )
    excused = F.col("_in_order") | F.coalesce(F.col("_first_stray") <= F.col("recv_ms"), F.lit(False))
    judged = (
        ordered.where(~(late | F.col("_stray")))
        .unionByName(again.withColumn("_in_order", excused).drop("_first_stray"))
        .drop("_since", "_stray")
    )
    state = (
        F.when(F.col("recv_ms").isNull(), F.col("send_state"))
        .when(~F.col("intact"), "RECEIVED_CORRUPTED")
        .when(F.col("_in_order"), "RECEIVED_CORRECT")
        .otherwise("RECEIVED_OUT_OF_ORDER")
    )
    return judged.withColumn("state", state).drop("_in_order")


def sli_report(states: DataFrame) -> DataFrame:
    """Share of correctly received messages and the transit time 99 % of receipts stay within.

    Transit times are whole milliseconds below the lifetime, so counting them first leaves a small table
    for the exact percentile.
    """
    counted = states.groupBy("state", "transit_ms").agg(F.count("*").alias("n"))
    return counted.agg(
        F.sum("n").alias("total"),
        F.sum(F.when(F.col("state") == "RECEIVED_CORRECT", F.col("n")).otherwise(0)).alias("correct"),
        F.expr("percentile(transit_ms, 0.99, n)").alias("transit_p99_ms"),
    ).withColumn("correct_share", F.col("correct") / F.col("total"))


def landing_gap_check(landed: DataFrame, landing: str = "acquisition_instant", groups: int = GROUPS, slice_seqs: int | None = None) -> DataFrame:
    """Per landing: duplicate and missing records, wrong groups, changed payloads.

    ``landed(landing, seq, group, payload, checksum)``. Copies are counted away before anything is ordered,
    so a landing that is mostly copies of one record costs no more than any other.
    """
    faults = landed.groupBy(landing, "group", "seq").agg(
        F.count("*").alias("_copies"),
        F.count_if(F.col("group") != probe_group(F.col("seq"), groups)).alias("_wrong"),
        F.count_if(F.crc32("payload") != F.col("checksum")).alias("_changed"),
    )
    width = slice_seqs or groups * 100_000
    ordered = previous_value(faults, [landing, "group"], "seq", F.col("seq"), "_before", width)
    step = F.col("seq") - F.col("_before")
    return ordered.groupBy(landing).agg(
        F.sum("_copies").alias("records"),
        F.sum(F.col("_copies") - 1).alias("duplicates"),
        F.count_if((step > groups) & (step % groups == 0)).alias("gaps"),
        F.sum("_wrong").alias("wrong_group"),
        F.sum("_changed").alias("changed_payload"),
    )


def landing_boundary_check(landed: DataFrame, landing: str = "acquisition_instant", groups: int = GROUPS) -> DataFrame:
    """Per landing and group: does its first record follow the last one of the landing before?

    Windows run over one row per landing and group, never over records.
    """
    ends = landed.groupBy(landing, "group").agg(F.min("seq").alias("min_seq"), F.max("seq").alias("max_seq"))
    before = W.partitionBy("group").orderBy(landing)
    return ends.withColumn("previous_max", F.lag("max_seq").over(before)).withColumn(
        "boundary_ok", F.col("previous_max").isNull() | (F.col("min_seq") - F.col("previous_max") == groups)
    )


def correlate_commits(commits: DataFrame, responses: DataFrame) -> DataFrame:
    """Outcome per commit: the response's verdict, ``closed`` when none came, and ``unknown`` for a response
    to no commit."""
    return commits.withColumn("_c", F.lit(True)).join(responses, "correlation_id", "full").select(
        "correlation_id",
        F.when(F.col("_c").isNull(), "unknown")
        .when(F.col("success").isNull(), "closed")
        .when(F.col("success"), "committed")
        .otherwise("failed")
        .alias("result"),
    )
