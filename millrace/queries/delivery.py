"""Queries over probe messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import delivery
from millrace.queries.inputs import LANDED, LANDED_SQL, PROBE_GROUPS, PROBE_SQL, RECEIVED, SENT, sql, table

SLICE = PROBE_GROUPS * 500


def _correlated(spark, sf_dir):
    return delivery.correlate_delivery(sql(spark, sf_dir, SENT, "events"), sql(spark, sf_dir, RECEIVED, "events"))


def _states(spark, sf_dir):
    return delivery.delivery_order(_correlated(spark, sf_dir), PROBE_GROUPS, SLICE)


def _landed(spark, sf_dir):
    return sql(spark, sf_dir, LANDED, "events")


def origin_filter(spark, sf_dir):
    """Receipts of one origin that answer a message it sent."""
    mine = delivery.own_messages(sql(spark, sf_dir, RECEIVED, "events"), "origin-1")
    sent = sql(spark, sf_dir, SENT, "events").where("seq % 6 <> 0").select("origin", "seq")
    return mine.join(sent, ["origin", "seq"], "left_semi").select("origin", "seq", "recv_ms")


def correlate_delivery(spark, sf_dir):
    return _correlated(spark, sf_dir).select("origin", "seq", "send_state", "recv_ms", "intact", "transit_ms")


def delivery_order(spark, sf_dir):
    return _states(spark, sf_dir).select("origin", "seq", "group", "transit_ms", "state")


def delivery_states(spark, sf_dir):
    return _states(spark, sf_dir).groupBy("state").agg(F.count("*").alias("messages"))


def sli_report(spark, sf_dir):
    report = delivery.sli_report(_states(spark, sf_dir))
    return report.select("total", "correct", F.round("transit_p99_ms", 6).alias("transit_p99_ms"), F.round("correct_share", 9).alias("correct_share"))


def gap_check(spark, sf_dir):
    return delivery.landing_gap_check(_landed(spark, sf_dir), groups=PROBE_GROUPS, slice_seqs=SLICE)


def boundary_check(spark, sf_dir):
    return delivery.landing_boundary_check(_landed(spark, sf_dir), groups=PROBE_GROUPS)


def correlate_commits(spark, sf_dir):
    """One commit per order; part of them answered, some answers to none."""
    orders = table(spark, sf_dir, "orders")
    commits = orders.where("o_orderkey % 9 <> 0").select(F.col("o_orderkey").alias("correlation_id"))
    answers = orders.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("correlation_id"), (F.col("o_orderstatus") == "F").alias("success"))
    return delivery.correlate_commits(commits, answers)


QUERIES = {
    "origin_filter": (origin_filter, f"WITH {PROBE_SQL} SELECT origin, seq, recv_ms FROM received WHERE origin = 'origin-1' AND seq % 6 <> 0"),
    "correlate_delivery": (correlate_delivery, f"WITH {PROBE_SQL} SELECT origin, seq, send_state, recv_ms, intact, transit_ms FROM correlated"),
    "delivery_order": (delivery_order, f'WITH {PROBE_SQL} SELECT origin, seq, CAST("group" AS INT) AS "group", transit_ms, state FROM states'),
    "delivery_states": (delivery_states, f"WITH {PROBE_SQL} SELECT state, count(*) AS messages FROM states GROUP BY state"),
    "sli_report": (
        sli_report,
        f"""WITH {PROBE_SQL} SELECT count(*) AS total, count(*) FILTER (state = 'RECEIVED_CORRECT') AS correct, round(quantile_cont(transit_ms, 0.99), 6) AS transit_p99_ms,
        round(count(*) FILTER (state = 'RECEIVED_CORRECT') / count(*), 9) AS correct_share FROM states""",
    ),
    "gap_check": (
        gap_check,
        f"""WITH {LANDED_SQL}, single AS (SELECT acquisition_instant, "group", seq, count(*) AS copies, bool_or("group" <> seq % 7) AS wrong, bool_or(changed) AS changed FROM landed GROUP BY ALL),
        stepped AS (SELECT *, seq - lag(seq) OVER (PARTITION BY acquisition_instant, "group" ORDER BY seq) AS step FROM single)
        SELECT acquisition_instant, CAST(sum(copies) AS BIGINT) AS records, CAST(sum(copies - 1) AS BIGINT) AS duplicates, count(*) FILTER (step > 7 AND step % 7 = 0) AS gaps,
        CAST(coalesce(sum(copies) FILTER (wrong), 0) AS BIGINT) AS wrong_group, CAST(coalesce(sum(copies) FILTER (changed), 0) AS BIGINT) AS changed_payload FROM stepped GROUP BY acquisition_instant""",
    ),
    "boundary_check": (
        boundary_check,
        f"""WITH {LANDED_SQL}, ends AS (SELECT acquisition_instant, "group", min(seq) AS min_seq, max(seq) AS max_seq FROM landed GROUP BY ALL),
        looked AS (SELECT *, lag(max_seq) OVER (PARTITION BY "group" ORDER BY acquisition_instant) AS previous_max FROM ends)
        SELECT *, previous_max IS NULL OR min_seq - previous_max = 7 AS boundary_ok FROM looked""",
    ),
    "correlate_commits": (
        correlate_commits,
        """SELECT o_orderkey AS correlation_id, CASE WHEN o_orderkey % 9 = 0 THEN 'unknown' WHEN o_orderstatus = 'P' THEN 'closed' WHEN o_orderstatus = 'F' THEN 'committed' ELSE 'failed' END AS result
        FROM orders WHERE o_orderkey % 9 <> 0 OR o_orderstatus <> 'P'""",
    ),
}
