"""Queries over the stream log: offsets, positions, ranges, counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions.offsets import format_offset_spec, parse_offset_spec
from millrace.operators import ordered, positions
from millrace.plans.serve import resume
from millrace.queries.inputs import LOG_SQL, event_ends, event_log, sql, table
from millrace.sources.log import bounded_offset_scan

SPEC = "0:100,500;1:0,50;2:300,300;4:7,1000000"
NOW_MS = 1_706_745_600_000  # 2024-02-01
TRIM_MS = 1_704_240_000_000  # 2024-01-03: older records are gone from the trimmed log

COMMITS_SQL = """
commits AS (SELECT event_type AS consumer, partition, max("offset") + 1 AS next_offset FROM log
  WHERE CAST(json_extract(props, '$.k') AS INT) < 50 AND event_type IN ('click', 'view', 'purchase')
    AND NOT (partition = 3 AND event_type = 'view') GROUP BY ALL)
"""
ENDS_SQL = f"""
ends AS (SELECT partition, min("offset") AS begin, max("offset") + 1 AS "end" FROM log WHERE ts_ms >= {TRIM_MS} GROUP BY partition)
"""
GROUPS_SQL = """
consumers AS (SELECT DISTINCT event_type AS consumer, CASE event_type WHEN 'error' THEN 'EARLIEST' WHEN 'signup' THEN NULL ELSE 'LATEST' END AS mode FROM events)
"""


def _commits(log):
    return (
        log.where(
            "CAST(get_json_object(props, '$.k') AS INT) < 50 AND event_type IN ('click', 'view', 'purchase') "
            "AND NOT (partition = 3 AND event_type = 'view')"
        )
        .groupBy(F.col("event_type").alias("consumer"), "partition")
        .agg((F.max("offset") + 1).alias("next_offset"))
    )


def _ends(log):
    return positions.log_ends(log.where(F.col("ts_ms") >= TRIM_MS))


def _streams(frame):
    """Even and odd partitions belong to two streams."""
    return frame.withColumn("stream", F.concat(F.lit("events-"), (F.col("partition") % 2).cast("string")))


def _consumers(log):
    mode = F.when(F.col("event_type") == "error", "EARLIEST").when(F.col("event_type") != "signup", "LATEST")
    return _streams(log).select("stream", F.col("event_type").alias("consumer"), mode.alias("mode")).distinct()


def log_scan(spark, sf_dir):
    return event_log(spark, sf_dir).select("partition", "offset", "ts_ms", "schema_version", "event_id", "user_id", "event_type")


def bounded_scan(spark, sf_dir):
    return bounded_offset_scan(event_log(spark, sf_dir), SPEC).select("partition", "offset", "event_id")


def several_ranges(spark, sf_dir):
    """Several ranges of a partition, in text, some of which overlap, touch or are empty."""
    spec = "0:0,5;0:10,15;0:12,20;1:3,3;2:7,9;2:9,11;2:2,4;5:0,1"
    return bounded_offset_scan(event_log(spark, sf_dir), spec).select("partition", "offset", "event_id")


def joined_bounded_scan(spark, sf_dir):
    log = event_log(spark, sf_dir)
    ranges = _commits(log).where("consumer = 'click'").select(
        "partition", (F.col("next_offset") / 2).cast("bigint").alias("start"), F.col("next_offset").alias("end")
    )
    return bounded_offset_scan(log, ranges).select("partition", "offset", "event_id")


def _daily_ranges(log):
    day = F.date_format(F.timestamp_millis("ts_ms"), "yyyy-MM-dd").alias("day")
    return log.groupBy(day, "partition").agg(F.min("offset").alias("start"), (F.max("offset") + 1).alias("end"))


def offset_specs(spark, sf_dir):
    ranges = _daily_ranges(event_log(spark, sf_dir))
    return ranges.groupBy("day").agg(format_offset_spec(F.col("partition"), F.col("start"), F.col("end")).alias("spec"))


def parsed_offset_specs(spark, sf_dir):
    specs = offset_specs(spark, sf_dir)
    return specs.select("day", F.explode(parse_offset_spec(F.col("spec"))).alias("r")).select("day", "r.partition", "r.start", "r.end")


def committed_offsets(spark, sf_dir):
    log = event_log(spark, sf_dir)
    return positions.committed_offsets(_ends(log), _commits(log).where("consumer = 'view'"))


def latest_offsets(spark, sf_dir):
    return positions.latest_of(event_ends(spark, sf_dir))


def start_position(spark, sf_dir):
    log = event_log(spark, sf_dir)
    return positions.start_positions(_streams(_ends(log)), _consumers(log), _streams(_commits(log)))


def resume_read(spark, sf_dir):
    """What the consumer ``view`` has not read yet."""
    log = event_log(spark, sf_dir)
    return resume(log, _commits(log).where("consumer = 'view'"), ends=event_ends(spark, sf_dir)).select("partition", "offset", "event_id")


def _plan(spark, sf_dir):
    latest = positions.latest_of(event_ends(spark, sf_dir))
    committed = latest.where("partition <> 5").select("partition", (F.col("partition") * 10).cast("bigint").alias("committed"))
    return positions.plan_landing(latest, committed)


def plan_landing(spark, sf_dir):
    return _plan(spark, sf_dir)


def landing_summary(spark, sf_dir):
    return positions.landing_summary(_plan(spark, sf_dir))


def landed_counts(spark, sf_dir):
    log = event_log(spark, sf_dir)
    plan = _plan(spark, sf_dir)
    # A compacted log: records of one kind are gone, their offsets are not.
    landed = bounded_offset_scan(log.where("event_type <> 'error'"), plan)
    return positions.landed_counts(landed, plan, "props", ("partition",))


def commit_positions(spark, sf_dir):
    log = event_log(spark, sf_dir).withColumn("ts", F.timestamp_millis("ts_ms"))
    windows = positions.commit_positions(log, "ts", "6 hours")
    return windows.select(F.unix_millis("window_start").alias("window_ms"), "partition", "next_offset")


def message_count(spark, sf_dir):
    # One topic per supplier nation; a line item's order is its offset range.
    ends = sql(
        spark, sf_dir,
        "SELECT concat('topic_', s_nationkey) AS stream, l_partkey % 8 AS partition, min(l_orderkey) AS begin, max(l_orderkey) AS end "
        "FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey GROUP BY 1, 2",
        "lineitem", "supplier",
    )
    return positions.message_count(ends)


def consumer_lag(spark, sf_dir):
    log = event_log(spark, sf_dir)
    ends = event_ends(spark, sf_dir).withColumn("stream", F.lit("events"))
    return positions.consumer_lag(ends, _commits(log).withColumn("stream", F.lit("events")))


def latest_gauge(spark, sf_dir):
    return positions.latest_gauge(event_log(spark, sf_dir), ("partition", "schema_version"), F.lit(NOW_MS))


def take_n(spark, sf_dir):
    return log_scan(spark, sf_dir).select("partition", "offset", "event_id").orderBy("partition", "offset").limit(500)


def demand_limit(spark, sf_dir):
    wanted = event_log(spark, sf_dir).groupBy("user_id").agg((F.count("*") * 40 - 1000).alias("requested"))
    return wanted.select("user_id", positions.demand_limit(F.col("requested")).cast("bigint").alias("fetch"))


def chunk_partitions(spark, sf_dir):
    partitions = table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 5).alias("topic"), (F.col("l_partkey") % 40).alias("partition")
    ).distinct()
    return ordered.chunk(partitions, ["topic"], "partition", 6)


def consecutive_runs(spark, sf_dir):
    """Runs of records of one kind along each partition of the log."""
    runs = ordered.run_ids(event_log(spark, sf_dir), ["partition"], "offset", F.col("event_type"), "run", 1000)
    return runs.groupBy("partition", "run", "event_type").agg(F.count("*").alias("records"), F.min("offset").alias("first_offset"))


_PLAN_SQL = """
latest AS (SELECT partition, max("offset") + 1 AS latest FROM log GROUP BY partition),
plan AS (SELECT partition, CAST(CASE WHEN partition <> 5 THEN partition * 10 ELSE 0 END AS BIGINT) AS start,
  least(latest, CASE WHEN partition <> 5 THEN partition * 10 ELSE 0 END + 100000) AS "end",
  latest > CASE WHEN partition <> 5 THEN partition * 10 ELSE 0 END + 100000 AS run_again
  FROM latest WHERE latest > CASE WHEN partition <> 5 THEN partition * 10 ELSE 0 END)
"""

_DAILY_SQL = """
daily AS (SELECT strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%d') AS day, partition, min("offset") AS start, max("offset") + 1 AS "end" FROM log GROUP BY ALL)
"""

QUERIES = {
    "log_scan": (log_scan, f'WITH {LOG_SQL} SELECT partition, "offset", ts_ms, schema_version, event_id, user_id, event_type FROM log'),
    "several_ranges": (
        several_ranges,
        f"""WITH {LOG_SQL} SELECT partition, "offset", event_id FROM log WHERE (partition = 0 AND ("offset" < 5 OR "offset" BETWEEN 10 AND 19))
        OR (partition = 2 AND ("offset" BETWEEN 7 AND 10 OR "offset" IN (2, 3))) OR (partition = 5 AND "offset" = 0)""",
    ),
    "bounded_scan": (
        bounded_scan,
        f"""WITH {LOG_SQL} SELECT partition, "offset", event_id FROM log
        WHERE (partition = 0 AND "offset" >= 100 AND "offset" < 500) OR (partition = 1 AND "offset" < 50) OR (partition = 4 AND "offset" >= 7)""",
    ),
    "joined_bounded_scan": (
        joined_bounded_scan,
        f"""WITH {LOG_SQL}, {COMMITS_SQL} SELECT l.partition, l."offset", l.event_id FROM log l
        JOIN commits c ON c.consumer = 'click' AND c.partition = l.partition WHERE l."offset" >= next_offset // 2 AND l."offset" < next_offset""",
    ),
    "offset_specs": (
        offset_specs,
        f"""WITH {LOG_SQL}, {_DAILY_SQL} SELECT day, string_agg(partition || ':' || start || ',' || "end", ';' ORDER BY partition) AS spec FROM daily GROUP BY day""",
    ),
    "parsed_offset_specs": (parsed_offset_specs, f'WITH {LOG_SQL}, {_DAILY_SQL} SELECT day, partition, start, "end" FROM daily'),
    "committed_offsets": (
        committed_offsets,
        f"""WITH {LOG_SQL}, {COMMITS_SQL}, {ENDS_SQL} SELECT e.partition, coalesce(c.next_offset, e.begin) AS committed
        FROM ends e LEFT JOIN commits c ON c.partition = e.partition AND c.consumer = 'view'""",
    ),
    "latest_offsets": (latest_offsets, f'WITH {LOG_SQL} SELECT partition, max("offset") + 1 AS latest FROM log GROUP BY partition'),
    "start_position": (
        start_position,
        f"""WITH {LOG_SQL}, {COMMITS_SQL}, {ENDS_SQL}, {GROUPS_SQL}
        SELECT 'events-' || (e.partition % 2) AS stream, g.consumer, e.partition, coalesce(c.next_offset, CASE WHEN g.mode = 'EARLIEST' THEN e.begin ELSE e."end" END) AS position
        FROM consumers g CROSS JOIN ends e LEFT JOIN commits c ON c.consumer = g.consumer AND c.partition = e.partition""",
    ),
    "resume_read": (
        resume_read,
        f"""WITH {LOG_SQL}, {COMMITS_SQL}, ends AS (SELECT partition, max("offset") + 1 AS "end" FROM log GROUP BY partition)
        SELECT l.partition, l."offset", l.event_id FROM log l JOIN ends e ON e.partition = l.partition
        LEFT JOIN commits c ON c.partition = l.partition AND c.consumer = 'view' WHERE l."offset" >= coalesce(c.next_offset, e."end")""",
    ),
    "plan_landing": (plan_landing, f'WITH {LOG_SQL}, {_PLAN_SQL} SELECT partition, start, "end", run_again FROM plan'),
    "landing_summary": (
        landing_summary,
        f"""WITH {LOG_SQL}, {_PLAN_SQL} SELECT string_agg(partition || ':' || start || ',' || "end", ';' ORDER BY partition) AS offsets,
        CAST(sum("end" - start) AS BIGINT) AS offset_count, bool_or(run_again) AS run_again FROM plan""",
    ),
    "landed_counts": (
        landed_counts,
        f"""WITH {LOG_SQL}, {_PLAN_SQL} SELECT p.partition, any_value(p."end" - p.start) AS offset_count,
        count(l.event_id) AS row_count, CAST(coalesce(sum(octet_length(encode(l.props))), 0) AS BIGINT) AS bytes
        FROM plan p LEFT JOIN log l ON l.partition = p.partition AND l."offset" >= p.start AND l."offset" < p."end" AND l.event_type <> 'error' GROUP BY p.partition""",
    ),
    "commit_positions": (
        commit_positions,
        f"""WITH {LOG_SQL} SELECT ts_ms // 21600000 * 21600000 AS window_ms, partition, max("offset") + 1 AS next_offset FROM log GROUP BY ALL""",
    ),
    "message_count": (
        message_count,
        """SELECT 'topic_' || s_nationkey AS stream, CAST(sum(e - b) AS BIGINT) AS messages FROM (
        SELECT s_nationkey, l_partkey % 8 AS p, min(l_orderkey) AS b, max(l_orderkey) AS e FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL) GROUP BY s_nationkey""",
    ),
    "consumer_lag": (
        consumer_lag,
        f"""WITH {LOG_SQL}, {COMMITS_SQL}, latest AS (SELECT partition, max("offset") + 1 AS "end" FROM log GROUP BY partition)
        SELECT consumer, 'events' AS stream, c.partition, next_offset, "end", "end" - next_offset AS lag FROM commits c JOIN latest l ON l.partition = c.partition""",
    ),
    "latest_gauge": (
        latest_gauge,
        f"""WITH {LOG_SQL} SELECT partition, schema_version, {NOW_MS} - arg_max(ts_ms, "offset") AS latency_ms, max("offset") AS last_offset FROM log GROUP BY ALL""",
    ),
    "take_n": (take_n, f'WITH {LOG_SQL} SELECT partition, "offset", event_id FROM log ORDER BY partition, "offset" LIMIT 500'),
    "demand_limit": (
        demand_limit,
        """SELECT user_id, CASE WHEN r < 0 THEN NULL WHEN r = 0 THEN 0 ELSE least(greatest(r, 10), 5000) END AS fetch
        FROM (SELECT user_id, count(*) * 40 - 1000 AS r FROM events GROUP BY user_id)""",
    ),
    "chunk_partitions": (
        chunk_partitions,
        """SELECT topic, partition, CAST((row_number() OVER (PARTITION BY topic ORDER BY partition) - 1) // 6 AS INT) AS chunk
        FROM (SELECT DISTINCT l_suppkey % 5 AS topic, l_partkey % 40 AS partition FROM lineitem)""",
    ),
    "consecutive_runs": (
        consecutive_runs,
        f"""WITH {LOG_SQL}, marked AS (SELECT *, CASE WHEN lag(event_type) OVER w IS DISTINCT FROM event_type OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS cut FROM log WINDOW w AS (PARTITION BY partition ORDER BY "offset")),
        numbered AS (SELECT *, CAST(sum(cut) OVER (PARTITION BY partition ORDER BY "offset") AS BIGINT) AS run FROM marked)
        SELECT partition, run, event_type, count(*) AS records, min("offset") AS first_offset FROM numbered GROUP BY ALL""",
    ),
}
