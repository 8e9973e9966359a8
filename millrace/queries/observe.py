"""Queries over counters, distributions, gauges and the replica inventory."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import inventory as inv
from millrace.operators import observe
from millrace.queries.inputs import sql, table


def _served_events(spark, sf_dir):
    return sql(
        spark, sf_dir,
        """SELECT concat('stream_', o_custkey % 10) AS stream, concat('consumer_', o_orderkey % 3) AS consumer,
           CASE o_orderstatus WHEN 'F' THEN 'message' WHEN 'O' THEN CASE WHEN o_orderkey % 4 = 0 THEN 'commit_failure' ELSE 'commit_success' END
             ELSE CASE o_orderkey % 3 WHEN 0 THEN 'rebalance' WHEN 1 THEN 'transport_error' ELSE 'stream_not_found' END END AS kind,
           octet_length(o_orderpriority) AS bytes FROM {orders}""",
        "orders",
    )


def serve_counters(spark, sf_dir):
    return observe.serve_counters(_served_events(spark, sf_dir))


def size_distribution(spark, sf_dir):
    """Sizes of whole conversation turns by role."""
    turns = table(spark, sf_dir, "conversations")
    return observe.size_distribution(turns, ("role",), F.octet_length("text")).select(
        "role", "count", "total", "max", *[F.round(p, 6).alias(p) for p in ("p50", "p95", "p99")]
    )


def document_sizes(spark, sf_dir):
    return observe.size_histogram(table(spark, sf_dir, "documents"), ("lang",), F.octet_length("text"), 1000)


def messages_per_request(spark, sf_dir):
    requests = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("messages"))
    return observe.size_distribution(requests, (), F.col("messages")).select(
        "count", "total", "max", *[F.round(p, 6).alias(p) for p in ("p50", "p95", "p99")]
    )


def latency_percentiles(spark, sf_dir):
    timings = table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_returnflag", "l_linestatus").alias("timer"), F.floor("l_extendedprice").cast("bigint").alias("ms")
    )
    return observe.latency_percentiles(timings, ("timer",), F.col("ms")).select(
        "timer", "count", F.round("mean_ms", 4).alias("mean_ms"), "max_ms", F.round("p99_ms", 6).alias("p99_ms")
    )


def active_connections(spark, sf_dir):
    changes = sql(
        spark, sf_dir,
        """SELECT event_id, concat('stream_', user_id % 5) AS stream, concat('consumer_', user_id % 3) AS consumer,
           CASE event_type WHEN 'signup' THEN 1 ELSE -1 END AS delta FROM {events} WHERE event_type IN ('signup', 'error')""",
        "events",
    )
    open_now = observe.active_connections(changes, ["stream", "consumer"], "event_id", F.col("delta"), 500)
    return open_now.select("event_id", "stream", "consumer", "active")


def client_versions(spark, sf_dir):
    requests = sql(
        spark, sf_dir,
        """SELECT concat('/roads/stream_', o_custkey % 10, '/messages') AS uri, CASE WHEN o_orderkey % 20 = 0 THEN NULL
           ELSE concat('client/', substr(o_orderpriority, 1, 1), '.0.', o_orderkey % 3, ' (x; y) app/1.2 client/9.9 other-', o_orderkey % 2, '/3') END AS user_agent FROM {orders}""",
        "orders",
    )
    return observe.client_versions(requests, ["client", "app", "other-1", "absent"])


# Replicas: one per (broker, topic, partition) of the line items, with everything else known for a part only.
_REPLICAS = """
SELECT CAST(l_suppkey % 3 AS INT) AS broker, concat('/disk', l_suppkey % 2) AS log_dir, concat('topic_', l_suppkey) AS topic,
       CAST(l_partkey % 8 AS INT) AS partition, CAST(sum(l_quantity) AS BIGINT) AS log_size, count(*) AS n, min(l_orderkey) AS lo, max(l_orderkey) AS hi
FROM {lineitem} GROUP BY ALL
"""


def _inventory(spark, sf_dir):
    base = sql(spark, sf_dir, _REPLICAS, "lineitem")
    replicas = base.select("broker", "log_dir", "topic", "partition", "log_size")
    leaders = base.where("partition <> 3").select("broker", "topic", "partition", (F.col("partition") % 2 == 0).alias("leader"), (F.col("n") % 5 != 0).alias("in_sync"))
    sizes = base.where("n % 3 <> 0").select("broker", "topic", "partition", (F.col("n") * 100).alias("size_on_disk"))
    offsets = base.where("partition <> 6").select("topic", "partition", F.col("lo").alias("begin"), F.col("hi").alias("end"))
    retention = table(spark, sf_dir, "supplier").where("s_suppkey % 7 <> 0").select(
        F.concat(F.lit("topic_"), F.col("s_suppkey").cast("string")).alias("topic"), (F.col("s_nationkey") * 3600000).cast("bigint").alias("retention_ms")
    )
    disks = base.where("broker <> 2").groupBy("broker", "log_dir").agg(F.sum("n").alias("free"), (F.sum("n") * 4).alias("total"))
    return inv.replica_inventory(replicas, leaders, retention, offsets, sizes, disks)


def replica_inventory(spark, sf_dir):
    return _inventory(spark, sf_dir)


def inventory_tree(spark, sf_dir):
    """The nested inventory, flattened again."""
    return inv.flatten_tree(inv.inventory_tree(_inventory(spark, sf_dir))).select(
        "broker", "log_dir", "topic", "partition", "leader", "in_sync", "size_on_disk", "log_size", "begin", "end", "record_count", "retention_ms", "disk_free", "disk_total"
    )


def inventory_gauges(spark, sf_dir):
    return inv.inventory_gauges(_inventory(spark, sf_dir))


def distinct_topics(spark, sf_dir):
    return inv.distinct_topics(sql(spark, sf_dir, _REPLICAS, "lineitem"))


_INVENTORY_SQL = """
base AS (SELECT CAST(l_suppkey % 3 AS INT) AS broker, '/disk' || (l_suppkey % 2) AS log_dir, 'topic_' || l_suppkey AS topic, l_suppkey,
       CAST(l_partkey % 8 AS INT) AS partition, CAST(sum(l_quantity) AS BIGINT) AS log_size, count(*) AS n, min(l_orderkey) AS lo, max(l_orderkey) AS hi FROM lineitem GROUP BY ALL),
disks AS (SELECT broker, log_dir, CAST(sum(n) AS BIGINT) AS free FROM base WHERE broker <> 2 GROUP BY ALL),
inventory AS (SELECT b.broker, b.log_dir, topic, partition, partition <> 3 AND partition % 2 = 0 AS leader, partition <> 3 AND n % 5 <> 0 AS in_sync,
  CASE WHEN n % 3 <> 0 THEN n * 100 ELSE 0 END AS size_on_disk, log_size, CASE WHEN partition <> 6 THEN lo ELSE 0 END AS begin, CASE WHEN partition <> 6 THEN hi ELSE 0 END AS "end",
  CASE WHEN partition <> 6 THEN hi - lo ELSE 0 END AS record_count, CAST(coalesce(s_nationkey * 3600000, 0) AS BIGINT) AS retention_ms,
  coalesce(free, 0) AS disk_free, coalesce(free * 4, 0) AS disk_total
  FROM base b LEFT JOIN supplier ON s_suppkey = l_suppkey AND s_suppkey % 7 <> 0 LEFT JOIN disks d ON d.broker = b.broker AND d.log_dir = b.log_dir)
"""
_TREE_COLUMNS = 'broker, log_dir, topic, partition, leader, in_sync, size_on_disk, log_size, begin, "end", record_count, retention_ms, disk_free, disk_total'

QUERIES = {
    "serve_counters": (
        serve_counters,
        """SELECT 'stream_' || (o_custkey % 10) AS stream, 'consumer_' || (o_orderkey % 3) AS consumer, count(*) FILTER (o_orderstatus = 'F') AS messages,
        CAST(coalesce(sum(length(o_orderpriority)) FILTER (o_orderstatus = 'F'), 0) AS BIGINT) AS bytes,
        count(*) FILTER (o_orderstatus = 'O' AND o_orderkey % 4 <> 0) AS commit_success, count(*) FILTER (o_orderstatus = 'O' AND o_orderkey % 4 = 0) AS commit_failure,
        count(*) FILTER (o_orderstatus = 'P' AND o_orderkey % 3 = 0) AS rebalance, count(*) FILTER (o_orderstatus = 'P' AND o_orderkey % 3 = 1) AS transport_error,
        count(*) FILTER (o_orderstatus = 'P' AND o_orderkey % 3 = 2) AS stream_not_found FROM orders GROUP BY ALL""",
    ),
    "size_distribution": (
        size_distribution,
        """SELECT role, count(*) AS count, CAST(sum(b) AS BIGINT) AS total, max(b) AS max, round(quantile_cont(b, 0.5), 6) AS p50, round(quantile_cont(b, 0.95), 6) AS p95, round(quantile_cont(b, 0.99), 6) AS p99
        FROM (SELECT role, octet_length(encode(text)) AS b FROM conversations) GROUP BY role""",
    ),
    "document_sizes": (
        document_sizes,
        "SELECT lang, octet_length(encode(text)) // 1000 * 1000 AS bucket, count(*) AS messages FROM documents GROUP BY ALL",
    ),
    "messages_per_request": (
        messages_per_request,
        """SELECT count(*) AS count, CAST(sum(n) AS BIGINT) AS total, max(n) AS max, round(quantile_cont(n, 0.5), 6) AS p50, round(quantile_cont(n, 0.95), 6) AS p95, round(quantile_cont(n, 0.99), 6) AS p99
        FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey)""",
    ),
    "latency_percentiles": (
        latency_percentiles,
        """SELECT l_returnflag || '-' || l_linestatus AS timer, count(*) AS count, round(avg(ms), 4) AS mean_ms, max(ms) AS max_ms, round(quantile_cont(ms, 0.99), 6) AS p99_ms
        FROM (SELECT *, CAST(floor(l_extendedprice) AS BIGINT) AS ms FROM lineitem) GROUP BY 1""",
    ),
    "active_connections": (
        active_connections,
        """SELECT event_id, 'stream_' || (user_id % 5) AS stream, 'consumer_' || (user_id % 3) AS consumer,
        CAST(sum(CASE event_type WHEN 'signup' THEN 1 ELSE -1 END) OVER (PARTITION BY user_id % 5, user_id % 3 ORDER BY event_id) AS BIGINT) AS active FROM events WHERE event_type IN ('signup', 'error')""",
    ),
    "client_versions": (
        client_versions,
        """WITH r AS (SELECT 'stream_' || (o_custkey % 10) AS stream, o_orderkey AS k, o_orderpriority AS p FROM orders WHERE o_orderkey % 20 <> 0),
        t AS (SELECT stream, 'client' AS product, substr(p, 1, 1) || '-0-' || (k % 3) AS version FROM r UNION ALL SELECT stream, 'app', '1-2' FROM r
              UNION ALL SELECT stream, 'other-1', '3' FROM r WHERE k % 2 = 1)
        SELECT stream, product, version, count(*) AS requests FROM t GROUP BY ALL""",
    ),
    "replica_inventory": (replica_inventory, f"WITH {_INVENTORY_SQL} SELECT {_TREE_COLUMNS} FROM inventory"),
    "inventory_tree": (inventory_tree, f"WITH {_INVENTORY_SQL} SELECT {_TREE_COLUMNS} FROM inventory"),
    "inventory_gauges": (
        inventory_gauges,
        f"""WITH {_INVENTORY_SQL}, dirs AS (SELECT DISTINCT broker, log_dir, disk_free, disk_total FROM inventory)
        SELECT 'size_on_disk' AS metric, broker, log_dir, topic, partition, leader, in_sync, size_on_disk AS value FROM inventory
        UNION ALL SELECT 'log_size', broker, log_dir, topic, partition, leader, in_sync, log_size FROM inventory
        UNION ALL SELECT 'begin', broker, log_dir, topic, partition, leader, in_sync, begin FROM inventory
        UNION ALL SELECT 'end', broker, log_dir, topic, partition, leader, in_sync, "end" FROM inventory
        UNION ALL SELECT 'record_count', broker, log_dir, topic, partition, leader, in_sync, record_count FROM inventory
        UNION ALL SELECT 'disk_free', broker, log_dir, NULL, NULL, NULL, NULL, disk_free FROM dirs
        UNION ALL SELECT 'disk_total', broker, log_dir, NULL, NULL, NULL, NULL, disk_total FROM dirs
        UNION ALL SELECT 'disk_used', broker, log_dir, NULL, NULL, NULL, NULL, disk_total - disk_free FROM dirs""",
    ),
    "distinct_topics": (distinct_topics, "SELECT DISTINCT 'topic_' || l_suppkey AS topic FROM lineitem"),
}
