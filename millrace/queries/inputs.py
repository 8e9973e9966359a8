"""Inputs of the registered queries, derived by rule from the given tables.

The tables hold no offsets, schemas or networks. Each input is stated once as Spark SQL and once as DuckDB
SQL (the ``*_SQL`` constants, common table expressions for the oracles).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import fresh_path, prepare
from millrace.sources.log import append_log, log_scan, stored_ends

PARTITIONS = 6

# Message schemas of the event stream; version 2 adds a defaulted and an optional field.
EVENT_V1 = (
    '{"type":"record","name":"event","fields":[{"name":"id","type":"long"},{"name":"user","type":"long"},'
    '{"name":"kind","type":"string","sensitivity":"PII"}]}'
)
EVENT_V2 = (
    '{"type":"record","name":"event","fields":[{"name":"id","type":"long"},{"name":"user","type":"long"},'
    '{"name":"kind","type":"string","sensitivity":"PII"},{"name":"value","type":"double","default":0.0},'
    '{"name":"props","type":["null",{"type":"record","name":"props","fields":[{"name":"k","type":"int"}]}],"default":null}]}'
)
EVENT_SCHEMAS = {1: EVENT_V1, 2: EVENT_V2}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql(spark: SparkSession, sf_dir: str, text: str, *tables: str, **frames: DataFrame) -> DataFrame:
    """Spark SQL over the named tables and frames."""
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in tables}, **frames)


# -- the event log ------------------------------------------------------------------------------------

EVENT_RECORDS = """
SELECT CAST(user_id % 6 AS INT) AS partition, unix_millis(CAST(ts AS TIMESTAMP)) AS ts_ms,
       CASE WHEN event_type IN ('error', 'signup') THEN 1 ELSE 2 END AS schema_version,
       event_id, user_id, event_type, value, props,
       CASE WHEN event_type IN ('error', 'signup')
            THEN to_json(named_struct('id', event_id, 'user', user_id, 'kind', event_type))
            ELSE to_json(named_struct('id', event_id, 'user', user_id, 'kind', event_type, 'value', value,
                                      'props', parse_json(props))) END AS body
FROM {events}
"""

LOG_SQL = """
log AS (SELECT CAST(user_id % 6 AS INT) AS partition,
               row_number() OVER (PARTITION BY user_id % 6 ORDER BY epoch_us(ts) // 1000, event_id) - 1 AS "offset",
               epoch_us(ts) // 1000 AS ts_ms,
               CASE WHEN event_type IN ('error', 'signup') THEN 1 ELSE 2 END AS schema_version,
               event_id, user_id, event_type, value, props
        FROM events)
"""

_stored: dict[tuple[str, str], str] = {}


def event_log_path(spark: SparkSession, sf_dir: str) -> str:
    """The events as a stored log, written once per application by the engine's own append."""
    prepare(spark)
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stored:
        path = fresh_path(spark, "event-log")
        append_log(sql(spark, sf_dir, EVENT_RECORDS, "events"), path, ["ts_ms", "event_id"])
        _stored[key] = path
    return _stored[key]


def event_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Begin and end of each partition of the event log, as its append kept them."""
    return stored_ends(spark, event_log_path(spark, sf_dir))


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_scan(spark, event_log_path(spark, sf_dir)).withColumn("partition", F.col("partition").cast("int"))


# -- the stream catalog -------------------------------------------------------------------------------

# One stream per customer.
STREAMS = """
SELECT c_custkey, CASE WHEN c_custkey % 17 = 0 THEN concat('Bad-', c_custkey) ELSE concat('stream_', c_custkey) END AS stream,
       c_acctbal > 0 AS enabled, c_custkey % 13 = 0 AS deleted,
       CAST(c_acctbal * 100 AS BIGINT) AS enabled_ms, CAST(c_custkey % 5 AS BIGINT) AS message_count,
       CASE WHEN c_custkey % 7 <> 0 THEN CAST(300000 AS BIGINT) END AS counted_ms,
       c_custkey % 4 <> 0 AS has_destinations, c_custkey % 8 <> 1 AS has_destinations_map, c_custkey % 4 <> 0 AND c_custkey % 8 <> 1 AS has_hive,
       c_custkey % 5 <> 0 AS hive_enabled,
       CASE c_custkey % 8 WHEN 0 THEN 'PT1H' WHEN 1 THEN 'PT5M' WHEN 2 THEN 'P1D' WHEN 3 THEN 'PT30S'
            WHEN 4 THEN 'P2D' WHEN 5 THEN NULL WHEN 6 THEN 'soon' ELSE 'PT2H30M' END AS landing_interval,
       CASE c_custkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'never'
            ELSE concat('2024-01-', lpad(CAST(1 + c_custkey % 28 AS STRING), 2, '0'), ' 06:00:00') END AS last_run,
       CASE c_custkey % 7 WHEN 0 THEN NULL WHEN 1 THEN '$.id' WHEN 2 THEN '$.owner.name' WHEN 3 THEN '$.tags.code'
            WHEN 4 THEN '$["owner"]["missing"]' WHEN 5 THEN '$' ELSE 'no path' END AS partition_path,
       array(c_mktsegment, CASE WHEN c_custkey % 11 = 0 THEN '*' ELSE 'OPS' END) AS authorities,
       map(c_mktsegment, CASE WHEN c_custkey % 9 = 0 THEN CAST(array() AS ARRAY<STRING>) WHEN c_custkey % 2 = 0 THEN array('PUBLIC', 'PII') ELSE array('PUBLIC') END) AS read_authorities,
       array(concat('10.', c_custkey % 4, '.0.0/', CASE WHEN c_custkey % 10 = 0 THEN 40 ELSE 16 END)) AS cidr_blocks,
       c_custkey % 3 <> 0 AS topic_created, CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'CAN_READ_ALL' ELSE 'MUTUAL_READ_LATEST' END AS compatibility_mode
FROM {customer}
"""

STREAMS_SQL = """
streams AS (SELECT c_custkey, CASE WHEN c_custkey % 17 = 0 THEN 'Bad-' || c_custkey ELSE 'stream_' || c_custkey END AS stream,
       c_acctbal > 0 AS enabled, c_custkey % 13 = 0 AS deleted,
       CAST(trunc(c_acctbal * 100) AS BIGINT) AS enabled_ms, CAST(c_custkey % 5 AS BIGINT) AS message_count,
       CASE WHEN c_custkey % 7 <> 0 THEN CAST(300000 AS BIGINT) END AS counted_ms,
       c_custkey % 4 <> 0 AS has_destinations, c_custkey % 8 <> 1 AS has_destinations_map, c_custkey % 4 <> 0 AND c_custkey % 8 <> 1 AS has_hive,
       c_custkey % 5 <> 0 AS hive_enabled,
       CASE c_custkey % 8 WHEN 0 THEN 'PT1H' WHEN 1 THEN 'PT5M' WHEN 2 THEN 'P1D' WHEN 3 THEN 'PT30S'
            WHEN 4 THEN 'P2D' WHEN 5 THEN NULL WHEN 6 THEN 'soon' ELSE 'PT2H30M' END AS landing_interval,
       CASE c_custkey % 8 WHEN 0 THEN 3600 WHEN 1 THEN 300 WHEN 2 THEN 86400 WHEN 3 THEN 30
            WHEN 4 THEN 172800 WHEN 5 THEN 3600 WHEN 6 THEN NULL ELSE 9000 END AS interval_s,
       CASE WHEN c_custkey % 6 < 2 THEN TIMESTAMP '1970-01-01'
            ELSE make_timestamp(2024, 1, 1 + c_custkey % 28, 6, 0, 0.0) END AS last_run_ts,
       CASE c_custkey % 7 WHEN 0 THEN NULL WHEN 1 THEN '$.id' WHEN 2 THEN '$.owner.name' WHEN 3 THEN '$.tags.code'
            WHEN 4 THEN '$["owner"]["missing"]' WHEN 5 THEN '$' ELSE 'no path' END AS partition_path,
       c_mktsegment, c_custkey % 3 <> 0 AS topic_created,
       CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'CAN_READ_ALL' ELSE 'MUTUAL_READ_LATEST' END AS compatibility_mode
FROM customer)
"""


def streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, STREAMS, "customer")


# One to four schema versions per stream. The rules below decide what each version holds:
#   id        int, long from version 3 on
#   owner     record of name (string, PII for every third stream)
#   tags      array of record of code (string)
#   note      optional string, from version 2 on
#   extra     required string without default, in version 4 of even streams
# and, on a few streams, something that is not allowed.
SCHEMAS = """
SELECT c_custkey, version,
       CASE WHEN c_custkey % 17 = 0 THEN concat('Bad-', c_custkey) ELSE concat('stream_', c_custkey) END AS stream,
       (c_custkey + version) % 5 = 0 AS deleted,
       concat('{{"type":"record","name":"m","fields":[{{"name":"id","type":"', CASE WHEN version >= 3 THEN 'long' ELSE 'int' END, '"}},',
         '{{"name":"owner","type":{{"type":"record","name":"o","fields":[{{"name":"name","type":"string"',
            CASE WHEN c_custkey % 3 = 0 THEN ',"sensitivity":"PII"' ELSE '' END, '}}]}}}},',
         '{{"name":"tags","type":{{"type":"array","items":{{"type":"record","name":"t","fields":[{{"name":"code","type":"string"}}]}}}}}}',
         CASE WHEN version >= 2 THEN concat(',{{"name":"note","type":["null","string"],"default":null',
              CASE WHEN c_custkey % 9 = 1 AND version >= 3 THEN ',"sensitivity":"PII"' ELSE '' END, '}}') ELSE '' END,
         CASE WHEN version = 4 AND c_custkey % 2 = 0 THEN ',{{"name":"extra","type":"string"}}' ELSE '' END,
         CASE WHEN c_custkey % 19 = 0 THEN ',{{"name":"Acquisition_Instant","type":["null","long"],"default":null}}' ELSE '' END,
         CASE WHEN c_custkey % 23 = 0 THEN ',{{"name":"age","type":["null","int"],"default":null,"sensitivity":"PII"}}' ELSE '' END,
         CASE WHEN c_custkey % 29 = 0 THEN ',{{"name":"raw","type":["bytes","string"],"default":""}}' ELSE '' END,
         ']}}') AS schema_json
FROM (SELECT c_custkey, explode(sequence(1, CAST(1 + c_custkey % 4 AS INT))) AS version FROM {customer})
"""

SCHEMAS_SQL = """
schemas AS (SELECT c_custkey, version, CASE WHEN c_custkey % 17 = 0 THEN 'Bad-' || c_custkey ELSE 'stream_' || c_custkey END AS stream,
       (c_custkey + version) % 5 = 0 AS deleted
FROM (SELECT c_custkey, CAST(unnest(range(1, 2 + c_custkey % 4)) AS INT) AS version FROM customer))
"""

# The rows schema_fields gives for those schemas, by the same rules.
FIELDS_SQL = f"""
{SCHEMAS_SQL},
nodes AS (
  SELECT *, '' AS path, 'root' AS kind, 'record' AS type, FALSE AS nullable, FALSE AS pii FROM schemas
  UNION ALL SELECT *, '/id', 'field', CASE WHEN version >= 3 THEN 'long' ELSE 'int' END, FALSE, FALSE FROM schemas
  UNION ALL SELECT *, '/owner', 'field', 'record', FALSE, FALSE FROM schemas
  UNION ALL SELECT *, '/owner/name', 'field', 'string', FALSE, c_custkey % 3 = 0 FROM schemas
  UNION ALL SELECT *, '/tags', 'field', 'array', FALSE, FALSE FROM schemas
  UNION ALL SELECT *, '/tags/*', 'element', 'record', FALSE, FALSE FROM schemas
  UNION ALL SELECT *, '/tags/*/code', 'field', 'string', FALSE, FALSE FROM schemas
  UNION ALL SELECT *, '/note', 'field', 'union', TRUE, c_custkey % 9 = 1 AND version >= 3 FROM schemas WHERE version >= 2
  UNION ALL SELECT *, '/note/0', 'branch', 'null', TRUE, FALSE FROM schemas WHERE version >= 2
  UNION ALL SELECT *, '/note/1', 'branch', 'string', FALSE, FALSE FROM schemas WHERE version >= 2
  UNION ALL SELECT *, '/extra', 'field', 'string', FALSE, FALSE FROM schemas WHERE version = 4 AND c_custkey % 2 = 0
  UNION ALL SELECT *, '/Acquisition_Instant', 'field', 'union', TRUE, FALSE FROM schemas WHERE c_custkey % 19 = 0
  UNION ALL SELECT *, '/Acquisition_Instant/0', 'branch', 'null', TRUE, FALSE FROM schemas WHERE c_custkey % 19 = 0
  UNION ALL SELECT *, '/Acquisition_Instant/1', 'branch', 'long', FALSE, FALSE FROM schemas WHERE c_custkey % 19 = 0
  UNION ALL SELECT *, '/age', 'field', 'union', TRUE, TRUE FROM schemas WHERE c_custkey % 23 = 0
  UNION ALL SELECT *, '/age/0', 'branch', 'null', TRUE, FALSE FROM schemas WHERE c_custkey % 23 = 0
  UNION ALL SELECT *, '/age/1', 'branch', 'int', FALSE, FALSE FROM schemas WHERE c_custkey % 23 = 0
  UNION ALL SELECT *, '/raw', 'field', 'union', FALSE, FALSE FROM schemas WHERE c_custkey % 29 = 0
  UNION ALL SELECT *, '/raw/0', 'branch', 'bytes', FALSE, FALSE FROM schemas WHERE c_custkey % 29 = 0
  UNION ALL SELECT *, '/raw/1', 'branch', 'string', FALSE, FALSE FROM schemas WHERE c_custkey % 29 = 0)
"""


def schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer makes a kilobyte or more of texts, so customers are dealt out first: their files are few and small."""
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return sql(spark, sf_dir, SCHEMAS, customer=table(spark, sf_dir, "customer").select("c_custkey").repartition(tasks, "c_custkey"))


# -- probe messages -----------------------------------------------------------------------------------

# One probe message per event, one a second, in seven groups.
PROBE_GROUPS = 7
SENT = """
SELECT concat('origin-', event_id % 2) AS origin, event_id AS seq, (event_id + 1) * 1000 AS sent_ms, props AS payload,
       CASE event_type WHEN 'error' THEN 'SEND_FAILURE' WHEN 'signup' THEN 'SEND_REJECTED' ELSE 'SEND_SUCCESS' END AS send_state
FROM {events}
"""
# Some are lost, some come late, twice or changed, and some failed ones arrive all the same.
RECEIVED = """
SELECT concat('origin-', event_id % 2) AS origin, event_id AS seq, (event_id + 1) * 1000 + (user_id * 37 + event_id * 11) % 700 * 100 + copy * 500 AS recv_ms,
       CASE WHEN event_id % 8 = 0 THEN concat(props, '!') ELSE props END AS payload
FROM {events} LATERAL VIEW explode(CASE WHEN event_id % 9 = 0 THEN array(0, 1) ELSE array(0) END) c AS copy
WHERE event_id % 10 <> 0
     AND (event_type IN ('click', 'view', 'purchase') OR (event_type = 'error' AND event_id % 4 = 0))
"""
PROBE_SQL = """
sent AS (SELECT 'origin-' || (event_id % 2) AS origin, event_id AS seq, (event_id + 1) * 1000 AS sent_ms, props AS payload,
       CASE event_type WHEN 'error' THEN 'SEND_FAILURE' WHEN 'signup' THEN 'SEND_REJECTED' ELSE 'SEND_SUCCESS' END AS send_state
FROM events),
received AS (SELECT 'origin-' || (event_id % 2) AS origin, event_id AS seq, (event_id + 1) * 1000 + (user_id * 37 + event_id * 11) % 700 * 100 + copy * 500 AS recv_ms,
       event_id % 8 <> 0 AS intact
FROM events JOIN (VALUES (0), (1)) c(copy)
  ON (copy = 0 OR event_id % 9 = 0) AND event_id % 10 <> 0
     AND (event_type IN ('click', 'view', 'purchase') OR (event_type = 'error' AND event_id % 4 = 0))),
first_receipt AS (SELECT origin, seq, min(recv_ms) AS recv_ms, bool_and(intact) AS intact FROM received GROUP BY ALL),
correlated AS (SELECT s.origin, s.seq, s.sent_ms, s.send_state, CASE WHEN r.recv_ms - s.sent_ms <= 60000 THEN r.recv_ms END AS recv_ms,
       CASE WHEN r.recv_ms - s.sent_ms <= 60000 THEN r.intact END AS intact,
       CASE WHEN r.recv_ms - s.sent_ms <= 60000 THEN r.recv_ms - s.sent_ms END AS transit_ms
FROM sent s LEFT JOIN first_receipt r ON s.origin = r.origin AND s.seq = r.seq),
grouped AS (SELECT *, abs(seq % 7) AS "group", send_state = 'SEND_SUCCESS' AS sent_ok FROM correlated),
looked AS (SELECT *, last_value(CASE WHEN sent_ok THEN seq END IGNORE NULLS) OVER (PARTITION BY origin, "group" ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before_seq FROM grouped),
strays AS (SELECT *, min(CASE WHEN NOT sent_ok THEN recv_ms END) OVER (PARTITION BY origin, "group", before_seq ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS stray_ms FROM looked),
states AS (SELECT l.origin, l.seq, l."group", l.sent_ms, l.transit_ms, l.recv_ms,
       CASE WHEN l.recv_ms IS NULL THEN l.send_state WHEN NOT l.intact THEN 'RECEIVED_CORRUPTED'
            WHEN l.before_seq IS NULL OR coalesce(b.recv_ms <= l.recv_ms, FALSE) OR coalesce(l.stray_ms <= l.recv_ms, FALSE) THEN 'RECEIVED_CORRECT'
            ELSE 'RECEIVED_OUT_OF_ORDER' END AS state
FROM strays l LEFT JOIN correlated b ON b.origin = l.origin AND b.seq = l.before_seq)
"""

# Landed probe records: one landing per day, some records dropped, doubled, moved or changed.
LANDED = """
SELECT date_format(CAST(ts AS TIMESTAMP), "yyyyMMdd'T'000000'Z'") AS acquisition_instant, event_id AS seq,
       CAST(CASE WHEN event_id % 211 = 0 THEN (event_id + 1) % 7 ELSE event_id % 7 END AS INT) AS `group`,
       props AS payload, CASE WHEN event_id % 97 = 0 THEN CAST(0 AS BIGINT) ELSE crc32(props) END AS checksum
FROM {events} LATERAL VIEW explode(CASE WHEN event_id % 53 = 0 THEN array(0, 1, 2) ELSE array(0) END) c AS copy
WHERE event_id % 31 <> 5
"""
LANDED_SQL = """
landed AS (SELECT strftime(ts, '%Y%m%d') || 'T000000Z' AS acquisition_instant, event_id AS seq,
       CAST(CASE WHEN event_id % 211 = 0 THEN (event_id + 1) % 7 ELSE event_id % 7 END AS INT) AS "group",
       event_id % 97 = 0 AS changed
FROM events JOIN (VALUES (0), (1), (2)) c(copy)
  ON event_id % 31 <> 5 AND (copy = 0 OR event_id % 53 = 0))
"""
