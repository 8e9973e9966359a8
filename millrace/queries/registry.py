"""Queries over the schema registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import registry
from millrace.plans.serve import decode_by_registry as decode_records
from millrace.plans.serve import join_writer_schema as join_schemas
from millrace.queries.inputs import EVENT_V1, EVENT_V2, FIELDS_SQL, SCHEMAS_SQL, STREAMS_SQL, schemas, sql, streams


def schema_fields(spark, sf_dir):
    return registry.schema_fields(schemas(spark, sf_dir)).select("stream", "version", "path", "kind", "type", "nullable", "pii")


def schema_rules(spark, sf_dir):
    return registry.schema_rules(registry.schema_fields(schemas(spark, sf_dir)), strict_unions=True)


def pii_paths(spark, sf_dir):
    return registry.pii_paths(registry.schema_fields(schemas(spark, sf_dir)))


def active_schemas(spark, sf_dir):
    return registry.active_schemas(schemas(spark, sf_dir)).select("stream", "version")


def ordered_versions(spark, sf_dir):
    return schemas(spark, sf_dir).select("stream", "version", "deleted").orderBy("stream", "version")


def latest_active_schema(spark, sf_dir):
    return registry.latest_active_schema(schemas(spark, sf_dir)).select("stream", "version")


def next_version(spark, sf_dir):
    known = schemas(spark, sf_dir).where("c_custkey % 6 <> 0")
    return registry.next_version(streams(spark, sf_dir), known)


def duplicate_versions(spark, sf_dir):
    again = schemas(spark, sf_dir).where("c_custkey % 31 = 0 and version = 2")
    return registry.duplicate_versions(schemas(spark, sf_dir).unionByName(again))


def _candidates(all_schemas):
    return registry.latest_active_schema(all_schemas)


def schema_pairs(spark, sf_dir):
    every = schemas(spark, sf_dir)
    return registry.schema_pairs(_candidates(every), every)


def read_faults(spark, sf_dir):
    """What stops the newest schema of a stream from reading older data, and the other way round."""
    every = schemas(spark, sf_dir)
    pairs = registry.schema_pairs(_candidates(every), every)
    both = pairs.select("stream", F.col("candidate").alias("reader"), F.col("existing").alias("writer")).union(
        pairs.select("stream", F.col("existing").alias("reader"), F.col("candidate").alias("writer"))
    )
    return registry.read_faults(registry.schema_fields(every), both)


def compat_report(spark, sf_dir):
    every = schemas(spark, sf_dir)
    return registry.compat_report(_candidates(every), every)


def pii_evolution(spark, sf_dir):
    """Each stream's newest schema judged against its oldest active one."""
    every = schemas(spark, sf_dir)
    oldest = registry.active_schemas(every).groupBy("stream").agg(F.min_by(F.struct("version", "schema_json"), "version").alias("s"))
    return registry.pii_evolution_check(
        registry.schema_fields(registry.latest_active_schema(every)), registry.schema_fields(oldest.select("stream", "s.*"))
    )


def key_path_check(spark, sf_dir):
    latest = registry.schema_fields(registry.latest_active_schema(schemas(spark, sf_dir)))
    return registry.key_path_check(streams(spark, sf_dir).select("stream", "partition_path"), latest)


def deletable_version(spark, sf_dir):
    requests = streams(spark, sf_dir).select(
        "stream",
        F.when(F.col("c_custkey") % 9 == 0, "latest").when(F.col("c_custkey") % 9 == 1, "x1").otherwise((1 + F.col("c_custkey") % 4).cast("string")).alias("version"),
    )
    return registry.deletable_version(schemas(spark, sf_dir), requests).select("stream", "version", "reason")


def decode_by_registry(spark, sf_dir):
    """Records of several streams and versions decoded by the schemas that the registry names for them."""
    records = sql(
        spark, sf_dir,
        "SELECT event_id, event_type AS stream, CAST(1 + event_id % 3 AS INT) AS schema_version, CASE WHEN event_id % 7 = 0 THEN '{{\"id\":\"x\"}}' "
        "ELSE to_json(named_struct('id', event_id, 'user', user_id, 'kind', event_type, 'value', value)) END AS body FROM {events}",
        "events",
    )
    registered = [("click", 1, EVENT_V1), ("click", 2, EVENT_V2), ("view", 1, EVENT_V1), ("view", 2, EVENT_V1), ("purchase", 2, EVENT_V2)]
    decoded = decode_records(records, spark.createDataFrame(registered, "stream string, version int, schema_json string"))
    return decoded.select(
        "event_id", "error", F.get_json_object("payload", "$.id").cast("bigint").alias("id"), F.get_json_object("payload", "$.value").isNotNull().alias("with_value")
    )


def join_writer_schema(spark, sf_dir):
    """Records of many streams met with the schema they were written with, errors told apart."""
    records = sql(
        spark, sf_dir, "SELECT o_orderkey, concat('stream_', o_custkey) AS stream, CAST(1 + o_orderkey % 5 AS INT) AS schema_version FROM {orders}", "orders"
    )
    met = join_schemas(records, schemas(spark, sf_dir).select("stream", "version", "schema_json"))
    return met.select("o_orderkey", "stream", "schema_version", F.col("schema_json").isNotNull().alias("found"), "error")


_LATEST_SQL = """latest AS (SELECT stream, any_value(c_custkey) AS c_custkey, max(version) AS version FROM schemas WHERE NOT deleted GROUP BY stream)"""
_PAIRS_SQL = f"""{_LATEST_SQL},
pairs AS (SELECT s.stream, s.c_custkey, l.version AS candidate, s.version AS existing, s.version = max(s.version) OVER (PARTITION BY s.stream) AS is_latest
  FROM schemas s JOIN latest l ON l.stream = s.stream WHERE NOT s.deleted AND s.version < l.version)"""
# By the rules the schemas are made of: versions below 3 cannot read the ids of later ones, and the extra field
# of version 4 has no default.
_FAULTS_SQL = f"""{SCHEMAS_SQL}, {_PAIRS_SQL},
faults AS (
  SELECT stream, existing AS reader, candidate AS writer, '/id' AS path, 'type' AS fault FROM pairs WHERE existing < 3 AND candidate >= 3
  UNION ALL SELECT stream, candidate, existing, '/extra', 'missing' FROM pairs WHERE candidate = 4 AND c_custkey % 2 = 0)"""

def decode_bad_registry(spark, sf_dir):
    """The registry has a version twice with unlike texts, null versions, a version without a text, and a text that is no
    schema; records of other streams are decoded all the same."""
    records = sql(
        spark, sf_dir,
        """SELECT event_id, event_type AS stream, CAST(1 + event_id % 3 AS INT) AS schema_version,
           to_json(named_struct('id', event_id, 'user', user_id, 'kind', event_type)) AS body FROM {events}""",
        "events",
    )
    registry_rows = [
        ("click", 1, EVENT_V1), ("click", 1, EVENT_V2), ("click", 2, EVENT_V1), ("click", None, EVENT_V1), ("click", 3, None),
        ("view", None, EVENT_V1), ("view", None, EVENT_V2), ("view", 2, "no schema"), ("view", 3, '{"type":"record"}'),
        ("purchase", 1, EVENT_V1), ("purchase", 1, EVENT_V1), ("purchase", 2, EVENT_V1), ("signup", None, None),
    ]
    known = spark.createDataFrame(registry_rows, "stream string, version int, schema_json string")
    decoded = decode_records(records, known)
    return decoded.select("event_id", "error", F.get_json_object("payload", "$.id").cast("bigint").alias("id"))


QUERIES = {
    "decode_by_registry": (
        decode_by_registry,
        """WITH r AS (SELECT event_id, event_type AS s, 1 + event_id % 3 AS v, event_id % 7 = 0 AS odd FROM events),
        j AS (SELECT *, CASE WHEN s NOT IN ('click', 'view', 'purchase') THEN 'unknown stream' WHEN v = 3 OR (s = 'purchase' AND v = 1) THEN 'unknown version'
          WHEN odd THEN 'unreadable' END AS error FROM r)
        SELECT event_id, error, CASE WHEN error IS NULL THEN event_id END AS id, error IS NULL AND v = 2 AND s <> 'view' AS with_value FROM j""",
    ),
    "decode_bad_registry": (
        decode_bad_registry,
        """WITH r AS (SELECT event_id, event_type AS s, 1 + event_id % 3 AS v FROM events),
        j AS (SELECT *, CASE s WHEN 'click' THEN CASE v WHEN 1 THEN 'ambiguous version' WHEN 3 THEN 'unknown version' END
          WHEN 'view' THEN CASE v WHEN 1 THEN 'unknown version' ELSE 'unreadable schema' END
          WHEN 'purchase' THEN CASE v WHEN 3 THEN 'unknown version' END WHEN 'signup' THEN 'unknown version' ELSE 'unknown stream' END AS error FROM r)
        SELECT event_id, error, CASE WHEN error IS NULL THEN event_id END AS id FROM j""",
    ),
    "join_writer_schema": (
        join_writer_schema,
        f"""WITH {SCHEMAS_SQL}, r AS (SELECT o_orderkey, 'stream_' || o_custkey AS stream, CAST(1 + o_orderkey % 5 AS INT) AS schema_version FROM orders)
        SELECT r.*, s.version IS NOT NULL AS found, CASE WHEN r.stream NOT IN (SELECT stream FROM schemas) THEN 'unknown stream' WHEN s.version IS NULL THEN 'unknown version' END AS error
        FROM r LEFT JOIN schemas s ON s.stream = r.stream AND s.version = r.schema_version""",
    ),
    "schema_fields": (schema_fields, f"WITH {FIELDS_SQL} SELECT stream, version, path, kind, type, nullable, pii FROM nodes"),
    "schema_rules": (
        schema_rules,
        f"""WITH {SCHEMAS_SQL}, rules AS (
        SELECT stream, version, 'reserved-name' AS rule, '/Acquisition_Instant' AS path FROM schemas WHERE c_custkey % 19 = 0
        UNION ALL SELECT stream, version, 'pii-not-text', '/age' FROM schemas WHERE c_custkey % 23 = 0
        UNION ALL SELECT stream, version, 'union-bytes-string', '/raw' FROM schemas WHERE c_custkey % 29 = 0
        UNION ALL SELECT stream, version, 'union-not-nullable', '/raw' FROM schemas WHERE c_custkey % 29 = 0)
        SELECT * FROM rules""",
    ),
    "pii_paths": (pii_paths, f"WITH {FIELDS_SQL} SELECT stream, version, path FROM nodes WHERE pii"),
    "active_schemas": (active_schemas, f"WITH {SCHEMAS_SQL} SELECT stream, version FROM schemas WHERE NOT deleted"),
    "ordered_versions": (ordered_versions, f"WITH {SCHEMAS_SQL} SELECT stream, version, deleted FROM schemas ORDER BY stream, version"),
    "latest_active_schema": (latest_active_schema, f"WITH {SCHEMAS_SQL}, {_LATEST_SQL} SELECT stream, version FROM latest"),
    "next_version": (
        next_version,
        f"""WITH {STREAMS_SQL} SELECT stream, CAST(CASE WHEN c_custkey % 6 = 0 THEN 1 ELSE 2 + c_custkey % 4 END AS INT) AS next_version FROM streams""",
    ),
    "duplicate_versions": (
        duplicate_versions,
        f"WITH {SCHEMAS_SQL} SELECT stream, version, CAST(2 AS BIGINT) AS copies FROM schemas WHERE c_custkey % 31 = 0 AND version = 2",
    ),
    "schema_pairs": (schema_pairs, f"WITH {SCHEMAS_SQL}, {_PAIRS_SQL} SELECT stream, candidate, existing, is_latest FROM pairs"),
    "read_faults": (read_faults, f"WITH {_FAULTS_SQL} SELECT stream, reader, writer, path, fault FROM faults"),
    "compat_report": (
        compat_report,
        f"""WITH {_FAULTS_SQL}, judged AS (SELECT l.stream, l.version, p.existing, coalesce(p.is_latest, TRUE) AS is_latest,
          NOT EXISTS (SELECT 1 FROM faults f WHERE f.stream = p.stream AND f.reader = p.candidate AND f.writer = p.existing) AS r,
          NOT EXISTS (SELECT 1 FROM faults f WHERE f.stream = p.stream AND f.reader = p.existing AND f.writer = p.candidate) AS b
          FROM latest l LEFT JOIN pairs p ON p.stream = l.stream),
        m AS (SELECT stream, version, bool_and(r) AS a1, bool_and(r OR NOT is_latest) AS a2, bool_and(b) AS a3, bool_and(b OR NOT is_latest) AS a4,
          bool_and(r AND b) AS a5, bool_and((r AND b) OR NOT is_latest) AS a6 FROM judged GROUP BY ALL)
        SELECT stream, version, mode, ok FROM (
          SELECT stream, version, 'CAN_READ_ALL' AS mode, a1 AS ok FROM m UNION ALL SELECT stream, version, 'CAN_READ_LATEST', a2 FROM m
          UNION ALL SELECT stream, version, 'CAN_BE_READ_BY_ALL', a3 FROM m UNION ALL SELECT stream, version, 'CAN_BE_READ_BY_LATEST', a4 FROM m
          UNION ALL SELECT stream, version, 'MUTUAL_READ_ALL', a5 FROM m UNION ALL SELECT stream, version, 'MUTUAL_READ_LATEST', a6 FROM m)""",
    ),
    "pii_evolution": (
        pii_evolution,
        f"""WITH {SCHEMAS_SQL}, {_LATEST_SQL}, oldest AS (SELECT stream, min(version) AS version FROM schemas WHERE NOT deleted GROUP BY stream)
        SELECT l.stream, l.version, '/note' AS path FROM latest l JOIN oldest o ON o.stream = l.stream WHERE l.c_custkey % 9 = 1 AND l.version >= 3 AND o.version = 2""",
    ),
    "key_path_check": (
        key_path_check,
        f"""WITH {STREAMS_SQL}, {SCHEMAS_SQL}, {_LATEST_SQL}
        SELECT stream, partition_path, '' AS location, 'syntax' AS fault FROM streams WHERE partition_path = 'no path'
        UNION ALL SELECT s.stream, partition_path, '/tags', 'not traversable: array' FROM streams s JOIN latest l ON l.stream = s.stream WHERE partition_path = '$.tags.code'
        UNION ALL SELECT s.stream, partition_path, '/owner', 'no field: missing' FROM streams s JOIN latest l ON l.stream = s.stream WHERE partition_path = '$["owner"]["missing"]'""",
    ),
    "deletable_version": (
        deletable_version,
        f"""WITH {STREAMS_SQL}, {SCHEMAS_SQL}, {_LATEST_SQL}, r AS (SELECT stream, c_custkey, CASE c_custkey % 9 WHEN 0 THEN 'latest' WHEN 1 THEN 'x1' ELSE CAST(1 + c_custkey % 4 AS VARCHAR) END AS version FROM streams)
        SELECT r.stream, r.version, CASE WHEN r.version = 'latest' THEN 'version must be explicit' WHEN r.version = 'x1' THEN 'not a version'
          WHEN l.version IS NULL THEN 'no active schema' WHEN CAST(r.version AS INT) <> l.version THEN 'not the latest version' END AS reason
        FROM r LEFT JOIN latest l ON l.stream = r.stream""",
    ),
}
