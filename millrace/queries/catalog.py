"""Queries over the stream catalog and changes to it."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import catalog, notify
from millrace.operators.catalog import op
from millrace.operators.model import OPERATIONS
from millrace.operators.registry import latest_active_schema, schema_fields
from millrace.plans.catalog import apply_catalog_changes
from millrace.plans.land import acquisition_instant, landing_path
from millrace.queries.inputs import SCHEMAS_SQL, STREAMS_SQL, schemas, streams

NOW = "2024-01-20 00:00:00"
NOW_MS = 1_705_708_800_000


def live_streams(spark, sf_dir):
    return catalog.live_streams(streams(spark, sf_dir))


def deletable_streams(spark, sf_dir):
    return catalog.deletable_streams(streams(spark, sf_dir)).select("stream")


def validate_streams(spark, sf_dir):
    return catalog.validate_streams(streams(spark, sf_dir))


def due_landings(spark, sf_dir):
    due = catalog.due_landings(streams(spark, sf_dir), F.lit(NOW).cast("timestamp"))
    return due.select("stream", F.unix_millis("last_run").alias("last_run_ms"), F.unix_millis("due_at").alias("due_ms"))


def landable_streams(spark, sf_dir):
    known = schemas(spark, sf_dir).where("c_custkey % 6 <> 0")
    return catalog.landable_streams(streams(spark, sf_dir), known).select("stream")


def landing_paths(spark, sf_dir):
    """Where each stream would land at its last run."""
    ran = F.coalesce(F.try_to_timestamp(F.col("last_run")), F.timestamp_seconds(F.lit(0)))
    path = landing_path(F.lit("lake"), F.col("stream"), F.unix_millis(ran) + 1000, acquisition_instant(ran))
    return streams(spark, sf_dir).select("stream", path.alias("path"))


def _models(spark, sf_dir):
    return streams(spark, sf_dir).select(
        "c_custkey", "stream", "deleted",
        F.when(F.col("c_custkey") % 5 != 0, F.concat(F.lit("road."), "stream")).alias("topic_name"),
        F.when(F.col("c_custkey") % 6 == 0, None).when(F.col("c_custkey") % 6 == 1, "COMPACT").otherwise("NORMAL").alias("type"),
        F.when(F.col("c_custkey") % 3 != 0, F.concat(F.lit('{"topicCreated":true,"partitions":'), (F.col("c_custkey") % 4).cast("string"), F.lit("}"))).alias("status"),
    )


def status_drift(spark, sf_dir):
    models = _models(spark, sf_dir)
    topics = models.where("c_custkey % 2 = 0").select(
        F.concat(F.lit("road."), "stream").alias("topic"), F.lit("NORMAL").alias("type"), F.lit('{"topicCreated":true,"partitions":2}').alias("status")
    )
    drift = catalog.status_drift(models, topics)
    return drift.select("document_id", F.array_join(F.transform("operations", lambda o: F.concat_ws(" ", o["op"], o["path"], o["value"])), "; ").alias("patch"))


# Patch requests: one per live stream, of every sort.
_PATCH_REQUESTS = """
SELECT concat('r', c_custkey) AS request_id, CASE WHEN c_custkey % 37 = 0 THEN 'nobody' ELSE stream END AS stream, CASE c_custkey % 16
  WHEN 0 THEN array(struct('replace' AS op, '/description' AS path, '"text"' AS value), struct('add' AS op, '/enabled' AS path, 'true' AS value))
  WHEN 1 THEN array(struct('add' AS op, '/enabled' AS path, 'false' AS value))
  WHEN 2 THEN array(struct('replace' AS op, '/teamName' AS path, '"  "' AS value))
  WHEN 3 THEN array(struct('replace' AS op, '/name' AS path, '"x"' AS value))
  WHEN 4 THEN array(struct('remove' AS op, '/metadata' AS path, CAST(NULL AS STRING) AS value))
  WHEN 5 THEN array(struct('replace' AS op, '/metadata' AS path, '{{"a":"b"}}' AS value))
  WHEN 6 THEN array(struct('replace' AS op, '/partitionPath' AS path, '"$.owner.name"' AS value))
  WHEN 7 THEN array(struct('replace' AS op, '/partitionPath' AS path, '"$.owner.nope"' AS value))
  WHEN 8 THEN array(struct('replace' AS op, '/authorisation/onramp/cidrBlocks' AS path, '["10.0.0.0/8"]' AS value))
  WHEN 9 THEN array(struct('replace' AS op, '/authorisation/onramp/cidrBlocks' AS path, '["10.0.0.0/8","banana"]' AS value))
  WHEN 10 THEN array(struct('replace' AS op, '/authorisation/onramp/authorities' AS path, '[1]' AS value))
  WHEN 11 THEN array(struct('replace' AS op, '/authorisation/offramp/authorities' AS path, '{{"A":["PII"]}}' AS value))
  WHEN 12 THEN array(struct('replace' AS op, '/authorisation/offramp/authorities' AS path, '{{"A":[]}}' AS value))
  WHEN 13 THEN array(struct('replace' AS op, '/enabled' AS path, '"yes"' AS value))
  WHEN 14 THEN array(struct('replace' AS op, '/contactEmail' AS path, '7' AS value))
  ELSE array(struct('add' AS op, '/authorisation/offramp/authorities' AS path, '{{"A":"PII"}}' AS value)) END AS operations
FROM {streams}
"""


def _patch_requests(spark, sf_dir):
    return spark.sql(_PATCH_REQUESTS, streams=streams(spark, sf_dir))


def validate_patches(spark, sf_dir):
    latest = schema_fields(latest_active_schema(schemas(spark, sf_dir)))
    judged = catalog.validate_patches(_patch_requests(spark, sf_dir), streams(spark, sf_dir), latest, F.lit(NOW_MS))
    return judged.select(
        "request_id", "reason",
        F.array_join(F.transform("operations", lambda o: F.concat_ws(" ", o["op"], o["path"])), "; ").alias("patch"),
    )


def patch_rules(spark, sf_dir):
    """Patches judged by rules of one's own: a path more, and another rule for a path that had one."""
    known = streams(spark, sf_dir)
    requests = known.select(
        F.concat(F.lit("r"), F.col("c_custkey").cast("string")).alias("request_id"), "stream",
        F.when(F.col("c_custkey") % 3 == 0, op("add", "/owner", F.lit('"team"')))
        .when(F.col("c_custkey") % 3 == 1, op("add", "/owner", F.lit("5")))
        .otherwise(op("add", "/description", F.lit('"short"'))).alias("o"),
    ).select("request_id", "stream", F.array("o").cast(OPERATIONS).alias("operations"))
    rules = {
        "/owner": lambda o: F.when(F.schema_of_variant(F.try_parse_json(o["value"])) != "STRING", "not a text"),
        "/description": lambda o: F.when(F.length(o["value"]) < 22, "too short"),
    }
    latest = schema_fields(latest_active_schema(schemas(spark, sf_dir)))
    judged = catalog.validate_patches(requests, known, latest, F.lit(NOW_MS), rules=rules)
    return judged.select("request_id", "reason", F.get("operations", F.lit(0))["path"].alias("path"))


def _create_requests(spark, sf_dir):
    return streams(spark, sf_dir).select(
        F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("new_"), F.col("c_custkey").cast("string"))).otherwise(F.col("stream")).alias("stream"),
        F.lit("d").alias("description"), F.lit(None).cast("string").alias("team_name"), F.lit("a@b.c").alias("contact_email"),
        F.when(F.col("c_custkey") % 3 == 0, True).alias("enabled"), "partition_path",
    )


def create_stream(spark, sf_dir):
    judged = catalog.create_streams(_create_requests(spark, sf_dir), streams(spark, sf_dir), F.lit(NOW_MS))
    document = F.col("operations")[0]["value"]
    return judged.select(
        "stream", "reason", F.get_json_object(document, "$.enabled").alias("enabled"),
        F.get_json_object(document, "$.compatibilityMode").alias("mode"), F.get_json_object(document, "$.destinations.hive.landingInterval").alias("landing_interval"),
    )


def _schema_requests(spark, sf_dir):
    """Each stream asks to register the schema its neighbour by two has as newest."""
    newest = latest_active_schema(schemas(spark, sf_dir))
    number = F.regexp_extract("stream", "([0-9]+)$", 1).cast("bigint")
    return newest.select(
        F.concat(F.lit("stream_"), (number + 2).cast("string")).alias("stream"),
        F.when(number % 4 == 0, F.lit(2)).when(number % 4 == 1, F.lit(9)).cast("int").alias("requested"),
        "schema_json",
    )


def register_schema(spark, sf_dir):
    judged = catalog.register_schemas(_schema_requests(spark, sf_dir), streams(spark, sf_dir), schemas(spark, sf_dir), schema_fields)
    return judged.select("stream", "version", "reason", F.col("operations")[0]["path"].alias("path"))


def _destination_requests(spark, sf_dir):
    return streams(spark, sf_dir).select(
        F.concat(F.lit("d"), F.col("c_custkey").cast("string")).alias("request_id"), "stream",
        F.when(F.col("c_custkey") % 3 == 0, "create").when(F.col("c_custkey") % 3 == 1, "update").otherwise("delete").alias("action"),
        F.lit(True).alias("enabled"), "landing_interval",
    )


def destination_changes(spark, sf_dir):
    judged = catalog.destination_changes(_destination_requests(spark, sf_dir), streams(spark, sf_dir))
    return judged.select(
        "request_id", "reason", F.array_join(F.transform("operations", lambda o: F.concat_ws(" ", o["op"], o["path"], o["value"])), "; ").alias("patch")
    )


def delete_stream(spark, sf_dir):
    judged = catalog.delete_streams(streams(spark, sf_dir).where("c_custkey % 2 = 0").select("stream"), streams(spark, sf_dir))
    return judged.select("stream", "reason", F.col("operations")[0]["path"].alias("path"))


def _version_requests(spark, sf_dir):
    """Requests to delete a version of each stream, malformed ones among them."""
    version = F.when(F.col("c_custkey") % 9 == 0, "latest").when(F.col("c_custkey") % 9 == 1, "x1").otherwise((1 + F.col("c_custkey") % 4).cast("string"))
    return streams(spark, sf_dir).select("stream", version.alias("version"))


def flag_deleted_schema(spark, sf_dir):
    judged = catalog.delete_schema_versions(_version_requests(spark, sf_dir), schemas(spark, sf_dir))
    first = F.get("operations", F.lit(0))
    return judged.select("stream", "version", "reason", first["path"].alias("path"), first["value"].alias("value"))


def catalog_changes(spark, sf_dir):
    """Every kind of request at once: accepted and refused, by kind."""
    every, known = streams(spark, sf_dir), schemas(spark, sf_dir)
    requests = {
        "create_stream": _create_requests(spark, sf_dir),
        "register_schema": _schema_requests(spark, sf_dir),
        "delete_schema": _version_requests(spark, sf_dir),
        "destination": _destination_requests(spark, sf_dir),
        "patch": _patch_requests(spark, sf_dir),
        "delete_stream": every.where("c_custkey % 2 = 0").select("stream"),
    }
    patches, rejects = apply_catalog_changes(requests, every, known, F.lit(NOW_MS))
    accepted = patches.groupBy("kind").agg(F.count("*").alias("requests")).withColumn("accepted", F.lit(True))
    refused = rejects.groupBy("kind").agg(F.count("*").alias("requests")).withColumn("accepted", F.lit(False))
    return accepted.unionByName(refused)


def notifications(spark, sf_dir):
    """Notifications about every stream and schema version, with their text."""
    created = notify.stream_created(
        streams(spark, sf_dir).select("stream", F.lit(None).cast("string").alias("description"), F.col("authorities")[0].alias("team_name"), F.lit("a@b.c").alias("contact_email"))
    )
    versions = schemas(spark, sf_dir).select("stream", "version", "deleted")
    return created.union(notify.schema_added(versions)).union(notify.schema_deleted(versions.where("deleted")))


_LATEST_SQL = "latest AS (SELECT stream, max(version) AS version FROM schemas WHERE NOT deleted GROUP BY stream)"
_ACCEPTED_INTERVAL = "coalesce(interval_s BETWEEN 300 AND 86400, FALSE)"
_PATCH_SQL = f"""
asked AS (SELECT s.*, l.version AS latest_version, CASE
  WHEN s.c_custkey % 37 = 0 OR s.deleted THEN 'unknown stream' ELSE CASE s.c_custkey % 16
  WHEN 0 THEN CASE WHEN NOT topic_created THEN 'not ready to be enabled: /enabled' END
  WHEN 2 THEN 'blank: /teamName' WHEN 3 THEN 'not a path to patch: /name' WHEN 4 THEN 'may not be removed: /metadata'
  WHEN 7 THEN CASE WHEN l.version IS NOT NULL THEN 'does not fit the schema: /partitionPath' END
  WHEN 9 THEN 'not CIDR blocks: /authorisation/onramp/cidrBlocks' WHEN 10 THEN 'not strings: /authorisation/onramp/authorities'
  WHEN 12 THEN 'grants are empty or not strings: /authorisation/offramp/authorities'
  WHEN 13 THEN 'not a boolean: /enabled' WHEN 14 THEN 'not a string: /contactEmail' WHEN 15 THEN 'grants are not an array: /authorisation/offramp/authorities' END END AS reason
  FROM streams s LEFT JOIN latest l ON l.stream = s.stream)
"""

# By the rules the schemas are made of: stream t is offered the newest schema of stream n = t - 2.
_REGISTER_SQL = f"""{STREAMS_SQL}, {SCHEMAS_SQL}, newest AS (SELECT c_custkey, max(version) AS v FROM schemas WHERE NOT deleted GROUP BY c_custkey),
offers AS (SELECT o.c_custkey AS n, o.c_custkey + 2 AS t, o.v AS vn, s.stream AS known, s.compatibility_mode AS mode, s.partition_path, e.next_version,
    CASE o.c_custkey % 4 WHEN 0 THEN 2 WHEN 1 THEN 9 ELSE e.next_version END AS version, w.v AS vt
  FROM newest o JOIN (SELECT n.c_custkey, coalesce(max(x.version), 0) + 1 AS next_version FROM newest n LEFT JOIN schemas x ON x.stream = 'stream_' || (n.c_custkey + 2) GROUP BY ALL) e ON e.c_custkey = o.c_custkey
  LEFT JOIN streams s ON s.stream = 'stream_' || (o.c_custkey + 2) AND NOT s.deleted LEFT JOIN newest w ON w.c_custkey = s.c_custkey),
olds AS (SELECT o.n, s.version = o.vt AS is_latest,
    (o.vn < 3 AND s.version >= 3) OR (o.vn = 4 AND o.n % 2 = 0 AND s.version <> 4) AS unread,
    (s.version < 3 AND o.vn >= 3) OR (s.version = 4 AND o.t % 2 = 0 AND NOT (o.vn = 4 AND o.n % 2 = 0)) AS unreadable
  FROM offers o JOIN schemas s ON s.stream = o.known AND NOT s.deleted),
clashes AS (SELECT n, bool_or(unread) AS read_all, bool_or(is_latest AND (unread OR unreadable)) AS mutual_latest FROM olds GROUP BY n),
judged AS (SELECT 'stream_' || t AS stream, CAST(version AS INT) AS version, CASE WHEN known IS NULL THEN 'unknown stream'
    WHEN partition_path = '$.tags.code' THEN 'key path: not traversable: array' WHEN partition_path = '$["owner"]["missing"]' THEN 'key path: no field: missing'
    WHEN partition_path = 'no path' THEN 'key path: syntax'
    WHEN o.n % 23 = 0 THEN 'schema: pii-not-text' WHEN o.n % 19 = 0 THEN 'schema: reserved-name' WHEN o.n % 29 = 0 THEN 'schema: union-bytes-string'
    WHEN coalesce(mode, 'CAN_READ_ALL') = 'CAN_READ_ALL' AND read_all THEN 'compatibility: CAN_READ_ALL'
    WHEN mode = 'MUTUAL_READ_LATEST' AND mutual_latest THEN 'compatibility: MUTUAL_READ_LATEST'
    WHEN o.n % 9 = 1 AND vn >= 3 AND vt >= 2 THEN 'personal data: /note' WHEN o.n % 3 = 0 AND vt IS NOT NULL THEN 'personal data: /owner/name'
    WHEN version < next_version THEN 'version too low' END AS reason
  FROM offers o LEFT JOIN clashes c ON c.n = o.n)
"""

QUERIES = {
    "live_streams": (live_streams, f"WITH {STREAMS_SQL} SELECT stream FROM streams WHERE NOT deleted ORDER BY stream"),
    "deletable_streams": (
        deletable_streams,
        f"WITH {STREAMS_SQL} SELECT stream FROM streams WHERE NOT deleted AND NOT has_destinations AND NOT enabled AND message_count = 0 AND enabled_ms < counted_ms",
    ),
    "validate_streams": (
        validate_streams,
        f"""WITH {STREAMS_SQL} SELECT stream, 'name' AS rule, c_custkey % 17 <> 0 AS ok FROM streams
        UNION ALL SELECT stream, 'landing_interval', landing_interval IS NULL OR {_ACCEPTED_INTERVAL} FROM streams
        UNION ALL SELECT stream, 'read_grants', c_custkey % 9 <> 0 FROM streams UNION ALL SELECT stream, 'cidr_blocks', c_custkey % 10 <> 0 FROM streams""",
    ),
    "due_landings": (
        due_landings,
        f"""WITH {STREAMS_SQL} SELECT stream, epoch_us(last_run_ts) // 1000 AS last_run_ms, epoch_us(last_run_ts) // 1000 + interval_s * 1000 AS due_ms FROM streams
        WHERE hive_enabled AND interval_s IS NOT NULL AND epoch_us(last_run_ts) // 1000 + interval_s * 1000 < {NOW_MS}""",
    ),
    "landable_streams": (
        landable_streams,
        f"""WITH {STREAMS_SQL}, {SCHEMAS_SQL} SELECT stream FROM streams WHERE has_hive AND NOT deleted AND c_custkey % 6 <> 0 AND stream IN (SELECT stream FROM schemas WHERE NOT deleted)""",
    ),
    "landing_paths": (
        landing_paths,
        f"""WITH {STREAMS_SQL} SELECT stream, 'lake/' || stream || '/' || (epoch_us(last_run_ts) // 1000 + 1000) || '/acquisition_instant=' || strftime(last_run_ts, '%Y%m%dT%H%M%SZ') AS path FROM streams""",
    ),
    "status_drift": (
        status_drift,
        f"""WITH {STREAMS_SQL}, seen AS (SELECT *, c_custkey % 2 = 0 AS present FROM streams),
        p AS (SELECT stream, CASE WHEN deleted AND NOT present THEN 'remove ' WHEN deleted THEN NULL ELSE concat_ws('; ',
          CASE WHEN c_custkey % 5 = 0 THEN 'add /topicName "road.' || stream || '"' END,
          CASE WHEN present AND c_custkey % 6 IN (0, 1) THEN 'add /type "NORMAL"' END,
          CASE WHEN present AND (c_custkey % 3 = 0 OR c_custkey % 4 <> 2) THEN 'add /status {{"topicCreated":true,"partitions":2}}' END) END AS patch FROM seen)
        SELECT stream AS document_id, patch FROM p WHERE patch <> ''""",
    ),
    "validate_patches": (
        validate_patches,
        f"""WITH {STREAMS_SQL}, {SCHEMAS_SQL}, {_LATEST_SQL}, {_PATCH_SQL} SELECT 'r' || c_custkey AS request_id, reason, CASE WHEN reason IS NULL THEN CASE c_custkey % 16
          WHEN 0 THEN 'replace /description; replace /enabled; add /enabledTimeStamp' WHEN 1 THEN 'replace /enabled; add /enabledTimeStamp' WHEN 5 THEN 'replace /metadata'
          WHEN 6 THEN 'replace /partitionPath' WHEN 7 THEN 'replace /partitionPath' WHEN 8 THEN 'replace /authorisation/onramp/cidrBlocks' WHEN 11 THEN 'replace /authorisation/offramp/authorities' END END AS patch FROM asked""",
    ),
    "patch_rules": (
        patch_rules,
        f"""WITH {STREAMS_SQL}, a AS (SELECT c_custkey, CASE WHEN deleted THEN 'unknown stream' WHEN c_custkey % 3 = 1 THEN 'not a text: /owner'
          WHEN c_custkey % 3 = 2 THEN 'too short: /description' END AS reason FROM streams)
        SELECT 'r' || c_custkey AS request_id, reason, CASE WHEN reason IS NULL THEN '/owner' END AS path FROM a""",
    ),
    "create_stream": (
        create_stream,
        f"""WITH {STREAMS_SQL}, a AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'new_' || c_custkey ELSE stream END AS stream,
          CASE WHEN c_custkey % 2 = 0 THEN NULL WHEN NOT deleted THEN 'already exists' WHEN c_custkey % 17 = 0 THEN 'invalid name' END AS reason FROM streams)
        SELECT stream, reason, CASE WHEN reason IS NULL THEN CASE WHEN c_custkey % 3 = 0 THEN 'true' ELSE 'false' END END AS enabled,
          CASE WHEN reason IS NULL THEN 'CAN_READ_ALL' END AS mode, CASE WHEN reason IS NULL THEN 'PT1H' END AS landing_interval FROM a""",
    ),
    "register_schema": (
        register_schema,
        f"""WITH {_REGISTER_SQL} SELECT stream, version, reason, CASE WHEN reason IS NULL THEN '/schemas/' || version END AS path FROM judged""",
    ),
    "destination_changes": (
        destination_changes,
        f"""WITH {STREAMS_SQL}, a AS (SELECT *, c_custkey % 3 AS x, '{{"enabled":true,"landingInterval":"' || coalesce(landing_interval, 'PT1H') || '"}}' AS v,
          CASE WHEN deleted THEN 'unknown stream' WHEN c_custkey % 3 = 0 AND has_hive THEN 'already exists' WHEN c_custkey % 3 <> 0 AND NOT has_hive THEN 'unknown destination'
            WHEN c_custkey % 3 <> 2 AND landing_interval IS NOT NULL AND NOT {_ACCEPTED_INTERVAL} THEN 'invalid landing interval' END AS reason FROM streams)
        SELECT 'd' || c_custkey AS request_id, reason, CASE WHEN reason IS NULL THEN CASE x WHEN 2 THEN 'remove /destinations/hive' WHEN 1 THEN 'replace /destinations/hive ' || v
          ELSE CASE WHEN has_destinations_map THEN '' ELSE 'add /destinations {{}}; ' END || 'add /destinations/hive ' || v END END AS patch FROM a""",
    ),
    "delete_stream": (
        delete_stream,
        f"""WITH {STREAMS_SQL}, a AS (SELECT stream, CASE WHEN deleted THEN 'unknown stream' WHEN NOT has_destinations AND NOT enabled AND message_count = 0 AND coalesce(enabled_ms < counted_ms, FALSE) THEN NULL ELSE 'still in use' END AS reason
        FROM streams WHERE c_custkey % 2 = 0) SELECT stream, reason, CASE WHEN reason IS NULL THEN '/deleted' END AS path FROM a""",
    ),
    "flag_deleted_schema": (
        flag_deleted_schema,
        f"""WITH {STREAMS_SQL}, {SCHEMAS_SQL}, {_LATEST_SQL}, r AS (SELECT stream, CASE c_custkey % 9 WHEN 0 THEN 'latest' WHEN 1 THEN 'x1' ELSE CAST(1 + c_custkey % 4 AS VARCHAR) END AS version FROM streams),
        j AS (SELECT r.stream, r.version, CASE WHEN r.version = 'latest' THEN 'version must be explicit' WHEN r.version = 'x1' THEN 'not a version'
          WHEN l.version IS NULL THEN 'no active schema' WHEN CAST(r.version AS INT) <> l.version THEN 'not the latest version' END AS reason FROM r LEFT JOIN latest l ON l.stream = r.stream)
        SELECT stream, version, reason, CASE WHEN reason IS NULL THEN '/schemas/' || version || '/deleted' END AS path, CASE WHEN reason IS NULL THEN 'true' END AS value FROM j""",
    ),
    "notifications": (
        notifications,
        f"""WITH {STREAMS_SQL}, {SCHEMAS_SQL}, n AS (
        SELECT 'ROAD_CREATED' AS type, stream, '{{"protocolVersion":"1.0","type":"ROAD_CREATED","roadName":"' || stream || '","teamName":"' || c_mktsegment || '","contactEmail":"a@b.c"}}' AS message FROM streams
        UNION ALL SELECT 'SCHEMA_VERSION_ADDED', stream, '{{"protocolVersion":"1.0","type":"SCHEMA_VERSION_ADDED","roadName":"' || stream || '","schemaVersion":' || version || '}}' FROM schemas
        UNION ALL SELECT 'SCHEMA_VERSION_DELETED', stream, '{{"protocolVersion":"1.0","type":"SCHEMA_VERSION_DELETED","roadName":"' || stream || '","schemaVersion":' || version || '}}' FROM schemas WHERE deleted)
        SELECT type, stream, '1.0' AS protocol, message, FALSE AS oversized FROM n""",
    ),
}

_KINDS = {
    "create_stream": "create_stream",
    "register_schema": "register_schema",
    "delete_schema": "flag_deleted_schema",
    "destination": "destination_changes",
    "patch": "validate_patches",
    "delete_stream": "delete_stream",
}
QUERIES["catalog_changes"] = (
    catalog_changes,
    "SELECT kind, reason IS NULL AS accepted, count(*) AS requests FROM ("
    + " UNION ALL ".join(f"SELECT '{kind}' AS kind, reason FROM ({QUERIES[name][1]})" for kind, name in _KINDS.items())
    + ") GROUP BY ALL",
)
