"""Queries over messages: admission, framing, decoding, masking, keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import envelope, keypath
from millrace.operators import conform as conform_ops
from millrace.operators import observe
from millrace.operators.mask import mask_pii
from millrace.plans import serve as serve_plan
from millrace.plans.ingest import answer_requests, partition_by_key
from millrace.queries.inputs import EVENT_SCHEMAS, EVENT_V1, EVENT_V2, LOG_SQL, event_log, sql, streams, table
from millrace.sources.log import framed_records

# Bodies made from props, {"k": n}, with every kind of fault by rule on n and the event.
K_SCHEMA = (
    '{"type":"record","name":"m","fields":[{"name":"k","type":"int"},'
    '{"name":"kind","type":{"type":"enum","name":"kind","symbols":["click","view","purchase","signup"]}},'
    '{"name":"tags","type":{"type":"array","items":"string"},"default":[]},'
    '{"name":"note","type":["null","string"],"default":null}]}'
)
BODIES = """
SELECT event_id, user_id, event_type, concat('/roads/stream_', user_id % 5, '/messages') AS uri, CASE event_id % 20
  WHEN 0 THEN concat('{{"kind":"', event_type, '"}}')
  WHEN 1 THEN concat('{{"k":"', event_id, '","kind":"', event_type, '"}}')
  WHEN 2 THEN concat('{{"k":null,"kind":"', event_type, '"}}')
  WHEN 3 THEN concat('{{"k":1.5,"kind":"', event_type, '"}}')
  WHEN 4 THEN concat('{{"k":', event_id, ',"kind":')
  WHEN 5 THEN concat('[', event_id, ']')
  WHEN 6 THEN concat('{{"k":3000000000,"kind":"', event_type, '"}}')
  WHEN 7 THEN concat('{{"k":', event_id, ',"kind":"', event_type, '","tags":["a",1]}}')
  WHEN 8 THEN concat('{{"k":', event_id, ',"kind":"', event_type, '","tags":["a","b"],"note":null,"other":1}}')
  WHEN 9 THEN concat('{{"k":', event_id, ',"kind":"', event_type, '","note":7}}')
  WHEN 10 THEN '{{}}'
  ELSE concat('{{"k":', event_id, ',"kind":"', event_type, '","note":"n', user_id, '"}}') END AS body
FROM {events}
"""
BODIES_SQL = """
judged AS (SELECT event_id, user_id, event_type, '/roads/stream_' || (user_id % 5) || '/messages' AS uri, CASE event_id % 20
  WHEN 0 THEN 'missing:k' WHEN 1 THEN 'type:k' WHEN 2 THEN 'null:k' WHEN 3 THEN 'type:k' WHEN 4 THEN 'unparseable'
  WHEN 5 THEN 'not an object' WHEN 6 THEN 'type:k' WHEN 10 THEN 'missing:k'
  ELSE CASE WHEN event_type = 'error' THEN 'type:kind' WHEN event_id % 20 = 7 THEN 'type:tags' WHEN event_id % 20 = 9 THEN 'type:note' END END AS reason
FROM events)
"""


def _bodies(spark, sf_dir):
    return sql(spark, sf_dir, BODIES, "events")


def _judged(spark, sf_dir):
    return conform_ops.conform(_bodies(spark, sf_dir), K_SCHEMA, version=3)


def conform_accepted(spark, sf_dir):
    return conform_ops.accepted(_judged(spark, sf_dir)).select(
        "event_id", "schema_version", "message.k", "message.kind", F.size("message.tags").alias("tags"), "message.note"
    )


def conform_repeated(spark, sf_dir):
    """Messages that repeat a member: the last one is judged, and kept."""
    bodies = sql(
        spark, sf_dir,
        """SELECT event_id, concat('{{"id":', CASE WHEN event_id % 3 = 0 THEN '"x"' ELSE '0' END, ',"user":', user_id, ',"kind":"', event_type,
        '","id":', CASE WHEN event_id % 5 = 0 THEN '"y"' ELSE CAST(event_id AS STRING) END, '}}') AS body FROM {events}""",
        "events",
    )
    return conform_ops.conform(bodies, EVENT_V1).select("event_id", "reason", "message.id")


def conform_rejects(spark, sf_dir):
    return conform_ops.rejected(_judged(spark, sf_dir)).select("event_id", "reason")


def conform_summary(spark, sf_dir):
    return _judged(spark, sf_dir).groupBy(F.coalesce("reason", F.lit("accepted")).alias("outcome")).agg(F.count("*").alias("messages"))


def responses(spark, sf_dir):
    return conform_ops.responses(_judged(spark, sf_dir), ["event_id"], F.lit(0).cast("bigint"))


def explode_request(spark, sf_dir):
    """Array requests of one to three elements; some are no arrays, some no JSON."""
    requests = sql(
        spark, sf_dir,
        """SELECT event_id, CASE WHEN event_id % 11 = 0 THEN props WHEN event_id % 11 = 1 THEN '[{{"k": '
           ELSE concat('[', props, CASE WHEN event_id % 2 = 0 THEN ', {{"k":7}}' ELSE '' END, ',5]') END AS body FROM {events}""",
        "events",
    )
    return conform_ops.explode_request(requests, ["event_id"]).select("event_id", "pos", "element")


def partial_failure(spark, sf_dir):
    """Positional answers per element of array requests, good and bad ones side by side."""
    requests = sql(
        spark, sf_dir,
        """SELECT event_id, concat('[{{"k":', event_id, ',"kind":"', event_type, '"}},{{"k":"', event_id, '"}},{{"kind":"view"}}]') AS body FROM {events}""",
        "events",
    )
    elements = conform_ops.explode_request(requests, ["event_id"])
    judged = conform_ops.conform(elements, K_SCHEMA, "node", 3, parsed=True)
    return conform_ops.responses(judged, ["event_id", "pos"], F.lit(0).cast("bigint"))


def ingest_answers(spark, sf_dir):
    """Answers to array requests on good, disabled, schemaless and unknown streams."""
    requests = sql(
        spark, sf_dir,
        """SELECT event_id AS request_id, concat('s', user_id % 6) AS stream,
           concat('[{{"k":', event_id, ',"kind":"view"}},{{"id":', event_id, ',"user":1,"kind":"x"}},7]') AS body FROM {events}""",
        "events",
    )
    known = table(spark, sf_dir, "region").select(
        F.concat(F.lit("s"), F.col("r_regionkey").cast("string")).alias("stream"), (F.col("r_regionkey") != 3).alias("enabled"),
        F.when(F.col("r_regionkey") != 4, F.lit(1)).alias("latest_version"),
    )
    schemas = {"s0": (3, K_SCHEMA), "s1": (2, EVENT_V2), "s2": (3, K_SCHEMA)}
    return answer_requests(requests, known, schemas, F.lit(0).cast("bigint")).drop("timestamp_ms")


def framed_log(spark, sf_dir):
    """A binary topic: framed values, some of unknown framing, read back as records."""
    raw = event_log(spark, sf_dir).select(
        "partition", "offset", F.timestamp_millis("ts_ms").alias("timestamp"), F.encode(F.col("user_id").cast("string"), "UTF-8").alias("key"),
        F.when(F.col("offset") % 10 == 3, F.concat(F.unhex(F.lit("07")), F.encode("body", "UTF-8"))).otherwise(
            envelope.add_envelope(F.encode("body", "UTF-8"), F.col("schema_version"))).alias("value"),
    )
    records = framed_records(raw).where("readable")
    return records.select("partition", "offset", "ts_ms", F.col("key").cast("string").alias("key"), "schema_version", F.get_json_object("body", "$.id").cast("bigint").alias("id"))


def error_counters(spark, sf_dir):
    return observe.error_counters(_bodies(spark, sf_dir))


def tagged_counters(spark, sf_dir):
    """Sent, refused and failed messages per stream; every 13th accepted message fails in sending."""
    outcomes = _judged(spark, sf_dir).select(
        F.regexp_extract("uri", "^/roads/([^/]+)/", 1).alias("stream"),
        F.when(F.col("reason").isNotNull(), "validation_failure").when(F.col("event_id") % 13 == 0, "send_failure").otherwise("success").alias("outcome"),
        "body",
    )
    return observe.ingest_counters(outcomes)


def available_filter(spark, sf_dir):
    known = streams(spark, sf_dir).where(~F.col("deleted")).select(
        "stream", "enabled", F.when(F.col("c_custkey") % 5 != 0, F.col("c_custkey")).alias("latest_version")
    )
    requests = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("stream_"), F.col("o_custkey").cast("string")).alias("stream"))
    return conform_ops.available_requests(requests, known).groupBy(F.coalesce("refusal", F.lit("available")).alias("refusal")).agg(F.count("*").alias("requests"))


_FRAMED = """
SELECT event_id, CASE WHEN event_id % 50 = 0 THEN unhex('00') WHEN event_id % 7 = 0
    THEN concat(unhex('01'), unhex(lpad(hex(CAST(event_id AS INT)), 8, '0')), encode(props, 'UTF-8'))
    ELSE concat(unhex('00'), unhex(lpad(hex(CAST(event_id AS INT)), 8, '0')), encode(props, 'UTF-8')) END AS value
FROM {events}
"""


def split_envelope(spark, sf_dir):
    framed = sql(spark, sf_dir, _FRAMED, "events").withColumn("e", envelope.split_envelope(F.col("value")))
    return framed.select(
        "event_id", "e.format_version", "e.schema_version", F.col("e.body").cast("string").alias("body"),
        F.coalesce(F.col("e.format_version") == envelope.MAGIC, F.lit(False)).alias("readable"),
    )


def add_envelope(spark, sf_dir):
    framed = envelope.add_envelope(F.encode("props", "UTF-8"), F.col("user_id"))
    return table(spark, sf_dir, "events").select("event_id", F.hex(framed).alias("framed"))


def decode_by_version(spark, sf_dir):
    decoded = serve_plan.decode_by_version(event_log(spark, sf_dir), EVENT_SCHEMAS)
    return decoded.select(
        "partition", "offset", "schema_version",
        F.coalesce("decoded.v1.id", "decoded.v2.id").alias("id"),
        F.coalesce("decoded.v1.kind", "decoded.v2.kind").alias("kind"),
        F.col("decoded.v2.value").alias("value"), F.col("decoded.v2.props.k").alias("k"),
    )


def read_as_latest(spark, sf_dir):
    read = serve_plan.read_as_latest(event_log(spark, sf_dir), EVENT_V2)
    return read.select("partition", "offset", "message.id", "message.kind", "message.value", F.col("message.props.k").alias("k"))


def _served(spark, sf_dir, grants):
    served = serve_plan.serve(event_log(spark, sf_dir), EVENT_SCHEMAS, grants)
    return served.select(
        "partition", "offset", "schema", "timestampMs",
        F.get_json_object("payload", "$.kind").alias("kind"), F.get_json_object("payload", "$.id").cast("bigint").alias("id"),
        F.get_json_object("payload", "$.props.k").cast("int").alias("k"),
    )


def serve_masked(spark, sf_dir):
    return _served(spark, sf_dir, set())


# A reader's own view of an event, without the mark on its personal field.
SEEN = '{"type":"record","name":"seen","fields":[{"name":"id","type":"long"},{"name":"value","type":"double","default":-1.0},{"name":"kind","type":"string"}]}'


def serve_as_reader(spark, sf_dir):
    """The log served by a schema of the reader's choice; marks stay."""
    rows = serve_plan.serve(event_log(spark, sf_dir), EVENT_SCHEMAS, reader_schema=SEEN)
    seen = F.from_json("payload", "id bigint, value double, kind string")
    return rows.select("partition", "offset", seen.alias("s")).select("partition", "offset", "s.*")


def serve_granted(spark, sf_dir):
    return _served(spark, sf_dir, {"PII"})


def event_summary(spark, sf_dir):
    """Events judged by their schema, placed, decoded as the newest version, masked and counted."""
    read = mask_pii(serve_plan.read_as_latest(event_log(spark, sf_dir), EVENT_V2))
    return read.groupBy("schema_version", "event_type").agg(
        F.count("*").alias("messages"),
        F.count_if(F.col("message.kind") == "").alias("masked"),
        F.round(F.sum("message.value"), 4).alias("value"),
        F.countDistinct("partition").alias("partitions"),
    )


_PERSON_SCHEMA = (
    '{"type":"record","name":"p","fields":[{"name":"key","type":"long"},'
    '{"name":"owner","type":["null",{"type":"record","name":"o","fields":[{"name":"name","type":"string","sensitivity":"PII"},{"name":"segment","type":"string"}]}]},'
    '{"name":"cards","type":{"type":"array","items":{"type":"record","name":"c","fields":[{"name":"number","type":["null","string"],"sensitivity":"PII"},{"name":"kind","type":"string"}]}}},'
    '{"name":"attrs","type":{"type":"map","values":{"type":"record","name":"a","fields":[{"name":"secret","type":"bytes","sensitivity":"PII"}]}}}]}'
)


def mask_nested(spark, sf_dir):
    """Personal data in records, arrays, maps and bytes; null and absent parents stay as they are."""
    bodies = sql(
        spark, sf_dir,
        """SELECT c_custkey, concat('{{"key":', c_custkey, ',"owner":', CASE WHEN c_custkey % 10 = 0 THEN 'null' ELSE concat('{{"name":"', c_name, '","segment":"', c_mktsegment, '"}}') END,
           ',"cards":[{{"number":"', c_custkey, '","kind":"x"}},{{"number":null,"kind":"y"}}],"attrs":{{"a":{{"secret":"s', c_custkey, '"}}}}}}') AS body FROM {customer}""",
        "customer",
    )
    typed = serve_plan.read_as_latest(bodies, _PERSON_SCHEMA)
    return mask_pii(typed).select(
        "c_custkey",
        F.col("message.owner").isNull().alias("no_owner"),
        F.col("message.owner.name").alias("name"),
        F.col("message.owner.segment").alias("segment"),
        F.col("message.cards")[0]["number"].alias("card_0"),
        F.col("message.cards")[1]["number"].alias("card_1"),
        F.col("message.cards")[1]["kind"].alias("kind_1"),
        F.octet_length(F.col("message.attrs")["a"]["secret"]).alias("secret_bytes"),
    )


def mask_with_replacer(spark, sf_dir):
    """A replacer of the caller's: keep the first letter, hash the rest."""
    log = event_log(spark, sf_dir)
    read = serve_plan.read_as_latest(log, EVENT_V2)
    masked = mask_pii(read, replacer=lambda c: F.concat(F.substring(c, 1, 1), F.lit("-"), F.substring(F.md5(c), 1, 8)))
    return masked.select("event_id", "message.kind")


def key_nodes(spark, sf_dir):
    """The key node of each message: a value, an object, an explicit null or nothing."""
    bodies = sql(
        spark, sf_dir,
        """SELECT event_id, CASE event_id % 5 WHEN 0 THEN '{{"a":{{"b.c":null}}}}' WHEN 1 THEN '{{"a":5}}' WHEN 2 THEN concat('{{"a":{{"b.c":{{"d":', user_id, '}}}}}}')
           ELSE concat('{{"a":{{"b.c":', user_id, '}}}}') END AS body FROM {events}""",
        "events",
    )
    node = keypath.key_node(F.try_parse_json("body"), '$.a["b.c"]')
    return bodies.select(
        "event_id",
        F.when(node.isNull(), "missing").when(F.is_variant_null(node), "null").otherwise("value").alias("state"),
        F.when(~F.is_variant_null(node), F.to_json(node)).alias("key"),
    )


def partition_by_key_query(spark, sf_dir):
    bodies = table(spark, sf_dir, "events").select("event_id", "user_id", F.to_json(F.struct(F.col("user_id").alias("u"))).alias("body"))
    return partition_by_key(bodies, "$.u", 6, hashing=keypath.md5_hash).select("event_id", "partition")


QUERIES = {
    "event_summary": (
        event_summary,
        """SELECT CASE WHEN event_type IN ('error', 'signup') THEN 1 ELSE 2 END AS schema_version, event_type, count(*) AS messages, count(*) AS masked,
        round(sum(CASE WHEN event_type IN ('error', 'signup') THEN 0.0 ELSE value END), 4) AS value, count(DISTINCT user_id % 6) AS partitions FROM events GROUP BY event_type""",
    ),
    "conform_accepted": (
        conform_accepted,
        f"""WITH {BODIES_SQL} SELECT event_id, CAST(3 AS INT) AS schema_version, CAST(event_id AS INT) AS k, event_type AS kind,
        CAST(CASE WHEN event_id % 20 = 8 THEN 2 ELSE 0 END AS INT) AS tags, CASE WHEN event_id % 20 > 10 THEN 'n' || user_id END AS note FROM judged WHERE reason IS NULL""",
    ),
    "conform_repeated": (
        conform_repeated,
        "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'type:id' END AS reason, CASE WHEN event_id % 5 <> 0 THEN event_id END AS id FROM events",
    ),
    "conform_rejects": (conform_rejects, f"WITH {BODIES_SQL} SELECT event_id, reason FROM judged WHERE reason IS NOT NULL"),
    "conform_summary": (conform_summary, f"WITH {BODIES_SQL} SELECT coalesce(reason, 'accepted') AS outcome, count(*) AS messages FROM judged GROUP BY 1"),
    "responses": (
        responses,
        f"""WITH {BODIES_SQL} SELECT event_id, CAST(0 AS BIGINT) AS timestamp_ms, reason IS NULL AS success, coalesce(reason, 'Message accepted.') AS answer FROM judged""",
    ),
    "explode_request": (
        explode_request,
        """SELECT event_id, CASE WHEN event_id % 11 > 1 THEN CAST(p AS INT) END AS pos,
        CASE WHEN event_id % 11 <= 1 THEN NULL WHEN p = 0 THEN replace(props, ' ', '') WHEN p = 1 AND event_id % 2 = 0 THEN '{"k":7}' ELSE '5' END AS element
        FROM events, (VALUES (0), (1), (2)) v(p) WHERE p = 0 OR (event_id % 11 > 1 AND p <= 1 + CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END)""",
    ),
    "partial_failure": (
        partial_failure,
        """SELECT event_id, CAST(p AS INT) AS pos, CAST(0 AS BIGINT) AS timestamp_ms, p = 0 AND event_type <> 'error' AS success,
        CASE p WHEN 0 THEN CASE WHEN event_type = 'error' THEN 'type:kind' ELSE 'Message accepted.' END WHEN 1 THEN 'type:k' ELSE 'missing:k' END AS answer
        FROM events, (VALUES (0), (1), (2)) v(p)""",
    ),
    "ingest_answers": (
        ingest_answers,
        """SELECT event_id AS request_id, 's' || s AS stream, CAST(p AS INT) AS pos, p = CASE s WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 0 ELSE 9 END AS success,
        CASE s WHEN 3 THEN 'disabled' WHEN 4 THEN 'no schema' WHEN 5 THEN 'unknown stream' ELSE
          CASE WHEN p = 2 THEN 'not an object' WHEN p = CASE s WHEN 1 THEN 1 ELSE 0 END THEN 'Message accepted.' WHEN s = 1 THEN 'missing:id' ELSE 'missing:k' END END AS answer
        FROM (SELECT event_id, user_id % 6 AS s FROM events), (VALUES (0), (1), (2)) v(p)""",
    ),
    "framed_log": (
        framed_log,
        f"""WITH {LOG_SQL} SELECT partition, "offset", ts_ms, CAST(user_id AS VARCHAR) AS key, CAST(schema_version AS INT) AS schema_version, event_id AS id FROM log WHERE "offset" % 10 <> 3""",
    ),
    "error_counters": (error_counters, f"WITH {BODIES_SQL} SELECT uri, count(*) AS unreadable FROM judged WHERE reason = 'unparseable' GROUP BY uri"),
    "tagged_counters": (
        tagged_counters,
        f"""WITH {BODIES_SQL}, o AS (SELECT 'stream_' || (user_id % 5) AS stream, CASE WHEN reason IS NOT NULL THEN 'v' WHEN event_id % 13 = 0 THEN 'f' ELSE 's' END AS outcome,
          CASE WHEN event_id % 20 = 8 THEN length('{{"k":' || event_id || ',"kind":"' || event_type || '","tags":["a","b"],"note":null,"other":1}}')
               ELSE length('{{"k":' || event_id || ',"kind":"' || event_type || '","note":"n' || user_id || '"}}') END AS bytes FROM judged)
        SELECT stream, count(*) FILTER (outcome = 's') AS send_success, count(*) FILTER (outcome = 'v') AS validation_failures, count(*) FILTER (outcome = 'f') AS send_failures,
          CAST(coalesce(sum(bytes) FILTER (outcome = 's'), 0) AS BIGINT) AS bytes FROM o GROUP BY stream""",
    ),
    "available_filter": (
        available_filter,
        """SELECT CASE WHEN c_custkey IS NULL OR c_custkey % 13 = 0 OR c_custkey % 17 = 0 THEN 'unknown stream' WHEN c_acctbal <= 0 THEN 'disabled'
          WHEN c_custkey % 5 = 0 THEN 'no schema' ELSE 'available' END AS refusal, count(*) AS requests
        FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1""",
    ),
    "split_envelope": (
        split_envelope,
        """SELECT event_id, CASE WHEN event_id % 50 = 0 THEN NULL WHEN event_id % 7 = 0 THEN 1 ELSE 0 END::INT AS format_version,
        CASE WHEN event_id % 50 <> 0 THEN event_id END::INT AS schema_version, CASE WHEN event_id % 50 <> 0 THEN props END AS body,
        event_id % 50 <> 0 AND event_id % 7 <> 0 AS readable FROM events""",
    ),
    "add_envelope": (
        add_envelope,
        "SELECT event_id, '00' || lpad(upper(to_hex(user_id)), 8, '0') || upper(hex(encode(props))) AS framed FROM events",
    ),
    "decode_by_version": (
        decode_by_version,
        f"""WITH {LOG_SQL} SELECT partition, "offset", schema_version, event_id AS id, event_type AS kind, CASE WHEN schema_version = 2 THEN value END AS value,
        CASE WHEN schema_version = 2 THEN CAST(json_extract(props, '$.k') AS INT) END AS k FROM log""",
    ),
    "read_as_latest": (
        read_as_latest,
        f"""WITH {LOG_SQL} SELECT partition, "offset", event_id AS id, event_type AS kind, CASE WHEN schema_version = 2 THEN value ELSE 0.0 END AS value,
        CASE WHEN schema_version = 2 THEN CAST(json_extract(props, '$.k') AS INT) END AS k FROM log""",
    ),
    "serve_masked": (
        serve_masked,
        f"""WITH {LOG_SQL} SELECT partition, "offset", schema_version AS schema, ts_ms AS "timestampMs", '' AS kind, event_id AS id,
        CASE WHEN schema_version = 2 THEN CAST(json_extract(props, '$.k') AS INT) END AS k FROM log""",
    ),
    "serve_as_reader": (
        serve_as_reader,
        f"""WITH {LOG_SQL} SELECT partition, "offset", event_id AS id, CASE WHEN schema_version = 2 THEN value ELSE -1.0 END AS value, '' AS kind FROM log""",
    ),
    "serve_granted": (
        serve_granted,
        f"""WITH {LOG_SQL} SELECT partition, "offset", schema_version AS schema, ts_ms AS "timestampMs", event_type AS kind, event_id AS id,
        CASE WHEN schema_version = 2 THEN CAST(json_extract(props, '$.k') AS INT) END AS k FROM log""",
    ),
    "mask_nested": (
        mask_nested,
        """SELECT c_custkey, c_custkey % 10 = 0 AS no_owner, CASE WHEN c_custkey % 10 <> 0 THEN '' END AS name, CASE WHEN c_custkey % 10 <> 0 THEN c_mktsegment END AS segment,
        '' AS card_0, CAST(NULL AS VARCHAR) AS card_1, 'y' AS kind_1, CAST(0 AS INT) AS secret_bytes FROM customer""",
    ),
    "mask_with_replacer": (
        mask_with_replacer,
        "SELECT event_id, substr(event_type, 1, 1) || '-' || substr(md5(event_type), 1, 8) AS kind FROM events",
    ),
    "key_nodes": (
        key_nodes,
        """SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'null' WHEN 1 THEN 'missing' ELSE 'value' END AS state,
        CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN '{"d":' || user_id || '}' ELSE CAST(user_id AS VARCHAR) END AS key FROM events""",
    ),
    "partition_by_key": (
        partition_by_key_query,
        "SELECT event_id, CAST(CAST('0x' || substr(md5(CAST(user_id AS VARCHAR)), 1, 8) AS BIGINT) % 6 AS INT) AS partition FROM events",
    ),
}
