"""Streaming queries, drained over the events table and read back."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from millrace.operators import model
from millrace.functions.keypath import md5_hash
from millrace.operators.delivery import probe_group
from millrace.queries.inputs import EVENT_SCHEMAS, LOG_SQL, PROBE_GROUPS, PROBE_SQL, RECEIVED, SENT, event_log, event_log_path, table
from millrace.queries.log import NOW_MS
from millrace.queries.model import BAD_PATCHES, BAD_PATCHES_SQL, KEYED_SQL, PATCHES, PATCHES_SQL, keyed_log, members_of
from millrace.session import fresh_path
from millrace.sources.log import log_stream
from millrace.streaming import compaction, gauges, jobs, state

RETENTION_MS = 10 * 24 * 3600 * 1000

# Admits only messages that carry a value.
STRICT_EVENT = (
    '{"type":"record","name":"event","fields":[{"name":"id","type":"long"},{"name":"user","type":"long"},{"name":"value","type":"double"}]}'
)


def _events(spark, sf_dir):
    """The events table as a stream."""
    return log_stream(spark, sf_dir, table(spark, sf_dir, "events").schema, pathGlobFilter="events.parquet")


def _drained(spark, df, name):
    return jobs.drain(df, fresh_path(spark, name), fresh_path(spark, f"{name}-checkpoint"))


def commit_stream(spark, sf_dir):
    """Committable positions per day; a day closes once the log is an hour past it."""
    log = log_stream(spark, event_log_path(spark, sf_dir), event_log(spark, sf_dir).schema).withColumn("ts", F.timestamp_millis("ts_ms"))
    closed = _drained(spark, jobs.commit_stream(log, "ts", "1 day", "1 hour"), "commit-stream")
    return closed.select(F.unix_millis("window_start").alias("window_ms"), "partition", "next_offset")


def ingest_stream(spark, sf_dir):
    """The log's messages admitted again, in several micro-batches, to a log of four partitions by user."""
    messages = log_stream(spark, event_log_path(spark, sf_dir), event_log(spark, sf_dir).schema, max_files=4).drop("partition", "offset", "schema_version")
    target, rejects = fresh_path(spark, "ingested"), fresh_path(spark, "rejects")
    jobs.ingest_stream(
        messages, schema_json=STRICT_EVENT, version=1, log=target, rejects=rejects, checkpoint=fresh_path(spark, "ingest-checkpoint"),
        order=["ts_ms", "event_id"], key_path="$.user", partitions=4, hashing=md5_hash,
    ).awaitTermination()
    stored = spark.read.parquet(target)
    refused = spark.read.parquet(rejects).groupBy("reason").agg(F.count("*").alias("records"))
    placed = stored.groupBy("partition").agg(
        F.count("*").alias("records"), F.countDistinct("offset").alias("offsets"), F.max("offset").alias("last_offset")
    )
    return placed.select(F.col("partition").cast("string").alias("part"), "records", "offsets", "last_offset").unionByName(
        refused.select(F.col("reason").alias("part"), "records"), allowMissingColumns=True
    )


def serve_stream(spark, sf_dir):
    """The log served to a consumer without grants, as a stream."""
    log = log_stream(spark, event_log_path(spark, sf_dir), event_log(spark, sf_dir).schema)
    served = _drained(spark, jobs.serve_stream(log, EVENT_SCHEMAS), "serve-stream")
    return served.select("partition", "offset", "schema", F.get_json_object("payload", "$.kind").alias("kind"), F.get_json_object("payload", "$.id").cast("bigint").alias("id"))


def dedup_stream(spark, sf_dir):
    """Receipts of probe messages with copies dropped."""
    received = spark.sql(RECEIVED, events=_events(spark, sf_dir)).withColumn("at", F.timestamp_millis("recv_ms"))
    return _drained(spark, jobs.first_receipts_stream(received, "at", "60 seconds").select("origin", "seq"), "dedup-stream")


def correlate_stream(spark, sf_dir):
    """Probe messages and their receipts inside their lifetime, copies, lost and late ones included. A message far in
    the future on either side closes all lifetimes before it."""
    last = _events(spark, sf_dir).where("event_id = 0").selectExpr("'last'", "CAST(-1 AS BIGINT)", "timestamp_millis(10000000000000)")
    sent = spark.sql(SENT, events=_events(spark, sf_dir)).select("origin", "seq", F.timestamp_millis("sent_ms").alias("sent_at")).union(last)
    received = spark.sql(RECEIVED, events=_events(spark, sf_dir)).select("origin", "seq", F.timestamp_millis("recv_ms").alias("recv_at")).union(last)
    met = _drained(spark, jobs.correlate_stream(sent, received, "60 seconds"), "correlate-stream").where("seq >= 0")
    return met.select("origin", "seq", F.unix_millis("recv_at").alias("recv_ms"))


def model_state_stream(spark, sf_dir):
    """Documents as the stateful fold leaves them."""
    patches = spark.sql(PATCHES, events=_events(spark, sf_dir))
    states = _drained(spark, state.model_state_stream(patches), "model-stream")
    last = states.groupBy("document_id").agg(F.max_by(F.struct("document"), "seq").alias("s")).select("document_id", "s.document")
    return members_of(last.where("document is not null"))


def fold_bad_patches_stream(spark, sf_dir):
    """The same as the batch fold makes of sets that can't be applied."""
    states = _drained(spark, state.model_state_stream(spark.sql(BAD_PATCHES, events=_events(spark, sf_dir))), "bad-model-stream")
    last = states.groupBy("document_id").agg(F.max_by(F.struct("document"), "seq").alias("s")).select("document_id", "s.document")
    return members_of(last.where("document is not null"))


def change_stream(spark, sf_dir):
    """Change events of a keyed log."""
    log = _events(spark, sf_dir).select(
        F.col("user_id").alias("key"), F.col("event_id").alias("offset"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("value")
    )
    return _drained(spark, state.change_stream(log), "change-stream")


def delivery_state_stream(spark, sf_dir):
    """End state of every probe message whose lifetime has passed."""
    probe = """
      SELECT concat('origin-', event_id % 2) AS origin, event_id AS seq, inline(array_compact(array(
        named_struct('kind', 'sent', 'step', 0, 'state', CAST(NULL AS STRING), 'checksum', crc32(props), 'at_ms', (event_id + 1) * 1000),
        named_struct('kind', 'response', 'step', 1, 'state', CASE event_type WHEN 'error' THEN 'SEND_FAILURE' WHEN 'signup' THEN 'SEND_REJECTED' ELSE 'SEND_SUCCESS' END,
                     'checksum', crc32(props), 'at_ms', (event_id + 1) * 1000),
        CASE WHEN event_id % 10 <> 0 AND (event_type IN ('click', 'view', 'purchase') OR (event_type = 'error' AND event_id % 4 = 0)) THEN
          named_struct('kind', 'received', 'step', 2, 'state', CAST(NULL AS STRING), 'checksum', crc32(CASE WHEN event_id % 8 = 0 THEN concat(props, '!') ELSE props END),
                       'at_ms', (event_id + 1) * 1000 + (user_id * 37 + event_id * 11) % 700 * 100) END,
        CASE WHEN event_id % 9 = 0 AND event_id % 10 <> 0 AND (event_type IN ('click', 'view', 'purchase') OR (event_type = 'error' AND event_id % 4 = 0)) THEN
          named_struct('kind', 'received', 'step', 2, 'state', CAST(NULL AS STRING), 'checksum', crc32(CASE WHEN event_id % 8 = 0 THEN concat(props, '!') ELSE props END),
                       'at_ms', (event_id + 1) * 1000 + (user_id * 37 + event_id * 11) % 700 * 100 + 500) END)))
      FROM {events}"""
    events = (
        spark.sql(probe, events=_events(spark, sf_dir))
        .withColumn("group", probe_group(F.col("seq"), PROBE_GROUPS))
        .withColumn("at", F.timestamp_millis("at_ms"))
    )
    states = _drained(spark, state.delivery_state_stream(events), "delivery-stream")
    return states.select("origin", "seq", "group", "transit_ms", "state")


def inspection(spark, sf_dir):
    """Two agents look at all documents and ask for patches, which are folded into the documents."""
    documents = model.fold_patches(spark.sql(PATCHES, events=table(spark, sf_dir, "events")))
    path = fresh_path(spark, "agent-patches")

    def mark(found):
        seen = model.single_operation("add", F.lit("/seen"), F.lit("true"))
        return found.select("document_id", seen.alias("operations"))

    def tidy(found):
        wanted = found.where(F.get_json_object("document", "$.click").isNotNull())
        return wanted.select("document_id", model.single_operation("remove", F.lit("/click"), F.lit(None).cast("string")).alias("operations"))

    jobs.inspect_models(spark, documents, [mark, tidy], path, 1)
    base = documents.select("document_id", F.lit(0).cast("bigint").alias("seq"), model.single_operation("add", F.lit(""), F.col("document")).alias("operations"))
    return members_of(model.fold_patches(base.unionByName(model.read_patches(spark.read.parquet(path)))))


def agent_stream(spark, sf_dir):
    """An agent called on each change of a keyed log; updates that change nothing are not shown to it."""
    log = _events(spark, sf_dir).select(
        F.col("user_id").alias("key"), F.col("event_id").alias("offset"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("value")
    )
    return _asked(spark, log, None, [0])


def _asked(spark, log, loaded, steps):
    """What an agent that notes every change asks for, counted, once the stream has run after each step."""
    path, checkpoint = fresh_path(spark, "agent-stream"), fresh_path(spark, "agent-checkpoint")

    def note(changes):
        return changes.select(
            F.col("key").cast("string").alias("document_id"), model.single_operation("add", F.lit("/last"), F.to_json(F.array("change"))).alias("operations")
        )

    with jobs.state_partitions(spark):
        for _ in steps:
            jobs.agent_stream(state.change_stream(log), [note], path, checkpoint, loaded).awaitTermination()
    asked = model.read_patches(spark.read.parquet(f"{path}/*/*"))
    return asked.groupBy("document_id", F.col("operations")[0]["value"].alias("asked")).agg(F.count("*").alias("patches"))


def agent_stream_muted(spark, sf_dir):
    """A log that grows in three steps; the agent starts after the first one, and sees the changes of the others."""
    events = table(spark, sf_dir, "events")
    many = events.count()
    rows = events.selectExpr("user_id AS key", "event_id AS offset", "CASE WHEN event_type <> 'error' THEN event_type END AS value")
    path = fresh_path(spark, "growing")

    def grow():
        for step in range(3):
            rows.where(f"offset * 3 >= {step * many} AND offset * 3 < {(step + 1) * many}").write.mode("append").parquet(path)
            yield step

    steps = grow()
    next(steps)  # what exists before the agent starts
    return _asked(spark, log_stream(spark, path, rows.schema), -(-many // 3), itertools.chain([0], steps))


def _in_steps(spark, rows, order, name, run, steps=2):
    """Rows arrive in steps, by ``order``, a number from 0 on; after each one ``run(stream, step)`` drains the stream."""
    path, many = fresh_path(spark, name), rows.agg(F.max(order)).first()[0] + 1
    for step in range(steps):
        rows.where(f"{order} * {steps} >= {step * many} AND {order} * {steps} < {(step + 1) * many}").write.mode("append").parquet(path)
        run(log_stream(spark, path, rows.schema), step)


# Streams of the region table: 3 is disabled, 4 has no schema at all.
K_ONLY = '{"type":"record","name":"m","fields":[{"name":"k","type":"int"}]}'
KIND_ONLY = '{"type":"record","name":"m","fields":[{"name":"kind","type":"string"}]}'


def _growing_registry(spark):
    """A registry of files: what it lists at first, and what is registered between the steps."""
    path = fresh_path(spark, "registry")
    shape = "stream string, version int, schema_json string, deleted boolean"
    lists = [
        [("s0", 1, K_ONLY, False), ("s1", 1, KIND_ONLY, False), ("s1", 2, K_ONLY, True)],
        [("s0", 2, KIND_ONLY, False), ("s2", 1, K_ONLY, False)],
    ]

    def register(step):
        spark.createDataFrame(lists[step], shape).write.mode("append").parquet(path)

    return register, lambda session: session.read.schema(shape).parquet(path)


def ingest_many_stream(spark, sf_dir):
    """Requests of six streams by one query; a newer schema of one stream, and the first one of another, are registered
    between two micro-batches."""
    requests = table(spark, sf_dir, "events").selectExpr(
        "event_id AS request_id", "concat('s', user_id % 6) AS stream",
        """CASE WHEN event_id % 10 = 7 THEN '{"k":1}' ELSE concat('[{"k":', event_id, '},{"kind":"', event_type, '"},7]') END AS body""",
    )
    regions = table(spark, sf_dir, "region")
    catalog = regions.selectExpr("concat('s', r_regionkey) AS stream", "r_regionkey <> 3 AS enabled", "CASE WHEN r_regionkey <> 1 THEN '$.k' END AS partition_path")
    register, listed = _growing_registry(spark)
    folders = {name: fresh_path(spark, f"many-{name}") for name in ("log", "answers", "checkpoint")}

    def run(requests, step):
        register(step)
        jobs.ingest_many_stream(requests, catalog=lambda _: catalog, schemas=listed, partitions=4, **folders).awaitTermination()

    _in_steps(spark, requests, "request_id", "requests", run)
    answers = spark.read.parquet(folders["answers"])
    logged = spark.read.parquet(folders["log"])
    places = logged.groupBy("stream", "partition").agg(F.count("*").alias("n"), F.max("offset").alias("last"), F.countDistinct("offset").alias("places"))
    dense = places.groupBy("stream").agg(F.sum("n").alias("logged"), F.min(F.expr("n = places AND n = last + 1")).alias("dense"))
    told = answers.select("request_id", "stream", "pos", "success", "answer", "schema_version")
    return told.join(dense, "stream", "left")


def decode_stream(spark, sf_dir):
    """A log of several streams followed and decoded; the schemas of one are registered between two micro-batches."""
    records = table(spark, sf_dir, "events").selectExpr(
        "event_id", "concat('s', user_id % 4) AS stream", "CAST(1 + event_id % 2 AS INT) AS schema_version",
        """concat('{"k":', event_id, CASE WHEN event_id % 5 = 0 THEN '' ELSE concat(',"kind":"', event_type, '"') END, '}') AS body""",
    )
    register, listed = _growing_registry(spark)
    path, checkpoint = fresh_path(spark, "decoded"), fresh_path(spark, "decoded-checkpoint")

    def run(records, step):
        register(step)
        jobs.decode_stream(records, schemas=listed, path=path, checkpoint=checkpoint).awaitTermination()

    _in_steps(spark, records, "event_id", "records", run)
    return spark.read.parquet(path).select("event_id", "stream", "error", "payload")


def compact_stream(spark, sf_dir):
    """The keyed log followed in three micro-batches and kept compacted, ten days back from its newest record."""
    log = keyed_log(spark, sf_dir)
    path, checkpoint = fresh_path(spark, "compacted"), fresh_path(spark, "compacted-checkpoint")

    def run(records, step):
        compaction.compact_stream(
            records, path=path, key="key", value="value", ts="ts_ms", retention=RETENTION_MS, checkpoint=checkpoint
        ).awaitTermination()

    _in_steps(spark, log, "offset", "keyed", run, 3)
    return compaction.compacted(spark, path, log.schema, "key", "value", "ts_ms")


def latency_sketch_stream(spark, sf_dir):
    """Latencies per kind, sketched by closed day as a stream and merged over the days; the ranks of the sketched quantiles among all
    latencies of those days are within the stated error of what was asked for. The error holds with a confidence of 99 %,
    so it is doubled here."""
    asked, off = {"p50": 0.5, "p95": 0.95, "p99": 0.99}, 2 * gauges.rank_error()
    ms = F.floor(F.col("value") * 1000).cast("bigint")
    events = _events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    days = _drained(spark, gauges.sketch_stream(events, "ts", "1 day", "1 hour", ("event_type",), ms), "sketches")
    merged = gauges.merged_sketches(days, ("event_type",), asked)
    last = days.agg(F.max(F.to_date("window_start"))).first()[0]
    rows = table(spark, sf_dir, "events").select("event_type", "ts", ms.alias("ms"))
    rows = rows.where(F.to_date("ts") <= F.lit(last).cast("date")).join(merged, "event_type")
    ranks = [F.sum(F.when(F.col("ms") < F.col(q), 1).otherwise(0)).alias(f"{q}_below") for q in asked]
    ranks += [F.sum(F.when(F.col("ms") <= F.col(q), 1).otherwise(0)).alias(f"{q}_upto") for q in asked]
    by = ["event_type", "count", "total", "mean", "max"]
    seen = rows.groupBy(*by).agg(*ranks)
    within = [((F.col(f"{q}_below") <= (r + off) * F.col("count")) & (F.col(f"{q}_upto") >= (r - off) * F.col("count"))).alias(f"{q}_within") for q, r in asked.items()]
    return seen.select("event_type", "count", "total", F.round("mean", 4).alias("mean"), "max", *within)


def connections_stream(spark, sf_dir):
    """Connects and disconnects in three micro-batches: every seventh comes forty places late, every fifth comes twice."""
    changes = """SELECT event_id, concat('stream_', user_id % 5) AS stream, concat('consumer_', user_id % 3) AS consumer,
      CASE event_type WHEN 'signup' THEN 1 ELSE -1 END AS delta,
      explode(CASE WHEN event_id % 7 = 0 THEN array(event_id + 40) WHEN event_id % 5 = 0 THEN array(event_id, event_id + 20) ELSE array(event_id) END) AS arrival
      FROM {events} WHERE event_type IN ('signup', 'error')"""
    rows = spark.sql(changes, events=table(spark, sf_dir, "events"))
    path, checkpoint = fresh_path(spark, "connections"), fresh_path(spark, "connections-checkpoint")

    def run(arrived, step):
        gauges.connections_stream(
            arrived, path=path, keys=["stream", "consumer"], order="event_id", delta=F.col("delta"), lateness=100, checkpoint=checkpoint, slice_rows=500
        ).awaitTermination()

    _in_steps(spark, rows, "arrival", "changes", run, 3)
    return gauges.connections(spark, path).select("event_id", "stream", "consumer", "active")


def gauge_stream(spark, sf_dir):
    """Newest offset and its age per partition, kept over several micro-batches of the log."""
    log = log_stream(spark, event_log_path(spark, sf_dir), event_log(spark, sf_dir).schema, max_files=4)
    path = fresh_path(spark, "gauges")
    with jobs.state_partitions(spark):
        gauges.gauge_stream(log, path=path, keys=("partition", "schema_version"), checkpoint=fresh_path(spark, "gauge-checkpoint")).awaitTermination()
    return gauges.gauges(spark, path, F.lit(NOW_MS)).select("partition", "schema_version", "latency_ms", "last_offset")


_CHANGES_SQL = """
changes AS (SELECT key, "offset", CASE WHEN new IS NULL THEN 'remove' WHEN old IS NULL THEN 'new' ELSE 'update' END AS change, old, new, coalesce(old = new, FALSE) AS same FROM (
  SELECT user_id AS key, event_id AS "offset", CASE WHEN event_type <> 'error' THEN event_type END AS new,
    lag(CASE WHEN event_type <> 'error' THEN event_type END) OVER (PARTITION BY user_id ORDER BY event_id) AS old FROM events))
"""

QUERIES = {
    "latency_sketch_stream": (
        latency_sketch_stream,
        """SELECT event_type, count(*) AS count, CAST(sum(ms) AS BIGINT) AS total, round(avg(ms), 4) AS mean, max(ms) AS max, TRUE AS p50_within, TRUE AS p95_within, TRUE AS p99_within
        FROM (SELECT event_type, ts, CAST(floor(value * 1000) AS BIGINT) AS ms FROM events) e
        WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR GROUP BY event_type""",
    ),
    "connections_stream": (
        connections_stream,
        """WITH c AS (SELECT event_id, user_id % 5 AS s, user_id % 3 AS k, CASE event_type WHEN 'signup' THEN 1 ELSE -1 END AS delta FROM events WHERE event_type IN ('signup', 'error'))
        SELECT event_id, 'stream_' || s AS stream, 'consumer_' || k AS consumer, CAST(sum(delta) OVER (PARTITION BY s, k ORDER BY event_id) AS BIGINT) AS active FROM c
        QUALIFY event_id <= (SELECT max(event_id) FROM c) - 100""",
    ),
    "gauge_stream": (
        gauge_stream,
        f"""WITH {LOG_SQL} SELECT partition, schema_version, {NOW_MS} - arg_max(ts_ms, "offset") AS latency_ms, max("offset") AS last_offset FROM log GROUP BY ALL""",
    ),
    "ingest_many_stream": (
        ingest_many_stream,
        """WITH e AS (SELECT event_id, event_type, user_id % 6 AS s, event_id * 2 >= (SELECT count(*) FROM events) AS late, event_id % 10 = 7 AS odd FROM events),
        p AS (SELECT e.*, v.p FROM e, (VALUES (0), (1), (2)) v(p) WHERE NOT odd UNION ALL SELECT e.*, NULL FROM e WHERE odd),
        k AS (SELECT *, CASE s WHEN 0 THEN CASE WHEN late THEN 'kind' ELSE 'k' END WHEN 1 THEN 'kind' WHEN 2 THEN CASE WHEN late THEN 'k' END END AS field FROM p),
        a AS (SELECT *, CASE WHEN s = 5 THEN 'unknown stream' WHEN s = 3 THEN 'disabled' WHEN field IS NULL THEN 'no schema' WHEN odd THEN 'not an array'
          WHEN p = 2 THEN 'not an object' WHEN p = (field = 'kind')::INT THEN 'Message accepted.' ELSE 'missing:' || field END AS answer FROM k),
        n AS (SELECT s, count(*) AS logged FROM a WHERE answer = 'Message accepted.' GROUP BY s)
        SELECT event_id AS request_id, 's' || a.s AS stream, CAST(p AS INT) AS pos, answer = 'Message accepted.' AS success, answer,
          CASE WHEN a.s = 0 AND late THEN 2 WHEN a.s < 2 OR (a.s = 2 AND late) THEN 1 END AS schema_version, CAST(logged AS BIGINT) AS logged,
          CASE WHEN logged IS NOT NULL THEN TRUE END AS dense
        FROM a LEFT JOIN n ON n.s = a.s""",
    ),
    "decode_stream": (
        decode_stream,
        """WITH e AS (SELECT event_id, event_type, user_id % 4 AS s, 1 + event_id % 2 AS v, event_id * 2 >= (SELECT count(*) FROM events) AS late, event_id % 5 <> 0 AS named FROM events),
        f AS (SELECT *, CASE WHEN s = 0 AND v = 1 THEN 'k' WHEN s = 0 AND late THEN 'kind' WHEN s = 1 AND v = 1 THEN 'kind' WHEN s = 1 THEN 'k' WHEN s = 2 AND v = 1 AND late THEN 'k' END AS field,
          s < 2 OR (s = 2 AND late) AS listed FROM e)
        SELECT event_id, 's' || s AS stream, CASE WHEN NOT listed THEN 'unknown stream' WHEN field IS NULL THEN 'unknown version' WHEN field = 'kind' AND NOT named THEN 'unreadable' END AS error,
          CASE field WHEN 'k' THEN '{"k":' || event_id || '}' WHEN 'kind' THEN CASE WHEN named THEN '{"kind":"' || event_type || '"}' END END AS payload FROM f""",
    ),
    "compact_stream": (
        compact_stream,
        f"""WITH {KEYED_SQL}, k AS (SELECT max(ts_ms) - {RETENTION_MS} AS keep_after FROM keyed),
        old AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY "offset" DESC) AS rn FROM keyed, k WHERE ts_ms <= keep_after AND key IS NOT NULL)
        SELECT key, "offset", ts_ms, value FROM old WHERE rn = 1 AND value IS NOT NULL UNION ALL SELECT key, "offset", ts_ms, value FROM keyed, k WHERE ts_ms > keep_after""",
    ),
    "commit_stream": (
        commit_stream,
        f"""WITH {LOG_SQL}, days AS (SELECT ts_ms // 86400000 * 86400000 AS window_ms, partition, max("offset") + 1 AS next_offset FROM log GROUP BY ALL)
        SELECT window_ms, partition, next_offset FROM days WHERE window_ms + 86400000 <= (SELECT max(ts_ms) FROM log) - 3600000""",
    ),
    "ingest_stream": (
        ingest_stream,
        """WITH p AS (SELECT CAST('0x' || substr(md5(CAST(user_id AS VARCHAR)), 1, 8) AS BIGINT) % 4 AS part FROM events WHERE event_type NOT IN ('error', 'signup'))
        SELECT CAST(part AS VARCHAR) AS part, count(*) AS records, count(*) AS offsets, count(*) - 1 AS last_offset FROM p GROUP BY part
        UNION ALL SELECT 'missing:value', count(*), NULL, NULL FROM events WHERE event_type IN ('error', 'signup')""",
    ),
    "serve_stream": (
        serve_stream,
        f"""WITH {LOG_SQL} SELECT partition, "offset", schema_version AS schema, '' AS kind, event_id AS id FROM log""",
    ),
    "dedup_stream": (dedup_stream, f"WITH {PROBE_SQL} SELECT DISTINCT origin, seq FROM received"),
    "correlate_stream": (
        correlate_stream,
        f"WITH {PROBE_SQL} SELECT origin, seq, recv_ms FROM correlated",
    ),
    "model_state_stream": (model_state_stream, f"WITH {PATCHES_SQL} SELECT document_id, member, value FROM members"),
    "fold_bad_patches_stream": (fold_bad_patches_stream, f"WITH {BAD_PATCHES_SQL} SELECT document_id, member, value FROM members"),
    "change_stream": (change_stream, f'WITH {_CHANGES_SQL} SELECT key, "offset", change, old, new, same FROM changes'),
    "delivery_state_stream": (
        delivery_state_stream,
        f"""WITH {PROBE_SQL} SELECT origin, seq, CAST("group" AS INT) AS "group", transit_ms, state FROM states
        WHERE sent_ms + 60000 <= (SELECT greatest(max(sent_ms), (SELECT max(recv_ms) FROM received)) FROM sent)""",
    ),
    "inspection": (
        inspection,
        f"""WITH {PATCHES_SQL} SELECT document_id, member, value FROM members WHERE member <> 'click'
        UNION ALL SELECT document_id, 'seen', 'true' FROM members GROUP BY document_id""",
    ),
    "agent_stream_muted": (
        agent_stream_muted,
        f"""WITH {_CHANGES_SQL} SELECT CAST(key AS VARCHAR) AS document_id, '["' || change || '"]' AS asked, count(*) AS patches FROM changes
        WHERE NOT same AND "offset" * 3 >= (SELECT count(*) FROM events) GROUP BY ALL""",
    ),
    "agent_stream": (
        agent_stream,
        f"""WITH {_CHANGES_SQL} SELECT CAST(key AS VARCHAR) AS document_id, '["' || change || '"]' AS asked, count(*) AS patches FROM changes WHERE NOT same GROUP BY ALL""",
    ),
}
