"""Queries that land the log and read what was landed."""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from millrace.operators import notify, positions
from millrace.plans import land
from millrace.queries.inputs import EVENT_V1, EVENT_V2, LOG_SQL, PARTITIONS, event_ends, event_log, event_log_path, sql
from millrace.session import fresh_path
from millrace.sources.log import append_log, bounded_offset_scan, log_scan, log_stream, stored_ends
from millrace.streaming.jobs import land_stream as start_landing

INSTANT = "20240201T000000Z"
FIRST = datetime(2024, 2, 1, tzinfo=timezone.utc)
FILE_ROWS = 3000
ROLL_BYTES = 8 * 1024
#: Tasks a core that read small files.
READERS = 8


def _plan(ends):
    latest = positions.latest_of(ends)
    committed = latest.select("partition", (F.col("partition") * 10).cast("bigint").alias("committed"))
    return positions.plan_landing(latest, committed)


def land_batch(spark, sf_dir):
    """One planned landing, read back from its files."""
    log = event_log(spark, sf_dir)
    location = f"{fresh_path(spark, 'landed')}/acquisition_instant={INSTANT}"
    land.land_batch(land.landed_rows(bounded_offset_scan(log, _plan(event_ends(spark, sf_dir))), EVENT_V2), location)
    landed = spark.read.schema(land.table_columns(EVENT_V2)).parquet(location)
    return landed.select("id", "user", "kind", "value", F.col("props.k").alias("k"), "schema_version", "log_partition", "log_offset")


def land_formats(spark, sf_dir):
    """The log landed as ORC with a codec and a greatest number of rows per file."""
    location = fresh_path(spark, "orc")
    land.land_batch(land.landed_rows(event_log(spark, sf_dir), EVENT_V2), location, "orc", "zlib", file_rows=FILE_ROWS)
    landed = spark.read.schema(land.table_columns(EVENT_V2)).orc(location)
    files = landed.groupBy("schema_version", F.input_file_name().alias("file")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("v"))
    return files.groupBy("schema_version").agg(
        F.sum("n").alias("row_count"), F.round(F.sum("v"), 2).alias("value"), (F.max("n") <= FILE_ROWS).alias("files_bounded")
    )


def land_rolled(spark, sf_dir):
    """The log landed as lines of JSON in files that are cut by bytes; their sizes are read back."""
    location = fresh_path(spark, "rolled")
    rows = land.landed_rows(event_log(spark, sf_dir), EVENT_V2)
    land.land_batch(rows, location, "json", file_bytes=ROLL_BYTES)
    largest = rows.agg(F.max(land.record_bytes(rows))).first()[0]
    # A scan takes a task for every 32 small files, and each of them as many shuffle files as there are partitions.
    tasks = READERS * spark.sparkContext.defaultParallelism
    listed = spark.read.format("binaryFile").load(location).select("path", "length").coalesce(tasks)
    sizes = listed.where("path like '%.json'").agg(F.max("length").alias("size"), F.count("*").alias("files")).first()
    landed = spark.read.schema(land.table_columns(EVENT_V2)).json(location).coalesce(tasks)
    said = F.lit(sizes["size"] < ROLL_BYTES + largest), F.lit(sizes["files"] > PARTITIONS)
    return landed.groupBy("schema_version", "log_partition").agg(
        F.count("*").alias("row_count"), F.countDistinct("log_offset").alias("offsets"), F.sum("id").alias("ids")
    ).withColumns({"bounded": said[0], "several": said[1]})


def landing_table(spark, sf_dir):
    """A table created with the first schema, brought to the second, with three landings of which one is
    registered twice and one dropped again."""
    log = event_log(spark, sf_dir)
    root, commits = fresh_path(spark, "lake"), fresh_path(spark, "commits")
    table = f"events_{uuid.uuid4().hex[:10]}"
    sent = fresh_path(spark, "notifications")
    steps = [land.ensure_table(spark, table, root, EVENT_V1, 1)]
    for day in (1, 2, 3):
        if day == 2:
            steps.append(land.ensure_table(spark, table, root, EVENT_V2, 2))
        instant = f"2024020{day}T000000Z"
        batch = log.where(F.col("event_id") % 3 == day - 1)
        plan = batch.groupBy("partition").agg(F.min("offset").alias("start"), (F.max("offset") + 1).alias("end"))
        land.land_range(
            spark, batch, plan, stream="events", table=table, location=f"{root}/{day}/acquisition_instant={instant}", instant=instant,
            schema_json=EVENT_V1 if day == 1 else EVENT_V2, commits=commits,
            notify=lambda rows: notify.send(
                notify.partition_created(rows, "thrift://metastore", "lake"), [lambda n: n.write.mode("append").parquet(sent)]
            ),
        )
    steps.append(land.ensure_table(spark, table, root, EVENT_V2, 2))
    again = land.register_partition(spark, table, "20240202T000000Z", f"{root}/2/acquisition_instant=20240202T000000Z")
    land.drop_partition(spark, table, "20240203T000000Z")
    landed = spark.table(table).groupBy("acquisition_instant").agg(
        F.count("*").alias("row_count"), F.count("value").alias("with_value"), F.count_if(F.col("kind") != "").alias("unmasked")
    )
    told = F.lit(spark.read.parquet(sent).count()).cast("bigint")
    return landed.withColumn("notified", told).withColumn("steps", F.lit(" ".join(steps))).withColumn("registered_again", F.lit(again))


def _landings(spark, log, ends, schema, cap, name):
    """A landing job run to its end, and again: rows of each landing and partition, where it was committed, and what
    was told."""
    root, commits, sent = fresh_path(spark, f"{name}-lake"), fresh_path(spark, f"{name}-commits"), fresh_path(spark, f"{name}-sent")
    table = f"{name}_{uuid.uuid4().hex[:10]}"
    sender = [lambda n: n.write.mode("append").parquet(sent)]
    how = dict(
        stream=name, table=table, root=root, schema_json=schema, version=2, commits=commits, first_instant=FIRST, cap=cap,
        notify=lambda rows: notify.send(notify.partition_created(rows, "thrift://metastore", "lake"), sender),
        notify_table=lambda rows: notify.send(notify.table_created(rows, "thrift://metastore", "lake"), sender),
    )
    passes = land.landing_job(spark, log, ends, **how)
    again = land.landing_job(spark, log, ends, **how)
    landed = spark.table(table).groupBy("acquisition_instant", F.col("log_partition").alias("partition")).agg(
        F.count("*").alias("row_count"), F.countDistinct("log_offset").alias("offsets")
    )
    committed = spark.read.schema(land.COMMITS).parquet(commits).select("acquisition_instant", "partition", "next_offset")
    told = spark.read.parquet(sent).groupBy("type").agg(F.count("*").alias("n"))
    told = {row["type"]: row["n"] for row in told.collect()}
    counts = f"{passes} {again} {told.get('HIVE_TABLE_CREATED', 0)} {told.get('HIVE_PARTITION_CREATED', 0)}"
    return landed.join(committed, ["acquisition_instant", "partition"]).withColumn("landings_again_tables_told", F.lit(counts))


def landing_job(spark, sf_dir):
    """The whole event log landed in passes of a thousand records per partition, then nothing more to land."""
    return _landings(spark, event_log(spark, sf_dir), event_ends(spark, sf_dir), EVENT_V2, CAP, "passes")


def landing_strategy(spark, sf_dir):
    """A table made and altered by a strategy of one's own, as ORC, and the log landed in it."""

    def create(spark, table, location, columns, version, fmt):
        land.create_table(spark, table, location, columns, version, "orc")
        spark.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ('made' = 'ours')")

    def alter(spark, table, columns, version):
        land.alter_table(spark, table, columns, version)
        spark.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ('altered' = 'ours')")

    root, table = fresh_path(spark, "strategy"), f"strategy_{uuid.uuid4().hex[:10]}"
    steps = [land.ensure_table(spark, table, root, text, version, create=create, alter=alter) for text, version in ((EVENT_V1, 1), (EVENT_V2, 2), (EVENT_V2, 2))]
    location = f"{root}/0/acquisition_instant={INSTANT}"
    land.land_batch(land.landed_rows(event_log(spark, sf_dir), EVENT_V2), location, "orc")
    land.register_partition(spark, table, INSTANT, location)
    kept = {row["key"]: row["value"] for row in spark.sql(f"SHOW TBLPROPERTIES {table}").collect()}
    said = " ".join([*steps, kept["made"], kept["altered"]])
    return spark.table(table).groupBy("schema_version").agg(F.count("*").alias("row_count")).withColumn("steps", F.lit(said))


ITEM = '{"type":"record","name":"item","fields":[{"name":"order","type":"long"},{"name":"line","type":"int"},{"name":"price","type":"double"}]}'


def landing_run(spark, sf_dir):
    """Line items as a log of six partitions, landed at the cap that landings have by default."""
    path = fresh_path(spark, "items")
    records = sql(
        spark, sf_dir,
        "SELECT CAST(l_orderkey % 6 AS INT) AS partition, l_orderkey, l_linenumber, 2 AS schema_version, 0L AS ts_ms, "
        "to_json(named_struct('order', l_orderkey, 'line', l_linenumber, 'price', l_extendedprice)) AS body FROM {lineitem}",
        "lineitem",
    )
    append_log(records, path, ["l_orderkey", "l_linenumber", "body"])
    log = log_scan(spark, path).withColumn("partition", F.col("partition").cast("int"))
    return _landings(spark, log, stored_ends(spark, path), ITEM, positions.MAX_RECORDS_PER_PARTITION, "items")


def land_stream(spark, sf_dir):
    """The whole log landed by a stream in capped micro-batches, with its committed positions."""
    schema = event_log(spark, sf_dir).schema
    root, commits = fresh_path(spark, "stream-lake"), fresh_path(spark, "stream-commits")
    table = f"stream_{uuid.uuid4().hex[:10]}"
    land.ensure_table(spark, table, root, EVENT_V2, 2)
    query = start_landing(
        log_stream(spark, event_log_path(spark, sf_dir), schema, max_files=4),
        stream="events", table=table, root=root, schema_json=EVENT_V2, commits=commits, checkpoint=fresh_path(spark, "checkpoint"),
        first_instant=FIRST, interval=timedelta(hours=1),
    )
    query.awaitTermination()
    landed = spark.table(table).groupBy(F.col("log_partition").alias("partition")).agg(
        F.count("*").alias("row_count"), F.countDistinct("log_offset").alias("offsets"), F.count_if(F.col("kind") != "").alias("unmasked")
    )
    committed = spark.read.parquet(f"{commits}/*").groupBy("partition").agg(F.max("next_offset").alias("next_offset"))
    return landed.join(committed, "partition")


CAP = 1000


def _landings_sql(rows: str, cap: int) -> str:
    """Landings of a log of which ``rows(partition, n)`` says how long its partitions are."""
    return f"""{rows}, passes AS (SELECT partition, n, unnest(range((n + {cap - 1}) // {cap})) AS number FROM rows_of)
        SELECT strftime(TIMESTAMP '2024-02-01' + number * INTERVAL 1 HOUR, '%Y%m%dT%H%M%SZ') AS acquisition_instant, CAST(partition AS INT) AS partition,
        CAST(least(n, (number + 1) * {cap}) - number * {cap} AS BIGINT) AS row_count, CAST(least(n, (number + 1) * {cap}) - number * {cap} AS BIGINT) AS offsets,
        CAST(least(n, (number + 1) * {cap}) AS BIGINT) AS next_offset,
        (SELECT max(number) + 1 FROM passes) || ' 0 1 ' || (SELECT max(number) + 1 FROM passes) AS landings_again_tables_told FROM passes"""


QUERIES = {
    "landing_job": (landing_job, _landings_sql("WITH rows_of AS (SELECT user_id % 6 AS partition, count(*) AS n FROM events GROUP BY ALL)", CAP)),
    "landing_run": (
        landing_run,
        _landings_sql("WITH rows_of AS (SELECT l_orderkey % 6 AS partition, count(*) AS n FROM lineitem GROUP BY ALL)", positions.MAX_RECORDS_PER_PARTITION),
    ),
    "landing_strategy": (
        landing_strategy,
        """SELECT CAST(CASE WHEN event_type IN ('error', 'signup') THEN 1 ELSE 2 END AS INT) AS schema_version, count(*) AS row_count,
        'created altered unchanged ours ours' AS steps FROM events GROUP BY 1""",
    ),
    "land_batch": (
        land_batch,
        f"""WITH {LOG_SQL} SELECT event_id AS id, user_id AS user, '' AS kind, CASE WHEN schema_version = 2 THEN value ELSE 0.0 END AS value,
        CASE WHEN schema_version = 2 THEN CAST(json_extract(props, '$.k') AS INT) END AS k, schema_version, partition AS log_partition, "offset" AS log_offset
        FROM log WHERE "offset" >= partition * 10 AND "offset" < partition * 10 + {positions.MAX_RECORDS_PER_PARTITION}""",
    ),
    "land_rolled": (
        land_rolled,
        f"""WITH {LOG_SQL} SELECT CAST(schema_version AS INT) AS schema_version, partition AS log_partition, count(*) AS row_count, count(*) AS offsets, CAST(sum(event_id) AS BIGINT) AS ids,
        TRUE AS bounded, TRUE AS several FROM log GROUP BY ALL""",
    ),
    "land_formats": (
        land_formats,
        """SELECT CAST(v AS INT) AS schema_version, count(*) AS row_count, round(sum(CASE WHEN v = 2 THEN value ELSE 0.0 END), 2) AS value, TRUE AS files_bounded
        FROM (SELECT value, CASE WHEN event_type IN ('error', 'signup') THEN 1 ELSE 2 END AS v FROM events) GROUP BY v""",
    ),
    "landing_table": (
        landing_table,
        """SELECT '2024020' || (1 + event_id % 3) || 'T000000Z' AS acquisition_instant, count(*) AS row_count,
        count(*) FILTER (event_id % 3 = 1) AS with_value, CAST(0 AS BIGINT) AS unmasked, CAST(3 AS BIGINT) AS notified,
        'created altered unchanged' AS steps, FALSE AS registered_again FROM events WHERE event_id % 3 < 2 GROUP BY ALL""",
    ),
    "land_stream": (
        land_stream,
        f"""WITH {LOG_SQL} SELECT partition, count(*) AS row_count, count(*) AS offsets, CAST(0 AS BIGINT) AS unmasked, max("offset") + 1 AS next_offset FROM log GROUP BY partition""",
    ),
}
