"""Landing, its failures, and streaming jobs over several micro-batches."""

import os
import shutil
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from millrace.operators import model, notify, positions
from millrace.plans import land
from millrace.queries import landing
from millrace.session import shared_dir
from millrace.sources import log as logs
from millrace.streaming import jobs, state
from tests.test_model import PATCH, brute, random_sets

V1 = '{"type":"record","name":"r","fields":[{"name":"id","type":"long"},{"name":"who","type":"string","sensitivity":"PII"}]}'
V2 = V1.replace("}]}", '},{"name":"extra","type":["null","string"],"default":null}]}')


def make_log(spark, path, count=2000):
    rows = spark.range(count).select(
        F.when(F.col("id") % 3 == 0, F.col("id") % 4).otherwise(0).cast("int").alias("partition"),
        "id",
        (F.col("id") * 10).alias("ts_ms"),
        F.when(F.col("id") < count // 2, 1).otherwise(2).alias("schema_version"),
        F.to_json(F.struct("id", F.concat(F.lit("u"), "id").alias("who"))).alias("body"),
    )
    logs.append_log(rows.repartition(6), path, ["id"])
    return logs.log_scan(spark, path)


def plan_all(batch):
    return batch.groupBy("partition").agg(F.min("offset").alias("start"), (F.max("offset") + 1).alias("end"))


def test_paths(spark):
    at = F.timestamp_millis(F.lit(1526462224000))
    row = spark.range(1).select(
        land.acquisition_instant(at).alias("i"),
        land.landing_path(F.lit("database1"), F.lit("road1"), F.lit(1526462225000), land.acquisition_instant(at)).alias("p"),
    ).first()
    assert row.i == "20180516T091704Z" and row.p == "database1/road1/1526462225000/acquisition_instant=20180516T091704Z"


def test_table_follows_the_schema(spark, path):
    assert land.ensure_table(spark, "t_schema", path("t"), V1, 1) == "created"
    assert land.ensure_table(spark, "t_schema", path("t"), V1, 1) == "unchanged"
    assert land.ensure_table(spark, "t_schema", path("t"), V2, 2) == "altered"
    assert land.ensure_table(spark, "t_schema", path("t"), V2, 2) == "unchanged"
    assert land.table_version(spark, "t_schema") == 2 and "extra" in spark.table("t_schema").columns


def test_failed_commit_lands_the_same_range_again(spark, path, monkeypatch):
    log = make_log(spark, path("log"))
    land.ensure_table(spark, "t_retry", path("t"), V2, 2)
    wanted = dict(stream="s", table="t_retry", location=path("t/1"), instant="20240101T000000Z", schema_json=V2, commits=path("commits"))
    told = []
    with monkeypatch.context() as m:
        m.setattr(land, "commit_offsets", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            land.land_range(spark, log, plan_all(log), **wanted, notify=told.append)
    assert not told
    assert land.land_range(spark, log, plan_all(log), **wanted) is False  # the partition was there already
    assert spark.table("t_retry").count() == 2000
    assert spark.read.parquet(path("commits")).agg(F.sum("next_offset")).first()[0] == 2000


def test_drop_keeps_files(spark, path):
    log = make_log(spark, path("log"), 100)
    land.ensure_table(spark, "t_drop", path("t"), V2, 2)
    land.land_range(spark, log, plan_all(log), stream="s", table="t_drop", location=path("t/1"), instant="i", schema_json=V2, commits=path("c"))
    land.drop_partition(spark, "t_drop", "i")
    land.drop_partition(spark, "t_drop", "i")
    assert spark.table("t_drop").count() == 0 and spark.read.parquet(path("t/1")).count() == 100


def test_file_size_and_codec(spark, path):
    rows = land.landed_rows(make_log(spark, path("log")), V2)
    land.land_batch(rows, path("small"), file_rows=300, codec="gzip")
    files = [r.path for r in spark.read.format("binaryFile").load(path("small")).select("path").collect()]
    assert len(files) >= 7 and all(".gz.parquet" in f for f in files)
    assert "134217728" not in spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    land.land_batch(rows, path("orc"), fmt="orc")
    assert spark.read.orc(path("orc")).where("who <> ''").count() == 0


@pytest.mark.parametrize("limit", [1, 700, 10**9])
def test_files_are_rolled_by_bytes(spark, path, limit):
    """Each file is what a writer that counts bytes record by record would have put into it, long records included."""
    rows = land.landed_rows(make_log(spark, path("log"), 400), V2)
    rows = rows.withColumn("who", F.when(F.col("log_offset") % 37 == 5, F.repeat(F.lit("é"), 900)).otherwise(F.lit("x")))
    land.land_batch(rows, path("out"), "json", file_bytes=limit)
    want, at = [], {}
    for row in sorted(rows.withColumn("n", land.record_bytes(rows)).collect(), key=lambda r: (r.schema_version, r.log_partition, r.log_offset)):
        key, (start, upto) = (row.schema_version, row.log_partition), at.get((row.schema_version, row.log_partition), (None, 0))
        number = upto // limit
        if number != start:
            want.append([])
        want[-1].append(row.n)
        at[key] = (number, upto + row.n)
    files = spark.read.format("binaryFile").load(path("out")).where("path like '%.json'").select("path", "length").orderBy("path").collect()
    assert [f.length for f in files] == [sum(own) for own in want]
    assert all(sum(own) - own[-1] <= limit for own in want)
    written = spark.read.schema(land.table_columns(V2)).json(path("out"))
    assert written.count() == 400 and written.distinct().count() == 400


def test_small_files_share_a_task(spark, path):
    """Tasks follow from the bytes, not from the files; files stay in order and lie in one folder."""
    rows = land.landed_rows(make_log(spark, path("log"), 400), V2)
    tasks = rows.select("schema_version", "log_partition").distinct().count()
    assert land.roll_by_bytes(rows, 200).rdd.getNumPartitions() == tasks
    land.land_batch(rows, path("out"), "json", codec="gzip", file_bytes=200)
    names = sorted(name for name in os.listdir(path("out")) if name.endswith(".json.gz"))
    assert len(names) > 5 * tasks
    assert not [name for name in os.listdir(path("")) if name.startswith("_pending")]
    read = spark.read.schema(land.table_columns(V2))
    assert read.json(path("out")).count() == 400
    order = ["schema_version", "log_partition", "log_offset"]
    found = [tuple(r) for name in names for r in read.json(path(f"out/{name}")).select(*order).collect()]
    assert found == sorted(found)


def test_rolled_files_take_few_calls(spark, path, monkeypatch):
    """What the driver does for a file is a renaming, one call to the JVM, however the names are found."""
    rows = spark.range(800).select("id", F.lit(1).alias("schema_version"), (F.col("id") % 400).cast("int").alias("log_partition"), (F.col("id") + 0).alias("log_offset"))
    calls, client = [], spark.sparkContext._gateway._gateway_client
    send = client.send_command

    def counted(command, *how, **also):
        calls.append(command)
        return send(command, *how, **also)

    monkeypatch.setattr(client, "send_command", counted)
    land.land_batch(rows, path("out"), "json", file_bytes=10**6)
    monkeypatch.undo()
    names = [name for name in os.listdir(path("out")) if name.endswith(".json")]
    assert len(names) == 400 and spark.read.schema(rows.schema).json(path("out")).count() == 800
    assert len([name for name in names if "-00000000-" in name]) == 400
    assert len(calls) < 8 * len(names)


def test_rolled_files_are_read_by_few_tasks(spark, path):
    """The query's tables are its own; the scan of the landed files is one of as many tasks as the session has room for."""
    kind = F.element_at(F.array(*map(F.lit, ("click", "error", "view", "signup"))), (F.floor(F.col("id") / 50) % 4 + 1).cast("int"))
    events = spark.range(3000).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") + 1_700_000_000).alias("ts"), (F.col("id") % 50).alias("user_id"),
        kind.alias("event_type"), (F.col("id") / 7).alias("value"), F.concat(F.lit('{"k": '), F.col("id") % 9, F.lit("}")).alias("props"),
    )
    events.write.parquet(path("events.parquet"))
    found = landing.land_rolled(spark, path(""))
    assert "Coalesce" in found._jdf.queryExecution().executedPlan().toString()
    rows = found.collect()
    assert len(rows) == 12 and sum(r.row_count for r in rows) == sum(r.offsets for r in rows) == 3000 and all(r.bounded and r.several for r in rows)
    assert sum(r.ids for r in rows) == sum(range(3000))


def test_nothing_to_roll(spark, path):
    rows = land.landed_rows(make_log(spark, path("log"), 10), V2).where("log_offset < 0")
    land.land_batch(rows, path("out"), file_bytes=100)
    assert spark.read.schema(land.table_columns(V2)).parquet(path("out")).count() == 0


def test_landing_stream_restarts_where_it_stopped(spark, path):
    log = make_log(spark, path("log"))
    land.ensure_table(spark, "t_stream", path("lake"), V2, 2)

    def go():
        query = jobs.land_stream(
            logs.log_stream(spark, path("log"), log.schema, max_files=1), stream="s", table="t_stream", root=path("lake"), schema_json=V2,
            commits=path("commits"), checkpoint=path("cp"), first_instant=datetime(2024, 1, 1, tzinfo=timezone.utc), interval=timedelta(hours=1),
        )
        query.awaitTermination()

    go()
    instants = spark.sql("SHOW PARTITIONS t_stream").count()
    assert instants >= 4 and spark.table("t_stream").count() == 2000
    ends = {r.partition: r.next_offset for r in positions.latest_offsets(log).withColumnRenamed("latest", "next_offset").collect()}
    more = spark.createDataFrame([(1, 5000, 50000, 2, '{"id":5000,"who":"x"}')], "partition int, id long, ts_ms long, schema_version int, body string")
    logs.append_log(more, path("log"), ["id"], spark.createDataFrame(list(ends.items()), "partition int, next_offset long"))
    go()
    assert spark.table("t_stream").count() == 2001 and spark.sql("SHOW PARTITIONS t_stream").count() == instants + 1
    committed = spark.read.parquet(path("commits")).groupBy("partition").agg(F.max("next_offset").alias("n"))
    assert {r.partition: r.n for r in committed.collect()} == {**ends, 1: ends[1] + 1}


def test_landing_job_goes_on_after_a_failure(spark, path, monkeypatch):
    """A landing that fails before its commit is landed again over the same files; one that fails after it is still told."""
    log = make_log(spark, path("log"))
    ends, told = logs.stored_ends(spark, path("log")), []
    assert {tuple(r) for r in ends.collect()} == {tuple(r) for r in positions.log_ends(log).collect()}
    table = f"job_{os.path.basename(path('x'))}_{abs(hash(path('x'))) % 10**8}"
    how = dict(
        stream="s", table=table, root=path("lake"), schema_json=V2, version=2, commits=path("commits"), cap=400,
        first_instant=datetime(2024, 1, 1, tzinfo=timezone.utc), notify=lambda rows: told.extend(rows.collect()),
        notify_table=lambda rows: told.append("table"),
    )
    plain, calls = land.commit_offsets, []

    def failing(*args, **kw):
        calls.append(args)
        if len(calls) == 2:
            raise RuntimeError("before the commit")
        plain(*args, **kw)
        if len(calls) == 4:
            raise RuntimeError("after the commit")

    monkeypatch.setattr(land, "commit_offsets", failing)
    landings = 0
    for _ in range(3):
        try:
            landings = land.landing_job(spark, log, ends, **how)
        except RuntimeError:
            continue
    rows = spark.table(table)
    assert rows.count() == 2000 == rows.select("log_partition", "log_offset").distinct().count()
    counts = sorted(r["record_count"] for r in told if r != "table")
    assert told.count("table") == 1 and sum(counts) == 2000
    assert len({r["acquisition_instant"] for r in told if r != "table"}) == len(counts) == spark.sql(f"SHOW PARTITIONS {table}").count()
    assert landings and land.landing_job(spark, log, ends, **how) == 0
    spark.sql(f"DROP TABLE {table}")


def test_the_notice_of_a_table_survives_a_failure(spark, path, monkeypatch):
    """The job fails once the table is there, then while it is told: it is told by a later run, and by none after that."""
    log = make_log(spark, path("log"))
    ends, told = logs.stored_ends(spark, path("log")), []
    table = f"told_{os.path.basename(path('x'))}_{abs(hash(path('x'))) % 10**8}"

    def tell(rows):
        told.append(rows.first()["table"])
        if len(told) == 1:
            raise RuntimeError("the receiver is away")

    how = dict(
        stream="s", table=table, root=path("lake"), schema_json=V2, version=2, commits=path("commits"),
        first_instant=datetime(2024, 1, 1, tzinfo=timezone.utc), notify_table=tell,
    )
    plain = land.ensure_table

    def failing(*args, **kw):
        plain(*args, **kw)
        raise RuntimeError("after the table")

    monkeypatch.setattr(land, "ensure_table", failing)
    with pytest.raises(RuntimeError, match="after the table"):
        land.landing_job(spark, log, ends, **how)
    monkeypatch.setattr(land, "ensure_table", plain)
    with pytest.raises(RuntimeError, match="away"):
        land.landing_job(spark, log, ends, **how)
    assert land.landing_job(spark, log, ends, **how) == 1
    assert land.landing_job(spark, log, ends, **how) == 0
    assert told == [table, table]
    spark.sql(f"DROP TABLE {table}")


def test_ingest_stream_continues_offsets(spark, path):
    for i in range(3):
        spark.range(i * 100, i * 100 + 100).select(
            "id", F.when(F.col("id") % 10 == 0, "{}").otherwise(F.to_json(F.struct("id", F.lit("w").alias("who")))).alias("body")
        ).coalesce(1).write.mode("append").parquet(path("in"))
    followed = logs.log_stream(spark, path("in"), spark.read.parquet(path("in")).schema, max_files=1)
    jobs.ingest_stream(
        followed, schema_json=V1, version=1, log=path("log"), rejects=path("rejects"), checkpoint=path("cp"), order=["id"], key_path="$.who", partitions=3
    ).awaitTermination()
    stored = spark.read.parquet(path("log"))
    assert stored.count() == 270 and stored.select("partition").distinct().count() == 1  # one key, one partition
    assert sorted(r.offset for r in stored.select("offset").collect()) == list(range(270))
    assert spark.read.parquet(path("rejects")).count() == 30


def test_ingest_stream_leaves_the_log_only(spark, path):
    """Messages without a key spread, and a finished batch leaves nothing but the log, the rejects and the positions."""
    spark.range(300).select("id", F.to_json(F.struct("id", F.lit("w").alias("who"))).alias("body")).coalesce(1).write.parquet(path("in"))
    followed = logs.log_stream(spark, path("in"), spark.read.parquet(path("in")).schema)
    folder = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    jobs.ingest_stream(
        followed, schema_json=V1, version=1, log=path("log"), rejects=path("rejects"), checkpoint=path("cp"), order=["id"], key_path="$.none", partitions=3
    ).awaitTermination()
    assert set(os.listdir(folder)) == before
    counts = {r["partition"]: r["count"] for r in spark.read.parquet(path("log")).groupBy("partition").count().collect()}
    assert len(counts) == 3 and min(counts.values()) > 60 and sum(counts.values()) == 300


@pytest.mark.parametrize("seed, bad", [(3, 0.0), (4, 0.3)])
def test_patch_stream_equals_batch(spark, path, seed, bad):
    rows = random_sets(seed, 400, bad=bad)
    for i in range(4):
        spark.createDataFrame(rows[i * 100 : i * 100 + 100], PATCH).coalesce(1).write.mode("append").parquet(path("patches"))
    followed = logs.log_stream(spark, path("patches"), spark.createDataFrame([], PATCH).schema, max_files=1)
    out = jobs.drain(state.model_state_stream(followed), path("out"), path("cp"))
    documents, failures = brute(rows)
    assert sorted((r.document_id, r.seq) for r in out.where("reason is not null").collect()) == sorted(failures)
    last = out.groupBy("document_id").agg(F.max_by(F.struct("document"), "seq").alias("s")).select("document_id", "s.document").where("document is not null")
    folded = model.fold_patches(spark.createDataFrame(rows, PATCH))
    assert {tuple(r) for r in last.collect()} == {tuple(r) for r in folded.collect()} and last.count() == len(documents)


def test_change_stream_equals_batch(spark, path):
    log = spark.range(400).select(
        (F.col("id") % 7).alias("key"), F.col("id").alias("offset"), F.when(F.col("id") % 5 != 0, (F.col("id") % 3).cast("string")).alias("value")
    )
    for i in range(4):
        log.where((F.col("offset") >= i * 100) & (F.col("offset") < i * 100 + 100)).coalesce(1).write.mode("append").parquet(path("log"))
    out = jobs.drain(state.change_stream(logs.log_stream(spark, path("log"), log.schema, max_files=1)), path("out"), path("cp"))
    batch = model.change_capture(log, "key", "value", slice_rows=50)
    assert {tuple(r) for r in out.collect()} == {tuple(r) for r in batch.collect()}


def test_agents_skip_what_is_already_there(spark, path):
    log = spark.range(40).select(F.col("id").alias("offset"), (F.col("id") % 2).alias("key"), F.col("id").cast("string").alias("value"))
    for part in (log.where("offset < 20"), log.where("offset >= 20")):
        part.coalesce(1).write.mode("append").parquet(path("log"))
    followed = logs.log_stream(spark, path("log"), spark.read.parquet(path("log")).schema, max_files=1)

    def note(changes):
        return changes.select(F.col("key").cast("string").alias("document_id"), F.array(F.struct(F.lit("add").alias("op"), F.lit("/n").alias("path"), "new")).cast(model.OPERATIONS).alias("operations"))

    jobs.agent_stream(state.change_stream(followed), [note], path("patches"), path("cp"), loaded=30).awaitTermination()
    assert spark.read.parquet(path("patches/*/*")).count() == 10
    jobs.agent_stream(state.change_stream(followed), [note], path("every"), path("cp-every")).awaitTermination()
    assert spark.read.parquet(path("every/*/*")).count() == 40


def test_unmatched_probes_come_out(spark, path):
    at = lambda c: F.timestamp_millis(c).alias
    spark.range(10).select(F.lit("o").alias("origin"), F.col("id").alias("seq"), at(F.col("id") * 1000 + 1)("sent_at")).coalesce(1).write.parquet(path("sent"))
    spark.createDataFrame([("o", 1, 1500), ("o", 2, 90_000), ("x", 99, 900_000)], "origin string, seq long, ms long").select(
        "origin", "seq", at(F.col("ms"))("recv_at")
    ).coalesce(1).write.parquet(path("received"))
    spark.createDataFrame([("o", 1000, 900_000)], "origin string, seq long, ms long").select("origin", "seq", at(F.col("ms"))("sent_at")).coalesce(1).write.mode("append").parquet(path("sent"))
    follow = lambda n: logs.log_stream(spark, path(n), spark.read.parquet(path(n)).schema)
    rows = jobs.drain(jobs.correlate_stream(follow("sent"), follow("received"), "60 seconds"), path("out"), path("cp")).where("seq < 1000").collect()
    assert {r.seq: r.recv_at is not None for r in rows} == {**{s: False for s in range(10)}, 1: True}


def test_notifications(spark):
    rows = spark.createDataFrame([("s", "x" * 300_000, None, "c")], "stream string, description string, team_name string, contact_email string")
    row = notify.stream_created(rows).first()
    assert row.oversized and row.type == "ROAD_CREATED" and '"teamName"' not in row.message
    sent = []
    notify.send(rows, [lambda n: sent.append(n.count()), lambda n: sent.append(n.count())])
    assert sent == [1, 1]
    with pytest.raises(ValueError):
        notify.notification("OTHER", F.lit("s"))


def test_many_landings_are_landed_together(spark, path, monkeypatch):
    """Landings by the job of several at once are those that pass by pass would be, also after a failure before the commit."""
    log, ends = make_log(spark, path("log")), logs.stored_ends(spark, path("log"))
    got, jobs_of = {}, []
    plain = land.land_together

    def counted(*args, **kw):
        jobs_of.append(len(args[2]))
        plain(*args, **kw)
        if len(jobs_of) == 1:  # as if the commit had been lost
            shutil.rmtree(path("commits-2"))
            raise OSError("lost")

    monkeypatch.setattr(land, "land_together", counted)
    for together in (2, 10**9):
        monkeypatch.setattr(land, "TOGETHER", together)
        table, told = f"together_{together}_{abs(hash(path('x'))) % 10**8}", []
        how = dict(
            stream="s", table=table, root=path(f"lake-{together}"), schema_json=V2, version=2, commits=path(f"commits-{together}"), cap=190,
            first_instant=datetime(2024, 1, 1, tzinfo=timezone.utc), notify=lambda rows: told.extend(rows.collect()),
        )
        try:
            passes = land.landing_job(spark, log, ends, **how)
        except OSError:
            passes = land.landing_job(spark, log, ends, **how)
        rows = {tuple(r) for r in spark.table(table).select("id", "who", "log_partition", "log_offset", "acquisition_instant").collect()}
        commits = {tuple(r) for r in spark.read.parquet(how["commits"]).drop("location").collect()}
        places = {r["location"].split(str(together), 1)[1] for r in spark.read.parquet(how["commits"]).collect()}
        got[together] = passes, spark.table(table).count(), rows, commits, places, sorted((r["acquisition_instant"], r["record_count"]) for r in told)
        assert not [name for name in os.listdir(f"{how['root']}/s") if name.startswith("_pending")]
        spark.sql(f"DROP TABLE {table}")
    assert got[2] == got[10**9] and got[2][0] == 8 and got[2][1] == 2000
    assert jobs_of == [4, 4, 2]
