"""Positions, landing plans and access rules, case by case."""

import ipaddress
import pytest
from pyspark.sql import functions as F

from millrace.operators import access, catalog, inventory, observe, positions


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_landing_plan(spark):
    latest = table(spark, [(1, 10), (2, 20), (3, 7), (4, 500), (5, 3)], "partition int, latest long")
    committed = table(spark, [(1, 5), (2, 15), (3, 7), (4, 100)], "partition int, committed long")
    plan = positions.plan_landing(latest, committed, 100)
    assert sorted(tuple(r) for r in plan.collect()) == [(1, 5, 10, False), (2, 15, 20, False), (4, 100, 200, True), (5, 0, 3, False)]
    summary = positions.landing_summary(plan).first()
    assert (summary.offsets, summary.offset_count, summary.run_again) == ("1:5,10;2:15,20;4:100,200;5:0,3", 113, True)
    assert positions.plan_landing(latest, latest.withColumnRenamed("latest", "committed")).count() == 0


def test_commit_positions(spark):
    received = table(spark, [(0, 1), (1, 2), (1, 3)], "partition int, offset long").withColumn("ts", F.timestamp_seconds(F.lit(0)))
    rows = positions.commit_positions(received, "ts", "1 second").collect()
    assert {r.partition: r.next_offset for r in rows} == {0: 2, 1: 4}


def test_start_positions(spark):
    ends = table(spark, [("s", 0, 5, 10), ("t", 0, 1, 2)], "stream string, partition int, begin long, end long")
    groups = table(spark, [("s", "a", "EARLIEST"), ("s", "b", "latest"), ("s", "c", None), ("s", "d", "EARLIEST")], "stream string, consumer string, mode string")
    commits = table(spark, [("s", "d", 0, 7), ("t", "a", 0, 1)], "stream string, consumer string, partition int, next_offset long")
    rows = positions.start_positions(ends, groups, commits).collect()
    assert {r.consumer: r.position for r in rows} == {"a": 5, "b": 10, "c": 10, "d": 7}


def test_demand(spark):
    rows = table(spark, [(-1,), (0,), (3,), (400,), (90000,)], "n long").select("n", positions.demand_limit(F.col("n")).alias("f")).collect()
    assert {r.n: r.f for r in rows} == {-1: None, 0: 0, 3: 10, 400: 400, 90000: 5000}


@pytest.mark.parametrize(
    "blocks, address, ok",
    [
        ([], "1.2.3.4", False),
        (["1.2.3.4/24", "1.2.4.4/24"], "1.2.5.4", False),
        (["1.2.3.4/24", "1.2.4.4/24"], "1.2.3.4", True),
        (["1.2.3.4/24", "1.2.4.4/24"], "1.2.4.4", True),
        (["1.2.3.4/24"], "1.2.3.0", True),
        (["1.2.3.4/24"], "1.2.3.255", True),
        (["0.0.0.0/0"], "200.1.1.1", True),
        (["8.0.0.0/6"], "11.255.255.255", True),
        (["8.0.0.0/6"], "12.0.0.0", False),
        (["1.2.3.4/24"], "not an address", False),
        (["1.2.3.4/24"], None, False),
    ],
)
def test_cidr(spark, blocks, address, ok):
    requests = table(spark, [("s", address)], "stream string, address string")
    listed = table(spark, [("s", b) for b in blocks] + [("other", "0.0.0.0/0")], "stream string, cidr string")
    assert [r.cidr_ok for r in access.cidr_access(requests, listed).collect()] == [ok]


def test_cidr_on_thousands_of_blocks(spark):
    requests = spark.range(3000).select(
        "id", F.concat(F.lit("s"), (F.col("id") % 3).cast("string")).alias("stream"),
        F.concat_ws(".", F.lit("10"), F.col("id") % 5, F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 200), F.lit("1")).alias("address"),
    )
    blocks = spark.range(5000).select(
        F.concat(F.lit("s"), (F.col("id") % 4).cast("string")).alias("stream"),
        F.concat(F.lit("10."), (F.col("id") % 5).cast("string"), F.lit("."), (F.col("id") * 3).cast("string"), F.lit(".0/"), (F.lit(17) + F.col("id") % 16).cast("string")).alias("cidr"),
    )
    found = {r.id: r.cidr_ok for r in access.cidr_access(requests, blocks).collect()}
    listed = {}
    for r in blocks.collect():
        try:
            listed.setdefault(r.stream, set()).add(ipaddress.ip_network(r.cidr, strict=False))
        except ValueError:
            continue
    for r in requests.collect():
        address = ipaddress.ip_address(r.address)
        assert found[r.id] == any(ipaddress.ip_network((address, n), strict=False) in listed[r.stream] for n in range(17, 33)), r
    assert len(found) == 3000 and 0 < sum(found.values()) < 3000


@pytest.mark.parametrize(
    "stream, authenticated, authorities, grants, outcome",
    [
        ("s", False, [], [], "AUTHORISED"),
        ("s", False, [], ["PII"], "UNAUTHORISED"),
        ("s", True, ["AUTHORITY"], [], "AUTHORISED"),
        ("s", True, ["OTHER"], [], "UNAUTHORISED"),
        ("s", True, ["AUTHORITY"], ["PII"], "UNAUTHORISED"),
        ("none", True, ["AUTHORITY"], [], "UNAUTHORISED"),
        ("bare", True, ["AUTHORITY"], [], "UNAUTHORISED"),
        ("all", True, [], ["PII"], "AUTHORISED"),
        ("unknown", True, ["AUTHORITY"], [], "ERROR"),
        ("unknown", False, [], [], "ERROR"),
    ],
)
def test_read_access(spark, stream, authenticated, authorities, grants, outcome):
    requests = table(spark, [(stream, authenticated, authorities, grants)], "stream string, authenticated boolean, authorities array<string>, grants array<string>")
    streams = table(
        spark,
        [("s", {"AUTHORITY": ["PUBLIC"]}), ("none", {}), ("bare", None), ("all", {"*": ["PUBLIC", "PII"]})],
        "stream string, read_authorities map<string,array<string>>",
    )
    assert access.read_access(requests, streams).first().outcome == outcome


@pytest.mark.parametrize("text, grants", [(None, []), ("", []), (",,", []), ("pii,,PUBLIC", ["PII", "PUBLIC"])])
def test_requested_grants(spark, text, grants):
    assert table(spark, [(text,)], "g string").select(access.requested_grants(F.col("g"))).first()[0] == grants


@pytest.mark.parametrize(
    "stream, authenticated, authorities, address, outcome",
    [
        ("s", True, ["A"], "9.9.9.9", "AUTHORISED"),
        ("s", True, ["B"], "1.2.3.4", "UNAUTHORISED"),  # logged in: the address does not help
        ("s", False, ["A"], "9.9.9.9", "UNAUTHORISED"),  # anonymous: the authority does not help
        ("s", False, [], "1.2.3.4", "AUTHORISED"),
        ("open", True, [], "9.9.9.9", "AUTHORISED"),
        ("unknown", True, ["A"], "1.2.3.4", "ERROR"),
    ],
)
def test_write_access(spark, stream, authenticated, authorities, address, outcome):
    requests = table(spark, [(stream, authenticated, authorities, address)], "stream string, authenticated boolean, authorities array<string>, address string")
    streams = table(spark, [("s", ["A"]), ("open", ["*"])], "stream string, authorities array<string>")
    blocks = table(spark, [("s", "1.2.3.0/24")], "stream string, cidr string")
    assert access.write_access(requests, streams, blocks).first().outcome == outcome


def test_admin_access(spark):
    requests = table(
        spark, [(1, True, ["ADMIN"], "9.9.9.9"), (2, True, ["X"], "1.2.3.4"), (3, False, ["ADMIN"], "9.9.9.9"), (4, False, None, "1.2.3.9")],
        "id int, authenticated boolean, authorities array<string>, address string",
    )
    judged = access.admin_access(requests, ["ADMIN"], ["1.2.3.0/24"]).collect()
    assert {r.id: r.outcome for r in judged} == {1: "AUTHORISED", 2: "AUTHORISED", 3: "UNAUTHORISED", 4: "AUTHORISED"}


def test_replica_inventory(spark):
    replicas = table(spark, [(1, "/d", "t", 0, 42), (1, "/d", "t", 1, 7), (1, "/e", "u", 0, 1)], "broker int, log_dir string, topic string, partition int, log_size long")
    leaders = table(spark, [(1, "t", 0, False, True)], "broker int, topic string, partition int, leader boolean, in_sync boolean")
    retention = table(spark, [("t", 1)], "topic string, retention_ms long")
    offsets = table(spark, [("t", 0, 1, 3)], "topic string, partition int, begin long, end long")
    sizes = table(spark, [(1, "t", 0, 12)], "broker int, topic string, partition int, size_on_disk long")
    disks = table(spark, [(1, "/d", 123, 234)], "broker int, log_dir string, free long, total long")
    found = inventory.replica_inventory(replicas, leaders, retention, offsets, sizes, disks)
    rows = {(r.topic, r.partition): r for r in found.collect()}
    full, bare = rows[("t", 0)], rows[("u", 0)]
    assert (full.leader, full.in_sync, full.size_on_disk, full.log_size, full.begin, full.end, full.record_count) == (False, True, 12, 42, 1, 3, 2)
    assert (full.disk_free, full.disk_total, full.retention_ms) == (123, 234, 1)
    assert (bare.leader, bare.in_sync, bare.size_on_disk, bare.record_count, bare.disk_total, bare.retention_ms) == (False, False, 0, 0, 0, 0)
    tree = inventory.inventory_tree(found).first()
    assert [d.log_dir for d in tree.log_dirs] == ["/d", "/e"] and len(tree.log_dirs[0].topics[0].replicas) == 2
    gauges = {(r.metric, r.log_dir): r.value for r in inventory.inventory_gauges(found).where("topic is null").collect()}
    assert gauges[("disk_used", "/d")] == 111 and gauges[("disk_used", "/e")] == 0


def test_exact_percentiles_under_one_hot_size(spark):
    sizes = table(spark, [(100,)] * 98 + [(1,), (1000,)], "n long")
    row = observe.size_distribution(sizes, (), F.col("n")).first()
    assert (row["count"], row.total, row.max, row.p50) == (100, 10801, 1000, 100.0)


def test_client_versions(spark):
    requests = table(
        spark,
        [("/roads/a/messages", "client/1.2.3 (x) lib/2.0 client/9"), ("/roads/a/messages", "client/1.2.3"), ("/elsewhere", "client/1.0"), ("/roads/b/x", None)],
        "uri string, user_agent string",
    )
    rows = observe.client_versions(requests, ["client", "lib", "none"]).collect()
    assert {(r.stream, r.product, r.version): r.requests for r in rows} == {("a", "client", "1-2-3"): 2, ("a", "lib", "2-0"): 1, (None, "client", "1-0"): 1}


@pytest.mark.parametrize(
    "interval, ok",
    [("PT5M", True), ("P1D", True), ("PT4M59S", False), ("PT24H1S", False), ("PT24H", True), (None, True), ("hourly", False), ("P1W", False)],
)
def test_landing_interval(spark, interval, ok):
    assert table(spark, [(interval,)], "i string").select(catalog.interval_ok(F.col("i"))).first()[0] is ok


def test_due_landings(spark):
    streams = table(
        spark,
        [
            ("never", True, "PT1H", None),
            ("broken", True, "PT1H", "yesterday"),
            ("recent", True, "PT1H", "2024-01-01 11:30:00"),
            ("due", True, "PT1H", "2024-01-01 10:59:59"),
            ("edge", True, "PT1H", "2024-01-01 11:00:00"),
            ("off", False, "PT1H", None),
            ("default", True, None, "2024-01-01 10:00:00"),
        ],
        "stream string, hive_enabled boolean, landing_interval string, last_run string",
    )
    now = F.lit("2024-01-01 12:00:00").cast("timestamp")
    assert {r.stream for r in catalog.due_landings(streams, now).collect()} == {"never", "broken", "due", "default"}
    late = catalog.due_landings(streams.where("stream = 'never'"), F.lit("2030-01-01").cast("timestamp"), jitter=True).first()
    assert 3600 <= late.due_at.timestamp() < 7200


def test_own_patch_rule(spark):
    streams = table(spark, [("s", False, True)], "stream string, deleted boolean, topic_created boolean")
    requests = table(
        spark, [("r1", "s", [("replace", "/colour", '"red"')]), ("r2", "s", [("replace", "/colour", "7")])],
        "request_id string, stream string, operations array<struct<op:string,path:string,value:string>>",
    )
    fields = table(spark, [], "stream string, version int, path string, plain_path string, parent_path string, kind string, name string, type string")
    rule = {"/colour": lambda o: F.when(F.schema_of_variant(F.try_parse_json(o["value"])) != "STRING", F.lit("not a colour"))}
    judged = catalog.validate_patches(requests, streams, fields, F.lit(1), rule).collect()
    assert {r.request_id: r.reason for r in judged} == {"r1": None, "r2": "not a colour: /colour"}
    assert catalog.validate_patches(requests, streams, fields, F.lit(1)).first().reason == "not a path to patch: /colour"
