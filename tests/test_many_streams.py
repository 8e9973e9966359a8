"""Work on many streams at once: by the registry, in one pass, as streams."""

import json

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from millrace.operators import registry
from millrace.plans.ingest import admit_by_registry
from millrace.plans.serve import decode_by_registry
from millrace.sources.log import bounded_offset_scan, log_stream
from millrace.streaming import jobs

REGISTRY = "stream string, version int, schema_json string, deleted boolean"
CATALOG = "stream string, enabled boolean, partition_path string"


def record(*fields):
    return json.dumps({"type": "record", "name": "r", "fields": [{"name": n, "type": t} for n, t in fields]})


def test_many_schemas_one_scan(spark):
    """A hundred schemas: every record is decoded by its own, and the records are read once."""
    many, rows = 100, 1200
    schemas = spark.createDataFrame([(f"s{k}", 1, record((f"f{k}", "long"))) for k in range(many)], "stream string, version int, schema_json string")
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    body = F.concat(F.lit('{"f'), (F.col("id") % many).cast("string"), F.lit('":'), F.col("id").cast("string"), F.lit("}"))
    raw = spark.range(rows).select("id", F.concat(F.lit("s"), (F.col("id") % many).cast("string")).alias("stream"), F.lit(1).alias("schema_version"), body.alias("body"))
    out = decode_by_registry(raw.mapInPandas(count, raw.schema), schemas).collect()
    assert read.value == rows == len(out)
    assert all(r.error is None and json.loads(r.payload) == {f"f{r.id % many}": r.id} for r in out)


def test_a_hot_schema_is_dealt_to_many_tasks(spark):
    schemas = spark.createDataFrame([("a", 1, record(("k", "int")))], "stream string, version int, schema_json string")
    records = spark.range(4000).select(F.lit("a").alias("stream"), F.lit(1).alias("schema_version"), F.to_json(F.struct(F.col("id").alias("k"))).alias("body"))
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(setting, "false")  # else so few rows are put together again
    try:
        parts = decode_by_registry(records, schemas).select(F.input_file_name().alias("f")).distinct().count()
    finally:
        spark.conf.unset(setting)
    assert parts > 4


def test_newest_schema_by_rules(spark):
    rows = [("a", 1, "x", False), ("a", 2, "y", True), ("a", None, "z", False), ("b", 3, "x", False), ("b", 3, "y", False), ("c", None, "x", False), ("d", 1, "x", True)]
    found = registry.newest_schemas(spark.createDataFrame(rows, REGISTRY)).collect()
    assert {(r.stream, r.version, r.ambiguous) for r in found} == {("a", 1, False), ("b", 3, True)}


def test_admission_by_registry(spark):
    schemas = spark.createDataFrame(
        [("a", 1, record(("k", "int")), False), ("b", 1, record(("k", "int")), False), ("bad", 1, "{", False), ("two", 1, "x", False), ("two", 1, "y", False)],
        REGISTRY,
    )
    catalog = spark.createDataFrame([("a", True, "$.k"), ("b", True, None), ("bad", True, None), ("two", True, None), ("off", False, None), ("new", True, None)], CATALOG)
    bodies = [("a", '[{"k":1},{"k":"x"},null,{"k":1,"l":2}]'), ("b", "[]"), ("b", '{"k":1}'), ("b", "nonsense"), ("b", None)]
    bodies += [(s, '[{"k":1}]') for s in ("bad", "two", "off", "new", "unknown")] + [(None, '[{"k":1}]')]
    requests = spark.createDataFrame([(k, s, b) for k, (s, b) in enumerate(bodies)], "request_id long, stream string, body string")
    out = admit_by_registry(requests, catalog, schemas).collect()
    told = {(r.request_id, r.pos): r.reason for r in out}
    assert told == {
        (0, 0): None, (0, 1): "type:k", (0, 2): "not an object", (0, 3): None, (1, None): "not an array", (2, None): "not an array", (3, None): "not an array",
        (4, None): "not an array", (5, 0): "unreadable schema", (6, 0): "ambiguous schema", (7, 0): "disabled", (8, 0): "no schema", (9, 0): "unknown stream",
        (10, 0): "unknown stream",
    }
    placed = {(r.request_id, r.pos): r.partition for r in out}
    assert placed[0, 0] == placed[0, 3] is not None and placed[0, 1] is None and placed[5, 0] is None


def test_a_batch_that_fails_and_runs_again(spark, path):
    """The registry can't be read at first: nothing is answered; then every element is answered and logged once, and the next
    batch goes on from there."""
    schemas = spark.createDataFrame([("a", 1, record(("k", "int")), False)], REGISTRY)
    catalog = spark.createDataFrame([("a", True, "$.k")], CATALOG)
    fail = [True]

    def listed(_):
        if fail[0]:
            raise OSError("the registry is away")
        return schemas

    folders = {name: path(name) for name in ("log", "answers", "checkpoint")}
    shape = "request_id long, stream string, body string"

    def run(first, last):
        rows = [(k, "a", json.dumps([{"k": k % 3}, {"k": None}])) for k in range(first, last)]
        spark.createDataFrame(rows, shape).write.mode("append").parquet(path("requests"))
        again()

    def again():
        stream = log_stream(spark, path("requests"), spark.createDataFrame([], shape).schema)
        jobs.ingest_many_stream(stream, catalog=lambda _: catalog, schemas=listed, **folders).awaitTermination()

    with pytest.raises(StreamingQueryException):
        run(0, 40)
    fail[0] = False
    again()
    run(40, 70)
    answers = spark.read.parquet(folders["answers"]).collect()
    assert sorted((r.request_id, r.pos, r.success) for r in answers) == sorted((k, p, p == 0) for k in range(70) for p in (0, 1))
    logged = spark.read.parquet(folders["log"]).collect()
    assert sorted(r.request_id for r in logged) == list(range(70))
    for partition in {r.partition for r in logged}:
        own = sorted((r.offset, r.request_id) for r in logged if r.partition == partition)
        assert [o for o, _ in own] == list(range(len(own)))
        assert [k for _, k in own] == sorted(k for _, k in own)


def test_several_ranges_of_a_partition(spark):
    log = spark.range(100).select((F.col("id") % 2).cast("int").alias("partition"), F.floor(F.col("id") / 2).cast("bigint").alias("offset"))

    def read(ranges):
        return sorted((r.partition, r.offset) for r in bounded_offset_scan(log, ranges).collect())

    assert read("0:0,5;0:10,15") == [(0, k) for k in (*range(5), *range(10, 15))]
    assert read("0:0,5;0:3,7;1:2,2;1:49,60") == [*[(0, k) for k in range(7)], (1, 49)]
    rows = spark.createDataFrame([(1, 3, 5), (1, 7, 8), (400_000_000, 0, 1)], "partition int, start long, end long")
    assert read(rows) == [(1, 3), (1, 4), (1, 7)]


def test_a_null_version_stops_no_compatibility_report(spark):
    rows = [("a", 1, record(("k", "int"))), ("a", 2, record(("k", "string"))), ("b", None, record(("k", "int")))]
    schemas = spark.createDataFrame(rows, "stream string, version int, schema_json string").withColumn("deleted", F.lit(False))
    pairs = spark.createDataFrame([("a", 2, 1)], "stream string, reader int, writer int")
    faults = registry.read_faults(registry.schema_fields(schemas), pairs).collect()
    assert [(r.stream, r.path, r.fault) for r in faults] == [("a", "/k", "type")]
