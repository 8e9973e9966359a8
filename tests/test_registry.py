"""Schema rules, compatibility, versions, key paths."""

import json

import pytest
from pyspark.sql import functions as F

from millrace.operators import registry


def record(*fields):
    return json.dumps({"type": "record", "name": "r", "fields": list(fields)})


def field(name, kind, **more):
    return {"name": name, "type": kind, **more}


N, S, SD, TEXT = record(), record(field("f", "string")), record(field("f", "string", default="foo")), '"string"'


def compat(spark, candidate, existing):
    versions = [("s", i + 1, text, False) for i, text in enumerate([*existing, candidate])]
    schemas = spark.createDataFrame(versions, "stream string, version int, schema_json string, deleted boolean")
    newest = schemas.where(F.col("version") == len(versions))
    rows = registry.compat_report(newest, schemas, registry.schema_fields(schemas)).collect()
    assert {r.version for r in rows} == {len(versions)}
    return {r["mode"]: r.ok for r in rows}


@pytest.mark.parametrize(
    "mode, candidate, existing, ok",
    [
        ("CAN_READ_ALL", S, [SD, SD], True),
        ("CAN_READ_ALL", S, [N, SD], False),
        ("CAN_READ_LATEST", S, [SD], True),
        ("CAN_READ_LATEST", S, [N], False),
        ("CAN_READ_LATEST", S, [N, SD], True),
        ("CAN_BE_READ_BY_ALL", SD, [N, S], True),
        ("CAN_BE_READ_BY_ALL", S, [TEXT], False),
        ("CAN_BE_READ_BY_LATEST", SD, [TEXT, S], True),
        ("CAN_BE_READ_BY_LATEST", S, [TEXT], False),
        ("MUTUAL_READ_ALL", SD, [SD, SD], True),
        ("MUTUAL_READ_ALL", SD, [TEXT, SD], False),
        ("MUTUAL_READ_LATEST", SD, [TEXT, SD], True),
        ("MUTUAL_READ_LATEST", SD, [TEXT], False),
        ("CAN_READ_ALL", S, [], True),
    ],
)
def test_compatibility_modes(spark, mode, candidate, existing, ok):
    assert compat(spark, candidate, existing)[mode] is ok


@pytest.mark.parametrize(
    "reader, writer, faults",
    [
        (record(field("a", "long")), record(field("a", "int")), []),
        (record(field("a", "int")), record(field("a", "long")), [("/a", "type")]),
        (record(field("a", "bytes")), record(field("a", "string")), []),
        (record(field("a", ["null", "long"])), record(field("a", "int")), []),
        (record(field("a", "int")), record(field("a", ["null", "int"])), [("/a", "type")]),
        (record(field("new", "int", aliases=["old"])), record(field("old", "int")), []),
        (record(field("a", {"type": "enum", "name": "e", "symbols": ["A"]})), record(field("a", {"type": "enum", "name": "e", "symbols": ["A", "B"]})), [("/a", "symbols")]),
        (
            record(field("r", {"type": "record", "name": "x", "fields": [field("a", "int"), field("b", "int")]})),
            record(field("r", {"type": "record", "name": "x", "fields": [field("a", "int")]})),
            [("/r/b", "missing")],
        ),
        (record(field("a", {"type": "array", "items": "int"})), record(field("a", {"type": "array", "items": "string"})), [("/a/*", "type")]),
        (record(field("r", {"type": "record", "name": "x", "fields": [field("a", "int")]})), record(), [("/r", "missing")]),
    ],
)
def test_read_faults(spark, reader, writer, faults):
    schemas = spark.createDataFrame([("s", 1, writer), ("s", 2, reader)], "stream string, version int, schema_json string")
    pairs = spark.createDataFrame([("s", 2, 1)], "stream string, reader int, writer int")
    rows = registry.read_faults(registry.schema_fields(schemas), pairs).collect()
    assert sorted((r.path, r.fault) for r in rows) == faults


def rules(spark, schema, strict=False):
    frame = spark.createDataFrame([("s", 1, schema)], "stream string, version int, schema_json string")
    return sorted(r.rule for r in registry.schema_rules(registry.schema_fields(frame), strict).collect())


PII = {"sensitivity": "PII"}


@pytest.mark.parametrize(
    "schema, strict, broken",
    [
        ('"bytes"', False, ["root-not-record"]),
        ("{", False, ["unreadable"]),
        ('{"type":"record","name":"r","fields":[{"name":"a","type":"nope"}]}', False, ["unreadable"]),
        (record(field("acquisition_instant", "long")), False, ["reserved-name"]),
        (record(field("a", "long", aliases=["Acquisition_Instant"])), False, ["reserved-name"]),
        (record(field("r", {"type": "record", "name": "x", "fields": [field("acquisition_instant", "long")]})), False, []),
        (record(field("a", ["int", "null"])), True, []),
        (record(field("a", ["null", "int"])), True, []),
        (record(field("a", {"type": "map", "values": ["null", "int"]})), True, []),
        (record(field("a", ["int"])), True, ["union-not-nullable"]),
        (record(field("a", ["int"])), False, []),
        (record(field("a", ["int", "long"])), True, ["union-not-nullable"]),
        (record(field("a", ["int", "long", "null"])), True, ["union-not-nullable"]),
        (record(field("a", {"type": "array", "items": ["int", "long"]})), True, ["union-not-nullable"]),
        (record(field("a", ["bytes", "string"])), False, ["union-bytes-string"]),
        (record(field("a", "string", **PII)), True, []),
        (record(field("a", ["null", "bytes"], **PII)), True, []),
        (record(field("a", {"type": "map", "values": "string"}, **PII)), True, ["pii-not-text"]),
        (record(field("a", ["null", "int"], **PII)), True, ["pii-not-text"]),
        (record(field("a", {"type": "string", **PII})), True, ["pii-on-type"]),
        (record(field("a", {"type": "int", "logicalType": "date"})), True, []),
        (record(field("a", {"type": "string", "logicalType": "date"})), True, ["logical-type-invalid"]),
        (record(field("a", {"type": "map", "values": "int"}, logicalType="date")), True, ["logical-type-on-field"]),
        (record(field("a", {"type": "bytes", "logicalType": "decimal", "precision": 2, "scale": 3})), True, ["logical-type-invalid"]),
        (record(field("a", {"type": "bytes", "logicalType": "custom"})), True, []),
    ],
)
def test_schema_rules(spark, schema, strict, broken):
    assert rules(spark, schema, strict) == broken


@pytest.mark.parametrize(
    "new, current, exposed",
    [
        (record(field("a", "string", **PII)), record(field("a", "string")), ["/a"]),
        (record(field("a", "string", **PII)), record(field("a", "string", **PII)), []),
        (record(field("a", "string", **PII)), None, []),
        (record(field("a", "string"), field("b", "string", **PII)), record(field("a", "string")), []),
        (
            record(field("l", {"type": "array", "items": {"type": "record", "name": "x", "fields": [field("a", "string", **PII)]}})),
            record(field("l", {"type": "array", "items": {"type": "record", "name": "x", "fields": [field("a", "string")]}})),
            ["/l/*/a"],
        ),
    ],
)
def test_pii_evolution(spark, new, current, exposed):
    frame = lambda rows: registry.schema_fields(spark.createDataFrame(rows, "stream string, version int, schema_json string"))
    old = [("s", 1, current)] if current else []
    rows = registry.pii_evolution_check(frame([("s", 2, new)]), frame(old or [("other", 1, N)])).collect()
    assert [r.path for r in rows] == exposed


X = {"type": "record", "name": "x", "fields": [field("b", {"type": "record", "name": "y", "fields": [field("c", "int")]})]}
Y = {"type": "record", "name": "z", "fields": [field("b", "int")]}


@pytest.mark.parametrize(
    "path, kind, faults",
    [
        ("$", "int", []),
        ("", "int", []),
        (None, "int", []),
        ("$.a", "int", []),
        ("$.a.b.c", X, []),
        ('$.a.b["c"]', {"type": "map", "values": "int"}, [("/a", "not traversable: map")]),
        ("$.a.b.c", {"type": "array", "items": X}, [("/a", "not traversable: array")]),
        ("$.a.b.c", [X, "int"], [("/a/1", "not traversable: int")]),
        ("$.a.b", [X, Y], []),
        ("$.a.b.c", [X, Y], [("/a/1/b", "not traversable: int")]),
        ("$.z", X, [("", "no field: z")]),
        ("$.a.z", X, [("/a", "no field: z")]),
        ("a.b", X, [("", "syntax")]),
    ],
)
def test_key_paths(spark, path, kind, faults):
    schemas = spark.createDataFrame([("s", 1, record(field("a", kind)))], "stream string, version int, schema_json string")
    paths = spark.createDataFrame([("s", path)], "stream string, partition_path string")
    rows = registry.key_path_check(paths, registry.schema_fields(schemas)).collect()
    assert sorted((r.location, r.fault) for r in rows) == faults


def test_versions(spark):
    schemas = spark.createDataFrame(
        [("a", 1, "x", False), ("a", 2, "y", False), ("a", 3, "z", True), ("b", 5, "w", True)],
        "stream string, version int, schema_json string, deleted boolean",
    )
    assert [tuple(r) for r in registry.latest_active_schema(schemas).collect()] == [("a", 2, "y")]
    streams = spark.createDataFrame([("a",), ("b",), ("c",)], "stream string")
    assert {r.stream: r.next_version for r in registry.next_version(streams, schemas).collect()} == {"a": 4, "b": 6, "c": 1}
    asked = spark.createDataFrame([("a", "2"), ("a", "3"), ("a", "latest"), ("b", "5"), ("a", "two")], "stream string, version string")
    reasons = {(r.stream, r.version): r.reason for r in registry.deletable_version(schemas, asked).collect()}
    assert reasons[("a", "2")] is None and reasons[("a", "3")] == "not the latest version"
    assert reasons[("a", "latest")] == "version must be explicit" and reasons[("b", "5")] == "no active schema" and reasons[("a", "two")] == "not a version"


def test_forms_made_of_texts_and_of_nodes_agree(spark):
    """What reading doesn't depend on leaves the print as it is; the report is the same from texts and from nodes."""
    plain = record(field("a", ["null", "long"], default=None), field("e", {"type": "enum", "name": "e", "symbols": ["B", "A"]}))
    turned = record(field("e", {"type": "enum", "name": "other", "symbols": ["A", "B"]}), field("a", ["null", "long"], default=None, **PII))
    unlike = record(field("a", ["null", "int"], default=None), field("e", {"type": "enum", "name": "e", "symbols": ["A"]}))
    texts = [plain, turned, unlike, "{", record(field("a", ["null", X, Y]))]
    versions = [(f"s{k}", v + 1, texts[(k + v) % 5], v == 1) for k in range(5) for v in range(4)]
    versions += [("hot", v + 1, texts[v % 3], False) for v in range(40)] + [("hot", None, plain, False), ("lone", 1, plain, False)]
    schemas = spark.createDataFrame(versions, "stream string, version int, schema_json string, deleted boolean")
    forms = registry.schema_forms(schemas.where("stream = 's0'").drop("deleted")).collect()
    prints = {f.version: f["print"] for f in forms}
    assert prints[1] == prints[2] != prints[3]
    newest = registry.latest_active_schema(schemas)
    texts_say = {tuple(r) for r in registry.compat_report(newest, schemas).collect()}
    nodes_say = {tuple(r) for r in registry.compat_report(newest, schemas, registry.schema_fields(schemas)).collect()}
    assert texts_say == nodes_say and len(texts_say) == 6 * 7
    assert ("lone", 1, "MUTUAL_READ_ALL", True) in texts_say and ("hot", 40, "MUTUAL_READ_ALL", False) in texts_say


def test_report_of_no_candidates(spark):
    empty = spark.createDataFrame([], "stream string, version int, schema_json string, deleted boolean")
    assert registry.compat_report(empty, empty).collect() == []
