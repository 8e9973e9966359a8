"""Strict admission and masking, case by case."""

import json

import pytest
from pyspark.sql import functions as F

from millrace.functions import avro
from millrace.operators import conform
from millrace.operators.mask import blank, mask_pii
from millrace.plans.ingest import ingest
from millrace.plans.land import landed_rows
from millrace.plans.serve import decode_by_version, join_writer_schema, read_as_latest, serve


def record(*fields):
    return json.dumps({"type": "record", "name": "r", "fields": list(fields)})


def field(name, kind, **more):
    return {"name": name, "type": kind, **more}


def reason(spark, schema, body):
    frame = spark.createDataFrame([(body,)], "body string")
    return conform.conform(frame, schema).first().reason


UNION = record(field("u", ["null", "int", {"type": "record", "name": "a", "fields": [field("x", "string")]}]))


@pytest.mark.parametrize(
    "schema, body, expected",
    [
        (record(field("f", "string")), "{}", "missing:f"),
        (record(field("f", "string")), '{"f":"f16"}', None),
        (record(field("f", "string")), '{"f":1}', "type:f"),
        (record(field("id", "int")), '{"id":0}', None),
        (record(field("id", "int")), '{"id":null}', "null:id"),
        (record(field("id", "int")), '{"id":1.5}', "type:id"),
        (record(field("id", "int")), '{"id":2147483648}', "type:id"),
        (record(field("id", "int")), '{"id":"1"}', "type:id"),
        (record(field("id", "long")), '{"id":2147483648}', None),
        (record(field("d", "double")), '{"d":3}', None),
        (record(field("d", "double")), '{"d":"3"}', "type:d"),
        (record(field("b", "boolean")), '{"b":"true"}', "type:b"),
        (record(field("b", "boolean", default=True)), "{}", None),
        (record(field("f", ["null", "string"])), "{}", None),
        (record(field("f", ["null", "string"])), '{"f":null}', None),
        (record(field("f", ["string", "null"])), '{"f":3}', "type:f"),
        (record(field("f", "string")), "[1]", "not an object"),
        (record(field("f", "string")), "7", "not an object"),
        (record(field("f", "string")), "{", "unparseable"),
        (record(field("f", "string")), '{"f":"x","more":1}', None),
        (record(field("a", {"type": "array", "items": "int"})), '{"a":[1,2]}', None),
        (record(field("a", {"type": "array", "items": "int"})), '{"a":[1,"2"]}', "type:a"),
        (record(field("m", {"type": "map", "values": "string"})), '{"m":{"a":"b"}}', None),
        (record(field("m", {"type": "map", "values": "string"})), '{"m":{"a":1}}', "type:m"),
        (record(field("e", {"type": "enum", "name": "e", "symbols": ["A", "B"]})), '{"e":"B"}', None),
        (record(field("e", {"type": "enum", "name": "e", "symbols": ["A", "B"]})), '{"e":"C"}', "type:e"),
        (record(field("x", {"type": "fixed", "name": "x", "size": 2})), '{"x":"ab"}', None),
        (record(field("x", {"type": "fixed", "name": "x", "size": 2})), '{"x":"abc"}', "type:x"),
        (record(field("r", {"type": "record", "name": "n", "fields": [field("y", "int")]})), '{"r":{}}', "type:r"),
        (record(field("r", {"type": "record", "name": "n", "fields": [field("y", "int")]})), '{"r":{"y":1}}', None),
        (UNION, '{"u":5}', None),
        (UNION, '{"u":{"x":"s"}}', None),
        (UNION, '{"u":"s"}', "type:u"),
    ],
)
def test_conform(spark, schema, body, expected):
    assert reason(spark, schema, body) == expected


def test_typed_values_and_defaults(spark):
    schema = record(
        field("b", "boolean", default=True),
        field("raw", "bytes"),
        field("when", {"type": "long", "logicalType": "timestamp-millis"}),
        field("tags", {"type": "array", "items": "string"}, default=["x"]),
        field("in", {"type": "record", "name": "i", "fields": [field("n", "long", default=4)]}),
    )
    row = read_as_latest(spark.createDataFrame([('{"raw":"\\u00ff","when":0,"in":{}}',)], "body string"), schema).first().message
    assert row.b is True and bytes(row.raw) == b"\xff" and row.when.timestamp() == 0 and row.tags == ["x"] and row["in"].n == 4


def test_union_members(spark):
    rows = read_as_latest(spark.createDataFrame([('{"u":5}',), ('{"u":{"x":"s"}}',), ('{"u":null}',)], "body string"), UNION).collect()
    found = [r.message.u for r in rows]
    assert (found[0].branch_0, found[0].branch_1) == (5, None) and found[1].branch_1.x == "s" and found[2] is None


def test_responses_keep_their_place(spark):
    frame = spark.createDataFrame([(0, '{"f":"a"}'), (1, "{}"), (2, '{"f":"b"}')], "pos int, body string")
    done = ingest(frame, record(field("f", "string")), 1, ["pos"], "$.f")
    answers = {r.pos: (r.success, r.answer) for r in done.responses.collect()}
    assert answers == {0: (True, "Message accepted."), 1: (False, "missing:f"), 2: (True, "Message accepted.")}
    assert done.accepted.count() == 2 and done.rejected.first().reason == "missing:f"
    assert {r.schema_version for r in done.accepted.collect()} == {1}


PII = {"sensitivity": "PII"}
NESTED = record(
    field("f1", "string", **PII),
    field("rec", {"type": "record", "name": "a", "fields": [field("f2", "string", **PII), field("keep", "string")]}),
    field("arr", {"type": "array", "items": {"type": "record", "name": "b", "fields": [field("f2", ["null", "string"], **PII)]}}),
    field("map", {"type": "map", "values": {"type": "record", "name": "c", "fields": [field("f2", "string", **PII)]}}),
    field("opt", ["null", {"type": "record", "name": "d", "fields": [field("f1", "bytes", **PII)]}]),
)
BODY = '{"f1":"s","rec":{"f2":"t","keep":"k"},"arr":[{"f2":"u"},{"f2":null},{}],"map":{"x":{"f2":"v"}},"opt":{"f1":"w"}}'


def test_mask_everywhere(spark):
    typed = read_as_latest(spark.createDataFrame([(BODY,), ("{}",)], "body string"), NESTED)
    full, empty = (r.message for r in mask_pii(typed).collect())
    assert full.f1 == "" and full.rec.f2 == "" and full.rec.keep == "k"
    assert [e.f2 for e in full.arr] == ["", None, None]
    assert full.map["x"].f2 == "" and bytes(full.opt.f1) == b""
    assert empty.f1 is None and empty.rec is None and empty.arr is None and empty.opt is None


def test_mask_granted_changes_nothing(spark):
    typed = read_as_latest(spark.createDataFrame([(BODY,)], "body string"), NESTED)
    assert mask_pii(typed, {"pii"}) is typed


def test_mask_case_of_the_tag_and_replacer(spark):
    schema = record(field("a", "string", sensitivity="pii"), field("b", "string", sensitivity="PUBLIC"))
    typed = read_as_latest(spark.createDataFrame([('{"a":"x","b":"y"}',)], "body string"), schema)
    row = mask_pii(typed, replacer=lambda c: F.concat(F.lit("#"), F.upper(c))).first().message
    assert (row.a, row.b) == ("#X", "y")
    assert mask_pii(typed, replacer=blank).first().message.a == ""


def test_union_siblings_are_masked_too(spark):
    schema = record(
        field(
            "u",
            [
                "null",
                {"type": "record", "name": "a", "fields": [field("s", "string", **PII), field("p", "int")]},
                {"type": "record", "name": "b", "fields": [field("s", "string"), field("q", "int")]},
            ],
        )
    )
    typed = read_as_latest(spark.createDataFrame([('{"u":{"s":"x","q":1}}',)], "body string"), schema)
    assert mask_pii(typed).first().message.u.branch_1.s == ""


def test_landed_columns_are_masked(spark):
    schema = record(field("p", "string", **PII), field("n", "string"), field("pb", "bytes", **PII), field("nb", "bytes"))
    log = spark.createDataFrame([(0, 0, 1, '{"p":"a","n":"b","pb":"\\u0000","nb":"\\u0001"}')], "partition int, offset long, schema_version int, body string")
    row = landed_rows(log, schema).first()
    assert (row.p, row.n, bytes(row.pb), bytes(row.nb)) == ("", "b", b"", b"\x01")


def test_serve_own_schema(spark):
    v1, v2 = record(field("f", "string", **PII)), record(field("f", "string"), field("g", "int", default=7))
    log = spark.createDataFrame(
        [(0, 0, 5, 1, '{"f":"x"}'), (0, 1, 6, 2, '{"f":"y","g":1}'), (0, 2, 7, 2, '{"f":"z"}'), (0, 3, 8, 9, "{}")],
        "partition int, offset long, ts_ms long, schema_version int, body string",
    )
    assert [r.payload for r in serve(log, {1: v1, 2: v2}).orderBy("offset").collect()] == ['{"f":""}', '{"f":"y","g":1}', '{"f":"z","g":7}', None]
    assert serve(log, {1: v1, 2: v2}, {"PII"}).orderBy("offset").first().payload == '{"f":"x"}'
    decoded = decode_by_version(log, {1: v1, 2: v2}).orderBy("offset").collect()
    assert decoded[0].decoded.v1.f == "x" and decoded[0].decoded.v2 is None and decoded[1].decoded.v2.g == 1


def test_writer_schema_errors(spark):
    records = spark.createDataFrame([("a", 1), ("a", 9), ("b", 1)], "stream string, schema_version int")
    schemas = spark.createDataFrame([("a", 1, "{}")], "stream string, version int, schema_json string")
    rows = join_writer_schema(records, schemas).collect()
    assert {(r.stream, r.schema_version): r.error for r in rows} == {("a", 1): None, ("a", 9): "unknown version", ("b", 1): "unknown stream"}


def test_metadata_reaches_the_schema():
    kinds = avro.spark_type(avro.load(NESTED))
    assert kinds["f1"].metadata == PII and kinds["rec"].dataType["keep"].metadata == {}
