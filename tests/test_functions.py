"""Key paths, offset specs, durations, addresses, agents and framing."""

import pytest
from pyspark.sql import functions as F

from millrace.functions import agents, durations, envelope, keypath, net, offsets


@pytest.mark.parametrize(
    "path, expected",
    [
        ("$", []),
        ('$["a"]', ["a"]),
        ('$["a.b"]["cd"]', ["a.b", "cd"]),
        ("$.a.bc.d", ["a", "bc", "d"]),
        ('$.a["b-c"].d_1', ["a", "b-c", "d_1"]),
        ("  $.a ", ["a"]),
        ("", None),
        (None, None),
        ("   ", None),
    ],
)
def test_key_path_steps(path, expected):
    assert keypath.steps(path) == expected


@pytest.mark.parametrize("path", ['$[""]', "a", "$a", "$.", "$.a.", "$.-a", '$["a"', "$.a b", "$..a"])
def test_key_path_errors(spark, path):
    with pytest.raises(keypath.KeyPathError):
        keypath.steps(path)
    assert spark.createDataFrame([(path,)], "p string").select(keypath.key_steps(F.col("p"))).first()[0] is None


def test_key_path_columns_agree(spark):
    paths = ["$", '$["a.b"]["cd"]', "$.a.bc.d", '$.a["b-c"].d_1']
    rows = spark.createDataFrame([(p,) for p in paths], "p string").select("p", keypath.key_steps(F.col("p")).alias("s"))
    assert {r.p: r.s for r in rows.collect()} == {p: keypath.steps(p) for p in paths}


@pytest.mark.parametrize(
    "path, state, key",
    [
        ("$.a.b.c", "value", "1"),
        ("$.a.b", "value", '{"c":1}'),
        ("$.a.x", "missing", None),
        ("$.a.b.c.d", "missing", None),
        ("$.n", "null", "null"),
        ("$", "value", '{"a":{"b":{"c":1}},"n":null}'),
    ],
)
def test_key_node(spark, path, state, key):
    node = keypath.key_node(F.try_parse_json(F.lit('{"a":{"b":{"c":1}},"n":null}')), path)
    row = spark.range(1).select(
        F.when(node.isNull(), "missing").when(F.is_variant_null(node), "null").otherwise("value").alias("state"),
        F.to_json(node).alias("key"),
    ).first()
    assert (row.state, row.key) == (state, key)


def test_key_hash_spreads_missing_and_pins_null(spark):
    bodies = spark.range(4000).select(F.when(F.col("id") % 2 == 0, "{}").otherwise('{"k":null}').alias("body"), "id")
    node = keypath.key_node(F.try_parse_json("body"), "$.k")
    placed = bodies.select("body", keypath.partition_number(keypath.key_hash(node, F.col("id").cast("string")), 8).alias("p"))
    spread = {r.body: (r.parts, r.biggest) for r in placed.groupBy("body", "p").count().groupBy("body").agg(F.count("*").alias("parts"), F.max("count").alias("biggest")).collect()}
    assert spread['{"k":null}'] == (1, 2000)
    assert spread["{}"][0] == 8 and spread["{}"][1] < 400


def test_offset_spec_both_ways(spark):
    spec = "0:123,234;1:124,235"
    rows = spark.range(1).select(F.explode(offsets.parse_offset_spec(F.lit(spec))).alias("r")).select("r.*")
    assert [tuple(r) for r in rows.collect()] == [(0, 123, 234), (1, 124, 235)]
    assert rows.agg(offsets.format_offset_spec(F.col("partition"), F.col("start"), F.col("end"))).first()[0] == spec


@pytest.mark.parametrize(
    "text, seconds",
    [
        ("PT1H", 3600.0),
        ("PT5M", 300.0),
        ("P1D", 86400.0),
        ("P1DT2H3M4.5S", 93784.5),
        ("pt30s", 30.0),
        ("-PT1H", -3600.0),
        ("PT-1H", -3600.0),
        ("P", None),
        ("PT", None),
        ("1H", None),
        ("P1Y", None),
        (None, None),
    ],
)
def test_durations(spark, text, seconds):
    frame = spark.createDataFrame([(text,)], "t string")
    assert frame.select(durations.duration_seconds(F.col("t"))).first()[0] == seconds


@pytest.mark.parametrize(
    "block, low, high",
    [
        ("1.2.3.4/24", "1.2.3.0", "1.2.3.255"),
        ("10.0.0.0/8", "10.0.0.0", "10.255.255.255"),
        ("1.2.3.4/32", "1.2.3.4", "1.2.3.4"),
        ("1.2.3.4/0", "0.0.0.0", "255.255.255.255"),
    ],
)
def test_blocks(spark, block, low, high):
    row = spark.range(1).select(
        net.block_range(F.lit(block)).alias("r"), net.address_number(F.lit(low)).alias("lo"), net.address_number(F.lit(high)).alias("hi")
    ).first()
    assert (row.r.lo, row.r.hi) == (row.lo, row.hi)


@pytest.mark.parametrize("block", ["1.2.3.4", "1.2.3.4/33", "1.2.3/8", "256.1.1.1/8", "banana", "", None])
def test_bad_blocks(spark, block):
    assert spark.createDataFrame([(block,)], "b string").select(net.block_range(F.col("b"))).first()[0] is None


@pytest.mark.parametrize(
    "agent, tokens",
    [
        ("a/1.0 (b) c/2.0", [("a", "1.0", "b"), ("c", "2.0", None)]),
        (
            "Mozilla/5.0 (X11; Linux x86_64) AppleWebKit/534.30 (KHTML, like Gecko) Version/4.0 Safari/534.30",
            [
                ("Mozilla", "5.0", "X11; Linux x86_64"),
                ("AppleWebKit", "534.30", "KHTML, like Gecko"),
                ("Version", "4.0", None),
                ("Safari", "534.30", None),
            ],
        ),
        ("a/1.0 (x (y) b/2 (z/9)", [("a", "1.0", "x (y"), ("b", "2", "z/9")]),
        (None, []),
        ("nothing here", []),
    ],
)
def test_agent_tokens(spark, agent, tokens):
    row = spark.createDataFrame([(agent,)], "a string").select(agents.agent_tokens(F.col("a"))).first()[0]
    assert [tuple(t) for t in row] == tokens
    short = spark.createDataFrame([(agent,)], "a string").select(agents.agent_products(F.col("a"))).first()[0]
    assert [tuple(t) for t in short] == [t[:2] for t in tokens]


def test_envelope(spark):
    framed = envelope.add_envelope(F.lit(b"body"), F.lit(258))
    row = spark.range(1).select(framed.alias("v"), envelope.split_envelope(framed).alias("e")).first()
    assert bytes(row.v) == b"\x00\x00\x00\x01\x02body"
    assert (row.e.format_version, row.e.schema_version, bytes(row.e.body)) == (0, 258, b"body")
    assert spark.range(1).select(envelope.split_envelope(F.lit(b"\x00\x01"))).first()[0] is None


@pytest.mark.parametrize(
    "value, kind, data",
    [(b"\x01xy", "data", b"xy"), (b"\x01", "data", b""), (b"\x02", "null", None), (b"\x00zz", "skip", None), (b"\x09", "invalid", None), (None, "tombstone", None)],
)
def test_nullable_values(spark, value, kind, data):
    row = spark.createDataFrame([(value,)], "v binary").select(envelope.unwrap_nullable(F.col("v")).alias("u")).first().u
    assert (row.kind, None if row.data is None else bytes(row.data)) == (kind, data)
