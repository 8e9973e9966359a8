"""Patch folds and keyed logs against plain Python."""

import json
import random

import pytest
from pyspark.sql import functions as F

from millrace.functions.jsonpatch import MISSING, PatchError, apply_set
from millrace.operators import model
from millrace.sources import log as logs

PATCH = "document_id string, seq long, operations array<struct<op:string,path:string,value:string>>"


def run(document, *operations):
    return apply_set(document, [(o, p, None if v is None else json.dumps(v)) for o, p, v in operations])


@pytest.mark.parametrize(
    "document, operations, expected",
    [
        (None, [("add", "", {"name": "r"})], {"name": "r"}),
        ({"a": 1}, [("add", "/d", "x")], {"a": 1, "d": "x"}),
        ({"d": "x"}, [("replace", "/d", "y")], {"d": "y"}),
        ({"d": "x", "a": 1}, [("remove", "/d", None)], {"a": 1}),
        ({"d": "x"}, [("remove", "", None)], MISSING),
        (None, [("remove", "", None)], MISSING),
        ({"l": [1, 3]}, [("add", "/l/1", 2), ("add", "/l/-", 4)], {"l": [1, 2, 3, 4]}),
        ({"l": [1, 3]}, [("remove", "/l/0", None)], {"l": [3]}),
        ({"a/b": {"c~d": 1}}, [("replace", "/a~1b/c~0d", 2)], {"a/b": {"c~d": 2}}),
        ({"a": 1}, [("ADD", "/a", None)], {"a": None}),
    ],
)
def test_apply(document, operations, expected):
    found = run(document, *operations)
    assert found is expected if expected is MISSING else found == expected


@pytest.mark.parametrize(
    "document, operation",
    [
        ({}, ("remove", "/x", None)),
        ({}, ("replace", "/x", 1)),
        ({}, ("add", "/x/y", 1)),
        (None, ("add", "/x", 1)),
        ({"l": [1]}, ("add", "/l/2", 1)),
        ({"l": [1]}, ("replace", "/l/1", 1)),
        ({"l": [1]}, ("remove", "/l/01", None)),
        ({"a": 1}, ("add", "/a/b", 1)),
        ({}, ("move", "/x", None)),
        ({}, ("add", "x", 1)),
    ],
)
def test_apply_fails_whole(document, operation):
    before = json.dumps(document)
    with pytest.raises(PatchError):
        run(document, ("add", "", document), operation)
    assert json.dumps(document) == before


def brute(rows):
    documents, failures = {}, []
    for doc, seq, operations in sorted(rows, key=lambda r: r[1]):
        before = json.dumps(documents.get(doc), sort_keys=True)
        try:
            if not operations or None in [x for op, path, _ in operations for x in (op, path)]:
                raise PatchError("nothing to try")
            found = apply_set(documents.get(doc), operations)
        except (PatchError, ValueError):
            assert json.dumps(documents.get(doc), sort_keys=True) == before
            failures.append((doc, seq))
            continue
        if found is MISSING:
            documents.pop(doc, None)
        else:
            documents[doc] = found
    return documents, failures


def random_sets(seed, count, hot=0.4, bad=0.0):
    """``bad``: share of sets that can't be tried, or that are left half done by what they hold."""
    rng = random.Random(seed)
    hopeless = [
        [], [("add", "", "nope")], [("replace", "", '{"x":')], [("test", "", "1")], [("add", "a", "1")], [("add", "/a", "1"), ("move", "/a", "2")],
        [("add", "/a", "{x")], [(None, "/a", "1")], [("add", None, "1")], None, [("add", "/a", "1"), ("remove", "/none", None)], [("ADD", "/b", "7")],
    ]
    value = lambda: json.dumps(rng.choice([1, "x", None, {"n": 1}, {"l": [1, 2]}, [1, 2], True, 1.5, {"a/b": "q"}]))
    members = ["/a", "/b", "/c~1d", "/~0e"]
    rows = []
    for seq in range(count):
        doc = "hot" if rng.random() < hot else f"d{rng.randrange(12)}"
        plain = doc in ("hot", "d0", "d1", "d2", "d3")  # these never mix members in one set

        def one(member):
            path = member + rng.choice(["", "", "", "/n", "/l", "/l/0", "/l/-"])
            kind = rng.choice(["add", "add", "replace", "remove"])
            return (kind, path, None if kind == "remove" else value())

        if rng.random() < bad:
            rows.append((doc, seq, rng.choice(hopeless)))
            continue
        roll = rng.random()
        if roll < 0.02:
            operations = [("add", "", value())]
        elif roll < 0.05:
            operations = [("add", "", json.dumps({"a": 1, "c/d": {"n": 2}}))]
        elif roll < 0.06:
            operations = [("remove", "", None)]
        elif roll < 0.2:
            member = rng.choice(members)
            operations = [one(member if plain else rng.choice(members)) for _ in range(rng.randrange(2, 4))]
        else:
            operations = [one(rng.choice(members))]
        rows.append((doc, seq, operations))
    return rows


@pytest.mark.parametrize("seed, bad", [(0, 0.0), (1, 0.0), (2, 0.1), (3, 0.3)])
def test_fold_matches_sequential_application(spark, seed, bad):
    rows = random_sets(seed, 1500, bad=bad)
    shuffled = random.Random(seed).sample(rows, len(rows))
    patches = spark.createDataFrame(shuffled, PATCH).repartition(7)
    documents, failures = brute(rows)
    folded = {r.document_id: json.loads(r.document) for r in model.fold_patches(patches).collect()}
    assert folded == documents
    failed = model.patch_failures(patches, slice_rows=50).collect()
    assert sorted((r.document_id, r.seq) for r in failed) == sorted(failures)


def test_fold_edges(spark):
    patches = spark.createDataFrame(
        [
            ("never", 1, [("add", "/a", "1")]),
            ("gone", 1, [("add", "", "{}")]),
            ("gone", 2, [("remove", "", None)]),
            ("empty", 1, [("add", "", "{}")]),
            ("text", 1, [("add", "", '"x"')]),
            ("text", 2, [("add", "/a", "1")]),
            ("emptied", 1, [("add", "", '{"a":1}')]),
            ("emptied", 2, [("remove", "/a", None)]),
            ("null", 1, [("add", "", "null")]),
            ("quotes", 1, [("add", "", '{"a\\"b":"c\\\\d"}')]),
            ("quotes", 2, [("replace", '/a"b', '"é\\n"')]),
        ],
        PATCH,
    )
    folded = {r.document_id: json.loads(r.document) for r in model.fold_patches(patches).collect()}
    assert folded == {"empty": {}, "text": "x", "emptied": {}, "null": None, "quotes": {'a"b': "é\n"}}


def test_change_capture(spark):
    log = spark.createDataFrame(
        [("k", 0, "a"), ("k", 1, "b"), ("k", 2, "b"), ("k", 3, None), ("k", 4, "c"), ("j", 5, None), (None, 6, "x")], "key string, offset long, value string"
    )
    rows = model.change_capture(log, "key", "value", slice_rows=2).orderBy("offset").collect()
    assert [(r.key, r.change, r.old, r.new, r.same) for r in rows] == [
        ("k", "new", None, "a", False),
        ("k", "update", "a", "b", False),
        ("k", "update", "b", "b", True),
        ("k", "remove", "b", None, False),
        ("k", "new", None, "c", False),
        ("j", "remove", None, None, False),
    ]


def test_compaction_and_snapshot(spark):
    log = spark.createDataFrame(
        [("a", 0, 10, "1"), ("a", 1, 20, "2"), ("b", 2, 30, "3"), ("b", 3, 40, None), ("a", 4, 50, "5"), ("c", 5, 60, "6"), ("c", 6, 70, None)],
        "key string, offset long, ts long, value string",
    )
    kept = model.compact_log(log, "key", "value", "ts", F.lit(45)).orderBy("offset").collect()
    assert [(r.key, r.offset, r.value) for r in kept] == [("a", 1, "2"), ("a", 4, "5"), ("c", 5, "6"), ("c", 6, None)]
    previous = logs.latest_by_key(log.where("ts <= 30"), "key", "value", "offset")
    rolled = model.roll_snapshot(previous, log.where("ts > 30"), "key", "value").collect()
    assert {r.key: r.value for r in rolled} == {"a": "5"}


def test_model_scan(spark):
    log = spark.createDataFrame(
        [("a", 0, b"\x01{}"), ("a", 1, b"\x00old"), ("b", 2, b"\x01{}"), ("b", 3, None), ("c", 4, b"\x02")], "key string, offset long, value binary"
    )
    rows = logs.model_scan(log).collect()
    assert {r.key: (r.is_null, r.document) for r in rows} == {"a": (False, "{}"), "c": (True, None)}
    assert {r.key for r in logs.clear_keys(log.withColumn("value", F.col("value").cast("string")), "key", "value", "offset").collect()} == {"a", "c"}


def test_snapshot_files(spark, path):
    documents = spark.createDataFrame([("a", '{"x":1}')], "document_id string, document string")
    target = model.model_snapshot(documents, path("s"), "2024-01-01", "t0")
    assert target.endswith("/2024-01-01/t0") and spark.read.json(target).collect()[0].document == '{"x":1}'
    assert any(f.endswith(".json.gz") for f in spark.read.format("binaryFile").load(target).toPandas()["path"])
