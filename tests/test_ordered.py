"""Sliced scans against plain Python, with a key that holds most rows."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import ordered
from millrace.sources import log as logs
from millrace.streaming import jobs


def rows_of(seed, count=3000):
    rng = random.Random(seed)
    keys = ["hot"] * 6 + ["a", "b", "c"]
    seqs = rng.sample(range(-2000, 20000), count)
    return [(rng.choice(keys), s, rng.choice([None, 1, 2, 3, -4]), rng.choice("xy")) for s in seqs]


@pytest.mark.parametrize("seed, width", [(1, 10), (2, 997), (3, 10**6)])
def test_scans(spark, seed, width):
    rows = rows_of(seed)
    frame = spark.createDataFrame(rows, "k string, seq long, v int, l string").repartition(5)
    last = ordered.previous_value(frame, ["k"], "seq", F.col("v"), "last", width)
    total = ordered.running_total(last, ["k"], "seq", F.coalesce("v", F.lit(0)), "total", width)
    low = ordered.running(total, ["k"], "seq", F.col("v"), "low", F.min, False, width)
    runs = ordered.run_ids(low, ["k"], "seq", F.col("l"), "run", width)
    found = {(r.k, r.seq): (r.last, r.total, r.low, r.run) for r in runs.collect()}
    expected, state = {}, {}
    for k, seq, v, label in sorted(rows, key=lambda r: (r[0], r[1])):
        previous, running, least, run, before = state.get(k, (None, 0, None, 0, None))
        run += label != before
        running += v or 0
        expected[(k, seq)] = (previous, running, least, run)
        least = least if v is None else v if least is None else min(least, v)
        state[k] = (previous if v is None else v, running, least, run, label)
    assert found == expected


@pytest.mark.parametrize("width", [1, 7, 50, 10**6])
def test_runs_across_slices(spark, width):
    """Null labels, labels that stay the same over many slices, gaps and negative order values."""
    draw = random.Random(width)
    rows = [(draw.choice("hhha"), seq, label) for seq in draw.sample(range(-300, 900), 400) for label in [draw.choice([None, "x", "x", "y"]) if seq < 300 else "x"]]
    found = ordered.run_ids(spark.createDataFrame(rows, "k string, seq long, l string").repartition(4), ["k"], "seq", F.col("l"), "run", width)
    expected, state = {}, {}
    for k, seq, label in sorted(rows, key=lambda r: (r[0], r[1])):
        run, before = state.get(k, (0, "none yet"))
        run += label != before
        expected[k, seq] = run
        state[k] = run, label
    assert {(r.k, r.seq): r.run for r in found.collect()} == expected
    assert found.columns == ["k", "seq", "l", "run"]


def test_runs_take_two_scans_and_four_exchanges(spark, path):
    spark.range(1000).selectExpr("id % 3 AS k", "id AS seq", "id % 7 AS l").write.parquet(path("rows"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        runs = ordered.run_ids(spark.read.parquet(path("rows")), ["k"], "seq", F.col("l"), "run", 100)
        plan = runs._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("FileScan") <= 2
    assert plan.count("Exchange hashpartitioning") <= 4


def test_slices_stay_small(spark):
    """However hot the key, no window group holds more rows than the width."""
    frame = spark.range(5000).select(F.lit("k").alias("k"), "id")
    sliced = ordered._sliced(frame, "id", 100)
    assert sliced.groupBy("k", "_slice").count().agg(F.max("count")).first()[0] == 100


def test_offsets_are_dense_whatever_the_skew(spark, path):
    rng = random.Random(5)
    rows = [(0 if rng.random() < 0.8 else rng.randrange(1, 5), rng.randrange(1000), i) for i in range(20000)]
    frame = spark.createDataFrame(rows, "partition int, ts long, id long").repartition(11)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = logs.assign_offsets(frame, ["ts", "id"])
        found = {r.id: (r.partition, r.offset) for r in placed.collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    expected, count = {}, {}
    for partition, ts, i in sorted(rows):
        expected[i] = (partition, count.get(partition, 0))
        count[partition] = count.get(partition, 0) + 1
    assert found == expected


def test_offsets_continue(spark):
    frame = spark.createDataFrame([(0, 2), (0, 1), (1, 3)], "partition int, id long")
    ends = spark.createDataFrame([(0, 40)], "partition int, next_offset long")
    assert {r.id: r.offset for r in logs.assign_offsets(frame, ["id"], ends).collect()} == {1: 40, 2: 41, 3: 0}


def test_log_files_are_pruned(spark, path):
    frame = spark.range(1000).select((F.col("id") % 4).cast("int").alias("partition"), "id")
    logs.append_log(frame, path("log"), ["id"])
    read = logs.bounded_offset_scan(logs.log_scan(spark, path("log")), "1:10,20;2:5,5;")
    assert sorted(r.offset for r in read.collect()) == list(range(10, 20))
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(offset), GreaterThanOrEqual(offset,10), LessThan(offset,20)]" in plan
    assert "PartitionFilters: [isnotnull(partition" in plan
    assert logs.bounded_offset_scan(logs.log_scan(spark, path("log")), "3:7,7").count() == 0


def test_an_append_is_all_or_nothing(spark, path, monkeypatch):
    """It fails between its records and its ends; nothing of it is seen, and run again it is there once."""

    def rows(first, last):
        return spark.range(first, last).select((F.col("id") % 3).cast("int").alias("partition"), "id")

    def seen():
        return sorted((r.partition, r.offset, r.id) for r in logs.log_scan(spark, path("log")).collect())

    assert logs.append_log(rows(0, 30), path("log"), ["id"], append="first")
    before = seen()
    ends = logs.stored_ends(spark, path("log")).withColumnRenamed("end", "next_offset")

    def lost(*_):
        raise OSError("the driver is lost")

    with monkeypatch.context() as broken:
        broken.setattr(logs.F, "max", lost)  # the records are written by then, the ends are not
        with pytest.raises(OSError):
            logs.append_log(rows(30, 60), path("log"), ["id"], ends, append="second")
    assert seen() == before and {(r.begin, r.end) for r in logs.stored_ends(spark, path("log")).collect()} == {(0, 10)}
    followed = logs.log_stream(spark, path("log"), logs.log_scan(spark, path("log")).schema)
    assert jobs.drain(followed, path("out"), path("state")).count() == 30
    for first in (True, False):  # tried again, and once more
        assert logs.append_log(rows(30, 60), path("log"), ["id"], ends, append="second") is first
    assert [x for x in seen() if x in before] == before and len(seen()) == 60
    for partition in range(3):
        assert [o for p, o, _ in seen() if p == partition] == list(range(20))
    assert {(r.begin, r.end) for r in logs.stored_ends(spark, path("log")).collect()} == {(0, 20)}
    assert jobs.drain(followed, path("out"), path("state")).count() == 60


def test_many_ranges_are_joined(spark, path):
    frame = spark.range(900).select((F.col("id") % 300).cast("int").alias("partition"), "id")
    log = logs.assign_offsets(frame, ["id"])
    spec = ";".join(f"{p}:0,1" for p in range(300))
    assert logs.bounded_offset_scan(log, spec).count() == 300


def test_chunks(spark):
    frame = spark.createDataFrame([("t", p) for p in range(13)], "topic string, partition int")
    sizes = ordered.chunk(frame, ["topic"], "partition", 6).groupBy("chunk").count().orderBy("chunk").collect()
    assert [tuple(r) for r in sizes] == [(0, 6), (1, 6), (2, 1)]
