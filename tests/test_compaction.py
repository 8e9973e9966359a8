"""Followed compaction against the compaction of the whole log, batch by batch."""

import os
import random

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from millrace.operators.model import compact_log
from millrace.sources.log import log_stream
from millrace.streaming import compaction

SHAPE = "key string, offset long, ts long, value string"
RETENTION = 40


class Followed:
    """A log that grows, followed after each step."""

    def __init__(self, spark, path, share=0.5):
        self.spark, self.path, self.share, self.rows = spark, path, share, []
        self.schema = spark.createDataFrame([], SHAPE).schema
        os.makedirs(path("log"))

    def add(self, rows):
        self.rows += rows
        self.spark.createDataFrame(rows, SHAPE).coalesce(1).write.mode("append").parquet(self.path("log"))

    def run(self):
        compaction.compact_stream(
            log_stream(self.spark, self.path("log"), self.schema), path=self.path("out"), key="key", value="value", ts="ts",
            retention=RETENTION, checkpoint=self.path("state"), share=self.share,
        ).awaitTermination()

    def seen(self):
        rows = compaction.compacted(self.spark, self.path("out"), self.schema, "key", "value", "ts").collect()
        return sorted(map(tuple, rows), key=str)

    def wanted(self):
        after = max(r[2] for r in self.rows) - RETENTION
        whole = self.spark.createDataFrame(self.rows, SHAPE)
        return sorted(map(tuple, compact_log(whole, "key", "value", "ts", F.lit(after)).select("key", "offset", "ts", "value").collect()), key=str)


@pytest.mark.parametrize("share", [0.0, 0.5, 5.0])
def test_every_batch_equals_the_whole(spark, path, share):
    log, rng, offset = Followed(spark, path, share), random.Random(4), 0
    for step in range(5):
        rows = []
        for _ in range(60):
            key = rng.choice(["hot"] * 5 + ["a", "b", "c", "d", None])
            rows.append((key, offset, step * 30 + rng.randrange(30), rng.choice(["x", "y", "z", None])))
            offset += 1
        log.add(rows)
        log.run()
        assert log.seen() == log.wanted()
    names = {n for n in os.listdir(path("out")) if n[0] not in "._"}
    pointer = compaction.current(spark, path("out"))
    assert names == {n for n in [pointer["base"], *pointer["deltas"], *pointer["before"]] if n}
    if share == 0.0:  # a generation per batch: little more than what is live
        assert pointer["base_rows"] == len(log.seen()) < 150 and pointer["deltas"] == []


def test_a_batch_that_fails_before_its_pointer(spark, path, monkeypatch):
    log = Followed(spark, path, 0.0)
    log.add([("a", 0, 0, "1"), ("b", 1, 5, "2")])
    log.run()
    before = log.seen()
    log.add([("a", 2, 90, None), ("b", 3, 95, "4"), ("c", 4, 200, "5")])

    def lost(*_):
        raise OSError("the driver is lost")

    with monkeypatch.context() as broken:
        broken.setattr(compaction, "_point", lost)
        with pytest.raises(StreamingQueryException):
            log.run()
    assert log.seen() == before  # what was written is not current
    log.run()
    assert log.seen() == log.wanted() == [("b", 3, 95, "4"), ("c", 4, 200, "5")]


def test_a_batch_that_was_made_current_is_not_made_again(spark, path):
    log = Followed(spark, path)
    log.add([("a", 0, 0, "1")])
    log.run()
    pointer = compaction.current(spark, path("out"))
    commits = f"{path('state')}/commits/0"
    os.remove(commits)
    if os.path.exists(f"{path('state')}/commits/.0.crc"):
        os.remove(f"{path('state')}/commits/.0.crc")
    log.run()
    assert compaction.current(spark, path("out")) == pointer and log.seen() == [("a", 0, 0, "1")]


def test_deletions_stay_for_the_retention(spark, path):
    log = Followed(spark, path, 0.0)
    log.add([("a", 0, 0, "1"), ("a", 1, 50, None)])
    log.run()
    assert log.seen() == [("a", 0, 0, "1"), ("a", 1, 50, None)]
    log.add([("b", 2, 91, "2")])
    log.run()
    assert log.seen() == [("b", 2, 91, "2")]


def test_nothing_yet(spark, path):
    log = Followed(spark, path)
    assert log.seen() == [] and compaction.current(spark, path("out")) is None
