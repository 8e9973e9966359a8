"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import settle

#: White space of the word rules: a space, and tab to carriage return. ``bytes.split`` cuts at the same six.
SPACES = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_of(doc_id: str | Column, folds: int) -> Column:
    """``crc32(doc_id as text) mod folds``; a null id has no fold."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")), F.lit(folds))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all other characters as they are."""
    return F.translate(text, UPPER, LOWER)


def pieces(texts: pd.Series, limit: int = 2_000_000) -> Iterator[list[str]]:
    """Consecutive rows in lists of about ``limit`` characters, so that what is worked out per word stays small
    however long the texts of a batch are. A null is an empty text."""
    held: list[str] = []
    size = 0
    for text in texts:
        text = text if isinstance(text, str) else ""
        held.append(text)
        size += len(text) + 16
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def in_pieces(texts: pd.Series, work: Callable[[list[str]], list], limit: int = 2_000_000) -> list:
    """``work`` over the pieces of a batch, its results in the order of the rows."""
    out: list = []
    for held in pieces(texts, limit):
        out.extend(work(held))
    return out


def give_back() -> None:
    """Return freed memory to the machine. Python workers live on after a task and serve the stages that follow, so what
    a task has let go of shouldn't stay with them; Arrow keeps what it has freed in a pool of its own. Call it once nothing
    of the task is held any more."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not in every C library
    if trim:
        trim(0)


class Remember(dict):
    """A bounded memory of a function's values, so that a task's memory doesn't follow the vocabulary: once ``size`` are
    held, they become the older ones, of which those asked for again move back, and the older ones before are let go."""

    def __init__(self, function: Callable, size: int = 200_000):
        super().__init__()
        self.function, self.size, self.older = function, size, {}

    def put(self, key, value) -> None:
        if len(self) >= self.size:
            self.older = dict(self)
            self.clear()
        self[key] = value

    def knows(self, key) -> bool:
        return key in self or key in self.older

    def __missing__(self, key):
        older = self.older
        value = older[key] if key in older else self.function(key)
        if len(key) <= 64:  # longer ones are seldom seen twice
            self.put(key, value)
        return value


def components(edges: DataFrame, name: str, most: int = 60) -> DataFrame:
    """Connected components of undirected ``edges`` (a, b: any one orderable type): rows (node, root), root being the
    least node reachable; nodes without edges aren't there.

    Alternates large-star and small-star steps until nothing changes: each step points the neighbours of a node at
    the least of them, first those above the node, then those below. Each step is a grouping that combines before the
    shuffle and a join that Spark can split, so a hub costs no task of its own, and each is written to the shared
    folder. A component of n nodes takes some log n rounds.
    """
    spark = edges.sparkSession
    pairs = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    pairs = settle(pairs, f"{name}-edges")
    before = None
    for _ in range(most):
        both = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        large = settle(large, f"{name}-large")
        # Below each node: its lesser neighbours, pointed at the least of them, and the node itself.
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = (
            large.join(low, "b").select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a <> b").distinct()
        )
        pairs = settle(small, f"{name}-small")
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    ends = pairs.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return ends.union(pairs.select(F.col("a").alias("node"), F.col("a").alias("root"))).distinct()


def unused(columns: list[str], *names: str) -> list[str]:
    """Names like the given ones that no column has, in any case of letters."""
    taken = {column.lower() for column in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
