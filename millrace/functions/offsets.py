"""Offset ranges as text: ``partition:start,end;partition:start,end``, ends exclusive."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_offset_spec(spec: Column) -> Column:
    """Offset spec text to ``array<struct<partition, start, end>>``."""
    parts = F.filter(F.split(spec, ";"), lambda p: F.trim(p) != "")

    def one(part: Column) -> Column:
        sides = F.split(F.trim(part), ":")
        bounds = F.split(sides[1], ",")
        return F.struct(
            sides[0].cast("int").alias("partition"),
            bounds[0].cast("bigint").alias("start"),
            bounds[1].cast("bigint").alias("end"),
        )

    return F.transform(parts, one)


def format_offset_spec(partition: Column, start: Column, end: Column) -> Column:
    """Aggregate: the ranges of a group as one spec text, ordered by partition.

    One entry per partition of a stream, so the collected list is as small as the topic is wide.
    """
    entry = F.struct(
        partition.alias("p"),
        F.concat(partition.cast("string"), F.lit(":"), start.cast("string"), F.lit(","), end.cast("string")).alias("t"),
    )
    return F.array_join(F.transform(F.sort_array(F.collect_list(entry)), lambda e: e["t"]), ";")
