"""Running computations over ordered groups of any size.

A plain window puts a whole group into one task. Here each group is cut into slices of its order
column; a slice is one window group, and a small per-slice summary, scanned once per key, carries
the running state from slice to slice. The order column is a whole number that is unique within its
key (an offset or a sequence number), so no slice holds more than ``width`` rows however hot the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE_ROWS = 1_000_000


def _sliced(df: DataFrame, order: str, width: int) -> DataFrame:
    """Name each slice by the order value it starts at; whole-number arithmetic, exact for every bigint."""
    value = F.col(order).cast("bigint")
    return df.withColumn("_slice", value - F.pmod(value, F.lit(width).cast("bigint")))


def previous_value(
    df: DataFrame, keys: list[str], order: str, value: Column, out: str, width: int = SLICE_ROWS
) -> DataFrame:
    """Add ``out``: the last non-null ``value`` of the rows before this one in its key, else NULL.

    Wrap the value in a struct to tell "the last one held a null" from "there was none".
    """
    rows = _sliced(df, order, width).withColumn("_value", value)
    tails = rows.groupBy(*keys, "_slice").agg(
        F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col(order))).alias("_tail")
    )
    before = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    carried = tails.select(*keys, "_slice", F.last("_tail", ignorenulls=True).over(before).alias("_carried"))
    inside = W.partitionBy(*keys, "_slice").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return (
        rows.join(carried, [*keys, "_slice"], "left")
        .withColumn(out, F.coalesce(F.last("_value", ignorenulls=True).over(inside), F.col("_carried")))
        .drop("_slice", "_value", "_carried")
    )


def running(
    df: DataFrame,
    keys: list[str],
    order: str,
    value: Column,
    out: str,
    combine=F.sum,
    inclusive: bool = True,
    width: int = SLICE_ROWS,
) -> DataFrame:
    """Add ``out``: ``combine`` (``F.sum``, ``F.min`` or ``F.max``) of ``value`` over the rows of the key up
    to this one, itself included if asked. NULL while there is nothing to combine."""
    rows = _sliced(df, order, width).withColumn("_value", value)
    parts = rows.groupBy(*keys, "_slice").agg(combine("_value").alias("_part"))
    before = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    carried = parts.select(*keys, "_slice", combine("_part").over(before).alias("_carried"))
    inside = W.partitionBy(*keys, "_slice").orderBy(order).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    local = combine("_value").over(inside)
    if combine is F.sum:
        total = F.when(local.isNull() & F.col("_carried").isNull(), None).otherwise(
            F.coalesce(local, F.lit(0)) + F.coalesce("_carried", F.lit(0))
        )
    else:
        total = (F.least if combine is F.min else F.greatest)(local, F.col("_carried"))
    return rows.join(carried, [*keys, "_slice"], "left").withColumn(out, total).drop("_slice", "_value", "_carried")


def running_total(
    df: DataFrame, keys: list[str], order: str, amount: Column, out: str, width: int = SLICE_ROWS
) -> DataFrame:
    """Add ``out``: the sum of ``amount`` over the rows of the key up to and including this one."""
    return running(df, keys, order, amount, out, F.sum, True, width)


def run_ids(df: DataFrame, keys: list[str], order: str, label: Column, out: str, width: int = SLICE_ROWS) -> DataFrame:
    """Add ``out``: a number, from 1, that grows by one wherever ``label`` changes along the order; nulls are a label, too.

    A slice is summed up by its first and last label and the changes inside. Such summaries compose, so one pass along
    them tells each slice the number it starts with.
    """
    rows = _sliced(df, order, width).withColumn("_label", F.struct(label.alias("l")))
    inside = W.partitionBy(*keys, "_slice").orderBy(order)
    before = F.lag("_label").over(inside)
    # Whether a slice's first row changes the label shows in the slice before it.
    rows = rows.withColumn("_changed", F.when(before.isNull() | before.eqNullSafe(F.col("_label")), 0).otherwise(1))
    rows = rows.withColumn("_inside", F.sum("_changed").over(inside.rowsBetween(W.unboundedPreceding, 0)))
    parts = rows.groupBy(*keys, "_slice").agg(
        F.min_by("_label", order).alias("_first"), F.max_by("_label", order).alias("_last"), F.max("_inside").alias("_changes")
    )
    along = W.partitionBy(*keys).orderBy("_slice")
    enters = F.when(F.lag("_last").over(along).eqNullSafe(F.col("_first")), 0).otherwise(1)
    upto = F.sum(F.col("_enters") + F.col("_changes")).over(along.rowsBetween(W.unboundedPreceding, 0))
    starts = parts.withColumn("_enters", enters).select(*keys, "_slice", (upto - F.col("_changes")).alias("_start"))
    numbered = rows.join(starts, [*keys, "_slice"], "left").withColumn(out, F.coalesce("_start", F.lit(1)) + F.col("_inside"))
    return numbered.drop("_slice", "_label", "_changed", "_inside", "_start")


def chunk(df: DataFrame, keys: list[str], order: str, size: int, out: str = "chunk") -> DataFrame:
    """Number chunks of ``size`` consecutive rows. For partition lists, which are as long as a topic
    is wide."""
    position = F.row_number().over(W.partitionBy(*keys).orderBy(order)) - 1
    return df.withColumn(out, F.floor(position / size).cast("int"))


def place_in_order(df: DataFrame, path: str, group: str, order: list[str]) -> DataFrame:
    """Write rows range-partitioned and sorted by ``(group, order)``, and give each row its dense
    position in its group as ``offset``, from 0.

    Ranges are cut by row count on the full sort key, so a hot group spreads over many tasks. Each
    written row keeps its (task, index) number; counting the rows per task and group - at most tasks
    + groups rows - turns that into positions without another pass over a whole group. The order must
    be total for the positions to be repeatable.
    """
    (
        df.repartitionByRange(group, *order)
        .sortWithinPartitions(group, *order)
        .withColumn("_pos", F.monotonically_increasing_id())
        .write.mode("errorifexists")
        .parquet(path)
    )
    written = T.StructType([*df.schema.fields, T.StructField("_pos", T.LongType())])
    stored = df.sparkSession.read.schema(written).parquet(path).withColumn("_task", F.shiftright("_pos", 33))
    runs = stored.groupBy("_task", group).agg(F.min("_pos").alias("_first"), F.count("*").alias("_rows"))
    before = W.partitionBy(group).orderBy("_task").rowsBetween(W.unboundedPreceding, -1)
    bases = runs.select("_task", group, "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_base"))
    return (
        stored.join(F.broadcast(bases), ["_task", group])
        .withColumn("offset", F.col("_base") + F.col("_pos") - F.col("_first"))
        .drop("_pos", "_task", "_first", "_base")
    )
