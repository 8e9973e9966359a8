"""The stream log: records addressed by ``(partition, offset)``, stored as files per partition."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.envelope import MAGIC, split_envelope, unwrap_nullable
from millrace.operators.ordered import place_in_order
from millrace.session import fresh_path

ENDS = "partition int, begin bigint, end bigint"
#: Folders of an append's records and, hidden inside, of its ends.
APPEND, ENDS_FOLDER = "append=", "_ends"


def assign_offsets(df: DataFrame, order: list[str], next_offsets: DataFrame | None = None, group: str = "partition") -> DataFrame:
    """Give records with a ``partition`` (or another ``group``) their dense offsets, in ``order`` within it.

    ``next_offsets(partition, next_offset)`` continues an existing log. ``order`` must be total.
    """
    placed = place_in_order(df, fresh_path(df.sparkSession, "placed"), group, order)
    if next_offsets is None:
        return placed
    base = next_offsets.select(group, "next_offset")
    return (
        placed.join(base, group, "left")
        .withColumn("offset", F.col("offset") + F.coalesce("next_offset", F.lit(0)))
        .drop("next_offset")
    )


def append_log(df: DataFrame, path: str, order: list[str], next_offsets: DataFrame | None = None, append: str | None = None) -> bool:
    """Append records to a stored log, all or nothing: one folder per append, in it one per partition, files in offset order.

    Files keep narrow offset ranges, so that a bounded read skips most of them by their statistics. Where each partition
    begins and ends is kept in the append's folder (``stored_ends``), for readers who only ask that. Records and ends are
    written to a hidden folder, whose one renaming makes both visible at once to readers and followers; what fails before
    leaves the log as it was. ``append`` names an append that may be tried again: once it is there, it is not written
    twice, and the answer is false. One writer at a time; the file system's renaming has to be atomic.
    """
    spark, name = df.sparkSession, append or uuid.uuid4().hex
    source, target = (spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{folder}{name}") for folder in ("_pending-", APPEND))
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(target):
        return False
    pending = f"{path}/_pending-{name}"
    rows = assign_offsets(df, order, next_offsets)
    rows.sortWithinPartitions("partition", "offset").write.mode("overwrite").partitionBy("partition").parquet(pending)
    spans = rows.groupBy(F.col("partition").cast("int").alias("partition")).agg(
        F.min("offset").alias("begin"), (F.max("offset") + 1).alias("end")
    )
    spans.coalesce(1).write.mode("overwrite").parquet(f"{pending}/{ENDS_FOLDER}")
    if not files.rename(source, target):
        raise OSError(f"an append could not be made visible: {target}")
    return True


def stored_ends(spark: SparkSession, path: str) -> DataFrame:
    """``(partition, begin, end)`` of a log that ``append_log`` wrote, from a row per partition and append."""
    kept = spark.read.schema(ENDS).parquet(f"{path}/{APPEND}*/{ENDS_FOLDER}")
    return kept.groupBy("partition").agg(F.min("begin").alias("begin"), F.max("end").alias("end"))


def log_scan(spark: SparkSession, path: str, schema: T.StructType | None = None, source: str = "parquet", **options) -> DataFrame:
    """Read a stored log, whole appends only, or a bounded range of another source."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return _without_append(reader.format(source).options(**options).load(path), schema)


def _without_append(log: DataFrame, schema: T.StructType | None) -> DataFrame:
    """The folder of its append is no column of a record."""
    name = APPEND[:-1]
    return log if schema is not None and name in schema.names else log.drop(name)


def framed_records(raw: DataFrame) -> DataFrame:
    """Records of a source that keeps framed binary values, such as a Kafka topic
    ``(partition, offset, timestamp, key, value)``. ``readable`` is false for unknown framing."""
    return (
        raw.withColumn("_e", split_envelope(F.col("value")))
        .select(
            "partition",
            "offset",
            F.unix_millis("timestamp").alias("ts_ms"),
            "key",
            "_e.format_version",
            "_e.schema_version",
            F.col("_e.body").cast("string").alias("body"),
        )
        .withColumn("readable", F.coalesce(F.col("format_version") == MAGIC, F.lit(False)))
    )


def log_stream(
    spark: SparkSession, path: str, schema: T.StructType, max_files: int | None = None, source: str = "parquet", **options
) -> DataFrame:
    """Follow a log. ``source`` may name another format, such as ``kafka`` where its package is present;
    ``max_files`` bounds a micro-batch. Of a log that ``append_log`` writes, whole appends are seen only."""
    reader = spark.readStream.format(source)
    if source != "kafka":
        reader = reader.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return _without_append(reader.options(**options).load(path), schema)


def _spec_ranges(spec: str) -> list[tuple[int, int, int]]:
    ranges = []
    for part in filter(None, (p.strip() for p in spec.split(";"))):
        partition, bounds = part.split(":")
        start, end = bounds.split(",")
        ranges.append((int(partition), int(start), int(end)))
    return ranges


def bounded_offset_scan(log: DataFrame, ranges: DataFrame | str) -> DataFrame:
    """Exactly the records whose offset is in ``[start, end)`` of their partition's range.

    Ranges are text (a job argument) or rows ``(partition, start, end)``, about as many as a topic is wide, so they are read
    here, and the log is never joined. A partition may have several, which may overlap: a record in any of them is read
    once. Folders are pruned by the partitions asked for, files and row groups by the least start and the greatest end; each
    partition's own ranges are looked up by its number. Empty ranges read nothing.
    """
    if isinstance(ranges, str):
        given = _spec_ranges(ranges)
    else:
        given = [(r["partition"], r["start"], r["end"]) for r in ranges.select("partition", "start", "end").collect()]
    wanted: dict[int, list[tuple[int, int]]] = {}
    for number, start, end in given:
        if start < end:
            wanted.setdefault(number, []).append((start, end))
    if not wanted:
        return log.where(F.lit(False))
    partition, offset = F.col("partition"), F.col("offset")
    least, most = min(s for own in wanted.values() for s, _ in own), max(e for own in wanted.values() for _, e in own)
    asked = partition.isin(*wanted) & (offset >= least) & (offset < most)

    def bounds(side: int) -> Column:
        entries = [x for number, own in wanted.items() for x in (F.lit(number).cast("bigint"), F.array(*[F.lit(r[side]).cast("bigint") for r in own]))]
        return F.try_element_at(F.create_map(*entries), partition.cast("bigint"))

    if all(len(own) == 1 for own in wanted.values()):
        return log.where(asked & (offset >= F.get(bounds(0), 0)) & (offset < F.get(bounds(1), 0)))
    inside = F.exists(F.arrays_zip(bounds(0).alias("s"), bounds(1).alias("e")), lambda r: (offset >= r["s"]) & (offset < r["e"]))
    return log.where(asked & inside)


def latest_by_key(log: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Current ``(key, value)`` of a keyed log: the last write wins, a null value deletes, a null key is
    ignored. Aggregates before the shuffle, so a hot key sends one row per task."""
    return (
        log.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.max_by(F.struct(F.col(value).alias("v")), F.col(order)).alias("_last"))
        .where(F.col("_last.v").isNotNull())
        .select(key, F.col("_last.v").alias(value))
    )


def model_scan(log: DataFrame, key: str = "key", value: str = "value", order: str = "offset") -> DataFrame:
    """Current documents of a compacted metadata log with null-prefixed values.

    Rows marked to be skipped are ignored, tombstones delete, and a stored null is a document of its own:
    ``(key, is_null, document)``. Any other prefix is an error.
    """
    split = log.withColumn("_v", unwrap_nullable(F.col(value))).where(F.col("_v.kind") != "skip")
    state = F.when(F.col("_v.kind") == "invalid", F.raise_error(F.lit("a value has an unknown prefix"))).when(
        F.col("_v.kind") != "tombstone",
        F.struct((F.col("_v.kind") == "null").alias("is_null"), F.col("_v.data").cast("string").alias("document")),
    )
    current = latest_by_key(split.withColumn("_state", state), key, "_state", order)
    return current.select(key, "_state.is_null", "_state.document")


def clear_keys(log: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Tombstones that remove every key the log currently holds."""
    held = latest_by_key(log, key, value, order)
    return held.select(key, F.lit(None).cast(log.schema[value].dataType).alias(value))


def model_projection(documents: DataFrame, schema: T.StructType, document: str = "document") -> DataFrame:
    """Read only the part of each JSON document a job needs; unknown fields are ignored."""
    return documents.withColumn("model", F.from_json(document, schema))
