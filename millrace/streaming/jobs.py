"""Streaming queries: landing, served positions, de-duplicated receipts, agents on model changes."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.functions.keypath import key_hash
from millrace.operators.conform import accepted, conform, rejected, responses
from millrace.operators.mask import blank
from millrace.operators.model import emit_patches, patch_rows
from millrace.plans.ingest import admit_by_registry, partition_by_key
from millrace.plans.land import land_range
from millrace.plans.serve import decode_by_registry, serve
from millrace.session import passing, settle
from millrace.sources.log import assign_offsets


def land_stream(
    records: DataFrame,
    *,
    stream: str,
    table: str,
    root: str,
    schema_json: str,
    commits: str,
    checkpoint: str,
    first_instant: datetime,
    interval: timedelta = timedelta(hours=1),
    trigger: dict | None = None,
    notify=None,
) -> StreamingQuery:
    """Land a followed log, one table partition per micro-batch.

    The folder and the instant of a landing follow from its batch number, so a batch that is run again after
    a failure replaces its own files and finds its own partition: each record lands once. ``availableNow``
    drains what is there in capped batches; ``processingTime`` lands at an interval.
    """

    def land(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        plan = batch.groupBy("partition").agg(
            F.min("offset").alias("start"), (F.max("offset") + 1).alias("end")
        )
        instant = (first_instant + number * interval).astimezone(timezone.utc).strftime("%Y%m%dT%H%M%SZ")
        land_range(
            spark, batch, plan, stream=stream, table=table, location=f"{root}/{stream}/{number}/acquisition_instant={instant}",
            instant=instant, schema_json=schema_json, commits=f"{commits}/batch={number}", notify=notify,
        )

    return (
        records.writeStream.foreachBatch(land)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def ingest_stream(
    messages: DataFrame,
    *,
    schema_json: str,
    version: int,
    log: str,
    rejects: str,
    checkpoint: str,
    order: list[str],
    key_path: str | None = None,
    partitions: int = 6,
    hashing=None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Admit messages to the log: accepted ones get their partition and the next dense offsets, the others
    go to the rejects with their reason.

    Each micro-batch writes a folder of its own and the positions its partitions end at, and starts from the
    positions of the batch before; run again, it replaces its own folders. What it keeps in between goes with it.
    ``order`` names each message, so it places those without a key, too.
    """

    def admit(batch: DataFrame, number: int) -> None:
        with passing(batch.sparkSession):
            write(batch, number)

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        judged = settle(conform(batch, schema_json, version=version).drop("message"), "judged")
        rejected(judged.withColumn("message", F.lit(None))).write.mode("overwrite").parquet(f"{rejects}/batch={number}")
        placed = partition_by_key(accepted(judged), key_path, partitions, hashing=hashing or key_hash, identity=order)
        ends = f"{log}-ends"
        before = None
        if number > 0:
            before = spark.read.schema("partition int, next_offset bigint").parquet(f"{ends}/batch={number - 1}")
        rows = assign_offsets(placed, order, before)
        target = f"{log}/batch={number}"
        rows.sortWithinPartitions("partition", "offset").write.mode("overwrite").partitionBy("partition").parquet(target)
        now = (
            spark.read.schema("offset bigint, partition int").parquet(target)
            .groupBy("partition").agg((F.max("offset") + 1).alias("next_offset"))
        )
        kept = now if before is None else now.unionByName(before).groupBy("partition").agg(F.max("next_offset").alias("next_offset"))
        kept.write.mode("overwrite").parquet(f"{ends}/batch={number}")

    return (
        messages.writeStream.foreachBatch(admit)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


Metadata = Callable[[SparkSession], DataFrame]


def ingest_many_stream(
    requests: DataFrame,
    *,
    catalog: Metadata,
    schemas: Metadata,
    log: str,
    answers: str,
    checkpoint: str,
    partitions: int = 6,
    hashing=None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Array requests ``(request_id, stream, body)`` of all streams, admitted by one query.

    ``catalog`` and ``schemas`` are read anew for every micro-batch, so a stream or a schema that is registered while
    the query runs counts from the next micro-batch on. Every element gets its answer, in position, below ``answers``;
    admitted ones get the next dense offsets of their stream's partition, below ``log``. A micro-batch writes folders of its own
    and starts from the positions of the one before; run again, it replaces its own folders.
    """

    def admit(batch: DataFrame, number: int) -> None:
        with passing(batch.sparkSession):
            write(batch, number)

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        judged = admit_by_registry(batch, catalog(spark), schemas(spark), partitions, hashing or key_hash)
        judged = settle(judged, "judged")
        told = responses(judged, ["request_id", "stream", "pos", "schema_version"])
        told.write.mode("overwrite").parquet(f"{answers}/batch={number}")
        place = F.concat_ws("/", "stream", F.col("partition").cast("string"))
        rows = judged.where(F.col("reason").isNull()).drop("reason").withColumnRenamed("element", "body").withColumn("_place", place)
        before = spark.read.schema("_place string, next_offset bigint").parquet(f"{log}-ends/batch={number - 1}") if number else None
        rows = assign_offsets(rows, ["request_id", "pos"], before, group="_place")
        target = f"{log}/batch={number}"
        by = ["stream", "partition"]
        rows.sortWithinPartitions(*by, "offset").write.mode("overwrite").partitionBy(*by).parquet(target)
        written = spark.read.schema("_place string, offset bigint").parquet(target)
        now = written.groupBy("_place").agg((F.max("offset") + 1).alias("next_offset"))
        kept = now if before is None else now.unionByName(before).groupBy("_place").agg(F.max("next_offset").alias("next_offset"))
        kept.write.mode("overwrite").parquet(f"{log}-ends/batch={number}")

    return (
        requests.writeStream.foreachBatch(admit)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def decode_stream(records: DataFrame, *, schemas: Metadata, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """A followed log of many streams, decoded record by record as :func:`millrace.plans.serve.decode_by_registry` does.

    The registry is read anew for every micro-batch. A record whose schema isn't registered when it is read goes out with
    its error; a micro-batch that is run again replaces its own folder.
    """

    def decode(batch: DataFrame, number: int) -> None:
        with passing(batch.sparkSession):
            decode_by_registry(batch, schemas(batch.sparkSession)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return (
        records.writeStream.foreachBatch(decode)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def serve_stream(records: DataFrame, schemas: dict[int, str], grants=frozenset(), replacer=blank) -> DataFrame:
    """Serve a followed log to one consumer group. The group's position is the checkpoint of the query that
    writes this out, so give every (stream, group) a checkpoint of its own."""
    return serve(records, schemas, grants, replacer)


def commit_stream(received: DataFrame, ts: str, interval: str, lateness: str) -> DataFrame:
    """Per tumbling interval and partition, the position that may be committed; intervals without
    messages give nothing."""
    return (
        received.withWatermark(ts, lateness)
        .groupBy(F.window(ts, interval).alias("w"), "partition")
        .agg((F.max("offset") + 1).alias("next_offset"))
        .select(F.col("w.start").alias("window_start"), "partition", "next_offset")
    )


def first_receipts_stream(received: DataFrame, ts: str, lifetime: str) -> DataFrame:
    """Receipts with later copies dropped, remembering each message for its lifetime."""
    return received.withWatermark(ts, lifetime).dropDuplicatesWithinWatermark(["origin", "seq"])


def correlate_stream(sent: DataFrame, received: DataFrame, lifetime: str) -> DataFrame:
    """Sent messages with their first receipt, as a left outer interval join; a message whose lifetime passes
    without a receipt comes out unmatched. Both sides carry ``origin, seq`` and a time column. Later copies of a receipt
    are ignored: a message comes out once, when its lifetime is over."""
    s = sent.withWatermark("sent_at", lifetime).alias("s")
    r = received.withWatermark("recv_at", lifetime).alias("r")
    met = s.join(
        r,
        F.expr(
            "s.origin = r.origin and s.seq = r.seq and r.recv_at >= s.sent_at "
            f"and r.recv_at <= s.sent_at + interval {lifetime}"
        ),
        "leftOuter",
    )
    return met.groupBy("s.origin", "s.seq", "s.sent_at").agg(F.min("r.recv_at").alias("recv_at"))


@contextmanager
def state_partitions(spark: SparkSession, number: int | None = None):
    """Start streams with this many state partitions, by default one per core. A stream keeps for good the
    number it was first started with."""
    conf, key = spark.conf, "spark.sql.shuffle.partitions"
    usual = conf.get(key)
    conf.set(key, str(number or spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        conf.set(key, usual)


def drain(df: DataFrame, path: str, checkpoint: str, mode: str = "append", fmt: str = "parquet") -> DataFrame:
    """Run a streaming DataFrame over everything available into files, and read those."""
    spark = df.sparkSession
    with state_partitions(spark):
        query = (
            df.writeStream.format(fmt)
            .outputMode(mode)
            .option("path", path)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    return spark.read.schema(df.schema).format(fmt).load(path)


Agent = Callable[[DataFrame], DataFrame]


def inspect_models(spark: SparkSession, documents: DataFrame, agents: list[Agent], patch_log: str, seq: int) -> None:
    """Let every agent look at all current documents and append the patches it asks for.

    An agent maps documents to ``(document_id, operations)``. Run it on a schedule.
    """
    for number, agent in enumerate(agents):
        wanted = agent(documents).withColumn("seq", F.lit(seq * len(agents) + number).cast("bigint"))
        emit_patches(wanted, patch_log)


def agent_stream(
    changes: DataFrame, agents: list[Agent], patch_log: str, checkpoint: str, loaded: int | None = None, order: str = "offset"
) -> StreamingQuery:
    """Call agents on model changes as they come, those after what existed when the agents began.

    ``loaded`` is where the log ended at that time. Changes before it, the load of what exists, are muted, however
    many micro-batches they take; without it every change is shown. ``changes(key, order, change, old, new, same)``;
    updates that change nothing are not shown. A batch that is run again replaces its own patches.
    """

    def act(batch: DataFrame, number: int) -> None:
        with passing(batch.sparkSession):
            # The changes come from stream state, so they are computed once, whatever is done with them.
            seen = settle(batch, "changes").where("not same")
            if loaded is not None:
                seen = seen.where(F.col(order) >= loaded)
            for place, agent in enumerate(agents):
                wanted = agent(seen).withColumn("seq", F.lit(number * len(agents) + place).cast("bigint"))
                patch_rows(wanted).write.mode("overwrite").parquet(f"{patch_log}/batch={number}/agent={place}")

    return (
        changes.writeStream.foreachBatch(act)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
