"""Serve: log records as masked JSON, read from where a consumer left off."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import avro
from millrace.operators.mask import GRANT_PII, blank, mask_column
from millrace.operators.positions import log_ends, resume_read
from millrace.plans.by_schema import each_by_its_own
from millrace.session import by_shuffle


def join_writer_schema(records: DataFrame, schemas: DataFrame) -> DataFrame:
    """Attach the schema each record was written with; ``error`` tells an unknown stream, an unknown version and an
    ambiguous one. ``records(stream, schema_version, ...)``, ``schemas(stream, version, schema_json)``.

    A row per stream with its schemas by version is met by one join on the stream, which adaptive execution splits where a
    stream is hot. Texts of many streams are no broadcast, however small the files they come from. A version that is listed with unlike texts is ambiguous, and a null version is no
    version; either ends decoding for its own records alone. A version without a text is unknown.
    """
    versions = schemas.groupBy("stream", "version").agg(F.min("schema_json").alias("text"), F.max("schema_json").alias("_other"))
    entry = F.struct("version", F.struct("text", (F.col("text") != F.col("_other")).alias("ambiguous")))
    known = versions.groupBy("stream").agg(F.map_from_entries(F.collect_list(F.when(F.col("version").isNotNull(), entry))).alias("_schemas"))
    joined = records.join(by_shuffle(known), "stream", "left").withColumn("_own", F.try_element_at("_schemas", F.col("schema_version")))
    error = (
        F.when(F.col("_schemas").isNull(), "unknown stream")
        .when(F.col("_own.ambiguous"), "ambiguous version")
        .when(F.col("_own.text").isNull(), "unknown version")
    )
    return joined.withColumn("error", error).withColumn("schema_json", F.when(F.col("error").isNull(), F.col("_own.text"))).drop("_schemas", "_own")


def decode_by_registry(records: DataFrame, schemas: DataFrame, body: str = "body", out: str = "payload") -> DataFrame:
    """Records of many streams, each decoded by the schema that its stream and version name in the registry.

    Adds ``out``, the record as JSON of its own schema, and ``error``: ``unknown stream``, ``unknown version``, ``ambiguous
    version``, ``unreadable schema`` or ``unreadable``, a body that isn't a record of its schema. The records are read once,
    however many schemas they use; streams that share a schema are decoded alike.
    """

    def decode(node, schema_json: str) -> dict:
        schema = avro.load(schema_json)
        payload = F.to_json(avro.typed(node, schema), {"ignoreNullFields": "false"})
        return {out: F.when(F.coalesce(avro.accepts(node, schema), F.lit(False)), payload)}

    attached = join_writer_schema(records, schemas)
    decoded = each_by_its_own(attached, ["schema_json"], schemas, body, decode, {out: "string"})
    error = F.coalesce(F.col("error"), F.when(F.col("unreadable"), "unreadable schema"), F.when(F.col(out).isNull(), "unreadable"))
    return decoded.withColumn("error", error).drop("unreadable")


def decode_by_version(records: DataFrame, schemas: dict[int, str], body: str = "body", out: str = "decoded") -> DataFrame:
    """Decode each JSON body with the schema of its own version, in one scan.

    Adds a struct with one member per version, ``v<version>``, of which only the record's own is set. Records
    of versions that are not listed decode to nothing.
    """
    node = F.try_parse_json(F.col(body))
    members = []
    for version, text in sorted(schemas.items()):
        value = avro.typed(F.col("_node"), avro.load(text))
        members.append(F.when(F.col("schema_version") == version, value).alias(f"v{version}"))
    return records.withColumn("_node", node).withColumn(out, F.struct(*members)).drop("_node")


def read_as_latest(records: DataFrame, schema_json: str, body: str = "body", out: str = "message") -> DataFrame:
    """Decode every record as the given (newest) schema: fields it lacks are null or take their default."""
    schema = avro.load(schema_json)
    return (
        records.withColumn("_node", F.try_parse_json(F.col(body)))
        .withColumn(out, avro.typed(F.col("_node"), schema))
        .drop("_node")
    )


def serve(
    records: DataFrame,
    schemas: dict[int, str],
    grants: set[str] | frozenset = frozenset(),
    replacer=blank,
    body: str = "body",
    reader_schema: str | None = None,
) -> DataFrame:
    """``(partition, offset, schema, timestampMs, payload)`` with the payload as JSON of the record's own
    schema, or of the one the reader asks for, personal data replaced unless granted.

    What a reader's schema marks as personal is masked besides what the newest of ``schemas`` marks so: a reader can't
    lift the mark of a field.
    """
    granted = GRANT_PII in {g.upper() for g in grants}
    if reader_schema is not None:
        marked = avro.keep_marks(avro.load(reader_schema), avro.load(schemas[max(schemas)]))
        decoded = records.withColumn("_decoded", avro.typed(F.try_parse_json(F.col(body)), marked))
        value = F.col("_decoded")
        shown = value if granted else mask_column(value, decoded.schema["_decoded"].dataType, replacer)
        payload = F.to_json(shown, {"ignoreNullFields": "false"})
        return decoded.select("partition", "offset", F.col("schema_version").alias("schema"), F.col("ts_ms").alias("timestampMs"), payload.alias("payload"))
    decoded = decode_by_version(records, schemas, body, "_decoded")
    types = {f.name: f.dataType for f in decoded.schema["_decoded"].dataType.fields}
    payloads = []
    for version in sorted(schemas):
        name = f"v{version}"
        value = F.col("_decoded")[name]
        payloads.append(F.to_json(value if granted else mask_column(value, types[name], replacer), {"ignoreNullFields": "false"}))
    return decoded.select(
        "partition",
        "offset",
        F.col("schema_version").alias("schema"),
        F.col("ts_ms").alias("timestampMs"),
        F.coalesce(*payloads).alias("payload"),
    )


def resume(log: DataFrame, commits: DataFrame, mode: str = "LATEST", ends: DataFrame | None = None) -> DataFrame:
    """Records one consumer group has not read yet. ``commits(partition, next_offset)`` are its positions;
    partitions without one are read from their begin (EARLIEST) or from their end (LATEST). ``ends`` are those kept beside
    the log, without which the log is scanned for them."""
    ends = log_ends(log) if ends is None else ends
    default = F.col("begin") if mode.upper() == "EARLIEST" else F.col("end")
    positions = ends.join(commits.select("partition", "next_offset"), "partition", "left").select(
        "partition", F.coalesce("next_offset", default).alias("position")
    )
    return resume_read(log, positions)
