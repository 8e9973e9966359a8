"""Ingest: JSON requests to log records, answers and rejects."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import avro, keypath
from millrace.operators import registry
from millrace.operators.conform import (
    accepted,
    available_requests,
    conform,
    explode_request,
    reject_reason,
    rejected,
    responses,
)
from millrace.plans.by_schema import each_by_its_own


@dataclass(frozen=True)
class Ingested:
    """What a batch of messages became; all three are lazy views of one judged projection."""

    accepted: DataFrame
    rejected: DataFrame
    responses: DataFrame


#: Begins the text that places a message without a key, so that it isn't taken for a key.
NO_KEY = "no key:"


def partition_by_key(
    df: DataFrame, key_path: str | None, partitions: int, body: str = "body", hashing=keypath.key_hash, identity: list[str] | None = None
) -> DataFrame:
    """Add the ``partition`` of each message from its key node.

    Equal keys share a partition, an explicit null is a key like any other, and messages without the key -
    or streams without a key path - spread evenly, each by the columns that name it (``identity``, by default its
    body). ``body`` may be text or a message that is parsed already.
    """
    parsed = df.schema[body].dataType.simpleString() == "variant"
    node = keypath.key_node(F.col(body) if parsed else F.try_parse_json(F.col(body)), key_path)
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in identity] if identity else [F.to_json(body) if parsed else F.col(body)]
    spread = F.concat_ws("|", F.lit(NO_KEY), *named)
    return df.withColumn("partition", keypath.partition_number(hashing(node, spread), partitions))


def ingest(
    df: DataFrame,
    schema_json: str,
    version: int,
    keys: list[str],
    key_path: str | None = None,
    partitions: int = 6,
    body: str = "body",
) -> Ingested:
    """Judge messages by the newest schema and place the accepted ones on partitions."""
    judged = conform(df, schema_json, body, version)
    return Ingested(
        accepted=partition_by_key(accepted(judged), key_path, partitions, body),
        rejected=rejected(judged),
        responses=responses(judged, keys),
    )


def judge_by_stream(df: DataFrame, schemas: dict[str, tuple[int, str]], node: str = "node") -> DataFrame:
    """Judge parsed messages of many streams in one pass, each by its stream's ``(version, schema)``.

    Streams that share a schema share one compiled check, and those at one version one test: work per message follows
    the schemas and versions in use, not the streams. Adds ``reason`` and ``schema_version``.
    """
    by_schema: dict[str, list[str]] = {}
    by_version: dict[int, list[str]] = {}
    for stream, (version, text) in schemas.items():
        by_schema.setdefault(text, []).append(stream)
        by_version.setdefault(version, []).append(stream)
    is_object = F.schema_of_variant(node).startswith("OBJECT")
    checks = [
        F.when(F.col("stream").isin(*names), reject_reason(F.col(node), is_object, avro.load(text)))
        for text, names in by_schema.items()
    ]
    versions = [F.when(F.col("stream").isin(*names), F.lit(version)) for version, names in by_version.items()]
    return df.withColumn("reason", F.coalesce(*checks)).withColumn("schema_version", F.coalesce(*versions).cast("int"))


def answer_requests(
    requests: DataFrame, streams: DataFrame, schemas: dict[str, tuple[int, str]], now: Column | None = None
) -> DataFrame:
    """Answers to array requests ``(request_id, stream, body)``: one per element, in position.

    A fault of one element leaves its neighbours alone; what refuses the whole request - an unknown or
    disabled stream, or one without a schema - is the answer of every element.
    """
    judged_requests = available_requests(requests, streams)
    elements = explode_request(judged_requests, ["request_id", "stream", "refusal"]).where("pos is not null")
    judged = judge_by_stream(elements, schemas).withColumn("reason", F.coalesce("refusal", "reason"))
    return responses(judged, ["request_id", "stream", "pos"], now)


NO_ARRAY = "not an array"


def admit_by_registry(
    requests: DataFrame,
    catalog: DataFrame,
    schemas: DataFrame,
    partitions: int = 6,
    hashing=keypath.key_hash,
    keys: tuple[str, ...] = ("request_id", "stream"),
) -> DataFrame:
    """Elements of array requests ``(request_id, stream, body)`` of many streams, judged by the newest schema that the registry
    lists for their stream, and placed by the stream's key path.

    ``catalog(stream, enabled, partition_path)``, ``schemas(stream, version, schema_json, deleted)``. A row per element:
    the request's ``keys``, ``pos``, ``element`` (its text), ``reason`` (null: admitted), ``schema_version`` and
    ``partition``. A body that is no array is one row without a position. What refuses a whole request - an unknown or
    disabled stream, one without a schema or with an ambiguous one - is the reason of each of its elements; a schema
    that can't be read refuses its own streams' elements alone. Checks are compiled once for each schema and key path in use.
    """
    newest = registry.newest_schemas(schemas)
    known = catalog.select("stream", "enabled", "partition_path").join(newest, "stream", "left").withColumnRenamed("version", "latest_version")
    refused = available_requests(requests, known).drop("enabled")
    refused = refused.join(known.select("stream", "schema_json", "ambiguous", "partition_path"), "stream", "left")
    refusal = F.coalesce("refusal", F.when(F.col("ambiguous"), "ambiguous schema"))
    carried = [*keys, "refusal", "latest_version", "schema_json", "partition_path"]
    elements = explode_request(refused.withColumn("refusal", refusal), carried).drop("node")
    reason = F.coalesce("refusal", F.when(F.col("pos").isNull(), NO_ARRAY))
    elements = elements.withColumn("refusal", reason).withColumn("schema_json", F.when(reason.isNull(), F.col("schema_json")))

    def judge(node: Column, schema_json: str, key_path: str | None) -> dict[str, Column]:
        is_object = F.coalesce(F.schema_of_variant(node).startswith("OBJECT"), F.lit(False))
        spread = F.concat_ws("|", F.lit(NO_KEY), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (*keys, "pos")))
        place = keypath.partition_number(hashing(keypath.key_node(node, key_path), spread), partitions)
        return {"reason": reject_reason(node, is_object, avro.load(schema_json)), "partition": place}

    recipes = known.select("schema_json", "partition_path")
    judged = each_by_its_own(elements, ["schema_json", "partition_path"], recipes, "element", judge, {"reason": "string", "partition": "int"})
    reason = F.coalesce("refusal", F.when(F.col("unreadable"), "unreadable schema"), "reason")
    admitted = F.col("reason").isNull()
    return judged.select(
        *keys, "pos", "element", reason.alias("reason"), F.col("latest_version").alias("schema_version"), "partition"
    ).withColumn("partition", F.when(admitted, F.col("partition")))
