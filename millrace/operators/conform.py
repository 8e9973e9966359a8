"""Strict admission of JSON messages against a declared schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import avro

ACCEPTED_TEXT = "Message accepted."


def _nodes(schema: dict, message: Column) -> dict[str, Column]:
    """The node of each top-level field, as columns of its own: they are looked up once, whatever they are
    checked for."""
    return {f"_node_{i}": avro.child(message, f["name"]) for i, f in enumerate(schema["fields"])}


def reject_reason(message: Column, is_object: Column, schema: dict, nodes: list[Column] | None = None) -> Column:
    """Why a parsed message does not conform, naming the first faulty field; NULL when it does."""
    if nodes is None:
        nodes = [avro.child(message, f["name"]) for f in schema["fields"]]
    faults = [
        F.concat(avro.field_fault(node, field), F.lit(f":{field['name']}"))
        for node, field in zip(nodes, schema["fields"])
    ]
    reason = F.when(message.isNull(), "unparseable").when(~is_object, "not an object")
    return reason.otherwise(F.coalesce(*faults)) if faults else reason


def opens_object(text: Column) -> Column:
    """Whether valid JSON text holds an object, told by what it opens with, at no cost for large messages."""
    return F.ltrim(text, F.lit(" \t\r\n")).startswith("{")


def conform(df: DataFrame, schema_json: str, body: str = "body", version: int | None = None, parsed: bool = False) -> DataFrame:
    """Judge each message. Adds ``reason`` (NULL = accepted), ``message`` (typed, NULL if rejected)
    and, when given, the ``schema_version`` it was judged by. ``parsed`` says that the body is a VARIANT.

    Narrow work only: the text is parsed once into a VARIANT and every check is a native expression.
    Unknown fields are ignored.
    """
    schema = avro.load(schema_json)
    looked_up = _nodes(schema, F.col("_parsed"))
    nodes = [F.col(name) for name in looked_up]
    is_object = F.schema_of_variant("_parsed").startswith("OBJECT") if parsed else opens_object(F.col(body))
    judged = (
        df.withColumn("_parsed", F.col(body) if parsed else F.try_parse_json(F.col(body)))
        .withColumns(looked_up)
        .withColumn("reason", reject_reason(F.col("_parsed"), is_object, schema, nodes))
    )
    typed = F.struct(*[avro.typed_field(n, f) for n, f in zip(nodes, schema["fields"])])
    out = judged.withColumn("message", F.when(F.col("reason").isNull(), typed))
    if version is not None:
        out = out.withColumn("schema_version", F.lit(version).cast("int"))
    return out.drop("_parsed", *looked_up)


def accepted(judged: DataFrame) -> DataFrame:
    return judged.where(F.col("reason").isNull()).drop("reason")


def rejected(judged: DataFrame) -> DataFrame:
    return judged.where(F.col("reason").isNotNull()).drop("message")


def responses(judged: DataFrame, keys: list[str], now: Column | None = None) -> DataFrame:
    """One answer per message, in request position: ``(keys, timestamp_ms, success, answer)``.

    A bad element never affects its neighbours.
    """
    stamp = now if now is not None else F.unix_millis(F.current_timestamp())
    return judged.select(
        *keys,
        stamp.alias("timestamp_ms"),
        F.col("reason").isNull().alias("success"),
        F.coalesce(F.col("reason"), F.lit(ACCEPTED_TEXT)).alias("answer"),
    )


def explode_request(df: DataFrame, keys: list[str], body: str = "body") -> DataFrame:
    """Elements of JSON array requests as ``(keys, pos, node, element)``, in order: the parsed node, and its
    text for those who ask for it.

    Bodies that are not arrays yield one row with a NULL position, so that they can be counted.
    """
    parsed = F.try_variant_get(F.try_parse_json(F.col(body)), "$", "array<variant>")
    return df.select(*keys, F.posexplode_outer(parsed).alias("pos", "node")).select(
        *keys, "pos", "node", F.to_json("node").alias("element")
    )


def available_requests(requests: DataFrame, streams: DataFrame) -> DataFrame:
    """Attach the stream of each request and say why a whole request must be refused.

    ``streams(stream, enabled, latest_version)`` is metadata; Spark picks a broadcast from its size.
    Adds ``refusal``: ``unknown stream`` / ``disabled`` / ``no schema`` / NULL.
    """
    known = streams.select("stream", "enabled", "latest_version", F.lit(True).alias("_known"))
    return (
        requests.join(known, "stream", "left")
        .withColumn(
            "refusal",
            F.when(F.col("_known").isNull(), "unknown stream")
            .when(~F.col("enabled"), "disabled")
            .when(F.col("latest_version").isNull(), "no schema"),
        )
        .drop("_known")
    )
