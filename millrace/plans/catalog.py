"""Catalog changes as one batch job: requests in, patch sets and rejects out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators import catalog
from millrace.operators.registry import latest_active_schema, schema_fields
from millrace.session import settle

REQUEST_KINDS = ("create_stream", "register_schema", "delete_schema", "destination", "patch", "delete_stream")


def apply_catalog_changes(
    requests: dict[str, DataFrame], streams: DataFrame, schemas: DataFrame, now_ms: Column
) -> tuple[DataFrame, DataFrame]:
    """Judge every kind of request against the catalog; returns ``(patches, rejects)``.

    ``requests`` maps a kind to its rows. Patches are ``(kind, document_id, operations)``, rejects are
    ``(kind, stream, reason)``.
    """
    judged = {}
    if "create_stream" in requests:
        judged["create_stream"] = catalog.create_streams(requests["create_stream"], streams, now_ms)
    if "register_schema" in requests:
        judged["register_schema"] = catalog.register_schemas(requests["register_schema"], streams, schemas, schema_fields)
    if "delete_schema" in requests:
        judged["delete_schema"] = catalog.delete_schema_versions(requests["delete_schema"], schemas)
    if "destination" in requests:
        judged["destination"] = catalog.destination_changes(requests["destination"], streams)
    if "patch" in requests:
        latest = schema_fields(latest_active_schema(schemas))
        judged["patch"] = catalog.validate_patches(requests["patch"], streams, latest, now_ms)
    if "delete_stream" in requests:
        judged["delete_stream"] = catalog.delete_streams(requests["delete_stream"], streams)
    parts = [
        rows.select(F.lit(kind).alias("kind"), "stream", "reason", "operations") for kind, rows in judged.items()
    ]
    every = settle(reduce(DataFrame.unionByName, parts), "catalog-changes")
    patches = every.where(F.col("reason").isNull()).select("kind", F.col("stream").alias("document_id"), "operations")
    return patches, every.where(F.col("reason").isNotNull()).select("kind", "stream", "reason")
