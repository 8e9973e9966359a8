"""Typed notifications about streams, schemas and landings, one wide table for all of them."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
PROTOCOL = "1.0"
SIZE_LIMIT = 262_144
TYPES = (
    "ROAD_CREATED",
    "SCHEMA_VERSION_ADDED",
    "SCHEMA_VERSION_DELETED",
    "HIVE_TABLE_CREATED",
    "HIVE_PARTITION_CREATED",
)


def notification(kind: str, stream: Column, **fields: Column) -> list[Column]:
    """Columns of a notification: its attributes, its text (nulls left out) and whether it is oversized."""
    if kind not in TYPES:
        raise ValueError(f"unknown notification {kind!r}")
    body = F.to_json(
        F.struct(
            F.lit(PROTOCOL).alias("protocolVersion"),
            F.lit(kind).alias("type"),
            stream.alias("roadName"),
            *[value.alias(name) for name, value in fields.items()],
        )
    )
    return [
        F.lit(kind).alias("type"),
        stream.alias("stream"),
        F.lit(PROTOCOL).alias("protocol"),
        body.alias("message"),
        (F.octet_length(body) > SIZE_LIMIT).alias("oversized"),
    ]


def stream_created(streams: DataFrame) -> DataFrame:
    return streams.select(
        *notification(
            "ROAD_CREATED", F.col("stream"), description=F.col("description"), teamName=F.col("team_name"),
            contactEmail=F.col("contact_email"),
        )
    )


def schema_added(versions: DataFrame) -> DataFrame:
    return versions.select(*notification("SCHEMA_VERSION_ADDED", F.col("stream"), schemaVersion=F.col("version")))


def schema_deleted(versions: DataFrame) -> DataFrame:
    return versions.select(*notification("SCHEMA_VERSION_DELETED", F.col("stream"), schemaVersion=F.col("version")))


def table_created(tables: DataFrame, metastore: str, database: str) -> DataFrame:
    return tables.select(
        *notification(
            "HIVE_TABLE_CREATED", F.col("stream"), metastoreUris=F.lit(metastore), databaseName=F.lit(database),
            tableName=F.col("table"), partitionColumnName=F.lit("acquisition_instant"), baseLocation=F.col("location"),
        )
    )


def partition_created(landings: DataFrame, metastore: str, database: str) -> DataFrame:
    return landings.select(
        *notification(
            "HIVE_PARTITION_CREATED", F.col("stream"), metastoreUris=F.lit(metastore), databaseName=F.lit(database),
            tableName=F.col("table"),
            partitionSpec=F.concat(F.lit("acquisition_instant="), "acquisition_instant"),
            locationUri=F.col("location"), recordCount=F.col("record_count"),
        )
    )


def send(notifications: DataFrame, senders: Iterable[Callable[[DataFrame], None]]) -> None:
    """Give every notification to every sender; oversized ones are flagged, not withheld."""
    for sender in senders:
        sender(notifications)
