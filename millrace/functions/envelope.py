"""Binary framing of log values: one magic byte, a big-endian schema version, the body."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAGIC = 0


def add_envelope(body: Column, version: Column) -> Column:
    """Frame a body with the schema version it was written with."""
    return F.concat(F.unhex(F.lit("00")), F.unhex(F.lpad(F.hex(version.cast("int")), 8, "0")), body)


def split_envelope(value: Column) -> Column:
    """``struct<format_version, schema_version, body>`` of a framed value; NULL when too short."""
    header = F.conv(F.hex(F.substring(value, 2, 4)), 16, 10).cast("bigint")
    signed = F.when(header >= 2**31, header - 2**32).otherwise(header)
    return F.when(
        F.octet_length(value) >= 5,
        F.struct(
            F.conv(F.hex(F.substring(value, 1, 1)), 16, 10).cast("int").alias("format_version"),
            signed.cast("int").alias("schema_version"),
            F.substring(value, F.lit(6), F.octet_length(value)).alias("body"),
        ),
    )


# First byte of a null-prefixed value: data follows / the value is null / the row is to be skipped.
HAS_DATA, IS_NULL, SKIP_ROW = 1, 2, 0


def wrap_nullable(data: Column) -> Column:
    """Prefix bytes so that a stored null differs from a tombstone."""
    return F.when(data.isNull(), F.unhex(F.lit("02"))).otherwise(F.concat(F.unhex(F.lit("01")), data))


def unwrap_nullable(value: Column) -> Column:
    """``struct<kind, data>`` where kind is data / null / skip / invalid; a NULL input is a tombstone."""
    first = F.conv(F.hex(F.substring(value, 1, 1)), 16, 10).cast("int")
    kind = (
        F.when(value.isNull(), "tombstone")
        .when(first == HAS_DATA, "data")
        .when(first == IS_NULL, "null")
        .when(first == SKIP_ROW, "skip")
        .otherwise("invalid")
    )
    data = F.when(first == HAS_DATA, F.substring(value, F.lit(2), F.octet_length(value)))
    return F.struct(kind.alias("kind"), data.alias("data"))
