"""Masking of personal data, driven by the ``sensitivity`` metadata of a DataFrame's schema."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Replacer = Callable[[Column], Column]
GRANT_PII = "PII"


def blank(text: Column) -> Column:
    """The standard replacement: any text becomes empty, null stays null."""
    return F.when(text.isNotNull(), F.lit(""))


def _is_pii(metadata: dict) -> bool:
    return str((metadata or {}).get("sensitivity", "")).upper() == "PII"


def _masked(value: Column, dtype: T.DataType, pii: bool, replacer: Replacer) -> Column | None:
    """The masked form of a value, or None when nothing below it is personal."""
    if pii and isinstance(dtype, T.StringType):
        return replacer(value)
    if pii and isinstance(dtype, T.BinaryType):
        return F.when(value.isNotNull(), F.lit(b""))
    if isinstance(dtype, T.StructType):
        changed = False
        for field in dtype.fields:
            inner = _masked(value[field.name], field.dataType, _is_pii(field.metadata), replacer)
            if inner is not None:
                value, changed = value.withField(f"`{field.name}`", inner), True
        return value if changed else None
    if isinstance(dtype, T.ArrayType):
        if not _touches(dtype.elementType):
            return None
        return F.transform(value, lambda e: _masked(e, dtype.elementType, False, replacer))
    if isinstance(dtype, T.MapType):
        if not _touches(dtype.valueType):
            return None
        return F.transform_values(value, lambda _, e: _masked(e, dtype.valueType, False, replacer))
    return None


def _touches(dtype: T.DataType) -> bool:
    """Whether a type holds a PII field anywhere inside."""
    if isinstance(dtype, T.StructType):
        return any(_is_pii(f.metadata) or _touches(f.dataType) for f in dtype.fields)
    if isinstance(dtype, T.ArrayType):
        return _touches(dtype.elementType)
    if isinstance(dtype, T.MapType):
        return _touches(dtype.valueType)
    return False


def mask_column(value: Column, dtype: T.DataType, replacer: Replacer = blank) -> Column:
    masked = _masked(value, dtype, False, replacer)
    return value if masked is None else masked


def mask_pii(df: DataFrame, grants: set[str] | frozenset = frozenset(), replacer: Replacer = blank) -> DataFrame:
    """Replace personal data in every tagged field, at any depth, unless PII was granted.

    A granted read gets the plan unchanged; otherwise the masking is a native projection that Spark
    still prunes and fuses with its neighbours.
    """
    if GRANT_PII in {g.upper() for g in grants}:
        return df
    changes = {}
    for field in df.schema.fields:
        masked = _masked(F.col(f"`{field.name}`"), field.dataType, _is_pii(field.metadata), replacer)
        if masked is not None:
            changes[field.name] = masked
    return df.withColumns(changes) if changes else df
