"""Avro schema documents as Spark types and as expressions over VARIANT messages.

Schemas are metadata: they are read on the driver (or, for whole registries, inside ``mapInPandas``)
and compiled into column expressions, so that no Python runs per message.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

PII = {"sensitivity": "PII"}

# Avro primitive -> Spark type.
_PRIMITIVES = {
    "null": T.NullType(),
    "boolean": T.BooleanType(),
    "int": T.IntegerType(),
    "long": T.LongType(),
    "float": T.FloatType(),
    "double": T.DoubleType(),
    "string": T.StringType(),
    "bytes": T.BinaryType(),
}
# Logical types that change the Spark type of their carrier.
_LOGICAL = {
    ("int", "date"): T.DateType(),
    ("long", "timestamp-millis"): T.TimestampType(),
    ("long", "timestamp-micros"): T.TimestampType(),
}
# Logical type -> carriers it may annotate.
LOGICAL_CARRIERS = {
    "decimal": ("bytes", "fixed"),
    "uuid": ("string",),
    "date": ("int",),
    "time-millis": ("int",),
    "time-micros": ("long",),
    "timestamp-millis": ("long",),
    "timestamp-micros": ("long",),
}


class SchemaError(ValueError):
    """The text is not a usable schema."""


def load(text: str) -> dict:
    """Schema text as a tree whose every node is a dict with a plain string ``type``."""
    return _node(json.loads(text), {})


def _node(raw, names: dict) -> dict:
    if isinstance(raw, str):
        if raw in _PRIMITIVES:
            return {"type": raw}
        if raw in names:
            return names[raw]
        raise SchemaError(f"unknown type {raw!r}")
    if isinstance(raw, list):
        return {"type": "union", "branches": [_node(b, names) for b in raw]}
    kind = raw.get("type")
    if not isinstance(kind, str):
        return _node(kind, names)
    node = dict(raw)
    if kind in ("record", "enum", "fixed"):
        names[raw["name"]] = node
        if raw.get("namespace"):
            names[f"{raw['namespace']}.{raw['name']}"] = node
    if kind == "record":
        node["fields"] = [{**f, "schema": _node(f["type"], names)} for f in raw["fields"]]
    elif kind == "array":
        node["items"] = _node(raw["items"], names)
    elif kind == "map":
        node["values"] = _node(raw["values"], names)
    elif kind not in _PRIMITIVES and kind not in ("enum", "fixed"):
        return _node(kind, names)
    return node


def is_pii(props: dict) -> bool:
    return str(props.get("sensitivity", "")).upper() == "PII"


def nullable(node: dict) -> bool:
    return node["type"] == "null" or (
        node["type"] == "union" and any(b["type"] == "null" for b in node["branches"])
    )


def _solid(node: dict) -> list[dict]:
    """The branches of a union other than null."""
    return [b for b in node["branches"] if b["type"] != "null"]


def spark_type(node: dict) -> T.DataType:
    """Spark type of a schema; PII fields carry ``sensitivity`` in their field metadata.

    A union of several types becomes a struct with one nullable member per branch.
    """
    kind = node["type"]
    if kind == "record":
        return T.StructType([_struct_field(f) for f in node["fields"]])
    if kind == "array":
        return T.ArrayType(spark_type(node["items"]))
    if kind == "map":
        return T.MapType(T.StringType(), spark_type(node["values"]))
    if kind == "union":
        solid = _solid(node)
        if not solid:
            return T.NullType()
        if len(solid) == 1:
            return spark_type(solid[0])
        return T.StructType(
            [T.StructField(f"branch_{i}", spark_type(b)) for i, b in enumerate(_mark_siblings(solid))]
        )
    if kind == "enum":
        return T.StringType()
    if kind == "fixed":
        return T.BinaryType()
    return _LOGICAL.get((kind, node.get("logicalType")), _PRIMITIVES[kind])


def _struct_field(field: dict) -> T.StructField:
    return T.StructField(field["name"], spark_type(field["schema"]), True, dict(PII) if is_pii(field) else {})


def _mark_siblings(branches: list[dict]) -> list[dict]:
    """A PII field of one union branch marks the field of that name in the other branches too."""
    tagged = {f["name"] for b in branches if b["type"] == "record" for f in b["fields"] if is_pii(f)}
    return [
        {**b, "fields": [{**f, **PII} if f["name"] in tagged else f for f in b["fields"]]}
        if b["type"] == "record"
        else b
        for b in branches
    ]


def keep_marks(schema: dict, marked: dict) -> dict:
    """A record schema with the personal-data marks that another has on fields of the same names, at any depth of
    records in records."""
    if schema["type"] != "record" or marked["type"] != "record":
        return schema
    of = {f["name"]: f for f in marked["fields"]}
    fields = []
    for f in schema["fields"]:
        if f["name"] in of:
            f = {**f, "schema": keep_marks(f["schema"], of[f["name"]]["schema"]), **(PII if is_pii(of[f["name"]]) else {})}
        fields.append(f)
    return {**schema, "fields": fields}


def child(message: Column, name: str) -> Column:
    return F.try_variant_get(message, f"$['{name}']", "variant")


def _kind(node: Column) -> Column:
    return F.schema_of_variant(node)


def accepts(node: Column, schema: dict) -> Column:
    """Whether a present VARIANT node is a value of the schema, without any coercion."""
    kind = schema["type"]
    if kind == "null":
        return F.is_variant_null(node)
    if kind == "union":
        verdict = F.lit(False)
        for branch in schema["branches"]:
            verdict = verdict | accepts(node, branch)
        return verdict
    if kind == "boolean":
        return _kind(node) == "BOOLEAN"
    if kind == "int":
        return (_kind(node) == "BIGINT") & F.try_variant_get(node, "$", "int").isNotNull()
    if kind == "long":
        return _kind(node) == "BIGINT"
    if kind in ("float", "double"):
        return _kind(node).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    if kind in ("string", "bytes"):
        return _kind(node) == "STRING"
    if kind == "enum":
        return (_kind(node) == "STRING") & F.coalesce(
            F.try_variant_get(node, "$", "string").isin(list(schema["symbols"])), F.lit(False)
        )
    if kind == "fixed":
        return (_kind(node) == "STRING") & F.coalesce(
            F.length(F.try_variant_get(node, "$", "string")) == int(schema["size"]), F.lit(False)
        )
    if kind == "array":
        items = F.try_variant_get(node, "$", "array<variant>")
        return _kind(node).startswith("ARRAY") & F.coalesce(
            F.forall(items, lambda e: accepts(e, schema["items"])), F.lit(False)
        )
    if kind == "map":
        values = F.map_values(F.try_variant_get(node, "$", "map<string,variant>"))
        return _kind(node).startswith("OBJECT") & F.coalesce(
            F.forall(values, lambda e: accepts(e, schema["values"])), F.lit(False)
        )
    verdict = _kind(node).startswith("OBJECT")
    for field in schema["fields"]:
        verdict = verdict & field_fault(child(node, field["name"]), field).isNull()
    return verdict


def field_fault(node: Column, field: dict) -> Column:
    """``missing`` / ``null`` / ``type`` when the node of a field breaks its schema, else NULL."""
    schema = field["schema"]
    optional = nullable(schema) or "default" in field
    missing = F.lit(None).cast("string") if optional else F.lit("missing")
    fault = F.when(node.isNull(), missing)
    if not nullable(schema):
        fault = fault.when(F.is_variant_null(node), F.lit("null"))
    return fault.when(~accepts(node, schema), F.lit("type"))


def typed(node: Column, schema: dict) -> Column:
    """The VARIANT node as a value of :func:`spark_type`; NULL wherever it does not fit."""
    kind = schema["type"]
    if kind == "record":
        parts = [typed_field(child(node, f["name"]), f) for f in schema["fields"]]
        return F.when(_kind(node).startswith("OBJECT"), F.struct(*parts))
    if kind == "array":
        return F.transform(F.try_variant_get(node, "$", "array<variant>"), lambda e: typed(e, schema["items"]))
    if kind == "map":
        return F.transform_values(
            F.try_variant_get(node, "$", "map<string,variant>"), lambda _, e: typed(e, schema["values"])
        )
    if kind == "union":
        solid = _solid(schema)
        if not solid:
            return F.lit(None)
        if len(solid) == 1:
            return typed(node, solid[0])
        return _typed_branches(node, _mark_siblings(solid))
    if kind in ("bytes", "fixed"):
        return F.encode(F.try_variant_get(node, "$", "string"), "ISO-8859-1")
    logical = schema.get("logicalType")
    if (kind, logical) == ("int", "date"):
        return F.date_from_unix_date(F.try_variant_get(node, "$", "int"))
    if (kind, logical) == ("long", "timestamp-millis"):
        return F.timestamp_millis(F.try_variant_get(node, "$", "bigint"))
    if (kind, logical) == ("long", "timestamp-micros"):
        return F.timestamp_micros(F.try_variant_get(node, "$", "bigint"))
    if kind == "enum":
        return F.try_variant_get(node, "$", "string")
    if kind == "null":
        return F.lit(None)
    return F.try_variant_get(node, "$", _PRIMITIVES[kind].simpleString())


def typed_field(node: Column, field: dict) -> Column:
    """The node of a field as its named, tagged value; a missing one takes the default."""
    value = typed(node, field["schema"])
    default = field.get("default")
    if default is not None:
        schema = field["schema"]
        value = F.when(node.isNull(), typed(F.parse_json(F.lit(json.dumps(default))), schema)).otherwise(value)
    return value.alias(field["name"], metadata=dict(PII)) if is_pii(field) else value.alias(field["name"])


def _typed_branches(node: Column, branches: list[dict]) -> Column:
    """One struct member per branch; only the first branch that accepts the value is set."""
    members, taken = [], F.lit(False)
    for i, branch in enumerate(branches):
        fits = accepts(node, branch)
        members.append(F.when(fits & ~taken, typed(node, branch)).alias(f"branch_{i}"))
        taken = taken | fits
    return F.when(node.isNotNull() & ~F.is_variant_null(node), F.struct(*members))


# One row per node of a schema, in document order.
NODE_SCHEMA = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("plain_path", T.StringType()),
        T.StructField("parent_path", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("depth", T.IntegerType()),
        T.StructField("type", T.StringType()),
        T.StructField("nullable", T.BooleanType()),
        T.StructField("has_default", T.BooleanType()),
        T.StructField("pii", T.BooleanType()),
        T.StructField("type_pii", T.BooleanType()),
        T.StructField("aliases", T.ArrayType(T.StringType())),
        T.StructField("branch_types", T.ArrayType(T.StringType())),
        T.StructField("symbols", T.ArrayType(T.StringType())),
        T.StructField("logical_type", T.StringType()),
        T.StructField("logical_ok", T.BooleanType()),
        T.StructField("logical_on_field", T.BooleanType()),
    ]
)


def nodes(schema: dict) -> Iterator[tuple]:
    """Rows of :data:`NODE_SCHEMA`. Steps are field names, ``*`` for elements and map values, and
    the branch index inside unions; ``plain_path`` leaves the branch indexes out."""

    def visit(node, depth, here, plain, parent, kind, field):
        branches = node.get("branches", ())
        logical = node.get("logicalType")
        yield (
            here,
            plain,
            parent,
            kind,
            field.get("name"),
            depth,
            node["type"],
            nullable(node),
            "default" in field,
            is_pii(field),
            is_pii(node),
            list(field.get("aliases", ())),
            [b["type"] for b in branches],
            list(node.get("symbols", ())),
            logical,
            _logical_ok(node, logical),
            "logicalType" in field,
        )
        if node["type"] == "record":
            for f in node["fields"]:
                step = f"/{f['name']}"
                yield from visit(f["schema"], depth + 1, here + step, plain + step, here, "field", f)
        elif node["type"] in ("array", "map"):
            inner = node["items"] if node["type"] == "array" else node["values"]
            yield from visit(inner, depth + 1, f"{here}/*", f"{plain}/*", here, "element", {})
        for i, branch in enumerate(branches):
            yield from visit(branch, depth + 1, f"{here}/{i}", plain, here, "branch", {})

    yield from visit(schema, 0, "", "", None, "root", {})


# The one row of a schema that cannot be read.
UNREADABLE = ("", "", None, "root", None, 0, "unreadable", False, False, False, False, [], [], [], None, True, False)


def _logical_ok(node: dict, logical: str | None) -> bool:
    """Unknown logical types are ignored; known ones must sit on a carrier that can hold them."""
    if logical not in LOGICAL_CARRIERS:
        return True
    if node["type"] not in LOGICAL_CARRIERS[logical]:
        return False
    if logical != "decimal":
        return True
    precision, scale = node.get("precision", 0), node.get("scale", 0)
    return isinstance(precision, int) and precision > 0 and 0 <= scale <= precision
