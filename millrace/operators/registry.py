"""The schema registry as a table: its fields, rules, versions and compatibility.

``schemas(stream, version, schema_json, deleted)``. Only :func:`schema_fields` reads schema documents;
everything else is relational over its rows.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from millrace.functions.avro import NODE_SCHEMA, UNREADABLE, load, nodes
from millrace.functions.keypath import key_steps
from millrace.session import by_shuffle, settle

RESERVED = "acquisition_instant"
MODES = (
    "CAN_READ_ALL",
    "CAN_READ_LATEST",
    "CAN_BE_READ_BY_ALL",
    "CAN_BE_READ_BY_LATEST",
    "MUTUAL_READ_ALL",
    "MUTUAL_READ_LATEST",
)
# Written type > type it may be read as.
PROMOTIONS = (
    "int>long", "int>float", "int>double", "long>float", "long>double", "float>double",
    "string>bytes", "bytes>string",
)


#: Schemas that Python holds the nodes of at a time.
AT_ONCE = 1000


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, AT_ONCE):
            yield batch.slice(start, AT_ONCE)


def _texts(batch: pa.RecordBatch) -> tuple[list[str | None], np.ndarray]:
    """The distinct texts of a batch, null last, and the place of each schema's own among them."""
    texts = batch.column("schema_json").dictionary_encode()
    distinct = [*texts.dictionary.to_pylist(), None]
    return distinct, texts.indices.fill_null(len(distinct) - 1).to_numpy(zero_copy_only=False)


def _nodes(text: str | None) -> list[tuple]:
    try:
        return list(nodes(load(text)))
    except (ValueError, KeyError, TypeError, RecursionError):
        return [UNREADABLE]


def schema_fields(schemas: DataFrame) -> DataFrame:
    """One row per node of every schema: path, type, default, PII tag, aliases, logical type.

    Schemas that cannot be read yield one row of type ``unreadable``. Documents are dealt out evenly first:
    a registry is few bytes, and would otherwise be read by as many tasks as it has files. Python holds the nodes of
    ``AT_ONCE`` schemas, and reads a text that is repeated among these once.
    """
    keys = [f for f in schemas.schema.fields if f.name in ("stream", "version")]
    out = T.StructType(keys + NODE_SCHEMA.fields)

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = to_arrow_schema(out)
        for batch in _slices(batches):
            texts, which = _texts(batch)
            read = [_nodes(text) for text in texts]
            ends = np.cumsum([0, *map(len, read)])
            # The rows of each distinct text once; a schema takes those of its own text.
            rows = [row for found in read for row in found]
            columns = [pa.array([row[k] for row in rows], target.field(f.name).type) for k, f in enumerate(NODE_SCHEMA.fields)]
            many = np.diff(ends)[which]
            schema = np.repeat(np.arange(len(which)), many)
            node = np.arange(len(schema)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(ends[which], many)
            own = [batch.column(f.name).cast(target.field(f.name).type).take(pa.array(schema)) for f in keys]
            yield pa.RecordBatch.from_arrays([*own, *(c.take(pa.array(node)) for c in columns)], schema=target)

    tasks = schemas.sparkSession.sparkContext.defaultParallelism
    return schemas.select(*[f.name for f in keys], "schema_json").repartition(tasks).mapInArrow(explode, out)


def schema_rules(fields: DataFrame, strict_unions: bool = False) -> DataFrame:
    """Violations ``(stream, version, rule, path)`` of the rules a schema must meet to be registered."""
    reserved = (F.col("kind") == "field") & (F.col("depth") == 1) & (
        (F.lower("name") == RESERVED) | F.exists("aliases", lambda a: F.lower(a) == RESERVED)
    )
    solid = F.filter("branch_types", lambda b: b != "null")
    text = F.col("type").isin("string", "bytes") | (
        (F.col("type") == "union")
        & (F.size("branch_types") == 2)
        & (F.size(solid) == 1)
        & F.coalesce(F.get(solid, F.lit(0)).isin("string", "bytes"), F.lit(False))
    )
    optional = (F.size("branch_types") == 2) & F.array_contains("branch_types", "null")
    rules = {
        "unreadable": F.col("type") == "unreadable",
        "root-not-record": (F.col("kind") == "root") & ~F.col("type").isin("record", "unreadable"),
        "reserved-name": reserved,
        "pii-not-text": F.col("pii") & ~text,
        "pii-on-type": F.col("type_pii"),
        "logical-type-invalid": ~F.col("logical_ok"),
        "logical-type-on-field": F.col("logical_on_field"),
        "union-bytes-string": F.array_contains("branch_types", "bytes") & F.array_contains("branch_types", "string"),
    }
    if strict_unions:
        rules["union-not-nullable"] = (F.col("type") == "union") & ~optional
    broken = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in rules.items()]))
    return fields.select("stream", "version", F.explode(broken).alias("rule"), "path")


def pii_paths(fields: DataFrame) -> DataFrame:
    """Paths of personal data per schema."""
    return fields.where("pii").select("stream", "version", "path")


# -- versions -----------------------------------------------------------------------------------------


def active_schemas(schemas: DataFrame) -> DataFrame:
    return schemas.where(~F.col("deleted"))


def latest_active_schema(schemas: DataFrame) -> DataFrame:
    """Newest version per stream that is not deleted."""
    return (
        active_schemas(schemas)
        .groupBy("stream")
        .agg(F.max_by(F.struct("version", "schema_json"), F.col("version")).alias("s"))
        .select("stream", "s.version", "s.schema_json")
    )


def newest_schemas(schemas: DataFrame) -> DataFrame:
    """The newest version of each stream that is not deleted, and whether it is listed with unlike texts; null versions
    are no versions: ``(stream, version, schema_json, ambiguous)``."""
    versions = active_schemas(schemas).where("version is not null").groupBy("stream", "version")
    texts = versions.agg(F.min("schema_json").alias("schema_json"), F.max("schema_json").alias("_other"))
    own = F.struct("version", "schema_json", (F.col("schema_json") != F.col("_other")).alias("ambiguous"))
    return texts.groupBy("stream").agg(F.max_by(own, F.col("version")).alias("s")).select("stream", "s.*")


def next_version(streams: DataFrame, schemas: DataFrame) -> DataFrame:
    """The number the next schema gets: one past every version ever used, deleted ones included."""
    used = schemas.groupBy("stream").agg(F.max("version").alias("_max"))
    return streams.select("stream").join(by_shuffle(used), "stream", "left").select(
        "stream", (F.coalesce("_max", F.lit(0)) + 1).cast("int").alias("next_version")
    )


def duplicate_versions(schemas: DataFrame) -> DataFrame:
    """Versions registered more than once; there should be none."""
    return schemas.groupBy("stream", "version").agg(F.count("*").alias("copies")).where("copies > 1")


def deletable_version(schemas: DataFrame, requests: DataFrame) -> DataFrame:
    """Judge requests to delete a schema version: only the latest active one, named by its number.

    ``requests(stream, version)`` with the version as text. Adds ``number`` and ``reason``.
    """
    latest = latest_active_schema(schemas).select("stream", F.col("version").alias("_latest"))
    number = F.when(F.col("version").rlike("^[0-9]{1,9}$"), F.col("version").cast("int"))
    return (
        requests.join(by_shuffle(latest), "stream", "left")
        .withColumn("number", number)
        .withColumn(
            "reason",
            F.when(F.lower("version") == "latest", "version must be explicit")
            .when(F.col("number").isNull(), "not a version")
            .when(F.col("_latest").isNull(), "no active schema")
            .when(F.col("number") != F.col("_latest"), "not the latest version"),
        )
        .drop("_latest")
    )


# -- compatibility ------------------------------------------------------------------------------------


def schema_pairs(candidates: DataFrame, schemas: DataFrame) -> DataFrame:
    """Each candidate with the active versions before it: ``(stream, candidate, existing, is_latest)``.

    One candidate per stream, so pairs grow with the registry, not with its square.
    ``candidates(stream, version)``.
    """
    wanted = candidates.select("stream", F.col("version").alias("candidate"))
    older = (
        active_schemas(schemas)
        .select("stream", F.col("version").alias("existing"))
        .join(by_shuffle(wanted), "stream")
        .where("existing < candidate")
    )
    newest = older.groupBy("stream", "candidate").agg(F.max("existing").alias("_newest"))
    return older.join(by_shuffle(newest), ["stream", "candidate"]).select(
        "stream", "candidate", "existing", (F.col("existing") == F.col("_newest")).alias("is_latest")
    )


# What a place of a schema takes, in the order two namesakes are compared by; union branches count for the place they sit at.
PLACE = T.StructType(
    [
        T.StructField("types", T.ArrayType(T.StringType())),
        T.StructField("symbols", T.ArrayType(T.StringType())),
        T.StructField("has_default", T.BooleanType()),
        T.StructField("name", T.StringType()),
        T.StructField("aliases", T.ArrayType(T.StringType())),
    ]
)
PLACES = T.MapType(T.StringType(), PLACE)


def canonical_places(rows: Iterable[dict]) -> dict[str, dict]:
    """A schema's nodes reduced to what reading depends on: a value of ``PLACE`` for each path, paths in order."""
    held: dict[str, list[dict]] = {}
    for row in rows:
        held.setdefault(row["plain_path"], []).append(row)
    out = {}
    for path in sorted(held):
        here = held[path]
        own = max(here, key=lambda r: (r["kind"] == "field", r["name"] is not None, r["name"] or "", r["aliases"]))
        out[path] = {
            "types": sorted({r["type"] for r in here} - {"union"}),
            "symbols": sorted({symbol for r in here for symbol in r["symbols"]}),
            "has_default": any(r["has_default"] for r in here),
            "name": own["name"],
            "aliases": own["aliases"],
        }
    return out


def schema_forms(schemas: DataFrame) -> DataFrame:
    """The canonical form of every schema: the columns but ``schema_json``, then ``places`` (path to ``PLACE``) and
    ``print``, the SHA-256 of the form's text. Schemas that differ only in names of records, documentation, order of
    fields or personal-data tags have one print. A text that a batch repeats is read once; nothing is shuffled by key."""
    kept = [f for f in schemas.schema.fields if f.name != "schema_json"]
    out = T.StructType([*kept, T.StructField("places", PLACES), T.StructField("print", T.StringType())])
    names = NODE_SCHEMA.names

    def read(text: str | None) -> tuple[dict, str]:
        places = canonical_places(dict(zip(names, row, strict=True)) for row in _nodes(text))
        return places, hashlib.sha256(json.dumps(places, sort_keys=True).encode()).hexdigest()

    def forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = to_arrow_schema(out)
        for batch in _slices(batches):
            texts, which = _texts(batch)
            read_once, which = [read(text) for text in texts], pa.array(which)
            places = pa.array([list(p.items()) for p, _ in read_once], target.field("places").type).take(which)
            prints = pa.array([p for _, p in read_once], pa.string()).take(which)
            columns = [batch.column(f.name).cast(target.field(f.name).type) for f in kept]
            yield pa.RecordBatch.from_arrays([*columns, places, prints], schema=target)

    tasks = schemas.sparkSession.sparkContext.defaultParallelism
    return schemas.repartition(tasks).mapInArrow(forms, out)


def _forms_of(fields: DataFrame) -> DataFrame:
    """:func:`schema_forms` made of the rows of :func:`schema_fields`: ``(stream, version, places, print)``."""
    solid = F.when(F.col("type") != "union", F.col("type"))
    places = fields.where("version is not null").repartition("stream", "version").groupBy("stream", "version", "plain_path").agg(
        F.array_sort(F.collect_set(solid)).alias("types"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("symbols")))).alias("symbols"),
        F.max("has_default").alias("has_default"),
        F.max(F.struct(F.col("kind") == "field", "name", "aliases")).alias("_own"),
    )
    place = F.struct("types", "symbols", "has_default", F.col("_own.name").alias("name"), F.col("_own.aliases").alias("aliases"))
    entries = F.array_sort(F.collect_list(F.struct("plain_path", place.alias("place"))))
    forms = places.groupBy("stream", "version").agg(entries.alias("_entries"))
    return forms.select("stream", "version", F.map_from_entries("_entries").alias("places"), F.sha2(F.to_json("_entries"), 256).alias("print"))


def _fault(path: Column, node: Column, written: Column) -> Column:
    """Why the place ``node`` at ``path`` cannot be read from data of the form ``written``; null if it can."""
    parent = F.regexp_replace(path, "/[^/]*$", "")
    aliases = F.coalesce(node["aliases"], F.array().cast("array<string>"))
    own = F.when(node["name"].isNull(), F.array(path)).otherwise(
        F.transform(F.array_union(F.array(node["name"]), aliases), lambda n: F.concat(parent, F.lit("/"), n))
    )
    met = F.array_max(F.transform(own, lambda at: F.try_element_at(written, at)))
    promotions = F.array(*[F.lit(p) for p in PROMOTIONS])

    def unreadable(given):
        return ~F.exists(node["types"], lambda r: (r == given) | F.array_contains(promotions, F.concat(given, F.lit(">"), r)))

    lacking = node["name"].isNotNull() & ~node["has_default"] & F.map_contains_key(written, parent)
    strange = (F.size(node["symbols"]) > 0) & (F.size(F.array_except(met["symbols"], node["symbols"])) > 0)
    return (
        F.when(met.isNull(), F.when(lacking, "missing"))
        .when(F.exists(met["types"], unreadable), "type")
        .when(strange, "symbols")
    )


def read_faults(fields: DataFrame, pairs: DataFrame) -> DataFrame:
    """Why data written with one version cannot be read with another.

    ``pairs(stream, reader, writer)`` gives ``(stream, reader, writer, path, fault)``: a reader field that
    the writer lacks and that has no default, a type that cannot be promoted, or an unknown enum symbol.
    Fields match by name or alias.
    """
    forms = settle(_forms_of(fields).drop("print"), "schema-forms")
    reader = forms.select("stream", F.col("version").alias("reader"), F.col("places").alias("_read"))
    writer = forms.select("stream", F.col("version").alias("writer"), F.col("places").alias("_written"))
    met = pairs.select("stream", "reader", "writer").join(by_shuffle(reader), ["stream", "reader"]).join(by_shuffle(writer), ["stream", "writer"])
    placed = met.select("stream", "reader", "writer", "_written", F.explode("_read").alias("path", "_node"))
    fault = _fault(F.col("path"), F.col("_node"), F.col("_written"))
    return placed.select("stream", "reader", "writer", "path", fault.alias("fault")).where("fault is not null")


# Versions of a stream go to this many tasks, so that a stream with most of the registry is no task of its own.
SLOTS = 8


def compat_report(candidates: DataFrame, schemas: DataFrame, fields: DataFrame | None = None) -> DataFrame:
    """``(stream, version, mode, ok)`` for every compatibility mode of each candidate.

    A candidate with nothing before it is compatible in every mode. Both frames hold ``schema_json``, unless
    ``fields`` has the nodes of all their schemas. Schemas are compared by their canonical forms: those with one
    print can read each other and aren't walked. A version listed with unlike texts counts as all of them.
    """
    wanted, active = F.lit(True).alias("_wanted"), F.lit(False).alias("_wanted")
    keys = ["stream", F.col("version").cast("int").alias("version")]
    if fields is None:
        keys.append("schema_json")
    rows = candidates.select(*keys, wanted).union(active_schemas(schemas).select(*keys, active)).where("version is not null")
    forms = schema_forms(rows) if fields is None else rows.join(_forms_of(fields), ["stream", "version"], "left")
    forms = settle(forms, "schema-forms")
    older = forms.where("not _wanted").select(
        "stream", F.pmod("version", F.lit(SLOTS)).alias("_slot"), F.col("version").alias("existing"), F.col("places").alias("_old"), F.col("print").alias("_old_print")
    )
    newer = forms.where("_wanted").select("stream", F.col("version").alias("candidate"), F.col("places").alias("_new"), F.col("print").alias("_new_print"))
    newer = newer.withColumn("_slot", F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1))))
    pairs = older.join(by_shuffle(newer), ["stream", "_slot"]).where("existing < candidate")

    def reads(reader: str, writer: str) -> Column:
        faulty = F.exists(F.map_entries(reader), lambda e: _fault(e["key"], e["value"], F.col(writer)).isNotNull())
        return F.coalesce((F.col("_old_print") == F.col("_new_print")) | ~faulty, F.lit(True))

    judged = pairs.select("stream", "candidate", "existing", reads("_new", "_old").alias("r"), reads("_old", "_new").alias("b"))
    # Each candidate stands for itself below every version, so one with nothing before it is there, too.
    alone = forms.where("_wanted").select(
        "stream", F.col("version").alias("candidate"), F.lit(-(2**31)).cast("int").alias("existing"), F.lit(True).alias("r"), F.lit(True).alias("b")
    )
    every = judged.union(alone).withColumn("m", F.col("r") & F.col("b"))
    verdicts = []
    for mode, way in zip(MODES, "rrbbmm", strict=True):
        latest = F.max(F.struct(F.col("existing"), (~F.col(way)).alias("broken")))["broken"]
        verdicts.append((~latest if mode.endswith("LATEST") else F.bool_and(way)).alias(mode))
    totals = every.groupBy("stream", F.col("candidate").alias("version")).agg(*verdicts)
    modes = F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), F.col(m).alias("ok")) for m in MODES])).alias("m")
    return totals.select("stream", "version", modes).select("stream", "version", "m.mode", "m.ok")


def pii_evolution_check(new_fields: DataFrame, current_fields: DataFrame) -> DataFrame:
    """Fields that exist without a PII tag today and would gain one: ``(stream, path)``.

    Current fields are those of the latest active version.
    """
    plain = current_fields.where((F.col("kind") == "field") & ~F.col("pii")).select("stream", "path")
    tagged = new_fields.where("pii").select("stream", "version", "path")
    return tagged.join(by_shuffle(plain), ["stream", "path"]).select("stream", "version", "path").distinct()


def key_path_check(paths: DataFrame, latest_fields: DataFrame) -> DataFrame:
    """Faults of key paths against the latest schema: ``(keys, path, location, fault)``.

    ``paths(stream, partition_path, ...)``. Every node along the path - each branch of a union included -
    must be a record holding the next step; arrays and maps cannot be stepped into. The root path and blank
    paths are always right.
    """
    given = paths.where(F.trim("partition_path") != "").withColumn("_steps", key_steps(F.col("partition_path")))
    keys = paths.columns
    bad_syntax = given.where(F.col("_steps").isNull()).select(
        *keys, F.lit("").alias("location"), F.lit("syntax").alias("fault")
    )
    stepped = given.where(F.size("_steps") > 0).select(
        *keys,
        F.explode(
            F.transform(
                "_steps",
                lambda s, i: F.struct(
                    F.concat_ws("", F.transform(F.slice("_steps", 1, i), lambda p: F.concat(F.lit("/"), p))).alias("at"),
                    s.alias("next"),
                ),
            )
        ).alias("_step"),
    )
    nodes = latest_fields.select("stream", F.col("plain_path").alias("_at"), F.col("path").alias("location"), "type")
    children = latest_fields.where("kind = 'field'").select(
        "stream", F.col("parent_path").alias("location"), F.col("name").alias("_next"), F.lit(True).alias("_has")
    )
    fault = F.when(~F.col("type").isin("record", "union"), F.concat(F.lit("not traversable: "), "type")).when(
        (F.col("type") == "record") & F.col("_has").isNull(), F.concat(F.lit("no field: "), "_next")
    )
    walked = (
        stepped.withColumn("_at", F.col("_step.at"))
        .withColumn("_next", F.col("_step.next"))
        .join(by_shuffle(nodes), ["stream", "_at"])
        .join(by_shuffle(children), ["stream", "location", "_next"], "left")
        .withColumn("fault", fault)
        .where("fault is not null")
    )
    return walked.select(*keys, "location", "fault").unionByName(bad_syntax)
