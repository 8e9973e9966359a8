"""Administration of streams as batch jobs: checks over the catalog, and requests turned into patches.

``streams`` is the catalog as a table, one row per stream. Jobs that change it give patch rows
``(document_id, operations)`` for :func:`millrace.operators.model.fold_patches` and rejects with a reason.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.durations import duration_seconds
from millrace.functions.net import BLOCK
from millrace.operators.model import OPERATIONS
from millrace.operators.registry import (
    active_schemas,
    compat_report,
    deletable_version,
    key_path_check,
    pii_evolution_check,
    schema_rules,
)
from millrace.session import by_shuffle, settle

# Fixed values.
STREAM_NAME = "^[a-z][a-z0-9_]*$"
DEFAULT_INTERVAL = "PT1H"
MIN_INTERVAL_S, MAX_INTERVAL_S = 300, 86400
DEFAULT_MODE = "CAN_READ_ALL"


def op(kind: str, path: Column | str, value: Column | None = None) -> Column:
    """One patch operation; the value is JSON text."""
    at = F.lit(path) if isinstance(path, str) else path
    json_value = F.lit(None).cast("string") if value is None else value
    return F.struct(F.lit(kind).alias("op"), at.alias("path"), json_value.alias("value"))


def _patch(*operations: Column) -> Column:
    return F.array(*operations).cast(OPERATIONS)


# -- checks over the catalog --------------------------------------------------------------------------


def live_streams(streams: DataFrame) -> DataFrame:
    """Names of streams that are not deleted, in order."""
    return streams.where(~F.col("deleted")).select("stream").distinct().orderBy("stream")


def deletable() -> Column:
    """No destinations, disabled, and known to be empty since it was disabled."""
    empty = (F.col("message_count") == 0) & (F.col("enabled_ms") < F.col("counted_ms"))
    return F.coalesce(~F.col("has_destinations") & ~F.col("enabled") & empty, F.lit(False))


def deletable_streams(streams: DataFrame) -> DataFrame:
    return streams.where(~F.col("deleted") & deletable())


def interval_ok(interval: Column) -> Column:
    """A landing interval is absent, or a duration between five minutes and a day."""
    seconds = duration_seconds(interval)
    return interval.isNull() | F.coalesce(seconds.between(MIN_INTERVAL_S, MAX_INTERVAL_S), F.lit(False))


def validate_streams(streams: DataFrame) -> DataFrame:
    """``(stream, rule, ok)`` for name, landing interval, read grants and CIDR blocks."""
    no_grants = F.exists(F.map_values("read_authorities"), lambda g: F.coalesce(F.size(g), F.lit(0)) <= 0)
    rules = {
        "name": F.col("stream").rlike(STREAM_NAME),
        "landing_interval": interval_ok(F.col("landing_interval")),
        "read_grants": ~F.coalesce(no_grants, F.lit(False)),
        "cidr_blocks": F.coalesce(F.forall("cidr_blocks", lambda c: c.rlike(BLOCK)), F.lit(True)),
    }
    rows = F.array(*[F.struct(F.lit(r).alias("rule"), ok.alias("ok")) for r, ok in rules.items()])
    return streams.select("stream", F.explode(rows).alias("r")).select("stream", "r.rule", "r.ok")


def due_landings(streams: DataFrame, now: Column, jitter: bool = False) -> DataFrame:
    """Destinations whose next landing time has passed: ``(stream, last_run, due_at)``.

    A destination that never ran, or whose last run cannot be read, counts from the epoch. With ``jitter``
    a first run is put off by a part of the interval that depends on the name.
    """
    seconds = duration_seconds(F.coalesce("landing_interval", F.lit(DEFAULT_INTERVAL)))
    ran = F.try_to_timestamp(F.col("last_run"))
    last = F.coalesce(ran, F.timestamp_seconds(F.lit(0)))
    put_off = F.when(ran.isNull(), F.pmod(F.xxhash64("stream"), seconds.cast("bigint"))) if jitter else F.lit(0)
    due = F.timestamp_micros(
        F.unix_micros(last) + ((seconds + F.coalesce(put_off, F.lit(0))) * 1_000_000).cast("bigint")
    )
    return (
        streams.where(F.col("hive_enabled") & seconds.isNotNull())
        .select("stream", last.alias("last_run"), due.alias("due_at"))
        .where(F.col("due_at") < now)
    )


def landable_streams(streams: DataFrame, schemas: DataFrame) -> DataFrame:
    """Streams with a landing destination and at least one active schema."""
    return streams.where("has_hive and not deleted").join(by_shuffle(active_schemas(schemas)), "stream", "left_semi")


def status_drift(streams: DataFrame, topics: DataFrame) -> DataFrame:
    """Patches that bring the model in line with the observed topics, only where they differ.

    ``streams(stream, deleted, topic_name, type, status)``, ``topics(topic, type, status)`` with the status
    as JSON text. Deleted streams whose topic is gone are removed altogether.
    """
    named = streams.withColumn("_topic", F.coalesce("topic_name", F.concat(F.lit("road."), "stream")))
    seen = topics.select(F.col("topic").alias("_topic"), F.col("type").alias("_type"), F.col("status").alias("_status"))
    both = named.join(by_shuffle(seen), "_topic", "left")
    present = F.col("_status").isNotNull()
    operations = F.array_compact(
        F.array(
            F.when(F.col("topic_name").isNull(), op("add", "/topicName", _text("_topic"))),
            F.when(present & ~F.col("type").eqNullSafe(F.col("_type")), op("add", "/type", _text("_type"))),
            F.when(present & ~F.col("status").eqNullSafe(F.col("_status")), op("add", "/status", F.col("_status"))),
        )
    )
    drift = F.when(F.col("deleted") & ~present, _patch(op("remove", ""))).otherwise(operations.cast(OPERATIONS))
    return (
        both.where(~F.col("deleted") | ~present)
        .select(F.col("stream").alias("document_id"), drift.alias("operations"))
        .where(F.size("operations") > 0)
    )


def _text(column: str) -> Column:
    """A text column as JSON."""
    return F.to_json(F.col(column).cast("variant"))


# -- requests -----------------------------------------------------------------------------------------


PatchRule = Callable[[Column], Column]


def _fault(test: Column, text: str) -> Column:
    return F.when(F.coalesce(test, F.lit(False)), F.lit(text))


def _value(o: Column) -> Column:
    return F.try_parse_json(o["value"])


def _kind(o: Column) -> Column:
    return F.coalesce(F.schema_of_variant(_value(o)), F.lit("VOID"))


def _text_rule(o: Column) -> Column:
    text = F.try_variant_get(_value(o), "$", "string")
    return F.coalesce(_fault(_kind(o) != "STRING", "not a string"), _fault(F.trim(text) == "", "blank"))


def _key_path_rule(o: Column) -> Column:
    return F.coalesce(_text_rule(o), _fault(F.col("_misfit"), "does not fit the schema"))


def _enabled_rule(o: Column) -> Column:
    turns_on = F.try_variant_get(_value(o), "$", "boolean")
    ready = F.coalesce("_ready", F.lit(False))
    return F.coalesce(_fault(_kind(o) != "BOOLEAN", "not a boolean"), _fault(turns_on & ~ready, "not ready to be enabled"))


def _list_rule(o: Column) -> Column:
    items = F.try_variant_get(_value(o), "$", "array<variant>")
    first = F.schema_of_variant(F.get(items, F.lit(0)))
    return F.coalesce(_fault(~_kind(o).startswith("ARRAY"), "not an array"), _fault(first != "STRING", "not strings"))


def _cidr_rule(o: Column) -> Column:
    blocks = F.from_json(o["value"], "array<string>")
    return F.coalesce(_list_rule(o), _fault(~F.forall(blocks, lambda c: c.rlike(BLOCK)), "not CIDR blocks"))


def _grants_rule(o: Column) -> Column:
    # from_json keeps members in document order; the first one is checked.
    first = F.get(F.map_values(F.from_json(o["value"], "map<string,string>")), F.lit(0))
    grants = F.try_parse_json(first)
    grant = F.get(F.try_variant_get(grants, "$", "array<variant>"), F.lit(0))
    is_list = F.coalesce(F.schema_of_variant(grants).startswith("ARRAY"), F.lit(False))
    is_text = F.coalesce(F.schema_of_variant(grant) == "STRING", F.lit(False))
    return F.coalesce(
        _fault(~_kind(o).startswith("OBJECT"), "not a map"),
        _fault(first.isNotNull() & ~is_list, "grants are not an array"),
        _fault(first.isNotNull() & ~is_text, "grants are empty or not strings"),
    )


def _metadata_rule(o: Column) -> Column:
    return _fault(~_kind(o).startswith("OBJECT"), "not an object")


# What may be patched, and the rule for its value: the fault of an operation, or NULL.
PATCH_RULES: dict[str, PatchRule] = {
    "/contactEmail": _text_rule,
    "/description": _text_rule,
    "/teamName": _text_rule,
    "/enabled": _enabled_rule,
    "/partitionPath": _key_path_rule,
    "/metadata": _metadata_rule,
    "/authorisation/onramp/cidrBlocks": _cidr_rule,
    "/authorisation/onramp/authorities": _list_rule,
    "/authorisation/offramp/authorities": _grants_rule,
}


def validate_patches(
    requests: DataFrame,
    streams: DataFrame,
    latest_fields: DataFrame,
    now_ms: Column,
    rules: dict[str, PatchRule] | None = None,
) -> DataFrame:
    """Judge requested patches and rewrite them: ``(request_id, stream, reason, operations)``.

    ``requests(request_id, stream, operations)``. Only paths with a rule may change; the first bad operation
    refuses the whole set. Accepted adds become replaces, and changing ``/enabled`` also stamps its time. A
    key path must fit the latest schema. ``rules`` adds paths or replaces their rules.
    """
    known = streams.where(~F.col("deleted")).select("stream", F.col("topic_created").alias("_ready"), F.lit(True).alias("_known"))
    proposed = requests.select("request_id", "stream", F.explode("operations").alias("o")).where(
        "o.path = '/partitionPath' and lower(o.op) <> 'remove'"
    )
    paths = proposed.select("request_id", "stream", F.try_variant_get(F.try_parse_json("o.value"), "$", "string").alias("partition_path"))
    misfits = key_path_check(paths, latest_fields).select("request_id").distinct().withColumn("_misfit", F.lit(True))
    judged = requests.join(by_shuffle(known), "stream", "left").join(by_shuffle(misfits), "request_id", "left")

    every = {**PATCH_RULES, **(rules or {})}

    def fault(o: Column) -> Column:
        found = F.when(~o["path"].isin(*every), F.lit("not a path to patch")).when(
            ~F.lower(o["op"]).isin("add", "replace"), F.lit("may not be removed")
        )
        for path, rule in every.items():
            found = found.when(o["path"] == path, rule(o))
        return F.when(found.isNotNull(), F.concat(found, F.lit(": "), o["path"]))

    faults = F.filter(F.transform("operations", fault), lambda f: f.isNotNull())
    reason = F.when(F.col("_known").isNull(), F.lit("unknown stream")).otherwise(F.get(faults, F.lit(0)))
    stamp = op("add", "/enabledTimeStamp", now_ms.cast("string"))

    def rewrite(o: Column) -> Column:
        replaced = F.struct(F.lit("replace").alias("op"), o["path"].alias("path"), o["value"].alias("value"))
        return F.when(o["path"] == "/enabled", F.array(replaced, stamp)).otherwise(F.array(replaced))

    rewritten = F.flatten(F.transform("operations", rewrite)).cast(OPERATIONS)
    return judged.select("request_id", "stream", reason.alias("reason"), F.when(reason.isNull(), rewritten).alias("operations"))


def create_streams(requests: DataFrame, streams: DataFrame, now_ms: Column, auto_landing: bool = True) -> DataFrame:
    """Requests for new streams: ``(stream, reason, operations)``.

    ``requests(stream, description, team_name, contact_email, enabled, partition_path)``. A name is free when
    no live stream has it. Missing settings take their defaults, and a landing destination may be added.
    """
    live = streams.where(~F.col("deleted")).select("stream", F.lit(True).alias("_taken"))
    judged = requests.join(by_shuffle(live), "stream", "left")
    reason = F.when(F.col("_taken"), "already exists").when(~F.col("stream").rlike(STREAM_NAME), "invalid name")
    landing = F.struct(F.struct(F.lit(True).alias("enabled"), F.lit(DEFAULT_INTERVAL).alias("landingInterval")).alias("hive"))
    parts = [
        F.col("stream").alias("name"),
        F.lit("NORMAL").alias("type"),
        F.col("description"),
        F.col("team_name").alias("teamName"),
        F.col("contact_email").alias("contactEmail"),
        F.coalesce("enabled", F.lit(False)).alias("enabled"),
        now_ms.cast("bigint").alias("enabledTimeStamp"),
        F.col("partition_path").alias("partitionPath"),
        F.lit(DEFAULT_MODE).alias("compatibilityMode"),
        F.lit(False).alias("deleted"),
    ]
    if auto_landing:
        parts.append(landing.alias("destinations"))
    document = F.to_json(F.struct(*parts))
    return judged.select(
        "stream", reason.alias("reason"), F.when(reason.isNull(), _patch(op("add", "", document))).alias("operations")
    )


def register_schemas(requests: DataFrame, streams: DataFrame, schemas: DataFrame, fields_of) -> DataFrame:
    """Requests to add a schema: ``(stream, version, reason, operations)``.

    ``requests(stream, requested, schema_json)``, at most one per stream, with ``requested`` an explicit
    number or NULL. ``streams(stream, deleted, compatibility_mode, partition_path)``. Checked in turn: the
    stream, the schema rules, the key path, the stream's compatibility mode, personal data added to existing
    fields, and the number. ``fields_of`` is :func:`~millrace.operators.registry.schema_fields`.
    """
    live = streams.where(~F.col("deleted")).select(
        "stream", F.coalesce("compatibility_mode", F.lit(DEFAULT_MODE)).alias("mode"), "partition_path"
    )
    active = F.when(~F.col("deleted") & F.col("version").isNotNull(), F.struct("version", "schema_json"))
    used = schemas.groupBy("stream").agg(F.max("version").alias("_max"), F.max(active).alias("_latest"))
    candidates = (
        requests.select("stream", "requested", "schema_json")
        .join(by_shuffle(used), "stream", "left")
        .join(by_shuffle(live), "stream", "left")
        .withColumn("next_version", (F.coalesce("_max", F.lit(0)) + 1).cast("int"))
        .withColumn("version", F.coalesce("requested", "next_version"))
        # The candidate takes the place after every existing version, so that explicit low numbers still compare.
        .withColumn("place", F.greatest("version", "next_version").cast("int"))
    )
    candidates = settle(candidates, "schema-requests")
    placed = candidates.select("stream", F.col("place").alias("version"), "schema_json")
    new_fields = settle(fields_of(placed), "new-fields")
    current_fields = fields_of(candidates.where("_latest is not null").select("stream", "_latest.version", "_latest.schema_json"))
    keyed = candidates.where(F.trim("partition_path") != "").select("stream", "partition_path")
    older = schemas.join(by_shuffle(candidates.select("stream")), "stream", "left_semi")

    # What speaks against a request, the weightiest first; of the modes that are broken, the stream's own one counts.
    def against(rows: DataFrame, rank: int, text: Column) -> DataFrame:
        return rows.select("stream", F.lit(rank).alias("rank"), text.alias("text"))

    found = (
        against(key_path_check(keyed, new_fields), 1, F.concat(F.lit("key path: "), "fault"))
        .union(against(schema_rules(new_fields), 2, F.concat(F.lit("schema: "), "rule")))
        .union(against(compat_report(placed, older).where(~F.col("ok")), 3, F.col("mode")))
        .union(against(pii_evolution_check(new_fields, current_fields), 4, F.concat(F.lit("personal data: "), "path")))
    )

    def least(rank: int) -> Column:
        return F.min(F.when(F.col("rank") == rank, F.col("text")))

    broken = found.groupBy("stream").agg(
        least(1).alias("_misfit"), least(2).alias("_rule"), F.collect_set(F.when(F.col("rank") == 3, F.col("text"))).alias("_modes"), least(4).alias("_exposed")
    )
    judged = candidates.join(by_shuffle(broken), "stream", "left")
    reason = (
        F.when(F.col("mode").isNull(), "unknown stream")
        .when(F.col("_misfit").isNotNull(), F.col("_misfit"))
        .when(F.col("_rule").isNotNull(), F.col("_rule"))
        .when(F.array_contains("_modes", F.col("mode")), F.concat(F.lit("compatibility: "), "mode"))
        .when(F.col("_exposed").isNotNull(), F.col("_exposed"))
        .when(F.col("version") < F.col("next_version"), "version too low")
    )
    value = F.concat(
        F.lit('{"schema":'), F.col("schema_json"), F.lit(',"version":'), F.col("version").cast("string"), F.lit(',"deleted":false}')
    )
    path = F.concat(F.lit("/schemas/"), F.col("version").cast("string"))
    return judged.select(
        "stream",
        F.col("version").cast("int").alias("version"),
        reason.alias("reason"),
        F.when(reason.isNull(), _patch(op("add", path, value))).alias("operations"),
    )


def delete_schema_versions(requests: DataFrame, schemas: DataFrame) -> DataFrame:
    """Requests to delete schema versions: ``(stream, version, reason, operations)``."""
    judged = deletable_version(schemas, requests)
    path = F.concat(F.lit("/schemas/"), F.col("number").cast("string"), F.lit("/deleted"))
    return judged.select(
        "stream", "version", "reason", F.when(F.col("reason").isNull(), _patch(op("replace", path, F.lit("true")))).alias("operations")
    )


def destination_changes(requests: DataFrame, streams: DataFrame) -> DataFrame:
    """Requests on landing destinations: ``(request_id, stream, reason, operations)``.

    ``requests(request_id, stream, action, enabled, landing_interval)`` with action create / update / delete;
    ``streams(stream, deleted, has_destinations_map, has_hive)``.
    """
    live = streams.where(~F.col("deleted")).select(
        "stream", F.col("has_destinations_map").alias("_map"), F.col("has_hive").alias("_hive"), F.lit(True).alias("_known")
    )
    judged = requests.join(by_shuffle(live), "stream", "left")
    create, delete = F.col("action") == "create", F.col("action") == "delete"
    reason = (
        F.when(F.col("_known").isNull(), "unknown stream")
        .when(create & F.col("_hive"), "already exists")
        .when(~create & ~F.col("_hive"), "unknown destination")
        .when(~delete & ~interval_ok(F.col("landing_interval")), "invalid landing interval")
    )
    value = F.to_json(
        F.struct(
            F.coalesce("enabled", F.lit(False)).alias("enabled"),
            F.coalesce("landing_interval", F.lit(DEFAULT_INTERVAL)).alias("landingInterval"),
        )
    )
    add = op("add", "/destinations/hive", value)
    operations = (
        F.when(delete, _patch(op("remove", "/destinations/hive")))
        .when(create & F.col("_map"), _patch(add))
        .when(create, _patch(op("add", "/destinations", F.lit("{}")), add))
        .otherwise(_patch(op("replace", "/destinations/hive", value)))
    )
    return judged.select("request_id", "stream", reason.alias("reason"), F.when(reason.isNull(), operations).alias("operations"))


def delete_streams(requests: DataFrame, streams: DataFrame) -> DataFrame:
    """Requests to delete streams: ``(stream, reason, operations)``; the row goes once its topic is gone."""
    known = streams.where(~F.col("deleted")).withColumn("_ok", deletable()).select("stream", "_ok")
    judged = requests.select("stream").join(by_shuffle(known), "stream", "left")
    reason = F.when(F.col("_ok").isNull(), "unknown stream").when(~F.col("_ok"), "still in use")
    return judged.select(
        "stream", reason.alias("reason"), F.when(reason.isNull(), _patch(op("add", "/deleted", F.lit("true")))).alias("operations")
    )
