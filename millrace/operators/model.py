"""Documents folded from patches, and change events of keyed logs."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.jsonpatch import MISSING, PatchError, apply_set
from millrace.operators.ordered import SLICE_ROWS, previous_value, running_total
from millrace.session import settle
from millrace.sources.log import latest_by_key

OPERATIONS = "array<struct<op:string,path:string,value:string>>"


def compact_json(document) -> str:
    return json.dumps(document, separators=(",", ":"), ensure_ascii=False, sort_keys=True)


def single_operation(op: str, path: Column, value: Column) -> Column:
    """A set of one operation."""
    return F.array(F.struct(F.lit(op).alias("op"), path.alias("path"), value.alias("value"))).cast(OPERATIONS)


def valid_set(operations: str | Column = "operations") -> Column:
    """Whether a set may be tried at all: it holds operations, each of them known, on a pointer, with a value that can
    be read as JSON (a missing one is null). Any other set changes nothing, whatever the document."""
    sets = F.col(operations) if isinstance(operations, str) else operations

    def readable(o: Column) -> Column:
        pointer = (o["path"] == "") | o["path"].startswith("/")
        value = o["value"].isNull() | (F.lower(o["op"]) == "remove") | F.try_parse_json(o["value"]).isNotNull()
        return F.coalesce(F.lower(o["op"]).isin("add", "replace", "remove") & pointer & value, F.lit(False))

    return F.coalesce((F.size(sets) > 0) & F.forall(sets, readable), F.lit(False))


def _writes_root() -> Column:
    """A valid set of one operation on the root: it always applies, and nothing before it matters."""
    return (F.size("operations") == 1) & (F.get("operations", F.lit(0))["path"] == "")


def _member() -> Column:
    """The one top-level member (still escaped) that every operation of a set is under, else NULL."""
    members = F.array_distinct(F.transform("operations", lambda o: F.get(F.split(o["path"], "/"), F.lit(1))))
    return F.when(F.size(members) == 1, F.get(members, F.lit(0)))


def _walk(
    batches: Iterator[pd.DataFrame], key: list[str], columns: list[str], start, failed=None, ended=None
) -> Iterator[pd.DataFrame]:
    """Apply sets in rows sorted by ``(key, seq)``, batch by batch, holding one document at a time.

    ``start(key)`` is the document a key begins with; ``failed(key, seq, error)`` and
    ``ended(key, document)`` give output rows.
    """
    current, document, rows = None, None, []
    for batch in batches:
        for *this, seq, operations in zip(*(batch[k] for k in key), batch["seq"], batch["operations"]):
            if this != current:
                if current is not None and ended:
                    rows.extend(ended(current, document))
                current, document = this, start(this)
            try:
                document = apply_set(document, [(o["op"], o["path"], o["value"]) for o in operations])
            except (PatchError, ValueError) as error:
                if failed:
                    rows.append(failed(this, seq, str(error)))
        if rows:
            yield pd.DataFrame(rows, columns=columns)
            rows = []
    if current is not None and ended:
        rows.extend(ended(current, document))
        if rows:
            yield pd.DataFrame(rows, columns=columns)


def _fold_units(units: DataFrame) -> DataFrame:
    """Fold ``(document_id, unit, seq, operations)``; the unit is '' for a whole document, which starts
    absent, or ``/member``, which is folded inside an object of its own."""

    def ended(key, document):
        if document is MISSING or (key[1] and not document):
            return []
        value = next(iter(document.values())) if key[1] else document
        return [(*key, compact_json(value))]

    def fold(batches):
        return _walk(
            batches, ["document_id", "unit"], ["document_id", "unit", "value"],
            start=lambda key: {} if key[1] else MISSING, ended=ended,
        )

    id_type = units.schema["document_id"].dataType.simpleString()
    return (
        units.repartition("document_id", "unit")
        .sortWithinPartitions("document_id", "unit", "seq")
        .mapInPandas(fold, f"document_id {id_type}, unit string, value string")
    )


def fold_patches(patches: DataFrame) -> DataFrame:
    """Current ``(document_id, document)`` after applying every patch set in ``seq`` order.

    ``patches(document_id, seq, operations)``; a document starts absent, a set that fails changes nothing,
    removing the root deletes the document. Documents are compact JSON with sorted members.

    A set that can't be tried (``valid_set``) is left out from the start; streams judge sets alike.

    What a later write makes irrelevant is dropped first, by aggregates that combine before the shuffle:
    everything before the last write of the root and, in documents whose later sets each stay under one
    top-level member, everything before the last write of that member. Members then fold apart, so the
    history of a busy document spreads out. The rest is sorted and walked batch by batch; no group is ever
    held in memory. The history is read twice; what survives is written out before the rest.
    """
    first = F.get("operations", F.lit(0))
    sets = patches.select("document_id", "seq", "operations").where(valid_set()).withColumns(
        {"_root": _writes_root(), "_member": _member(), "_single": F.size("operations") == 1}
    )
    root_seq = F.when(F.col("_root"), F.col("seq"))
    written = F.when(F.lower(first["op"]) != "remove", F.coalesce(first["value"], F.lit("null")))
    roots = settle(
        sets.groupBy("document_id")
        .agg(F.max(root_seq).alias("_from"), F.max_by(F.struct(written.alias("v")), root_seq).alias("_last"))
        .select("document_id", "_from", F.col("_last.v").alias("_base")),
        "documents",
    )
    later = settle(
        sets.where(~F.col("_root"))
        .join(roots, "document_id")
        .where(F.col("_from").isNull() | (F.col("seq") > F.col("_from")))
        .select("document_id", "seq", "operations", "_member", "_single"),
        "patch-tail",
    )
    # Members fold apart if every set after the last write of the root stays under one; they exist only in an
    # object, so any other document is folded whole.
    split = later.groupBy("document_id").agg(F.bool_and(F.col("_member").isNotNull()).alias("_split"))
    objects_only = F.col("_base").isNull() | F.ltrim("_base").startswith("{")
    documents = roots.join(split, "document_id", "left").select(
        "document_id", "_from", "_base", (F.coalesce("_split", F.lit(True)) & objects_only).alias("_apart")
    )
    tail = later.join(documents.select("document_id", "_apart", F.col("_base").isNotNull().alias("_based")), "document_id").where(
        ~F.col("_apart") | F.col("_based")
    )
    # A document whose sets stay apart and whose root was never written, or was removed, stays absent.
    objects = documents.where(F.col("_apart") & F.col("_base").isNotNull())
    kept = _decisive_moves(tail.where("_apart"), objects)
    bases = documents.where(~F.col("_apart") & F.col("_base").isNotNull())
    whole = (
        tail.where(~F.col("_apart"))
        .select("document_id", "seq", "operations")
        .unionByName(
            bases.select(
                "document_id", F.col("_from").alias("seq"), single_operation("add", F.lit(""), F.col("_base")).alias("operations")
            )
        )
    )
    folded = settle(_fold_units(whole.withColumn("unit", F.lit("")).unionByName(kept)), "folded")

    name = F.replace(F.replace(F.substring("unit", 2, 1 << 30), F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~"))
    members = (
        folded.where("unit <> ''")
        .groupBy("document_id")
        .agg(F.sort_array(F.collect_list(F.struct(name.alias("k"), F.col("value").alias("v")))).alias("_members"))
    )
    text = F.transform("_members", lambda m: F.concat(_quoted(m["k"]), F.lit(":"), m["v"]))
    built = objects.select("document_id").join(members, "document_id", "left").select(
        "document_id",
        F.concat(F.lit("{"), F.coalesce(F.array_join(text, ","), F.lit("")), F.lit("}")).alias("document"),
    )
    return folded.where("unit = ''").select("document_id", F.col("value").alias("document")).unionByName(built)


def _quoted(text: Column) -> Column:
    """Text as a JSON string, escapes included."""
    boxed = F.to_json(F.array(text))
    return F.substring(boxed, F.lit(2), F.length(boxed) - 2)


def _decisive_moves(tail: DataFrame, objects: DataFrame) -> DataFrame:
    """Per member of a document, the sets from its last decisive write on."""
    path = F.concat(F.lit("/"), F.col("_member"))
    in_base = F.explode(F.variant_get(F.parse_json("_base"), "$", "map<string,variant>")).alias("_key", "_node")
    escaped = F.replace(F.replace(F.col("_key"), F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))
    given = objects.select("document_id", F.col("_from").alias("seq"), in_base).select(
        "document_id",
        "seq",
        escaped.alias("_member"),
        single_operation("add", F.concat(F.lit("/"), escaped), F.to_json("_node")).alias("operations"),
        F.lit(True).alias("_single"),
    )
    first = F.get("operations", F.lit(0))
    moves = (
        tail.select("document_id", "seq", "_member", "operations", "_single")
        .unionByName(given)
        .withColumn("_op", F.when(F.col("_single") & (first["path"] == path), F.lower(first["op"])))
    )
    # An add or remove of the member settles whether it exists, whatever came before. With single
    # operations only, nothing but those settles it, so the last write decides the value too.
    reset = F.when(F.col("_op").isin("add", "remove"), F.col("seq"))
    write = F.when(F.col("_op").isin("add", "replace"), F.col("seq"))
    decided = (
        moves.groupBy("document_id", "_member")
        .agg(
            F.max(reset).alias("_reset"),
            F.max_by("_op", reset).alias("_reset_op"),
            F.max(write).alias("_write"),
            F.bool_or(~F.col("_single")).alias("_compound"),
        )
        .select(
            "document_id",
            "_member",
            F.when(F.col("_compound"), F.coalesce("_reset", F.lit(-(1 << 62))))
            .when(F.col("_reset_op") == "add", F.col("_write"))
            .alias("_start"),
        )
        .where("_start is not null")
    )
    opens = (F.col("seq") == F.col("_start")) & (F.col("_op") == "replace")
    return (
        moves.join(decided, ["document_id", "_member"])
        .where("seq >= _start")
        .select(
            "document_id",
            path.alias("unit"),
            "seq",
            F.when(opens, single_operation("add", path, first["value"])).otherwise(F.col("operations")).alias("operations"),
        )
    )


#: The reason of a set that isn't tried.
UNREADABLE = "no operations, or an unknown operation, pointer or value"


def patch_failures(patches: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """``(document_id, seq, reason)`` of every set that could not be applied.

    Sets that can't be tried are told from the rest where they lie. Every write of the root starts a history of its
    own; these are numbered first and walked apart.
    """
    judged = patches.select("document_id", "seq", "operations").withColumn("_valid", valid_set())
    sets = running_total(
        judged.where("_valid").drop("_valid"), ["document_id"], "seq",
        F.when(_writes_root(), 1).otherwise(0), "life", slice_rows,
    )
    id_type = patches.schema["document_id"].dataType.simpleString()
    seq_type = patches.schema["seq"].dataType.simpleString()

    def failures(batches):
        return _walk(
            batches, ["document_id", "life"], ["document_id", "seq", "reason"],
            start=lambda key: MISSING, failed=lambda key, seq, error: (key[0], seq, error),
        )

    walked = (
        sets.repartition("document_id", "life")
        .sortWithinPartitions("document_id", "life", "seq")
        .mapInPandas(failures, f"document_id {id_type}, seq {seq_type}, reason string")
    )
    return walked.unionByName(judged.where("not _valid").select("document_id", "seq", F.lit(UNREADABLE).alias("reason")))


def change_capture(log: DataFrame, key: str, value: str, order: str = "offset", slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Change events of a keyed log: ``(key, order, change, old, new)``.

    ``new`` when the key was absent, ``update`` when it held a value, ``remove`` for a null. Rows without a
    key are ignored. ``same`` marks updates that change nothing, for readers that skip them.
    """
    keyed = log.where(F.col(key).isNotNull()).select(key, order, value)
    seen = previous_value(keyed, [key], order, F.struct(F.col(value).alias("v")), "_before", slice_rows)
    old = F.col("_before.v")
    change = F.when(F.col(value).isNull(), "remove").when(old.isNull(), "new").otherwise("update")
    return seen.select(
        key, order, change.alias("change"), old.alias("old"), F.col(value).alias("new"),
        F.coalesce(old == F.col(value), F.lit(False)).alias("same"),
    )


def compact_log(log: DataFrame, key: str, value: str, ts: str, keep_after: Column, order: str = "offset") -> DataFrame:
    """A compacted stream: of the records up to ``keep_after`` only the last one per key, unless it is a
    deletion; every later record."""
    old = log.where(F.col(ts) <= keep_after)
    names = [c for c in log.columns if c != key]
    last = (
        old.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.max_by(F.struct(*names), F.col(order)).alias("_r"))
        .where(F.col(f"_r.{value}").isNotNull())
        .select(key, "_r.*")
    )
    return last.unionByName(log.where(F.col(ts) > keep_after))


def roll_snapshot(previous: DataFrame, log: DataFrame, key: str, value: str, order: str = "offset") -> DataFrame:
    """The next snapshot of a compacted stream: the previous one overlaid with newer records."""
    base = previous.select(key, F.col(value), F.lit(-1).cast(log.schema[order].dataType).alias(order))
    return latest_by_key(base.unionByName(log.select(key, value, order)), key, value, order)


def model_snapshot(documents: DataFrame, prefix: str, date: str, stamp: str) -> str:
    """Dump every current document as gzipped JSON lines; returns the folder written."""
    target = f"{prefix.rstrip('/')}/{date}/{stamp}"
    documents.write.mode("overwrite").option("compression", "gzip").json(target)
    return target


def patch_rows(patches: DataFrame) -> DataFrame:
    """Patch sets ``(document_id, seq, operations)`` as rows of the patch log, one JSON text per set."""
    return patches.select("document_id", "seq", F.to_json("operations").alias("patch"))


def emit_patches(patches: DataFrame, path: str) -> None:
    """Append patch sets to the patch log."""
    patch_rows(patches).write.mode("append").parquet(path)


def read_patches(log: DataFrame) -> DataFrame:
    """Patch sets of a patch log."""
    return log.select("document_id", "seq", F.from_json("patch", OPERATIONS).alias("operations"))
