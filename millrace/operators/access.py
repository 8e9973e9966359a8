"""Who may write to, administer and read a stream. Three separate rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.net import address_number, block_range

AUTHORISED, UNAUTHORISED, ERROR = "AUTHORISED", "UNAUTHORISED", "ERROR"
ANYONE = "*"
PUBLIC = "PUBLIC"


def cidr_access(requests: DataFrame, blocks: DataFrame, address: str = "address", key: str = "stream") -> DataFrame:
    """Add ``cidr_ok``: whether the address lies in any block of the stream; no blocks means no.

    A block is its network and the length of its prefix. Each distinct address of a stream is cut to the lengths that
    the stream's blocks use, 33 at most, and looked up by an equi-join, so the work follows the number of addresses,
    whatever the number of blocks.
    """
    size = F.col("_r.hi") - F.col("_r.lo") + 1
    networks = (
        blocks.select(F.col(key).alias("_key"), block_range(F.col("cidr")).alias("_r"))
        .where(F.col("_r").isNotNull())
        .select("_key", size.alias("_size"), (F.col("_r.lo") / size).cast("bigint").alias("_network"))
        .distinct()
    )
    sizes = networks.groupBy("_key").agg(F.collect_set("_size").alias("_sizes"))
    placed = requests.withColumn("_ip", address_number(F.col(address)))
    asked = placed.where(F.col("_ip").isNotNull()).select(F.col(key).alias("_key"), "_ip").distinct()
    cut = asked.join(sizes, "_key").select("_key", "_ip", F.explode("_sizes").alias("_size"))
    cut = cut.withColumn("_network", F.expr("_ip div _size"))
    inside = cut.join(networks, ["_key", "_size", "_network"], "left_semi").select("_key", F.col("_ip").alias("_inside")).distinct()
    found = placed.join(inside, (F.col(key) == F.col("_key")) & (F.col("_ip") == F.col("_inside")), "left")
    return found.withColumn("cidr_ok", F.col("_inside").isNotNull()).drop("_ip", "_key", "_inside")


def holds_authority(held: Column, allowed: Column) -> Column:
    """Any shared authority, or everyone is allowed. Null lists hold nothing."""
    empty = F.array().cast("array<string>")
    held, allowed = F.coalesce(held, empty), F.coalesce(allowed, empty)
    return F.array_contains(allowed, ANYONE) | F.arrays_overlap(held, allowed)


def write_access(requests: DataFrame, streams: DataFrame, blocks: DataFrame) -> DataFrame:
    """Producers: an authenticated user by authority, an anonymous one by network address.

    ``requests(stream, authenticated, authorities, address)``, ``streams(stream, authorities)``.
    Adds ``authentication`` and ``outcome``; an unknown stream is an ERROR.
    """
    allowed = streams.select("stream", F.col("authorities").alias("_allowed"), F.lit(True).alias("_known"))
    judged = cidr_access(requests.join(allowed, "stream", "left"), blocks)
    passed = F.when(F.col("authenticated"), holds_authority(F.col("authorities"), F.col("_allowed"))).otherwise(
        F.col("cidr_ok")
    )
    return (
        judged.withColumn("authentication", _authentication())
        .withColumn(
            "outcome",
            F.when(F.col("_known").isNull(), ERROR).when(passed, AUTHORISED).otherwise(UNAUTHORISED),
        )
        .drop("_allowed", "_known", "cidr_ok")
    )


def admin_access(requests: DataFrame, admins: list[str], blocks: list[str]) -> DataFrame:
    """Administrators: by authority first, else by network address. Adds ``outcome``.

    The lists are service settings, so they become literals.
    """
    by_authority = F.col("authenticated") & holds_authority(
        F.col("authorities"), F.array(*[F.lit(a) for a in admins]).cast("array<string>")
    )
    number = address_number(F.col("address"))
    by_address = F.lit(False)
    for block in blocks:
        span = block_range(F.lit(block))
        by_address = by_address | F.coalesce(number.between(span["lo"], span["hi"]), F.lit(False))
    return requests.withColumn("authentication", _authentication()).withColumn(
        "outcome", F.when(by_authority | by_address, AUTHORISED).otherwise(UNAUTHORISED)
    )


def requested_grants(text: Column) -> Column:
    """Comma-separated grants; empty entries are dropped and none means an empty list."""
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), ","), lambda g: F.trim(g) != "")
    return F.array_distinct(F.transform(parts, lambda g: F.upper(F.trim(g))))


def read_access(requests: DataFrame, streams: DataFrame) -> DataFrame:
    """Readers: the grants of a user's authorities must cover PUBLIC and everything requested.

    ``requests(stream, authenticated, authorities, grants)`` with ``grants`` an array;
    ``streams(stream, read_authorities map<authority, array<grant>>)``. An anonymous reader passes only
    without grants. Adds ``missing``, ``authentication`` and ``outcome``.
    """
    known = streams.select("stream", F.col("read_authorities").alias("_map"), F.lit(True).alias("_known"))
    empty = F.array().cast("array<string>")
    entries = F.filter(
        F.map_entries("_map"),
        lambda e: (e["key"] == ANYONE) | F.array_contains(F.coalesce("authorities", empty), e["key"]),
    )
    held = F.coalesce(F.array_distinct(F.flatten(F.transform(entries, lambda e: e["value"]))), empty)
    wanted = F.array_union(F.array(F.lit(PUBLIC)), F.coalesce("grants", empty))
    missing = F.when(F.col("authenticated"), F.sort_array(F.array_except(wanted, held))).otherwise(
        F.sort_array(F.coalesce("grants", empty))
    )
    return (
        requests.join(known, "stream", "left")
        .withColumn("missing", F.when(F.col("_known").isNotNull(), missing))
        .withColumn("authentication", _authentication())
        .withColumn(
            "outcome",
            F.when(F.col("_known").isNull(), ERROR)
            .when(F.size("missing") == 0, AUTHORISED)
            .otherwise(UNAUTHORISED),
        )
        .drop("_map", "_known")
    )


def _authentication() -> Column:
    return F.when(F.col("authenticated"), "AUTHENTICATED").otherwise("ANONYMOUS")


def security_counters(judged: DataFrame) -> DataFrame:
    """Requests by stream, authentication type and outcome."""
    return judged.groupBy("stream", "authentication", "outcome").agg(F.count("*").alias("requests"))
