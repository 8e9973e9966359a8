"""Replica inventory: where each partition copy lives, how big it is and who leads it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import settle

TP = ["topic", "partition"]


def replica_inventory(
    replicas: DataFrame,
    leaders: DataFrame,
    retention: DataFrame,
    offsets: DataFrame,
    sizes: DataFrame,
    disks: DataFrame,
) -> DataFrame:
    """One row per replica with everything known about it; whatever is unknown takes a zero default.

    ``replicas(broker, log_dir, topic, partition, log_size)``, ``leaders(broker, topic, partition, leader,
    in_sync)``, ``retention(topic, retention_ms)``, ``offsets(topic, partition, begin, end)``,
    ``sizes(broker, topic, partition, size_on_disk)``, ``disks(broker, log_dir, free, total)``.
    """
    joined = (
        replicas.join(leaders, ["broker", *TP], "left")
        .join(sizes, ["broker", *TP], "left")
        .join(offsets, TP, "left")
        .join(retention, "topic", "left")
        .join(disks, ["broker", "log_dir"], "left")
    )
    no, zero = F.lit(False), F.lit(0).cast("bigint")
    begin, end = F.coalesce("begin", zero), F.coalesce("end", zero)
    return joined.select(
        "broker",
        F.coalesce("log_dir", F.lit("")).alias("log_dir"),
        *TP,
        F.coalesce("leader", no).alias("leader"),
        F.coalesce("in_sync", no).alias("in_sync"),
        F.coalesce("size_on_disk", zero).alias("size_on_disk"),
        F.coalesce("log_size", zero).alias("log_size"),
        begin.alias("begin"),
        end.alias("end"),
        (end - begin).alias("record_count"),
        F.coalesce("retention_ms", zero).alias("retention_ms"),
        F.coalesce("free", zero).alias("disk_free"),
        F.coalesce("total", zero).alias("disk_total"),
    )


def distinct_topics(replicas: DataFrame) -> DataFrame:
    return replicas.select("topic").distinct()


def inventory_tree(inventory: DataFrame) -> DataFrame:
    """Nest replicas by topic, log dir and broker, topics in name order.

    A group holds the replicas of one topic on one disk: metadata, bounded by what one broker can host.
    """
    replica = F.struct("partition", "leader", "in_sync", "size_on_disk", "log_size", "begin", "end", "record_count")
    topics = inventory.groupBy("broker", "log_dir", "topic").agg(
        F.max("retention_ms").alias("retention_ms"),
        F.max("disk_free").alias("disk_free"),
        F.max("disk_total").alias("disk_total"),
        F.sort_array(F.collect_list(replica)).alias("replicas"),
    )
    dirs = topics.groupBy("broker", "log_dir").agg(
        F.max("disk_free").alias("disk_free"),
        F.max("disk_total").alias("disk_total"),
        F.sort_array(F.collect_list(F.struct("topic", "retention_ms", "replicas"))).alias("topics"),
    )
    return dirs.groupBy("broker").agg(
        F.sort_array(F.collect_list(F.struct("log_dir", "disk_free", "disk_total", "topics"))).alias("log_dirs")
    )


def inventory_gauges(inventory: DataFrame) -> DataFrame:
    """Flat gauges ``(metric, broker, log_dir, topic, partition, leader, in_sync, value)``.

    Disk gauges are per log dir; the others per replica. The inventory is read twice, so it is written first.
    """
    inventory = settle(inventory, "inventory")
    tags = ["broker", "log_dir", "topic", "partition", "leader", "in_sync"]
    per_replica = inventory.unpivot(
        tags, ["size_on_disk", "log_size", "begin", "end", "record_count"], "metric", "value"
    )
    disks = inventory.groupBy("broker", "log_dir").agg(
        F.max("disk_free").alias("disk_free"), F.max("disk_total").alias("disk_total")
    ).withColumn("disk_used", F.col("disk_total") - F.col("disk_free"))
    per_disk = disks.unpivot(["broker", "log_dir"], ["disk_free", "disk_total", "disk_used"], "metric", "value")
    return per_replica.unionByName(per_disk, allowMissingColumns=True).select("metric", *tags, "value")


def flatten_tree(tree: DataFrame) -> DataFrame:
    """The replicas of a nested inventory, one row each."""
    return (
        tree.select("broker", F.explode("log_dirs").alias("d"))
        .select("broker", "d.log_dir", "d.disk_free", "d.disk_total", F.explode("d.topics").alias("t"))
        .select("broker", "log_dir", "disk_free", "disk_total", "t.topic", "t.retention_ms", F.explode("t.replicas").alias("r"))
        .select("broker", "log_dir", "topic", "r.*", "retention_ms", "disk_free", "disk_total")
    )
