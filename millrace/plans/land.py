"""Land: bounded ranges of the log as partitions of an external table."""

from __future__ import annotations

import re
import uuid
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import avro
from millrace.operators.mask import blank, mask_pii
from millrace.operators.ordered import running_total
from millrace.operators.positions import MAX_RECORDS_PER_PARTITION, latest_of
from millrace.plans.serve import read_as_latest
from millrace.session import passing, settle
from millrace.sources.log import bounded_offset_scan

PARTITION_COLUMN = "acquisition_instant"
VERSION_PROPERTY = "schema.version"
FILE_BYTES = 128 * 1024 * 1024
#: Bytes that a task of several files or landings writes, before it takes another one.
TASK_BYTES = FILE_BYTES // 8
#: Number of a rolled file within its task.
ROLLED = "_rolled"
#: Names of files that the driver asks for at once, and renamings that are under way at once.
NAMES, RENAMES = 10_000, 4


def acquisition_instant(ts: Column) -> Column:
    """UTC, whole seconds: ``20180516T091704Z``."""
    return F.date_format(ts, "yyyyMMdd'T'HHmmss'Z'")


def landing_path(database: Column, stream: Column, millis: Column, instant: Column) -> Column:
    return F.concat_ws("/", database, stream, millis.cast("string"), F.concat(F.lit(f"{PARTITION_COLUMN}="), instant))


def landed_rows(records: DataFrame, schema_json: str, replacer=blank) -> DataFrame:
    """Records as rows of the landed table: the newest schema's columns, personal data always masked."""
    message = mask_pii(read_as_latest(records, schema_json), replacer=replacer)
    columns = [f["name"] for f in avro.load(schema_json)["fields"]]
    return message.select(
        *[F.col("message")[c].alias(c) for c in columns],
        F.col("schema_version"),
        F.col("partition").alias("log_partition"),
        F.col("offset").alias("log_offset"),
    )


def record_bytes(rows: DataFrame) -> Column:
    """Bytes of each row as a line of JSON: what a text format writes, and about what others do before they compress."""
    return F.octet_length(F.to_json(F.struct(*rows.columns))).cast("bigint") + 1


def roll_by_bytes(rows: DataFrame, limit: int) -> DataFrame:
    """Rows dealt to tasks of about ``TASK_BYTES``, in order, with ``ROLLED``, the number of their file in their task. A file
    holds records of one schema version and log partition, and ends with the record that takes it to ``limit`` bytes or
    beyond: files follow from the records alone, whatever their order.

    The running sum of bytes goes by slices of offsets, so a partition of any size takes many tasks, and a task writes many
    files where these are small. Only the last file of each version and partition comes to the driver.
    """
    keys = ["schema_version", "log_partition"]
    sized = rows.withColumn("_bytes", record_bytes(rows))
    upto = running_total(sized, keys, "log_offset", F.col("_bytes"), "_upto")
    numbered = settle(upto.withColumn("_file", F.floor((F.col("_upto") - F.col("_bytes")) / limit)).drop("_upto", "_bytes"), "rolled")
    together, begin, many = max(1, TASK_BYTES // limit), [], 0
    for row in numbered.groupBy(*keys).agg(F.max("_file").alias("last")).orderBy(*keys).collect():
        begin.append((row["schema_version"], row["log_partition"], many))
        many += row["last"] // together + 1
    begins = F.broadcast(numbered.sparkSession.createDataFrame(begin, "_version int, _partition int, _begin int"))
    own = F.col("schema_version").eqNullSafe(F.col("_version")) & F.col("log_partition").eqNullSafe(F.col("_partition"))
    task = (F.col("_begin") + F.floor(F.col("_file") / together)).cast("int").alias("_task")
    dealt = numbered.join(begins, own).select(*numbered.columns, task).repartitionById(max(1, many), F.col("_task"))
    # Records longer than the limit leave numbers out, so files are counted within their task.
    counted = dealt.withColumn(ROLLED, F.dense_rank().over(W.partitionBy("_task").orderBy("_file")) - 1)
    return counted.sortWithinPartitions(ROLLED, "log_offset").select(*rows.columns, ROLLED)


def _land_rolled(rows: DataFrame, location: str, fmt: str, codec: str | None, limit: int) -> None:
    """The files of ``roll_by_bytes``, in the order of their names. Beside the landing, tasks write their first files to one folder,
    their second ones to another, and so on; from there files are renamed to one folder, which replaces the landing."""
    spark = rows.sparkSession
    target, files = _files(spark, location)
    pending = f"{target.getParent()}/_pending-{uuid.uuid4().hex}"
    with passing(spark):
        writer = roll_by_bytes(rows, limit).write.partitionBy(ROLLED)
        if codec:
            writer = writer.option("compression", codec)
        # Tasks put their files in place themselves; the driver doesn't move each of them when the job ends.
        writer.option("mapreduce.fileoutputcommitter.algorithm.version", 2).format(fmt).save(pending)
    flat = _files(spark, f"{pending}/flat")[0]
    files.mkdirs(flat)

    _gather(spark, files, _files(spark, pending)[0], flat)
    files.create(_files(spark, f"{pending}/flat/_SUCCESS")[0]).close()
    files.delete(target, True)
    if not files.rename(flat, target):
        raise OSError(f"a landing could not be put in its place: {location}")
    files.delete(_files(spark, pending)[0], True)


def _gather(spark: SparkSession, files, pending, flat) -> None:
    """Rename the files of the folders of ``ROLLED`` to one folder; its number goes behind that of their task, as Spark puts it
    into the name.

    A call to the JVM costs more than a renaming, and finding a class more than both: classes are found once, names come many at
    a time, and a file takes one call.
    """
    java, hadoop = spark._jvm.java, spark._jvm.org.apache.hadoop
    thing, copy, listed, paths_of = java.lang.Object, java.lang.System.arraycopy, java.util.Arrays.toString, hadoop.fs.FileUtil.stat2Paths
    move, array = hadoop.io.MapFile.rename, spark.sparkContext._gateway.new_array  # which renames any path, and fails where it can't
    target = f"{flat}/"
    with ThreadPoolExecutor(RENAMES) as pool:
        for folder in paths_of(files.listStatus(pending)):
            begin, rolled, number = f"{folder}".rpartition(f"/{ROLLED}=")
            if not rolled:
                continue
            begin, paths = f"{begin}{rolled}{number}/", paths_of(files.listStatus(folder))
            for start in range(0, len(paths), NAMES):
                many = min(NAMES, len(paths) - start)
                copy(paths, start, some := array(thing, many), 0, many)
                names = listed(some)[1:-1].removeprefix(begin).split(f", {begin}")
                places = [re.sub(r"(-\d{5,})", rf"\1-{int(number):08}", name, count=1) for name in names]
                for _ in pool.map(lambda name, place, begin=begin: move(files, begin + name, target + place), names, places):
                    pass


def land_batch(
    rows: DataFrame, location: str, fmt: str = "parquet", codec: str | None = None, file_rows: int | None = None, file_bytes: int | None = None
) -> None:
    """Write one landing to its own folder, replacing whatever an earlier attempt left there.

    Rows are rebalanced to files of about the advisory size, records of one schema version together; a
    version holding most of the rows is split over many files. With ``file_bytes`` files are rolled by the bytes of their
    records instead (``roll_by_bytes``). ``codec`` is the format's own (deflate level 3
    for ``avro`` is ``spark.sql.avro.deflate.level``).
    """
    if file_bytes:
        _land_rolled(rows, location, fmt, codec, file_bytes)
        return
    conf, size = rows.sparkSession.conf, "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    usual = conf.get(size, None)
    writer = rows.hint("rebalance", "schema_version").sortWithinPartitions("schema_version", "log_partition", "log_offset").write
    if codec:
        writer = writer.option("compression", codec)
    if file_rows:
        writer = writer.option("maxRecordsPerFile", file_rows)
    conf.set(size, str(FILE_BYTES))
    try:
        writer.mode("overwrite").format(fmt).save(location)
    finally:
        conf.set(size, usual) if usual else conf.unset(size)


def table_columns(schema_json: str) -> T.StructType:
    """Columns of the landed table, partition column excluded."""
    message = avro.spark_type(avro.load(schema_json))
    return T.StructType(
        [T.StructField(f.name, f.dataType) for f in message.fields]
        + [
            T.StructField("schema_version", T.IntegerType()),
            T.StructField("log_partition", T.IntegerType()),
            T.StructField("log_offset", T.LongType()),
        ]
    )


def create_table(spark: SparkSession, table: str, location: str, columns: T.StructType, version: int, fmt: str) -> None:
    listed = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns.fields)
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {table} ({listed}, {PARTITION_COLUMN} STRING) USING {fmt} "
        f"PARTITIONED BY ({PARTITION_COLUMN}) LOCATION '{location}' "
        f"TBLPROPERTIES ('{VERSION_PROPERTY}' = '{version}')"
    )


def alter_table(spark: SparkSession, table: str, columns: T.StructType, version: int) -> None:
    present = {c.lower() for c in spark.table(table).columns}
    added = [f for f in columns.fields if f.name.lower() not in present]
    if added:
        listed = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in added)
        spark.sql(f"ALTER TABLE {table} ADD COLUMNS ({listed})")
    spark.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ('{VERSION_PROPERTY}' = '{version}')")


def ensure_table(
    spark: SparkSession,
    table: str,
    location: str,
    schema_json: str,
    version: int,
    fmt: str = "parquet",
    create=create_table,
    alter=alter_table,
) -> str:
    """Create the external table once, and bring it to the newest schema: ``created`` / ``altered`` /
    ``unchanged``. Calling it again changes nothing. ``create`` and ``alter`` are the table's strategy."""
    columns = table_columns(schema_json)
    if not spark.catalog.tableExists(table):
        create(spark, table, location, columns, version, fmt)
        return "created"
    if table_version(spark, table) == version:
        return "unchanged"
    alter(spark, table, columns, version)
    return "altered"


def table_version(spark: SparkSession, table: str) -> int | None:
    rows = spark.sql(f"SHOW TBLPROPERTIES {table}").where(F.col("key") == VERSION_PROPERTY).take(1)
    return int(rows[0]["value"]) if rows else None


def register_partition(spark: SparkSession, table: str, instant: str, location: str) -> bool:
    """Add the partition at its folder; False when it was there already, which is no error."""
    spec = f"{PARTITION_COLUMN} = '{instant}'"
    known = spark.sql(f"SHOW PARTITIONS {table} PARTITION ({spec})").take(1)
    spark.sql(f"ALTER TABLE {table} ADD IF NOT EXISTS PARTITION ({spec}) LOCATION '{location}'")
    return not known


def drop_partition(spark: SparkSession, table: str, instant: str) -> None:
    """Forget the partition; the table is external, so its files stay."""
    spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION ({PARTITION_COLUMN} = '{instant}')")


COMMITS = f"stream string, partition int, start bigint, next_offset bigint, {PARTITION_COLUMN} string, location string"


def commit_offsets(plan: DataFrame, path: str, stream: str, instant: str, location: str | None = None) -> None:
    """Record what was landed where; the newest row per partition is the committed position."""
    (
        plan.select(
            F.lit(stream).alias("stream"),
            F.col("partition").cast("int").alias("partition"),
            F.col("start").cast("bigint").alias("start"),
            F.col("end").cast("bigint").alias("next_offset"),
            F.lit(instant).alias(PARTITION_COLUMN),
            F.lit(location).cast("string").alias("location"),
        )
        .coalesce(1)
        .write.mode("append")
        .parquet(path)
    )


def landings(commits: DataFrame, table: str) -> DataFrame:
    """What was committed, a row per landing, as its notification tells it."""
    return commits.groupBy("stream", PARTITION_COLUMN, "location").agg(F.sum(F.col("next_offset") - F.col("start")).alias("record_count")).select(
        "stream", F.lit(table).alias("table"), PARTITION_COLUMN, "location", "record_count"
    )


def land_range(
    spark: SparkSession,
    records: DataFrame,
    plan: DataFrame,
    *,
    stream: str,
    table: str,
    location: str,
    instant: str,
    schema_json: str,
    commits: str,
    notify=None,
) -> bool:
    """Files, then the partition, then the offsets, then the notification.

    A failure before the offsets are committed leaves the position where it was, and the same range is landed
    again over the same folder. What was committed is notified, whether or not an attempt before had registered the
    partition; a landing that is run again after that is notified again. Returns whether the partition is new.
    """
    land_batch(landed_rows(records, schema_json), location)
    created = register_partition(spark, table, instant, location)
    commit_offsets(plan, commits, stream, instant, location)
    if notify is not None:
        notify(
            plan.agg(F.sum(F.col("end") - F.col("start")).alias("record_count")).select(
                F.lit(stream).alias("stream"),
                F.lit(table).alias("table"),
                F.lit(instant).alias(PARTITION_COLUMN),
                F.lit(location).alias("location"),
                "record_count",
            )
        )
    return created


#: What share of the landings ahead a job lands and commits together, one at least: a failure costs no more than that.
TOGETHER = 8


def land_together(
    spark: SparkSession, log: DataFrame, passes: list[tuple[str, str, list[tuple[int, int, int]]]], *, stream: str, table: str, schema_json: str, commits: str, cap: int
) -> None:
    """Several landings that follow one another, in one job: files, then the partitions, then the offsets.

    ``passes`` holds an instant, a location and rows ``(partition, start, end)`` for each; a partition's ranges go on from one
    another and hold ``cap`` offsets but for its last. Files are written beside the table and renamed to the location of their
    landing, where they replace those of an earlier attempt.
    """
    spans: dict[int, tuple[int, int]] = {}
    for _, _, ranges in passes:
        for partition, start, end in ranges:
            spans[partition] = (spans.get(partition, (start, end))[0], end)
    whole = spark.createDataFrame([(p, *span) for p, span in spans.items()], "partition int, start bigint, end bigint")
    rows = landed_rows(bounded_offset_scan(log, whole), schema_json)
    number = "_landing"
    while number in rows.columns:
        number = "_" + number
    first = F.create_map(*[F.lit(x) for p, (start, _) in spans.items() for x in (p, start)])
    offset = F.col("log_offset") - F.try_element_at(first, F.col("log_partition").cast("int"))
    rows = rows.withColumn(number, F.floor(offset / cap).cast("int"))
    path, files = _files(spark, passes[0][1])
    pending = f"{path.getParent().getParent()}/_pending-{uuid.uuid4().hex}"
    conf, size = spark.conf, "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    usual = conf.get(size, None)
    order = [number, "schema_version", "log_partition", "log_offset"]
    conf.set(size, str(TASK_BYTES))
    try:
        rows.hint("rebalance", number, "schema_version").sortWithinPartitions(*order).write.partitionBy(number).parquet(pending)
    finally:
        conf.set(size, usual) if usual else conf.unset(size)
    for k, (_, location, _) in enumerate(passes):
        source, target = _files(spark, f"{pending}/{number}={k}")[0], _files(spark, location)[0]
        files.delete(target, True)
        files.mkdirs(target.getParent())
        if not (files.rename(source, target) if files.exists(source) else files.mkdirs(target)):
            raise OSError(f"a landing could not be put in its place: {location}")
    files.delete(_files(spark, pending)[0], True)
    places = " ".join(f"PARTITION ({PARTITION_COLUMN} = '{instant}') LOCATION '{location}'" for instant, location, _ in passes)
    spark.sql(f"ALTER TABLE {table} ADD IF NOT EXISTS {places}")
    done = [(stream, *span, instant, location) for instant, location, ranges in passes for span in ranges]
    spark.createDataFrame(done, COMMITS).coalesce(1).write.mode("append").parquet(commits)


def _files(spark: SparkSession, path: str):
    """A path and its file system."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def _kept(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a folder that is there once something was written to it."""
    place, files = _files(spark, path)
    return spark.read.schema(schema).parquet(path) if files.exists(place) else spark.createDataFrame([], schema)


def landing_job(
    spark: SparkSession,
    log: DataFrame,
    ends: DataFrame,
    *,
    stream: str,
    table: str,
    root: str,
    schema_json: str,
    version: int,
    commits: str,
    first_instant: datetime,
    interval: timedelta = timedelta(hours=1),
    cap: int = MAX_RECORDS_PER_PARTITION,
    notify=None,
    notify_table=None,
) -> int:
    """Land a log up to its ``ends``: plan, land, commit, and again until no partition is cut short by ``cap``.

    Where it goes on is read from the commits alone, once; a pass carries its own ends on, a number per partition, so its cost
    doesn't grow with the landings before. Where many landings are ahead, one in ``TOGETHER`` of them is written by one job and
    committed at once (``land_together``), each to its own folder and partition. A landing's number, and with it its folder and instant, is that
    of the landings committed before, so an attempt after a failure lands the same range over the same files.
    Committed landings are notified, each once its row is in ``<commits>-notified``: none is lost by a failure in between.
    That a table was created is told to ``notify_table`` in the same way: what is about to be created is noted in
    ``<commits>-creating`` first, and what was told in ``<commits>-created``. Returns the number of landings. One job at a
    time lands a stream.
    """
    told = f"{commits}-notified"
    _ensure_and_tell(spark, table, root, schema_json, version, stream, commits, notify_table)
    before = _kept(spark, commits, COMMITS).where(F.col("stream") == stream)

    def tell(due: DataFrame) -> None:
        instants = [row[PARTITION_COLUMN] for row in due.select(PARTITION_COLUMN).collect()]  # those landed together
        if instants:
            notify(due)
            spark.createDataFrame([(x,) for x in instants], f"{PARTITION_COLUMN} string").coalesce(1).write.mode("append").parquet(told)

    if notify is not None:
        tell(landings(before, table).join(_kept(spark, told, f"{PARTITION_COLUMN} string"), PARTITION_COLUMN, "left_anti"))
    # A row per partition each.
    goal = {row["partition"]: row["latest"] for row in latest_of(ends).collect()}
    at = {row["partition"]: row["committed"] for row in before.groupBy("partition").agg(F.max("next_offset").alias("committed")).collect()}
    number = before.select(PARTITION_COLUMN).distinct().count()
    landed = 0
    while True:
        ahead = max((-(-(end - (at.get(p) or 0)) // cap) for p, end in goal.items()), default=0)
        if ahead <= 0:
            return landed
        passes = []
        for k in range(number, number + max(1, ahead // TOGETHER)):
            ranges = [(p, at.get(p) or 0, min(end, (at.get(p) or 0) + cap)) for p, end in sorted(goal.items()) if end > (at.get(p) or 0)]
            instant = (first_instant + k * interval).astimezone(timezone.utc).strftime("%Y%m%dT%H%M%SZ")
            passes.append((instant, f"{root}/{stream}/{k}/{PARTITION_COLUMN}={instant}", ranges))
            at.update((p, end) for p, _, end in ranges)
        how = dict(stream=stream, table=table, schema_json=schema_json, commits=commits)
        if len(passes) > 1:
            land_together(spark, log, passes, cap=cap, **how)
        else:
            ((instant, location, ranges),) = passes
            plan = spark.createDataFrame(ranges, "partition int, start bigint, end bigint")
            land_range(spark, bounded_offset_scan(log, plan), plan, location=location, instant=instant, **how)
        number, landed = number + len(passes), landed + len(passes)
        if notify is not None:
            new = [(stream, *span, instant, location) for instant, location, ranges in passes for span in ranges]
            tell(landings(spark.createDataFrame(new, COMMITS), table))


def _ensure_and_tell(spark: SparkSession, table: str, root: str, schema_json: str, version: int, stream: str, commits: str, notify_table) -> None:
    """The table as it should be, and the notice of its creation sent at least once, whatever fails in between."""
    name, creating, created = "table string", f"{commits}-creating", f"{commits}-created"
    if notify_table is not None and not spark.catalog.tableExists(table):
        spark.createDataFrame([(table,)], name).write.mode("append").parquet(creating)
    ensure_table(spark, table, root, schema_json, version)
    if notify_table is None:
        return
    begun, ended = (_kept(spark, path, name).where(F.col("table") == table).count() for path in (creating, created))
    if begun > ended:  # a table that was dropped and created anew is told again; one that took several attempts, once
        notify_table(spark.createDataFrame([(stream, table, root)], "stream string, table string, location string"))
        spark.createDataFrame([(table,)] * (begun - ended), name).write.mode("append").parquet(created)
