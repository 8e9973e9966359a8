"""Queries over keyed logs, patches and documents."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.envelope import wrap_nullable
from millrace.operators import model
from millrace.queries.inputs import LOG_SQL, event_log, sql, table
from millrace.session import fresh_path
from millrace.sources.log import clear_keys as clear_all
from millrace.sources.log import latest_by_key as latest
from millrace.sources.log import model_projection as project
from millrace.sources.log import model_scan as scan_model

KEEP_AFTER = 1_705_708_800_000  # 2024-01-20

# One document per user. Small props create or delete it; every kind of event changes a member of its own,
# and documents of every fifth user also get sets that touch two members at once.
PATCHES = """
SELECT CAST(user_id AS STRING) AS document_id, event_id AS seq, CASE
  WHEN k < 3 THEN array(struct('add' AS op, '' AS path, concat('{{"base":', event_id, ',"a/b":"x"}}') AS value))
  WHEN k = 3 THEN array(struct('remove' AS op, '' AS path, CAST(NULL AS STRING) AS value))
  WHEN event_type = 'click' THEN array(struct('add' AS op, '/click' AS path, CAST(event_id AS STRING) AS value))
  WHEN event_type = 'view' THEN array(struct('replace' AS op, '/click' AS path, CAST(event_id AS STRING) AS value))
  WHEN event_type = 'purchase' AND user_id % 5 = 0 THEN array(struct('add' AS op, '/purchase' AS path, CAST(event_id AS STRING) AS value),
                                                              struct('add' AS op, '/count' AS path, CAST(event_id AS STRING) AS value))
  WHEN event_type = 'purchase' THEN array(struct('add' AS op, '/purchase' AS path, CAST(event_id AS STRING) AS value))
  WHEN event_type = 'error' THEN array(struct('remove' AS op, '/purchase' AS path, CAST(NULL AS STRING) AS value))
  ELSE array(struct('replace' AS op, '/signup' AS path, CAST(event_id AS STRING) AS value)) END AS operations
FROM (SELECT *, CAST(get_json_object(props, '$.k') AS INT) AS k FROM {events})
"""
PATCHES_SQL = """
moves AS (SELECT CAST(user_id AS VARCHAR) AS document_id, user_id, event_id AS seq, event_type, CAST(json_extract(props, '$.k') AS INT) AS k FROM events),
lives AS (SELECT *, sum(CASE WHEN k <= 3 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY seq) AS life FROM moves),
born AS (SELECT user_id, life, max(k) <= 3 AND max(k) < 3 AS alive, max(seq) AS born_seq FROM lives WHERE k <= 3 GROUP BY ALL),
steps AS (SELECT l.*, coalesce(b.alive, FALSE) AS alive, b.born_seq FROM lives l LEFT JOIN born b ON b.user_id = l.user_id AND b.life = l.life),
tried AS (SELECT *, max(CASE WHEN event_type = 'click' AND k > 3 THEN 1 ELSE 0 END) OVER w AS clicked,
  last_value(CASE WHEN k > 3 AND event_type IN ('purchase', 'error') THEN event_type END IGNORE NULLS) OVER w AS bought FROM steps
  WINDOW w AS (PARTITION BY user_id, life ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
current AS (SELECT t.* FROM tried t JOIN (SELECT user_id, max(life) AS life FROM lives GROUP BY user_id) m ON m.user_id = t.user_id AND m.life = t.life WHERE alive),
members AS (
  SELECT document_id, 'base' AS member, CAST(max(born_seq) AS VARCHAR) AS value FROM current GROUP BY document_id
  UNION ALL SELECT document_id, 'a/b', 'x' FROM current GROUP BY document_id
  UNION ALL SELECT document_id, 'click', CAST(max(seq) AS VARCHAR) FROM current WHERE k > 3 AND (event_type = 'click' OR (event_type = 'view' AND clicked = 1)) GROUP BY document_id
  UNION ALL SELECT document_id, 'purchase', CAST(arg_max(CASE WHEN event_type = 'purchase' THEN seq END, seq) AS VARCHAR) FROM current WHERE k > 3 AND event_type IN ('purchase', 'error')
    GROUP BY document_id HAVING arg_max(event_type, seq) = 'purchase'
  UNION ALL SELECT document_id, 'count', CAST(max(seq) AS VARCHAR) FROM current WHERE k > 3 AND event_type = 'purchase' AND user_id % 5 = 0 GROUP BY document_id)
"""


# Sets that must change nothing among sets that do: empty ones, root values that aren't JSON, unknown operations, paths
# that are no pointers, and, for users of every tenth number, removals of a root that never was.
BAD_PATCHES = """
SELECT CAST(user_id AS STRING) AS document_id, event_id AS seq, CASE event_id % 11
  WHEN 0 THEN CAST(array() AS array<struct<op:string,path:string,value:string>>)
  WHEN 1 THEN array(struct(CASE WHEN event_id % 2 = 0 THEN 'replace' ELSE 'add' END AS op, '' AS path, 'nope' AS value))
  WHEN 2 THEN array(struct('test' AS op, '' AS path, '{{"z":1}}' AS value))
  WHEN 3 THEN array(struct('add' AS op, '/a' AS path, CAST(event_id AS STRING) AS value), struct('add' AS op, '/b' AS path, CAST(event_id AS STRING) AS value))
  WHEN 4 THEN array(struct(CASE WHEN user_id % 10 = 0 THEN 'remove' ELSE 'add' END AS op, '' AS path, CASE WHEN user_id % 10 <> 0 THEN concat('{{"base":', event_id, '}}') END AS value))
  WHEN 5 THEN array(struct('add' AS op, '/m' AS path, '{{x' AS value))
  WHEN 6 THEN array(struct('add' AS op, 'm' AS path, '1' AS value))
  WHEN 7 THEN array(struct('add' AS op, '/a' AS path, '1' AS value), struct('remove' AS op, '/none' AS path, CAST(NULL AS STRING) AS value))
  ELSE array(struct('add' AS op, '/m' AS path, CAST(event_id AS STRING) AS value)) END AS operations
FROM {events}
"""
BAD_PATCHES_SQL = """
moves AS (SELECT CAST(user_id AS VARCHAR) AS document_id, user_id % 10 <> 0 AS lives, event_id AS seq, event_id % 11 AS k FROM events),
born AS (SELECT document_id, max(seq) AS root_seq, min(seq) AS first_seq FROM moves WHERE k = 4 AND lives GROUP BY document_id),
later AS (SELECT m.document_id, m.seq, m.k, b.root_seq FROM moves m JOIN born b ON b.document_id = m.document_id AND m.seq >= b.root_seq),
members AS (
  SELECT document_id, 'base' AS member, CAST(root_seq AS VARCHAR) AS value FROM born
  UNION ALL SELECT document_id, unnest(['a', 'b']), CAST(max(seq) AS VARCHAR) FROM later WHERE k = 3 GROUP BY document_id
  UNION ALL SELECT document_id, 'm', CAST(max(seq) AS VARCHAR) FROM later WHERE k > 7 GROUP BY document_id)
"""


def _bad_patches(spark, sf_dir):
    return sql(spark, sf_dir, BAD_PATCHES, "events")


def fold_bad_patches(spark, sf_dir):
    """Documents that sets which can't be applied leave as they are."""
    return members_of(model.fold_patches(_bad_patches(spark, sf_dir)))


def bad_patch_failures(spark, sf_dir):
    """Every such set, told from those that apply."""
    found = model.patch_failures(_bad_patches(spark, sf_dir), 500)
    return found.select("document_id", "seq", (F.col("reason") == model.UNREADABLE).alias("unreadable"))


def _patches(spark, sf_dir):
    return sql(spark, sf_dir, PATCHES, "events")


def members_of(documents):
    """Documents as rows of members."""
    return documents.select("document_id", F.explode(F.from_json("document", "map<string,string>")).alias("member", "value"))


def fold_patches(spark, sf_dir):
    return members_of(model.fold_patches(_patches(spark, sf_dir)))


def patch_failures(spark, sf_dir):
    return model.patch_failures(_patches(spark, sf_dir), 500).select("document_id", "seq")


def patch_log(spark, sf_dir):
    """Patch sets written to the patch log and read back."""
    path = fresh_path(spark, "patches")
    model.emit_patches(_patches(spark, sf_dir), path)
    stored = model.read_patches(spark.read.parquet(path))
    return stored.select("document_id", "seq", F.size("operations").alias("operations"), F.col("operations")[0]["path"].alias("path"))


def keyed_log(spark, sf_dir):
    return event_log(spark, sf_dir).select(
        F.when(F.col("user_id") % 50 != 7, F.col("user_id")).alias("key"), "offset", "ts_ms",
        F.when(F.col("event_type") != "error", F.col("event_type")).alias("value"),
    )


def latest_by_key(spark, sf_dir):
    return latest(keyed_log(spark, sf_dir), "key", "value", "offset")


def change_capture(spark, sf_dir):
    return model.change_capture(keyed_log(spark, sf_dir), "key", "value", "offset", 500)


def compact_log(spark, sf_dir):
    return model.compact_log(keyed_log(spark, sf_dir), "key", "value", "ts_ms", F.lit(KEEP_AFTER))


def roll_snapshot(spark, sf_dir):
    """A snapshot of the older part of the log, rolled forward over the newer part."""
    log = keyed_log(spark, sf_dir)
    previous = latest(log.where(F.col("ts_ms") <= KEEP_AFTER), "key", "value", "offset")
    return model.roll_snapshot(previous, log.where(F.col("ts_ms") > KEEP_AFTER), "key", "value")


def clear_keys(spark, sf_dir):
    log = keyed_log(spark, sf_dir)
    cleared = clear_all(log, "key", "value", "offset").withColumn("offset", F.lit(1 << 40))
    return clear_all(log, "key", "value", "offset").join(
        latest(log.select("key", "offset", "value").unionByName(cleared), "key", "value", "offset"), "key", "left_anti"
    ).select("key", "value")


def model_scan(spark, sf_dir):
    """A metadata log with null-prefixed values: documents, stored nulls, rows to skip and tombstones."""
    log = event_log(spark, sf_dir).select(
        F.col("user_id").alias("key"), "offset",
        F.when(F.col("event_type") == "error", None)
        .when(F.col("event_type") == "signup", F.unhex(F.lit("00FF")))
        .when(F.col("event_type") == "view", wrap_nullable(F.lit(None).cast("binary")))
        .otherwise(wrap_nullable(F.encode("props", "UTF-8"))).alias("value"),
    )
    return scan_model(log)


def model_projection(spark, sf_dir):
    """Two fields out of a wide document."""
    documents = table(spark, sf_dir, "customer").select(F.to_json(F.struct("*", F.struct("c_name", "c_acctbal").alias("detail"))).alias("document"))
    wanted = T.StructType([T.StructField("c_custkey", T.LongType()), T.StructField("detail", T.StructType([T.StructField("c_name", T.StringType())]))])
    return project(documents, wanted).select("model.c_custkey", "model.detail.c_name")


def model_snapshot(spark, sf_dir):
    """All current documents dumped as gzipped JSON and read back."""
    documents = model.fold_patches(_patches(spark, sf_dir))
    target = model.model_snapshot(documents, fresh_path(spark, "snapshots"), "2024-02-01", "2024-02-01T00-00-00Z")
    return members_of(spark.read.schema("document_id string, document string").json(target))


KEYED_SQL = f"""{LOG_SQL}, keyed AS (SELECT CASE WHEN user_id % 50 <> 7 THEN user_id END AS key, "offset", ts_ms, CASE WHEN event_type <> 'error' THEN event_type END AS value FROM log)"""

QUERIES = {
    "fold_patches": (fold_patches, f"WITH {PATCHES_SQL} SELECT document_id, member, value FROM members"),
    "fold_bad_patches": (fold_bad_patches, f"WITH {BAD_PATCHES_SQL} SELECT document_id, member, value FROM members"),
    "bad_patch_failures": (
        bad_patch_failures,
        f"""WITH {BAD_PATCHES_SQL} SELECT m.document_id, m.seq, m.k IN (0, 1, 2, 5, 6) AS unreadable FROM moves m LEFT JOIN born b ON b.document_id = m.document_id
        WHERE m.k IN (0, 1, 2, 5, 6, 7) OR (m.k <> 4 AND (b.first_seq IS NULL OR m.seq < b.first_seq))""",
    ),
    "model_snapshot": (model_snapshot, f"WITH {PATCHES_SQL} SELECT document_id, member, value FROM members"),
    "patch_failures": (
        patch_failures,
        f"""WITH {PATCHES_SQL} SELECT document_id, seq FROM tried WHERE k > 3 AND (NOT alive OR event_type = 'signup'
        OR (event_type = 'view' AND coalesce(clicked, 0) = 0) OR (event_type = 'error' AND bought IS DISTINCT FROM 'purchase'))""",
    ),
    "patch_log": (
        patch_log,
        f"""WITH {PATCHES_SQL} SELECT document_id, seq, CAST(CASE WHEN k > 3 AND event_type = 'purchase' AND user_id % 5 = 0 THEN 2 ELSE 1 END AS INT) AS operations,
        CASE WHEN k <= 3 THEN '' WHEN event_type IN ('click', 'view') THEN '/click' WHEN event_type IN ('purchase', 'error') THEN '/purchase' ELSE '/signup' END AS path FROM moves""",
    ),
    "latest_by_key": (
        latest_by_key,
        f"""WITH {KEYED_SQL} SELECT key, arg_max_null(value, "offset") AS value FROM keyed WHERE key IS NOT NULL GROUP BY key HAVING arg_max_null(value, "offset") IS NOT NULL""",
    ),
    "change_capture": (
        change_capture,
        f"""WITH {KEYED_SQL}, looked AS (SELECT key, "offset", value AS new, lag(value) OVER (PARTITION BY key ORDER BY "offset") AS old FROM keyed WHERE key IS NOT NULL)
        SELECT key, "offset", CASE WHEN new IS NULL THEN 'remove' WHEN old IS NULL THEN 'new' ELSE 'update' END AS change, old, new, coalesce(old = new, FALSE) AS same FROM looked""",
    ),
    "compact_log": (
        compact_log,
        f"""WITH {KEYED_SQL}, old AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY "offset" DESC) AS rn FROM keyed WHERE ts_ms <= {KEEP_AFTER} AND key IS NOT NULL)
        SELECT key, "offset", ts_ms, value FROM old WHERE rn = 1 AND value IS NOT NULL UNION ALL SELECT key, "offset", ts_ms, value FROM keyed WHERE ts_ms > {KEEP_AFTER}""",
    ),
    "roll_snapshot": (
        roll_snapshot,
        f"""WITH {KEYED_SQL} SELECT key, arg_max_null(value, "offset") AS value FROM keyed WHERE key IS NOT NULL GROUP BY key HAVING arg_max_null(value, "offset") IS NOT NULL""",
    ),
    "clear_keys": (
        clear_keys,
        f"""WITH {KEYED_SQL} SELECT key, CAST(NULL AS VARCHAR) AS value FROM keyed WHERE key IS NOT NULL GROUP BY key HAVING arg_max_null(value, "offset") IS NOT NULL""",
    ),
    "model_scan": (
        model_scan,
        f"""WITH {LOG_SQL} SELECT user_id AS key, arg_max(event_type, "offset") = 'view' AS is_null, arg_max_null(CASE WHEN event_type <> 'view' THEN props END, "offset") AS document
        FROM log WHERE event_type <> 'signup' GROUP BY user_id HAVING arg_max(event_type, "offset") <> 'error'""",
    ),
    "model_projection": (model_projection, "SELECT c_custkey, c_name FROM customer"),
}
