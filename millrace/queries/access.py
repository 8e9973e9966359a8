"""Queries over access decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions.net import client_address
from millrace.operators import access
from millrace.queries.inputs import sql

# One stream per nation with the blocks of its suppliers; customers ask for access to nation streams.
_BLOCKS = """
SELECT concat('stream_', s_nationkey) AS stream,
       concat('10.', s_suppkey % 4, '.', s_suppkey % 256, '.77/', CASE WHEN s_suppkey % 41 = 0 THEN 6 ELSE 14 + s_suppkey % 15 END) AS cidr
FROM {supplier}
"""
_REQUESTS = """
SELECT c_custkey, concat('stream_', c_custkey % 30) AS stream, c_custkey % 3 <> 0 AS authenticated,
       array(c_mktsegment, concat('team_', c_custkey % 7)) AS authorities,
       CASE WHEN c_custkey % 5 = 0 THEN concat('10.', c_custkey % 4, '.', c_custkey % 256, '.', c_custkey % 200) END AS forwarded,
       concat('10.', c_custkey % 4, '.', c_custkey % 256, '.', c_custkey % 250) AS remote,
       CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'PII' WHEN 2 THEN ',public,,PII' ELSE NULL END AS grants
FROM {customer}
"""
# Streams allow two segments each, some everybody; read grants by segment.
_NATIONS = """
SELECT concat('stream_', n_nationkey) AS stream,
       CASE WHEN n_nationkey % 6 = 0 THEN array('*') WHEN n_nationkey % 6 = 1 THEN array('BUILDING', 'team_3')
            WHEN n_nationkey % 6 = 2 THEN CAST(NULL AS ARRAY<STRING>) ELSE array('MACHINERY') END AS authorities,
       CASE n_nationkey % 4 WHEN 0 THEN map('*', array('PUBLIC'), 'BUILDING', array('PII')) WHEN 1 THEN map('MACHINERY', array('PUBLIC', 'PII'))
            WHEN 2 THEN map('team_1', array('PII')) END AS read_authorities
FROM {nation}
"""


def _requests(spark, sf_dir):
    made = sql(spark, sf_dir, _REQUESTS, "customer")
    return made.withColumn("address", client_address(F.col("forwarded"), F.col("remote")))


def _blocks(spark, sf_dir):
    return sql(spark, sf_dir, _BLOCKS, "supplier")


def _nations(spark, sf_dir):
    return sql(spark, sf_dir, _NATIONS, "nation")


def cidr_access(spark, sf_dir):
    return access.cidr_access(_requests(spark, sf_dir), _blocks(spark, sf_dir)).select("c_custkey", "stream", "address", "cidr_ok")


def _written(spark, sf_dir):
    return access.write_access(_requests(spark, sf_dir), _nations(spark, sf_dir).drop("read_authorities"), _blocks(spark, sf_dir))


def write_access(spark, sf_dir):
    return _written(spark, sf_dir).select("c_custkey", "authentication", "outcome")


def authority_access(spark, sf_dir):
    joined = _requests(spark, sf_dir).join(_nations(spark, sf_dir).select("stream", F.col("authorities").alias("allowed")), "stream")
    return joined.select("c_custkey", access.holds_authority(F.col("authorities"), F.col("allowed")).alias("allowed"))


def admin_access(spark, sf_dir):
    judged = access.admin_access(_requests(spark, sf_dir), ["FURNITURE", "team_2"], ["10.1.0.0/16", "10.2.3.0/24"])
    return judged.select("c_custkey", "outcome")


def _read(spark, sf_dir):
    requests = _requests(spark, sf_dir).withColumn("grants", access.requested_grants(F.col("grants")))
    return access.read_access(requests, _nations(spark, sf_dir).drop("authorities"))


def grant_check(spark, sf_dir):
    return _read(spark, sf_dir).select("c_custkey", F.array_join("missing", ",").alias("missing"), "authentication", "outcome")


def security_counters(spark, sf_dir):
    judged = _written(spark, sf_dir).select("stream", "authentication", "outcome").union(
        _read(spark, sf_dir).select("stream", "authentication", "outcome")
    )
    return access.security_counters(judged)


_REQUESTS_SQL = """
requests AS (SELECT c_custkey, 'stream_' || (c_custkey % 30) AS stream, c_custkey % 30 AS nation, c_custkey % 3 <> 0 AS authenticated, c_mktsegment, 'team_' || (c_custkey % 7) AS team,
  '10.' || (c_custkey % 4) || '.' || (c_custkey % 256) || '.' || (c_custkey % CASE WHEN c_custkey % 5 = 0 THEN 200 ELSE 250 END) AS address,
  (10::BIGINT << 24) + ((c_custkey % 4) << 16) + ((c_custkey % 256) << 8) + c_custkey % CASE WHEN c_custkey % 5 = 0 THEN 200 ELSE 250 END AS ip,
  c_custkey % 4 AS g FROM customer),
blocks AS (SELECT 'stream_' || s_nationkey AS stream, (10::BIGINT << 24) + ((s_suppkey % 4) << 16) + ((s_suppkey % 256) << 8) + 77 AS n, CASE WHEN s_suppkey % 41 = 0 THEN 6 ELSE 14 + s_suppkey % 15 END AS bits FROM supplier),
cidr AS (SELECT r.*, EXISTS (SELECT 1 FROM blocks b WHERE b.stream = r.stream AND (r.ip >> (32 - b.bits)) = (b.n >> (32 - b.bits))) AS cidr_ok FROM requests r),
authority AS (SELECT *, CASE nation % 6 WHEN 0 THEN TRUE WHEN 1 THEN c_mktsegment = 'BUILDING' OR team = 'team_3' WHEN 2 THEN FALSE ELSE c_mktsegment = 'MACHINERY' END AS auth_ok FROM cidr),
written AS (SELECT *, CASE WHEN authenticated THEN 'AUTHENTICATED' ELSE 'ANONYMOUS' END AS authentication,
  CASE WHEN nation >= 25 THEN 'ERROR' WHEN CASE WHEN authenticated THEN auth_ok ELSE cidr_ok END THEN 'AUTHORISED' ELSE 'UNAUTHORISED' END AS outcome FROM authority),
held AS (SELECT *, g IN (1, 2) AS wants_pii,
  CASE nation % 4 WHEN 0 THEN TRUE WHEN 1 THEN c_mktsegment = 'MACHINERY' ELSE FALSE END AS has_public,
  CASE nation % 4 WHEN 0 THEN c_mktsegment = 'BUILDING' WHEN 1 THEN c_mktsegment = 'MACHINERY' WHEN 2 THEN team = 'team_1' ELSE FALSE END AS has_pii FROM requests),
missing AS (SELECT *, CASE WHEN nation >= 25 THEN NULL WHEN NOT authenticated THEN CASE g WHEN 1 THEN 'PII' WHEN 2 THEN 'PII,PUBLIC' ELSE '' END
  ELSE concat_ws(',', CASE WHEN wants_pii AND NOT has_pii THEN 'PII' END, CASE WHEN NOT has_public THEN 'PUBLIC' END) END AS missing FROM held),
readers AS (SELECT *, CASE WHEN authenticated THEN 'AUTHENTICATED' ELSE 'ANONYMOUS' END AS authentication,
  CASE WHEN missing IS NULL THEN 'ERROR' WHEN missing = '' THEN 'AUTHORISED' ELSE 'UNAUTHORISED' END AS outcome FROM missing)
"""

QUERIES = {
    "cidr_access": (cidr_access, f"WITH {_REQUESTS_SQL} SELECT c_custkey, stream, address, cidr_ok FROM cidr"),
    "write_access": (write_access, f"WITH {_REQUESTS_SQL} SELECT c_custkey, authentication, outcome FROM written"),
    "authority_access": (authority_access, f"WITH {_REQUESTS_SQL} SELECT c_custkey, auth_ok AS allowed FROM authority WHERE nation < 25"),
    "admin_access": (
        admin_access,
        f"""WITH {_REQUESTS_SQL} SELECT c_custkey, CASE WHEN (authenticated AND (c_mktsegment = 'FURNITURE' OR team = 'team_2')) OR (ip >> 16) = (10 << 8) + 1 OR (ip >> 8) = (10 << 16) + (2 << 8) + 3
        THEN 'AUTHORISED' ELSE 'UNAUTHORISED' END AS outcome FROM requests""",
    ),
    "grant_check": (grant_check, f"WITH {_REQUESTS_SQL} SELECT c_custkey, missing, authentication, outcome FROM readers"),
    "security_counters": (
        security_counters,
        f"""WITH {_REQUESTS_SQL} SELECT stream, authentication, outcome, count(*) AS requests FROM (
        SELECT stream, authentication, outcome FROM written UNION ALL SELECT stream, authentication, outcome FROM readers) GROUP BY ALL""",
    ),
}
