"""Every registered query against its oracle on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry_points
from millrace.queries import all_queries

SF = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
QUERIES, ORACLES = entry_points.queries(), entry_points.oracle_sql()
TYPES = {"int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    return value


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query(spark, duck, name):
    frame = QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in frame.collect()), key=repr)
    assert name in ORACLES, "every query here has an oracle"
    cursor = duck.execute(ORACLES[name])
    described = {d[0]: str(d[1]) for d in cursor.description}
    assert sorted(described) == columns
    order = [list(described).index(c) for c in columns]
    expected = sorted((tuple(plain(r[i]) for i in order) for r in cursor.fetchall()), key=repr)
    assert rows == expected
    for field in frame.schema.fields:
        assert TYPES[field.dataType.simpleString()] == described[field.name], field.name


def test_entry(spark):
    assert entry_points.entry(spark).count() == 5
