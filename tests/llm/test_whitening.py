import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import queries, whitening

SF = "/root/testdata/sf0.001"


def plainly(vectors):
    """Whole numbers, exact sums, and the covariance formed and taken apart."""
    x = np.floor(64 * np.asarray(vectors, float)).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    far = x - sums / n
    values, found = np.linalg.eigh(far.T @ far / n)
    deviation = [sum(int(n * a - s) ** 2 for a, s in zip(row.tolist(), sums.tolist(), strict=True)) for row in x]
    return n, deviation, far, values[::-1], found[:, ::-1], np.trace(far.T @ far / n)


def agrees(rows, vectors, components):
    n, deviation, far, values, found, trace = plainly(vectors)
    count = min(components, len(values))
    assert len(rows) == n * count
    white = np.zeros((n, count))
    for row in rows:
        white[row.vec_id, row.component - 1] = row.whitened
        assert (row.n, row.deviation) == (n, deviation[row.vec_id])
        assert math.isclose(row.explained, values[row.component - 1] / trace, rel_tol=1e-10)
        assert 0 <= row.identity_error < 1e-10
    want = far @ (found[:, :count] / np.sqrt(values[:count]))
    signs = np.sign((white * want).sum(axis=0))
    assert np.abs(white - want * signs).max() < 1e-7
    assert np.abs(white.T @ white / n - np.eye(count)).max() < 1e-10


@pytest.mark.parametrize(("rows", "dimension", "components"), [(500, 20, 6), (300, 90, 10), (50, 3, 32), (400, 40, 40)])
def test_against_a_covariance_that_is_formed(spark, rows, dimension, components):
    rng = np.random.default_rng(rows)
    spread = 3.0 / (1 + np.arange(dimension)) ** 0.7
    vectors = (rng.standard_normal((rows, dimension)) * spread) @ np.linalg.qr(rng.standard_normal((dimension, dimension)))[0] + 5
    vectors = np.round(vectors, 3)
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    agrees(whitening.whitened_rows(table, components=components).collect(), vectors, components)


def test_the_query_over_its_whole_table(spark):
    out = queries.op11_whitening(spark, SF)
    rows = out.collect()
    table = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    assert [r.vec_id for r in table] == list(range(len(table)))
    agrees(rows, [r.embedding for r in table], 32)
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_many_close_values_by_jacobi_davidson_alone():
    """A spectrum with a cluster, in a dimension that the subspace never fills; products are counted."""
    rng = np.random.default_rng(1)
    values = np.concatenate([[50.0, 49.999, 20.0, 20.0, 10.0], np.linspace(8, 0.01, 395)])
    basis = np.linalg.qr(rng.standard_normal((400, 400)))[0]
    matrix = (basis * values) @ basis.T
    calls = []

    def product(x):
        calls.append(x.shape[1])
        return matrix @ x

    found, vectors = whitening.leading(product, 400, 8)
    assert np.allclose(found, np.sort(values)[::-1][:8], atol=1e-10)
    assert np.abs(matrix @ vectors - vectors * found).max() < 50 * 1e-13
    assert np.abs(vectors.T @ vectors - np.eye(8)).max() < 1e-12
    assert len(calls) < 200


def test_inner_solver():
    rng = np.random.default_rng(2)
    half = rng.standard_normal((30, 30))
    matrix = half + half.T  # neither positive nor negative
    right = rng.standard_normal((30, 3))
    right[:, 1] = 0
    assert np.allclose(matrix @ whitening.minres(lambda v: matrix @ v, right, 200, 1e-13), right, atol=1e-8)


def test_odd_rows_are_left_out(spark):
    inf, nan = float("inf"), float("nan")
    good = [[0.1 * k, 0.03 * k * k, 1.0 - (k % 3)] for k in range(12)]
    rows = [(k, v, "x") for k, v in enumerate(good)]
    odd = [(90, None, "x"), (91, [1.0, None, 2.0], None), (92, [nan, 1.0, 1.0], "x"), (93, [inf, 1.0, 1.0], "x"), (94, [], "x"), (95, [1.0, 2.0], "x")]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, component string")
    agrees(whitening.whitened_rows(table).collect(), np.asarray(good, np.float32), 32)
    repeated = spark.createDataFrame(rows + rows + [(None, good[0], "y")], table.schema)
    found = whitening.whitened_rows(repeated, components=1).collect()
    assert len(found) == 25 and {r.n for r in found} == {25} and sum(r.vec_id is None for r in found) == 1


def test_nothing_to_whiten(spark):
    schema = "vec_id long, embedding array<float>"
    columns = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    for rows in ([], [(1, None)], [(1, [])], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        out = whitening.whitened_rows(spark.createDataFrame(rows, schema))
        assert out.collect() == [] and out.columns == columns
    # One direction only: one component, even though three are there.
    line = spark.createDataFrame([(k, [1.0 * k, 2.0 * k, 0.5]) for k in range(5)], schema)
    assert {r.component for r in whitening.whitened_rows(line).collect()} == {1}


def test_exact_sums_of_great_numbers():
    centre = whitening.Centre(3_000_000_000, (5, -7_000_000_000))
    rows = np.array([[1, -2], [2**40, -(2**40)]], np.int64)
    n, (a, b) = centre.n, centre.sums
    want = [(n * x - a) ** 2 + (n * y - b) ** 2 for x, y in rows.tolist()]
    assert centre.deviations(rows) == [want[0] if want[0] < 2**63 else None, None]


def test_scan_is_pruned(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").withColumn("n", F.lit(1))
    plan = whitening.whitened_rows(table, components=2)._jdf.queryExecution().executedPlan().toString()
    assert "label" not in plan and "Exchange" not in plan
