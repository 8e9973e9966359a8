"""Embedding whitening: leading eigenvectors of a covariance that is never formed, found by Jacobi-Davidson.

Vectors become whole numbers, so their sums are exact. They are packed into blocks of rows once, in the shared folder; every
product of the covariance with a few vectors is a Spark job over these blocks, which centres a block before it multiplies
and adds up parts of (dimensions x vectors) in two steps. The search itself needs matrices of the vectors' dimension only:

* Rayleigh-Ritz on a growing subspace gives pairs of values and vectors;
* leading pairs whose residual has reached double precision are locked and taken out of the problem;
* for the others the correction equation, projected against locked and current vectors, is solved by a few steps of MINRES,
  all of them side by side so that a step is one product; the corrections extend the subspace;
* a subspace that has grown too large restarts from its best vectors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import give_back, unused
from millrace.session import settle

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: A locked pair's residual against the greatest eigenvalue.
RESIDUAL = 64 * np.finfo(float).eps
#: Eigenvalues below this part of the greatest are no variance but rounding.
RANK = 1e-12
#: Entries of a block of rows.
ENTRIES = 1 << 21
#: Parts that tasks' sums are added up in before the driver adds the rest; a job sends it so many at most.
SLOTS = 16
#: Vectors beside the wanted ones, steps of MINRES for a correction, and rounds before the search is given up.
GUARD, INNER, ROUNDS = 8, 6, 100


def usable(vector: Column, dimension: int | None = None) -> Column:
    """Whether a vector has entries, all of them finite numbers (and ``dimension`` of them)."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    size = F.size(vector) > 0 if dimension is None else F.size(vector) == dimension
    return F.coalesce(vector.isNotNull() & size & finite, F.lit(False))


def _matrix(values: pa.Array, dimension: int) -> np.ndarray:
    """Whole numbers less ``SHIFT``, a row per vector."""
    entries = values.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return np.floor(SCALE * entries).astype(np.int64).reshape(-1, dimension)


def _least_type(matrix: np.ndarray) -> np.dtype:
    low, high = (int(matrix.min()), int(matrix.max())) if matrix.size else (0, 0)
    return np.result_type(np.min_scalar_type(min(low, -1)), np.min_scalar_type(min(low, -1 - high)))


def packed(vectors: DataFrame, column: str, dimension: int) -> DataFrame:
    """Blocks of rows: their number, entries in the least type of whole numbers that holds them, and exact sums."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(parts: list[np.ndarray]) -> pa.RecordBatch:
            whole = np.concatenate(parts)
            kind = _least_type(whole)
            sums = pa.array([whole.sum(axis=0).tolist()], pa.list_(pa.int64()))
            body = pa.array([whole.astype(kind).tobytes()], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([len(whole)], pa.int64()), pa.array([kind.str]), body, sums], names=["rows", "kind", "body", "sums"])

        held, rows = [], 0
        for batch in batches:
            some = _matrix(batch.column(0), dimension)
            for k in range(0, len(some), step):
                held.append(some[k : k + step])
                rows += len(held[-1])
                if rows >= step:
                    yield block(held)
                    held, rows = [], 0
        if held:
            yield block(held)

    step = max(1, ENTRIES // dimension)
    blocks = vectors.select(column).mapInArrow(pack, "rows bigint, kind string, body binary, sums array<bigint>")
    return settle(blocks, "vector-blocks")


@dataclass(frozen=True)
class Centre:
    """Rows, and for each dimension the exact sum of the whole numbers less ``SHIFT``."""

    n: int
    sums: tuple[int, ...]

    def parts(self) -> tuple[np.ndarray, np.ndarray]:
        """The mean as a whole number and what is left of n times it: small numbers, so that nothing overflows early."""
        whole = [s // self.n for s in self.sums]
        return np.array(whole, np.int64), np.array([s - self.n * m for s, m in zip(self.sums, whole, strict=True)], np.int64)

    def centred(self, matrix: np.ndarray) -> np.ndarray:
        whole, rest = self.parts()
        return (matrix.astype(np.int64) - whole) - rest / self.n

    def deviations(self, matrix: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)^2 of each row, exactly; None if that is no 64-bit number."""
        whole, rest = self.parts()
        far = matrix.astype(np.int64) - whole
        bound = (self.n * (np.abs(far).max(initial=0) + 1.0)) ** 2 * max(1, matrix.shape[1])
        if bound < 2**62:
            return ((far * self.n - rest) ** 2).sum(axis=1).tolist()
        rows = [sum((int(x) * self.n - int(r)) ** 2 for x, r in zip(row, rest, strict=True)) for row in far]
        return [x if x < 2**63 else None for x in rows]


def centre_of(blocks: DataFrame) -> Centre:
    each = blocks.select("rows", F.posexplode("sums").alias("at", "part"))
    found = each.groupBy("at").agg(F.sum("rows").alias("n"), F.sum(F.col("part").cast("decimal(38,0)")).alias("s")).orderBy("at").collect()
    return Centre(int(found[0]["n"]) if found else 0, tuple(int(row["s"]) for row in found))


def summed(blocks: DataFrame, work: Callable[[np.ndarray], np.ndarray], centre: Centre) -> np.ndarray:
    """``work`` on each centred block, added up over all: by task, then by slot, then on the driver."""
    dimension = len(centre.sums)

    def by_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for kind, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = np.frombuffer(body.as_buffer(), np.dtype(kind)).reshape(-1, dimension)
                part = work(centre.centred(rows))
                total = part if total is None else total + part
        if total is not None:
            task = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays(
                [pa.array([task % SLOTS], pa.int32()), pa.array([task], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["slot", "task", "part"]
            )
        give_back()

    def by_slot(rows: pa.Table) -> pa.Table:
        parts = sorted(zip(rows["task"].to_pylist(), rows["part"].to_pylist(), strict=True))
        total = sum(np.frombuffer(part) for _, part in parts)
        return pa.table({"slot": rows["slot"].slice(0, 1), "part": pa.array([total.tobytes()], pa.binary())})

    parts = blocks.select("kind", "body").mapInArrow(by_task, "slot int, task int, part binary")
    rows = parts.groupBy("slot").applyInArrow(by_slot, "slot int, part binary").collect()
    return sum(np.frombuffer(row["part"]) for row in sorted(rows, key=lambda row: row["slot"]))


def covariance_product(blocks: DataFrame, centre: Centre) -> Callable[[np.ndarray], np.ndarray]:
    """The covariance times some vectors, without the covariance."""

    def product(vectors: np.ndarray) -> np.ndarray:
        return summed(blocks, lambda rows: rows.T @ (rows @ vectors), centre).reshape(vectors.shape) / centre.n

    return product


def _against(basis: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """What of ``vectors`` stands upright on ``basis``; done twice, since once leaves rounding."""
    for _ in range(2):
        vectors = vectors - basis @ (basis.T @ vectors)
    return vectors


def _directions(basis: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what ``vectors`` add to ``basis``; vectors that add nothing are left out."""
    found = np.zeros((len(basis), 0))
    for column in vectors.T:
        size = np.linalg.norm(column)
        if not size:
            continue
        column = _against(np.hstack([basis, found]), (column / size)[:, None])
        if np.linalg.norm(column) > 1e-8:
            found = np.hstack([found, _against(np.hstack([basis, found]), column / np.linalg.norm(column))])
            found[:, -1] /= np.linalg.norm(found[:, -1])
    return found


def minres(operator: Callable[[np.ndarray], np.ndarray], right: np.ndarray, steps: int, enough: float = 0.05) -> np.ndarray:
    """Solutions of symmetric systems, a column each, by ``steps`` of MINRES or until all residuals are ``enough`` of the
    right sides. A step is one call of ``operator`` on all columns."""
    size = np.linalg.norm(right, axis=0)
    out = np.zeros_like(right)
    live = size > 0
    safe = np.where(live, size, 1.0)
    before, now = np.zeros_like(right), right / safe
    beta, left = np.zeros_like(size), size.copy()
    cos, sin, cos_before, sin_before = np.ones_like(size), np.zeros_like(size), np.ones_like(size), np.zeros_like(size)
    way, way_before = np.zeros_like(right), np.zeros_like(right)
    for _ in range(steps):
        image = operator(now) - beta * before
        alpha = (now * image).sum(axis=0)
        image = image - alpha * now
        following = np.linalg.norm(image, axis=0)
        # The new column of the tridiagonal matrix, turned by the two rotations before.
        far = sin_before * beta
        near = cos_before * beta
        upper = cos * near + sin * alpha
        diagonal = -sin * near + cos * alpha
        pivot = np.hypot(diagonal, following)
        live &= pivot > 1e-300
        pivot = np.where(live, pivot, 1.0)
        cos_before, sin_before, cos, sin = cos, sin, np.where(live, diagonal / pivot, 1.0), np.where(live, following / pivot, 0.0)
        way, way_before = (now - upper * way - far * way_before) / pivot, way
        out = out + np.where(live, cos * left, 0.0) * way
        left = -sin * left
        live &= following > 1e-14 * safe
        if not (live & (np.abs(left) > enough * safe)).any():
            break
        before, now, beta = now, image / np.where(following > 0, following, 1.0), following
    return out


def leading(product: Callable[[np.ndarray], np.ndarray], dimension: int, wanted: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` greatest eigenvalues of a symmetric positive operator, falling, and their unit eigenvectors as columns,
    all to residuals of ``RESIDUAL`` of the greatest."""
    wanted = min(wanted, dimension)
    locked = np.zeros((dimension, 0))
    space = np.linalg.qr(np.random.default_rng(seed).standard_normal((dimension, min(dimension, wanted + GUARD))))[0]
    image = product(space)
    most = min(dimension, 3 * wanted + 2 * GUARD)
    greatest, stale = 0.0, False
    for _ in range(ROUNDS):
        values, turn = np.linalg.eigh((space.T @ image + image.T @ space) / 2)
        turn = turn[:, ::-1]
        values, ritz, image = values[::-1], space @ turn, image @ turn
        greatest = max(greatest, values[0] if len(values) else 0.0)
        gaps = _against(locked, image - ritz * values)
        residuals = np.linalg.norm(gaps, axis=0)
        todo = wanted - locked.shape[1]
        open_ = np.flatnonzero(residuals[:todo] > RESIDUAL * greatest)
        done = int(open_[0]) if len(open_) else todo
        if done:
            # Locked pairs leave the problem; the rest goes on in what stands upright on them.
            locked = np.hstack([locked, ritz[:, :done]])
            ritz, image, values, gaps = ritz[:, done:], image[:, done:], values[done:], gaps[:, done:]
            open_ = open_ - done
            image = _against(locked, image)
        if locked.shape[1] == wanted:
            return _polished(product, locked)
        space = ritz
        if locked.shape[1] + space.shape[1] > most - len(open_) and locked.shape[1] + space.shape[1] < dimension:
            keep = max(wanted - locked.shape[1] + GUARD, 1)
            space, image = space[:, :keep], image[:, :keep]

        targets, levels = ritz[:, open_], values[open_]

        def projected(vectors: np.ndarray, locked=locked, targets=targets) -> np.ndarray:
            vectors = vectors - locked @ (locked.T @ vectors)
            return vectors - targets * (targets * vectors).sum(axis=0)

        def correction(vectors: np.ndarray, levels=levels, projected=projected) -> np.ndarray:
            vectors = projected(vectors)
            return projected(product(vectors) - vectors * levels)

        full = locked.shape[1] + space.shape[1] == dimension
        added = np.zeros((dimension, 0)) if full else _directions(np.hstack([locked, space]), minres(correction, -projected(gaps[:, open_]), INNER))
        if added.shape[1]:
            space, image, stale = np.hstack([space, added]), np.hstack([image, _against(locked, product(added))]), False
            continue
        if stale:
            raise RuntimeError("the residuals stay above double precision")
        # Nothing is left to add: only what has been carried along through the turns is inexact.
        space = np.linalg.qr(_against(locked, space))[0]
        image, stale = _against(locked, product(space)), True
    raise RuntimeError(f"no {wanted} eigenvectors in {ROUNDS} rounds")


def _polished(product: Callable[[np.ndarray], np.ndarray], vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rayleigh-Ritz once more over all locked vectors together, from a product of its own."""
    vectors = np.linalg.qr(vectors)[0]
    image = product(vectors)
    values, turn = np.linalg.eigh((vectors.T @ image + image.T @ vectors) / 2)
    return values[::-1], vectors @ turn[:, ::-1]


@dataclass(frozen=True)
class Whitening:
    """A fit: ``values`` fall, ``vectors`` has a column for each, ``explained`` is each value's part of the whole variance,
    ``identity_error`` the largest absolute entry of the whitened rows' covariance less the identity."""

    dimension: int
    centre: Centre
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray
    identity_error: float

    @property
    def basis(self) -> np.ndarray:
        return self.vectors / np.sqrt(self.values)


def fit(vectors: DataFrame, column: str, components: int = COMPONENTS) -> Whitening | None:
    """Fit to all usable vectors of the commonest length (of several, the greatest). None if there are none."""
    sizes = vectors.where(usable(F.col(column))).groupBy(F.size(column).alias("size")).count()
    common = sizes.orderBy(F.desc("count"), F.desc("size")).first()
    if common is None:
        return None
    dimension = common["size"]
    blocks = packed(vectors.where(usable(F.col(column), dimension)), column, dimension)
    centre = centre_of(blocks)
    values, found = leading(covariance_product(blocks, centre), dimension, components)
    kept = values > max(RANK * values[0], 0.0)
    values, found = values[kept], found[:, kept]
    basis = found / np.sqrt(values)

    def second_moments(rows: np.ndarray) -> np.ndarray:
        white = rows @ basis
        return np.append((white.T @ white).reshape(-1), (rows**2).sum())

    moments = summed(blocks, second_moments, centre) / centre.n
    error = np.abs(moments[:-1].reshape(len(values), len(values)) - np.eye(len(values))).max(initial=0.0)
    return Whitening(dimension, centre, values, found, values / moments[-1] if moments[-1] else values, float(error))


WHITENED = "struct<deviation: bigint, whitened: array<double>>"


def whitened(vector: Column, model: Whitening) -> Column:
    """Deviation and whitened coordinates of usable vectors of the fitted dimension."""
    basis = model.basis

    @F.arrow_udf(WHITENED)
    def project(values: pa.Array) -> pa.Array:
        rows = _matrix(values, model.dimension)
        white = model.centre.centred(rows) @ basis
        offsets = np.arange(len(rows) + 1, dtype=np.int32) * basis.shape[1]
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(white.reshape(-1)))
        return pa.StructArray.from_arrays([pa.array(model.centre.deviations(rows), pa.int64()), lists], names=["deviation", "whitened"])

    return project(vector)


def whitened_rows(vectors: DataFrame, column: str = "embedding", key: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """A row for each usable vector and component: ``key``, ``component`` (from 1, by falling variance), ``n``,
    ``deviation``, ``whitened``, ``explained`` and ``identity_error``.

    Vectors that are null or empty, hold null or non-finite entries, or have another length than most, are left out.
    Every entry c counts as floor(64 c) + 1000000. Rows that repeat count as often as they are there; null keys stay.
    Directions without variance have no component, so equal vectors, a single one, or an empty table give no rows.
    Eigenvectors of equal eigenvalues are any basis of their space, the same for all rows. ``deviation`` is null where it
    doesn't fit 64 bits. Columns beside ``key`` and ``column`` are not read, whatever their names.
    """
    model = fit(vectors, column, components)
    key_type = vectors.schema[key].dataType.simpleString()
    if model is None or not len(model.values):
        schema = f"`{key}` {key_type}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
        return vectors.sparkSession.createDataFrame([], schema)
    own, made = unused([key], "_made", "_entry")
    rows = vectors.where(usable(F.col(column), model.dimension)).select(F.col(key), whitened(F.col(column), model).alias(own))
    rows = rows.select(key, F.col(own)["deviation"].alias("deviation"), F.posexplode(F.col(own)["whitened"]).alias(made, "whitened"))
    explained = F.array(*(F.lit(float(x)) for x in model.explained))
    return rows.select(
        key,
        (F.col(made) + 1).alias("component"),
        F.lit(model.centre.n).cast("bigint").alias("n"),
        "deviation",
        "whitened",
        F.element_at(explained, F.col(made) + 1).alias("explained"),
        F.lit(model.identity_error).alias("identity_error"),
    )
