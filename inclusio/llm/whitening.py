"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation.

``A`` is the matrix of the centred rows over sqrt(n), so that A'A is the covariance.  Step j multiplies
A by the right vector v_j and A' by the left vector that results, each made orthogonal to all before it
(twice).  Left vectors have an entry for each row, so none is ever stored: u_j = A q_j for a short vector
q_j, and one pass over the rows gives the norm of A q and the product A'(A q), block by block; the inner
products of a new left vector with the old ones follow from the products A'u_i that are known already.
The steps end with the row space (an exhausted space is left by a fresh random vector, so that repeated
eigenvalues are found) or, for more than ``FULL_STEPS`` dimensions, once the wanted values have
converged.  The small bidiagonal matrix's singular vectors turn the v_j into components, its singular
values are the deviations.  A last rotation within their span, from the products of the projected rows,
removes what rounding has left.

The driver holds vectors of one entry a dimension and small matrices only; rows are read from a staged
table of blocks of vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import ship, staged

COMPONENTS = 32
SCALE, SHIFT = 64, 1_000_000
#: Entries beyond this are no exact integers after scaling; such rows count as not finite.
LARGEST = float(1 << 45)
#: Vectors in a block.
ROWS = 2048
#: Up to so many dimensions the steps go through the whole row space.
FULL_STEPS = 256
#: Directions whose eigenvalue is below this share of the largest are no components.
RANK_SHARE = 1e-12
EPS = np.finfo(float).eps
BLOCKS = "ids binary, nulls binary, x binary"


def _vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Rows whose vector has entries, all of them finite."""
    v = F.col(vec_col).cast("array<double>")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) > LARGEST))
    return df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(v.isNotNull() & (F.size(v) > 0) & ~bad)


def integer_blocks(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, int]:
    """(staged blocks of the integer vectors, dimensions).  Vectors of another length than most are left out
    (of equally frequent lengths the longest stays)."""
    rows = _vectors(df, id_col, vec_col)
    sizes = rows.groupBy(F.size("v").alias("d")).count()
    most = sizes.agg(F.max_by("d", F.struct("count", "d"))).first()[0]
    dims = most or 0

    def pack(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                part = batch.slice(a, ROWS)
                v = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
                x = np.floor(SCALE * v).astype(np.int64) + SHIFT
                ids = part.column("vec_id")
                cells = ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False), x
                yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(c).tobytes()], pa.binary()) for c in cells], ["ids", "nulls", "x"])

    return staged(rows.where(F.size("v") == dims).mapInArrow(pack, BLOCKS), "whitening-blocks"), dims


def _sum_by_dim(blocks: DataFrame, part, size: int, kind: str):
    """Sum over all blocks of the vector ``part(x)``; each task sends one partial sum."""
    dtype = np.int64 if kind == "long" else np.float64

    def run(batches):
        total = np.zeros(size, dtype)
        for batch in batches:
            for cell in batch.column("x").to_pylist():
                total += part(np.frombuffer(cell, np.int64))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["dim", "value"])

    got = blocks.select("x").mapInArrow(run, f"dim int, value {kind}").groupBy("dim").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(size, dtype)
    for r in got:  # ``size`` values
        out[r.dim] = r.value
    return out


class Centred:
    """The centred rows over sqrt(n) as a linear operator; every product is one pass over the blocks."""

    def __init__(self, blocks: DataFrame, dims: int):
        self.blocks, self.dims = blocks, dims
        first = _sum_by_dim(blocks, lambda x: np.append(x.reshape(-1, dims).sum(axis=0), len(x) // dims), dims + 1, "long")
        self.sums, self.n = first[:-1], int(first[-1])

    def centre(self):
        """Function that gives a block's centred rows: (n x - S) / n, the numerator exact."""
        n, sums, d = self.n, self.sums, self.dims
        return lambda x: (n * x.reshape(-1, d) - sums) / n

    def gram_product(self, q: np.ndarray) -> tuple[np.ndarray, float]:
        """A'(A q) and the square of the norm of A q."""
        n, centre = self.n, self.centre()

        def part(x):
            a = centre(x)
            u = a @ q
            return np.append(u @ a, u @ u) / n

        got = _sum_by_dim(self.blocks, part, self.dims + 1, "double")
        return got[:-1], float(got[-1])

    def projected_products(self, basis: np.ndarray) -> np.ndarray:
        """(A basis)'(A basis), and the mean of the projected rows as its last row."""
        n, k, centre = self.n, basis.shape[1], self.centre()

        def part(x):
            z = centre(x) @ basis
            return np.concatenate(((z.T @ z).ravel(), z.sum(axis=0))) / n

        return _sum_by_dim(self.blocks, part, k * k + k, "double").reshape(k + 1, k)

    def trace(self) -> float:
        centre = self.centre()
        return float(_sum_by_dim(self.blocks, lambda x: np.array([(centre(x) ** 2).sum()]), 1, "double")[0]) / self.n


def _orthogonal(v: np.ndarray, basis: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for b in basis:
            v = v - (b @ v) * b
    return v


def bidiagonalise(a: Centred, wanted: int, trace: float, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(V, B): orthonormal right vectors as columns and the bidiagonal matrix with A V = U B."""
    rng = np.random.default_rng(seed)
    d, scale = a.dims, trace ** 0.5
    right: list[np.ndarray] = []
    left: list[tuple[np.ndarray, np.ndarray]] = []  # (q, A'A q) of each left vector A q
    alphas, betas = [], []  # diagonal; entry above the diagonal in the next column

    def fresh():
        """A unit vector of the row space orthogonal to the right vectors so far; None if there is none."""
        for _ in range(3):
            g = _orthogonal(rng.normal(size=d), right)
            if len(right) == d or np.linalg.norm(g) < 1e-8:
                return None
            g /= np.linalg.norm(g)
            r = _orthogonal(a.gram_product(g)[0], right)
            size = np.linalg.norm(r)
            if size > RANK_SHARE * trace:
                return _orthogonal(r / size, right) / np.linalg.norm(_orthogonal(r / size, right))
        return None

    v = fresh()
    while v is not None and len(right) < d:
        right.append(v)
        q = v
        for _ in range(2):  # u = A v - (u_i'A v) u_i over all i, as a short vector
            for qi, yi in left:
                q = q - (yi @ q) * qi
        y, norm2 = a.gram_product(q)
        alpha = norm2 ** 0.5
        if alpha <= (RANK_SHARE ** 0.5) * scale:  # the row space is exhausted
            right.pop()
            if betas:
                betas[-1] = 0.0
            break
        left.append((q / alpha, y / alpha))
        alphas.append(alpha)
        r = _orthogonal(y / alpha - alpha * v, right)
        beta = float(np.linalg.norm(r))
        if beta <= 64 * EPS * scale:
            betas.append(0.0)
            v = fresh()
        else:
            betas.append(beta)
            v = _orthogonal(r / beta, right)
            v /= np.linalg.norm(v)
        if d > FULL_STEPS and len(right) > wanted and v is not None:
            p, s, _ = np.linalg.svd(np.diag(alphas) + np.diag(betas[:-1], 1))
            if np.all(abs(betas[-1] * p[-1, :wanted]) <= 8 * EPS * s[0]):
                break
    if not right:
        return np.zeros((d, 0)), np.zeros((0, 0))
    k = len(right)
    return np.column_stack(right), np.diag(alphas[:k]) + np.diag(betas[:k - 1], 1)


def fit(a: Centred, components: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray, float, float]:
    """(components as columns, eigenvalues, trace, identity error) of the covariance, by falling eigenvalue.

    At most ``components``; fewer if the rank is smaller."""
    trace = a.trace() if a.n else 0.0
    if not trace > 0:
        return np.zeros((a.dims, 0)), np.zeros(0), trace, 0.0
    v, b = bidiagonalise(a, components, trace)
    _, s, wt = np.linalg.svd(b)
    basis = v @ wt.T
    keep = s ** 2 > RANK_SHARE * trace
    basis = basis[:, keep]
    values, turn = np.linalg.eigh(_symmetric(a.projected_products(basis)[:-1]))
    order = np.argsort(-values)[:components]
    comps = basis @ turn[:, order]
    comps /= np.linalg.norm(comps, axis=0)
    got = a.projected_products(comps)
    values = np.diag(got[:-1]) - got[-1] ** 2
    order = np.argsort(-values, kind="stable")
    comps, values, got = comps[:, order], values[order], got[np.append(order, len(values))][:, order]
    spread = (got[:-1] - np.outer(got[-1], got[-1])) / np.sqrt(np.outer(values, values))
    return comps, values, trace, float(abs(spread - np.eye(len(values))).max())


def _symmetric(m: np.ndarray) -> np.ndarray:
    return (m + m.T) / 2


RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row for each remaining row of ``df`` and component: vec_id, component (from 1), n, deviation (the
    sum over dimensions of (n x - S)^2), whitened, explained, identity_error.

    Rows whose vector is null or empty, holds null, NaN or infinite entries, entries beyond 2^45, or has
    another length than most vectors are dropped.  A null id stays null; repeated rows count and are
    returned each.  A deviation beyond a long is null.  There are as many components as the covariance has
    rank, ``components`` at most: equal vectors, a single row or an empty table give no rows.  Other columns
    are not read."""
    spark = df.sparkSession
    ship(spark)
    blocks, dims = integer_blocks(df, id_col, vec_col)
    if not dims:
        return spark.createDataFrame([], RESULT)
    a = Centred(blocks, dims)
    comps, values, trace, error = fit(a, components)
    k = len(values)
    if not k:
        return spark.createDataFrame([], RESULT)
    model = spark.sparkContext.broadcast((comps / np.sqrt(values), values / trace, a.n, a.sums))  # dimensions x components

    def run(batches):
        scaled, explained, n, sums = model.value
        for batch in batches:
            for row in batch.to_pylist():
                ids, nulls = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["nulls"], bool)
                over = n * np.frombuffer(row["x"], np.int64).reshape(-1, dims) - sums
                rows = len(ids)
                fits = (over.astype(float) ** 2).sum(axis=1) < 9.2e18
                deviation = np.where(fits, (np.where(fits[:, None], over, 0) ** 2).sum(axis=1), 0)
                z = (over / n) @ scaled
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(ids, k), mask=np.repeat(nulls, k)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                     pa.array(np.full(rows * k, n)), pa.array(np.repeat(deviation, k), mask=np.repeat(~fits, k)), pa.array(z.ravel()),
                     pa.array(np.tile(explained, rows)), pa.array(np.full(rows * k, error))],
                    [c.split()[0] for c in RESULT.split(", ")])

    return blocks.mapInArrow(run, RESULT)
