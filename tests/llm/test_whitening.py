import numpy as np
import pytest
from conftest import SF_SMALL
from inclusio.llm import catalog, whitening as W

VECTORS = "vec_id long, embedding array<float>"


def reference(vectors, components=32):
    """Eigenvectors of the covariance of the integer vectors, centred exactly."""
    x = np.floor(64 * np.asarray(vectors, np.float32).astype(float)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    centred = (n * x - s) / n
    e, q = np.linalg.eigh(centred.T @ centred / n)
    e, q = e[::-1], q[:, ::-1]
    k = min(components, int((e > 1e-9 * e[0]).sum()))
    return n, ((n * x - s) ** 2).sum(axis=1), centred @ q[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum(), e[:k]


def wide(rows, ids):
    k = max(r.component for r in rows)
    got = np.full((len(ids), k), np.nan)
    place = {i: n for n, i in enumerate(ids)}
    for r in rows:
        got[place[r.vec_id], r.component - 1] = r.whitened
    assert not np.isnan(got).any()
    return got


def check(rows, ids, vectors, tolerance=1e-7):
    n, deviation, z, explained, _ = reference(vectors)
    got = wide(rows, ids)
    assert got.shape == z.shape
    assert np.allclose(got * np.sign((got * z).sum(axis=0)), z, atol=tolerance)
    assert {r.n for r in rows} == {n}
    place = {i: m for m, i in enumerate(ids)}
    assert all(r.deviation == deviation[place[r.vec_id]] for r in rows)
    assert all(r.explained == pytest.approx(explained[r.component - 1], rel=1e-9) for r in rows)
    assert len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-8


def test_query_equals_eigenvectors_of_the_covariance(spark):
    vectors = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").collect()
    check(catalog.op12_whitening(spark, SF_SMALL).collect(), [r.vec_id for r in vectors], [r.embedding for r in vectors])


def test_falling_spectrum_and_many_dimensions(spark, monkeypatch):
    """Stops before the whole space once the wanted components have converged."""
    monkeypatch.setattr(W, "FULL_STEPS", 10)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 90)) * 0.8 ** np.arange(90) * 40
    rows = W.whiten(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], VECTORS), components=5).collect()
    _, _, z, _, _ = reference(x, 5)
    got = wide(rows, range(600))
    assert np.allclose(got * np.sign((got * z).sum(axis=0)), z, atol=1e-6)


def test_repeated_eigenvalues_are_all_found(spark):
    """Each axis equally often: all eigenvalues but one are equal."""
    rows = [(i, [4.0 if j == i % 6 else 0.0 for j in range(6)]) for i in range(60)]
    got = W.whiten(spark.createDataFrame(rows, VECTORS)).collect()
    assert {r.component for r in got} == set(range(1, 6)) and got[0].identity_error < 1e-9
    assert sum(r.explained for r in got if r.vec_id == 0) == pytest.approx(1)
    z = wide(got, range(60))
    assert np.allclose(z.T @ z / 60, np.eye(5), atol=1e-9)


def test_rank_below_the_wanted_components(spark):
    rng = np.random.default_rng(5)
    x = np.repeat(np.round(rng.normal(size=(50, 3)) * 64) / 64, 4, axis=1)
    got = W.whiten(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], VECTORS)).collect()
    assert {r.component for r in got} == {1, 2, 3}
    check(got, range(50), x)


def test_far_from_the_origin(spark):
    """A common offset a million times the spread must not cost precision."""
    rng = np.random.default_rng(9)
    x = np.round(rng.normal(size=(80, 5)) * 64) / 64 + 2.0 ** 17
    got = W.whiten(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()
    n, deviation, z, _, _ = reference(x - 2.0 ** 17)
    g = wide(got, range(80))
    assert np.allclose(g * np.sign((g * z).sum(axis=0)), z, atol=1e-8)


def test_odd_rows(spark):
    good = [(i, [float((i * 7) % 5), float((i * i) % 11), float(i % 3)]) for i in range(1, 20)]
    odd = [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [float("nan"), 1.0, 1.0]), (104, [float("inf"), 1.0, 1.0]), (105, [1.0, 2.0]), (106, [1e30, 0.0, 0.0])]
    again = [good[0], (None, [2.0, 2.0, 2.0])]
    df = spark.createDataFrame(good + odd + again, "vec_id long, embedding array<double>").selectExpr("*", "1 AS n", "'x' AS component", "2 AS dim", "3 AS value", "'y' AS x")
    rows = W.whiten(df).collect()
    assert {r.vec_id for r in rows} == {i for i, _ in good} | {None} and {r.n for r in rows} == {21} and len(rows) == 21 * 3
    n, deviation, _, _, _ = reference([v for _, v in good + again])
    assert {r.deviation for r in rows if r.vec_id is None} == {deviation[-1]}
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], VECTORS)
    assert [W.whiten(x).collect() for x in (df.limit(0), same, same.limit(1), df.where("vec_id > 99"))][:3] == [[], [], []]
    far = spark.createDataFrame([(i, [float(2 ** 40 * (i % 2)), float(i)]) for i in range(64)], "vec_id long, embedding array<double>")
    assert {r.deviation for r in W.whiten(far).collect()} == {None}
