"""Aggregate-once threshold search equals brute force; metrics equal their definitions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from inclusio import config as C
from inclusio.functions import decide as D
from inclusio.operators import metrics as M
from inclusio.operators import search as SR


def f1_np(y, p, average):
    labels = sorted(set(y) | set(p))
    f1s, sup = [], []
    for c in labels:
        tp = np.sum((y == c) & (p == c))
        s, q = np.sum(y == c), np.sum(p == c)
        f1s.append(2 * tp / (s + q) if s + q else 0.0)
        sup.append(s)
    f1s, sup = np.array(f1s), np.array(sup)
    return float((f1s * sup).sum() / sup.sum()) if average == "weighted" else float(f1s.mean())


def decide_np(p1, p2, t1, t2):
    return np.where(p2 >= t2, 2, np.where(p1 >= t1, 1, 0))


@pytest.fixture(scope="module")
def probs(spark):
    rng = np.random.default_rng(11)
    n = 500
    raw = rng.dirichlet([2, 1.5, 0.6], size=n)
    y = np.array([rng.choice(3, p=r) for r in raw])
    # a few probabilities exactly on grid points
    g = C.threshold_grid(15)
    raw[:5, 2] = g[3]
    raw[5:10, 1] = g[7]
    country = rng.choice([0, 1, 3], size=n)
    pdf = [(int(y[i]), float(raw[i, 1]), float(raw[i, 2]), int(country[i])) for i in range(n)]
    return spark.createDataFrame(pdf, "y int, p1 double, p2 double, country int"), y, raw, country


@pytest.mark.parametrize("metric", ["f1_weighted", "f1_macro"])
def test_cube_equals_brute_force(spark, probs, metric):
    df, y, raw, _ = probs
    grid = C.threshold_grid(15)
    sc = SR.cube_scores(SR.grid_cells(df, F.col("p1"), F.col("p2"), "y", grid), len(grid)).toPandas()
    avg = "weighted" if metric == "f1_weighted" else "macro"
    for _, r in sc.iterrows():
        exp = f1_np(y, decide_np(raw[:, 1], raw[:, 2], grid[int(r["j1"])], grid[int(r["j2"])]), avg)
        assert abs(r[metric] - exp) < 1e-12
    best = SR.first_best(sc_df := SR.cube_scores(SR.grid_cells(df, F.col("p1"), F.col("p2"), "y", grid),
                                                  len(grid)), metric, ["j2", "j1"]).first()
    # reference loop: t2 outer, t1 inner, strictly better
    bf, bj = 0.0, None
    for j2, t2 in enumerate(grid):
        for j1, t1 in enumerate(grid):
            s = f1_np(y, decide_np(raw[:, 1], raw[:, 2], t1, t2), avg)
            if s > bf:
                bf, bj = s, (j2, j1)
    assert (best["j2"], best["j1"]) == bj
    del sc_df


def test_pinned_group(spark, probs):
    df, y, raw, country = probs
    grid = C.threshold_grid(10)
    pinned = F.when(F.col("country") == 0, F.col("p2") >= 0.95)
    sc = SR.cube_scores(SR.grid_cells(df, F.col("p1"), F.col("p2"), "y", grid, high_override=pinned),
                        len(grid)).toPandas()
    for _, r in sc.sample(20, random_state=1).iterrows():
        t1, t2 = grid[int(r["j1"])], grid[int(r["j2"])]
        t2v = np.where(country == 0, 0.95, t2)
        exp = f1_np(y, decide_np(raw[:, 1], raw[:, 2], t1, t2v), "weighted")
        assert abs(r["f1_weighted"] - exp) < 1e-12


def test_metrics(spark, probs):
    df, y, raw, _ = probs
    scored = df.withColumn("pred", D.apply_thresholds("p1", "p2", 0.3, 0.35))
    p = decide_np(raw[:, 1], raw[:, 2], 0.3, 0.35)
    r = M.f1_scores(scored).first()
    assert abs(r["f1_weighted"] - f1_np(y, p, "weighted")) < 1e-12
    assert abs(r["f1_macro"] - f1_np(y, p, "macro")) < 1e-12
    cm = {row["y"]: row for row in M.confusion_matrix(scored).collect()}
    for t in range(3):
        for q in range(3):
            assert cm[t][f"pred_{q}"] == int(np.sum((y == t) & (p == q)))


def test_argmax_first_on_ties(spark):
    df = spark.createDataFrame([(0.4, 0.4, 0.2), (0.2, 0.4, 0.4), (0.1, 0.2, 0.7)], "a double, b double, c double")
    assert [r[0] for r in df.select(D.argmax_class("a", "b", "c")).collect()] == [0, 1, 2]


def test_simplex_grid():
    assert len(C.simplex_weights(0.1)) == 66 and len(C.simplex_weights(0.2)) == 21


def test_exact_quantiles_match_numpy(spark):
    from inclusio.operators.quantiles import exact_quantiles
    rng = np.random.default_rng(5)
    n = 3000
    g = rng.choice([0, 1, 2], size=n, p=[0.8, 0.15, 0.05])   # one hot group
    v = np.round(rng.normal(0, 3, n), 1)                      # many ties
    v[:50] = np.nan
    rows = [(int(g[i]), None if np.isnan(v[i]) else float(v[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "g int, v double")
    qs = {"q10": 0.1, "q25": 0.25, "q50": 0.5, "q90": 0.9}
    got = {r["g"]: r for r in exact_quantiles(df, ["g"], "v", qs, num_partitions=6).collect()}
    for k in range(3):
        x = v[(g == k) & ~np.isnan(v)]
        for name, q in qs.items():
            assert abs(got[k][name] - np.percentile(x, q * 100)) < 1e-9
    allq = exact_quantiles(df, [], "v", {"m": 0.5}).first()["m"]
    assert abs(allq - np.median(v[~np.isnan(v)])) < 1e-9


def test_weight_search_not_worse_than_single_weights(spark):
    """The blended optimum is at least the best score of every single weight setting."""
    import __spark_entry__ as E
    from conftest import SF_SMALL
    from pyspark.sql import functions as F
    best = E.queries()["weight_search"](spark, SF_SMALL).first()["f1_weighted"]
    per_weight = (E.queries()["weight_threshold_cross"](spark, SF_SMALL)
                  .groupBy("wi").agg(F.max("f1_weighted").alias("m")).collect())
    assert len(per_weight) == 20
    assert all(best >= r["m"] - 1e-9 for r in per_weight)
    assert any(abs(best - r["m"]) < 1e-9 for r in per_weight)
