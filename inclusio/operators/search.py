"""Threshold / weight search by aggregating once and scoring every grid point.

The reference re-scores the full data for each grid point (n^2 passes, times
20 or 66 weight settings).  Here every row is reduced to two bucket indices
(how many grid points lie at or below each probability), so one map-side
combined ``groupBy(keys, y, b_high, b_med).count()`` over the data yields a
cube of at most ``3 (n+1)^2`` cells per key.  A 2-D prefix sum over that
tiny cube gives the confusion matrix of every threshold pair, which is exact:

    pred = 2  <=>  p_high >= t_high[j2]  <=>  b_high > j2
    pred = 1  <=>  b_high <= j2 and b_med > j1
    pred = 0  <=>  b_high <= j2 and b_med <= j1
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.decide import grid_bucket
from ..session import materialised
from .metrics import scores_from_counts


def grid_cells(df: DataFrame, p_med: Column, p_high: Column, y: str, grid: list[float], keys=(),
               high_override: Column | None = None) -> DataFrame:
    """``(*keys, y, b2, b1, cnt)`` — the only pass over the data.

    ``high_override`` (boolean) pins the High decision for some rows: true ->
    always High, false -> never High, NULL -> use the grid.
    """
    n = len(grid)
    b2 = grid_bucket(p_high, grid)
    if high_override is not None:
        b2 = F.when(high_override.isNull(), b2).when(high_override, F.lit(n)).otherwise(F.lit(0))
    b1 = grid_bucket(p_med, grid)
    return (df.select(*keys, F.col(y).cast("int").alias("y"), b2.alias("b2"), b1.alias("b1"))
            .groupBy(*keys, "y", "b2", "b1").agg(F.count(F.lit(1)).alias("cnt")))


def cube_scores(cells: DataFrame, n: int, keys=()) -> DataFrame:
    """Confusion counts and F1 for every grid point ``(*keys, j2, j1)``.

    Works on the cube only (``|keys| * 3 * (n+1)^2`` rows at most).
    """
    keys = list(keys)
    if keys:
        # the cube is tiny; written so that the key list and the counts come from one pass over the data
        cells = materialised(cells, "cube")
        key_rows = cells.select(*keys).distinct()
    else:
        key_rows = cells.sparkSession.range(1).select()
    dense = (key_rows.select(*keys, F.explode(F.array(*[F.lit(c) for c in range(3)])).alias("y"))
             .select("*", F.explode(F.sequence(F.lit(0), F.lit(n))).alias("b2"))
             .select("*", F.explode(F.sequence(F.lit(0), F.lit(n))).alias("b1")))
    d = dense.join(cells, [*keys, "y", "b2", "b1"], "left").na.fill(0, ["cnt"])
    w1 = Window.partitionBy(*keys, "y", "b2").orderBy("b1").rowsBetween(Window.unboundedPreceding, 0)
    w2 = Window.partitionBy(*keys, "y", "b1").orderBy("b2").rowsBetween(Window.unboundedPreceding, 0)
    s = d.withColumn("c1", F.sum("cnt").over(w1)).withColumn("S", F.sum("c1").over(w2))
    s = (s.withColumn("rowtot", F.max("S").over(Window.partitionBy(*keys, "y", "b2")))
         .withColumn("ny", F.max("S").over(Window.partitionBy(*keys, "y"))))
    pts = s.where((F.col("b2") < n) & (F.col("b1") < n)).select(
        *keys, F.col("b2").alias("j2"), F.col("b1").alias("j1"), "y",
        F.col("S").alias("P0"), (F.col("rowtot") - F.col("S")).alias("P1"),
        (F.col("ny") - F.col("rowtot")).alias("P2"), F.col("ny"))
    aggs = []
    for yv in range(3):
        for c in range(3):
            aggs.append(F.sum(F.when(F.col("y") == yv, F.col(f"P{c}")).otherwise(0)).alias(f"m{yv}{c}"))
    conf = pts.groupBy(*keys, "j2", "j1").agg(*aggs)
    counts = conf.select(
        *keys, "j2", "j1",
        *[F.col(f"m{c}{c}").alias(f"tp{c}") for c in range(3)],
        *[(F.col(f"m{c}0") + F.col(f"m{c}1") + F.col(f"m{c}2")).alias(f"s{c}") for c in range(3)],
        *[(F.col(f"m0{c}") + F.col(f"m1{c}") + F.col(f"m2{c}")).alias(f"p{c}") for c in range(3)])
    sc = scores_from_counts()
    return counts.select("*", sc["f1_weighted"].alias("f1_weighted"), sc["f1_macro"].alias("f1_macro"))


def first_best(scores: DataFrame, metric: str, order: list[str]) -> DataFrame:
    """The first point (in ``order``) with the largest ``metric``, strictly
    positive scores only (the reference starts from score 0 and keeps a point
    only when it is strictly better; no row means it keeps its defaults)."""
    return scores.where(F.col(metric) > 0).orderBy(F.desc(metric), *[F.asc(c) for c in order]).limit(1)


def with_grid_values(df: DataFrame, grid: list[float], pairs: dict[str, str]) -> DataFrame:
    """Map grid indices to threshold values through a literal array."""
    arr = F.array(*[F.lit(float(g)) for g in grid])
    return df.select("*", *[F.element_at(arr, F.col(j) + 1).alias(name) for name, j in pairs.items()])


def simplex_blends(df: DataFrame, y: str, models: list[str], weights: list[tuple]) -> DataFrame:
    """``(y, wi, w0.., pA, pB)``: each row under every weighting of its models' ordinal probabilities
    (columns ``<model>_pA``, ``<model>_pB``); the weightings are exploded per row before any shuffle."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("wi"), *[F.lit(w).alias(f"w{j}") for j, w in enumerate(ws)])
                               for i, ws in enumerate(weights)])).alias("w")
    rows = df.select(F.col(y).alias("y"), *[f"{m}_p{t}" for m in models for t in "AB"], each)
    blend = {t: sum((F.col(f"w.w{j}") * F.col(f"{m}_p{t}") for j, m in enumerate(models[1:], 1)), F.col("w.w0") * F.col(f"{models[0]}_p{t}")) for t in "AB"}
    return rows.select("y", "w.wi", *[f"w.w{j}" for j in range(len(models))], *[e.alias(f"p{t}") for t, e in blend.items()])


def blend_weight_search(df: DataFrame, y: str, a: tuple[str, str], b: tuple[str, str], weights: list[float],
                        grid: list[float]) -> DataFrame:
    """Scores of every (weight, t_high, t_med) for the blend w*a + (1-w)*b.

    ``a``/``b`` name the (p_med, p_high) columns of the two models.  Each row is
    expanded once per weight setting before the map-side combine, so the
    shuffle carries only cube cells.  Columns: ``wi, w, j2, j1, f1_*``.
    """
    wt = F.explode(F.array(*[F.struct(F.lit(i).alias("wi"), F.lit(float(w)).alias("w"),
                                      F.lit(1.0 - float(w)).alias("w2")) for i, w in enumerate(weights)]))
    ex = df.select(F.col(y).alias("y"), *[F.col(c) for c in (*a, *b)], wt.alias("s")).select(
        "y", "s.wi", "s.w",
        (F.col("s.w") * F.col(a[0]) + F.col("s.w2") * F.col(b[0])).alias("__p1"),
        (F.col("s.w") * F.col(a[1]) + F.col("s.w2") * F.col(b[1])).alias("__p2"))
    cells = grid_cells(ex, F.col("__p1"), F.col("__p2"), "y", grid, keys=["wi", "w"])
    return cube_scores(cells, len(grid), keys=["wi", "w"])
