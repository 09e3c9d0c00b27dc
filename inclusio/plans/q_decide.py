"""Queries for blending, decisions, threshold/weight search and metrics
(SURVEY 2.5, 2.7, 2.9 N-rows, 2.10), on the out-of-fold probability table."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config as C
from ..functions import decide as D
from ..functions.encode import decode_target
from ..operators import metrics as M
from ..operators import search as SR
from ..sources import io as IO
from . import synthetic as SY
from .q_prepare import cleaned
from .registry import register

# parameters of the scored table (fixed thresholds for the metric reports)
T_MED, T_HIGH = 0.34, 0.36
W_LGB = 0.5
N_SEARCH = 30


def dl(x: float) -> str:
    """Exact double literal for SQL."""
    return f"CAST('{float(x)!r}' AS DOUBLE)"


def grid_values_sql(grid, name="grid") -> str:
    rows = ", ".join(f"({i}, {dl(g)})" for i, g in enumerate(grid))
    return f"{name} AS (SELECT * FROM (VALUES {rows}) v(j, t))"


# ---------------------------------------------------------------- scored rows
def ens_expr(c: int, w=W_LGB):
    two = D.blend_two(w, f"lgb_p{c}", f"xgb_p{c}")
    return F.lit(1.0 - C.BLEND_CAT_WEIGHT) * two + F.lit(C.BLEND_CAT_WEIGHT) * F.col(f"cat_p{c}")


def ens_sql(c: int, w=W_LGB) -> str:
    return (f"{dl(1.0 - C.BLEND_CAT_WEIGHT)} * ({dl(w)} * lgb_p{c} + {dl(1.0 - w)} * xgb_p{c}) + "
            f"{dl(C.BLEND_CAT_WEIGHT)} * cat_p{c}")


def scored(spark, sf_dir):
    o = SY.oof_table(spark, sf_dir)
    e = o.select(C.ID_COL, "country", "y", *[ens_expr(c).alias(f"p{c}") for c in range(3)])
    return e.withColumn("pred", D.apply_thresholds("p1", "p2", T_MED, T_HIGH))


def scored_cte() -> str:
    return (SY.oof_cte() + ",\nsc0 AS (SELECT ID, fold, country, y, " +
            ", ".join(f"{ens_sql(c)} AS p{c}" for c in range(3)) + " FROM oof),\n" +
            f"sc AS (SELECT *, CAST(CASE WHEN p2 >= {dl(T_HIGH)} THEN 2 WHEN p1 >= {dl(T_MED)} THEN 1 ELSE 0 END "
            "AS BIGINT) AS pred FROM sc0)")


def f1_sql(prefix: str = "") -> tuple[str, str]:
    """(weighted, macro) F1 from columns tp0..2, s0..2, p0..2 — same formula as Spark."""
    f = [f"CASE WHEN {prefix}s{c} + {prefix}p{c} > 0 THEN 2 * {prefix}tp{c} / ({prefix}s{c} + {prefix}p{c}) "
         f"ELSE 0e0 END" for c in range(3)]
    n = f"({prefix}s0 + {prefix}s1 + {prefix}s2)"
    wsum = " + ".join(f"{prefix}s{c} * ({f[c]})" for c in range(3))
    pres = [f"CAST({prefix}s{c} + {prefix}p{c} > 0 AS INTEGER)" for c in range(3)]
    fsum = " + ".join(f"CASE WHEN {pres[c]} = 1 THEN {f[c]} ELSE 0e0 END" for c in range(3))
    npres = " + ".join(pres)
    return (f"CASE WHEN {n} > 0 THEN ({wsum}) / {n} ELSE 0e0 END",
            f"CASE WHEN {npres} > 0 THEN ({fsum}) / ({npres}) ELSE 0e0 END")


def counts_sql(y="y", pred="pred") -> str:
    parts = ["count(*) AS n"]
    for c in range(3):
        parts += [f"count_if({y} = {c} AND {pred} = {c}) AS tp{c}", f"count_if({y} = {c}) AS s{c}",
                  f"count_if({pred} = {c}) AS p{c}"]
    return ", ".join(parts)


# ----------------------------------------------------------------- tables
@register("synthetic_probs", sql=lambda: SY.oof_cte() + "\nSELECT * FROM oof_long")
def q_synth(spark, sf_dir):
    from .q_prepare import cleaned as cl
    return SY.long_probs(SY.with_folds(SY.train_rows(cl(spark, sf_dir))))


@register("keyed_align", sql=lambda: SY.oof_cte() + """
SELECT o.ID, o.fold, o.y, c.country, c.has_credit_card FROM oof o JOIN clean c ON o.ID = c.ID""")
def q_keyed_align(spark, sf_dir):
    o = SY.oof_table(spark, sf_dir, folds=True).select("ID", "fold", "y")
    c = cleaned(spark, sf_dir).select("ID", "country", "has_credit_card")
    return o.join(c, "ID", "inner")


#: Buckets of the aligned tables here (some 256 MB a bucket at scale).
BUCKETS = 8


@register("bucketed_align", sql=lambda: SY.oof_cte() + """
SELECT o.ID, o.fold, o.y, c.country, c.has_credit_card FROM oof o JOIN clean c ON o.ID = c.ID""")
def q_bucketed_align(spark, sf_dir):
    """The same alignment of two tables that are laid out by ID: the join shuffles neither side."""
    o = IO.bucketed_table(SY.oof_table(spark, sf_dir, folds=True).select("ID", "fold", "y"), "ID", BUCKETS, "oof")
    c = IO.bucketed_table(cleaned(spark, sf_dir).select("ID", "country", "has_credit_card"), "ID", BUCKETS, "answers")
    return o.join(c.hint("merge"), "ID", "inner")


# ---------------------------------------------------------------- blends
@register("blend_two", sql=lambda: SY.oof_cte() + "\nSELECT ID, " + ", ".join(
    f"{dl(0.6)} * lgb_p{c} + {dl(1.0 - 0.6)} * xgb_p{c} AS p{c}" for c in range(3)) + " FROM oof")
def q_blend_two(spark, sf_dir):
    o = SY.oof_table(spark, sf_dir)
    return o.select("ID", *[D.blend_two(0.6, f"lgb_p{c}", f"xgb_p{c}").alias(f"p{c}") for c in range(3)])


@register("blend_three_fixed", sql=lambda: SY.oof_cte() + "\nSELECT ID, " + ", ".join(
    f"{ens_sql(c)} AS p{c}" for c in range(3)) + " FROM oof")
def q_blend_three(spark, sf_dir):
    o = SY.oof_table(spark, sf_dir)
    return o.select("ID", *[ens_expr(c).alias(f"p{c}") for c in range(3)])


ORD_W = (0.5, 0.3, 0.2)


@register("blend_ordinal", sql=lambda: SY.oof_cte() + "\nSELECT ID, " + ", ".join(
    f"{dl(ORD_W[0])} * lgb_p{t} + {dl(ORD_W[1])} * xgb_p{t} + {dl(ORD_W[2])} * cat_p{t} AS p_{t}"
    for t in ("A", "B")) + " FROM oof")
def q_blend_ordinal(spark, sf_dir):
    o = SY.oof_table(spark, sf_dir)
    return o.select("ID", *[D.blend(ORD_W, [f"{m}_p{t}" for m in SY.MODELS]).alias(f"p_{t}") for t in ("A", "B")])


# ---------------------------------------------------------------- decisions
@register("apply_thresholds", sql=lambda: scored_cte() + "\nSELECT ID, pred FROM sc")
def q_apply(spark, sf_dir):
    return scored(spark, sf_dir).select("ID", "pred")


GROUP_T = {0: (0.30, 0.95), 1: (0.35, 0.40), 3: (0.33, 0.34)}
DEFAULT_T = (0.35, 0.40)


@register("apply_thresholds_by_group", sql=lambda: scored_cte() + ",\nthr AS (SELECT * FROM (VALUES " +
          ", ".join(f"({g}e0, {dl(t[0])}, {dl(t[1])})" for g, t in GROUP_T.items()) +
          ") v(country, t1, t2))\nSELECT sc.ID, CAST(CASE WHEN p2 >= COALESCE(thr.t2, " + dl(DEFAULT_T[1]) +
          ") THEN 2 WHEN p1 >= COALESCE(thr.t1, " + dl(DEFAULT_T[0]) +
          ") THEN 1 ELSE 0 END AS BIGINT) AS pred FROM sc LEFT JOIN thr ON sc.country = thr.country")
def q_apply_group(spark, sf_dir):
    s = scored(spark, sf_dir)
    thr = s.sparkSession.createDataFrame([(float(g), t[0], t[1]) for g, t in GROUP_T.items()],
                                         "country double, t1 double, t2 double")
    j = s.join(F.broadcast(thr), "country", "left")
    return j.select("ID", D.apply_thresholds("p1", "p2", F.coalesce("t1", F.lit(DEFAULT_T[0])),
                                             F.coalesce("t2", F.lit(DEFAULT_T[1]))).alias("pred"))


@register("ordinal_decision", sql=lambda: SY.oof_cte() + f"""
SELECT ID, CAST(CASE WHEN lgb_pB >= {dl(0.3)} THEN 2 WHEN lgb_pA >= {dl(0.6)} THEN 1 ELSE 0 END AS BIGINT) AS pred
FROM oof""")
def q_ordinal(spark, sf_dir):
    o = SY.oof_table(spark, sf_dir)
    return o.select("ID", D.ordinal_decision("lgb_pA", "lgb_pB", 0.6, 0.3).alias("pred"))


@register("argmax_class", sql=lambda: SY.oof_cte() + """
SELECT ID, CAST(CASE WHEN lgb_p0 >= lgb_p1 AND lgb_p0 >= lgb_p2 THEN 0 WHEN lgb_p1 >= lgb_p2 THEN 1 ELSE 2 END
AS BIGINT) AS pred FROM oof""")
def q_argmax(spark, sf_dir):
    o = SY.oof_table(spark, sf_dir)
    return o.select("ID", D.argmax_class("lgb_p0", "lgb_p1", "lgb_p2").alias("pred"))


# ---------------------------------------------------------------- searches
def _search(df, p1, p2, grid, keys=(), override=None):
    cells = SR.grid_cells(df, p1, p2, "y", grid, keys, override)
    return SR.cube_scores(cells, len(grid), keys)


def _brute_sql(src: str, p1: str, p2: str, grid, metric: str, order: str, extra_keys: str = "",
               rule: str | None = None) -> str:
    """Brute force: every grid point x every row (DuckDB only)."""
    wf, mf = f1_sql()
    rule = rule or f"CASE WHEN {p2} >= g2.t THEN 2 WHEN {p1} >= g1.t THEN 1 ELSE 0 END"
    return (f",\n{grid_values_sql(grid)},\n"
            f"preds AS (SELECT {extra_keys} g2.j AS j2, g1.j AS j1, g2.t AS t_high, g1.t AS t_med, y, {rule} AS pred "
            f"FROM {src} CROSS JOIN grid g2 CROSS JOIN grid g1),\n"
            f"cnt AS (SELECT {extra_keys} j2, j1, t_high, t_med, {counts_sql()} FROM preds "
            f"GROUP BY {extra_keys} j2, j1, t_high, t_med),\n"
            f"scores AS (SELECT *, {wf} AS f1_weighted, {mf} AS f1_macro FROM cnt)\n"
            f"SELECT {extra_keys} t_med, t_high, {metric} FROM scores WHERE {metric} > 0 "
            f"ORDER BY {metric} DESC, {order} LIMIT 1")


def _best(scores, grid, metric, order, keep=()):
    best = SR.first_best(scores, metric, order)
    best = SR.with_grid_values(best, grid, {"t_med": "j1", "t_high": "j2"})
    return best.select(*keep, "t_med", "t_high", metric)


@register("threshold_search", sql=lambda: scored_cte() + _brute_sql("sc", "p1", "p2", C.threshold_grid(50),
                                                                    "f1_weighted", "j2, j1"), bench=True)
def q_threshold_search(spark, sf_dir):
    """n=50 grid, weighted F1, t_high outer / t_med inner, first best."""
    grid = C.threshold_grid(50)
    sc = _search(scored(spark, sf_dir), F.col("p1"), F.col("p2"), grid)
    return _best(sc, grid, "f1_weighted", ["j2", "j1"])


@register("threshold_search_macro", sql=lambda: scored_cte() + _brute_sql("sc", "p1", "p2", C.threshold_grid(30),
                                                                          "f1_macro", "j2, j1"))
def q_threshold_search_macro(spark, sf_dir):
    grid = C.threshold_grid(N_SEARCH)
    sc = _search(scored(spark, sf_dir), F.col("p1"), F.col("p2"), grid)
    return _best(sc, grid, "f1_macro", ["j2", "j1"])


WEIGHTS = C.linspace(0.3, 0.8, 20)


def _weights_sql() -> str:
    return ("wts AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {dl(w)}, {dl(1.0 - w)})"
                                                         for i, w in enumerate(WEIGHTS)) + ") v(wi, w_lgb, w_xgb))")


@register("weight_search", sql=lambda: SY.oof_cte() + ",\n" + _weights_sql() + ",\n" +
          "bl AS (SELECT wi, w_lgb, y, w_lgb * lgb_p1 + w_xgb * xgb_p1 AS p1, w_lgb * lgb_p2 + w_xgb * xgb_p2 AS p2 "
          "FROM oof CROSS JOIN wts)" + _brute_sql("bl", "p1", "p2", C.threshold_grid(30), "f1_weighted",
                                                  "wi, j2, j1", extra_keys="wi, w_lgb,"), bench=True)
def q_weight_search(spark, sf_dir):
    """20 blend weights x 30^2 thresholds from one aggregate over the rows."""
    grid = C.threshold_grid(N_SEARCH)
    o = SY.oof_table(spark, sf_dir)
    sc = SR.blend_weight_search(o, "y", ("lgb_p1", "lgb_p2"), ("xgb_p1", "xgb_p2"), WEIGHTS, grid)
    sc = sc.withColumnRenamed("w", "w_lgb")
    return _best(sc, grid, "f1_weighted", ["wi", "j2", "j1"], keep=["wi", "w_lgb"])


SIMPLEX = C.simplex_weights(0.1)


@register("simplex_search", sql=lambda: SY.oof_cte() + ",\nwts AS (SELECT * FROM (VALUES " + ", ".join(
    f"({i}, {dl(a)}, {dl(b)}, {dl(c)})" for i, (a, b, c) in enumerate(SIMPLEX)) + ") v(wi, wl, wx, wc)),\n" +
    "bl AS (SELECT wi, wl, wx, wc, y, wl * lgb_pA + wx * xgb_pA + wc * cat_pA AS pA, "
    "wl * lgb_pB + wx * xgb_pB + wc * cat_pB AS pB FROM oof CROSS JOIN wts)" +
    _brute_sql("bl", "pA", "pB", C.threshold_grid(30), "f1_weighted", "wi, j1, j2", extra_keys="wi, wl, wx, wc,"))
def q_simplex(spark, sf_dir):
    """66 weight triples x 30^2 ordinal thresholds; tA outer, tB inner."""
    grid = C.threshold_grid(N_SEARCH)
    o = SY.oof_table(spark, sf_dir)
    bl = SR.simplex_blends(o, "y", SY.MODELS, SIMPLEX).withColumnsRenamed({"w0": "wl", "w1": "wx", "w2": "wc"})
    sc = _search(bl, F.col("pA"), F.col("pB"), grid, keys=["wi", "wl", "wx", "wc"])
    return _best(sc, grid, "f1_weighted", ["wi", "j1", "j2"], keep=["wi", "wl", "wx", "wc"])


def _group_rule(pin: float) -> str:
    return (f"CASE WHEN country = 0 THEN (CASE WHEN p2 >= {dl(pin)} THEN 2 WHEN p1 >= g1.t THEN 1 ELSE 0 END) "
            "ELSE (CASE WHEN p2 >= g2.t THEN 2 WHEN p1 >= g1.t THEN 1 ELSE 0 END) END")


def _group_scores(s, grid):
    pinned = F.when(F.col("country") == C.COUNTRY_LESOTHO, F.col("p2") >= C.LESOTHO_HIGH_PIN)
    return _search(s, F.col("p1"), F.col("p2"), grid, override=pinned)


@register("group_threshold_search", sql=lambda: scored_cte() + _brute_sql(
    "sc", "p1", "p2", C.threshold_grid(30), "f1_weighted", "j2, j1", rule=_group_rule(C.LESOTHO_HIGH_PIN)))
def q_group_search(spark, sf_dir):
    """Shared t_med/t_high with the Lesotho High threshold pinned at .95."""
    grid = C.threshold_grid(N_SEARCH)
    s = scored(spark, sf_dir).select("y", "country", "p1", "p2")
    return _best(_group_scores(s, grid), grid, "f1_weighted", ["j2", "j1"])


@register("keep_if_better", sql=lambda: scored_cte() + ",\n" + grid_values_sql(C.threshold_grid(30)) + """,
g AS (SELECT g2.j AS j2, g1.j AS j1, g2.t AS t_high, g1.t AS t_med FROM grid g2 CROSS JOIN grid g1),
pr AS (SELECT j2, j1, y, CASE WHEN p2 >= t_high THEN 2 WHEN p1 >= t_med THEN 1 ELSE 0 END AS pg,
  CASE WHEN country = 0 THEN (CASE WHEN p2 >= """ + dl(C.LESOTHO_HIGH_PIN) + """ THEN 2 WHEN p1 >= t_med THEN 1 ELSE 0 END)
       ELSE (CASE WHEN p2 >= t_high THEN 2 WHEN p1 >= t_med THEN 1 ELSE 0 END) END AS pc FROM sc CROSS JOIN g),
cg AS (SELECT j2, j1, """ + counts_sql("y", "pg") + """ FROM pr GROUP BY j2, j1),
cc AS (SELECT j2, j1, """ + counts_sql("y", "pc") + """ FROM pr GROUP BY j2, j1),
bg AS (SELECT max(""" + f1_sql()[0] + """) AS baseline_f1 FROM cg),
bc AS (SELECT max(""" + f1_sql()[0] + """) AS group_f1 FROM cc)
SELECT round(baseline_f1, 9) AS baseline_f1, round(group_f1, 9) AS group_f1,
       round(group_f1 - baseline_f1, 9) AS improvement,
       CAST(group_f1 > baseline_f1 AS BIGINT) AS use_group_thresholds FROM bg, bc""")
def q_keep_if_better(spark, sf_dir):
    """Replace the global thresholds only if the group search is strictly better."""
    grid = C.threshold_grid(N_SEARCH)
    s = scored(spark, sf_dir).select("y", "country", "p1", "p2")
    base = _search(s, F.col("p1"), F.col("p2"), grid).agg(F.max("f1_weighted").alias("baseline_f1"))
    grp = _group_scores(s, grid).agg(F.max("f1_weighted").alias("group_f1"))
    both = base.unionByName(grp, allowMissingColumns=True).agg(
        F.max("baseline_f1").alias("baseline_f1"), F.max("group_f1").alias("group_f1"))
    return both.select(F.round("baseline_f1", 9).alias("baseline_f1"), F.round("group_f1", 9).alias("group_f1"),
                       F.round(F.col("group_f1") - F.col("baseline_f1"), 9).alias("improvement"),
                       (F.col("group_f1") > F.col("baseline_f1")).cast("bigint").alias("use_group_thresholds"))


# ---------------------------------------------------------------- metrics
@register("f1_weighted", sql=lambda: scored_cte() + f",\nc AS (SELECT {counts_sql()} FROM sc)\n"
          f"SELECT n, round({f1_sql()[0]}, 9) AS f1_weighted FROM c")
def q_f1w(spark, sf_dir):
    return M.f1_scores(scored(spark, sf_dir)).select("n", F.round("f1_weighted", 9).alias("f1_weighted"))


@register("f1_macro", sql=lambda: scored_cte() + f",\nc AS (SELECT {counts_sql()} FROM sc)\n"
          f"SELECT n, round({f1_sql()[1]}, 9) AS f1_macro FROM c")
def q_f1m(spark, sf_dir):
    return M.f1_scores(scored(spark, sf_dir)).select("n", F.round("f1_macro", 9).alias("f1_macro"))


@register("classification_report", sql=lambda: scored_cte() + f""",
c AS (SELECT {counts_sql()} FROM sc),
per AS (""" + " UNION ALL ".join(
    f"SELECT '{C.TARGET_LABELS[k]}' AS label, CASE WHEN p{k} > 0 THEN tp{k} / p{k} ELSE 0e0 END AS precision, "
    f"CASE WHEN s{k} > 0 THEN tp{k} / s{k} ELSE 0e0 END AS recall, "
    f"CASE WHEN s{k} + p{k} > 0 THEN 2 * tp{k} / (s{k} + p{k}) ELSE 0e0 END AS f1, CAST(s{k} AS BIGINT) AS support FROM c"
    for k in range(3)) + """),
allrows AS (SELECT * FROM per
  UNION ALL SELECT 'accuracy', NULL, NULL, (tp0 + tp1 + tp2) / n, CAST(n AS BIGINT) FROM c
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM per
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
     sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM per)
SELECT label, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM allrows""")
def q_report(spark, sf_dir):
    r = M.classification_report(scored(spark, sf_dir))
    return r.select("label", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], "support")


@register("confusion_matrix", sql=lambda: scored_cte() + """,
dom AS (SELECT CAST(y AS BIGINT) AS y FROM (VALUES (0), (1), (2)) v(y))
SELECT dom.y, """ + ", ".join(f"CAST(count_if(sc.pred = {c}) AS BIGINT) AS pred_{c}" for c in range(3)) +
          " FROM dom LEFT JOIN sc ON dom.y = sc.y GROUP BY dom.y")
def q_confusion(spark, sf_dir):
    return M.confusion_matrix(scored(spark, sf_dir))


@register("missed_class_report", sql=lambda: scored_cte() + """
SELECT count_if(y = 2) AS n_true, count_if(y = 2 AND pred = 2) AS n_correct,
       count_if(y = 2 AND pred = 0) AS missed_as_low, count_if(y = 2 AND pred = 1) AS missed_as_medium FROM sc""")
def q_missed(spark, sf_dir):
    return M.missed_class_report(scored(spark, sf_dir))


@register("class_probability_stats", sql=lambda: scored_cte() + f"""
SELECT round(avg(CASE WHEN y = 2 THEN p2 END), 9) AS mean_p, round(median(CASE WHEN y = 2 THEN p2 END), 9) AS median_p,
  round(min(CASE WHEN y = 2 THEN p2 END), 9) AS min_p, round(max(CASE WHEN y = 2 THEN p2 END), 9) AS max_p,
  round(avg(CASE WHEN y = 2 THEN CAST(p2 >= {dl(T_HIGH)} AS DOUBLE) END), 9) AS share_above,
  round(avg(CASE WHEN y = 2 AND pred <> 2 THEN p2 END), 9) AS missed_mean_p,
  round(max(CASE WHEN y = 2 AND pred <> 2 THEN p2 END), 9) AS missed_max_p,
  round(avg(CASE WHEN y = 2 AND pred <> 2 THEN CAST(p2 >= {dl(0.3)} AND p2 < {dl(T_HIGH)} AS DOUBLE) END), 9)
    AS missed_share_band
FROM sc""")
def q_prob_stats(spark, sf_dir):
    r = M.class_probability_stats(scored(spark, sf_dir), "p2", T_HIGH)
    return r.select(*[F.round(c, 9).alias(c) for c in r.columns])


@register("false_positive_report", sql=lambda: scored_cte() + """
SELECT count_if(pred = 2 AND y <> 2) AS n_false, count_if(pred = 2 AND y = 0) AS actual_low,
       count_if(pred = 2 AND y = 1) AS actual_medium FROM sc""")
def q_fp(spark, sf_dir):
    return M.false_positive_report(scored(spark, sf_dir))


def _group_sql(cols: str) -> str:
    wf, mf = f1_sql()
    return (scored_cte() + f",\nc AS (SELECT country, {counts_sql()} FROM sc WHERE country IS NOT NULL "
            f"GROUP BY country),\ng AS (SELECT country, n, s0 AS n_low, s1 AS n_medium, s2 AS n_high, "
            f"p2 AS pred_high, {wf} AS f1_weighted, {mf} AS f1_macro FROM c)\nSELECT {cols} FROM g")


@register("per_group_macro_f1", sql=lambda: _group_sql(
    "country, n, n_low, n_medium, n_high, round(f1_macro, 9) AS f1_macro"))
def q_group_macro(spark, sf_dir):
    g = M.per_group_scores(scored(spark, sf_dir), "country")
    return g.select("country", "n", "n_low", "n_medium", "n_high", F.round("f1_macro", 9).alias("f1_macro"))


@register("per_group_weighted_f1", sql=lambda: _group_sql(
    "country, n, round(f1_weighted, 9) AS f1_weighted, n_high, pred_high"))
def q_group_weighted(spark, sf_dir):
    g = M.per_group_scores(scored(spark, sf_dir), "country")
    return g.select("country", "n", F.round("f1_weighted", 9).alias("f1_weighted"), "n_high", "pred_high")


@register("boundary_confusion", sql=lambda: scored_cte() + """
SELECT count_if(y = 1 AND pred = 0) AS medium_as_low,
       round(count_if(y = 1 AND pred = 0) / count_if(y = 1), 9) AS medium_as_low_rate,
       count_if(y = 0 AND pred = 1) AS low_as_medium,
       round(count_if(y = 0 AND pred = 1) / count_if(y = 0), 9) AS low_as_medium_rate FROM sc""")
def q_boundary(spark, sf_dir):
    r = M.boundary_confusion(scored(spark, sf_dir))
    return r.select("medium_as_low", F.round("medium_as_low_rate", 9).alias("medium_as_low_rate"),
                    "low_as_medium", F.round("low_as_medium_rate", 9).alias("low_as_medium_rate"))


@register("probability_ranges", sql=lambda: scored_cte() + """,
l AS (SELECT y, 0 AS prob_class, p0 AS p FROM sc UNION ALL SELECT y, 1, p1 FROM sc UNION ALL SELECT y, 2, p2 FROM sc)
SELECT y, CAST(prob_class AS BIGINT) AS prob_class, round(avg(p), 9) AS mean_p, round(median(p), 9) AS median_p,
       round(max(p), 9) AS max_p FROM l GROUP BY y, prob_class""")
def q_prob_ranges(spark, sf_dir):
    r = M.probability_ranges(scored(spark, sf_dir), ["p0", "p1", "p2"])
    return r.select("y", "prob_class", *[F.round(c, 9).alias(c) for c in ("mean_p", "median_p", "max_p")])


@register("model_leaderboard", sql=lambda: SY.oof_cte() + f""",
a AS (SELECT m, y, CASE WHEN p_low >= p_med AND p_low >= p_high THEN 0 WHEN p_med >= p_high THEN 1 ELSE 2 END AS pred
      FROM oof_long),
c AS (SELECT m, {counts_sql()} FROM a GROUP BY m)
SELECT m, n, round({f1_sql()[0]}, 9) AS f1_weighted FROM c""")
def q_leaderboard(spark, sf_dir):
    from .q_prepare import cleaned as cl
    lp = SY.long_probs(SY.train_rows(cl(spark, sf_dir)))
    a = lp.withColumn("pred", D.argmax_class("p_low", "p_med", "p_high"))
    return M.f1_scores(a, keys=["m"]).select("m", "n", F.round("f1_weighted", 9).alias("f1_weighted"))


@register("fold_metrics", sql=lambda: SY.oof_cte() + f""",
a AS (SELECT fold, m, y, CASE WHEN p_low >= p_med AND p_low >= p_high THEN 0 WHEN p_med >= p_high THEN 1 ELSE 2 END
      AS pred FROM oof_long),
c AS (SELECT fold, m, {counts_sql()} FROM a GROUP BY fold, m)
SELECT fold, m, n, round({f1_sql()[0]}, 9) AS f1_weighted, s2 AS n_high_true, p2 AS n_high_pred FROM c""")
def q_fold_metrics(spark, sf_dir):
    from .q_prepare import cleaned as cl
    lp = SY.long_probs(SY.with_folds(SY.train_rows(cl(spark, sf_dir))))
    a = lp.withColumn("pred", D.argmax_class("p_low", "p_med", "p_high"))
    counts = a.groupBy("fold", "m").agg(*M.class_count_aggs("y", "pred"))
    sc = M.scores_from_counts()
    return counts.select("fold", "m", "n", F.round(sc["f1_weighted"], 9).alias("f1_weighted"),
                         F.col("s2").alias("n_high_true"), F.col("p2").alias("n_high_pred"))


@register("predicted_rate_by_group", sql=lambda: scored_cte() + """
SELECT country, count(*) AS n, count_if(pred = 2) AS n_pred, round(count_if(pred = 2) / count(*), 9) AS pred_rate
FROM sc WHERE country IS NOT NULL GROUP BY country""")
def q_pred_rate(spark, sf_dir):
    r = M.predicted_rate_by_group(scored(spark, sf_dir), "country")
    return r.select("country", "n", "n_pred", F.round("pred_rate", 9).alias("pred_rate"))


# ------------------------------------------------ fold-averaged test scoring
def _test_fold_avg(spark, sf_dir):
    """Test rows scored by the k fold models (model f = recipe m=f), averaged in one projection."""
    t = cleaned(spark, sf_dir).where(F.col("split") == "test").select("ID", SY.key_of().alias("k"), "country")
    per = [SY.prob_exprs(f) for f in range(C.N_FOLDS)]
    avg = []
    for c in range(3):
        s = per[0][c]
        for f in range(1, C.N_FOLDS):
            s = s + per[f][c]
        avg.append((s / C.N_FOLDS).alias(f"p{c}"))
    return t.select("ID", "country", *avg)


def _test_fold_avg_sql() -> str:
    from . import sql_text as S
    parts = []
    for c in range(3):
        terms = [SY._prob_sql(f)[c] for f in range(C.N_FOLDS)]
        s = terms[0]
        for x in terms[1:]:
            s = f"({s}) + ({x})"
        parts.append(f"({s}) / {C.N_FOLDS} AS p{c}")
    return (S.clean_cte() + ",\nte AS (SELECT ID, CAST(substr(ID, 4) AS BIGINT) AS k, country FROM clean "
            "WHERE split = 'test'),\nfa AS (SELECT ID, country, " + ", ".join(parts) + " FROM te)")


@register("fold_average_scoring", sql=lambda: _test_fold_avg_sql() +
          "\nSELECT ID, round(p0, 9) AS p0, round(p1, 9) AS p1, round(p2, 9) AS p2 FROM fa")
def q_fold_avg(spark, sf_dir):
    r = _test_fold_avg(spark, sf_dir)
    return r.select("ID", *[F.round(f"p{c}", 9).alias(f"p{c}") for c in range(3)])


@register("submission", sql=lambda: _test_fold_avg_sql() + f"""
SELECT ID, CASE WHEN p2 >= {dl(T_HIGH)} THEN 'High' WHEN p1 >= {dl(T_MED)} THEN 'Medium' ELSE 'Low' END AS Target
FROM fa""")
def q_submission(spark, sf_dir):
    r = _test_fold_avg(spark, sf_dir)
    return r.select("ID", decode_target(D.apply_thresholds("p1", "p2", T_MED, T_HIGH)).alias("Target"))


@register("validate_submission", sql=lambda: _test_fold_avg_sql() + f""",
sub AS (SELECT ID, CASE WHEN p2 >= {dl(T_HIGH)} THEN 'High' WHEN p1 >= {dl(T_MED)} THEN 'Medium' ELSE 'Low' END
        AS Target FROM fa),
sample AS (SELECT ID FROM clean WHERE split = 'test')
SELECT (SELECT count(*) FROM sub) AS n_rows, (SELECT count(*) FROM sample) AS n_expected,
  (SELECT count(*) FROM sub WHERE Target IS NULL OR Target NOT IN ('Low', 'Medium', 'High')) AS bad_labels,
  (SELECT count(*) FROM sample WHERE ID NOT IN (SELECT ID FROM sub)) AS missing_ids,
  (SELECT count(*) FROM sub WHERE ID NOT IN (SELECT ID FROM sample)) AS extra_ids, CAST(1 AS BIGINT) AS columns_ok""")
def q_validate(spark, sf_dir):
    from ..sources.io import validate_submission
    sub = q_submission(spark, sf_dir)
    sample = cleaned(spark, sf_dir).where(F.col("split") == "test").select("ID")
    return validate_submission(sub, sample)


@register("weight_threshold_cross", sql=lambda: SY.oof_cte() + ",\n" + _weights_sql() + ",\n" +
          grid_values_sql(C.threshold_grid(30)) + """,
bl AS (SELECT wi, w_lgb, y, w_lgb * lgb_p1 + w_xgb * xgb_p1 AS p1, w_lgb * lgb_p2 + w_xgb * xgb_p2 AS p2
       FROM oof CROSS JOIN wts),
preds AS (SELECT wi, w_lgb, g2.t AS t_high, g1.t AS t_med, y,
          CASE WHEN p2 >= g2.t THEN 2 WHEN p1 >= g1.t THEN 1 ELSE 0 END AS pred
          FROM bl CROSS JOIN grid g2 CROSS JOIN grid g1),
cnt AS (SELECT wi, w_lgb, t_high, t_med, """ + counts_sql() + """ FROM preds GROUP BY wi, w_lgb, t_high, t_med)
SELECT wi, w_lgb, t_med, t_high, round(""" + f1_sql()[0] + """, 9) AS f1_weighted FROM cnt""")
def q_weight_threshold_cross(spark, sf_dir):
    """Every (weight, t_med, t_high) point scored: 20 x 30 x 30 from one aggregate over the rows;
    the grid meets the small per-weight cube, never the data."""
    grid = C.threshold_grid(N_SEARCH)
    o = SY.oof_table(spark, sf_dir)
    sc = SR.blend_weight_search(o, "y", ("lgb_p1", "lgb_p2"), ("xgb_p1", "xgb_p2"), WEIGHTS, grid)
    sc = SR.with_grid_values(sc.withColumnRenamed("w", "w_lgb"), grid, {"t_med": "j1", "t_high": "j2"})
    return sc.select("wi", "w_lgb", "t_med", "t_high", F.round("f1_weighted", 9).alias("f1_weighted"))
