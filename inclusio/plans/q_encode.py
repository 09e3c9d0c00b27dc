"""Label preparation, folds and target-encoding keys."""

from __future__ import annotations

import contextlib

from pyspark.sql import functions as F

from .. import config as C
from ..operators import folds as FO
from ..operators import target_encoding as TE
from ..sources import io as IO
from ..sources import versions as VE
from . import synthetic as SY
from .q_prepare import cleaned
from .registry import register

TE_COLS = C.TARGET_ENCODE_COLS
OUT_TE = [f"{c}_te_{k}" for c in TE_COLS for k in range(3)]


def train_clean(spark, sf_dir):
    return cleaned(spark, sf_dir).where(F.col("split") == "train")


def _r9(cols):
    return [F.round(c, 9).alias(c) for c in cols]


# ------------------------------------------------------------------ weights
@register("class_weights", sql=lambda: SY.oof_cte() + """
SELECT y AS Target, count(*) AS n, round((SELECT count(*) FROM tr) / (3 * count(*)), 9) AS weight FROM tr GROUP BY y""")
def q_class_weights(spark, sf_dir):
    r = FO.class_weights(train_clean(spark, sf_dir))
    return r.select(C.TARGET_COL, "n", F.round("weight", 9).alias("weight"))


@register("sample_weights", sql=lambda: SY.oof_cte() + """,
w AS (SELECT y, (SELECT count(*) FROM tr) / (3 * count(*)) AS weight FROM tr GROUP BY y)
SELECT tr.ID, round(w.weight, 9) AS weight FROM tr JOIN w ON tr.y = w.y""")
def q_sample_weights(spark, sf_dir):
    r = FO.sample_weights(train_clean(spark, sf_dir))
    return r.select("ID", F.round("weight", 9).alias("weight"))


# ------------------------------------------------------------------ folds
@register("stratified_folds", sql=lambda: SY.oof_cte() + "\nSELECT ID, y, fold FROM fo", bench=True)
def q_folds(spark, sf_dir):
    return SY.with_folds(SY.train_rows(cleaned(spark, sf_dir))).select("ID", "y", "fold")


def _joint_stratum_sql() -> str:
    return "coalesce(CAST(country AS VARCHAR), 'nan') || '_' || CAST(y AS VARCHAR)"


@register("joint_stratified_folds", sql=lambda: SY.oof_cte() + f""",
js AS (SELECT ID, k, {_joint_stratum_sql()} AS stratum FROM tr),
joffs AS (SELECT stratum, sum(n) OVER (ORDER BY stratum) - n AS off FROM
          (SELECT stratum, count(*) AS n FROM js GROUP BY stratum) c)
SELECT js.ID, js.stratum, CAST((joffs.off + row_number() OVER (PARTITION BY js.stratum
       ORDER BY (js.k * {SY.ORDER_MUL}) % {SY.ORDER_MOD}, js.k) - 1) % 5 AS BIGINT) AS fold
FROM js JOIN joffs ON js.stratum = joffs.stratum""")
def q_joint_folds(spark, sf_dir):
    rows = SY.train_rows(cleaned(spark, sf_dir))
    rows = rows.select("ID", "k", FO.joint_stratum("country", "y").alias("stratum"),
                       ((F.col("k") * SY.ORDER_MUL) % SY.ORDER_MOD).alias("_ord"))
    return FO.stratified_folds(rows, "stratum", ["_ord", "k"]).select("ID", "stratum", "fold")


@register("stratified_split", sql=lambda: SY.oof_cte() + f""",
js AS (SELECT ID, k, {_joint_stratum_sql()} AS stratum FROM tr)
SELECT ID, CAST(row_number() OVER (PARTITION BY stratum ORDER BY (k * {SY.ORDER_MUL}) % {SY.ORDER_MOD}, k) - 1
       < 0.2e0 * count(*) OVER (PARTITION BY stratum) AS BIGINT) AS is_holdout FROM js""")
def q_split(spark, sf_dir):
    rows = SY.train_rows(cleaned(spark, sf_dir))
    rows = rows.select("ID", "k", FO.joint_stratum("country", "y").alias("stratum"),
                       ((F.col("k") * SY.ORDER_MUL) % SY.ORDER_MOD).alias("_ord"))
    return FO.stratified_split(rows, "stratum", ["_ord", "k"], 0.2).select("ID", "is_holdout")


@register("ordinal_targets", sql=lambda: SY.oof_cte() + """
SELECT ID, CAST(y >= 1 AS BIGINT) AS y_A, CAST(y = 2 AS BIGINT) AS y_B FROM tr""")
def q_ordinal_targets(spark, sf_dir):
    return FO.ordinal_targets(SY.train_rows(cleaned(spark, sf_dir)), "y").select("ID", "y_A", "y_B")


# ------------------------------------------------------------ target encoding
def _fit_sql(src: str = "tcl", folded: bool = False, cols=TE_COLS, label: str = "Target",
             n_folds: int = C.N_FOLDS) -> str:
    """CTEs: ``te_l`` long, ``te_v`` value stats, ``te_g`` globals, ``te_enc`` encodings."""
    fsel = "fold, " if folded else ""
    long = " UNION ALL ".join(f"SELECT {fsel}'{c}' AS column_name, CAST({c} AS DOUBLE) AS value, {label} AS Target "
                              f"FROM {src}" for c in cols)
    hits = ", ".join(f"count_if(Target = {k}) AS h{k}" for k in range(3))
    hits_src = ", ".join(f"count_if({label} = {k}) AS h{k}" for k in range(3))
    if not folded:
        return (f"te_l AS ({long}),\n"
                f"te_v AS (SELECT column_name, value, count(*) AS n, {hits} FROM te_l WHERE value IS NOT NULL "
                "GROUP BY column_name, value),\n"
                f"te_g AS (SELECT {', '.join(f'h{k} / n AS g{k}' for k in range(3))} FROM "
                f"(SELECT count(*) AS n, {hits_src} FROM {src}) t),\n"
                "te_enc AS (SELECT column_name, value, n, " + ", ".join(
                    f"(n * (h{k} / n) + 10e0 * g{k}) / (n + 10e0) AS enc_{k}" for k in range(3)) +
                " FROM te_v, te_g)")
    return (f"te_l AS ({long}),\n"
            f"te_v AS (SELECT fold, column_name, value, count(*) AS n, {hits} FROM te_l WHERE value IS NOT NULL "
            "GROUP BY fold, column_name, value),\n"
            f"te_fg AS (SELECT fold, count(*) AS n, {hits_src} FROM {src} GROUP BY fold),\n"
            "te_tg AS (SELECT sum(n) AS tn, " + ", ".join(f"sum(h{k}) AS th{k}" for k in range(3)) + " FROM te_fg),\n"
            "te_g AS (SELECT fold, " + ", ".join(f"(th{k} - h{k}) / (tn - n) AS g{k}" for k in range(3)) +
            " FROM te_fg, te_tg),\n"
            "te_tv AS (SELECT column_name, value, sum(n) AS tn, " + ", ".join(f"sum(h{k}) AS th{k}" for k in range(3)) +
            " FROM te_v GROUP BY column_name, value),\n"
            "te_c AS (SELECT f.fold, tv.column_name, tv.value, tv.tn - COALESCE(v.n, 0) AS n, " +
            ", ".join(f"tv.th{k} - COALESCE(v.h{k}, 0) AS h{k}" for k in range(3)) +
            f" FROM te_tv tv CROSS JOIN (SELECT * FROM range(0, {n_folds}) r(fold)) f "
            "LEFT JOIN te_v v ON v.fold = f.fold AND v.column_name = tv.column_name AND v.value = tv.value),\n"
            "te_enc AS (SELECT c.fold, column_name, value, n, " + ", ".join(
                f"(n * (h{k} / n) + 10e0 * g{k}) / (n + 10e0) AS enc_{k}" for k in range(3)) +
            " FROM te_c c JOIN te_g g ON c.fold = g.fold WHERE n > 0)")


def _apply_sql(src: str, folded: bool = False, keep: str = "t.ID", cols=TE_COLS) -> str:
    joins, sel = [], []
    for i, c in enumerate(cols):
        fcond = f"e{i}.fold = t.fold AND " if folded else ""
        joins.append(f"LEFT JOIN te_enc e{i} ON {fcond}e{i}.column_name = '{c}' AND e{i}.value = CAST(t.{c} AS DOUBLE)")
        for k in range(3):
            sel.append(f"round(COALESCE(e{i}.enc_{k}, g.g{k}), 9) AS {c}_te_{k}")
    gj = "JOIN te_g g ON g.fold = t.fold" if folded else "CROSS JOIN te_g g"
    return f"SELECT {keep}, {', '.join(sel)} FROM {src} t {gj} " + " ".join(joins)


def _tcl() -> str:
    from . import sql_text as S
    return S.clean_cte() + ",\ntcl AS (SELECT * FROM clean WHERE split = 'train'),\ntst AS (SELECT * FROM clean WHERE split = 'test')"


@register("target_encode_fit", sql=lambda: _tcl() + ",\n" + _fit_sql() +
          "\nSELECT column_name, value, n, " + ", ".join(f"round(enc_{k}, 9) AS enc_{k}" for k in range(3)) +
          " FROM te_enc")
def q_te_fit(spark, sf_dir):
    enc, _ = TE.fit(train_clean(spark, sf_dir))
    return enc.select("column_name", "value", "n", *_r9([f"enc_{k}" for k in range(3)]))


@register("artifact_tables", sql=lambda: _tcl() + ",\n" + _fit_sql() +
          "\nSELECT column_name, value, n, " + ", ".join(f"round(enc_{k}, 9) AS enc_{k}" for k in range(3)) +
          " FROM te_enc")
def q_artifacts(spark, sf_dir):
    """Fitted encodings and shares committed as one version in the shared checkpoint folder, checked and read
    back; a second writer of that version is refused, so what is read is the first one's."""
    import uuid
    enc, g = TE.fit(train_clean(spark, sf_dir))
    store = VE.Store(spark, f"{IO.checkpoint_dir(spark)}/artifacts-{uuid.uuid4().hex}")
    one, two = store.draft(), store.draft()
    one.table("encodings", enc)
    one.table("encoding_shares", g)
    two.table("encodings", enc.limit(0))
    one.commit()
    with contextlib.suppress(VE.Conflict):
        two.commit()
    return store.load("encodings", verify=True).select("column_name", "value", "n", *_r9([f"enc_{k}" for k in range(3)]))


@register("target_encode_transform", sql=lambda: _tcl() + ",\n" + _fit_sql() + "\n" + _apply_sql("tcl"), bench=True)
def q_te_transform(spark, sf_dir):
    tr = train_clean(spark, sf_dir)
    enc, g = TE.fit(tr)
    return TE.transform(tr, enc, g).select("ID", *_r9(OUT_TE))


@register("target_encode_full", sql=lambda: _tcl() + ",\n" + _fit_sql() + "\n" + _apply_sql("tst"))
def q_te_full(spark, sf_dir):
    c = cleaned(spark, sf_dir)
    enc, g = TE.fit(c.where(F.col("split") == "train"))
    return TE.transform(c.where(F.col("split") == "test"), enc, g).select("ID", *_r9(OUT_TE))


def _folded_train(spark, sf_dir, cols):
    """The given columns of the cleaned train rows with their fold (folds numbered on the same rows, no self-join)."""
    c = train_clean(spark, sf_dir)
    c = c.select(*cols, SY.key_of().alias("k"), F.col(C.TARGET_COL).alias("y"))
    return SY.with_folds(c).drop("k", "y")


@register("target_encode_oof", sql=lambda: SY.oof_cte() + ",\ntcl AS (SELECT clean.*, fo.fold FROM clean JOIN fo "
          "ON clean.ID = fo.ID WHERE clean.split = 'train'),\n" + _fit_sql("tcl", True) + "\n" +
          _apply_sql("tcl", True, "t.ID, t.fold"), bench=True)
def q_te_oof(spark, sf_dir):
    """Held-out encodings: each row encoded with statistics of the other folds only."""
    # narrow rows; their slices are written once, and the fit and the transform read those
    d = _folded_train(spark, sf_dir, ["ID", C.TARGET_COL, *TE_COLS])
    enc, g = TE.fit_out_of_fold(d, "fold")
    return TE.transform(d, enc, g, fold_col="fold").select("ID", "fold", *_r9(OUT_TE))
