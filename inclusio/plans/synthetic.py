"""Out-of-fold probability table derived from the survey's train rows.

Training output cannot be reproduced in SQL, so decision, search and metric
queries also run on probabilities computed from the row key by integer
arithmetic (``model m``: a = (13+2m)k % 97 + 1, b = (29+2m)k % 89 + 1,
c = (17+2m)k % 83 + 1, p = a/(a+b+c) ...).  Folds come from the deterministic
stratified fold operator with an engine-neutral order key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import config as C
from ..operators.folds import stratified_folds
from . import sql_text as S

MODELS = ["lgb", "xgb", "cat"]
# --- fixed values: fold order key and probability recipe --------------------
ORDER_MUL, ORDER_MOD = 7919, 104729
A_MUL, A_MOD = 13, 97
B_MUL, B_MOD = 29, 89
C_MUL, C_MOD = 17, 83


def key_of(id_col: str = C.ID_COL):
    return F.substring(F.col(id_col), 4, 1 << 20).cast("bigint")


def train_rows(clean: DataFrame) -> DataFrame:
    return (clean.where(F.col("split") == "train")
            .select(C.ID_COL, key_of().alias("k"), "country", F.col(C.TARGET_COL).alias("y")))


def with_folds(rows: DataFrame, n_folds: int = C.N_FOLDS) -> DataFrame:
    ordered = rows.withColumn("_ord", (F.col("k") * ORDER_MUL) % ORDER_MOD)
    return stratified_folds(ordered, "y", ["_ord", "k"], n_folds).drop("_ord")


def prob_exprs(m: int, k="k"):
    kk = F.col(k)
    a = (kk * (A_MUL + 2 * m)) % A_MOD + 1
    b = (kk * (B_MUL + 2 * m)) % B_MOD + 1
    c = (kk * (C_MUL + 2 * m)) % C_MOD + 1
    tot = a + b + c
    return a.cast("double") / tot, b.cast("double") / tot, c.cast("double") / tot


def wide_probs(folded: DataFrame) -> DataFrame:
    """One row per train row: ``<model>_p0..p2`` and ordinal ``<model>_pA, _pB``."""
    cols = []
    for m, name in enumerate(MODELS):
        p0, p1, p2 = prob_exprs(m)
        cols += [p0.alias(f"{name}_p0"), p1.alias(f"{name}_p1"), p2.alias(f"{name}_p2")]
    w = folded.select("*", *cols)
    return w.select("*", *[(F.col(f"{n}_p1") + F.col(f"{n}_p2")).alias(f"{n}_pA") for n in MODELS],
                    *[F.col(f"{n}_p2").alias(f"{n}_pB") for n in MODELS])


def long_probs(folded: DataFrame) -> DataFrame:
    """Long form ``(ID, [fold,] country, y, m, p_low, p_med, p_high)``."""
    keep = [C.ID_COL, *(["fold"] if "fold" in folded.columns else []), "country", "y"]
    st = []
    for m in range(len(MODELS)):
        p0, p1, p2 = prob_exprs(m)
        st.append(F.struct(F.lit(m).cast("bigint").alias("m"), p0.alias("p_low"), p1.alias("p_med"),
                           p2.alias("p_high")))
    return (folded.select(*keep, F.explode(F.array(*st)).alias("s"))
            .select(*keep, "s.m", "s.p_low", "s.p_med", "s.p_high"))


def oof_table(spark, sf_dir, folds: bool = False) -> DataFrame:
    """Wide probabilities of the train rows; the fold column (a range shuffle)
    only when the query uses it."""
    from .q_prepare import cleaned
    rows = train_rows(cleaned(spark, sf_dir))
    return wide_probs(with_folds(rows) if folds else rows)


# ------------------------------------------------------------------- SQL side
def _prob_sql(m: int) -> list[str]:
    a = f"((k * {A_MUL + 2 * m}) % {A_MOD} + 1)"
    b = f"((k * {B_MUL + 2 * m}) % {B_MOD} + 1)"
    c = f"((k * {C_MUL + 2 * m}) % {C_MOD} + 1)"
    tot = f"({a} + {b} + {c})"
    return [f"CAST({a} AS DOUBLE) / {tot}", f"CAST({b} AS DOUBLE) / {tot}", f"CAST({c} AS DOUBLE) / {tot}"]


def oof_cte() -> str:
    """``tr`` (train rows), ``fo`` (with folds), ``oof`` (wide), ``oof_long``."""
    wide = []
    for m, n in enumerate(MODELS):
        p = _prob_sql(m)
        wide += [f"{p[0]} AS {n}_p0", f"{p[1]} AS {n}_p1", f"{p[2]} AS {n}_p2"]
    ordinal = [f"{n}_p1 + {n}_p2 AS {n}_pA" for n in MODELS] + [f"{n}_p2 AS {n}_pB" for n in MODELS]
    long_parts = []
    for m in range(len(MODELS)):
        p = _prob_sql(m)
        long_parts.append(f"SELECT ID, fold, country, y, CAST({m} AS BIGINT) AS m, {p[0]} AS p_low, "
                          f"{p[1]} AS p_med, {p[2]} AS p_high FROM fo")
    return (S.clean_cte() + ",\n"
            "tr AS (SELECT ID, CAST(substr(ID, 4) AS BIGINT) AS k, country, Target AS y FROM clean "
            "WHERE split = 'train'),\n"
            "offs AS (SELECT y, sum(n) OVER (ORDER BY y) - n AS off FROM "
            "(SELECT y, count(*) AS n FROM tr GROUP BY y) c),\n"
            f"fo AS (SELECT tr.ID, tr.k, tr.country, tr.y, CAST((offs.off + row_number() OVER "
            f"(PARTITION BY tr.y ORDER BY (tr.k * {ORDER_MUL}) % {ORDER_MOD}, tr.k) - 1) % 5 AS BIGINT) AS fold "
            "FROM tr JOIN offs ON tr.y = offs.y),\n"
            f"oof0 AS (SELECT *, {', '.join(wide)} FROM fo),\n"
            f"oof AS (SELECT *, {', '.join(ordinal)} FROM oof0),\n"
            f"oof_long AS ({' UNION ALL '.join(long_parts)})")
