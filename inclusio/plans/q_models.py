"""Training, scoring and search keys and file round trips (A1, A2, A10).

What a fit learns has no SQL form.  The oracles of these keys state what SQL can know exactly about the
output: which rows are scored, by which learner and fold, that probabilities are a distribution, that
labels are in the domain, how many trials ran.  Tests check the rest (accuracy, early stopping, that
saved models score like the ones in memory).
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import config as C
from ..functions import decide as D
from ..operators import clean as CL
from ..operators import boosting as BO
from ..operators import engineer as EN
from ..operators import folds as FO
from ..operators import metrics as M
from ..operators import models as MD
from ..operators import search as SR
from ..operators import target_encoding as TE
from ..sources import io as IO
from ..sources import survey_view as SV
from ..sources import versions as VE
from . import sql_text as S
from ..session import materialised
from .q_prepare import cleaned
from .registry import register

K_FOLDS = C.N_FOLDS


def _base(spark, sf_dir):
    """Engineered features and missing flags of both splits, written once to the shared folder: every
    fit below reads this table again.  The flagged columns are those of the train split."""
    c = cleaned(spark, sf_dir)
    flagged = CL.missing_flag_columns(c.where(F.col("split") == "train"))
    f = EN.engineer_features(CL.add_missing_flags(c, flagged))
    return materialised(f.select("*", F.substring("ID", 4, 1 << 20).cast("bigint").alias("k")), "training-base")


def _feature_cols(df):
    return MD.numeric_features(df)


def _train_with_folds(base, n_folds=K_FOLDS, stratum=C.TARGET_COL):
    """Train rows with their fold, materialised once (every fold fit reads them)."""
    tr = base.where(F.col("split") == "train").withColumn("_ord", (F.col("k") * 7919) % 104729)
    if stratum != C.TARGET_COL:
        tr = tr.withColumn(stratum, FO.joint_stratum("country", C.TARGET_COL))
    folded = FO.stratified_folds(tr, stratum, ["_ord", "k"], n_folds).drop("_ord")
    return materialised(folded.drop(stratum) if stratum != C.TARGET_COL else folded, "training-folds")


def _full_encoder(tr, te):
    enc, g = TE.fit(tr)
    return TE.transform(tr, enc, g), TE.transform(te, enc, g), TE.encoded_columns()


def fold_encoder(base):
    """Encoder of each fold's complement, all of them from one aggregate; see ``MD.cross_validate``."""
    enc, g = TE.fit_out_of_fold(base, "fold", n_folds=K_FOLDS)
    packed = materialised(TE.pack(materialised(enc, "encodings"), g, TE.C.TARGET_ENCODE_COLS, "fold", C.N_CLASSES), "packed-encodings")
    kind = dict(enc.dtypes)["value"]

    def encode(f, rows):
        return TE.apply_packed(rows, packed.where(F.col("fold") == f), kind), TE.encoded_columns()
    return encode


def _summary(oof, by):
    """Per group: rows, ids, and rows whose probabilities aren't a distribution."""
    p = [F.col(f"p{c}") for c in range(C.N_CLASSES)]
    bad = (F.abs(p[0] + p[1] + p[2] - 1) > 1e-9) | (F.least(*p) < 0) | F.greatest(*[x.isNull() for x in p])
    return oof.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("ID").alias("n_ids"), F.count_if(bad).alias("n_bad"))


_LEARNERS_SQL = "(VALUES ('gbt'), ('rf'), ('lr')) l(model)"


@register("train_multiclass", sql=lambda: S.clean_cte() + f"""
SELECT model, count(*) AS n_rows, count(DISTINCT ID) AS n_ids, CAST(0 AS BIGINT) AS n_bad
FROM clean CROSS JOIN {_LEARNERS_SQL} WHERE split = 'test' GROUP BY model""")
def q_train_multiclass(spark, sf_dir):
    """Three learners fitted on all train rows (full-fit encoder), scoring the test rows."""
    base = _base(spark, sf_dir)
    tr_e, te_e, extra = _full_encoder(base.where(F.col("split") == "train"), base.where(F.col("split") == "test"))
    cols = _feature_cols(base) + extra
    return _summary(MD.score_ensemble(MD.train_ensemble(tr_e, cols), te_e, cols, ["ID"]), ["model"])


@register("train_ordinal", sql=lambda: S.clean_cte() + """
SELECT count(*) AS n_rows, count(DISTINCT ID) AS n_ids, CAST(0 AS BIGINT) AS n_bad FROM clean WHERE split = 'test'""")
def q_train_ordinal(spark, sf_dir):
    """Three learners for each of the two tasks (full-fit encoder), scoring the test rows."""
    base = _base(spark, sf_dir)
    tr_e, te_e, extra = _full_encoder(base.where(F.col("split") == "train"), base.where(F.col("split") == "test"))
    cols = _feature_cols(base) + extra
    scored = MD.score_ordinal(MD.train_ordinal(tr_e, cols), te_e, cols, ["ID"])
    bad = ~(F.col("p_A").between(0, 1) & F.col("p_B").between(0, 1))
    return scored.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("ID").alias("n_ids"), F.count_if(bad).alias("n_bad"))


_FOLDS_SQL = f"""
f AS (SELECT ID, Target, CAST((row_number() OVER (ORDER BY Target, (CAST(substr(ID, 4) AS BIGINT) * 7919) % 104729, CAST(substr(ID, 4) AS BIGINT)) - 1) % {C.N_FOLDS} AS BIGINT) AS fold
      FROM clean WHERE split = 'train')"""


@register("early_stopping", sql=lambda: S.clean_cte() + "," + _FOLDS_SQL + f"""
SELECT fold, CAST({MD.DEFAULT_PARAMS['gbt']['maxIter']} AS BIGINT) AS max_rounds, TRUE AS by_patience, TRUE AS cut_at_best, count(*) AS n_validation FROM f GROUP BY fold""")
def q_early_stopping(spark, sf_dir):
    """Each fold's boosted fit with that fold as validation set: it ends when the patience is used up (or no
    split is left that gains enough, or at the last allowed round), and the model has the trees of the round
    with the least validation loss."""
    base = _train_with_folds(_base(spark, sf_dir))
    most = MD.DEFAULT_PARAMS["gbt"]["maxIter"]
    cv = MD.cross_validate(base, _feature_cols(base), "fold", learners=["gbt"])
    rows = []  # one a fold
    for (f, _), (_, m) in cv.models.items():
        least = min(m.curve)
        ended = m.rounds < m.best_round + BO.PATIENCE if m.exhausted else m.rounds == min(m.best_round + BO.PATIENCE, most)
        rows.append((int(f), ended and m.rounds == len(m.curve),
                     m.curve[m.best_round - 1] == least and all(c > least for c in m.curve[:m.best_round - 1])
                     and all(len(trees) == m.best_round for trees in m.trees)))
    outcome = spark.createDataFrame(rows, "fold bigint, by_patience boolean, cut_at_best boolean")
    return (base.groupBy("fold").agg(F.count(F.lit(1)).alias("n_validation")).join(F.broadcast(outcome), "fold")
            .select("fold", F.lit(most).cast("bigint").alias("max_rounds"), "by_patience", "cut_at_best", "n_validation"))


@register("trained_fold_report", sql=lambda: S.clean_cte() + "," + _FOLDS_SQL + f"""
SELECT fold, model, count(*) AS n_rows, count_if(Target = 2) AS high_true, TRUE AS f1_in_range, model = 'gbt' AS has_best_round
FROM f CROSS JOIN (VALUES ('gbt'), ('lr')) l(model) GROUP BY fold, model""")
def q_fold_report(spark, sf_dir):
    """Weighted F1, High counts and best round of each fold and learner, from fitted models."""
    _, cv = _cross_validated(spark, sf_dir, ["gbt", "lr"])
    r = MD.fold_report(cv)
    return r.select("fold", "model", "n_rows", "high_true", F.col("f1_weighted").between(0, 1).alias("f1_in_range"),
                    (F.coalesce(F.col("best_round").between(1, F.col("rounds")), F.lit(False))).alias("has_best_round"))


@register("oof_predictions", sql=lambda: S.clean_cte() + "," + _FOLDS_SQL + f"""
SELECT model, fold, count(*) AS n_rows, count(DISTINCT ID) AS n_ids, CAST(0 AS BIGINT) AS n_bad FROM f CROSS JOIN {_LEARNERS_SQL} GROUP BY model, fold""")
def q_oof(spark, sf_dir):
    """Every train row scored exactly once by each learner fitted without its fold."""
    return _summary(_cross_validated(spark, sf_dir)[1].oof, ["model", "fold"])


def _cross_validated(spark, sf_dir, learners=MD.LEARNERS):
    base = _train_with_folds(_base(spark, sf_dir))
    return base, MD.cross_validate(base, _feature_cols(base), "fold", learners=learners, encoder=fold_encoder(base), threads=8)


def _blend_search(oof, other="rf"):
    """First best (weight of the boosted learner, thresholds) on out-of-fold scores of it and another one."""
    wide = (oof.groupBy("ID", C.TARGET_COL).pivot("model", ["gbt", other])
            .agg(*[F.first(f"p{c}").alias(f"p{c}") for c in (1, 2)]))
    grid = C.threshold_grid(30)
    sc = SR.blend_weight_search(wide, C.TARGET_COL, ("gbt_p1", "gbt_p2"), (f"{other}_p1", f"{other}_p2"),
                                C.linspace(0.3, 0.8, 20), grid)
    best = SR.first_best(sc, "f1_weighted", ["wi", "j2", "j1"])
    return SR.with_grid_values(best, grid, {"t_med": "j1", "t_high": "j2"}).select(
        F.col("w").alias("w_first"), "t_med", "t_high", "f1_weighted")


@register("oof_weight_search", sql="SELECT TRUE AS in_grid, CAST(1 AS BIGINT) AS n")
def q_oof_weight_search(spark, sf_dir):
    """Out-of-fold GBT and forest probabilities (fold-local encodings), then 20 blend weights x 30^2
    thresholds from one aggregate, first best; the result says that it is a point of the grid."""
    _, cv = _cross_validated(spark, sf_dir, ["gbt", "rf"])
    grid, weights = C.threshold_grid(30), C.linspace(0.3, 0.8, 20)
    ok = F.col("w_first").isin(weights) & F.col("t_med").isin(grid) & F.col("t_high").isin(grid) & F.col("f1_weighted").between(0, 1)
    return _blend_search(cv.oof).agg(F.min(ok).alias("in_grid"), F.count(F.lit(1)).alias("n"))


@register("ordinal_oof_search", sql=lambda: S.clean_cte() + """
SELECT count(*) AS n_rows, count(*) AS n_ids, CAST(0 AS BIGINT) AS n_bad, TRUE AS in_grid FROM clean WHERE split = 'train'""")
def q_ordinal_oof_search(spark, sf_dir):
    """Three learners x two ordinal tasks x five folds of joint (country, label) strata, then 66 weight
    triples x 30^2 ordinal thresholds on the out-of-fold output; the best point is one of the grid."""
    base = _train_with_folds(_base(spark, sf_dir), stratum="_joint")
    oof, _ = MD.cross_validate_ordinal(base, _feature_cols(base), encoder=fold_encoder(base))
    oof = materialised(oof, "ordinal-oof")
    grid, weights = C.threshold_grid(30), C.simplex_weights(0.1)
    best = _ordinal_search(oof, MD.LEARNERS, grid, weights)
    ok = F.col("wi").between(0, len(weights) - 1) & F.col("t_A").isin(grid) & F.col("t_B").isin(grid) & F.col("f1_weighted").between(0, 1)
    p = [F.col(f"{k}_p{t}") for k in MD.LEARNERS for t in "AB"]
    bad = (F.least(*p) < 0) | (F.greatest(*p) > 1) | F.greatest(*[x.isNull() for x in p])
    rows = oof.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("ID").alias("n_ids"), F.count_if(bad).alias("n_bad"))
    return rows.withColumn("in_grid", best.agg(F.min(ok)).scalar())


def _ordinal_search(oof, learners, grid, weights):
    """First best (weight tuple, thresholds) of the ordinal rule on out-of-fold scores."""
    blends = SR.simplex_blends(oof, C.TARGET_COL, learners, weights)
    cells = SR.grid_cells(blends, F.col("pA"), F.col("pB"), "y", grid, ["wi"])
    return SR.with_grid_values(SR.first_best(SR.cube_scores(cells, len(grid), ["wi"]), "f1_weighted", ["wi", "j1", "j2"]),
                               grid, {"t_A": "j1", "t_B": "j2"})


@register("train_score_submit", sql=lambda: S.clean_cte() + """
SELECT n AS n_rows, n AS n_expected, CAST(0 AS BIGINT) AS bad_labels, CAST(0 AS BIGINT) AS missing_ids,
       CAST(0 AS BIGINT) AS extra_ids, CAST(1 AS BIGINT) AS columns_ok, CAST(2 AS BIGINT) AS versions
FROM (SELECT count(*) AS n FROM clean WHERE split = 'test') t""")
def q_train_score_submit(spark, sf_dir):
    """The whole flow: cross-validate, search blend and thresholds, commit models, encodings, scores and
    decision as one version; reload them all, encode the test rows by the full-data encoder, score them by
    the average of the fold models, blend, decide, write the submission and validate what was written.
    A better decision replaces the committed one as a second version, a worse one doesn't."""
    base_all = _base(spark, sf_dir)
    base = _train_with_folds(base_all)
    store = VE.Store(spark, f"{IO.checkpoint_dir(spark)}/run-{uuid.uuid4().hex}")
    cv = MD.cross_validate(base, _feature_cols(base), "fold", learners=["gbt", "rf"], encoder=fold_encoder(base), threads=8)
    draft = store.draft()
    for name, table in zip(("encodings", "encoding_shares"), TE.fit(base)):
        draft.table(name, table)
    draft.model("models", lambda path: MD.save_models(cv, spark, path))
    best = _blend_search(draft.table("oof", cv.oof)).withColumn("f1_weighted", F.col("f1_weighted") - 0.25)
    draft.table("decision", best)
    draft.values["decision"] = best.first()["f1_weighted"]
    draft.commit()
    better = _blend_search(store.load("oof"))
    store.keep_if_better("decision", better, "decision", better.first()["f1_weighted"])
    store.keep_if_better("decision", best.withColumn("t_high", F.lit(0.0)), "decision", 0.0)

    loaded = MD.load_models(spark, store.model_path("models"))
    test = TE.transform(base_all.where(F.col("split") == "test"), store.load("encodings", verify=True), store.load("encoding_shares"))
    d = store.load("decision", verify=True).first()
    w = F.when(F.col("model") == "gbt", d.w_first).otherwise(1 - d.w_first)
    blended = MD.score_fold_average(loaded, test, ["ID"]).groupBy("ID").agg(*[F.sum(w * F.col(f"p{c}")).alias(f"p{c}") for c in range(C.N_CLASSES)])
    pred = blended.select("ID", D.apply_thresholds("p1", "p2", d.t_med, d.t_high).alias("pred"))
    return _submitted(spark, store, pred, test)


def _submitted(spark, store, pred, test):
    """The predictions written as a submission, and the checks of the written file."""
    path = f"{store.path}/submission"
    IO.sink_table(IO.submission(pred), path, fmt="csv")
    checks = IO.validate_submission(IO.scan_csv(spark, path, ["ID", C.TARGET_COL]), test.select("ID"))
    return checks.withColumn("versions", F.lit(len(store.numbers())).cast("bigint"))


@register("ordinal_train_score_submit", sql=lambda: S.clean_cte() + """
SELECT n AS n_rows, n AS n_expected, CAST(0 AS BIGINT) AS bad_labels, CAST(0 AS BIGINT) AS missing_ids,
       CAST(0 AS BIGINT) AS extra_ids, CAST(1 AS BIGINT) AS columns_ok, CAST(1 AS BIGINT) AS versions
FROM (SELECT count(*) AS n FROM clean WHERE split = 'test') t""")
def q_ordinal_submit(spark, sf_dir):
    """The ordinal twin: both tasks under joint strata with fold encodings, weights and thresholds from the
    out-of-fold scores, everything committed, reloaded, and the test rows scored by the fold averages."""
    base_all = _base(spark, sf_dir)
    base = _train_with_folds(base_all, stratum="_joint")
    learners = ["gbt", "lr"]
    store = VE.Store(spark, f"{IO.checkpoint_dir(spark)}/run-{uuid.uuid4().hex}")
    oof, cvs = MD.cross_validate_ordinal(base, _feature_cols(base), learners=learners, encoder=fold_encoder(base))
    draft = store.draft()
    for name, table in zip(("encodings", "encoding_shares"), TE.fit(base)):
        draft.table(name, table)
    for t, cv in cvs.items():
        draft.model(f"models_{t}", lambda path, cv=cv: MD.save_models(cv, spark, path))
    weights = [(i / 10, 1 - i / 10) for i in range(11)]
    draft.table("decision", _ordinal_search(draft.table("oof", oof), learners, C.threshold_grid(30), weights))
    draft.commit()

    loaded = {t: MD.load_models(spark, store.model_path(f"models_{t}")) for t in cvs}
    test = TE.transform(base_all.where(F.col("split") == "test"), store.load("encodings", verify=True), store.load("encoding_shares"))
    d = store.load("decision", verify=True).first()
    scored = MD.score_ordinal_average(loaded, test, ["ID"], dict(zip(learners, weights[d.wi])))
    pred = scored.select("ID", D.ordinal_decision("p_A", "p_B", d.t_A, d.t_B).alias("pred"))
    return _submitted(spark, store, pred, test)


@register("feature_importance", sql="SELECT CAST(20 AS BIGINT) AS n, CAST(20 AS BIGINT) AS n_features, TRUE AS descending")
def q_importance(spark, sf_dir):
    """The boosted learner's 20 most important features; the result says that they are 20 different ones
    with falling shares."""
    base = _base(spark, sf_dir)
    cols = _feature_cols(base)
    models = MD.train_ensemble(base.where(F.col("split") == "train"), cols, learners=["gbt"])
    top = MD.feature_importance(models["gbt"], cols, spark, top=20)
    return top.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("feature").alias("n_features"),
                   ((F.min("importance") >= 0) & (F.max("importance") <= 1)).alias("descending"))


@register("baseline_model", sql=lambda: SV.survey_cte() + """
SELECT 'test' AS part, count(*) AS n_rows, count(DISTINCT ID) AS n_ids, CAST(0 AS BIGINT) AS n_bad FROM survey WHERE split = 'test'""")
def q_baseline(spark, sf_dir):
    """Raw strings -> StringIndexer (train only) -> assembler -> forest; the test rows are predicted."""
    model, _ = _baseline(spark, sf_dir)
    test = SV.survey_split(spark, sf_dir, "test").na.fill(MD.SENTINEL, C.NUMERIC_COLS)
    pred = model.transform(test)
    return pred.agg(F.lit("test").alias("part"), F.count(F.lit(1)).alias("n_rows"), F.countDistinct("ID").alias("n_ids"),
                    F.count_if(~F.col("prediction").isin(0.0, 1.0, 2.0)).alias("n_bad"))


def _baseline(spark, sf_dir):
    """The fitted pipeline and the classification report of its 80/20 stratified holdout."""
    raw = SV.survey_split(spark, sf_dir, "train")
    raw = raw.select("*", F.substring("ID", 4, 1 << 20).cast("bigint").alias("k"),
                     FO.joint_stratum("country", C.TARGET_COL).alias("stratum"))
    split = FO.stratified_split(raw.withColumn("_ord", (F.col("k") * 7919) % 104729), "stratum", ["_ord", "k"], 0.2)
    split = split.withColumn("label", F.when(F.col(C.TARGET_COL) == "Low", 0.0)
                             .when(F.col(C.TARGET_COL) == "Medium", 1.0).otherwise(2.0))
    filled = materialised(split.na.fill(MD.SENTINEL, C.NUMERIC_COLS), "baseline")
    strings = [c for c, _ in SV.ANSWER_COLUMNS] + ["country"]
    model = MD.baseline_pipeline(strings, C.NUMERIC_COLS).fit(filled.where(F.col("is_holdout") == 0))
    pred = model.transform(filled.where(F.col("is_holdout") == 1)).select(
        F.col("label").cast("bigint").alias("y"), F.col("prediction").cast("bigint").alias("pred"))
    return model, M.classification_report(pred)


@register("baseline_report", sql=lambda: SV.survey_cte() + """,
t AS (SELECT Target, country, CAST(substr(ID, 4) AS BIGINT) AS k FROM survey WHERE split = 'train'),
places AS (SELECT Target, row_number() OVER (PARTITION BY country, Target ORDER BY (k * 7919) % 104729, k) - 1 AS pos,
                  count(*) OVER (PARTITION BY country, Target) AS n FROM t),
h AS (SELECT Target FROM places WHERE pos < 0.2e0 * n)
SELECT Target AS label, count(*) AS support FROM h GROUP BY Target
UNION ALL SELECT m, (SELECT count(*) FROM h) FROM (VALUES ('accuracy'), ('macro avg'), ('weighted avg')) v(m)""")
def q_baseline_report(spark, sf_dir):
    """Labels and supports of the holdout report (its scores have no SQL form)."""
    return _baseline(spark, sf_dir)[1].select("label", "support")


@register("hyperparameter_search", sql=f"""
SELECT CAST(trial AS INT) AS trial, TRUE AS in_space, TRUE AS scored FROM range({MD.N_TRIALS}) r(trial)""")
def q_search(spark, sf_dir):
    """Random search: ``MD.N_TRIALS`` sampled parameter trials x k-fold class-weighted GBT; objective is macro F1 after the
    threshold search on the out-of-fold probabilities.  The rows say what was fitted, unclamped."""
    base = _train_with_folds(_base(spark, sf_dir))
    base = materialised(FO.sample_weights(base, C.TARGET_COL, "w"), "weighted-folds")
    found = MD.random_search(base, _feature_cols(base.drop("w")), "w")
    space = F.lit(True)
    for k, (_, lo, hi) in MD.SEARCH_SPACE.items():
        space = space & F.col(k).cast("double").between(lo * 0.999, hi * 1.001)
    return found.select("trial", space.alias("in_space"), F.col("f1_macro").between(0, 1).alias("scored"))


# ------------------------------------------------------------ file round trips
@register("scan_csv", sql=lambda: SV.survey_cte() + "\nSELECT * FROM survey")
def q_scan_csv(spark, sf_dir):
    """Survey written as header CSV to the shared folder and read back with pandas' NA tokens."""
    s = SV.survey(spark, sf_dir)
    path = f"{IO.checkpoint_dir(spark)}/csv-{uuid.uuid4().hex}"
    IO.sink_table(s, path, fmt="csv")
    back = IO.scan_csv(spark, path, schema=s.schema)
    return back


@register("sink_table", sql=lambda: S.clean_cte() + "\nSELECT * FROM clean")
def q_sink(spark, sf_dir):
    """Cleaned survey written as Parquet partitioned by split, read back with partition pruning."""
    c = cleaned(spark, sf_dir)
    path = f"{IO.checkpoint_dir(spark)}/parquet-{uuid.uuid4().hex}"
    IO.sink_table(c, path, partition_by=["split"])
    return spark.read.parquet(path).select(*c.columns)


_STRINGS = [c for c, _ in SV.ANSWER_COLUMNS] + ["country"]


def _codes_sql(c: str) -> str:
    return (f"{c}_codes AS (SELECT {c} AS v, CAST(row_number() OVER (ORDER BY {c}) - 1 AS BIGINT) AS i "
            f"FROM (SELECT DISTINCT {c} FROM survey WHERE split = 'train' AND {c} IS NOT NULL) d)")


@register("categorical_index", sql=lambda: SV.survey_cte() + ",\n" + ",\n".join(_codes_sql(c) for c in _STRINGS) + "\nSELECT s.ID, " + ", ".join(
    f"coalesce({c}_codes.i, (SELECT count(*) FROM {c}_codes)) AS {c}_idx" for c in _STRINGS) + "\nFROM survey s " + " ".join(
    f"LEFT JOIN {c}_codes ON s.{c} = {c}_codes.v" for c in _STRINGS) + " WHERE s.split = 'test'")
def q_cat_index(spark, sf_dir):
    """All string columns as category codes, fitted on train only (ascending), unseen and missing -> one more."""
    codes = CL.category_codes(SV.survey_split(spark, sf_dir, "train"), _STRINGS)
    coded, names = CL.with_category_codes(SV.survey_split(spark, sf_dir, "test"), codes, _STRINGS)
    return coded.select("ID", *names)
