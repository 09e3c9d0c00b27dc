"""Distributed training: learners, out-of-fold scoring, saved models, search.

The reference's boosted-tree libraries are single-machine; here every fit's
work (histogram aggregation per tree level) runs on the executors.  Fits are independent Spark jobs: ``run_fits`` submits them from
one small driver thread pool, each in a scheduler pool of its own (with
``spark.scheduler.mode=FAIR`` they share the cluster), and commits every
finished fit, so that a restarted driver fits what is missing only.

Boosted fits (``boosting``) end by patience on their validation rows: the
held-out fold under cross-validation, else ``held_back`` rows, beside a model of
as many rounds on all rows, which is the one that is kept.  All folds and
tasks that share a feature table are boosted side by side.  Forests grow all
their trees in the same passes (``forest``).  MLlib rejects NaN/NULL
features, so missing values get a sentinel far outside every column's range
before assembling.
"""

from __future__ import annotations

import json
import random
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import StringIndexer, VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from .. import config as C
from ..session import materialised
from ..sources.versions import Folder
from . import boosting as BO
from . import forest as FR

#: Stands for a missing value: no answer, amount or score is anywhere near it.
SENTINEL = -1e9
#: Up to 2000 boosting rounds (patience ends them), 1000 trees and 1000 iterations.  A forest's level is
#: one pass over the rows if its statistics fit into maxMemoryInMB; their size, which is what a level
#: shuffles, goes by nodes, features and bins (an answer has ten values at most).
DEFAULT_PARAMS = {
    # fixed values: least rows of a leaf and least gain of a split
    "gbt": {"maxIter": 2000, "maxDepth": 4, "stepSize": 0.1, "subsamplingRate": 0.8, "seed": C.SEED, "minInstancesPerNode": 13, "minInfoGain": 0.2529},
    "rf": {"numTrees": 1000, "maxDepth": 6, "seed": C.SEED, "maxBins": 16, "maxMemoryInMB": 1024},
    "lr": {"maxIter": 1000, "regParam": 0.01},
}
#: Share of rows held back to end boosting where no fold is held out.
STOP_SHARE = 0.1
LEARNERS = ["gbt", "rf", "lr"]


def numeric_features(df: DataFrame, exclude=(C.ID_COL, C.TARGET_COL, "split", "fold", "y", "k")) -> list[str]:
    return [c for c, t in df.dtypes if c not in exclude and t in ("double", "int", "bigint", "float")]


def assemble(df: DataFrame, cols: list[str], out: str = "features") -> DataFrame:
    """Sentinel for missing and non-finite values, then one vector column (ML boundary only)."""
    def fin(c):
        x = F.col(c).cast("double")
        return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(SENTINEL)).otherwise(x)
    filled = df.select("*", *[fin(c).alias(f"__f_{c}") for c in cols])
    va = VectorAssembler(inputCols=[f"__f_{c}" for c in cols], outputCol=out)
    return va.transform(filled).drop(*[f"__f_{c}" for c in cols])


def fit_learner(kind: str, train: DataFrame, label: str = "label", params: dict | None = None,
                n_classes: int = C.N_CLASSES, validation_col: str | None = None, whole: bool = False):
    """One learner on an assembled frame, as ``(form, model)``.  ``gbt``: joint boosting of all classes,
    ended by patience on the rows of ``validation_col`` and, with ``whole``, grown on all rows for as many rounds;
    the others don't look at that column and are fitted on all rows."""
    p = {**DEFAULT_PARAMS[kind], **(params or {})}
    if kind == "gbt":
        return ("boosted", BO.fit_boosted(train, n_classes, label, validation_col, whole=whole, **_boosting_params(params)))
    if kind == "rf":
        return ("forest", FR.fit_forest(train, label, n_classes, **p))
    if kind == "lr":
        fam = "binomial" if n_classes == 2 else "multinomial"
        return ("lr", LogisticRegression(labelCol=label, featuresCol="features", family=fam, **p).fit(train))
    raise ValueError(kind)


def _boosting_params(params: dict | None) -> dict:
    names = {"maxIter": "max_rounds", "stepSize": "rate", "weightCol": "weight_col"}
    return {names.get(k, k): v for k, v in {**DEFAULT_PARAMS["gbt"], **(params or {})}.items()}


def with_probabilities(fitted, df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` (with ``features``) plus the probability of each class under the given names."""
    form, m = fitted
    if form in _TREES:
        return m.probabilities(df, "__p").withColumnsRenamed({f"__p{c}": n for c, n in enumerate(names)})
    t = m.transform(df).withColumn("__p", vector_to_array("probability"))
    return t.select(*df.columns, *[F.col("__p")[c].alias(n) for c, n in enumerate(names)])


def predict_proba(fitted, df: DataFrame, keep: list[str], n_classes: int = C.N_CLASSES) -> DataFrame:
    """``keep + p0..p{n-1}``."""
    names = [f"p{c}" for c in range(n_classes)]
    return with_probabilities(fitted, df, names).select(*keep, *names)


def held_back(df: DataFrame, id_col: str = C.ID_COL, share: float = STOP_SHARE) -> DataFrame:
    """Adds ``__val``: a fixed share of the rows, by a hash of the id, on which boosting stops."""
    return df.withColumn("__val", F.pmod(F.xxhash64(F.col(id_col), F.lit("stop")), F.lit(1000)) < int(share * 1000))


def train_ensemble(train: DataFrame, feature_cols: list[str], label: str = C.TARGET_COL,
                   learners=LEARNERS, params: dict | None = None, threads: int = 3) -> dict:
    """Fit each learner on all rows (fits submitted concurrently); ``held_back`` rows say after how many rounds
    boosting ends, and are trained on, too."""
    a = assemble(train.where(F.col(label).isNotNull()), feature_cols).withColumn("label", F.col(label).cast("double"))
    a = materialised(held_back(a).select("features", "label", "__val"), "ensemble-rows")
    return run_fits(a.sparkSession, {k: lambda k=k: fit_learner(k, a, "label", (params or {}).get(k), C.N_CLASSES, "__val", True) for k in learners},
                    threads=threads)


def score_ensemble(models: dict, df: DataFrame, feature_cols: list[str], keep: list[str]) -> DataFrame:
    """Long table ``(keep..., model, p0, p1, p2)``."""
    a = assemble(df, feature_cols)
    out = None
    for name, fitted in models.items():
        p = predict_proba(fitted, a, keep).withColumn("model", F.lit(name))
        out = p if out is None else out.unionByName(p)
    return out


def ordinal_labels(label: str = C.TARGET_COL) -> dict[str, Column]:
    """The two binary tasks of an ordered label: A = (y >= 1), B = (y == 2)."""
    return {"A": (F.col(label) >= 1).cast("double"), "B": (F.col(label) == 2).cast("double")}


def train_ordinal(train: DataFrame, feature_cols: list[str], label: str = C.TARGET_COL,
                  learners=LEARNERS, params: dict | None = None, threads: int = 3) -> dict:
    """Both tasks with every learner on all rows (see ``train_ensemble``): ``{(task, learner): model}``."""
    tasks = ordinal_labels(label)
    base = held_back(assemble(train.where(F.col(label).isNotNull()), feature_cols))
    base = materialised(base.select("features", "__val", *[y.alias(f"__y{t}") for t, y in tasks.items()]), "ordinal-rows")
    return run_fits(base.sparkSession, {(t, k): lambda t=t, k=k: fit_learner(k, base, f"__y{t}", (params or {}).get(k), 2, "__val", True)
                                        for t in tasks for k in learners}, threads=threads)


def score_ordinal(models: dict, df: DataFrame, feature_cols: list[str], keep: list[str]) -> DataFrame:
    """``(keep..., p_A, p_B)``: each task's probability, averaged over its learners in one pass."""
    out, names = assemble(df, feature_cols), {"A": [], "B": []}
    for (task, kind), fitted in models.items():
        name = f"__p_{task}_{kind}"
        out = with_probabilities(fitted, out, ["__other", name]).drop("__other")
        names[task].append(F.col(name))
    mean = {t: sum(cols[1:], cols[0]) / len(cols) for t, cols in names.items()}
    return out.select(*keep, mean["A"].alias("p_A"), mean["B"].alias("p_B"))


def fit_with_early_stopping(train: DataFrame, valid: DataFrame, feature_cols: list[str],
                            label: str = C.TARGET_COL, params: dict | None = None):
    """Boosting of all classes, ended by patience on the rows of ``valid``."""
    both = (train.withColumn("__val", F.lit(False)).unionByName(valid.withColumn("__val", F.lit(True))))
    a = assemble(both, feature_cols).withColumn("label", F.col(label).cast("double"))
    return fit_learner("gbt", a, "label", params, validation_col="__val")


# ------------------------------------------------------------ committed fits
_TREES = {"boosted": BO.Boosted, "forest": FR.Forest}


def save_fitted(fitted, path: str, spark, **about) -> None:
    """One fitted learner as a folder: its MLlib model (trees as text) and what it is."""
    form, m = fitted
    if form in _TREES:
        about[form] = m.to_json()
    else:
        m.write().overwrite().save(f"{path}/model")
    Folder(spark, path).write("about.json", json.dumps({"form": form, **about}))


def load_fitted(path: str, spark):
    """(fitted learner, about) as ``save_fitted`` wrote them."""
    about = json.loads(Folder(spark, path).read("about.json"))
    form = about["form"]
    if form in _TREES:
        return (form, _TREES[form].from_json(about.pop(form))), about
    return (form, LogisticRegressionModel.load(f"{path}/model")), about


def fit_name(key) -> str:
    return "-".join(str(k) for k in key) if isinstance(key, tuple) else str(key)


def run_fits(spark, fits: dict, path: str | None = None, threads: int = 4, joint=()) -> dict:
    """``{key: fit()}`` for every entry of ``fits``, from one pool of driver threads; ``joint``: further
    ``(keys, fit)``, where ``fit(keys)`` yields ``(key, fitted)`` of several that are fitted side by side.

    Each fit's jobs go to a scheduler pool of their own, so that in FAIR mode a long fit doesn't hold up
    the others.  With ``path`` a finished fit is saved below it under a passing name and committed by a
    rename; a fit that is committed already, by this driver or one before it, is loaded instead of run."""
    folder, done = Folder(spark, path) if path else None, {}

    def keep(key, fitted):
        if folder:
            passing = f".{fit_name(key)}-{uuid.uuid4().hex}"
            save_fitted(fitted, f"{path}/{passing}", spark)
            folder.rename_new(passing, fit_name(key))  # False: another driver was first, with the same rows and seed
        done[key] = fitted

    def run(keys, fit):
        held = [k for k in keys if folder and folder.exists(f"{fit_name(k)}/about.json")]
        done.update({k: load_fitted(f"{path}/{fit_name(k)}", spark)[0] for k in held})
        missing = [k for k in keys if k not in done]
        if missing:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"fit-{fit_name(missing[0])}")
            for key, fitted in fit(missing):
                keep(key, fitted)

    work = [*joint, *[([key], lambda keys, key=key: [(key, fits[key]())]) for key in fits]]
    with ThreadPoolExecutor(max_workers=threads) as pool:
        futures = [pool.submit(run, keys, fit) for keys, fit in work]
        for f in futures:
            f.result()
    return {key: done[key] for keys, _ in work for key in keys}


# ------------------------------------------------------------ cross-validation
@dataclass
class CrossValidated:
    """Out-of-fold scores, the fitted model of each (fold, learner), and each fold's feature columns."""

    oof: DataFrame
    models: dict
    columns: dict


def _fold_table(df: DataFrame, feature_cols, fold_col, keep, labels: dict, encoder):
    """The assembled rows (``keep``, ``features``, one ``__y<task>`` per task), written once: the features and,
    with an encoder, each fold's encodings after them.  Also each fold's feature columns and their places."""
    folds = sorted(r[0] for r in df.select(fold_col).distinct().collect())  # k values
    rows, columns, places, everything = df, {}, {}, list(feature_cols)
    for f in folds:
        rows, extra = encoder(f, rows) if encoder is not None else (rows, [])
        columns[f] = list(feature_cols) + extra
        places[f] = (*range(len(feature_cols)), *range(len(everything), len(everything) + len(extra)))
        rows = rows.withColumnsRenamed({c: f"__{f}_{c}" for c in extra})
        everything += [f"__{f}_{c}" for c in extra]
    a = assemble(rows, everything).select(*dict.fromkeys([*keep, fold_col]), "features", *[y.alias(f"__y{t}") for t, y in labels.items()])
    return materialised(a, "fold-table"), columns, places


def _cross_validate(df, feature_cols, fold_col, labels, learners, params, keep, threads, encoder, n_classes, path, held=None):
    """(long out-of-fold table with ``task`` and ``model``, models by (task, fold, learner), columns by fold)."""
    keep = list(dict.fromkeys([*keep, fold_col]))
    params = params or {}
    weight = (params.get("gbt") or {}).get("weightCol")
    (table, columns, places), blocks = held or (_fold_table(df, feature_cols, fold_col, [*keep, weight] if weight else keep, labels, encoder), None)

    def frame(f):
        """The rows with the features of fold f's models."""
        if encoder is None:
            return table
        own = VectorSlicer(inputCol="features", outputCol="__own", indices=list(places[f]))
        return own.transform(table).drop("features").withColumnRenamed("__own", "features")

    def boosted(keys):
        """All tasks and folds side by side, each fold's models on its own features."""
        wanted = [BO.Ensemble((t, f, k), f"__y{t}", f, n_classes, places[f] if encoder is not None else None) for t, f, k in keys]
        for key, m in BO.boost(table, wanted, fold_col, held=blocks, **_boosting_params(params.get("gbt"))):
            yield key, ("boosted", m)

    def fit(t, f, k):
        return fit_learner(k, frame(f).where(F.col(fold_col) != f), f"__y{t}", params.get(k), n_classes)

    joint = [([(t, f, "gbt") for f in places for t in labels], boosted)] if "gbt" in learners else []
    keys = [(t, f, k) for k in learners if k != "gbt" for t in labels for f in places]
    models = run_fits(df.sparkSession, {key: lambda key=key: fit(*key) for key in keys}, path, threads, joint)
    out = None
    for (t, f, k), fitted in models.items():
        p = predict_proba(fitted, frame(f).where(F.col(fold_col) == f), keep, n_classes).withColumns({"task": F.lit(t), "model": F.lit(k)})
        out = p if out is None else out.unionByName(p)
    return out, models, columns


def cross_validate(df: DataFrame, feature_cols: list[str], fold_col: str = "fold", label: str = C.TARGET_COL,
                   learners=LEARNERS, params: dict | None = None, keep=(C.ID_COL,), threads: int = 4,
                   encoder=None, n_classes: int = C.N_CLASSES, path: str | None = None, held=None) -> CrossValidated:
    """Per fold f: fit on folds != f (boosting stops on fold f), score fold f; every row scored once.

    ``encoder(f, rows) -> (rows, cols)`` adds the encodings fitted without fold f to all rows; it is
    called once a fold and its columns serve all learners.  The assembled rows are written once, with the
    encodings of all folds side by side.
    ``path``: folder in which finished fits are committed (see ``run_fits``).  ``held``: the assembled rows and
    blocks of these rows, columns and labels, if they are written already.
    """
    oof, models, columns = _cross_validate(df, feature_cols, fold_col, {"": F.col(label).cast("double")}, learners, params, [*keep, fold_col, label],
                                           threads, encoder, n_classes, path, held)
    return CrossValidated(oof.drop("task"), {(f, k): m for (_, f, k), m in models.items()}, columns)


def oof_predictions(df: DataFrame, feature_cols: list[str], *args, **kw) -> DataFrame:
    """The out-of-fold scores of ``cross_validate``."""
    return cross_validate(df, feature_cols, *args, **kw).oof


def cross_validate_ordinal(df: DataFrame, feature_cols: list[str], fold_col: str = "fold", label: str = C.TARGET_COL,
                           learners=LEARNERS, params: dict | None = None, threads: int = 8, encoder=None,
                           path: str | None = None) -> tuple[DataFrame, dict]:
    """Both binary tasks (y >= 1, y == 2) with every learner under the same folds and encodings, all fits of
    both tasks in one pool.

    Returns ``(ID, label, fold, <learner>_pA, <learner>_pB ...)``, one row per row of ``df``, and the
    ``CrossValidated`` of each task.  ``ID`` must be unique."""
    oof, models, columns = _cross_validate(df, feature_cols, fold_col, ordinal_labels(label), learners, params, [C.ID_COL, label],
                                           threads, encoder, 2, path)
    names = [(t, k) for k in learners for t in "AB"]
    wide = oof.groupBy(C.ID_COL, label, fold_col).agg(
        *[F.max(F.when((F.col("task") == t) & (F.col("model") == k), F.col("p1"))).alias(f"{k}_p{t}") for t, k in names])
    return wide, {t: CrossValidated(oof.where(F.col("task") == t).drop("task"), {(f, k): m for (u, f, k), m in models.items() if u == t}, columns)
                  for t in "AB"}


def score_fold_average(cv: CrossValidated, df: DataFrame, keep: list[str], n_classes: int = C.N_CLASSES) -> DataFrame:
    """``(keep..., model, p0..p{n-1})``: every row scored by all fold models of a learner, averaged.

    ``df`` holds all feature columns; encoded ones come from the encoder fitted on all train rows, as at
    serving time there is no fold to leave out.  The fold models score one after the other in projections
    over the same rows, so nothing is shuffled and no row id is needed."""
    learners = sorted({k for _, k in cv.models})
    folds = sorted({f for f, _ in cv.models})
    out = assemble(df, cv.columns[folds[0]]).select(*keep, "features")
    total = {k: [F.lit(0.0)] * n_classes for k in learners}
    for f in folds:
        for k in learners:
            names = [f"__p_{f}_{k}_{c}" for c in range(n_classes)]
            out = with_probabilities(cv.models[f, k], out, names)
            total[k] = [t + F.col(n) for t, n in zip(total[k], names)]
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("model"), *[(t / len(folds)).alias(f"p{c}") for c, t in enumerate(total[k])])
                               for k in learners])).alias("s")
    return out.select(*keep, rows).select(*keep, "s.*")


def score_ordinal_average(cvs: dict, df: DataFrame, keep: list[str], weights: dict[str, float]) -> DataFrame:
    """``(keep..., p_A, p_B)``: each task's fold models averaged per learner, learners blended by ``weights``."""
    out = df
    for t, cv in cvs.items():
        folds = sorted({f for f, _ in cv.models})
        out = assemble(out, cv.columns[folds[0]])
        parts = []
        for f in folds:
            for k, w in weights.items():
                name = f"__{t}_{f}_{k}"
                out = with_probabilities(cv.models[f, k], out, ["__other", name]).drop("__other")
                parts.append(F.col(name) * F.lit(w / len(folds)))
        out = out.withColumn(f"p_{t}", sum(parts[1:], parts[0])).drop("features", *[c for c in out.columns if c.startswith(f"__{t}_")])
    return out.select(*keep, *[f"p_{t}" for t in cvs])


def fold_report(cv: CrossValidated, label: str = C.TARGET_COL, fold_col: str = "fold") -> DataFrame:
    """Per fold and learner: rows, weighted F1 of the most probable class, rows predicted and truly in the
    last class, and of boosted learners the chosen and the last round."""
    from ..functions.decide import argmax_class
    from .metrics import f1_scores

    spark, last = cv.oof.sparkSession, C.N_CLASSES - 1
    pred = cv.oof.select(fold_col, "model", F.col(label).alias("y"), argmax_class(*[f"p{c}" for c in range(C.N_CLASSES)]).alias("pred"))
    scores = f1_scores(pred, keys=[fold_col, "model"])
    counts = pred.groupBy(fold_col, "model").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("pred") == last).alias("high_predicted"),
                                                 F.count_if(F.col("y") == last).alias("high_true"))
    rounds = [(int(f), k, m.best_round, m.rounds) for (f, k), (form, m) in cv.models.items() if form == "boosted"]
    chosen = spark.createDataFrame(rounds, "fold bigint, model string, best_round int, rounds int")  # one row a boosted fit
    return (counts.join(scores, [fold_col, "model"])
            .join(F.broadcast(chosen.withColumnRenamed("fold", fold_col)), [fold_col, "model"], "left")
            .select(fold_col, "model", "n_rows", "f1_weighted", "high_predicted", "high_true", "best_round", "rounds"))


def save_models(cv: CrossValidated, spark, path: str) -> None:
    """All fold models with their feature columns."""
    for (f, k), fitted in cv.models.items():
        save_fitted(fitted, f"{path}/{fit_name((f, k))}", spark, fold=int(f), learner=k, columns=cv.columns[f])


def load_models(spark, path: str) -> CrossValidated:
    """The models and columns that ``save_models`` wrote (without out-of-fold scores)."""
    models, columns = {}, {}
    for name in (n for n in Folder(spark, path).names("") if not n.startswith(".")):
        fitted, about = load_fitted(f"{path}/{name}", spark)
        models[about["fold"], about["learner"]] = fitted
        columns[about["fold"]] = about["columns"]
    return CrossValidated(None, dict(sorted(models.items())), columns)


def feature_importance(fitted, feature_cols: list[str], spark, top: int = 20) -> DataFrame:
    """Importances zipped with the assembled column names, sorted, top-k."""
    rows = [(c, float(v)) for c, v in zip(feature_cols, fitted[1].importances())]
    return (spark.createDataFrame(rows, "feature string, importance double")
            .orderBy(F.desc("importance"), F.asc("feature")).limit(top))


def baseline_pipeline(string_cols: list[str], numeric_cols: list[str], label: str = "label") -> Pipeline:
    """StringIndexer (fit on train only, unseen -> extra index) + assembler + forest."""
    idx = StringIndexer(inputCols=string_cols, outputCols=[f"{c}__idx" for c in string_cols],
                        handleInvalid="keep", stringOrderType="alphabetAsc")
    va = VectorAssembler(inputCols=[f"{c}__idx" for c in string_cols] + numeric_cols, outputCol="features",
                         handleInvalid="keep")
    rf = FR.ForestClassifier(labelCol=label, featuresCol="features", **DEFAULT_PARAMS["rf"])
    return Pipeline(stages=[idx, va, rf])


# --- fixed values: search ranges of the tuned boosted-tree parameters ---------
# learning rate 0.01-0.15 (log), depth 3-12, min child 5-100, subsample 0.5-1,
# column sample 0.5-1, min split gain 0-1; leaves and L1/L2 have no MLlib
# counterpart and are not searched.
SEARCH_SPACE = {
    "stepSize": ("log", 0.01, 0.15),
    "maxDepth": ("int", 3, 12),
    "minInstancesPerNode": ("int", 5, 100),
    "subsamplingRate": ("float", 0.5, 1.0),
    "featureSubsetStrategy": ("float", 0.5, 1.0),
    "minInfoGain": ("float", 0.0, 1.0),
}


def sample_trials(n_trials: int, seed: int = C.SEED) -> list[dict]:
    """Random search: a reproducible table of sampled parameters."""
    import math
    rng = random.Random(seed)
    out = []
    for t in range(n_trials):
        p = {}
        for k, (kind, lo, hi) in SEARCH_SPACE.items():
            if kind == "int":
                p[k] = rng.randint(lo, hi)
            elif kind == "log":
                p[k] = math.exp(rng.uniform(math.log(lo), math.log(hi)))
            else:
                p[k] = rng.uniform(lo, hi)
        p["featureSubsetStrategy"] = f"{p['featureSubsetStrategy']:.4f}"
        out.append({"trial": t, **p})
    return out


#: Trials of a full search.
N_TRIALS = 100


def random_search(base: DataFrame, feature_cols: list[str], weight_col: str | None = None, fold_col: str = "fold",
                  label: str = C.TARGET_COL, n_trials: int = N_TRIALS, seed: int = C.SEED, threads: int = 4,
                  fixed: dict | None = None, path: str | None = None) -> DataFrame:
    """One row per trial: its parameters, as fitted, and macro F1 after the threshold search on its
    out-of-fold probabilities.  Trials share one pool of driver threads and one staged copy of the rows, a trial's
    folds are boosted side by side.  ``fixed``: parameters that all trials share.  ``path``: folder in which each finished trial is
    committed with its parameters; a restarted search runs the missing trials only."""
    from . import search as SR

    grid = C.threshold_grid(30)
    trials = sample_trials(n_trials, seed)
    folder = Folder(base.sparkSession, path) if path else None
    name = "trial-{:04d}.json".format

    def committed(trial):
        if folder and folder.exists(name(trial["trial"])):
            row = json.loads(folder.read(name(trial["trial"])))
            if {k: row[k] for k in trial} == trial:  # of the same seed and ranges
                return tuple(row.values())

    def one(trial):
        params = (fixed or {}) | {k: v for k, v in trial.items() if k != "trial"} | ({"weightCol": weight_col} if weight_col else {})
        oof = cross_validate(base, feature_cols, fold_col, label, ["gbt"], {"gbt": params}, threads=2, held=held).oof
        cells = SR.grid_cells(oof.withColumn("y", F.col(label)), F.col("p1"), F.col("p2"), "y", grid)
        best = SR.first_best(SR.cube_scores(cells, len(grid)), "f1_macro", ["j2", "j1"]).select("f1_macro").first()
        row = {k: trial[k] for k in ("trial", *SEARCH_SPACE)} | {"f1_macro": float(best[0]) if best else 0.0}
        if folder:
            passing = f".{name(trial['trial'])}-{uuid.uuid4().hex}"
            folder.write(passing, json.dumps(row))
            folder.rename_new(passing, name(trial["trial"]))
        return tuple(row.values())

    done = {t["trial"]: committed(t) for t in trials}
    missing = [t for t in trials if done[t["trial"]] is None]
    if missing:
        labels = {"": F.col(label).cast("double")}
        rows = _fold_table(base, feature_cols, fold_col, [C.ID_COL, fold_col, label, *[weight_col] * bool(weight_col)], labels, None)
        held = rows, BO.staged(rows[0], [f"__y{t}" for t in labels], fold_col, weight_col)
        with ThreadPoolExecutor(max_workers=threads) as ex:
            done |= zip((t["trial"] for t in missing), ex.map(one, missing))
    rows = [done[t["trial"]] for t in trials]
    return base.sparkSession.createDataFrame(rows, "trial int, stepSize double, maxDepth int, minInstancesPerNode int, "
                                                   "subsamplingRate double, featureSubsetStrategy string, minInfoGain double, f1_macro double")
