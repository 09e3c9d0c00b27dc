"""Training properties and the driver contract."""

import os
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="module")
def small(spark):
    """Labelled rows whose label depends on two columns, in five folds, with a constant column."""
    rows = [(f"r{i}", float(i % 17), float((i * 7) % 23), 1.0, (i % 17 > 5) + (i % 17 > 11), i % 5) for i in range(400)]
    return spark.createDataFrame(rows, "ID string, a double, b double, c double, Target int, fold int").cache()


FAST = {"rf": {"numTrees": 10}}  # fewer trees for properties that don't depend on them
QUICK = FAST | {"gbt": {"maxIter": 6, "stepSize": 0.3}}


def test_cross_validation_scores_every_row_once(small):
    from inclusio.operators import models as MD
    cv = MD.cross_validate(small, ["a", "b", "c"], params=QUICK)
    per = cv.oof.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("ID").alias("ids")).collect()
    assert {r["model"] for r in per} == set(MD.LEARNERS)
    assert all(r["n"] == r["ids"] == 400 for r in per)
    s = cv.oof.agg(F.min(F.col("p0") + F.col("p1") + F.col("p2")), F.max(F.col("p0") + F.col("p1") + F.col("p2"))).first()
    assert abs(s[0] - 1) < 1e-9 and abs(s[1] - 1) < 1e-9
    right = cv.oof.where("model = 'gbt'").select(F.avg((F.greatest("p0", "p1", "p2") == F.element_at(F.array("p0", "p1", "p2"), F.col("Target") + 1)).cast("int"))).first()[0]
    assert right > 0.9
    assert MD.DEFAULT_PARAMS["gbt"]["maxIter"] == 2000
    for (_, k), (_, m) in cv.models.items():
        if k == "gbt":
            assert 0 < m.best_round <= m.rounds == len(m.curve) == 6 and all(len(trees) == m.best_round for trees in m.trees)


def test_encoder_is_called_once_a_fold(small):
    from inclusio.operators import models as MD
    calls = []

    def encoder(f, rows):
        calls.append(f)
        return rows.withColumn("extra", F.col("a") * f), ["extra"]

    cv = MD.cross_validate(small, ["a", "b"], learners=["rf", "lr"], params=FAST, encoder=encoder)
    assert sorted(calls) == [0, 1, 2, 3, 4] and all(c == ["a", "b", "extra"] for c in cv.columns.values())


def test_saved_models_score_like_those_in_memory(spark, small, tmp_path):
    from inclusio.operators import models as MD
    cv = MD.cross_validate(small, ["a", "b"], params=QUICK)
    MD.save_models(cv, spark, str(tmp_path / "run"))
    back = MD.load_models(spark, str(tmp_path / "run"))
    key = lambda r: (r["ID"], r["model"])
    one, two = (sorted(MD.score_fold_average(x, small, ["ID"]).collect(), key=key) for x in (cv, back))
    assert one == two and len(one) == 3 * 400
    assert [(m.best_round, m.rounds, m.curve, m.prior) for (_, k), (_, m) in sorted(back.models.items()) if k == "gbt"] == [
        (m.best_round, m.rounds, m.curve, m.prior) for (_, k), (_, m) in sorted(cv.models.items()) if k == "gbt"]
    # the average over the folds, by hand for one learner
    by_hand = [MD.predict_proba(cv.models[f, "rf"], MD.assemble(small, cv.columns[f]), ["ID"]) for f in range(5)]
    total = by_hand[0].unionByName(by_hand[1]).unionByName(by_hand[2]).unionByName(by_hand[3]).unionByName(by_hand[4])
    want = {r["ID"]: r["p"] for r in total.groupBy("ID").agg(F.avg("p1").alias("p")).collect()}
    assert all(abs(r["p1"] - want[r["ID"]]) < 1e-9 for r in one if r["model"] == "rf")


def test_ordinal_tasks_have_every_learner(small):
    from inclusio.operators import models as MD
    models = MD.train_ordinal(small, ["a", "b"], params=QUICK)
    assert set(models) == {(t, k) for t in "AB" for k in MD.LEARNERS}
    got = MD.score_ordinal(models, small, ["a", "b"], ["ID", "Target"]).collect()
    assert len(got) == 400 and all(0 <= r["p_A"] <= 1 and 0 <= r["p_B"] <= 1 for r in got)
    assert sum((r["p_A"] >= 0.5) + (r["p_B"] >= 0.5) == r["Target"] for r in got) > 350


def test_ordinal_cross_validation_reads_the_encoded_columns(small):
    from inclusio.operators import models as MD
    from inclusio.operators import search as SR
    calls = []

    def encoder(f, rows):  # the only column that tells the classes apart
        calls.append(f)
        return rows.withColumn("told", F.col("Target") * 2.0), ["told"]

    oof, cvs = MD.cross_validate_ordinal(small, ["c"], learners=["rf", "lr"], params=FAST, encoder=encoder)
    assert sorted(calls) == [0, 1, 2, 3, 4]  # one encoding serves both tasks
    assert set(cvs) == {"A", "B"} and all(set(cv.models) == {(f, k) for f in range(5) for k in ("rf", "lr")} for cv in cvs.values())
    assert all(cv.columns[f] == ["c", "told"] for cv in cvs.values() for f in range(5))
    rows = oof.collect()
    assert len(rows) == len({r["ID"] for r in rows}) == 400
    assert all(0 <= r[c] <= 1 for r in rows for c in ("rf_pA", "rf_pB", "lr_pA", "lr_pB"))
    assert sum((r["rf_pA"] >= 0.5) + (r["rf_pB"] >= 0.5) == r["Target"] for r in rows) == 400
    blends = SR.simplex_blends(oof, "Target", ["rf", "lr"], [(1.0, 0.0), (0.25, 0.75)]).collect()
    assert len(blends) == 800
    want = sorted(round(0.25 * r["rf_pA"] + 0.75 * r["lr_pA"], 12) for r in rows)
    assert sorted(round(b["pA"], 12) for b in blends if b["wi"] == 1) == want
    # the fold averages, blended, against the fold models one by one
    told = small.withColumn("told", F.col("Target") * 2.0)
    got = {r["ID"]: r for r in MD.score_ordinal_average(cvs, told, ["ID"], {"rf": 0.25, "lr": 0.75}).collect()}
    for t in "AB":
        for i in ("r0", "r7", "r11"):
            one = MD.assemble(told.where(F.col("ID") == i), ["c", "told"])
            want = sum(w / 5 * MD.predict_proba(cvs[t].models[f, k], one, ["ID"], 2).first()["p1"] for f in range(5) for k, w in (("rf", 0.25), ("lr", 0.75)))
            assert got[i][f"p_{t}"] == pytest.approx(want, abs=1e-9)


def test_committed_fits_are_not_run_again(small, tmp_path, monkeypatch):
    """A restarted run fits what its predecessor has not committed, and nothing else."""
    from inclusio.operators import models as MD
    path, fit, ran = str(tmp_path / "fits"), MD.fit_learner, []

    def counted(kind, *args, **kw):
        if len(ran) == 3:
            raise RuntimeError("driver lost")
        ran.append(kind)
        return fit(kind, *args, **kw)

    monkeypatch.setattr(MD, "fit_learner", counted)
    run = lambda: MD.cross_validate(small, ["a", "b"], learners=["lr"], threads=1, path=path)
    with pytest.raises(RuntimeError, match="driver lost"):
        run()
    monkeypatch.setattr(MD, "fit_learner", lambda kind, *args, **kw: (ran.append(kind), fit(kind, *args, **kw))[1])
    resumed = run()
    assert len(ran) == 5
    again = run()
    assert len(ran) == 5 and set(again.models) == {(f, "lr") for f in range(5)}
    one, two, fresh = (sorted(cv.oof.collect()) for cv in (resumed, again, MD.cross_validate(small, ["a", "b"], learners=["lr"])))
    assert one == two == fresh


def test_a_fit_cut_short_is_not_seen(spark, small, tmp_path):
    from inclusio.operators import models as MD
    path = str(tmp_path / "fits")
    a = MD.assemble(small, ["a", "b"]).withColumn("label", F.col("Target").cast("double"))
    fitted = MD.fit_learner("lr", a)
    fitted[1].write().save(f"{path}/.x-unfinished/0")  # no about.json, not renamed
    ran = []
    MD.run_fits(spark, {"x": lambda: (ran.append(1), fitted)[1]}, path)
    MD.run_fits(spark, {"x": lambda: (ran.append(1), fitted)[1]}, path)
    assert ran == [1]


def test_fold_report(small):
    from inclusio.operators import models as MD
    cv = MD.cross_validate(small, ["a", "b"], learners=["gbt", "lr"], params=QUICK)
    rows = {(r["fold"], r["model"]): r for r in MD.fold_report(cv).collect()}
    assert len(rows) == 10
    truth = small.where("Target = 2").groupBy("fold").count().collect()
    for r in truth:
        assert rows[r["fold"], "gbt"]["high_true"] == rows[r["fold"], "lr"]["high_true"] == r["count"]
    for f in range(5):
        m = cv.models[f, "gbt"][1]
        assert (rows[f, "gbt"]["best_round"], rows[f, "gbt"]["rounds"]) == (m.best_round, m.rounds) and rows[f, "lr"]["rounds"] is None
        assert rows[f, "gbt"]["f1_weighted"] > 0.9


def test_missing_is_told_apart_from_minus_one(spark):
    from inclusio.operators import models as MD
    df = spark.createDataFrame([(1, None), (2, -1.0), (3, float("nan")), (4, float("inf"))], "ID int, x double")
    got = [r["features"][0] for r in MD.assemble(df, ["x"]).orderBy("ID").collect()]
    assert got == [MD.SENTINEL, -1.0, MD.SENTINEL, MD.SENTINEL]


def test_random_search_reports_what_it_fitted(small):
    from inclusio.operators import models as MD
    got = MD.random_search(small, ["a", "b"], n_trials=2, fixed={"maxIter": 3}).orderBy("trial").collect()
    assert MD.N_TRIALS == 100
    for r, t in zip(got, MD.sample_trials(2)):
        assert r["maxDepth"] == t["maxDepth"] and r["minInstancesPerNode"] == t["minInstancesPerNode"] and 0 <= r["f1_macro"] <= 1


def test_a_restarted_search_runs_missing_trials_only(small, tmp_path, monkeypatch):
    from inclusio.operators import models as MD
    ran, cv = [], MD.cross_validate
    monkeypatch.setattr(MD, "cross_validate", lambda *a, **k: (ran.append(1), cv(*a, **k))[1])
    search = lambda n: MD.random_search(small, ["a"], n_trials=n, fixed={"maxIter": 1}, path=str(tmp_path)).orderBy("trial").collect()
    one = search(1)
    assert len(ran) == 1
    both = search(2)
    assert len(ran) == 2 and both[:1] == one and search(2) == both and len(ran) == 2


def test_versions_keep_the_best(spark, tmp_path):
    from inclusio.sources import io as IO
    base = str(tmp_path)
    frame = lambda s, t: spark.createDataFrame([(s, t)], "f1 double, t double")
    assert IO.count_versions(spark, base, "d") == 0
    assert IO.save_version(frame(0.5, 1.0), base, "d", "f1") is True
    assert IO.save_version(frame(0.4, 2.0), base, "d", "f1") is False
    assert IO.best_version(spark, base, "d").first()["t"] == 1.0
    assert IO.save_version(frame(0.6, 3.0), base, "d", "f1") is True
    assert IO.best_version(spark, base, "d").first()["t"] == 3.0 and IO.count_versions(spark, base, "d") == 3


def test_entry_and_contract(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["country", "n_rows", "avg_formal_access_count", "avg_resilience_score", "n_train",
                          "high_rate"]
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 100


def test_boosting_ends_on_a_plateau():
    from inclusio.operators.boosting import best_round
    falling = [1.0, 0.8, 0.7, 0.65]
    assert best_round([], 3) == (0, False)
    assert best_round(falling, 3) == (4, False)
    assert best_round([*falling, 0.651, 0.651], 3) == (4, False)  # small losses don't end it
    assert best_round([*falling, 0.651, 0.66, 0.64], 3) == (7, False)  # a later gain starts the patience anew
    assert best_round([*falling, 0.65, 0.65, 0.65], 3) == (4, True)  # of equal ones the first


def test_patience_keeps_the_best_round(small):
    """The curve of a real fit: the kept round has the least loss, and the model gives that loss."""
    from inclusio.operators import boosting as BO
    from inclusio.operators import models as MD
    a = MD.assemble(small, ["a", "b"]).withColumn("label", F.col("Target").cast("double")).withColumn("__val", F.col("fold") == 0).cache()
    m = BO.fit_boosted(a, 3, validation_col="__val", patience=3, max_rounds=40, maxDepth=2, rate=0.3, seed=1)
    assert m.rounds == len(m.curve) == min(m.best_round + 3, 40) and m.curve[m.best_round - 1] == min(m.curve)
    held = m.probabilities(a).where("__val")
    assert BO.log_loss(held, "label", ["__p0", "__p1", "__p2"]) == pytest.approx(min(m.curve), abs=1e-9)
    p = held.selectExpr("min(__p0 + __p1 + __p2)", "max(__p0 + __p1 + __p2)").first()
    assert p[0] == pytest.approx(1) and p[1] == pytest.approx(1)


def test_joint_boosting_is_not_worse_than_one_against_the_rest(spark):
    """Three overlapping classes: the joint loss against three binary models whose scores are normalised."""
    from inclusio.operators import boosting as BO
    from inclusio.operators import models as MD
    rows = [(float(x), float(y), float(min(2, max(0, (x + 2 * y + (x * 7 + y * 13 + i * 5) % 11 - 5) // 12))), i % 4 == 0)
            for i in range(3) for x in range(12) for y in range(12)]
    a = MD.assemble(spark.createDataFrame(rows, "a double, b double, label double, __val boolean"), ["a", "b"]).cache()
    joint = BO.fit_boosted(a, 3, validation_col="__val", patience=10, max_rounds=20, maxDepth=3, seed=2)
    held = joint.probabilities(a).where("__val")
    single = held
    for c in range(3):
        one = a.withColumn("label", (F.col("label") == c).cast("double"))
        m = BO.fit_boosted(one, 2, validation_col="__val", patience=10, max_rounds=20, maxDepth=3, seed=2)
        single = m.probabilities(single, f"__q{c}")
    total = F.col("__q01") + F.col("__q11") + F.col("__q21")
    single = single.select("label", *[(F.col(f"__q{c}1") / total).alias(f"q{c}") for c in range(3)])
    assert BO.log_loss(held, "label", ["__p0", "__p1", "__p2"]) <= BO.log_loss(single, "label", ["q0", "q1", "q2"]) + 0.01


def test_boosting_without_validation_rows_or_a_class(spark):
    from inclusio.operators import boosting as BO
    from inclusio.operators import models as MD
    rows = [(float(i), float(i % 2), 1.0 + i % 3) for i in range(60)]  # no row of class 2
    a = MD.assemble(spark.createDataFrame(rows, "a double, label double, w double"), ["a"])
    m = BO.fit_boosted(a, 3, weight_col="w", max_rounds=3, maxDepth=2)
    assert m.rounds == m.best_round == 3 and m.curve == []
    got = m.probabilities(a).agg(F.max("__p2"), F.min("__p0"), F.max("__p0")).first()
    assert got[0] < 0.01 and 0 < got[1] <= got[2] < 1


def test_two_writers_of_a_version(spark, tmp_path):
    from inclusio.sources import versions as VE
    store = VE.Store(spark, str(tmp_path / "store"))
    assert store.current() is None and store.numbers() == []
    one, two = store.draft(), store.draft()
    one.table("t", spark.range(10))
    two.table("t", spark.range(5))
    assert store.numbers() == []  # tables without a manifest are not seen
    assert one.commit().number == 1
    with pytest.raises(VE.Conflict):
        two.commit()
    assert store.load("t", verify=True).count() == 10 and store.numbers() == [1]
    # an update meets another writer in between and is applied to what that one left
    seen = []

    def change(draft, current):
        seen.append(current.number)
        if len(seen) == 1:
            other = store.draft()
            other.values["other"] = 1
            other.commit()
        draft.values["mine"] = 2

    assert store.update(change).number == 3 and seen == [1, 2]
    assert store.current().values == {"other": 1, "mine": 2} and store.current().tables.keys() == {"t"}


def test_a_write_cut_short_is_not_seen_and_changes_are_noticed(spark, tmp_path):
    from inclusio.sources import versions as VE
    store = VE.Store(spark, str(tmp_path / "store"))
    draft = store.draft()
    draft.table("t", spark.range(4).selectExpr("id", "CAST(id AS STRING) AS s"))
    draft.commit()
    store.folder.write("versions/.half.tmp", "{")
    store.draft().table("t", spark.range(9))
    assert store.numbers() == [1] and store.load("t").columns == ["id", "s"]
    assert VE.digest(spark.range(4)) == VE.digest(spark.range(4).orderBy(F.desc("id"))) != VE.digest(spark.range(1, 5))
    spark.range(4).selectExpr("id + 1 AS id", "CAST(id AS STRING) AS s").write.mode("overwrite").parquet(f"{store.path}/{store.current().tables['t']['path']}")
    with pytest.raises(ValueError, match="changed"):
        store.load("t", verify=True)


def test_better_decisions_replace_worse_ones(spark, tmp_path):
    from inclusio.sources import versions as VE
    store = VE.Store(spark, str(tmp_path / "store"))
    frame = lambda t: spark.createDataFrame([(t,)], "t double")
    assert store.keep_if_better("d", frame(1.0), "f1", 0.5) is True
    assert store.keep_if_better("d", frame(2.0), "f1", 0.4) is False and store.keep_if_better("d", frame(2.0), "f1", 0.5) is False
    assert store.load("d").first()["t"] == 1.0
    assert store.keep_if_better("d", frame(3.0), "f1", 0.6) is True
    assert store.load("d").first()["t"] == 3.0 and store.load("d", store.version(1)).first()["t"] == 1.0 and store.numbers() == [1, 2]


def test_categorical_index_unseen(spark):
    from pyspark.ml.feature import StringIndexer
    tr = spark.createDataFrame([("b",), ("a",), ("b",)], "c string")
    te = spark.createDataFrame([("a",), ("z",), (None,)], "c string")
    m = StringIndexer(inputCol="c", outputCol="i", handleInvalid="keep", stringOrderType="alphabetAsc").fit(tr)
    assert [r["i"] for r in m.transform(te).collect()] == [0.0, 2.0, 2.0]


@pytest.mark.parametrize("key", ["threshold_search", "weight_search", "target_encode_oof", "country_pct_rank"])
def test_plans_have_no_python_udf(spark, key):
    import __spark_entry__ as E
    plan = E.queries()[key](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_a_boosting_pass_sums_cuts_and_left_children_only(small, monkeypatch):
    """A pass sends totals and one sum a cut (not 32 bins a feature), for one child of each split node; a level
    without a node that may be split again has no pass."""
    from inclusio.operators import boosting as BO
    from inclusio.operators import models as MD
    a = MD.assemble(small, ["a", "b", "c"]).withColumn("label", F.col("Target").cast("double")).cache()
    seen, summed = [], BO._summed
    monkeypatch.setattr(BO, "_summed", lambda *args: (seen.append(summed(*args)), seen[-1])[1])
    m = BO.fit_boosted(a, 2, max_rounds=1, maxDepth=3)
    assert [np.isfinite(e).sum() for e in m.edges] == [16, 22, 0]
    nodes = [got[0].size // (3 * (1 + 16 + 22)) for got in seen[1:] if 0 in got]
    assert nodes[0] == nodes[1] == 1 and len(nodes) == 3 and nodes[2] <= 2
    assert all(got[0].size % (3 * 39) == 0 for got in seen[1:] if 0 in got)
    seen.clear()
    BO.fit_boosted(a, 2, max_rounds=1, maxDepth=3, minInstancesPerNode=150)  # a child of 250 rows has no split left
    assert sum(0 in got for got in seen[1:]) == 1


@pytest.mark.parametrize("product_nodes", [8, 0])
def test_boosted_trees_by_brute_force(small, monkeypatch, product_nodes):
    """Every split of a first tree has the largest gain over all cuts, and leaves are the Newton step, however
    the sums are made."""
    from inclusio.operators import boosting as BO
    from inclusio.operators import models as MD
    if not product_nodes:  # tasks see the module, not the patched value: the wide path is called by itself
        run = BO._Run([BO.Ensemble("e", "y", None, 2)], [0], None, [0, 1], 0.1, 2, 0, 1.0, 1.0, np.array([[1.0, 2.0], [5.0, np.inf], [np.inf] * 2]))
        rng = np.random.default_rng(0)
        x, slot, z = rng.integers(0, 3, (50, 3)).astype(np.uint8), rng.integers(0, 4, 50), rng.random(50)
        x[:, 1] = np.minimum(x[:, 1], 1)
        got = run.counted(x, run.cuts(0), slot, 4, [z, np.ones(50)])
        right = run.right_of(np.ascontiguousarray(x.T), run.cuts(0))
        want = np.array([[right @ (v * (slot == n)) for v in (z, np.ones(50))] for n in range(4)])
        assert got.shape == (4, 2, 3) and np.allclose(got, want)
        return
    a = MD.assemble(small, ["a", "b"]).withColumn("label", (F.col("Target") > 0).cast("double"))
    m = BO.fit_boosted(a, 2, max_rounds=1, maxDepth=2, rate=0.5)
    rows = a.select("a", "b", "label").collect()
    x, y = BO._binned(np.array([r[:2] for r in rows]), m.edges), np.array([r[2] for r in rows])
    p = 1 / (1 + np.exp(-m.prior[0]))
    g, h, tree = y - p, np.full(len(y), p * (1 - p)), m.trees[0][0]
    worth = lambda on: g[on].sum() ** 2 / (h[on].sum() + BO.RIDGE)

    def best(on):
        cuts = [(f, b, on & (x[:, f] > b)) for f in (0, 1) for b in range(31)]
        return max((worth(on & ~r) + worth(r) - worth(on) for _, _, r in cuts if r.sum() >= 5 and (on & ~r).sum() >= 5), default=0)

    at = np.zeros(len(y), int)
    for depth in range(2):
        at = tree.nodes(x, depth)
        for node in range(1 << depth):
            on, heap = at == node, (1 << depth) - 1 + node
            gain = best(on)
            assert tree.gain[heap] == pytest.approx(gain if gain > 1e-9 else 0, abs=1e-8) and (tree.feature[heap] >= 0) == (gain > 1e-9)
    leaf = tree.nodes(x, 2)
    for node in set(leaf):
        on = leaf == node
        assert tree.value[node] == pytest.approx(0.5 * g[on].sum() / (h[on].sum() + BO.RIDGE), abs=1e-9)


def test_boosted_models_of_an_ensemble_are_trained_on_all_rows(spark, monkeypatch):
    """Class 2 has no row but held-back ones: a model that leaves them out never learns it.  The rounds are those
    that the held-back rows ask for."""
    from inclusio.operators import boosting as BO
    from inclusio.operators import models as MD
    rows = [(f"r{i}", float(i % 5), i % 2) for i in range(400)]
    df = MD.held_back(spark.createDataFrame(rows, "ID string, a double, Target int"))
    df = df.withColumn("Target", F.when(F.col("__val"), F.lit(2)).otherwise(F.col("Target"))).withColumn("a", F.when(F.col("__val"), F.lit(9.0)).otherwise(F.col("a"))).drop("__val").cache()
    assert 10 < df.where("Target = 2").count() < 100
    params = {"gbt": {"maxIter": 8, "stepSize": 0.5, "subsamplingRate": 1.0, "minInstancesPerNode": 1}}
    got = MD.train_ensemble(df, ["a"], learners=["gbt"], params=params)
    p = MD.score_ensemble(got, df, ["a"], ["ID", "Target"]).where("Target = 2").agg(F.min("p2")).first()[0]
    assert p > 0.5
    tasks = MD.train_ordinal(df, ["a"], learners=["gbt"], params=params)
    assert MD.score_ordinal(tasks, df, ["a"], ["ID", "Target"]).where("Target = 2").agg(F.min("p_B")).first()[0] > 0.5
    a = MD.held_back(MD.assemble(df, ["a"]).withColumn("label", F.col("Target").cast("double")))
    one, whole = (BO.fit_boosted(a, 3, "label", "__val", whole=w, max_rounds=8, rate=0.5) for w in (False, True))
    assert (one.best_round, one.rounds, one.curve) == (whole.best_round, whole.rounds, whole.curve)
    assert all(len(trees) == whole.best_round for trees in whole.trees) and one.prior != whole.prior


def test_boosting_keeps_its_checkpoints_for_as_long_as_it_runs(spark, small, monkeypatch):
    """Scores are carried over checkpoints: the trees are those of a run without any, and no checkpoint stays.  A pass
    is a job over cached blocks, without a query plan."""
    import glob
    from pyspark import RDD
    from inclusio.operators import boosting as BO
    from inclusio.operators import models as MD
    from inclusio.session import ensure_checkpoint_dir
    a = MD.assemble(small, ["a", "b"]).withColumn("label", F.col("Target").cast("double")).cache()
    held = lambda: set(glob.glob(f"{ensure_checkpoint_dir(spark).removeprefix('file:').replace('//', '/')}/*/rdd-*"))
    before, models, passes, summed = held(), [], [], BO._summed
    monkeypatch.setattr(BO, "_summed", lambda *args: (passes.append(args[0]), summed(*args))[1])
    for every in (1000, 2):
        monkeypatch.setattr(BO, "REFRESH", every)
        models.append(BO.fit_boosted(a, 3, max_rounds=7, maxDepth=2, rate=0.3, subsamplingRate=0.8, seed=1).to_json())
    assert models[0] == models[1] and held() == before
    assert len(passes) > 20 and all(isinstance(p, RDD) for p in passes)


def test_fits_of_several_threads_ship_the_package_once(spark, monkeypatch):
    import threading
    from concurrent.futures import ThreadPoolExecutor
    from inclusio import session as S
    ready, sent = threading.Barrier(4), []

    class Files:
        applicationId = "shipped-by-many"

        def addPyFile(self, path):
            sent.append(path)

    class Session:
        sparkContext = Files()

    def one(_):
        ready.wait(10)
        S.ship(Session())

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(one, range(4)))
    assert len(sent) == 1


def test_the_search_query_runs_all_trials(spark, small, monkeypatch):
    """The query asks for all 100 trials, as its SQL does."""
    import re
    from inclusio.operators import models as MD
    from inclusio.plans import q_models as Q
    from inclusio.plans.registry import REGISTRY
    asked = []

    def search(base, cols, weight_col=None, n_trials=MD.N_TRIALS, **kw):
        asked.append(n_trials)
        return spark.createDataFrame([(t["trial"], *[t[k] for k in MD.SEARCH_SPACE], 0.5) for t in MD.sample_trials(n_trials)],
                                     ["trial", *MD.SEARCH_SPACE, "f1_macro"])

    monkeypatch.setattr(Q, "_base", lambda *_: small)
    monkeypatch.setattr(Q, "_train_with_folds", lambda base: base)
    monkeypatch.setattr(MD, "random_search", search)
    rows = Q.q_search(spark, "").collect()
    assert asked == [100] and sorted(r["trial"] for r in rows) == list(range(100)) and all(r["in_space"] and r["scored"] for r in rows)
    assert re.search(r"range\((\d+)\)", REGISTRY["hyperparameter_search"].sql).group(1) == "100"


def test_trials_share_one_staged_copy_of_the_rows(small, monkeypatch):
    from inclusio.operators import boosting as BO
    from inclusio.operators import models as MD
    staged, tables, one, two = [], [], BO.staged, MD._fold_table
    monkeypatch.setattr(BO, "staged", lambda *a: (staged.append(1), one(*a))[1])
    monkeypatch.setattr(MD, "_fold_table", lambda *a: (tables.append(1), two(*a))[1])
    weighted = small.withColumn("w", F.lit(1.0))
    got = MD.random_search(weighted, ["a", "b"], "w", n_trials=3, fixed={"maxIter": 1}).orderBy("trial").collect()
    assert [r["trial"] for r in got] == [0, 1, 2] and staged == tables == [1]


def test_large_sums_are_added_in_a_shuffle(small, monkeypatch):
    """Sums of many tasks or many nodes don't all go to the driver; the trees are the same."""
    from inclusio.operators import boosting as BO
    from inclusio.operators import models as MD
    a = MD.assemble(small.repartition(3), ["a", "b"]).withColumn("label", F.col("Target").cast("double")).cache()
    asked, summed, models = [], BO._summed, []
    monkeypatch.setattr(BO, "_summed", lambda *args: (asked.append(args[2]), summed(*args))[1])
    for most in (BO.DIRECT_BYTES, 0):
        asked.clear()
        monkeypatch.setattr(BO, "DIRECT_BYTES", most)
        models.append(BO.fit_boosted(a, 3, max_rounds=2, maxDepth=3, seed=1).to_json())
        assert all((n > BO.DIRECT_TASKS) == (most == 0) for n in asked[1:])
    assert [[t["feature"] for t in ts] for ts in models[0]["trees"]] == [[t["feature"] for t in ts] for ts in models[1]["trees"]]
