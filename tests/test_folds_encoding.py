"""Folds, class weights and target encoding: properties and a leak test."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from inclusio.operators import folds as FO
from inclusio.operators import target_encoding as TE
from inclusio.operators.ranking import exclusive_prefix_sum


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(3)
    n = 600
    # one hot stratum holds most rows (skew), one tiny stratum has 2 rows
    y = rng.choice([0, 1, 2], size=n, p=[0.7, 0.25, 0.05])
    y[:2] = 2
    a = rng.choice([0.0, 1.0, 2.0, None], size=n)
    b = rng.choice([0.0, 1.0, 3.0], size=n)
    rows = [(f"id{i}", i, int(y[i]), None if a[i] is None else float(a[i]), float(b[i])) for i in range(n)]
    return spark.createDataFrame(rows, "ID string, k bigint, Target bigint, a double, b double")


def test_prefix_sum_matches_brute_force(spark, labelled):
    out = exclusive_prefix_sum(labelled.withColumn("w", F.col("k") % 7), ["Target"], ["k"], "w",
                               num_partitions=5).toPandas()
    pdf = labelled.withColumn("w", F.col("k") % 7).toPandas().sort_values("k")
    pdf["exp"] = pdf.groupby("Target")["w"].cumsum() - pdf["w"]
    m = out.merge(pdf[["ID", "exp"]], on="ID")
    assert (m["_before"] == m["exp"]).all()
    assert (m["_group_total"] == m.groupby("Target")["w"].transform("sum")).all()


def test_fold_balance(spark, labelled):
    out = FO.stratified_folds(labelled, "Target", n_folds=5).toPandas()
    assert len(out) == 600 and out["ID"].is_unique
    sizes = out.groupby(["Target", "fold"]).size().unstack(fill_value=0)
    assert ((sizes.max(axis=1) - sizes.min(axis=1)) <= 1).all()
    tot = out.groupby("fold").size()
    assert tot.max() - tot.min() <= 1


def test_fold_deterministic(spark, labelled):
    a = FO.stratified_folds(labelled, "Target").orderBy("ID").select("fold").collect()
    b = FO.stratified_folds(labelled.repartition(7), "Target").orderBy("ID").select("fold").collect()
    assert a == b


def test_class_weights(spark, labelled):
    w = {r["Target"]: r["weight"] for r in FO.class_weights(labelled).collect()}
    counts = labelled.groupBy("Target").count().toPandas().set_index("Target")["count"]
    for c, n in counts.items():
        assert abs(w[c] - 600 / (3 * n)) < 1e-12


def test_stratified_split_share(spark, labelled):
    out = FO.stratified_split(labelled, "Target", ["k"], 0.2).toPandas()
    for _, g in out.groupby("Target"):
        assert g["is_holdout"].sum() == int(np.ceil(0.2 * len(g)))


def _pandas_fit(pdf, cols, s=10.0):
    out = {}
    for col in cols:
        for cls in range(3):
            t = (pdf["Target"] == cls).astype(float)
            g = t.mean()
            st = pd.DataFrame({"v": pdf[col], "t": t}).groupby("v")["t"].agg(["count", "mean"])
            sm = (st["count"] * st["mean"] + s * g) / (st["count"] + s)
            for v, e in sm.items():
                out[(col, float(v), cls)] = e
    return out


def test_fit_matches_pandas(spark, labelled):
    enc, g = TE.fit(labelled, ["a", "b"])
    exp = _pandas_fit(labelled.toPandas(), ["a", "b"])
    got = {(r["column_name"], r["value"], c): r[f"enc_{c}"] for r in enc.collect() for c in range(3)}
    assert set(got) == set(exp)
    assert all(abs(got[k] - exp[k]) < 1e-12 for k in exp)


def test_literal_and_join_paths_agree(spark, labelled):
    enc, g = TE.fit(labelled, ["a", "b"])
    lit = TE.transform(labelled, enc, g, ["a", "b"]).orderBy("ID").toPandas()
    join = TE.transform(labelled, enc, g, ["a", "b"], broadcast_limit=0).orderBy("ID").toPandas()
    cols = TE.encoded_columns(["a", "b"])
    assert np.allclose(lit[cols].to_numpy(), join[cols].to_numpy(), atol=1e-12)
    # missing value -> global share
    miss = lit[lit["a"].isna()]
    gl = g.first()
    assert np.allclose(miss["a_te_0"], gl["g0"])


def test_oof_equals_refit_and_does_not_leak(spark, labelled):
    d = FO.stratified_folds(labelled, "Target", n_folds=4)
    enc, g = TE.fit_out_of_fold(d, "fold", ["a", "b"], n_folds=4)
    oof = TE.transform(d, enc, g, ["a", "b"], fold_col="fold").orderBy("ID").toPandas()
    joinp = TE.transform(d, enc, g, ["a", "b"], fold_col="fold", broadcast_limit=0).orderBy("ID").toPandas()
    cols = TE.encoded_columns(["a", "b"])
    assert np.allclose(oof[cols].to_numpy(), joinp[cols].to_numpy(), atol=1e-12)
    pdf = d.toPandas()
    for f in range(4):
        exp = _pandas_fit(pdf[pdf["fold"] != f], ["a", "b"])
        part = oof[oof["fold"] == f]
        for _, r in part.iterrows():
            if r["b"] == r["b"] and ("b", float(r["b"]), 0) in exp:
                assert abs(r["b_te_0"] - exp[("b", float(r["b"]), 0)]) < 1e-12
    # leak test: permuting fold 0's labels leaves fold 0's encodings unchanged
    shuffled = d.withColumn("Target", F.when(F.col("fold") == 0, (F.col("Target") + 1) % 3)
                            .otherwise(F.col("Target")))
    enc2, g2 = TE.fit_out_of_fold(shuffled, "fold", ["a", "b"], n_folds=4)
    oof2 = TE.transform(shuffled, enc2, g2, ["a", "b"], fold_col="fold").orderBy("ID").toPandas()
    f0 = oof["fold"] == 0
    assert np.allclose(oof.loc[f0, cols].to_numpy(), oof2.loc[f0, cols].to_numpy(), atol=1e-12)
    assert not np.allclose(oof.loc[~f0, cols].to_numpy(), oof2.loc[~f0, cols].to_numpy())


def test_many_strata_path_matches(spark, labelled, monkeypatch):
    a = FO.stratified_folds(labelled, "Target", n_folds=5).orderBy("ID").select("ID", "fold").collect()
    monkeypatch.setattr(FO, "LITERAL_STRATA", 0)
    b = FO.stratified_folds(labelled, "Target", n_folds=5).orderBy("ID").select("ID", "fold").collect()
    assert a == b


def test_hot_group_is_split_across_slices(spark):
    """One group holding 90 % of the rows is range-partitioned over many tasks."""
    rows = [(0 if i % 10 else 1, i) for i in range(20000)]
    df = spark.createDataFrame(rows, "g int, k bigint")
    ranged = df.repartitionByRange(8, "g", "k").withColumn("pid", F.spark_partition_id())
    slices = ranged.where("g = 0").select("pid").distinct().count()
    assert slices >= 6
    out = exclusive_prefix_sum(df, ["g"], ["k"], num_partitions=8).where("g = 0")
    got = out.agg(F.min("_before"), F.max("_before"), F.countDistinct("_before")).first()
    assert (got[0], got[1], got[2]) == (0, 17999, 18000)


def _odd_rows(spark, extra):
    """300 rows: missing labels and order values, every id twice, some rows wholly equal."""
    rows = [(f"r{i // 2}", None if i % 3 == 0 else i % 2, None if i % 10 == 0 else i % 50, i // 4) for i in range(300)]
    df = spark.createDataFrame(rows, "ID string, Target int, k int, z int")
    return df.select("*", *[F.lit(j).alias(f"x{j}") for j in range(extra)])


@pytest.mark.parametrize("extra", [0, 8])
@pytest.mark.parametrize("order", [None, ["k"]])
def test_folds_keep_every_row_once(spark, extra, order):
    df = _odd_rows(spark, extra)
    out = FO.stratified_folds(df, "Target", order, 5)
    assert out.columns == [*df.columns, "fold"]
    assert out.drop("fold").exceptAll(df).isEmpty() and df.exceptAll(out.drop("fold")).isEmpty()
    sizes = out.groupBy("Target", "fold").count().collect()
    for label in (None, 0, 1):
        n = [r["count"] for r in sizes if r["Target"] == label]
        assert len(n) == 5 and max(n) - min(n) <= 1
    again = FO.stratified_folds(df.repartition(7), "Target", order, 5)
    assert out.exceptAll(again).isEmpty()


@pytest.mark.parametrize("extra", [0, 8])
def test_split_keeps_every_row_once(spark, extra):
    df = _odd_rows(spark, extra)
    out = FO.stratified_split(df, "Target", ["k"], 0.2)
    assert out.drop("is_holdout").exceptAll(df).isEmpty() and out.count() == 300
    assert {r["Target"]: r["s"] for r in out.groupBy("Target").agg(F.sum("is_holdout").alias("s")).collect()} == {None: 20, 0: 20, 1: 20}


def test_many_strata_give_the_folds_of_few(spark, monkeypatch):
    df = _odd_rows(spark, 1)
    few = FO.stratified_folds(df, "z", ["k"], 4)
    monkeypatch.setattr(FO, "LITERAL_STRATA", 10)  # 75 strata: offsets by a join
    many = FO.stratified_folds(df, "z", ["k"], 4)
    assert few.exceptAll(many).isEmpty() and many.count() == 300


def test_quantiles_of_a_missing_group(spark):
    from inclusio.operators.quantiles import exact_quantiles
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 2.0), ("a", None)], "g string, v double")
    assert {r["g"]: r["m"] for r in exact_quantiles(df, ["g"], "v", {"m": 0.5}).collect()} == {None: 2.0, "a": 2.0}


def test_string_keys_and_empty_folds_are_encoded(spark):
    from inclusio.operators import target_encoding as TE
    df = spark.createDataFrame([("a'b", 0, 0), ("a'b", 1, 0), ("c\\d", 2, 0), (None, 1, 0), ("new", None, 1)], "s string, Target int, fold bigint")
    enc, g = TE.fit(df, ["s"])
    out = {r["s"]: r for r in TE.transform(df, enc, g, ["s"]).collect()}
    assert out["a'b"]["s_te_0"] == pytest.approx((1 + TE.C.TE_SMOOTHING * 0.25) / (2 + TE.C.TE_SMOOTHING))
    assert out["new"]["s_te_1"] == out[None]["s_te_1"] == pytest.approx(0.5)
    joined = {r["s"]: r for r in TE.transform(df, enc, g, ["s"], broadcast_limit=0).collect()}
    assert joined == out
    # every labelled row in one fold: nothing to encode that fold with
    enc, g = TE.fit_out_of_fold(df, "fold", ["s"], n_folds=2)
    assert all(r["s_te_0"] is None for r in TE.transform(df, enc, g, ["s"], fold_col="fold").where("fold = 0").collect())
    enc, g = TE.fit(df.where("Target IS NULL"), ["s"])
    assert all(r["s_te_0"] is None for r in TE.transform(df, enc, g, ["s"]).collect())


def test_one_join_serves_all_encoded_columns(spark, labelled):
    """Columns of many values are looked up in buckets of the packed dictionary, in one broadcast."""
    from inclusio.operators import target_encoding as TE
    many = spark.range(3000).selectExpr("id AS ID", "CAST(id % 997 AS DOUBLE) AS a", "CAST(id % 3 AS DOUBLE) AS b", "CAST(id % 4 % 3 AS INT) AS Target", "id % 5 AS fold")
    enc, g = TE.fit_out_of_fold(many, "fold", ["a", "b"], n_folds=5)
    packed = TE.transform(many, enc, g, ["a", "b"], fold_col="fold")
    joins = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Join")
    assert joins(packed) == joins(TE.transform(many, enc, g, ["a"], fold_col="fold"))  # whatever the number of columns
    joined = TE.transform(many, enc, g, ["a", "b"], fold_col="fold", broadcast_limit=0)
    assert sorted(packed.collect()) == sorted(joined.collect())


def test_single_column_rank_equals_the_stacked_form(spark):
    from inclusio.operators import ranking as RK
    rows = [("u", 1.0, 5), ("u", 1.0, 5), ("u", None, 1), (None, 3.0, 2), ("v", -2.0, 2), ("u", 7.5, 9), ("v", 4.0, 4)]
    df = spark.createDataFrame(rows, "k string, x double, g int")
    one = RK.pct_rank_column(df, "k", "x", "r")
    many = RK.pct_rank_columns(df, "k", {"r": "x"})
    assert one.columns == ["k", "x", "g", "r"] and sorted(map(str, one.collect())) == sorted(map(str, many.collect()))
