"""Profiling reports and submission checks on small frames."""

import numpy as np
from pyspark.sql import functions as F

from inclusio.operators import metrics as M
from inclusio.operators import profile as P
from inclusio.sources import io as IO


def test_histogram_last_bin_closed(spark):
    df = spark.createDataFrame([(float(x),) for x in [0, 1, 2, 3, 29.9, 30]] + [(None,)], "x double")
    h = {r["bin"]: r["n"] for r in P.histogram(df, ["x"], bins=30).collect()}
    assert sum(h.values()) == 6
    assert h[29] == 2 and h[0] == 1 and max(h) == 29


def test_histogram_constant_column(spark):
    df = spark.createDataFrame([(5.0,)] * 4, "x double")
    assert [(r["bin"], r["n"]) for r in P.histogram(df, ["x"]).collect()] == [(0, 4)]


def test_missing_profile_and_cardinality(spark):
    df = spark.createDataFrame([("a", None), ("b", 1.0), (None, 2.0), ("a", None)], "s string, v double")
    mp = {r["column_name"]: (r["n_missing"], r["pct_missing"]) for r in P.missing_profile(df).collect()}
    assert mp == {"s": (1, 25.0), "v": (2, 50.0)}
    card = {r["column_name"]: r["n_distinct"] for r in P.cardinality(df, ["s"]).collect()}
    assert card == {"s": 2}


def test_value_proportions_domain_zero(spark):
    df = spark.createDataFrame([("Low",), ("Low",), ("High",)], "Target string")
    r = {x["value"]: (x["n"], x["share"]) for x in
         P.value_proportions(df, "Target", domain=["Low", "Medium", "High"]).collect()}
    assert r["Medium"] == (0, 0.0) and r["Low"][0] == 2 and abs(r["High"][1] - 1 / 3) < 1e-12


def test_validate_submission(spark):
    sample = spark.createDataFrame([("a",), ("b",), ("c",)], "ID string")
    sub = spark.createDataFrame([("a", "Low"), ("b", "Bad"), ("d", "High")], "ID string, Target string")
    r = IO.validate_submission(sub, sample).first()
    assert (r["n_rows"], r["n_expected"], r["bad_labels"], r["missing_ids"], r["extra_ids"], r["columns_ok"]) == \
        (3, 3, 1, 1, 1, 1)


def test_classification_report_values(spark):
    y = [0, 0, 1, 1, 2, 2, 2]
    p = [0, 1, 1, 1, 2, 0, 2]
    df = spark.createDataFrame(list(zip(y, p)), "y int, pred int")
    rep = {r["label"]: r for r in M.classification_report(df).collect()}
    assert abs(rep["Low"]["precision"] - 0.5) < 1e-12 and abs(rep["Low"]["recall"] - 0.5) < 1e-12
    assert abs(rep["Medium"]["precision"] - 2 / 3) < 1e-12 and rep["Medium"]["recall"] == 1.0
    assert rep["High"]["support"] == 3 and abs(rep["accuracy"]["f1"] - 5 / 7) < 1e-12
    f1 = np.array([rep[k]["f1"] for k in ("Low", "Medium", "High")])
    assert abs(rep["macro avg"]["f1"] - f1.mean()) < 1e-12
    assert abs(rep["weighted avg"]["f1"] - (f1 * [2, 2, 3]).sum() / 7) < 1e-12


def test_boundary_and_missed(spark):
    df = spark.createDataFrame([(1, 0), (1, 0), (0, 1), (2, 0), (2, 1), (2, 2)], "y int, pred int")
    b = M.boundary_confusion(df).first()
    assert b["medium_as_low"] == 2 and b["medium_as_low_rate"] == 1.0 and b["low_as_medium"] == 1
    m = M.missed_class_report(df).first()
    assert (m["n_true"], m["n_correct"], m["missed_as_low"], m["missed_as_medium"]) == (3, 1, 1, 1)


def test_sketches_of_parts_unite_to_those_of_all_rows(spark):
    from inclusio.operators import profile as P
    rows = spark.range(20_000).selectExpr("id % 7 AS day", "CAST(id % 6000 AS STRING) AS s", "CAST(NULL AS STRING) AS none", "CAST((id * 7919) % 10007 AS DOUBLE) AS x")
    parts = P.cardinality_sketches(rows, ["s", "none"], ["day"])
    assert parts.count() == 7  # a column without values has no sketch
    got = {r["column_name"]: r["n_distinct"] for r in P.merged_cardinality(parts, ["s", "none"]).collect()}
    once = {r["column_name"]: r["n_distinct"] for r in P.merged_cardinality(P.cardinality_sketches(rows, ["s", "none"], []), ["s", "none"]).collect()}
    assert got == once and got["none"] == 0 and abs(got["s"] - 6000) <= 120
    # a new day is united with the held sketches; no earlier row is read
    more = P.cardinality_sketches(spark.range(1000).selectExpr("7 AS day", "concat('new', id) AS s", "CAST(NULL AS STRING) AS none"), ["s", "none"], ["day"])
    grown = {r["column_name"]: r["n_distinct"] for r in P.merged_cardinality(parts.unionByName(more), ["s", "none"]).collect()}
    assert abs(grown["s"] - 7000) <= 140
    q = P.merged_quantiles(P.quantile_sketches(rows, ["x"], ["day"]), ["x"], {"p10": 0.1, "p50": 0.5}).first()
    values = sorted(r["x"] for r in rows.select("x").collect())
    assert q["n"] == 20_000 and all(abs(sum(v < q[c] for v in values) / 20_000 - p) < 0.01 for c, p in (("p10", 0.1), ("p50", 0.5)))
    by = P.merged_quantiles(P.quantile_sketches(rows, ["x"], ["day"]), ["x"], {"p50": 0.5}, ["day"])
    assert by.count() == 7


def test_category_codes_of_all_columns(spark):
    from inclusio.operators import clean as CL
    train = spark.createDataFrame([("b", "y"), ("a", None), ("b", "x"), (None, None)], "s string, t string")
    test = spark.createDataFrame([(1, "a", "x"), (2, "z", None), (3, None, "y")], "i int, s string, t string")
    codes = CL.category_codes(train, ["s", "t"])
    assert {tuple(r) for r in codes.collect()} == {("s", "a", 0), ("s", "b", 1), ("t", "x", 0), ("t", "y", 1)}
    coded, names = CL.with_category_codes(test, codes, ["s", "t"])
    assert names == ["s_idx", "t_idx"] and coded.columns == ["i", "s", "t", "s_idx", "t_idx"]
    assert {r["i"]: (r["s_idx"], r["t_idx"]) for r in coded.collect()} == {1: (0, 0), 2: (2, 2), 3: (2, 1)}
    nothing = CL.category_codes(train.limit(0), ["s", "t"])
    assert {r["s_idx"] for r in CL.with_category_codes(test, nothing, ["s", "t"])[0].collect()} == {0}


def test_bucketed_tables_are_joined_without_a_shuffle(spark):
    import __spark_entry__ as E
    from conftest import SF_SMALL
    joined = E.queries()["bucketed_align"](spark, SF_SMALL)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert sorted(map(str, joined.collect())) == sorted(map(str, E.queries()["keyed_align"](spark, SF_SMALL).collect()))


def test_every_sql_text_is_parsed():
    import __spark_entry__ as E
    import duckdb
    con, bad = duckdb.connect(), {}
    for key, sql in E.oracle_sql().items():
        try:
            assert len(con.extract_statements(sql)) == 1
        except Exception as e:  # noqa: BLE001
            bad[key] = str(e)[:200]
    assert bad == {} and set(E.oracle_sql()) <= set(E.queries())
