"""Cleaning and encoding: the reference's preprocessing cases as Spark checks."""

import math

import pytest
from pyspark.sql import functions as F

from conftest import col_values
from inclusio import config as C
from inclusio.sources.survey_view import RAW_COLUMNS
from inclusio.functions import encode as E
from inclusio.operators import clean as CL


class TestNormaliseString:
    def test_cases(self, spark):
        got = col_values(spark, E.normalise_string,
                         ["YES", "  No  ", "Don’t know", "Don?t know", "Do not know / N‎/A", None,
                          "No ‎"])
        assert got[0] == "yes"
        assert got[1] == "no"
        assert got[2] == "don't know" and "’" not in got[2]
        assert got[3] == "don't know"
        assert "‎" not in got[4]
        assert got[5] is None
        # strip happens before the mark is removed: the space stays
        assert got[6] == "no "


class TestEncoders:
    def test_product(self, spark):
        got = col_values(spark, E.encode_product, ["Have now", "Used to have but don't have now", "Never had",
                                                   "Don't know", None, " HAVE NOW ",
                                                   "Used to have but don’t have now"])
        assert got[:3] == [2.0, 1.0, 0.0]
        assert got[3] is None and got[4] is None
        assert got[5] == 2.0 and got[6] == 1.0

    def test_binary(self, spark):
        got = col_values(spark, E.encode_binary, ["Yes", "No", "YES", "NO", "Don't know", None])
        assert got == [1.0, 0.0, 1.0, 0.0, None, None]

    def test_ternary(self, spark):
        got = col_values(spark, E.encode_ternary, ["Yes", "No", "0", "1", "Don't know", "Don't know or N/A",
                                                   "Refused", "Don't Know", None])
        assert got[:4] == [1.0, 0.0, 0.0, 1.0]
        assert all(v is None for v in got[4:])

    def test_records_order(self, spark):
        got = col_values(spark, E.encode_records, ["Yes, always", "Yes, sometimes", "Yes", "No"])
        assert got == [3.0, 2.0, 1.0, 0.0]

    def test_offers_credit(self, spark):
        got = col_values(spark, E.encode_offers_credit, ["Yes, always", "Yes, sometimes", "No", "Yes"])
        assert got == [2.0, 1.0, 0.0, None]

    def test_sex(self, spark):
        assert col_values(spark, E.encode_sex, ["Male", "Female", "MALE", "FEMALE"]) == [1.0, 0.0, 1.0, 0.0]

    def test_country(self, spark):
        got = col_values(spark, E.encode_country, ["eswatini", "lesotho", "malawi", "zimbabwe", "Eswatini",
                                                   " eswatini", None])
        assert got[:4] == [3.0, 0.0, 1.0, 1.0]
        assert got[0] == max(got[:4]) and got[1] == min(got[:4])
        assert got[4] == 3.0 and got[5] is None and got[6] is None

    def test_target_round_trip(self, spark):
        got = col_values(spark, E.encode_target, ["Low", "Medium", "High", "high", None])
        assert got == [0, 1, 2, None, None]
        assert col_values(spark, E.decode_target, [0, 1, 2, None], "bigint") == ["Low", "Medium", "High", None]

    def test_coerce_numeric(self, spark):
        got = col_values(spark, E.coerce_numeric, ["12", " 3.5 ", "1e3", "abc", "12d", "0x1p3", "nan", "", None])
        assert got[:3] == [12.0, 3.5, 1000.0]
        assert all(v is None for v in got[3:])


# one made-up answer sheet: every kind of answer at least once
ANSWERS = {"Have now": ["has_mobile_money", "funeral_insurance"], "Used to have but don't have now": ["has_loan_account", "medical_insurance"],
           "Never had": ["motor_vehicle_insurance", "has_credit_card", "has_internet_banking", "has_debit_card", "uses_friends_family_savings", "uses_informal_lender"],
           "Yes": ["has_cellphone", "future_risk_theft_stock", "covid_essential_service", "attitude_worried_shutdown", "compliance_income_tax"],
           "Don't know": ["perception_insurance_important", "problem_sourcing_money"]}
RAW_ROW = {"ID": "ID_7", "country": "Malawi", "owner_age": "52", "personal_income": "640.5", "business_expenses": "75", "business_turnover": "1200",
           "business_age_years": "3", "business_age_months": "0", **{c: a for a, cols in ANSWERS.items() for c in cols},
           "keeps_financial_records": "Yes, sometimes", "offers_credit_to_customers": "No", "owner_sex": "Male", "Target": "Medium"}
RAW_ROW |= {c: "No" for c in RAW_COLUMNS if c not in RAW_ROW}


@pytest.fixture(scope="module")
def raw_row(spark):
    cols = list(RAW_ROW)
    return spark.createDataFrame([tuple(RAW_ROW[c] for c in cols)], ", ".join(f"{c} string" for c in cols))


class TestClean:
    def test_values(self, spark, raw_row):
        r = CL.clean_survey(raw_row, True).first().asDict()
        assert r["Target"] == C.TARGET_MAP["Medium"]
        assert r["motor_vehicle_insurance"] == 0 and r["has_mobile_money"] == 2 and r["has_loan_account"] == 1
        assert r["has_cellphone"] == 1 and r["country"] == 1 and r["has_insurance"] == 0
        assert r["keeps_financial_records"] == 2 and r["offers_credit_to_customers"] == 0
        assert r["owner_sex"] == 1 and r["owner_age"] == 52.0 and r["personal_income"] == 640.5
        assert r["ID"] == "ID_7"

    def test_no_strings_but_id(self, raw_row):
        out = CL.clean_survey(raw_row, True)
        assert [c for c, t in out.dtypes if t == "string"] == ["ID"]
        assert out.columns == raw_row.columns

    def test_products_imputed(self, spark, raw_row):
        r = raw_row.withColumn("has_loan_account", F.lit(None).cast("string")) \
                   .withColumn("has_insurance", F.lit("Don't know"))
        out = CL.clean_survey(r, True).first()
        assert out["has_loan_account"] == 0.0 and out["has_insurance"] == 0.0

    def test_attitudes_not_imputed(self, spark, raw_row):
        r = raw_row.withColumn("attitude_worried_shutdown", F.lit("Refused"))
        assert CL.clean_survey(r, True).first()["attitude_worried_shutdown"] is None


class TestMissingFlags:
    def _frame(self, spark, n_missing):
        rows = [(i, None if i < n_missing else float(i)) for i in range(10)]
        return spark.createDataFrame(rows, "ID bigint, some_col double")

    def test_30_percent_flagged(self, spark):
        out = CL.add_missing_flags(self._frame(spark, 3))
        assert "some_col_missing" in out.columns

    def test_10_percent_not_flagged(self, spark):
        assert "some_col_missing" not in CL.add_missing_flags(self._frame(spark, 1)).columns

    def test_20_percent_boundary_not_flagged(self, spark):
        assert "some_col_missing" not in CL.add_missing_flags(self._frame(spark, 2)).columns

    def test_flag_matches_mask(self, spark):
        out = CL.add_missing_flags(self._frame(spark, 5)).orderBy("ID").collect()
        assert all(r["some_col_missing"] == int(r["some_col"] is None) for r in out)
        assert set(r["some_col_missing"] for r in out) == {0, 1}

    def test_align_columns(self, spark):
        df = self._frame(spark, 0)
        out = CL.align_columns(df, ["ID", "other", "some_col"], {"other": "double"})
        assert out.columns == ["ID", "other", "some_col"]
        assert out.where(F.col("other").isNotNull()).count() == 0


def test_scan_csv_na_tokens(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text("ID,a\n1,NA\n2,n/a\n3,#N/A\n4,ok\n5,\n6,null\n")
    out = __import__("inclusio.sources.io", fromlist=["x"]).scan_csv(spark, str(p), columns=["ID", "a"])
    vals = [r["a"] for r in out.orderBy(F.col("ID").cast("int")).collect()]
    assert vals == [None, None, None, "ok", None, None]
    assert not any(isinstance(v, float) and math.isnan(v) for v in vals)
