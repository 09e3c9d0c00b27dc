"""Queries for scan, cleaning and feature engineering."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config as C
from ..functions import encode as E
from ..functions import features as FX
from ..operators import clean as CL
from ..operators import engineer as EN
from ..sources import survey_view as SV
from . import sql_text as S
from .registry import r6, register

LOG_COLS = {"log_personal_income", "log_business_expenses", "log_business_turnover",
            "log_income_expense_ratio", "log_turnover_expense_ratio", "log_business_age",
            "income_expense_ratio", "turnover_expense_ratio"}

GROUPS = {
    "feat_access": ["formal_access_count", "total_products_now", "total_products_ever", "product_score_total",
                    "formal_access_score", "has_any_banking_now", "has_loan_and_banking"],
    "feat_savings": ["insurance_count", "insurance_strength", "keeps_any_records", "log_personal_income",
                     "log_business_expenses", "log_business_turnover", "income_expense_ratio",
                     "log_income_expense_ratio", "turnover_expense_ratio", "log_turnover_expense_ratio"],
    "feat_debt": ["uses_informal_now", "has_formal_loan_now", "formal_vs_informal", "is_tax_compliant",
                  "compliance_and_loan"],
    "feat_resilience": ["positive_attitude_score", "negative_attitude_score", "net_attitude_score",
                        "cash_flow_stable", "theft_risk", "covid_resilient", "resilience_score"],
    "feat_business": ["business_age_total_months", "log_business_age", "owner_age_band", "markets_actively",
                      "extends_credit"],
    "feat_interaction": ["insured_with_credit_card", "insured_with_internet_banking", "insured_with_banking",
                         "loan_and_compliant", "fully_formal", "records_and_formal", "country_x_access"],
}
RANK_COLS = [f"{c}_country_rank" for c in C.MONEY_COLS]


def _out(c: str):
    return r6(c).alias(c) if (c in LOG_COLS or c.endswith("_rank")) else F.col(c)


def _sql_out(c: str) -> str:
    return f"round({c}, 6) AS {c}" if (c in LOG_COLS or c.endswith("_rank")) else c


def cleaned(spark, sf_dir):
    """Both splits cleaned together (test rows carry a missing Target)."""
    return CL.clean_survey(SV.survey(spark, sf_dir), is_train=True)


def featured(spark, sf_dir, ranks=True):
    return EN.engineer_features(cleaned(spark, sf_dir), ranks=ranks)


# ---------------------------------------------------------------- A: sources
@register("survey_view", sql=lambda: SV.survey_cte() + "\nSELECT * FROM survey")
def q_survey_view(spark, sf_dir):
    return SV.survey(spark, sf_dir)


@register("union_splits", sql=lambda: SV.survey_cte() + """
SELECT split, count(*) AS n_rows, count(Target) AS n_target, count(DISTINCT ID) AS n_ids
FROM (SELECT ID, 'train' AS split, Target FROM survey WHERE split = 'train'
      UNION ALL SELECT ID, 'test' AS split, NULL AS Target FROM survey WHERE split = 'test') u
GROUP BY split""")
def q_union_splits(spark, sf_dir):
    train = SV.survey_split(spark, sf_dir, "train").withColumn("split", F.lit("train"))
    test = SV.survey_split(spark, sf_dir, "test").withColumn("split", F.lit("test"))
    u = train.unionByName(test, allowMissingColumns=True)
    return u.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.count(C.TARGET_COL).alias("n_target"),
                                  F.countDistinct(C.ID_COL).alias("n_ids"))


@register("split_back", sql=lambda: S.clean_cte() + """
SELECT ID, formal_access_count FROM (SELECT ID, split, """ + dict(S.feature_exprs())["formal_access_count"]
          + """ AS formal_access_count FROM clean) t WHERE split = 'test'""")
def q_split_back(spark, sf_dir):
    f = EN.feat_access(cleaned(spark, sf_dir))
    return f.filter(F.col("split") == "test").select("ID", "formal_access_count")


@register("feature_columns", sql=lambda: S.clean_cte() + """
SELECT * EXCLUDE (ID, Target, split) FROM clean""")
def q_feature_columns(spark, sf_dir):
    df = cleaned(spark, sf_dir)
    return df.select(*C.feature_columns(df.columns, drop=(C.ID_COL, C.TARGET_COL, "split")))


# ------------------------------------------------------------- B: cleaning
@register("normalise_string", sql=lambda: SV.survey_cte() + "\nSELECT ID, " + ", ".join(
    f"{S.norm(c)} AS {c}" for c, _ in SV.ANSWER_COLUMNS) + " FROM survey")
def q_normalise(spark, sf_dir):
    s = SV.survey(spark, sf_dir)
    return s.select("ID", *[E.normalise_string(c).alias(c) for c, _ in SV.ANSWER_COLUMNS])


#: Numbers as people type them, by row: padded, with a unit, empty, spelled missing, signed, in powers, clean.
DIRTY_NUMBER = """CASE CAST(substr(ID, 4) AS BIGINT) % 8
  WHEN 0 THEN '  ' || n || ' ' WHEN 1 THEN n || ' USD' WHEN 2 THEN '' WHEN 3 THEN 'NaN'
  WHEN 4 THEN '-' || n || '.25' WHEN 5 THEN n || 'e2' WHEN 6 THEN n || ',000' ELSE n END"""


@register("coerce_dirty_numeric", sql=lambda: SV.survey_cte() + f""",
n AS (SELECT ID, CAST(CAST(floor(abs(business_turnover)) AS BIGINT) AS VARCHAR) AS n FROM survey),
t AS (SELECT ID, {DIRTY_NUMBER} AS typed FROM n)
SELECT ID, typed, CASE WHEN typed = 'NaN' THEN NULL ELSE TRY_CAST(trim(typed) AS DOUBLE) END AS value FROM t""")
def q_coerce_dirty(spark, sf_dir):
    """Dirty numbers parsed; what isn't a number is missing."""
    t = (SV.survey(spark, sf_dir).selectExpr("ID", "CAST(CAST(floor(abs(business_turnover)) AS BIGINT) AS STRING) AS n")
         .selectExpr("ID", f"{DIRTY_NUMBER} AS typed"))
    return t.select("ID", "typed", E.coerce_numeric("typed").alias("value"))


def _encode_query(name, cols, fn, sqlfn):
    @register(name, sql=lambda: SV.survey_cte() + "\nSELECT ID, " +
              ", ".join(f"{sqlfn(c)} AS {c}" for c in cols) + " FROM survey")
    def q(spark, sf_dir):
        return SV.survey(spark, sf_dir).select("ID", *[fn(c).alias(c) for c in cols])
    return q


def _strip_coalesce(sql: str) -> str:
    return sql[len("COALESCE("):-len(", 0e0)")] if sql.startswith("COALESCE(") else sql


_encode_query("encode_product", C.PRODUCT_COLS, E.encode_product, lambda c: _strip_coalesce(S.clean_sql(c)))
_encode_query("encode_binary", [c for c in C.BINARY_COLS], E.encode_binary,
              lambda c: _strip_coalesce(S.clean_sql(c)))
_encode_query("encode_ternary", C.TERNARY_COLS, E.encode_ternary, S.clean_sql)
_encode_query("encode_records", ["keeps_financial_records"], E.encode_records, S.clean_sql)
_encode_query("encode_offers_credit", ["offers_credit_to_customers"], E.encode_offers_credit, S.clean_sql)
_encode_query("encode_sex", ["owner_sex"], E.encode_sex, S.clean_sql)
_encode_query("encode_country", ["country"], E.encode_country, S.clean_sql)
_encode_query("encode_target", ["Target"], E.encode_target, S.clean_sql)
_encode_query("coerce_numeric", C.NUMERIC_COLS, lambda c: E.coerce_numeric(F.col(c).cast("string")),
              lambda c: f"CAST({c} AS DOUBLE)")


@register("decode_target", sql=lambda: S.clean_cte() + """
SELECT ID, Target AS code, CASE Target WHEN 0 THEN 'Low' WHEN 1 THEN 'Medium' WHEN 2 THEN 'High' END AS label
FROM clean WHERE split = 'train'""")
def q_decode(spark, sf_dir):
    c = cleaned(spark, sf_dir).filter(F.col("split") == "train")
    return c.select("ID", F.col("Target").alias("code"), E.decode_target("Target").alias("label"))


@register("impute_constants", sql=lambda: S.clean_cte() + "\nSELECT " + ", ".join(
    [f"count_if({c} IS NULL) AS {c}_nulls" for c in C.PRODUCT_COLS + ["has_insurance"]]) + " FROM clean")
def q_impute(spark, sf_dir):
    c = cleaned(spark, sf_dir)
    return c.agg(*[F.count_if(F.col(x).isNull()).alias(f"{x}_nulls") for x in C.PRODUCT_COLS + ["has_insurance"]])


@register("clean_survey", sql=lambda: S.clean_cte() + "\nSELECT * FROM clean")
def q_clean(spark, sf_dir):
    return cleaned(spark, sf_dir)


@register("missing_flags", sql=lambda: S.clean_cte() + """,
per_split AS (
  SELECT split, name AS column_name, pos AS column_pos, count(*) AS n_rows,
         CAST(sum(CASE WHEN is_missing THEN 1 ELSE 0 END) AS BIGINT) AS n_missing
  FROM (SELECT split, unnest([""" + ", ".join(f"'{c}'" for c in S.SURVEY_SELECT_COLS[2:-1]) + """]) AS name,
               unnest(range(0, """ + str(len(S.SURVEY_SELECT_COLS) - 3) + """)) AS pos,
               unnest([""" + ", ".join(f"{c} IS NULL" for c in S.SURVEY_SELECT_COLS[2:-1]) + """]) AS is_missing
        FROM clean) t
  GROUP BY split, name, pos)
SELECT split, column_name, column_pos, n_rows, n_missing, n_missing / n_rows AS missing_rate,
       CAST(n_missing / n_rows > 0.2e0 AS BIGINT) AS flagged
FROM per_split""")
def q_missing_flags(spark, sf_dir):
    """Per split (as the reference): missing count, rate and whether a flag is added.
    One aggregate grouped by split over the feature columns."""
    c = cleaned(spark, sf_dir)
    feats = [x for x in c.columns if x not in (C.ID_COL, C.TARGET_COL, "split")]
    r = CL.missing_rates(c, by=["split"], columns=feats)
    return r.select("split", "column_name", "column_pos", "n_rows", "n_missing", "missing_rate",
                    (F.col("missing_rate") > C.MISSING_FLAG_RATE).cast("bigint").alias("flagged"))


# ------------------------------------------------------------- C: features
def _feat_query(name):
    cols = GROUPS[name]

    @register(name, sql=lambda: S.features_cte() + "\nSELECT ID, " + ", ".join(_sql_out(c) for c in cols)
              + " FROM feat")
    def q(spark, sf_dir):
        fn = getattr(EN, name)
        return fn(cleaned(spark, sf_dir)).select("ID", *[_out(c) for c in cols])
    return q


for _g in GROUPS:
    _feat_query(_g)


@register("country_pct_rank", sql=lambda: S.features_cte() + "\nSELECT ID, " +
          ", ".join(_sql_out(c) for c in RANK_COLS) + " FROM feat")
def q_rank(spark, sf_dir):
    return EN.country_pct_rank(cleaned(spark, sf_dir)).select("ID", *[_out(c) for c in RANK_COLS])


ALL_FEATURES = [c for g in GROUPS.values() for c in g] + RANK_COLS


@register("engineer_features", sql=lambda: S.features_cte() + "\nSELECT * EXCLUDE (" +
          ", ".join(sorted(LOG_COLS) + RANK_COLS) + "), " +
          ", ".join(_sql_out(c) for c in sorted(LOG_COLS) + RANK_COLS) + " FROM feat", bench=True)
def q_engineer(spark, sf_dir):
    f = featured(spark, sf_dir)
    plain = [c for c in f.columns if c not in LOG_COLS and c not in RANK_COLS]
    return f.select(*plain, *[_out(c) for c in sorted(LOG_COLS) + RANK_COLS])


@register("profit_margin", sql=lambda: SV.survey_cte() + """
SELECT ID, round(CASE WHEN personal_income IS NOT NULL AND business_expenses IS NOT NULL AND personal_income <> 0
  THEN greatest(-1e0, least(1e0, (personal_income - business_expenses) / personal_income)) END, 6) AS profit_margin
FROM survey""")
def q_profit_margin(spark, sf_dir):
    return SV.survey(spark, sf_dir).select("ID", r6(FX.profit_margin()).alias("profit_margin"))


@register("financial_access_score", sql=lambda: SV.survey_cte() + "\nSELECT ID, round(CASE WHEN (" +
          " + ".join(f"CAST({c} IS NOT NULL AS INTEGER)" for c in C.ACCESS_SCORE_COLS) + ") > 0 THEN (" +
          " + ".join(f"CASE WHEN {c} IN ('Yes', 'Have now', 'have now') THEN 1e0 WHEN {c} IN "
                     f"('Used to have but don''t have now', 'used to have') THEN 0.5e0 ELSE 0e0 END"
                     for c in C.ACCESS_SCORE_COLS) + ") / (" +
          " + ".join(f"CAST({c} IS NOT NULL AS INTEGER)" for c in C.ACCESS_SCORE_COLS) +
          ") END, 6) AS financial_access_score FROM survey")
def q_access_score(spark, sf_dir):
    return SV.survey(spark, sf_dir).select("ID", r6(FX.financial_access_score()).alias("financial_access_score"))


@register("mask_filters", sql=lambda: S.clean_cte() + """
SELECT ID, country, Target FROM clean
WHERE split = 'train' AND country = 3 AND Target = 2 AND Target IS NOT NULL""")
def q_mask(spark, sf_dir):
    c = cleaned(spark, sf_dir)
    return (c.filter((F.col("split") == "train") & (F.col("country") == 3) & (F.col("Target") == 2))
            .select("ID", "country", "Target").dropna(subset=["Target"]))


@register("country_summary", sql=lambda: S.features_cte() + """
SELECT country, count(*) AS n_rows,
       round(avg(formal_access_count), 6) AS avg_formal_access_count,
       round(avg(resilience_score), 6) AS avg_resilience_score,
       count(Target) AS n_train,
       round(avg(CASE WHEN Target IS NOT NULL THEN CAST(Target = 2 AS INTEGER) END), 6) AS high_rate
FROM feat GROUP BY country""", bench=True)
def q_country_summary(spark, sf_dir):
    """Flagship: features over both splits, then per-country access, resilience, High rate."""
    return summarise_by_country(featured(spark, sf_dir, ranks=False))


def summarise_by_country(f):
    return f.groupBy("country").agg(
        F.count(F.lit(1)).alias("n_rows"),
        r6(F.avg("formal_access_count")).alias("avg_formal_access_count"),
        r6(F.avg("resilience_score")).alias("avg_resilience_score"),
        F.count("Target").alias("n_train"),
        r6(F.avg(F.when(F.col("Target").isNotNull(), (F.col("Target") == 2).cast("int")))).alias("high_rate"))
