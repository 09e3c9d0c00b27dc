"""Portable SQL text for the oracle side (DuckDB runs it on the same parquet).

Written independently of the DataFrame code: same semantics, plain SQL.
Doubles are written as ``1e0`` (DuckDB reads ``1.0`` as DECIMAL).
"""

from __future__ import annotations

from .. import config as C
from ..sources.survey_view import survey_cte


def d(x) -> str:
    """Double literal."""
    return f"CAST({x!r} AS DOUBLE)" if not isinstance(x, str) else f"CAST({x} AS DOUBLE)"


def norm(c: str) -> str:
    return (f"translate(lower(regexp_replace(regexp_replace({c}, '^\\s+', ''), '\\s+$', '')), "
            "'’?‎', '''''')")


def clean_sql(c: str, is_train: bool = True) -> str:
    n = norm(c)
    if c == C.TARGET_COL:
        return ("CAST(CASE Target WHEN 'Low' THEN 0 WHEN 'Medium' THEN 1 WHEN 'High' THEN 2 END AS BIGINT)"
                if is_train else c)
    if c == "country":
        return ("CASE lower(country) WHEN 'eswatini' THEN 3e0 WHEN 'zimbabwe' THEN 1e0 "
                "WHEN 'malawi' THEN 1e0 WHEN 'lesotho' THEN 0e0 END")
    if c in C.PRODUCT_COLS:
        return (f"COALESCE(CASE WHEN {n} LIKE '%used to have%' THEN 1e0 WHEN {n} LIKE '%have now%' THEN 2e0 "
                f"WHEN {n} LIKE '%never had%' THEN 0e0 END, 0e0)")
    if c in C.BINARY_COLS:
        e = f"CASE WHEN {n} = 'yes' THEN 1e0 WHEN {n} = 'no' THEN 0e0 END"
        return f"COALESCE({e}, 0e0)" if c == "has_insurance" else e
    if c in C.TERNARY_COLS:
        return f"CASE WHEN {n} IN ('yes', '1') THEN 1e0 WHEN {n} IN ('no', '0') THEN 0e0 END"
    if c == "keeps_financial_records":
        return (f"CASE WHEN {n} LIKE '%always%' THEN 3e0 WHEN {n} LIKE '%sometimes%' THEN 2e0 "
                f"WHEN {n} = 'yes' THEN 1e0 WHEN {n} = 'no' THEN 0e0 END")
    if c == "offers_credit_to_customers":
        return (f"CASE WHEN {n} LIKE '%always%' THEN 2e0 WHEN {n} LIKE '%sometimes%' THEN 1e0 "
                f"WHEN {n} = 'no' THEN 0e0 END")
    if c == "owner_sex":
        return f"CASE WHEN {n} = 'male' THEN 1e0 WHEN {n} = 'female' THEN 0e0 END"
    if c in C.NUMERIC_COLS:
        return f"CAST({c} AS DOUBLE)"
    return c


SURVEY_SELECT_COLS = ["ID", "split", "country"] + C.NUMERIC_COLS + C.PRODUCT_COLS + C.BINARY_COLS + \
    C.TERNARY_COLS + ["keeps_financial_records", "offers_credit_to_customers", "owner_sex", C.TARGET_COL]


def clean_cte() -> str:
    """``survey`` (raw) and ``clean`` (encoded, both splits) CTEs."""
    cols = ", ".join(f"{clean_sql(c)} AS {c}" for c in SURVEY_SELECT_COLS)
    return survey_cte() + f",\nclean AS (SELECT {cols} FROM survey)"


# --- composite features -----------------------------------------------------

def _flag(cond: str) -> str:
    return f"CAST(COALESCE({cond}, FALSE) AS BIGINT)"


def _cnt(cols, op) -> str:
    return " + ".join(_flag(f"{c} {op}") for c in cols)


def _any(cols, op) -> str:
    return "(" + " OR ".join(f"COALESCE({c} {op}, FALSE)" for c in cols) + ")"


def _sum0(cols) -> str:
    return "(" + " + ".join(f"COALESCE({c}, 0e0)" for c in cols) + ")"


def _log1p0(x: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN ln(1 + greatest({x}, 0e0)) END"


def _ratio(n: str, dn: str) -> str:
    return (f"CASE WHEN {n} IS NULL OR {dn} IS NULL THEN NULL WHEN {dn} = 0 THEN "
            f"CASE WHEN {n} > 0 THEN 100e0 WHEN {n} < 0 THEN CAST('-inf' AS DOUBLE) END "
            f"ELSE least({n} / {dn}, 100e0) END")


def feature_exprs() -> list[tuple[str, str]]:
    """(name, SQL) for the composites, referencing cleaned columns and earlier names."""
    out = []
    banking = _any(C.BANKING_COLS, "= 2")
    out += [("formal_access_count", _cnt(C.FORMAL_ACCESS_COLS, "= 2")),
            ("total_products_now", _cnt(C.PRODUCT_COLS, "= 2")),
            ("total_products_ever", _cnt(C.PRODUCT_COLS, ">= 1")),
            ("product_score_total", _sum0(C.PRODUCT_COLS)),
            ("formal_access_score", _sum0(C.FORMAL_ACCESS_COLS)),
            ("has_any_banking_now", f"CAST({banking} AS BIGINT)"),
            ("has_loan_and_banking", f"CAST(COALESCE(has_loan_account = 2, FALSE) AND {banking} AS BIGINT)")]
    ins_count = _cnt(C.INSURANCE_PRODUCT_COLS, "= 2")
    out += [("insurance_count", ins_count),
            ("insurance_strength", f"COALESCE(has_insurance, 0e0) + ({ins_count})"),
            ("keeps_any_records", _flag("keeps_financial_records > 0"))]
    for c in C.MONEY_COLS:
        out.append((f"log_{c}", _log1p0(c)))
    ier = _ratio("personal_income", "(business_expenses + 1)")
    ter = _ratio("business_turnover", "(business_expenses + 1)")
    out += [("income_expense_ratio", ier), ("log_income_expense_ratio", _log1p0(f"({ier})")),
            ("turnover_expense_ratio", ter), ("log_turnover_expense_ratio", _log1p0(f"({ter})"))]
    informal = f"CAST({_any(C.INFORMAL_COLS, '= 2')} AS BIGINT)"
    loan = _flag("has_loan_account = 2")
    out += [("uses_informal_now", informal), ("has_formal_loan_now", loan),
            ("formal_vs_informal", f"{loan} - {informal}"),
            ("is_tax_compliant", "COALESCE(compliance_income_tax, 0e0)"),
            ("compliance_and_loan", _flag("compliance_income_tax = 1 AND has_loan_account = 2"))]
    pos, neg = _sum0(C.ATTITUDE_COLS), _sum0(C.NEGATIVE_ATTITUDE_COLS)
    cash = "least(greatest(1 - COALESCE(current_problem_cash_flow, 0.5e0), 0e0), 1e0)"
    covid = "COALESCE(covid_essential_service, 0e0)"
    out += [("positive_attitude_score", pos), ("negative_attitude_score", neg),
            ("net_attitude_score", f"{pos} - {neg}"), ("cash_flow_stable", cash),
            ("theft_risk", "COALESCE(future_risk_theft_stock, 0e0)"), ("covid_resilient", covid),
            ("resilience_score", f"COALESCE(COALESCE(has_insurance, 0e0) + ({ins_count}), 0e0) + {pos} + {cash} + {covid}")]
    months = "(COALESCE(business_age_years, 0e0) * 12 + COALESCE(business_age_months, 0e0))"
    b = C.OWNER_AGE_BINS
    band = "CASE " + " ".join(f"WHEN owner_age > {b[i]} AND owner_age <= {b[i + 1]} THEN {i}e0"
                              for i in range(len(b) - 1)) + " END"
    out += [("business_age_total_months", months),
            ("log_business_age", f"CASE WHEN {months} > -1 THEN ln(1 + {months}) END"),
            ("owner_age_band", band),
            ("markets_actively", "COALESCE(marketing_word_of_mouth, 0e0)"),
            ("extends_credit", "COALESCE(offers_credit_to_customers, 0e0)")]
    return out


def interaction_exprs() -> list[tuple[str, str]]:
    banking = _any(C.BANKING_COLS, "= 2")
    return [("insured_with_credit_card", _flag("has_insurance = 1 AND has_credit_card = 2")),
            ("insured_with_internet_banking", _flag("has_insurance = 1 AND has_internet_banking = 2")),
            ("insured_with_banking", f"CAST(COALESCE(has_insurance = 1, FALSE) AND {banking} AS BIGINT)"),
            ("loan_and_compliant", _flag("has_loan_account = 2 AND compliance_income_tax = 1")),
            ("fully_formal", _flag("has_insurance = 1 AND has_any_banking_now = 1 AND has_loan_account = 2")),
            ("records_and_formal", _flag("keeps_financial_records >= 2 AND formal_access_count >= 1")),
            ("country_x_access", "country * formal_access_count")]


def rank_sql(c: str) -> str:
    v = f"CASE WHEN {c} IS NOT NULL THEN greatest({c}, 0e0) END"
    part = f"PARTITION BY country"
    return (f"CASE WHEN country IS NOT NULL AND {c} IS NOT NULL THEN "
            f"(CAST(rank() OVER (PARTITION BY country, ({c} IS NULL) ORDER BY {v}) AS DOUBLE) "
            f"+ (count({v}) OVER (PARTITION BY country, {v}) - 1) / 2e0) "
            f"/ count({v}) OVER ({part}) END")


def features_cte() -> str:
    """``clean`` -> ``f1`` (composites) -> ``feat`` (+ country ranks, interactions)."""
    f1 = ", ".join(f"{e} AS {n}" for n, e in feature_exprs())
    ranks = ", ".join(f"{rank_sql(c)} AS {c}_country_rank" for c in C.MONEY_COLS)
    inter = ", ".join(f"{e} AS {n}" for n, e in interaction_exprs())
    return (clean_cte() + f",\nf1 AS (SELECT *, {f1} FROM clean),\n"
            f"f2 AS (SELECT *, {ranks} FROM f1),\n"
            f"feat AS (SELECT *, {inter} FROM f2)")
