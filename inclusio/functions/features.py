"""Row-wise composite features as column expressions.

pandas compares missing values as false and skips them in sums; here every
comparison is wrapped as ``coalesce(cond, false)`` and sums use
``coalesce(c, 0)``.  ``greatest``/``least`` skip NULLs in Spark while pandas'
``clip`` keeps them, so clipping is guarded by ``isNotNull``.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, functions as F

from .. import config as C


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def flag(cond: Column) -> Column:
    """pandas boolean -> int: missing compares false."""
    return F.coalesce(cond, F.lit(False)).cast("bigint")


def count_where(cols, pred) -> Column:
    return reduce(add, [flag(pred(col(c))) for c in cols])


def any_where(cols, pred) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(pred(col(c)), F.lit(False)) for c in cols])


def sum_skipna(cols) -> Column:
    return reduce(add, [F.coalesce(col(c), F.lit(0.0)) for c in cols])


def now(c) -> Column:
    return col(c) == 2


def log1p_clip0(c) -> Column:
    """log1p(max(x, 0)), missing stays missing."""
    x = col(c)
    return F.when(x.isNotNull(), F.log1p(F.greatest(x, F.lit(0.0))))


def capped_ratio(num, den_plus_one, cap=C.RATIO_CAP) -> Column:
    """min(num / den, cap) with IEEE division: +x/0 -> cap, -x/0 -> -inf, 0/0 -> missing."""
    n, d = col(num), col(den_plus_one)
    return (F.when(n.isNull() | d.isNull(), F.lit(None).cast("double"))
            .when(d == 0, F.when(n > 0, F.lit(cap)).when(n < 0, F.lit(float("-inf"))))
            .otherwise(F.least(n / d, F.lit(cap))))


def access_exprs() -> dict[str, Column]:
    banking_now = any_where(C.BANKING_COLS, lambda c: c == 2)
    return {
        "formal_access_count": count_where(C.FORMAL_ACCESS_COLS, lambda c: c == 2),
        "total_products_now": count_where(C.PRODUCT_COLS, lambda c: c == 2),
        "total_products_ever": count_where(C.PRODUCT_COLS, lambda c: c >= 1),
        "product_score_total": sum_skipna(C.PRODUCT_COLS),
        "formal_access_score": sum_skipna(C.FORMAL_ACCESS_COLS),
        "has_any_banking_now": banking_now.cast("bigint"),
        "has_loan_and_banking": (F.coalesce(now("has_loan_account"), F.lit(False)) & banking_now).cast("bigint"),
    }


def savings_exprs() -> dict[str, Column]:
    out = {"insurance_count": count_where(C.INSURANCE_PRODUCT_COLS, lambda c: c == 2)}
    out["insurance_strength"] = F.coalesce(col("has_insurance"), F.lit(0.0)) + out["insurance_count"]
    out["keeps_any_records"] = flag(col("keeps_financial_records") > 0)
    for c in C.MONEY_COLS:
        out[f"log_{c}"] = log1p_clip0(c)
    den = col("business_expenses") + 1
    out["income_expense_ratio"] = capped_ratio("personal_income", den)
    out["log_income_expense_ratio"] = log1p_clip0(out["income_expense_ratio"])
    out["turnover_expense_ratio"] = capped_ratio("business_turnover", den)
    out["log_turnover_expense_ratio"] = log1p_clip0(out["turnover_expense_ratio"])
    return out


def debt_exprs() -> dict[str, Column]:
    informal = any_where(C.INFORMAL_COLS, lambda c: c == 2).cast("bigint")
    loan = flag(now("has_loan_account"))
    return {
        "uses_informal_now": informal,
        "has_formal_loan_now": loan,
        "formal_vs_informal": loan - informal,
        "is_tax_compliant": F.coalesce(col("compliance_income_tax"), F.lit(0.0)),
        "compliance_and_loan": flag((col("compliance_income_tax") == 1) & now("has_loan_account")),
    }


def resilience_exprs(insurance_strength: Column) -> dict[str, Column]:
    pos = sum_skipna(C.ATTITUDE_COLS)
    neg = sum_skipna(C.NEGATIVE_ATTITUDE_COLS)
    cash = F.least(F.greatest(1 - F.coalesce(col("current_problem_cash_flow"), F.lit(0.5)), F.lit(0.0)),
                   F.lit(1.0))
    covid = F.coalesce(col("covid_essential_service"), F.lit(0.0))
    return {
        "positive_attitude_score": pos,
        "negative_attitude_score": neg,
        "net_attitude_score": pos - neg,
        "cash_flow_stable": cash,
        "theft_risk": F.coalesce(col("future_risk_theft_stock"), F.lit(0.0)),
        "covid_resilient": covid,
        "resilience_score": F.coalesce(insurance_strength, F.lit(0.0)) + pos + cash + covid,
    }


def owner_age_band(c="owner_age") -> Column:
    """Right-closed bins (0,25],(25,35],(35,45],(45,55],(55,120] -> 0..4; else missing."""
    x, b = col(c), C.OWNER_AGE_BINS
    out = F.when((x > b[0]) & (x <= b[1]), 0.0)
    for i in range(1, len(b) - 1):
        out = out.when((x > b[i]) & (x <= b[i + 1]), float(i))
    return out


def business_exprs() -> dict[str, Column]:
    months = (F.coalesce(col("business_age_years"), F.lit(0.0)) * 12
              + F.coalesce(col("business_age_months"), F.lit(0.0)))
    return {
        "business_age_total_months": months,
        "log_business_age": F.log1p(months),
        "owner_age_band": owner_age_band(),
        "markets_actively": F.coalesce(col("marketing_word_of_mouth"), F.lit(0.0)),
        "extends_credit": F.coalesce(col("offers_credit_to_customers"), F.lit(0.0)),
    }


def interaction_exprs(has_any_banking_now: Column, formal_access_count: Column) -> dict[str, Column]:
    insured = col("has_insurance") == 1
    return {
        "insured_with_credit_card": flag(insured & now("has_credit_card")),
        "insured_with_internet_banking": flag(insured & now("has_internet_banking")),
        "insured_with_banking": (F.coalesce(insured, F.lit(False))
                                 & any_where(C.BANKING_COLS, lambda c: c == 2)).cast("bigint"),
        "loan_and_compliant": flag(now("has_loan_account") & (col("compliance_income_tax") == 1)),
        "fully_formal": flag(insured & (has_any_banking_now == 1) & now("has_loan_account")),
        "records_and_formal": flag((col("keeps_financial_records") >= 2) & (formal_access_count >= 1)),
        "country_x_access": col("country") * formal_access_count,
    }


def profit_margin(income="personal_income", expenses="business_expenses") -> Column:
    i, e = col(income), col(expenses)
    return F.when(i.isNotNull() & e.isNotNull() & (i != 0),
                  F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (i - e) / i)))


# --- fixed values: answers the notebook's access score credits -------------
ACCESS_FULL = ["Yes", "Have now", "have now"]
ACCESS_HALF = ["Used to have but don't have now", "used to have"]


def financial_access_score(cols=None) -> Column:
    """On raw strings: full credit 1, lapsed 0.5, else 0; divided by answered count."""
    cols = cols or C.ACCESS_SCORE_COLS
    score = reduce(add, [F.when(col(c).isin(*ACCESS_FULL), 1.0).when(col(c).isin(*ACCESS_HALF), 0.5)
                         .otherwise(0.0) for c in cols])
    n = reduce(add, [col(c).isNotNull().cast("int") for c in cols])
    return F.when(n > 0, score / n)
