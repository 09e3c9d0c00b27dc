"""Feature engineering: composites (one projection) + within-country ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import config as C
from ..functions import features as FX
from .ranking import pct_rank_columns

RANK_SUFFIX = "_country_rank"


def _with(df: DataFrame, exprs: dict) -> DataFrame:
    return df.select("*", *[e.alias(n) for n, e in exprs.items()])


def feat_access(df: DataFrame) -> DataFrame:
    return _with(df, FX.access_exprs())


def feat_savings(df: DataFrame) -> DataFrame:
    return _with(df, FX.savings_exprs())


def feat_debt(df: DataFrame) -> DataFrame:
    return _with(df, FX.debt_exprs())


def feat_resilience(df: DataFrame) -> DataFrame:
    """Needs ``insurance_strength`` (from savings) when present; else built here."""
    ins = F.col("insurance_strength") if "insurance_strength" in df.columns else FX.savings_exprs()["insurance_strength"]
    return _with(df, FX.resilience_exprs(ins))


def feat_business(df: DataFrame) -> DataFrame:
    return _with(df, FX.business_exprs())


def feat_interaction(df: DataFrame) -> DataFrame:
    acc = FX.access_exprs()
    bank = F.col("has_any_banking_now") if "has_any_banking_now" in df.columns else acc["has_any_banking_now"]
    fac = F.col("formal_access_count") if "formal_access_count" in df.columns else acc["formal_access_count"]
    return _with(df, FX.interaction_exprs(bank, fac))


def country_pct_rank(df: DataFrame, group_col: str = "country", value_cols=None, num_partitions: int | None = None) -> DataFrame:
    """``<col>_country_rank`` for the three money columns (average ties / non-missing count).

    Ranked on ``max(x, 0)``: same order as its log1p, without engine-specific
    log rounding.  Returns the input with the rank columns appended; rows are
    matched by country and values, so no unique row id is assumed.
    """
    vals = {f"{c}{RANK_SUFFIX}": F.when(F.col(c).isNotNull(), F.greatest(F.col(c), F.lit(0.0)))
            for c in (value_cols or C.MONEY_COLS)}
    return pct_rank_columns(df, group_col, vals, num_partitions)


def engineer_features(df: DataFrame, num_partitions: int | None = None, ranks: bool = True) -> DataFrame:
    """All composites in the reference's order; originals kept.

    access -> savings -> debt -> resilience -> business are one projection; the
    country ranks are the only shuffle (``ranks=False`` leaves them out for callers
    that don't read them); interactions are a final projection.
    """
    acc = FX.access_exprs()
    sav = FX.savings_exprs()
    debt = FX.debt_exprs()
    res = FX.resilience_exprs(F.col("insurance_strength"))
    bus = FX.business_exprs()
    step1 = _with(_with(df, {**acc, **sav, **debt}), res)
    step1 = _with(step1, bus)
    ranked = country_pct_rank(step1, num_partitions=num_partitions) if ranks else step1
    inter = FX.interaction_exprs(F.col("has_any_banking_now"), F.col("formal_access_count"))
    return _with(ranked, inter)


def added_feature_columns(before: DataFrame, after: DataFrame) -> list[str]:
    have = set(before.columns)
    return [c for c in after.columns if c not in have]
