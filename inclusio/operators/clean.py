"""Survey cleaning: one projection, then data-dependent missing flags."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import config as C
from ..functions import encode as E


def clean_expr(name: str, dtype: str, is_train: bool = True):
    """Cleaning expression for one column, by the column group it belongs to."""
    c = F.col(name)
    if name == C.TARGET_COL:
        return E.encode_target(c) if is_train else c
    if name == "country":
        return E.encode_country(c)
    if name in C.PRODUCT_COLS:
        return F.coalesce(E.encode_product(c), F.lit(0.0))
    if name in C.BINARY_COLS:
        e = E.encode_binary(c)
        return F.coalesce(e, F.lit(0.0)) if name == "has_insurance" else e
    if name in C.TERNARY_COLS:
        return E.encode_ternary(c)
    if name == "keeps_financial_records":
        return E.encode_records(c)
    if name == "offers_credit_to_customers":
        return E.encode_offers_credit(c)
    if name == "owner_sex":
        return E.encode_sex(c)
    if name in C.NUMERIC_COLS:
        return E.coerce_numeric(c, dtype)
    return c


def clean_survey(df: DataFrame, is_train: bool = True) -> DataFrame:
    """All encodings and imputations in a single ``select`` (one codegen stage)."""
    return df.select(*[clean_expr(n, t, is_train).alias(n) for n, t in df.dtypes])


def missing_rates(df: DataFrame, exclude=(C.ID_COL, C.TARGET_COL, "split"), by: list[str] | None = None,
                  columns: list[str] | None = None) -> DataFrame:
    """Long table ``([*by,] column_name, column_pos, n_rows, n_missing, missing_rate)``
    from one aggregate (one pass; grouped by ``by`` when given)."""
    by = by or []
    cols = columns or [c for c in df.columns if c not in exclude and c not in by]
    g = df.groupBy(*by) if by else df.groupBy()
    agg = g.agg(F.count(F.lit(1)).alias("__n"),
                *[F.count_if(F.col(c).isNull()).alias(f"m{i}") for i, c in enumerate(cols)])
    stack = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.lit(i).cast("bigint").alias("column_pos"),
                 F.col(f"m{i}").cast("bigint").alias("n_missing"))
        for i, c in enumerate(cols)]))
    return (agg.select(*by, F.col("__n").cast("bigint").alias("n_rows"), stack.alias("s"))
            .select(*by, "s.column_name", "s.column_pos", "n_rows", "s.n_missing",
                    F.when(F.col("n_rows") > 0, F.col("s.n_missing") / F.col("n_rows")).alias("missing_rate")))


def missing_flag_columns(df: DataFrame, threshold: float = C.MISSING_FLAG_RATE,
                         exclude=(C.ID_COL, C.TARGET_COL, "split")) -> list[str]:
    """Columns whose missing rate is strictly above ``threshold``.

    One aggregate job; the driver reads a single row of per-column counts.
    """
    cols = [c for c in df.columns if c not in exclude]
    if not cols:
        return []
    row = df.agg(F.count(F.lit(1)).alias("__n"),
                 *[F.count_if(F.col(c).isNull()).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    n = row["__n"]
    if not n:
        return []
    return [c for i, c in enumerate(cols) if row[f"m{i}"] / n > threshold]


def add_missing_flags(df: DataFrame, columns: list[str] | None = None,
                      threshold: float = C.MISSING_FLAG_RATE) -> DataFrame:
    """Add ``<col>_missing`` (0/1) for the flagged columns.

    ``columns=None`` decides from this frame (the reference's per-split
    behaviour); pass the train split's list to fit on train instead.
    """
    flagged = missing_flag_columns(df, threshold) if columns is None else columns
    return df.select("*", *[F.col(c).isNull().cast("bigint").alias(f"{c}_missing") for c in flagged])


def align_columns(df: DataFrame, columns: list[str], types: dict[str, str] | None = None) -> DataFrame:
    """Exactly ``columns`` in that order: extra dropped, absent added as typed NULL."""
    types = types or {}
    have = set(df.columns)
    return df.select(*[F.col(c) if c in have else F.lit(None).cast(types.get(c, "double")).alias(c)
                       for c in columns])


def column_differences(left: DataFrame, right: DataFrame) -> tuple[list[str], list[str]]:
    """(in left not right, in right not left), each in column order."""
    r, l_ = set(right.columns), set(left.columns)
    return [c for c in left.columns if c not in r], [c for c in right.columns if c not in l_]


def category_codes(train: DataFrame, cols: list[str]) -> DataFrame:
    """(column_name, value, code) of every non-missing value of the given columns: codes count from 0 in
    ascending order within a column.  One stacked distinct serves all columns, and the skew-safe prefix sum
    numbers its values, so that a column of many values is spread over tasks."""
    from .ranking import exclusive_prefix_sum

    items = [F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in cols]
    values = train.select(F.explode(F.array(*items)).alias("s")).select("s.*").where(F.col("value").isNotNull()).distinct()
    return exclusive_prefix_sum(values, ["column_name"], ["value"], out_col="code").select("column_name", "value", "code")


def with_category_codes(df: DataFrame, codes: DataFrame, cols: list[str], suffix: str = "_idx") -> tuple[DataFrame, list[str]]:
    """``df`` plus ``<col><suffix>`` for every column, and the names added.  An unseen or missing value gets the
    number of the column's codes.  The codes are looked up like encodings of one class: one packed
    dictionary for all columns, or joins if it is too large to broadcast."""
    from .target_encoding import transform

    codes = codes.withColumn("enc_0", F.col("code").cast("double"))
    none = df.sparkSession.range(1).select(F.lit(-1.0).alias("g0"))
    sizes = codes.groupBy().pivot("column_name", cols).agg(F.count(F.lit(1)))  # one row
    coded = transform(df, codes.select("column_name", "value", "enc_0"), none, cols, n_classes=1)
    coded = coded.withColumn("__n", sizes.select(F.struct("*")).scalar())
    found = [F.when(F.col(f"{c}_te_0") >= 0, F.col(f"{c}_te_0")).otherwise(F.coalesce(F.col("__n")[c], F.lit(0))).cast("bigint").alias(f"{c}{suffix}") for c in cols]
    return coded.select(*df.columns, *found), [f"{c}{suffix}" for c in cols]
