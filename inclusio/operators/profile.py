"""Profiling and data-quality reports as aggregates (one wide pass each).

Per-column statistics are computed in a single ``agg`` over all columns and
then turned into a long table with ``unpivot``/``explode`` of the one-row
result, so the data is scanned once whatever the number of columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import config as C
from .quantiles import exact_quantiles


def _stack(row_df: DataFrame, items: list[tuple[str, dict]]) -> DataFrame:
    """One-row aggregate -> long table: ``items`` = [(column_name, {out: agg_col_name})]."""
    outs = list(items[0][1])
    arr = F.array(*[F.struct(F.lit(name).alias("column_name"), F.lit(i).cast("bigint").alias("column_pos"),
                             *[F.col(src).alias(o) for o, src in m.items()])
                    for i, (name, m) in enumerate(items)])
    return row_df.select(F.explode(arr).alias("s")).select("s.column_name", "s.column_pos",
                                                           *[f"s.{o}" for o in outs])


def shape_summary(df: DataFrame, split_col: str = "split") -> DataFrame:
    """Rows and columns per split."""
    ncols = len([c for c in df.columns if c != split_col])
    return df.groupBy(split_col).agg(F.count(F.lit(1)).alias("n_rows"),
                                     F.lit(ncols).cast("bigint").alias("n_columns"))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Count per value, missing dropped."""
    return (df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("value"))
            .agg(F.count(F.lit(1)).alias("n")))


def value_proportions(df: DataFrame, col: str, domain: list | None = None) -> DataFrame:
    """Counts and share of the total of all non-missing rows; with ``domain`` only its values are
    listed, absent ones as 0 (the shares of values outside it are left out, not dealt again)."""
    vc = value_counts(df, col)
    total = df.agg(F.count(F.col(col))).scalar()
    if domain is not None:
        dom = df.sparkSession.createDataFrame([(v,) for v in domain], ["value"])
        # only values of the domain are counted, so its few rows bound the table that is joined
        inside = value_counts(df.where(F.col(col).isin(list(domain))), col)
        vc = dom.join(inside, "value", "left").na.fill(0, ["n"])
    return vc.select("value", "n", F.when(total > 0, F.col("n") / total).otherwise(F.lit(0.0)).alias("share"))


def class_imbalance(df: DataFrame, col: str, limit: float = 1.5) -> DataFrame:
    vc = value_counts(df, col)
    return vc.agg(F.max("n").alias("max_n"), F.min("n").alias("min_n"),
                  (F.max("n") / F.min("n")).alias("ratio")).withColumn(
        "imbalanced", (F.col("ratio") > limit).cast("bigint"))


def missing_profile(df: DataFrame, exclude=()) -> DataFrame:
    """Missing count and % per column, only > 0 (sort: % desc, name)."""
    cols = [c for c in df.columns if c not in exclude]
    agg = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count_if(F.col(c).isNull()).alias(f"m{i}")
                                                    for i, c in enumerate(cols)])
    long = _stack(agg, [(c, {"n_missing": f"m{i}", "n_rows": "__n"}) for i, c in enumerate(cols)])
    return (long.where(F.col("n_missing") > 0)
            .select("column_name", F.col("n_missing").cast("bigint").alias("n_missing"),
                    (F.col("n_missing") * 100.0 / F.col("n_rows")).alias("pct_missing")))


def column_info(df: DataFrame) -> DataFrame:
    """Type and non-null count per column."""
    types = dict(df.dtypes)
    agg = df.agg(*[F.count(F.col(c)).alias(f"c{i}") for i, c in enumerate(df.columns)])
    arr = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(types[c]).alias("dtype"),
                             F.col(f"c{i}").cast("bigint").alias("non_null")) for i, c in enumerate(df.columns)])
    return agg.select(F.explode(arr).alias("s")).select("s.*")


def numeric_describe(df: DataFrame, cols: list[str] | None = None, exact: bool = True) -> DataFrame:
    """count, mean, sample std, min, quartiles (linear interpolation), max per numeric column.

    Moments come from one wide aggregate; quartiles from the distributed exact
    quantile over the stacked ``(column, value)`` table (or ``percentile_approx``).
    """
    cols = cols or [c for c, t in df.dtypes if t in ("double", "float", "int", "bigint", "smallint")]
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.count(c).alias(f"n{i}"), F.avg(c).alias(f"mean{i}"), F.stddev_samp(c).alias(f"std{i}"),
                 F.min(c).cast("double").alias(f"min{i}"), F.max(c).cast("double").alias(f"max{i}")]
    agg = df.agg(*aggs)
    items = [(c, {"count": f"n{i}", "mean": f"mean{i}", "std": f"std{i}", "min": f"min{i}", "max": f"max{i}"})
             for i, c in enumerate(cols)]
    moments = _stack(agg, items)
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("x"))
                                         for c in cols])).alias("s")).select("s.column_name", "s.x")
    qs = {"p25": 0.25, "p50": 0.5, "p75": 0.75}
    if exact:
        quart = exact_quantiles(long, ["column_name"], "x", qs)
    else:
        quart = long.groupBy("column_name").agg(*[F.percentile_approx("x", q, 10000).alias(n) for n, q in qs.items()])
    out = moments.join(quart, "column_name", "left")
    return out.select("column_name", "column_pos", "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def cardinality(df: DataFrame, cols: list[str] | None = None, exact: bool = True) -> DataFrame:
    """Distinct non-missing values per string column: the columns are stacked and grouped twice (a
    narrow shuffle of distinct values), or sketched in one pass with ``exact=False``."""
    cols = cols or [c for c, t in df.dtypes if t == "string"]
    if not exact:
        agg = df.agg(*[F.approx_count_distinct(F.col(c)).alias(f"d{i}") for i, c in enumerate(cols)])
        return _stack(agg, [(c, {"n_distinct": f"d{i}"}) for i, c in enumerate(cols)])
    where = [F.struct(F.lit(i).cast("bigint").alias("column_pos"), F.col(c).cast("string").alias("value")) for i, c in enumerate(cols)]
    values = df.select(F.explode(F.array(*where)).alias("s")).select("s.*").distinct()
    counts = values.groupBy("column_pos").agg(F.count("value").alias("n_distinct"))
    names = df.sparkSession.createDataFrame(list(enumerate(cols)), "column_pos bigint, column_name string")
    return names.join(counts, "column_pos", "left").select("column_name", "column_pos", F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"))


#: Registers (log2) of a cardinality sketch: a standard error of 0.8 %.
HLL_BITS = 14
#: Accuracy parameter of a quantile sketch: a rank error well below 1 %.
KLL_K = 400


def _stacked(df: DataFrame, cols: list[str], kind: str, keep: list[str]) -> DataFrame:
    """(*keep, column_pos, value) of the non-missing values of all columns."""
    items = [F.struct(F.lit(i).cast("bigint").alias("column_pos"), F.col(c).cast(kind).alias("value")) for i, c in enumerate(cols)]
    return df.select(*keep, F.explode(F.array(*items)).alias("s")).select(*keep, "s.*").where(F.col("value").isNotNull())


def _column_names(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.sparkSession.createDataFrame(list(enumerate(cols)), "column_pos bigint, column_name string")


def cardinality_sketches(df: DataFrame, cols: list[str], by: list[str]) -> DataFrame:
    """(*by, column_pos, n, sketch): a HyperLogLog sketch of each column's values per group of ``by`` (a day, a
    file, a split).  Kept as a table it grows by the new groups only; ``merged_cardinality`` unites any of
    them without reading a row again.  Values are sketched as text; missing ones don't count."""
    long = _stacked(df, cols, "string", by)
    return long.groupBy(*by, "column_pos").agg(F.count(F.lit(1)).alias("n"), F.hll_sketch_agg("value", HLL_BITS).alias("sketch"))


def merged_cardinality(sketches: DataFrame, cols: list[str]) -> DataFrame:
    """(column_name, column_pos, n_distinct) from a table of sketches, whatever its groups."""
    united = sketches.groupBy("column_pos").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_distinct"))
    return (F.broadcast(_column_names(sketches, cols)).join(united, "column_pos", "left")
            .select("column_name", "column_pos", F.coalesce("n_distinct", F.lit(0)).cast("bigint").alias("n_distinct")))


def quantile_sketches(df: DataFrame, cols: list[str], by: list[str]) -> DataFrame:
    """(*by, column_pos, sketch): a KLL sketch of each numeric column's values per group of ``by``; merged like
    the cardinality sketches.  Memory goes by ``KLL_K``, not by the values."""
    long = _stacked(df, cols, "double", by)
    return long.groupBy(*by, "column_pos").agg(F.kll_sketch_agg_double("value", F.lit(KLL_K)).alias("sketch"))


def merged_quantiles(sketches: DataFrame, cols: list[str], quantiles: dict[str, float], by: list[str] = ()) -> DataFrame:
    """(*by, column_name, column_pos, n, one column per quantile) from a table of sketches."""
    united = sketches.groupBy(*by, "column_pos").agg(F.kll_merge_agg_double("sketch").alias("s"))
    return (united.join(F.broadcast(_column_names(sketches, cols)), "column_pos")
            .select(*by, "column_name", "column_pos", F.kll_sketch_get_n_double("s").alias("n"),
                    *[F.kll_sketch_get_quantile_double("s", F.lit(q)).alias(name) for name, q in quantiles.items()]))


# --- fixed values: answers that mark a yes/no question ---------------------
YES_NO_VALUES = ["Yes", "No", "Don't know or N/A"]


def yes_no_columns(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """String columns holding any yes/no answer, with their value counts (long)."""
    cols = cols or [c for c, t in df.dtypes if t == "string"]
    arr = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("value")) for c in cols]))
    long = df.select(arr.alias("s")).select("s.column_name", "s.value").where(F.col("value").isNotNull())
    counts = long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    hit = counts.where(F.col("value").isin(*YES_NO_VALUES)).select("column_name").distinct()
    return counts.join(F.broadcast(hit), "column_name", "left_semi")


def stats_by_target(df: DataFrame, value: str, target: str = C.TARGET_COL) -> DataFrame:
    """mean / exact median / sample std / count of a numeric per class."""
    base = df.where(F.col(target).isNotNull())
    mom = base.groupBy(target).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
                                   F.count(value).alias("count"))
    med = exact_quantiles(base, [target], value, {"median": 0.5})
    return mom.join(med, target, "left").select(target, "mean", "median", "std", "count")


def crosstab_pct(df: DataFrame, cat: str, target: str = C.TARGET_COL, classes=None) -> DataFrame:
    """Row-normalised % (rounded 2) of each class within each category value."""
    classes = classes or C.TARGET_LABELS
    base = df.where(F.col(cat).isNotNull() & F.col(target).isNotNull())
    counts = base.groupBy(cat).agg(F.count(F.lit(1)).alias("_n"),
                                   *[F.count_if(F.col(target) == k).alias(f"_c{i}") for i, k in enumerate(classes)])
    return counts.select(F.col(cat).alias("value"), *[F.round(F.col(f"_c{i}") * 100.0 / F.col("_n"), 2).alias(
        f"pct_{str(k).lower()}") for i, k in enumerate(classes)])


def histogram(df: DataFrame, cols: list[str], bins: int = 30) -> DataFrame:
    """Equal-width bins between each column's min and max; last bin closed."""
    arr = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("x"))
                              for c in cols]))
    long = df.select(arr.alias("s")).select("s.column_name", "s.x").where(F.col("x").isNotNull())
    rng = long.groupBy("column_name").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    j = long.join(F.broadcast(rng), "column_name")  # one row per column: bounded by len(cols)
    width = (F.col("hi") - F.col("lo")) / bins
    b = F.when(F.col("hi") == F.col("lo"), F.lit(0)).otherwise(
        F.least(F.floor((F.col("x") - F.col("lo")) / width), F.lit(bins - 1)))
    return j.groupBy("column_name", b.cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def boxplot_stats(df: DataFrame, value: str, group: str = C.TARGET_COL) -> DataFrame:
    base = df.where(F.col(group).isNotNull())
    q = exact_quantiles(base, [group], value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    mm = base.groupBy(group).agg(F.min(value).alias("min"), F.max(value).alias("max"))
    return q.join(mm, group, "inner").select(group, "q1", "median", "q3", "min", "max")


def feature_sanity(df: DataFrame, cols: list[str]) -> DataFrame:
    agg = df.agg(*[x for i, c in enumerate(cols) for x in
                   (F.avg(c).alias(f"a{i}"), F.max(c).cast("double").alias(f"x{i}"),
                    F.count_if(F.col(c).isNull()).alias(f"m{i}"))])
    return _stack(agg, [(c, {"mean": f"a{i}", "max": f"x{i}", "n_missing": f"m{i}"}) for i, c in enumerate(cols)])


def group_high_rate(df: DataFrame, group: str = "country", label: str = C.TARGET_COL, cls: int = 2) -> DataFrame:
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("n"),
                                 F.avg((F.col(label) == cls).cast("double")).alias("high_rate"))


def binary_positive_rate(df: DataFrame, cols: list[str]) -> DataFrame:
    agg = df.agg(*[x for i, c in enumerate(cols) for x in (F.sum(c).alias(f"s{i}"), F.avg(c).alias(f"r{i}"))])
    return _stack(agg, [(c, {"positives": f"s{i}", "rate": f"r{i}"}) for i, c in enumerate(cols)])


def row_duplicates(df: DataFrame, id_col: str = C.ID_COL) -> DataFrame:
    """Rows whose id appeared before = sum(count - 1) per id (partial aggregation)."""
    per = df.groupBy(id_col).agg(F.count(F.lit(1)).alias("_n"))
    return per.agg(F.sum(F.col("_n") - 1).cast("bigint").alias("n_duplicates"),
                   F.count(F.lit(1)).alias("n_distinct_ids"))


def id_overlap(left: DataFrame, right: DataFrame, id_col: str = C.ID_COL) -> DataFrame:
    """Ids present on both sides (semi join; right side deduplicated first)."""
    return left.select(id_col).join(right.select(id_col).distinct(), id_col, "left_semi")


def sort_topk(df: DataFrame, by: str, k: int, tie: str) -> DataFrame:
    """Sort desc then head(k) with a tie-break column (TakeOrderedAndProject)."""
    return df.orderBy(F.desc(by), F.asc(tie)).limit(k)
