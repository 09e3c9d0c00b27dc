"""Label preparation: class weights, deterministic stratified folds and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import config as C
from .ranking import exclusive_prefix_sum, prefix_sum_with_totals

#: Strata up to this number get their offsets as literals, more by a join; both give the same rows.
LITERAL_STRATA = 10_000


def class_weights(df: DataFrame, label_col: str = C.TARGET_COL, n_classes: int = C.N_CLASSES) -> DataFrame:
    """Balanced weights n / (k * count_c): ``(label, n, weight)``.  Small: one row per class;
    the total is a scalar subquery over that table."""
    counts = df.where(F.col(label_col).isNotNull()).groupBy(label_col).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.select(F.col(label_col), "n", (total / (n_classes * F.col("n"))).alias("weight"))


def sample_weights(df: DataFrame, label_col: str = C.TARGET_COL, weight_col: str = "weight") -> DataFrame:
    """Row weight = its class weight (class table has one row per class -> broadcast)."""
    w = class_weights(df, label_col).select(label_col, F.col("weight").alias(weight_col))
    return df.join(F.broadcast(w), label_col, "left")


def hash_order(id_col: str = C.ID_COL, seed: int = C.SEED):
    """Default shuffle order inside a stratum: a seeded 64-bit hash of the id."""
    return [F.xxhash64(F.col(id_col), F.lit(seed)).alias("_h"), F.col(id_col).alias("_tie")]


def stratum_index(df: DataFrame, stratum_col: str, order_cols: list[str],
                  num_partitions: int | None = None) -> DataFrame:
    """Adds (to every row, also those of a missing stratum) ``_in_stratum`` (0-based position in stratum order), ``_stratum_n`` and
    ``_offset`` (rows in strata sorting before this one)."""
    pref, totals = prefix_sum_with_totals(df, [stratum_col], order_cols, None, num_partitions,
                                          out_col="_in_stratum", total_col="_stratum_n")
    # stratum sizes from the prefix sum's slice totals (already materialised)
    sizes = totals.select(stratum_col, F.col("_stratum_n").alias("_cnt"))
    head = sizes.limit(LITERAL_STRATA + 1).collect()  # size check: strata are few by nature
    if len(head) <= LITERAL_STRATA:
        acc, pairs = 0, []
        for r in sorted(head, key=lambda r: (r[0] is not None, r[0])):  # ascending, NULL first
            if r[0] is not None:
                pairs += [F.lit(r[0]), F.lit(acc).cast("bigint")]
            else:
                null_off = acc
            acc += r["_cnt"]
        off = F.try_element_at(F.create_map(*pairs), F.col(stratum_col)) if pairs else F.lit(None).cast("bigint")
        if any(r[0] is None for r in head):
            off = F.when(F.col(stratum_col).isNull(), F.lit(null_off).cast("bigint")).otherwise(off)
        return pref.withColumn("_offset", off)
    # many strata: the same skew-safe prefix sum over the (stratum, count) table
    offs = exclusive_prefix_sum(sizes.withColumn("_all", F.lit(0)), ["_all"], [stratum_col], "_cnt",
                                num_partitions, out_col="_soff").select(stratum_col, F.col("_soff").alias("_offset"))
    offs = offs.withColumnRenamed(stratum_col, "__stratum")
    return pref.join(offs, F.col(stratum_col).eqNullSafe(F.col("__stratum")), "inner").drop("__stratum")


def _tie_break(df: DataFrame):
    """Hash of the whole row: rows that tie in the order are numbered alike in every run
    (rows that tie here too are equal, so their numbers may be swapped)."""
    return F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).alias("_row")


def stratified_folds(df: DataFrame, stratum_col: str = C.TARGET_COL, order_cols: list[str] | None = None,
                     n_folds: int = C.N_FOLDS, fold_col: str = "fold",
                     num_partitions: int | None = None) -> DataFrame:
    """Deal rows round-robin into folds after ordering them by (stratum, order).

    index = rows in earlier strata + position in own stratum; fold = index % k.
    Every stratum's fold sizes differ by at most one row.  ``order_cols``
    default to a seeded hash of ``ID`` (with the id as tie-break).  Every row
    gets exactly one fold: a missing stratum is a stratum, a missing order
    value sorts first, and rows of one id are numbered one after the other.
    """
    work = df
    if order_cols is None:
        work = df.select("*", *hash_order())
        order_cols = ["_h", "_tie"]
    work = work.select("*", _tie_break(df))
    fold = ((F.col("_offset") + F.col("_in_stratum")) % n_folds).cast("bigint").alias(fold_col)
    idx = stratum_index(work, stratum_col, [*order_cols, "_row"], num_partitions)
    return idx.select(*df.columns, fold)


def joint_stratum(*cols, sep: str = "_"):
    """``country_target`` style key; missing parts spelled ``nan`` as pandas writes them."""
    return F.concat_ws(sep, *[F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in cols])


def stratified_split(df: DataFrame, stratum_col: str, order_cols: list[str], test_share: float = 0.2,
                     out_col: str = "is_holdout", num_partitions: int | None = None) -> DataFrame:
    """Per stratum, the first ``ceil(test_share * n)`` rows in order are held out."""
    flag = (F.col("_in_stratum") < F.lit(test_share) * F.col("_stratum_n")).cast("bigint").alias(out_col)
    idx = stratum_index(df.select("*", _tie_break(df)), stratum_col, [*order_cols, "_row"], num_partitions)
    return idx.select(*df.columns, flag)


def ordinal_targets(df: DataFrame, label_col: str = C.TARGET_COL) -> DataFrame:
    """y_A = (y >= 1), y_B = (y == 2)."""
    y = F.col(label_col)
    return df.select("*", (y >= 1).cast("bigint").alias("y_A"), (y == 2).cast("bigint").alias("y_B"))
