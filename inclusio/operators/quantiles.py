"""Exact quantiles (linear interpolation) without gathering a group's values.

``percentile``/``median`` aggregates keep every value of a group in one
buffer, so a class holding a third of the rows would sit in one task.  Here
the values are counted per ``(group, value)`` (map-side combined), positioned
by the skew-safe prefix sum (range-partitioned slices), and the two
neighbours of each quantile position are picked by a conditional aggregate
over the distinct values:

    pos = q (n - 1),  lo = floor(pos),  hi = ceil(pos)
    x(i) = the value whose run [before, before + count) covers index i
    quantile = x(lo) + (x(hi) - x(lo)) (pos - lo)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .ranking import exclusive_prefix_sum


def exact_quantiles(df: DataFrame, group_cols: list[str], value, qs: dict[str, float],
                    num_partitions: int | None = None) -> DataFrame:
    """``(*group_cols, *qs)``: one row per group having at least one non-missing value."""
    v = F.col(value) if isinstance(value, str) else value
    base = df.select(*group_cols, v.cast("double").alias("__v")).where(F.col("__v").isNotNull())
    grp = group_cols if group_cols else []
    key = grp or ["__all"]
    if not grp:
        base = base.withColumn("__all", F.lit(0))
    counts = base.groupBy(*key, "__v").agg(F.count(F.lit(1)).alias("__cnt"))
    pos = exclusive_prefix_sum(counts, key, ["__v"], "__cnt", num_partitions, out_col="__b", total_col="__tot")
    aggs = []
    for name, q in qs.items():
        p = F.lit(float(q)) * (F.col("__tot") - 1)
        lo, hi = F.floor(p), F.ceil(p)

        def pick(i: Column) -> Column:
            return F.max(F.when((F.col("__b") <= i) & (i < F.col("__b") + F.col("__cnt")), F.col("__v")))

        aggs += [pick(lo).alias(f"__lo_{name}"), pick(hi).alias(f"__hi_{name}"),
                 F.max(p - lo).alias(f"__f_{name}")]
    picked = pos.groupBy(*key).agg(*aggs)
    out = picked.select(*key, *[(F.col(f"__lo_{n}") + (F.col(f"__hi_{n}") - F.col(f"__lo_{n}")) * F.col(f"__f_{n}"))
                                .alias(n) for n in qs])
    return out if grp else out.drop("__all")
