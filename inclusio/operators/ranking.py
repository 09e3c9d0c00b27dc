"""Skew-safe running counts within groups.

``Window.partitionBy(group).orderBy(x)`` sends a whole group to one task; the
survey's groups are 3-4 countries or 3 classes, so at scale a third of the
table would land in one task.  Instead the rows are range-partitioned on
``(group, order)`` so a hot group is split across many tasks, each task sums
its own slice, and a tiny table of per-slice totals (at most
partitions x groups rows) supplies the offset of every slice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..session import materialised

BROADCAST_ROWS = 1_000_000


def _range(df: DataFrame, n: int | None, keys: list[str]) -> DataFrame:
    """Range shuffle on ``keys``; without an explicit count AQE may coalesce
    small slices (it never merges large ones, so a hot group stays split)."""
    return df.repartitionByRange(n, *keys) if n else df.repartitionByRange(*keys)


def exclusive_prefix_sum(df: DataFrame, group_cols: list[str], order_cols: list[str],
                         weight_col: str | None = None, num_partitions: int | None = None,
                         out_col: str = "_before", total_col: str = "_group_total") -> DataFrame:
    """See ``prefix_sum_with_totals``; returns the rows only."""
    return prefix_sum_with_totals(df, group_cols, order_cols, weight_col, num_partitions, out_col, total_col)[0]


def prefix_sum_with_totals(df: DataFrame, group_cols: list[str], order_cols: list[str],
                           weight_col: str | None = None, num_partitions: int | None = None,
                           out_col: str = "_before", total_col: str = "_group_total"
                           ) -> tuple[DataFrame, DataFrame]:
    """Add ``out_col`` = sum of weights of the rows of the same group that come
    strictly before this row in ``order_cols`` order, and ``total_col`` = the
    group's total weight.  Rows of a group that tie in ``order_cols`` are taken
    in any order when counting rows; weighted sums need them unique in a group.
    A NULL group is a group of its own; a NULL order value sorts first.

    Plan: one range shuffle on (group, order); the slices are written once (with
    their number), so that the per-slice totals and the rows see the same ones,
    also after a lost executor, and nothing stays cached.  Unweighted (row
    counting): rows are sorted inside each slice and numbered with
    ``monotonically_increasing_id`` - no second shuffle.  Weighted: a window
    per (slice, group), i.e. one more shuffle spread over all slices.
    """
    keys = group_cols + order_cols
    ranged = _range(df, num_partitions, keys)
    if weight_col is None:
        r = materialised(ranged.sortWithinPartitions(*keys)
                         .withColumn("_pid", F.spark_partition_id())
                         .withColumn("_mid", F.monotonically_increasing_id()), "slices")
        totals = r.groupBy("_pid", *group_cols).agg(F.count(F.lit(1)).alias("_slice_total"),
                                                    F.min("_mid").alias("_first"))
        local = r.withColumn("_w", F.lit(1))
        local_expr = F.col("_mid") - F.col("_first")
    else:
        r = materialised(ranged.withColumn("_w", F.col(weight_col)).withColumn("_pid", F.spark_partition_id()), "slices")
        slice_w = Window.partitionBy("_pid", *group_cols).orderBy(*order_cols).rowsBetween(
            Window.unboundedPreceding, -1)
        local = r.withColumn("_local", F.coalesce(F.sum("_w").over(slice_w), F.lit(0)))
        totals = r.groupBy("_pid", *group_cols).agg(F.sum("_w").alias("_slice_total"))
        local_expr = F.col("_local")
    # at most (slices x groups) rows; its size is checked before it is broadcast
    before_w = Window.partitionBy(*group_cols).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (totals
               .withColumn("_offset", F.coalesce(F.sum("_slice_total").over(before_w), F.lit(0)))
               .withColumn(total_col, F.sum("_slice_total").over(Window.partitionBy(*group_cols)))
               .drop("_slice_total"))
    n_off = offsets.count()
    offsets = F.broadcast(offsets) if n_off <= BROADCAST_ROWS else offsets
    # a missing group is a group like any other: the slices match null-safely
    renamed = {c: f"__off_{i}" for i, c in enumerate(["_pid", *group_cols])}
    cond = F.lit(True)
    for c, r in renamed.items():
        cond = cond & F.col(c).eqNullSafe(F.col(r))
    out = local.join(offsets.withColumnsRenamed(renamed), cond, "inner").drop(*renamed.values())
    out = (out.withColumn(out_col, (F.col("_offset") + local_expr).cast("bigint"))
           .drop("_pid", "_local", "_offset", "_w", "_mid", "_first"))
    # per-group totals, read from the written slices (no new pass over the input)
    return out, totals.groupBy(*group_cols).agg(F.sum("_slice_total").alias(total_col))


def rank_table(vals: DataFrame, group_cols: list[str], num_partitions: int | None = None) -> DataFrame:
    """From ``(*group_cols, v, _n)`` distinct-value counts to ``(*group_cols, v, pct)``."""
    pref = exclusive_prefix_sum(vals, group_cols, ["v"], "_n", num_partitions)
    return pref.select(*group_cols, "v",
                       ((F.col("_before") + (F.col("_n") + 1) / 2.0) / F.col("_group_total")).alias("pct"))


def pct_rank_columns(df: DataFrame, group_col: str, value_cols: dict, num_partitions: int | None = None) -> DataFrame:
    """Append, for each ``out -> value`` in ``value_cols``, the average-tie
    percentile rank of the value within ``group_col`` (pandas ``rank(pct=True)``;
    missing value or group -> missing).

    Plan: a row's ranks depend on its group and values only, so everything is
    done on the distinct ``(group, values)`` tuples (map-side combined).  The
    values are stacked into a narrow ``(which, group, value)`` table without its
    missing ones and counted per distinct triple; one skew-safe prefix sum ranks
    all columns; the ranks are pivoted back to the tuples, and the tuples joined
    back to the rows once, null-safely.  No row id is needed.  A tuple is far
    less often repeated than any one value (a third of the rows may miss one);
    what repeats still is split by AQE.
    """
    names = list(value_cols)
    cols = [(F.col(v) if isinstance(v, str) else v).cast("double") for v in value_cols.values()]
    keys = ["__g", *[f"__v{i}" for i in range(len(names))]]
    keyed = df.select("*", F.col(group_col).alias("__g"), *[c.alias(k) for c, k in zip(cols, keys[1:])])
    tuples = keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__g").isNotNull())
    stacked = F.explode(F.array(*[F.struct(F.lit(i).alias("which"), F.col(k).alias("v")) for i, k in enumerate(keys[1:])]))
    long = (tuples.select(*keys, "__n", stacked.alias("s"))
            .select(*keys, "__n", "s.which", F.col("__g").alias("g"), "s.v").where(F.col("v").isNotNull()))
    vals = long.groupBy("which", "g", "v").agg(F.sum("__n").alias("_n"))
    ranks = rank_table(vals, ["which", "g"], num_partitions)
    per_tuple = long.join(ranks, ["which", "g", "v"]).groupBy(*keys).agg(
        *[F.max(F.when(F.col("which") == i, F.col("pct"))).alias(n) for i, n in enumerate(names)])
    other = {k: f"__r{i}" for i, k in enumerate(keys)}
    cond = F.lit(True)
    for k, r in other.items():
        cond = cond & F.col(k).eqNullSafe(F.col(r))
    return keyed.join(per_tuple.withColumnsRenamed(other), cond, "left").select(*df.columns, *names)


def pct_rank_column(df: DataFrame, group_col: str, value, out_col: str,
                    num_partitions: int | None = None) -> DataFrame:
    """Single-column form of ``pct_rank_columns``: the distinct (group, value) pairs are what is ranked, so
    they are counted, prefix-summed and joined back, without stacking or pivoting."""
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    keyed = df.select("*", F.col(group_col).alias("__g"), v.alias("__v"))
    counts = (keyed.where(F.col("__g").isNotNull() & F.col("__v").isNotNull())
              .groupBy(F.col("__g").alias("g"), F.col("__v").alias("v")).agg(F.count(F.lit(1)).alias("_n")))
    ranks = rank_table(counts, ["g"], num_partitions).withColumnsRenamed({"g": "__rg", "v": "__rv", "pct": "__pct"})
    return (keyed.join(ranks, (F.col("__g") == F.col("__rg")) & (F.col("__v") == F.col("__rv")), "left")
            .select(*df.columns, F.col("__pct").alias(out_col)))
