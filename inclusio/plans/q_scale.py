"""The same operators bound to the large driver tables.

``lineitem.l_returnflag`` (A/N/R) and ``orders`` are natural 3-class tables
with low-cardinality categorical columns: folds, target encoding, ranks and
the aggregate-once threshold search run on them at full size (600k lineitem
rows at sf0.1), which is where the partitioning choices show.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import decide as D
from ..operators import folds as FO
from ..operators import metrics as M
from ..operators import ranking as RK
from ..operators import search as SR
from ..operators import target_encoding as TE
from .. import config as C
from .q_decide import _brute_sql, counts_sql, dl, f1_sql
from .q_encode import _apply_sql, _fit_sql
from .registry import register

# --- fixed values: label codes and the engine-neutral row order -------------
FLAG_CODES = {"A": 0, "N": 1, "R": 2}
LI_TE_COLS = ["l_quantity", "l_discount", "l_tax", "l_linenumber", "l_suppkey"]
OUT_TE = [f"{c}_te_{k}" for c in LI_TE_COLS for k in range(3)]


def lineitem(spark, sf_dir, cols):
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*cols)


KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]  # unique row key of lineitem


def labelled_lineitem(spark, sf_dir, extra=()):
    """Rows keyed by KEY, label y, row hash h = 8*orderkey + linenumber (not unique)."""
    extra = [c for c in extra if c not in KEY]
    li = lineitem(spark, sf_dir, [*KEY, "l_returnflag", *extra])
    y = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1) \
        .when(F.col("l_returnflag") == "R", 2).cast("bigint")
    h = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    return li.select(*KEY, *extra, y.alias("y"), h.alias("h"))


def li_folds(spark, sf_dir, extra=()):
    d = labelled_lineitem(spark, sf_dir, extra).withColumn("_ord", (F.col("h") * 7919) % 104729)
    return FO.stratified_folds(d, "y", ["_ord", *KEY], C.N_FOLDS).drop("_ord")


LI_SQL = """li AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_discount, l_tax, l_suppkey,
  CAST(CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 WHEN 'R' THEN 2 END AS BIGINT) AS y,
  l_orderkey * 8 + l_linenumber AS h FROM lineitem),
lo AS (SELECT y, sum(n) OVER (ORDER BY y) - n AS off FROM (SELECT y, count(*) AS n FROM li GROUP BY y) c),
lf AS (SELECT li.*, CAST((lo.off + row_number() OVER (PARTITION BY li.y ORDER BY (li.h * 7919) % 104729,
       li.l_orderkey, li.l_linenumber, li.l_partkey, li.l_suppkey) - 1)
       % 5 AS BIGINT) AS fold FROM li JOIN lo ON li.y = lo.y)"""


@register("lineitem_folds", sql=lambda: "WITH " + LI_SQL + "\nSELECT " + ", ".join(KEY) + ", y, fold FROM lf",
          bench=True)
def q_li_folds(spark, sf_dir):
    return li_folds(spark, sf_dir).select(*KEY, "y", "fold")


@register("lineitem_target_encode_oof", sql=lambda: "WITH " + LI_SQL + ",\n" +
          _fit_sql("lf", True, LI_TE_COLS, "y") + "\n" +
          _apply_sql("lf", True, ", ".join(f"t.{k}" for k in KEY) + ", t.fold", LI_TE_COLS), bench=True)
def q_li_te(spark, sf_dir):
    """Held-out encodings of five lineitem columns against the return flag."""
    d = li_folds(spark, sf_dir, LI_TE_COLS)  # its slices are written once; the fit and the transform read those
    enc, g = TE.fit_out_of_fold(d, "fold", LI_TE_COLS, label="y")
    out = TE.transform(d, enc, g, LI_TE_COLS, fold_col="fold")
    return out.select(*KEY, "fold", *[F.round(c, 9).alias(c) for c in OUT_TE])


@register("orders_pct_rank", sql=lambda: """
SELECT o_orderkey, round(CASE WHEN o_orderpriority IS NOT NULL AND o_totalprice IS NOT NULL THEN
  (CAST(rank() OVER (PARTITION BY o_orderpriority, (o_totalprice IS NULL) ORDER BY o_totalprice) AS DOUBLE)
   + (count(o_totalprice) OVER (PARTITION BY o_orderpriority, o_totalprice) - 1) / 2e0)
  / count(o_totalprice) OVER (PARTITION BY o_orderpriority) END, 9) AS price_rank FROM orders""", bench=True)
def q_orders_rank(spark, sf_dir):
    """Average-tie percentile rank of the order price within its priority (5 groups of ~20 % each)."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderpriority", "o_totalprice")
    r = RK.pct_rank_column(o, "o_orderpriority", "o_totalprice", "price_rank")
    return r.select("o_orderkey", F.round("price_rank", 9).alias("price_rank"))


def li_scored(spark, sf_dir):
    d = labelled_lineitem(spark, sf_dir, ["l_linestatus"])
    h = F.col("h")
    a, b, c = (h * 13) % 97 + 1, (h * 29) % 89 + 1, (h * 17) % 83 + 1
    tot = a + b + c
    return d.select("l_orderkey", "l_linenumber", "l_linestatus", "y", (b.cast("double") / tot).alias("p1"),
                    (c.cast("double") / tot).alias("p2"))


LI_SCORED_SQL = """WITH ls AS (SELECT l_orderkey, l_linenumber, l_linestatus,
  CAST(CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 WHEN 'R' THEN 2 END AS BIGINT) AS y,
  CAST(((l_orderkey * 8 + l_linenumber) * 29) % 89 + 1 AS DOUBLE) / ((((l_orderkey * 8 + l_linenumber) * 13) % 97 + 1)
    + (((l_orderkey * 8 + l_linenumber) * 29) % 89 + 1) + (((l_orderkey * 8 + l_linenumber) * 17) % 83 + 1)) AS p1,
  CAST(((l_orderkey * 8 + l_linenumber) * 17) % 83 + 1 AS DOUBLE) / ((((l_orderkey * 8 + l_linenumber) * 13) % 97 + 1)
    + (((l_orderkey * 8 + l_linenumber) * 29) % 89 + 1) + (((l_orderkey * 8 + l_linenumber) * 17) % 83 + 1)) AS p2
  FROM lineitem)"""


@register("lineitem_threshold_search", sql=lambda: LI_SCORED_SQL +
          _brute_sql("ls", "p1", "p2", C.threshold_grid(30), "f1_weighted", "j2, j1"), bench=True)
def q_li_search(spark, sf_dir):
    """30 x 30 threshold grid over every lineitem row from one aggregate."""
    grid = C.threshold_grid(30)
    cells = SR.grid_cells(li_scored(spark, sf_dir), F.col("p1"), F.col("p2"), "y", grid)
    best = SR.first_best(SR.cube_scores(cells, len(grid)), "f1_weighted", ["j2", "j1"])
    return SR.with_grid_values(best, grid, {"t_med": "j1", "t_high": "j2"}).select("t_med", "t_high", "f1_weighted")


@register("lineitem_group_f1", sql=lambda: LI_SCORED_SQL + f""",
sc AS (SELECT l_linestatus, y, CASE WHEN p2 >= {dl(0.36)} THEN 2 WHEN p1 >= {dl(0.34)} THEN 1 ELSE 0 END AS pred
       FROM ls),
c AS (SELECT l_linestatus, {counts_sql()} FROM sc GROUP BY l_linestatus)
SELECT l_linestatus, n, round({f1_sql()[0]}, 9) AS f1_weighted, round({f1_sql()[1]}, 9) AS f1_macro FROM c""",
          bench=True)
def q_li_group_f1(spark, sf_dir):
    s = li_scored(spark, sf_dir).withColumn("pred", D.apply_thresholds("p1", "p2", 0.34, 0.36))
    r = M.per_group_scores(s, "l_linestatus")
    return r.select("l_linestatus", "n", F.round("f1_weighted", 9).alias("f1_weighted"),
                    F.round("f1_macro", 9).alias("f1_macro"))
