"""Multiclass smoothed target encoding, leak-free per fold.

Fit: the encoded columns are stacked into a narrow long table and reduced
once by ``groupBy(fold, column, value)`` with per-class counts (map-side
combined, so a value holding a third of the rows costs nothing extra).  For
out-of-fold encodings the statistics of "all folds but f" are the total minus
fold f's slice, so k folds need one shuffle instead of k refits.

    enc(col, v, c) = (n_v * mean_v + s * g_c) / (n_v + s),  mean_v = hits_v / n_v
    g_c            = share of class c over all fitted rows (missing values too)

Transform: the fitted table is packed into a dictionary of one row per fold.
For each column it holds an array of hash buckets, each a map of some
``BUCKET_VALUES`` values to their encodings, so a look-up searches one small
map whatever the column's cardinality, and all columns cost one join: a
broadcast on the fold, or a scalar subquery where there are no folds.  Only the
table's size is looked at beforehand; above ``broadcast_limit`` values the rows
are joined column by column instead.  Unseen and missing values get ``g_c``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import config as C
from ..session import materialised

BROADCAST_LIMIT = 2_000_000
#: Values in a bucket of the packed dictionary, on average.
BUCKET_VALUES = 8


ROWS = "__rows__"  # pseudo-column: every row counted once, value 0


def key_type(df: DataFrame, cols: list[str]) -> str:
    """Type in which the values of all columns meet: double where it is exact, else their text."""
    exact = ("double", "float", "int", "smallint", "tinyint", "boolean")
    return "double" if all(t in exact for c, t in df.dtypes if c in cols) else "string"


def _long(df: DataFrame, cols: list[str], keep: list[str], with_rows: bool = False) -> DataFrame:
    kind = key_type(df, cols)
    items = [F.struct(F.lit(c).alias("column_name"), F.col(c).cast(kind).alias("value")) for c in cols]
    if with_rows:
        items.append(F.struct(F.lit(ROWS).alias("column_name"), F.lit(0).cast(kind).alias("value")))
    return df.select(*keep, F.explode(F.array(*items)).alias("s")).select(*keep, "s.column_name", "s.value")


def fit_counts(df: DataFrame, cols: list[str], label: str = C.TARGET_COL, fold_col: str | None = None,
               n_classes: int = C.N_CLASSES) -> tuple[DataFrame, DataFrame]:
    """(value stats, global stats), both keyed by ``fold`` when ``fold_col`` is given.

    One aggregate produces both: the global row counts ride along as the
    pseudo-column ``__rows__``.  The result (distinct values x folds) is small
    and written once, so the stats are read back without another data pass.
    """
    keep = [label] + ([fold_col] if fold_col else [])
    fk = [F.col(fold_col).alias("fold")] if fold_col else []
    long = _long(df.where(F.col(label).isNotNull()), cols, keep, with_rows=True)
    hits = [F.count_if(F.col(label) == c).alias(f"h{c}") for c in range(n_classes)]
    counts = materialised(long.where(F.col("value").isNotNull()).groupBy(*fk, "column_name", "value")
                          .agg(F.count(F.lit(1)).alias("n"), *hits), "encoding-counts")
    vals = counts.where(F.col("column_name") != ROWS)
    glob = counts.where(F.col("column_name") == ROWS).drop("column_name", "value")
    return vals, glob


def _enc(n: Column, h: Column, g: Column, s: float) -> Column:
    return (n * (h / n) + F.lit(s) * g) / (n + F.lit(s))


def fit(df: DataFrame, cols: list[str] = C.TARGET_ENCODE_COLS, label: str = C.TARGET_COL,
        smoothing: float = C.TE_SMOOTHING, n_classes: int = C.N_CLASSES) -> tuple[DataFrame, DataFrame]:
    """Encodings on all rows: ``(column_name, value, n, enc_0..)`` and ``(g_0..)``."""
    vals, glob = fit_counts(df, cols, label, None, n_classes)
    g = glob.select(*[(F.col(f"h{c}") / F.col("n")).alias(f"g{c}") for c in range(n_classes)])
    # the global shares are scalar subqueries over the one-row global table
    enc = vals.select("column_name", "value", "n",
                      *[_enc(F.col("n"), F.col(f"h{c}"), g.select(f"g{c}").scalar(), smoothing).alias(f"enc_{c}")
                        for c in range(n_classes)])
    return enc, g


def fit_out_of_fold(df: DataFrame, fold_col: str = "fold", cols: list[str] = C.TARGET_ENCODE_COLS,
                    label: str = C.TARGET_COL, smoothing: float = C.TE_SMOOTHING,
                    n_classes: int = C.N_CLASSES, n_folds: int = C.N_FOLDS) -> tuple[DataFrame, DataFrame]:
    """Per fold f, encodings fitted on every fold but f (total minus slice f).

    Returns ``(fold, column_name, value, n, enc_*)`` and ``(fold, g_*)``.
    Values seen only in fold f are absent for f (-> global mean at transform).
    """
    vals, glob = fit_counts(df, cols, label, fold_col, n_classes)
    hs = [f"h{c}" for c in range(n_classes)]
    tot_g = glob.agg(F.sum("n").alias("tn"), *[F.sum(h).alias(f"t{h}") for h in hs])
    # no labelled row outside a fold: no global share (and no encoding) for it
    rest = tot_g.select("tn").scalar() - F.col("n")
    g = glob.select("fold", *[F.when(rest > 0, (tot_g.select(f"t{h}").scalar() - F.col(h)) / rest).alias(f"g{c}")
                              for c, h in enumerate(hs)])
    # totals per value, then one row per (fold, value): complement = total - slice
    tot_v = vals.groupBy("column_name", "value").agg(F.sum("n").alias("tn"), *[F.sum(h).alias(f"t{h}") for h in hs])
    per = tot_v.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_folds - 1).cast("bigint")))
                       .alias("fold"))
    comp = (per.join(vals, ["fold", "column_name", "value"], "left").na.fill(0, ["n", *hs])
            .select("fold", "column_name", "value", (F.col("tn") - F.col("n")).alias("n"),
                    *[(F.col(f"t{h}") - F.col(h)).alias(h) for h in hs])
            .where(F.col("n") > 0))
    enc = (comp.join(F.broadcast(g), "fold")
           .select("fold", "column_name", "value", "n",
                   *[_enc(F.col("n"), F.col(f"h{c}"), F.col(f"g{c}"), smoothing).alias(f"enc_{c}")
                     for c in range(n_classes)]))
    return enc, g


def pack(enc: DataFrame, glob: DataFrame, cols: list[str], fold_col: str | None, n_classes: int) -> DataFrame:
    """The fitted table as one row per fold (one row without folds): ``g``, the global shares, and per column
    ``d<i>``, its hash buckets in order, each a map of values to encodings (null if empty)."""
    by = ["fold"] if fold_col else []
    sized = enc.groupBy(*by, "column_name").agg(F.count(F.lit(1)).alias("_n")).select(
        *by, "column_name", F.ceil(F.col("_n") / BUCKET_VALUES).cast("int").alias("_buckets"))
    bucket = F.pmod(F.xxhash64("value"), F.col("_buckets")).cast("int").alias("_b")
    entry = F.struct("value", F.array(*[f"enc_{c}" for c in range(n_classes)]))
    maps = (enc.join(sized, [*by, "column_name"]).select(*by, "column_name", bucket, entry.alias("_e"))
            .groupBy(*by, "column_name", "_b").agg(F.map_from_entries(F.collect_list("_e")).alias("_m")))
    every = sized.select(*by, "column_name", F.explode(F.sequence(F.lit(0), F.col("_buckets") - 1)).alias("_b"))
    full = (every.join(maps, [*by, "column_name", "_b"], "left").groupBy(*by, "column_name")
            .agg(F.collect_list(F.struct("_b", "_m")).alias("_l")))
    in_order = F.transform(F.array_sort("_l", lambda x, y: x["_b"] - y["_b"]), lambda x: x["_m"])
    wide = full.select(*by, "column_name", in_order.alias("_d")).groupBy(*by).agg(
        *[F.first(F.when(F.col("column_name") == c, F.col("_d")), ignorenulls=True).alias(f"d{i}") for i, c in enumerate(cols)])
    if by:
        return glob.select("fold", F.array(*[f"g{c}" for c in range(n_classes)]).alias("g")).join(wide, "fold", "left")
    return wide.select("*", F.array(*[glob.select(f"g{c}").scalar() for c in range(n_classes)]).alias("g"))  # one row, also of an empty table


def _look_up(values: dict, dictionary, cols: list[str], n_classes: int) -> list[Column]:
    """The encoding (an array of the classes) of each column's value; the global shares if it has none."""
    out = []
    for i, c in enumerate(cols):
        buckets, x = dictionary(f"d{i}"), values[c]
        found = F.try_element_at(F.try_element_at(buckets, F.pmod(F.xxhash64(x), F.size(buckets)).cast("int") + 1), x)
        out.append(F.coalesce(found, dictionary("g")).alias(f"__e{i}"))
    return out


def transform(df: DataFrame, enc: DataFrame, glob: DataFrame, cols: list[str] = C.TARGET_ENCODE_COLS,
              fold_col: str | None = None, n_classes: int = C.N_CLASSES, broadcast_limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Add ``<col>_te_<c>`` for every encoded column and class.

    With ``fold_col`` each row uses the encodings of its own fold's complement
    (the held-out encoding).  One broadcast of the packed dictionary serves all
    columns (no shuffle of ``df``) while the fitted table has at most
    ``broadcast_limit`` rows, else one shuffle join per column.
    """
    enc, glob = materialised(enc, "encodings"), materialised(glob, "encoding-shares")
    if enc.limit(broadcast_limit + 1).count() > broadcast_limit:
        return _transform_join(df, enc, glob, cols, fold_col, n_classes)
    kind = dict(enc.dtypes)["value"]
    packed = pack(enc, glob, cols, fold_col, n_classes)
    if not fold_col:
        return apply_packed(df, packed, kind, cols, n_classes)
    here = packed.withColumnsRenamed({c: f"__{c}" for c in packed.columns})
    joined = df.join(F.broadcast(here), F.col(fold_col) == F.col("__fold"), "left")  # one row a fold, size checked above
    return _encoded(joined, df.columns, lambda name: F.col(f"__{name}"), kind, cols, n_classes)


def apply_packed(df: DataFrame, packed: DataFrame, kind: str, cols: list[str] = C.TARGET_ENCODE_COLS, n_classes: int = C.N_CLASSES) -> DataFrame:
    """Encode all rows by a packed dictionary of one row (say one fold's); ``kind``: the type of its values."""
    joined = df.withColumn("__dict", packed.select(F.struct("*")).scalar())
    return _encoded(joined, df.columns, lambda name: F.col("__dict")[name], kind, cols, n_classes)


def _encoded(joined, keep, dictionary, kind, cols, n_classes):
    typed = {c: F.col(c).cast(kind) + F.lit(0.0) if kind == "double" else F.col(c).cast(kind) for c in cols}  # -0.0 is 0.0
    found = joined.select(*keep, *_look_up(typed, dictionary, cols, n_classes))
    return found.select(*keep, *[F.get(f"__e{i}", c).alias(f"{col}_te_{c}") for i, col in enumerate(cols) for c in range(n_classes)])


def _transform_join(df, enc, glob, cols, fold_col, n_classes):
    """One shuffle join per encoded column on ``([fold,] value)``, for dictionaries too large to broadcast;
    the global shares (one row per fold at most) come last."""
    out, raw = df, lambda col, c: f"__{col}_te_{c}"
    for col in cols:
        e = enc.where(F.col("column_name") == col).select(
            *([F.col("fold").alias("__fold")] if fold_col else []), F.col("value").alias("__v"),
            *[F.col(f"enc_{c}").alias(raw(col, c)) for c in range(n_classes)])
        cond = F.col(col).cast(dict(enc.dtypes)["value"]) == F.col("__v")
        if fold_col:
            cond = cond & (F.col(fold_col) == F.col("__fold"))
        out = out.join(e, cond, "left").drop("__v", "__fold")
    if fold_col:
        shares = glob.select(F.col("fold").alias("__fold"), *[F.col(f"g{c}").alias(f"__g{c}") for c in range(n_classes)])
        out = out.join(F.broadcast(shares), F.col(fold_col) == F.col("__fold"), "left")  # one row a fold
    else:
        out = out.select("*", *[glob.select(f"g{c}").scalar().alias(f"__g{c}") for c in range(n_classes)])
    return out.select(*df.columns, *[F.coalesce(raw(col, c), F.col(f"__g{c}")).alias(f"{col}_te_{c}") for col in cols for c in range(n_classes)])


def encoded_columns(cols: list[str] = C.TARGET_ENCODE_COLS, n_classes: int = C.N_CLASSES) -> list[str]:
    return [f"{col}_te_{c}" for c in range(n_classes) for col in cols]
