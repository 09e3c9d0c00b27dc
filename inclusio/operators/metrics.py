"""Evaluation and diagnostics from conditional-count aggregates.

Every metric is one ``groupBy(keys).agg(count_if ...)`` over the scored rows
(map-side combined, so a hot group costs nothing extra), followed by
arithmetic on a handful of counts.  F1 is always formed from integer counts
with one formula so equal confusions give equal scores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import config as C
from .quantiles import exact_quantiles

CLASSES = list(range(C.N_CLASSES))


def f1_from_counts(tp: Column, support: Column, predicted: Column) -> Column:
    """2tp / (2tp + fp + fn) = 2tp / (support + predicted); 0 when undefined."""
    den = support + predicted
    return F.when(den > 0, (F.lit(2) * tp) / den).otherwise(F.lit(0.0))


def class_count_aggs(y: str, pred: str, classes=CLASSES) -> list[Column]:
    out = [F.count(F.lit(1)).alias("n")]
    for c in classes:
        out += [F.count_if((F.col(y) == c) & (F.col(pred) == c)).alias(f"tp{c}"),
                F.count_if(F.col(y) == c).alias(f"s{c}"),
                F.count_if(F.col(pred) == c).alias(f"p{c}")]
    return out


def scores_from_counts(classes=CLASSES, prefix: str = "") -> dict[str, Column]:
    """Weighted F1, macro F1 (classes present in truth or prediction), accuracy."""
    col = lambda n: F.col(f"{prefix}{n}")
    f1 = {c: f1_from_counts(col(f"tp{c}"), col(f"s{c}"), col(f"p{c}")) for c in classes}
    n = None
    wsum = None
    present = None
    fsum = None
    tps = None
    for c in classes:
        s = col(f"s{c}")
        n = s if n is None else n + s
        term = s * f1[c]
        wsum = term if wsum is None else wsum + term
        pres = ((col(f"s{c}") + col(f"p{c}")) > 0).cast("int")
        present = pres if present is None else present + pres
        fc = F.when(pres == 1, f1[c]).otherwise(F.lit(0.0))
        fsum = fc if fsum is None else fsum + fc
        tps = col(f"tp{c}") if tps is None else tps + col(f"tp{c}")
    return {
        "f1_weighted": F.when(n > 0, wsum / n).otherwise(F.lit(0.0)),
        "f1_macro": F.when(present > 0, fsum / present).otherwise(F.lit(0.0)),
        "accuracy": F.when(n > 0, tps / n).otherwise(F.lit(0.0)),
    }


def f1_scores(df: DataFrame, y: str = "y", pred: str = "pred", keys=()) -> DataFrame:
    """``(*keys, n, f1_weighted, f1_macro, accuracy)``."""
    g = df.groupBy(*keys) if keys else df.groupBy()
    counts = g.agg(*class_count_aggs(y, pred))
    sc = scores_from_counts()
    return counts.select(*keys, "n", *[v.alias(k) for k, v in sc.items()])


def label_domain(df: DataFrame, name: str = "y") -> DataFrame:
    """The fixed 3-class domain as a tiny frame (so absent classes show as zeros)."""
    return df.sparkSession.range(C.N_CLASSES).select(F.col("id").alias(name))


def confusion_matrix(df: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    """Rows = true class, columns ``pred_0..2``; zero rows kept."""
    m = df.groupBy(F.col(y).alias("y")).agg(
        *[F.count_if(F.col(pred) == c).alias(f"pred_{c}") for c in CLASSES])
    return (label_domain(df).join(m, "y", "left").na.fill(0, [f"pred_{c}" for c in CLASSES])
            .select(F.col("y").cast("bigint").alias("y"), *[F.col(f"pred_{c}").cast("bigint") for c in CLASSES]))


def classification_report(df: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    """Per class precision/recall/F1/support + accuracy, macro avg, weighted avg rows."""
    counts = df.agg(*class_count_aggs(y, pred))
    rows = []
    for c in CLASSES:
        tp, s, p = F.col(f"tp{c}"), F.col(f"s{c}"), F.col(f"p{c}")
        rows.append(F.struct(F.lit(C.TARGET_LABELS[c]).alias("label"),
                             F.when(p > 0, tp / p).otherwise(0.0).alias("precision"),
                             F.when(s > 0, tp / s).otherwise(0.0).alias("recall"),
                             f1_from_counts(tp, s, p).alias("f1"),
                             s.cast("bigint").alias("support")))
    per = counts.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    macro = per.agg(F.lit("macro avg").alias("label"), F.avg("precision").alias("precision"),
                    F.avg("recall").alias("recall"), F.avg("f1").alias("f1"),
                    F.sum("support").cast("bigint").alias("support"))
    weighted = per.agg(F.lit("weighted avg").alias("label"),
                       *[F.when(F.sum("support") > 0, F.sum(F.col(m) * F.col("support")) / F.sum("support"))
                         .otherwise(0.0).alias(m) for m in ("precision", "recall", "f1")],
                       F.sum("support").cast("bigint").alias("support"))
    acc = counts.select(F.lit("accuracy").alias("label"), F.lit(None).cast("double").alias("precision"),
                        F.lit(None).cast("double").alias("recall"),
                        F.when(F.col("n") > 0, (F.col("tp0") + F.col("tp1") + F.col("tp2")) / F.col("n")).otherwise(0.0).alias("f1"),
                        F.col("n").cast("bigint").alias("support"))
    return per.unionByName(acc).unionByName(macro).unionByName(weighted)


def missed_class_report(df: DataFrame, y="y", pred="pred", cls: int = 2) -> DataFrame:
    t = F.col(y) == cls
    return df.agg(F.count_if(t).alias("n_true"), F.count_if(t & (F.col(pred) == cls)).alias("n_correct"),
                  F.count_if(t & (F.col(pred) == 0)).alias("missed_as_low"),
                  F.count_if(t & (F.col(pred) == 1)).alias("missed_as_medium"))


def class_probability_stats(df: DataFrame, prob: str, threshold: float, y="y", pred="pred", cls: int = 2,
                            low: float = 0.3) -> DataFrame:
    t = F.col(y) == cls
    missed = t & (F.col(pred) != cls)
    p = F.col(prob)
    med = exact_quantiles(df.where(t), [], prob, {"median_p": 0.5})
    return df.agg(
        F.avg(F.when(t, p)).alias("mean_p"), med.select("median_p").scalar().alias("median_p"),
        F.min(F.when(t, p)).alias("min_p"), F.max(F.when(t, p)).alias("max_p"),
        F.avg(F.when(t, (p >= threshold).cast("double"))).alias("share_above"),
        F.avg(F.when(missed, p)).alias("missed_mean_p"), F.max(F.when(missed, p)).alias("missed_max_p"),
        F.avg(F.when(missed, ((p >= low) & (p < threshold)).cast("double"))).alias("missed_share_band"))


def false_positive_report(df: DataFrame, y="y", pred="pred", cls: int = 2) -> DataFrame:
    fp = (F.col(pred) == cls) & (F.col(y) != cls)
    return df.agg(F.count_if(fp).alias("n_false"), F.count_if(fp & (F.col(y) == 0)).alias("actual_low"),
                  F.count_if(fp & (F.col(y) == 1)).alias("actual_medium"))


def per_group_scores(df: DataFrame, group: str, y="y", pred="pred") -> DataFrame:
    """Per group: n, class counts, weighted and macro F1, High true / predicted."""
    counts = df.where(F.col(group).isNotNull()).groupBy(group).agg(*class_count_aggs(y, pred))
    sc = scores_from_counts()
    return counts.select(group, "n", F.col("s0").alias("n_low"), F.col("s1").alias("n_medium"),
                         F.col("s2").alias("n_high"), F.col("p2").alias("pred_high"),
                         sc["f1_weighted"].alias("f1_weighted"), sc["f1_macro"].alias("f1_macro"))


def boundary_confusion(df: DataFrame, y="y", pred="pred") -> DataFrame:
    med_low = F.count_if((F.col(y) == 1) & (F.col(pred) == 0))
    low_med = F.count_if((F.col(y) == 0) & (F.col(pred) == 1))
    n_med, n_low = F.count_if(F.col(y) == 1), F.count_if(F.col(y) == 0)
    # an absent class has no rate
    return df.agg(med_low.alias("medium_as_low"), F.when(n_med > 0, med_low / n_med).alias("medium_as_low_rate"),
                  low_med.alias("low_as_medium"), F.when(n_low > 0, low_med / n_low).alias("low_as_medium_rate"))


def probability_ranges(df: DataFrame, probs: list[str], y="y") -> DataFrame:
    """mean / exact median / max of each class probability by true class (long table)."""
    st = F.explode(F.array(*[F.struct(F.lit(i).cast("bigint").alias("prob_class"), F.col(p).alias("p"))
                             for i, p in enumerate(probs)]))
    long = df.select(F.col(y).alias("y"), st.alias("s")).select("y", "s.prob_class", "s.p")
    mom = long.groupBy("y", "prob_class").agg(F.avg("p").alias("mean_p"), F.max("p").alias("max_p"))
    med = exact_quantiles(long, ["y", "prob_class"], "p", {"median_p": 0.5})
    return mom.join(med, ["y", "prob_class"], "left").select("y", "prob_class", "mean_p", "median_p", "max_p")


def predicted_rate_by_group(df: DataFrame, group: str, pred="pred", cls: int = 2) -> DataFrame:
    """Per known group (missing group left out, as the per-country report does)."""
    return df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(pred) == cls).alias("n_pred"),
                                 (F.count_if(F.col(pred) == cls) / F.count(F.lit(1))).alias("pred_rate"))
