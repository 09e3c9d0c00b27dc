"""Mixing sources to target weights: Efraimidis-Spirakis sampling under token budgets (native).

Every document draws an exponential key ``-ln(u) / quality``; in each source the documents of least
key go first, as in sampling without replacement by quality.  A source whose target is above its own
size is taken whole as often as it fits (complete epochs); the fraction that is left is filled by key
order until its words are used up, the last document up to the budget.

The prefix sums need no sort of a whole source in one task: documents are counted in buckets of the
key's logarithm, coarse and fine ones, and only the documents of the one fine bucket in which a
source's budget ends are sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import staged, text_or_empty

#: Buckets of a unit of the key's logarithm: coarse ones, and fine ones within a coarse one.
COARSE = 16
FINE = 4096
#: Weights of the sources in code point order, repeating (the query's).
SOURCE_WEIGHTS = (5, 2, 1)
#: Words of the mix over the words of all sources, and most epochs of a source (the query's).
SHARE = 1.5
MOST_EPOCHS = 2.0
SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """Share of letters among the characters that aren't white space, at least 0.05."""
    letters = F.length(F.regexp_replace(text, r"[^a-zA-ZÀ-ɏ]", ""))
    solid = F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]", ""))
    return F.coalesce(F.greatest(F.lit(0.05), letters / F.greatest(solid, F.lit(1))), F.lit(0.05))


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from a digest: 52 bits, the same for the same parts in every run."""
    digest = F.md5(F.concat_ws("|", *parts))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights=SOURCE_WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS) -> DataFrame:
    """(src, is_null, source_size, target) from (src, is_null, source_size), one row a source.

    ``share`` times all words are dealt by weight; no target is above ``most`` times its source's
    size, and what is above is dealt again by weight among the others.  That is the level at which
    ``sum(min(cap, level * weight))`` meets the total: with the sources in order of cap / weight it
    follows from prefix sums.  The number of sources is the only thing that meets in one task."""
    by_name = Window.orderBy("is_null", "src")
    n = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (n % len(weights) + 1).cast("int"))
    s = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "is_null", "src")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    s = s.withColumn("total", F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share)))
    s = s.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    # the first source in this order that stays below its cap has the highest of the levels that fit
    s = s.withColumn("level", F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(Window.partitionBy()))
    return s.select("src", "is_null", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def mix(docs: DataFrame, size: Column | None = None, quality: Column | None = None, weights=SOURCE_WEIGHTS,
        share: float = SHARE, most: float = MOST_EPOCHS, seed: str = SEED) -> DataFrame:
    """Every row of ``docs`` (doc_id, text, source, ...) with what the mix takes of it.

    Columns: doc_id, source, size (words), source_size, target (of its source), quality, taken: the
    words taken, repeats counted (``epochs * size``, and in the fractional epoch the whole text, its
    first words, or nothing).  Each source's taken words are the floor of its target.  A null or
    empty text has size 0 and takes 0; null sources are one source, after all others; a null doc_id
    draws its key by the text alone; equal rows tie and are taken one after the other; of other ties
    the lesser doc_id goes first.  Columns other than doc_id, text and source are read only by
    ``size`` and ``quality``; an empty table gives an empty result."""
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("src"),
                       F.col("source").isNull().cast("int").alias("is_null"),
                       (word_count(text) if size is None else size).cast("long").alias("size"),
                       (quality_weight(text) if quality is None else quality).cast("double").alias("quality"),
                       uniform(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(text_or_empty())).alias("u"))
    rows = rows.withColumn("key", -F.log("u") / F.col("quality"))
    rows = rows.withColumn("fine", F.floor(F.log("key") * FINE).cast("long")).withColumn("coarse", F.floor(F.col("fine") / (FINE // COARSE)).cast("long"))
    rows = staged(rows.drop("u"), "mix-rows")  # narrow: no text

    group = ["src", "is_null"]
    fine = staged(rows.groupBy(*group, "coarse", "fine").agg(F.sum("size").alias("words")), "mix-buckets")
    sizes = fine.groupBy(*group).agg(F.sum("words").alias("source_size"))
    target = source_targets(sizes, weights, share, most)
    target = target.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    target = staged(target.withColumn("rest", F.floor(F.col("target")).cast("long") - F.col("epochs") * F.col("source_size")), "mix-targets")

    def ends_in(buckets: DataFrame, bucket: str, rest: DataFrame) -> DataFrame:
        """Per source the bucket in which the budget ends, and the words left for it."""
        run = Window.partitionBy(*group).orderBy(bucket)
        b = buckets.join(rest, group).withColumn("upto", F.sum("words").over(run))
        return (b.where((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("words") <= F.col("rest")))
                .select(*group, F.col(bucket).alias(f"end_{bucket}"), (F.col("rest") - F.col("upto") + F.col("words")).alias("rest")))

    coarse = fine.groupBy(*group, "coarse").agg(F.sum("words").alias("words"))
    at_coarse = ends_in(coarse, "coarse", target.select(*group, "rest"))
    inside = fine.join(at_coarse.select(*group, F.col("end_coarse").alias("coarse")), [*group, "coarse"], "left_semi").select(*group, "fine", "words")
    at_fine = ends_in(inside, "fine", at_coarse.select(*group, "rest"))
    plan = staged(target.select(*group, "source_size", "target", "epochs").join(at_fine, group, "left"), "mix-plan")

    # documents below the last bucket are taken whole, those in it by a prefix sum in key order
    named = rows.join(plan, group)
    last = named.where(F.col("fine") == F.col("end_fine"))
    run = Window.partitionBy(*group).orderBy("key", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, -1)
    part = F.greatest(F.lit(0), F.least("size", F.col("rest") - F.coalesce(F.sum("size").over(run), F.lit(0))))
    last = last.withColumn("part", part)
    others = (named.where(F.col("end_fine").isNull() | (F.col("fine") != F.col("end_fine")))
              .withColumn("part", F.when(F.col("fine") < F.col("end_fine"), F.col("size")).otherwise(F.lit(0)).cast("long")))
    out = others.unionByName(last)
    return out.select("doc_id", F.when(F.col("is_null") == 0, F.col("src")).alias("source"), "size", "source_size", "target", "quality",
                      (F.col("epochs") * F.col("size") + F.col("part")).alias("taken"))


def oracle() -> str:
    """DuckDB SQL of the query: the resharing level by source, the prefix sum by one window."""
    ws = ", ".join(f"{float(w)}" for w in SOURCE_WEIGHTS)
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS src, CAST(source IS NULL AS INT) AS is_null, coalesce(text, '') AS body,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         CASE WHEN text IS NULL THEN 0.05 ELSE greatest(0.05, length(regexp_replace(text, '[^a-zA-Z\\x{{C0}}-\\x{{24F}}]', '', 'g'))
              / greatest(length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')), 1)) END AS quality
  FROM documents
), k AS (
  SELECT *, -ln((CAST(('0x' || substr(md5('{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(body)), 1, 13)) AS BIGINT) + 0.5)
            / 4503599627370496.0) / quality AS k
  FROM d
), s AS (
  SELECT src, is_null, sum(size) AS source_size FROM d GROUP BY ALL
), s1 AS (
  SELECT *, [{ws}][((row_number() OVER (ORDER BY is_null, src) - 1) % {len(SOURCE_WEIGHTS)}) + 1] AS weight, source_size * {MOST_EPOCHS} AS cap,
         sum(source_size) OVER () * {SHARE} AS total FROM s
), s2 AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, is_null, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY cap / weight, is_null, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level0 FROM s1
), s3 AS (
  SELECT *, max(level0) FILTER (WHERE level0 * weight <= cap) OVER () AS level FROM s2
), t AS (
  SELECT src, is_null, CAST(source_size AS BIGINT) AS source_size, least(cap, coalesce(level * weight, cap)) AS target FROM s3
), t2 AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t
), r AS (
  SELECT k.doc_id, k.size, t2.source_size, t2.target, t2.epochs, CAST(floor(t2.target) AS BIGINT) - t2.epochs * t2.source_size AS rest,
         coalesce(sum(k.size) OVER (PARTITION BY k.src, k.is_null ORDER BY k.k, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM k JOIN t2 USING (src, is_null)
)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken FROM r
"""
