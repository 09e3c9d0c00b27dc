"""Benchmark decontamination: size-partitioned MinHash containment search (native).

A short test item is *contained* in a document when at least ``THRESHOLD`` of the item's distinct
five-word shingles occur in it.  The sets differ in size by orders of magnitude, so a sketch of the
document of any fixed size would miss short items.  The search therefore signs the items:

1. Items are partitioned by their number of shingles (powers of two).  An item's signature is its k
   shingles of least hash, k being ``floor((1 - threshold) * n) + 1`` for the partition's largest n:
   whichever shingles a containing document lacks, it has one of these, so no item is missed.
2. Each partition has a hash bound (the greatest signature hash of its items).  Shingles of documents
   above every bound are dropped, the others probe the signatures; a hit is a candidate (text, item).
3. Candidates, known by the text's digest, are verified by exact containment on whole texts.

All of it is DataFrame expressions: a document's shingles are made by array functions and never
shuffled; only candidates are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import staged, text_key, text_or_empty

SHINGLE_WORDS = 5
THRESHOLD = 0.8
#: Signatures are broadcast up to so many rows (24 bytes each), and joined by a shuffle beyond.
BROADCAST_SIGNATURES = 2_000_000


def shingles(text: str) -> Column:
    """Hashes of all five-word shingles of a text column, in order; none for shorter texts."""
    words = f"filter(split(lower({text}), '[^\\\\p{{L}}\\\\p{{N}}]+'), w -> w != '')"  # made once a text
    gram = ", ".join(f"ws[i + {j}]" for j in range(SHINGLE_WORDS))
    places = f"IF(size(ws) >= {SHINGLE_WORDS}, sequence(0, size(ws) - {SHINGLE_WORDS}), CAST(array() AS ARRAY<INT>))"
    return F.expr(f"flatten(transform(array({words}), ws -> transform({places}, i -> xxhash64({gram}))))")


def item_shingles(benchmark: DataFrame) -> DataFrame:
    """(item_id, item_shingles) of the items that have any; a null item_id is left out.  Of several
    rows of an item_id the shingles are united."""
    s = (benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_or_empty().alias("text")).where("item_id IS NOT NULL")
         .select("item_id", F.explode(shingles("text")).alias("s")))
    return staged(s.groupBy("item_id").agg(F.array_sort(F.collect_set("s")).alias("item_shingles")), "items")


def signatures(items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(s, item_id, part): the k least shingles of each item, k by the item's size partition."""
    part = F.floor(F.log2(F.size("item_shingles").cast("double"))).cast("int")
    sized = items.withColumn("part", part).withColumn("most", F.max(F.size("item_shingles")).over(Window.partitionBy("part")))
    k = F.least(F.size("item_shingles"), (F.floor(F.lit(1 - threshold + 1e-9) * F.col("most")) + 1).cast("int"))
    return sized.select("item_id", "part", F.explode(F.slice("item_shingles", F.lit(1), k)).alias("s"))


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, text_key, item_id, shared, item_size, containment) for each row of ``docs`` (doc_id,
    text, ...) and item of ``benchmark`` (item_id, text, ...) whose containment reaches ``threshold``.

    ``containment`` is the share of the item's distinct shingles that the whole text has.  Null and
    empty texts, and texts and items under five words, match nothing.  A null doc_id stays null;
    repeated documents give their rows again; other columns are not read; empty tables give an empty
    result."""
    items = item_shingles(benchmark)
    signed = staged(signatures(items, threshold), "item-signatures")
    n_signed, bound = signed.agg(F.count(F.lit(1)), F.max("s")).first()
    probe = signed.select("s", "item_id").distinct()
    if n_signed <= BROADCAST_SIGNATURES:
        probe = F.broadcast(probe)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    bounded = F.filter(shingles("text"), lambda s: s <= F.lit(bound if bound is not None else 0))
    hits = (rows.select(text_key(F.col("text")).alias("text_key"), F.explode(bounded).alias("s"))
            .join(probe, "s").groupBy("text_key").agg(F.collect_set("item_id").alias("item_ids")))
    candidates = staged(hits, "candidates")

    # exact check: the shingles of a candidate text are made once, for all its items
    seen = (rows.withColumn("text_key", text_key(F.col("text"))).join(candidates, "text_key")
            .select("doc_id", "text_key", F.array_distinct(shingles("text")).alias("doc_shingles"), F.explode("item_ids").alias("item_id")))
    shared = F.size(F.array_intersect("doc_shingles", "item_shingles"))
    return (seen.join(items, "item_id")
            .select("doc_id", "text_key", "item_id", shared.cast("long").alias("shared"), F.size("item_shingles").cast("long").alias("item_size"))
            .withColumn("containment", F.col("shared") / F.col("item_size"))
            .where(F.col("containment") >= threshold - 1e-9))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs``, with all columns, without the rows that contain an item."""
    keys = staged(contaminated(docs, benchmark, threshold).select("text_key").distinct(), "leaks")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text_key(text_or_empty()).alias("text_key"))
    return rows.join(keys, "text_key", "left_anti").select(*[F.col("row")[c].alias(c) for c in docs.columns])


def oracle() -> str:
    """DuckDB SQL of the query: containment by joining all shingles, as strings."""
    k = SHINGLE_WORDS
    grams = " || ' ' || ".join(f"w[i + {j}]" for j in range(k))
    return rf"""
WITH d AS (SELECT doc_id, [x FOR x IN regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+') IF x <> ''] AS w FROM documents),
b AS (SELECT item_id, [x FOR x IN regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+') IF x <> ''] AS w FROM benchmark WHERE item_id IS NOT NULL),
ds AS (SELECT DISTINCT doc_id, {grams} AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - {k - 1})) AS i FROM d)),
bs AS (SELECT DISTINCT item_id, {grams} AS g FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - {k - 1})) AS i FROM b)),
n AS (SELECT item_id, count(*) AS item_size FROM bs GROUP BY item_id)
SELECT doc_id, item_id, count(*) AS shared, any_value(item_size) AS item_size, count(*) / any_value(item_size) AS containment
FROM ds JOIN bs USING (g) JOIN n USING (item_id) GROUP BY doc_id, item_id HAVING count(*) / any_value(item_size) >= {THRESHOLD} - 1e-9
"""
