"""Line dedup by distinct-site spread: lines that many sites carry are removed as boilerplate.

1. Every line gets a 128-bit digest; per digest, HyperLogLog sketches of the sites are built within
   each task and merged by aggregation.
2. Lines whose estimate is within ``MARGIN`` of the threshold get an exact distinct count.
3. A line that at least ``MIN_SITES`` sites carry is boilerplate.  It stays where it occurs first (least
   doc_id, then place) and is removed everywhere else.
4. Documents that consist of such lines for the most part (``COPY_SHARE`` of their characters) and that
   near-duplicate detection puts in a class with another row are copies of whole documents, not carriers of
   boilerplate: they are left to that stage as they are.  All others lose such lines, whatever their share.
5. A line of more than ``LONG_WORDS`` words is a passage: it needs ``LONG_SITES`` sites only.  At fewer than
   ``MIN_SITES`` sites it stays in all documents of the near-duplicate class of its first place and is removed
   from all others, so that copies of one document stay alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import near_dup
from .common import staged, text_key, text_or_empty

#: Sites that must carry a line.
MIN_SITES = 5
#: Words above which a line is a passage, and the sites that must carry one.
LONG_WORDS = 50
LONG_SITES = 2
#: Estimates within this factor of the threshold are counted exactly.
MARGIN = 0.25
#: log2 of the sketch's registers: a standard error of 1.6 %.
LG_K = 12
#: Share of boilerplate characters from which a document that has a near-duplicate is left as it is.
COPY_SHARE = 0.35
#: White space that is cut off both ends of a line.
BLANKS = " \t\r\f\x0b"
_NO_ID = (1 << 63) - 1


def normal_line(line: Column) -> Column:
    """A line without white space around it."""
    return F.btrim(line, F.lit(BLANKS))


def _rows(docs: DataFrame, site_col: str) -> DataFrame:
    """(rid, tkey, site, text): a row is known by doc_id and the digest of its text and site, so that
    equal rows share one decision."""
    site = F.coalesce(F.col(site_col).cast("string"), F.lit("")) if site_col in docs.columns else F.lit("")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("rid"), text_key(text_or_empty()).alias("tkey"),
                       site.alias("site"), text_or_empty().alias("text"))


def _lines(docs: DataFrame, site_col: str, min_sites: int, long_sites: int) -> DataFrame:
    """(rid, tkey, site, pos, lkey, chars, need) of every line that isn't blank, ``need`` being the sites
    that must carry it: the texts are read once, the steps below read this narrow table."""
    line = normal_line(F.col("line"))
    need = F.when(F.size(F.split("line", r"\s+")) > LONG_WORDS, F.lit(long_sites)).otherwise(F.lit(min_sites))
    return staged(_rows(docs, site_col).select("rid", "tkey", "site", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
                  .select("rid", "tkey", "site", "pos", line.alias("line")).where("line != ''")
                  .select("rid", "tkey", "site", "pos", text_key(F.col("line")).alias("lkey"), F.length("line").alias("chars"), need.alias("need")), "lines")


def line_spread(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(lkey, sites, n_lines, few, first_rid, first_pos, first_tkey) of those of ``lines`` (lkey, site, rid,
    pos, tkey, need) that at least ``need`` sites carry; ``few`` where these are fewer than ``min_sites``.

    ``sites`` is the exact count for lines near the threshold and the estimate for others."""
    spread = staged(lines.groupBy("lkey").agg(
        F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"), F.count(F.lit(1)).alias("n_lines"),
        F.min("need").alias("need"), F.min(F.struct("rid", "pos", "tkey")).alias("first"))
        .where(F.col("n_lines") >= F.col("need"))
        .select("lkey", F.hll_sketch_estimate("sketch").alias("estimate"), "n_lines", "need", F.col("first.rid").alias("first_rid"),
                F.col("first.pos").alias("first_pos"), F.col("first.tkey").alias("first_tkey"))
        .where(F.col("estimate") >= F.col("need") * (1 - MARGIN)), "line-spread")
    # exact near the own threshold, and near the one above which a passage isn't ``few``
    near = spread.where((F.col("estimate") <= F.col("need") * (1 + MARGIN)) | F.col("estimate").between(min_sites * (1 - MARGIN), min_sites * (1 + MARGIN))).select("lkey")
    # (line, site) pairs first: a line that a third of all rows carry is spread over its sites
    exact = (lines.select("lkey", "site").join(near, "lkey", "left_semi").distinct()
             .groupBy("lkey").agg(F.count(F.lit(1)).alias("exact")))
    return staged(spread.join(exact, "lkey", "left").withColumn("sites", F.coalesce("exact", "estimate")).where(F.col("sites") >= F.col("need"))
                  .select("lkey", "sites", "n_lines", (F.col("sites") < min_sites).alias("few"), "first_rid", "first_pos", "first_tkey"), "boilerplate")


def _copies(docs: DataFrame) -> DataFrame:
    """(rid, tkey, class_key) of the rows that are in a near-duplicate class with another row."""
    found = near_dup.near_duplicates(docs).where("class_size > 1")
    return staged(found.select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("rid"), F.col("text_key").alias("tkey"), "class_key").distinct(), "copies")


def _decided(docs: DataFrame, site_col: str, min_sites: int, copy_share: float, shown_copies: bool, long_sites: int) -> DataFrame:
    """(row, clean, n_lines, n_removed, is_copy): each row of ``docs`` as a struct, with its clean text."""
    lines = _lines(docs, site_col, min_sites, long_sites)
    wide = line_spread(lines, min_sites)
    if shown_copies:
        copies = _copies(docs)
        wide = wide.join(copies.withColumnsRenamed({"rid": "first_rid", "tkey": "first_tkey", "class_key": "first_class"}), ["first_rid", "first_tkey"], "left")
    else:
        wide = wide.withColumn("first_class", F.lit(None).cast("binary"))
    hits = (lines.join(wide.select("lkey", "first_rid", "first_pos", "first_class", "few"), "lkey")
            .select("rid", "tkey", F.struct("pos", "chars", ((F.col("rid") != F.col("first_rid")) | (F.col("pos") != F.col("first_pos"))).alias("again"),
                                            "few", F.when(F.col("few"), F.col("first_class")).alias("first_class")).alias("hit")))
    # at most the lines of one text; equal rows give equal hits, which the set holds once
    per_row = hits.groupBy("rid", "tkey").agg(F.collect_set("hit").alias("hits"))
    per_row = per_row.join(copies, ["rid", "tkey"], "left") if shown_copies else per_row.withColumn("class_key", F.lit(None).cast("binary"))
    per_row = staged(per_row, "line-hits")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("rid"), text_key(text_or_empty()).alias("tkey"))
    # the text is shuffled once, within the row
    found = rows.join(per_row, ["rid", "tkey"], "left").withColumn("body", F.coalesce(F.col("row.text").cast("string"), F.lit("")))
    share = F.expr("aggregate(hits, 0L, (s, h) -> s + IF(h.few, 0, h.chars))") / F.greatest(F.lit(1), F.length("body"))
    shown = F.col("class_key").isNotNull() if shown_copies else F.lit(True)
    gone = "h.again AND IF(h.few, class_key IS NULL OR h.first_class IS NULL OR class_key != h.first_class, NOT is_copy)"
    found = (found.withColumn("is_copy", F.coalesce((share >= copy_share) & shown, F.lit(False)))
             .withColumn("gone", F.expr(f"transform(filter(hits, h -> {gone}), h -> h.pos)")))
    clean = F.expr("array_join(filter(split(body, '\\n'), (x, i) -> NOT array_contains(gone, i)), '\\n')")
    acts = F.size("gone") > 0
    return found.select("row", F.when(acts, clean).otherwise(F.col("body")).alias("clean"), F.size(F.split("body", "\n")).cast("long").alias("n_lines"),
                        F.when(acts, F.size("gone")).otherwise(0).cast("long").alias("n_removed"), "is_copy")


def line_report(docs: DataFrame, site_col: str = "source", min_sites: int = MIN_SITES, copy_share: float = COPY_SHARE,
                shown_copies: bool = True, long_sites: int = LONG_SITES) -> DataFrame:
    """doc_id, n_lines, n_removed, is_copy, text (clean) of every row of ``docs`` (doc_id, text, source).

    A null text counts as empty and empty lines are never removed; a row without boilerplate keeps
    its text to the byte.  A null site is one site, as is the whole table without a column
    ``site_col``.  A null doc_id orders after all others.  Equal rows get the same decision (a line's
    first place may so stay in several equal rows).  Without ``shown_copies`` every document of that
    share counts as a copy (as in ``oracle``, which also has ``long_sites`` equal to ``min_sites``).  Other columns are not read; an empty table gives an
    empty result."""
    return (_decided(docs, site_col, min_sites, copy_share, shown_copies, long_sites)
            .select(F.col("row.doc_id").cast("long").alias("doc_id"), "n_lines", "n_removed", "is_copy", F.col("clean").alias("text")))


def dedup_lines(docs: DataFrame, site_col: str = "source", min_sites: int = MIN_SITES, copy_share: float = COPY_SHARE,
                shown_copies: bool = True, long_sites: int = LONG_SITES) -> DataFrame:
    """``docs`` with the same rows and columns, boilerplate lines removed from ``text`` and ``n_chars``
    (where there is one) counted anew for the rows that changed.  Cases as in ``line_report``."""
    out = _decided(docs, site_col, min_sites, copy_share, shown_copies, long_sites)
    changed = F.col("n_removed") > 0

    def column(c):
        old = F.col("row")[c]
        if c == "text":
            return F.when(changed, F.col("clean")).otherwise(old).alias(c)
        if c == "n_chars":
            return F.when(changed, F.length("clean")).otherwise(old).cast(docs.schema[c].dataType).alias(c)
        return old.alias(c)

    return out.select(*[column(c) for c in docs.columns])


def oracle() -> str:
    """DuckDB SQL of the query, with exact distinct counts for every line."""
    return rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS site, coalesce(text, '') AS body, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (
  SELECT doc_id, site, pos - 1 AS pos, trim(ls[pos], concat(' ', chr(9), chr(13), chr(12), chr(11))) AS line
  FROM (SELECT doc_id, site, ls, unnest(generate_series(1, len(ls))) AS pos FROM d)
), w AS (
  SELECT doc_id, site, pos, line, length(line) AS chars FROM l WHERE line <> ''
), wide AS (
  SELECT line, min((doc_id, pos)) AS first FROM w GROUP BY line HAVING count(DISTINCT site) >= {MIN_SITES}
), hits AS (
  SELECT doc_id, sum(chars) AS chars, list(pos) FILTER (WHERE (doc_id, pos) <> first) AS gone
  FROM w JOIN wide USING (line) GROUP BY doc_id
), x AS (
  SELECT d.doc_id, d.body, d.ls, h.gone, coalesce(h.chars / greatest(1, length(d.body)) >= {COPY_SHARE}, false) AS is_copy,
         CASE WHEN h.gone IS NOT NULL THEN len(h.gone) ELSE 0 END AS n
  FROM d LEFT JOIN hits h USING (doc_id)
)
SELECT doc_id, CAST(len(ls) AS BIGINT) AS n_lines, CAST(CASE WHEN is_copy THEN 0 ELSE n END AS BIGINT) AS n_removed, is_copy,
       sha256(CASE WHEN is_copy OR n = 0 THEN body
                   ELSE coalesce(array_to_string([ls[i] FOR i IN generate_series(1, len(ls)) IF NOT list_contains(gone, i - 1)], chr(10)), '') END) AS text_sha256
FROM x
"""
