"""One registered query for each operator, over its whole table, and DuckDB SQL where there is any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (decontaminate, fingerprint, html_extract, lexical, line_dedup, mixing, near_dup, pii, quality_fm,
               token_count, toxicity_mil, url_filter, whitening)
from .common import table


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_fingerprints(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # copies by their share alone, one threshold for all lines: the query's SQL defines them so
    return (line_dedup.line_report(table(spark, sf_dir, "documents"), shown_copies=False, long_sites=line_dedup.MIN_SITES)
            .select("doc_id", "n_lines", "n_removed", "is_copy", F.sha2("text", 256).alias("text_sha256")))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
            .select("doc_id", "item_id", "shared", "item_size", "containment"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "kept")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_fm.quality_scores(docs, quality_fm.train(docs, table(spark, sf_dir, "labels")))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_extract.main_texts(pages, html_extract.train(pages))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(table(spark, sf_dir, "documents"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = toxicity_mil.toxicity(docs, toxicity_mil.train(docs, table(spark, sf_dir, "labels")))
    where = F.array_join(F.transform("sentences", lambda s: F.format_string("%d:%d", s["start"], s["end"])), ",")
    return found.select("doc_id", "held_out", "score", "predicted", where.alias("sentences"))


QUERIES = {f.__name__: f for f in (op1_source_mix, op2_fingerprints, op3_line_dedup, op4_pii, op5_decontaminate, op6_url_filter,
                                   op7_near_duplicates, op8_quality, op9_main_text, op10_token_counts,
                                   op11_lexical_search, op12_whitening, op13_toxicity)}
ORACLES = {"op1_source_mix": mixing.oracle(), "op3_line_dedup": line_dedup.oracle(),
           "op5_decontaminate": decontaminate.oracle(), "op6_url_filter": url_filter.oracle(),
           "op11_lexical_search": lexical.oracle()}
