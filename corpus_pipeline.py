"""Training corpus from raw documents: five stages, each on what the one before it kept.

Every stage is a function (spark, docs, sf_dir) -> DataFrame.  ``run`` writes each stage's rows as
Parquet to the shared folder and reads them again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inclusio.llm import decontaminate, line_dedup, mixing, near_dup, quality_fm
from inclusio.llm.common import staged, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it is trained on labelled rows that aren't held out."""
    return quality_fm.keep_good(docs, quality_fm.train(docs, table(spark, sf_dir, "labels")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without boilerplate lines that stand in documents of many sources."""
    return line_dedup.dedup_lines(docs, long_sites=line_dedup.MIN_SITES)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return near_dup.keep_one_per_class(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document taken, with its source, size, target and the words taken of it."""
    return mixing.mix(docs).where("taken > 0")


STAGES = [("quality", quality), ("line dedup", lines), ("near duplicates", near_duplicates), ("decontamination", benchmark), ("mixing", mixture)]

#: The classifier and the sampled bands have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over all documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
