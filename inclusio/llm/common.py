"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Text that one vectorised step holds at a time, in bytes (a longer text is a step of its own).
CHUNK_BYTES = 1 << 21


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors (once a session), as ``--py-files`` would."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    to = os.path.join(tempfile.mkdtemp(prefix="inclusio-py-"), "inclusio.zip")
    with zipfile.ZipFile(to, "w") as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    sc.addPyFile(to)
    _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``.  Only a local master, whose one JVM sees
    every file, may run without it; then a scratch folder is set for the session."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    sc = spark.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="inclusio-llm-")
    sc.setCheckpointDir(path)
    return path


def staged(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again.

    It cuts the lineage (a lost executor re-reads the table), prunes columns, and gives Spark
    the true size of the table, so that joins with it are broadcast only when it is small."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/inclusio-llm/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def text_key(text: Column) -> Column:
    """128-bit digest of a text: rows with equal texts share it."""
    return F.unhex(F.md5(text))
