"""SparkSession construction and checkpoint-folder handling."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
import zipfile

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, app: str = "inclusio", shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    """Session with AQE on and the UI off.

    On a cluster the builder is not used: pass the cluster's own session to the
    operators.  Locally the shuffle partition count follows the core count.
    """
    master = master or os.environ.get("SPARK_MASTER", "local[8]")
    cores = master[master.find("[") + 1:master.find("]")] if "[" in master else "8"
    parts = shuffle_partitions or (os.cpu_count() if cores == "*" else int(cores))
    b = (SparkSession.builder.master(master).appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.shuffle.partitions", str(parts))
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "16g"))
         .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``.  Only a local master, whose one JVM sees every file, may
    run without it: then (in tests) a scratch folder is set for the session."""
    sc = spark.sparkContext
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    held = sc._jsc.sc().getCheckpointDir()
    if conf_dir:
        if not held.isDefined():
            sc.setCheckpointDir(conf_dir)
        return conf_dir.rstrip("/")
    if held.isDefined():
        return held.get().rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="inclusio-ckpt-")
    sc.setCheckpointDir(path)
    return path


_shipped: set[str] = set()
_shipping = threading.Lock()  # fits of several driver threads


def ship(spark: SparkSession) -> None:
    """Send this package to the executors (once a session), as ``--py-files`` would."""
    sc = spark.sparkContext
    with _shipping:
        if sc.applicationId in _shipped:
            return
        top = os.path.dirname(os.path.abspath(__file__))
        to = os.path.join(tempfile.mkdtemp(prefix="inclusio-py-"), "inclusio.zip")
        with zipfile.ZipFile(to, "w") as z:
            for folder, _, names in os.walk(top):
                for name in names:
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        z.write(full, os.path.relpath(full, os.path.dirname(top)))
        sc.addPyFile(to)
        _shipped.add(sc.applicationId)


def reliable_checkpoint(df):
    """``df.checkpoint(eager=True)`` into the shared checkpoint folder (set from the
    session's ``spark.checkpoint.dir`` first if the context has none yet)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def materialised(df, tag: str):
    """``df`` written as Parquet to the shared folder and read again: for tables that several passes
    read, since unlike a checkpoint it keeps column pruning and true sizes."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/inclusio/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
