"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Settings a job should run with.  Shuffle width is left to the cluster: AQE
#: merges small partitions and splits skewed ones, so the initial number only
#: has to be large enough (``spark.sql.adaptive.coalescePartitions.initialPartitionNum``).
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


#: Settings that must be there when the session starts.  Capturing the Python
#: call site of every column costs more than planning for long expressions.
STATIC = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


def build(master: str | None = None, **extra: str) -> SparkSession:
    """A new session with all settings; ``extra`` uses ``__`` for dots in names."""
    builder = SparkSession.builder.appName("strideflow")
    if master is not None:
        builder = builder.master(master)
    for key, value in {**STATIC, **DEFAULTS}.items():
        builder = builder.config(key, value)
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    """Apply :data:`DEFAULTS` to a running session (all are runtime settings)."""
    for key, value in DEFAULTS.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can read: ``spark.checkpoint.dir`` of the session.

    Only a local session that names none (a test) gets a folder of its own; on a
    cluster a machine-local folder would lose what other executors wrote.
    """
    known = spark.sparkContext.getCheckpointDir()
    if known is not None:
        return known
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="strideflow-checkpoint-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder.

    A lost executor does not lose the files, and later steps read them instead
    of repeating the work behind ``df``.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
