"""Session settings for the engine's jobs."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def get_session(name: str = "shelfmark", master: str | None = None, **conf) -> SparkSession:
    """A session with adaptive execution, skew handling and UTC.

    On a cluster, ``master`` and the number of partitions come from the submit settings;
    adaptive execution sizes shuffle partitions at run time.
    """
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Call sites of column expressions cost more than the expressions.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        # Narrow batches for vectors and pages: a batch is held in memory by a Python worker.
        "spark.sql.execution.arrow.maxRecordsPerBatch": "5000",
        "spark.ui.enabled": "false" if master and master.startswith("local") else "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or one of our own where it is unset (local tests).

    On a cluster the setting is needed: a folder on one machine would be lost with it, and others could not read it.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()
