"""The folder that driver and executors share, for what is written between steps."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

from .errors import EngineError


def shared_folder(spark: SparkSession) -> str:
    """The context's checkpoint folder, else the one that `spark.checkpoint.dir` names.

    Where neither is set, a temporary folder becomes the checkpoint folder if all runs in one process; on a cluster, where
    executors would not see it, that is an error.
    """
    context = spark.sparkContext
    if known := context.getCheckpointDir():
        return known
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not named and not (context.master == "local" or context.master.startswith("local[")):
        raise EngineError("spark.checkpoint.dir must name a folder that all executors share")
    context.setCheckpointDir(named or tempfile.mkdtemp())
    return context.getCheckpointDir()


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder of any of Hadoop's file systems; one that is not there is no error."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
