"""Results that are written once, so that what follows doesn't compute them again and a lost executor costs its tasks only."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints, set now if it wasn't: spark.checkpoint.dir, or where that is unset and one machine does all
    the work, one of its own. A cluster has to name one that all executors share."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tidemark-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a reliable checkpoint."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
