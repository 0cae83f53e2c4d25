"""What operators need of the session: the folder that driver and executors share."""

from __future__ import annotations

import gc
import os

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a folder of this machine serves a local master; a cluster must name one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = jvm_dir.get() if jvm_dir.isDefined() else None
        if folder is None:
            master = spark.sparkContext.master
            if not (master == "local" or master.startswith("local[")):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            folder = f"/tmp/loomwork-checkpoints-{os.getpid()}"
            spark.sparkContext.setCheckpointDir(folder)
    return folder


def tidy(spark: SparkSession) -> None:
    """Lets Spark's cleaner take away shuffles and checkpoints that nothing refers to any more: it learns of them when the driver's
    memory is collected, which may be long after a round is over."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def settle(df: DataFrame) -> DataFrame:
    """Computes the rows once and cuts lineage, in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
