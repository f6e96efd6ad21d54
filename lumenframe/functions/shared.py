"""The folder that the driver and all executors share, and tables settled there."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder: the one that the cluster names in spark.checkpoint.dir; a local one only where that is unset and all runs on one machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="lumenframe-shared-"))
    return sc.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, so that its lineage ends there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
