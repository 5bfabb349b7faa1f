"""Cutting lineage, for loops whose plans would grow with each round."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df as a checkpoint in the folder that the cluster names in spark.checkpoint.dir.

    Only a local master without that setting gets a temporary folder; elsewhere its lack is an error.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="leafline-")
        sc.setCheckpointDir(named)
    return df.checkpoint()
