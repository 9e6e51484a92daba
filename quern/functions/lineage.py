"""Cutting the lineage of small but expensive results, in storage every executor can reach."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame, needed: bool = False) -> DataFrame:
    """Checkpoint in the folder the cluster names in spark.checkpoint.dir. A local session without one gets a fresh
    temporary folder; a cluster without one keeps the lineage, which is slower and still right, unless the rows are `needed`
    as they were computed first: then it is an error."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and sc.master.startswith("local"):
            folder = tempfile.mkdtemp(prefix="checkpoint-")
        if folder is None and needed:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if folder is None:
            return df
        sc.setCheckpointDir(folder)
    return df.checkpoint()
