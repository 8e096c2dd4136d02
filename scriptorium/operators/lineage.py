"""Cutting the lineage of loops in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame


def checkpointed(df: DataFrame) -> DataFrame:
    """A checkpoint where ``spark.checkpoint.dir`` says; only a single machine that names no folder gets a local one."""
    spark, sc = df.sparkSession, df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not root:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            made = tempfile.mkdtemp(prefix="scriptorium-")
            atexit.register(shutil.rmtree, made, ignore_errors=True)
            root = f"file://{made}"
        sc.setCheckpointDir(root)
    return df.checkpoint()
