"""Cutting the lineage of iterative plans."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """``df`` from a reliable checkpoint in the folder that the cluster shares.

    The folder is the context's, or else ``spark.checkpoint.dir``; a local
    session that has neither gets a temporary one.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where and not (context.master or "").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(where or tempfile.mkdtemp(prefix="loomfed-cut-"))
    return df.checkpoint()
