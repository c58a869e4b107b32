"""Lineage cuts for iterative plans, in the checkpoint folder that the session names."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint; a folder is made only where the session names none (a single machine)."""
    spark = df.sparkSession
    context = spark.sparkContext._jsc.sc()
    if not spark.conf.get("spark.checkpoint.dir", None) and not context.getCheckpointDir().isDefined():
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="latticework-"))
    return df.checkpoint(eager=True)
