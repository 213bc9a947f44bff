"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame


#: Spark's own setting: the shuffle files of a query go when it has ended, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def meet(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """Equi-join of two frames that both grow with the input, shuffled. Left alone, Spark broadcasts a frame of small files, which
    unpacks to many times their size, through the driver."""
    return left.join(right.hint("merge"), on, how)


def cut(df: DataFrame) -> DataFrame:
    """Write to spark.checkpoint.dir and read back; a local folder serves only where the session names none. The shuffles that made the
    rows are freed."""
    spark = df.sparkSession
    if not (base := spark.conf.get("spark.checkpoint.dir", None)):
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = os.path.join(tempfile.gettempdir(), "checkpoints", f"run-{os.getpid()}")
        os.makedirs(base, exist_ok=True)
        spark.conf.set("spark.checkpoint.dir", base)
        atexit.register(shutil.rmtree, base, True)
    path = f"{base.rstrip('/')}/cut-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
