"""What the operators share: the documents table and cutting lineage in the shared folder."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python task holds at once, at most (one longer document is held alone).
BLOCK_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Python workers get texts in Arrow batches of BLOCK_BYTES (Spark's own default is 64 MB, held several times over on both sides)."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", str(2**31 - 1))) > BLOCK_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BLOCK_BYTES))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where the session names none."""
    if not (base := spark.conf.get("spark.checkpoint.dir", None)):
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = os.path.join(tempfile.gettempdir(), "checkpoints", f"run-{os.getpid()}")
        os.makedirs(base, exist_ok=True)
        spark.conf.set("spark.checkpoint.dir", base)
        atexit.register(shutil.rmtree, base, True)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Spark's own setting: the shuffle files of a query go when it has ended, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write to the shared folder and read back: the rows no longer depend on any executor, and the shuffles that made them are freed."""
    spark = df.sparkSession
    bounded_batches(spark)
    path = fresh_path(spark, name)
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def own_columns(docs: DataFrame) -> list:
    """The columns as they are, whatever their names."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]


def aside(docs: DataFrame, made) -> DataFrame:
    """docs with each column whose name is among `made` (in any case), the names that an operator gives, renamed to `<name>_input`, with
    more `_input` where that name is taken too. No value is lost."""
    made, names = {m.lower() for m in made}, list(docs.columns)
    for k, name in enumerate(names):
        while name.lower() in made or (name != docs.columns[k] and name.lower() in {c.lower() for c in docs.columns}):
            name += "_input"
        names[k] = name
    return docs.toDF(*names) if names != docs.columns else docs


#: A key with more than one row in so many is large: there are at most so many large keys, few enough to broadcast.
HEAVY = 10_000


def met(rows: DataFrame, facts: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """rows with the facts of their keys (one row a key, cut; `size` counts its rows, `total` all). The rows of large keys meet their facts where
    they are, so that no key's rows are gathered; the others by a join."""
    large = F.col(size) > max(1, total // HEAVY)
    heavy, light = facts.where(large), facts.where(~large)
    rest = rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(heavy), keys).unionByName(rest.join(light.hint("merge"), keys))


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def byte_blocks(batches, column: str = "text", limit: int = BLOCK_BYTES):
    """Arrow batches regrouped into slices of at most `limit` bytes of text each."""
    for batch in batches:
        col, start, size = batch.column(column), 0, 0
        for i in range(len(col)):
            n = len(col[i].as_buffer() or b"") if col[i].is_valid else 0
            if size + n > limit and i > start:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        if batch.num_rows > start:
            yield batch.slice(start)


_HELD: dict = {}


def held(key: tuple, make):
    """A worker's helper with its caches. A worker keeps one at a time: operators follow each other in the same processes, and what
    an earlier one kept would only take memory from the next."""
    if key not in _HELD:
        freed()
        _HELD[key] = make()
    return _HELD[key]


def freed() -> None:
    """A worker without helpers, its memory given back to the system."""
    import ctypes

    import pyarrow as pa

    _HELD.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)
