"""New source files as a stream: each trigger parses what has come since the last one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import scalar
from ..operators import extraction

BINARY = "path string, modificationTime timestamp, length long, content binary"


def stream_functions(spark: SparkSession, folder: str, out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Appends the functions of new files to Parquet under `out`, errors under `out`_errors. A batch that is run again overwrites
    its own folder, so nothing is written twice."""
    found = spark.readStream.format("binaryFile").schema(BINARY).option("recursiveFileLookup", True).load(folder)
    files = found.select("path", scalar.language_of(F.col("path")).alias("language"), "content").where("language <> 'unknown'")

    def write(batch: DataFrame, number: int) -> None:
        parsed = extraction.parse(batch).persist()
        extraction.functions(parsed, f"batch-{number}").write.mode("overwrite").parquet(f"{out}/batch={number}")
        extraction.errors(parsed).write.mode("overwrite").parquet(f"{out}_errors/batch={number}")
        parsed.unpersist()

    writer = files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
