"""Files packed as they arrive in a folder (an extension: the job itself is a batch)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quern.operators.codecs import Options
from quern.operators.repack import repack

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def arrivals(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """(path, content) of files that come into the folder, each once."""
    reader = spark.readStream.format("binaryFile").schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", "true")
    return reader.load(folder).select("path", "content")


def pack_arrivals(spark: SparkSession, folder: str, target: str, checkpoint: str, options: Options = Options()) -> StreamingQuery:
    """Each batch through the repack job, its results appended to ``target`` in a folder named by the batch, so that a
    batch that runs again replaces what it wrote."""
    def batch(files: DataFrame, number: int) -> None:
        repack(files, options).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return arrivals(spark, folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
