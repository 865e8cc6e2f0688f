"""Tables recompressed by Spark's own readers and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Each page is compressed with a state of its own, which at level 19 costs more to set up (0.1 CPU seconds) than a page
#: of the default 20,000 rows costs to compress. Small dictionaries keep columns of many values from half a dictionary.
PAGES = {"page.row.count.limit": 1 << 19, "page.size": 2 << 20, "dictionary.page.size": 1 << 18}


def recompress_parquet(spark: SparkSession, source: str, target: str, ultra: bool = False) -> DataFrame:
    """All columns and rows of ``source`` as zstd Parquet at level 19 (22 if ultra), timestamps in microseconds, rows in
    their order. A source of fewer row groups than there are cores is dealt to all of them, by row number, before the
    encoding, which is most of the work; a larger one is encoded where it is read, without a shuffle."""
    frame = spread(spark.read.parquet(source))
    writer = frame.write.mode("overwrite").option("compression", "zstd").option("parquet.compression.codec.zstd.level", 22 if ultra else 19)
    for key, value in PAGES.items():
        writer.option(f"parquet.{key}", value)
    writer.option("outputTimestampType", "TIMESTAMP_MICROS").parquet(target)
    return spark.read.parquet(target)


def spread(frame: DataFrame) -> DataFrame:
    cores = frame.sparkSession.sparkContext.defaultParallelism
    if frame.rdd.getNumPartitions() >= cores:
        return frame
    at = "__row"
    while at in frame.columns:
        at += "_"
    numbered = frame.withColumn(at, F.monotonically_increasing_id())
    return numbered.repartitionByRange(cores, at).sortWithinPartitions(at).drop(at)


def recompress_orc(spark: SparkSession, source: DataFrame, target: str) -> DataFrame:
    source.write.mode("overwrite").option("compression", "zstd").orc(target)
    return spark.read.schema(source.schema).orc(target)
