"""File arrivals as a stream: new source files are described, each content once, and their functions extracted batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType, TimestampType

from ..plans.analyze import extract
from ..sources import files

SCHEMA = StructType([StructField("path", StringType()), StructField("modificationTime", TimestampType()), StructField("length", LongType()), StructField("content", BinaryType())])


def arrivals(spark: SparkSession, folder: str, lateness: str = "1 hour") -> DataFrame:
    """(path, content, size, modified) of files as they arrive; a file of the same path and content that comes again within the lateness is dropped."""
    raw = spark.readStream.format("binaryFile").schema(SCHEMA).option("recursiveFileLookup", "true").load(folder)
    rows = raw.select("path", "content", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("digest"))
    return rows.withWatermark("modified", lateness).dropDuplicatesWithinWatermark(["path", "digest"]).drop("digest")


def extract_arrivals(spark: SparkSession, folder: str, output: str, checkpoint: str, describe: Callable[[DataFrame], DataFrame] = files.describe):
    """A query that appends the functions of arriving files to a Parquet table; stops when there is nothing more (trigger availableNow)."""

    def each(batch: DataFrame, number: int) -> None:
        functions = extract(describe(batch)).functions
        functions.withColumn("batch", F.lit(number)).write.mode("append").parquet(output)

    return arrivals(spark, folder).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
