"""Memo tables: results keyed by namespace and digest, kept as Parquet, so that a later run computes misses only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import __version__


def key(*columns: str):
    """A digest of columns under this version of the code."""
    return F.sha2(F.to_json(F.struct(F.lit(__version__).alias("_version"), *columns)), 256)


class Memo:
    def __init__(self, spark: SparkSession, path: str, namespace: str):
        self.spark, self.path, self.namespace = spark, f"{path.rstrip('/')}/{namespace}", namespace

    def known(self, schema) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(self.path)
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def through(self, rows: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """compute(rows) with a column _key kept, of which results known under their _key aren't computed again; misses are appended."""
        schema = compute(rows.limit(0)).schema
        old = self.known(schema)
        hits = old.join(rows.select("_key").distinct(), "_key", "left_semi")
        new = compute(rows.join(old.select("_key"), "_key", "left_anti"))
        new.write.mode("append").parquet(self.path)
        return self.known(schema).join(rows.select("_key").distinct(), "_key", "left_semi") if new.schema == schema else hits.unionByName(new)

    def statistics(self) -> DataFrame:
        return self.spark.read.parquet(self.path).agg(F.count("*").alias("entries")).withColumn("namespace", F.lit(self.namespace))
