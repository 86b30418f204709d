"""What the operators of this subpackage share: staging tables, Arrow row streams and connected components."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph

#: Rows that a Python worker holds as Python objects at a time.
ROWS_AT_ONCE = 256

#: Ids or spans up to this number are broadcast (16 MB or so); beyond it the texts are shuffled to them.
BROADCAST_ROWS = 500_000

#: Rows of an Arrow batch in the jobs that run here.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release() -> None:
    """Gives memory that a finished task no longer needs back to the system; Python workers outlive their tasks."""
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries lack it
        ctypes.CDLL(None).malloc_trim(0)


def small(df: DataFrame) -> DataFrame:
    """The table, to be broadcast if its rows are counted and few enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """While jobs run inside, Python workers get texts BATCH_ROWS at a time, which bounds what workers and executors hold."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(BATCH_ROWS, int(before)) if int(before) > 0 else BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage of a small table with a reliable checkpoint."""
    with small_batches(df.sparkSession):
        return graph.reliable(df)


def stage(df: DataFrame) -> DataFrame:
    """Writes a large intermediate as compressed Parquet in the shared folder and reads it back; removed when the driver ends."""
    spark = df.sparkSession
    path = f"{graph.shared_folder(spark)}/twinframe-stage-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)  # nobody looks for the mark
    atexit.register(removed, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a staged table, if it and the JVM are still there."""
    with contextlib.suppress(Exception):  # the JVM may have ended before the interpreter
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def drop(staged: DataFrame) -> None:
    """Deletes what stage() wrote for this table, from which nothing is computed any more."""
    for path in {file.rsplit("/", 1)[0] for file in staged.inputFiles()}:
        removed(staged.sparkSession, path)


def map_rows(df: DataFrame, make: Callable[[], Callable[[list[tuple]], list[tuple]]], schema: str) -> DataFrame:
    """Applies make()'s function to lists of rows (tuples in the columns' order) through Arrow, a bounded number of rows at a time.

    make() runs once for each task, so that models and memos load there. The result may have any number of rows.
    """
    spark = df.sparkSession
    fields = spark.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(start, ROWS_AT_ONCE)
                rows = f(list(zip(*(c.to_pylist() for c in part.columns), strict=True)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), arrow.types, strict=True)], schema=arrow)
        del f
        release()

    return df.mapInArrow(run, fields)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of links (a long, b long): one row (node, root) for every linked node, root its smallest reachable node."""
    return graph.components(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")))
