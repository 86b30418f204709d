"""Aggregates and rankings over groups of rows: leads, zero-filled counts, duplicates, subsumption, surfaces, ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import content_digest
from .graph import reliable


def lead_rows(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in an order: all its columns come from one row."""
    return df.withColumn("_place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("_place = 1").drop("_place")


def zero_filled_counts(df: DataFrame, column: str, labels: Sequence[str]) -> DataFrame:
    """(label, n) for each of a fixed list of labels, 0 where there is none."""
    fixed = df.sparkSession.createDataFrame([(x,) for x in labels], "label string")  # as many rows as labels are stated
    counted = df.groupBy(F.col(column).alias("label")).agg(F.count("*").alias("n"))
    return F.broadcast(fixed).join(counted, "label", "left").select("label", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def stable_ids(df: DataFrame, prefix: str, keys: list[str], place: list[str], name: str = "id") -> DataFrame:
    """A digest id of the keys; rows of equal digests are numbered from the second on in the order of place."""
    short = content_digest(*[F.col(k).cast("string") for k in keys])
    n = F.row_number().over(Window.partitionBy("_short").orderBy(*place))
    return df.withColumn("_short", short).withColumn("_n", n).withColumn(name, F.concat(F.lit(prefix), F.col("_short"), F.when(F.col("_n") > 1, F.concat(F.lit("-"), F.col("_n"))).otherwise(""))).drop("_short", "_n")


def equivalents(df: DataFrame, members: str, order: list[Column], extra: list[str] | None = None) -> DataFrame:
    """One row, the first in an order, of those with the same set of members (and the same extra columns)."""
    return lead_rows(df.withColumn("_set", F.array_sort(F.array_distinct(members))), ["_set", *(extra or [])], order).drop("_set")


def subsumed(df: DataFrame, key: str, members: str, same: list[str], rank: str) -> DataFrame:
    """Keys of rows whose members are a strict subset of those of another row that agrees in `same` and ranks no lower (rank <=).

    Members are exploded and pairs counted by shared member; a pair whose count is the smaller set's size is a containment.
    """
    sets = df.select(key, F.array_distinct(members).alias("_m"), *same, rank).withColumn("_n", F.size("_m"))
    flat = sets.select(key, F.explode("_m").alias("_x"), "_n", *same, rank)
    other = flat.select(F.col(key).alias("_k"), "_x", F.col("_n").alias("_on"), *same, F.col(rank).alias("_r"))
    pairs = flat.join(other, ["_x", *same]).filter((F.col("_n") < F.col("_on")) & (F.col("_r") <= F.col(rank)))
    return pairs.groupBy(key, "_k", "_n").agg(F.count("*").alias("_shared")).filter("_shared = _n").select(key).distinct()


def without_subsumed(df: DataFrame, key: str, members: str, same: list[str], rank: str) -> DataFrame:
    return df.join(subsumed(df, key, members, same, rank), key, "left_anti")


def ranked(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Rows numbered in a total order: range-partitioned, sorted and numbered inside each partition, on top of the rows that earlier partitions hold.

    The partitioned rows are cut from their lineage once, with the number of their partition: a range partitioning that is planned
    twice samples its bounds twice. Only the partitions' sizes are summed up, so no task holds all rows.
    """
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parted = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    numbered = reliable(parted.withColumn("_part", F.spark_partition_id()).withColumn("_in", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    sizes = numbered.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each partition
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "_before")
    return numbered.join(F.broadcast(before), "_part").withColumn(name, (F.col("_before") + F.col("_in") + 1).cast("long")).drop("_part", "_in", "_before")


def surfaces(df: DataFrame, target: str, rank: str, tier: str, visible: str) -> DataFrame:
    """The first row of each target by rank, with the surface it shows on: edits, review, or notes; hidden rows are kept with none."""
    first = lead_rows(df, [target], [F.col(rank)])
    surface = F.when(~F.col(visible), F.lit(None)).when(F.col(tier) == "recommended_edit", "edits").when(F.col(tier) == "review_candidate", "review").otherwise("notes")
    return first.withColumn("surface", surface)
