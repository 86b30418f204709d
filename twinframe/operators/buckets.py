"""Candidate pairs from shared bucket keys, and their ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import strongest


def bucket_members(keys: DataFrame, limit: int) -> DataFrame:
    """The first so many members of every bucket: keys is (cluster, key, member, place...), in order of place then member."""
    return strongest(keys.dropDuplicates(["cluster", "key", "member"]), ["cluster", "key"], [F.col("place"), F.col("member")], limit)


def bucket_pairs(keys: DataFrame, limit: int) -> DataFrame:
    """Distinct pairs (cluster, a, b), a < b, of members that share a bucket. The limit bounds a bucket's pairs."""
    m = bucket_members(keys, limit)
    other = m.select("cluster", "key", F.col("member").alias("b"))
    return m.select("cluster", "key", F.col("member").alias("a")).join(other, ["cluster", "key"]).filter("a < b").select("cluster", "a", "b").distinct()


def bucket_cuts(keys: DataFrame, limit: int) -> DataFrame:
    """(cluster, cut): how many members the limit left out of buckets."""
    sizes = keys.dropDuplicates(["cluster", "key", "member"]).groupBy("cluster", "key").agg(F.count("*").alias("n"))
    return sizes.groupBy("cluster").agg(F.sum(F.greatest(F.col("n") - limit, F.lit(0))).alias("cut"))


def best_candidates(pairs: DataFrame, estimate: str, limit: int) -> DataFrame:
    """The pairs of each cluster with the highest estimates, ties by pair."""
    return strongest(pairs, ["cluster"], [F.desc(estimate), F.col("a"), F.col("b")], limit)
