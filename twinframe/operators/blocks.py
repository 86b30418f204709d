"""Runs of equal statements inside otherwise different units: windows, rare windows, maximal runs, overlap removal."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def windows(units: DataFrame, width: int, first: str | None = None) -> DataFrame:
    """(group, unit, start, window, different) for every run of width consecutive keys of units (group, unit, keys array), from position 0 or the column `first` on."""
    begin = F.col(first) if first else F.lit(0)
    starts = F.when(F.size("keys") - width >= begin, F.sequence(begin, F.size("keys") - width)).otherwise(F.array().cast("array<int>"))
    return units.select("group", "unit", "keys", F.explode(starts).alias("start")).select(
        "group", "unit", "start", F.slice("keys", F.col("start") + 1, width).alias("_keys")
    ).select("group", "unit", "start", F.sha2(F.array_join("_keys", "\x1f"), 256).alias("window"), F.size(F.array_distinct("_keys")).alias("different"))


def rare_windows(found: DataFrame, max_df: int, min_distinct: int = 1) -> DataFrame:
    """Windows that more than one and at most max_df units of a group have, with enough different keys."""
    df = found.filter(F.col("different") >= min_distinct).groupBy("group", "window").agg(F.count_distinct("unit").alias("df"))
    return df.filter((F.col("df") > 1) & (F.col("df") <= max_df))


def seeds(found: DataFrame, rare: DataFrame) -> DataFrame:
    """Pairs of places (group, a, a_start, b, b_start), a < b, that share a rare window."""
    hits = found.join(rare.select("group", "window"), ["group", "window"], "left_semi").select("group", "window", "unit", "start")
    other = hits.select("group", "window", F.col("unit").alias("b"), F.col("start").alias("b_start"))
    return hits.withColumnRenamed("unit", "a").withColumnRenamed("start", "a_start").join(other, ["group", "window"]).filter("a < b").select("group", "a", "a_start", "b", "b_start")


def maximal_runs(units: DataFrame, places: DataFrame, first: str | None = None) -> DataFrame:
    """Longest equal runs (group, a, a_start, b, b_start, length) around seed places.

    For each pair of units and diagonal (a's place less b's) that has a seed, keys are compared along the diagonal; equal
    neighbours form islands (position less row number), and islands that hold a seed are kept.
    """
    begin = F.col(first) if first else F.lit(0)
    flat = units.select("group", "unit", F.posexplode("keys").alias("pos", "key"), begin.alias("_first")).filter("pos >= _first").drop("_first")
    diagonals = places.select("group", "a", "b", (F.col("a_start") - F.col("b_start")).alias("diagonal")).distinct()
    left = flat.select("group", F.col("unit").alias("a"), F.col("pos").alias("a_pos"), F.col("key").alias("a_key"))
    right = flat.select("group", F.col("unit").alias("b"), F.col("pos").alias("b_pos"), F.col("key").alias("b_key"))
    along = diagonals.join(left, ["group", "a"]).withColumn("b_pos", F.col("a_pos") - F.col("diagonal")).join(right, ["group", "b", "b_pos"]).filter("a_key = b_key")
    by = ["group", "a", "b", "diagonal"]
    island = along.withColumn("island", F.col("a_pos") - F.row_number().over(Window.partitionBy(*by).orderBy("a_pos")))
    runs = island.groupBy(*by, "island").agg(F.min("a_pos").alias("a_start"), F.min("b_pos").alias("b_start"), F.count("*").cast("int").alias("length"))
    marked = places.withColumn("diagonal", F.col("a_start") - F.col("b_start")).select(*by, F.col("a_start").alias("seed"))
    inside = (F.col("seed") >= F.col("a_start")) & (F.col("seed") < F.col("a_start") + F.col("length"))
    return runs.join(marked, by).filter(inside).select("group", "a", "a_start", "b", "b_start", "length").distinct()


def without_overlaps(occurrences: DataFrame) -> DataFrame:
    """Of occurrences (block, unit, start, length) of a block, longest first, those that don't overlap a kept one in the same unit."""

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates().sort_values(["length", "unit", "start"], ascending=[False, True, True])
        kept: dict = {}
        rows = []
        for r in pdf.itertuples(index=False):
            spans = kept.setdefault(r.unit, [])
            if all(r.start + r.length <= s or e <= r.start for s, e in spans):
                spans.append((r.start, r.start + r.length))
                rows.append(r)
        return pd.DataFrame(rows, columns=pdf.columns)

    schema = occurrences.select("block", "unit", "start", "length").schema
    return occurrences.select("block", "unit", "start", "length").groupBy("block").applyInPandas(pick, schema)
