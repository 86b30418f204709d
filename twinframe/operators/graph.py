"""Grouping by links: connected components, and components of bounded size."""

from __future__ import annotations

import re
import tempfile

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def shared_folder(spark) -> str:
    """The folder that driver and executors share. A temporary one only in local sessions that name none; elsewhere each executor would write its own disk, so that is an error."""
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    named = spark.conf.get("spark.checkpoint.dir", None) or (own.get() if own.isDefined() else None)
    if named:
        return named
    if not re.match(r"local(\[[^]]*\])?$", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    path = tempfile.mkdtemp(prefix="twinframe-")
    spark.sparkContext.setCheckpointDir(path)
    return path


def reliable(df: DataFrame) -> DataFrame:
    """Cuts lineage by a checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Salts of a node in joins with its minimum.
SALTS = 4


def with_minimum(edges: DataFrame, low: DataFrame) -> DataFrame:
    """edges (u, v) with m of low (u, m), one row for each u. Salted, so that a hot node's edges are dealt to several tasks, and so that both sides are dealt anew, which lets AQE split what is still too much."""
    salted = low.withColumn("s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return edges.withColumn("s", F.pmod(F.xxhash64("v"), F.lit(SALTS))).join(salted, ["u", "s"]).drop("s")


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, root) for every linked node of edges (a, b) of any ordered type; root is its smallest reachable node.

    Alternating large-star and small-star steps until nothing changes: grouped minima, which are summed up before they are dealt
    out, and salted equi-joins; an error if that takes more than so many rounds. The number of rounds grows with the logarithm of the longest chain; each is checkpointed. Null
    ends and self-links are ignored.
    """
    e = reliable(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    seen = None
    for _ in range(rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = with_minimum(both.filter("v > u"), low).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        e = reliable(with_minimum(large, least).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").union(least.select("u", F.col("m").alias("v"))).distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            break
        seen = now
    else:
        raise RuntimeError(f"components are unfinished after {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def bounded_components(edges: DataFrame, limit: int) -> DataFrame:
    """Edges (a, b, weight) with the component each falls into when the strongest are joined first and joins beyond `limit` nodes are refused.

    Refused edges have no row; an edge inside a component stays. Which joins are refused depends on the order, so each connected
    component (they are split first, without the limit) is walked in one task; ties go by a, then b. component is its smallest node.
    """
    roots = components(edges)
    placed = edges.join(roots, edges["a"] == roots["node"]).drop("node")

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["weight", "a", "b"], ascending=[False, True, True], kind="stable")
        above: dict = {}
        size: dict = {}

        def top(x):
            above.setdefault(x, x)
            size.setdefault(x, 1)
            while above[x] != x:
                above[x] = above[above[x]]
                x = above[x]
            return x

        keep = []
        for a, b in zip(pdf["a"], pdf["b"], strict=True):
            x, y = top(a), top(b)
            fits = x == y or size[x] + size[y] <= limit
            if fits and x != y:
                above[x] = y
                size[y] += size[x]
            keep.append(fits)
        out = pdf[keep].copy()
        tops = [top(a) for a in out["a"]]
        least: dict = {}
        for t, a, b in zip(tops, out["a"], out["b"], strict=True):
            least[t] = min(least.get(t, a), a, b)
        out["component"] = [least[t] for t in tops]
        return out[["a", "b", "weight", "component"]]

    kind = edges.schema["a"].dataType.simpleString()
    return placed.select("root", "a", "b", F.col("weight").cast("double").alias("weight")).groupBy("root").applyInPandas(walk, f"a {kind}, b {kind}, weight double, component {kind}")


def strongest(df: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each group in an order."""
    return df.withColumn("_place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_place") <= k).drop("_place")
