"""Similarity joins over token sets: document frequencies, rare-token blocking, verification, nearest neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import jaccard
from .graph import reliable, strongest


def exploded(items: DataFrame, tokens: str = "tokens") -> DataFrame:
    """(group, id, token) of items (group, id, tokens array); a token counts once for each item."""
    return items.select("group", "id", F.explode(F.array_distinct(tokens)).alias("token"))


def document_frequency(items: DataFrame) -> DataFrame:
    """(group, token, df)."""
    return exploded(items).groupBy("group", "token").agg(F.count("*").alias("df"))


def rare_tokens(items: DataFrame, max_df: int) -> DataFrame:
    """Tokens that more than one and at most max_df items of a group have."""
    return document_frequency(items).filter((F.col("df") > 1) & (F.col("df") <= max_df))


def shared_rare(items: DataFrame, indexed: DataFrame, max_df: int, least: int) -> DataFrame:
    """Pairs (group, a, b, shared), a < b, of indexed items that share at least so many rare tokens.

    Frequencies count all items; the cut keeps every posting list at max_df items, so the self-join can't blow up on a frequent
    token. Tokens are joined as 64-bit hashes.
    """
    rare = rare_tokens(items, max_df).select("group", F.xxhash64("token").alias("h"))
    posts = exploded(indexed).select("group", "id", F.xxhash64("token").alias("h")).join(rare, ["group", "h"], "left_semi")
    other = posts.select("group", "h", F.col("id").alias("b"))
    return posts.withColumnRenamed("id", "a").join(other, ["group", "h"]).filter("a < b").groupBy("group", "a", "b").agg(F.count("*").alias("shared")).filter(F.col("shared") >= least)


def exact_pairs(indexed: DataFrame, body: str, first: int) -> DataFrame:
    """Pairs (group, a, b) of equal non-empty bodies among the first so many ids of each body."""
    members = strongest(indexed.filter(F.col(body) != "").select("group", "id", body), ["group", body], [F.col("id")], first)
    other = members.select("group", body, F.col("id").alias("b"))
    return members.withColumnRenamed("id", "a").join(other, ["group", body]).filter("a < b").select("group", "a", "b")


def verified(pairs: DataFrame, items: DataFrame, least: float, exact: DataFrame | None = None) -> DataFrame:
    """Pairs with their token sets' similarity (1 for exact ones), of at least `least`.

    Candidates are cut from their lineage, and so are the sets of the items in them: tokens are read once more, for those items
    only. Sizes are compared first: sets of n and m tokens can't be more alike than the smaller over the larger. What is left
    meets as arrays of 64-bit hashes, and only pairs that these let pass are measured on the tokens themselves.
    """
    all_pairs = pairs.select("group", "a", "b", F.lit(False).alias("same"))
    if exact is not None:
        all_pairs = all_pairs.union(exact.select("group", "a", "b", F.lit(True).alias("same"))).groupBy("group", "a", "b").agg(F.bool_or("same").alias("same"))
    all_pairs = reliable(all_pairs)
    wanted = all_pairs.select("group", F.col("a").alias("id")).union(all_pairs.select("group", F.col("b").alias("id"))).distinct()
    sets = reliable(items.select("group", "id", "tokens").join(wanted, ["group", "id"], "left_semi").select("group", "id", F.array_distinct("tokens").alias("t")))
    sized = reliable(sets.select("group", "id", F.size("t").alias("n"), F.transform("t", lambda x: F.xxhash64(x)).alias("h")))
    side = lambda d, name, **c: d.select("group", F.col("id").alias(name), *[F.col(v).alias(k) for k, v in c.items()])
    near = all_pairs.join(side(sized, "a", n="n"), ["group", "a"]).join(side(sized, "b", m="n"), ["group", "b"])
    near = near.filter(F.col("same") | (F.least("n", "m") >= F.greatest("n", "m") * least))
    near = near.join(side(sized, "a", x="h"), ["group", "a"]).join(side(sized, "b", y="h"), ["group", "b"])
    # computed once: a filter over the same expression would compute it again
    near = near.select("group", "a", "b", "same", "n", "m", F.when(F.col("same"), 0).otherwise(F.size(F.array_intersect("x", "y"))).alias("shared"))
    near = near.filter(F.col("same") | (F.col("shared") >= (F.col("n") + F.col("m") - F.col("shared")) * (least - 1e-9)))
    whole = near.join(side(sets, "a", x="t"), ["group", "a"]).join(side(sets, "b", y="t"), ["group", "b"])
    scored = whole.withColumn("similarity", F.when(F.col("same"), 1.0).otherwise(jaccard(F.col("x"), F.col("y"))))
    return scored.filter(F.col("similarity") >= least).select("group", "a", "b", "similarity")


def nearest(edges: DataFrame, k: int) -> DataFrame:
    """Edges that are among the k strongest of at least one of their ends; ties go to the smaller neighbour."""
    sides = edges.select("group", F.col("a").alias("node"), F.col("b").alias("other"), "similarity", "a", "b").union(edges.select("group", F.col("b").alias("node"), F.col("a").alias("other"), "similarity", "a", "b"))
    return strongest(sides, ["group", "node"], [F.desc("similarity"), F.col("other")], k).select("group", "a", "b", "similarity").distinct()


def content_edges(items: DataFrame, indexed: DataFrame, max_df: int = 16, min_shared: int = 2, min_jaccard: float = 0.55, k: int = 8, body: str | None = None, apart: DataFrame | None = None, flag: str | None = None) -> DataFrame:
    """The content index: rare-token pairs and exact bodies, verified, cut to each item's nearest.

    items: (group, id, tokens[, body, flag]). apart: pairs (a, b) already related, left out. flag: a column that both ends must
    agree in. Nulls in tokens count as no tokens; an empty table gives no edges.
    """
    pairs = shared_rare(items, indexed, max_df, min_shared)
    exact = exact_pairs(indexed, body, max_df) if body else None
    if flag:
        flags = items.select("group", F.col("id").alias("a"), F.col(flag).alias("_f")), items.select("group", F.col("id").alias("b"), F.col(flag).alias("_g"))
        agree = lambda p: p.join(flags[0], ["group", "a"]).join(flags[1], ["group", "b"]).filter(F.col("_f").eqNullSafe(F.col("_g"))).select("group", "a", "b")
        pairs, exact = agree(pairs), agree(exact) if exact is not None else None
    if apart is not None:
        known = apart.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        pairs = pairs.join(known, ["a", "b"], "left_anti")
        exact = exact.join(known, ["a", "b"], "left_anti") if exact is not None else None
    return nearest(verified(pairs, items, min_jaccard, exact), k)
