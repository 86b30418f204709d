"""What a cluster's relations say together: actions, risks, kinds, summaries, candidate statistics and the shapes of holes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..policy import Policy

#: Words that mark a boundary.
BOUNDARY = ("auth", "cache", "client", "credential", "database", "network", "password", "permission", "retry", "secret", "security", "timeout")


def cluster_actions(rel: DataFrame, members: DataFrame, policy: Policy | None = None) -> DataFrame:
    """(cluster, place, action, status, confidence, reason): the first of each different action in pair order, at most five; groups of over two members without an edit for all are told not to merge as one.

    members: (cluster, n).
    """
    p = (policy or Policy()).pairs
    each = rel.select("cluster", F.col("confidence").alias("_c"), F.col("l.file").alias("_f"), F.col("l.start_line").alias("_n"), F.posexplode("actions").alias("_k", "a")).select("cluster", "_c", "_f", "_n", "_k", "a.*")
    edits = rel.groupBy("cluster").agg(F.count("*").alias("pairs"), F.count_if(F.exists("actions", lambda a: a["status"] == "recommended")).alias("recommended")).join(members, "cluster")
    broad = edits.filter((F.col("n") > p.group_members) & (F.col("recommended") < F.col("n") * (F.col("n") - 1) / 2))
    stop = broad.select("cluster", F.lit(-1.0).alias("_c"), F.lit("").alias("_f"), F.lit(0).alias("_n"), F.lit(0).alias("_k"), F.lit("do_not_refactor").alias("action"), F.lit("not_recommended").alias("status"), F.lit(0.0).alias("confidence"), F.lit("GROUP_TOO_BROAD_FOR_SINGLE_REFACTOR").alias("reason"))
    order = [F.desc("_c"), F.col("_f"), F.col("_n"), F.col("_k")]
    once = each.union(stop).withColumn("_o", F.row_number().over(Window.partitionBy("cluster", "action", "status", "reason").orderBy(*order))).filter("_o = 1")
    placed = once.withColumn("place", F.row_number().over(Window.partitionBy("cluster").orderBy(*order)))
    return placed.filter(F.col("place") <= p.actions).select("cluster", "place", "action", "status", "confidence", "reason")


def subclusters(rel: DataFrame) -> DataFrame:
    """(cluster, kind, pairs, strongest, mean confidence)."""
    return rel.groupBy("cluster", "kind").agg(F.count("*").alias("pairs"), F.max("confidence").alias("strongest"), F.avg("confidence").alias("mean"))


def cluster_risks(members: DataFrame, policy: Policy | None = None) -> DataFrame:
    """(cluster, risks array) of member rows (cluster and columns of functions): many parameters, different vocabulary, layers, boundaries, tests mixed with other code, uneven evidence, small commonality."""
    p = (policy or Policy()).pairs
    tokens = F.array_distinct(S.identifier_tokens(F.col("symbol")))
    layer = F.concat_ws("/", F.slice(F.split(S.parent(F.col("file")), "/"), 1, 2))
    bound = F.arrays_overlap(F.concat(tokens, S.identifier_tokens(F.col("file"))), F.array(*map(F.lit, BOUNDARY)))
    rows = members.withColumns({"_t": tokens, "_layer": layer, "_bound": bound})
    words = rows.select("cluster", "symbol", F.explode("_t").alias("w")).distinct().groupBy("cluster", "w").agg(F.count_distinct("symbol").alias("k"))
    sizes = rows.groupBy("cluster").agg(
        F.count_distinct("symbol").alias("symbols"), F.max(F.size("parameters")).alias("parameters"), F.count_distinct("_layer").alias("layers"), F.count_if("_bound").alias("bound"), F.count("*").alias("n"), F.count_if("is_test").alias("tests"), F.count_distinct("type_source").alias("sources")
    )
    common = words.join(sizes.select("cluster", "symbols"), "cluster").filter("k = symbols").groupBy("cluster").agg(F.count("*").alias("common"))
    named: list[tuple[str, Column]] = [
        ("many_parameters", F.col("parameters") >= p.risky_parameters),
        ("vocabulary_mismatch", (F.col("symbols") > 1) & F.col("common").isNull()),
        ("layer_mismatch", F.col("layers") > 1),
        ("error_semantics_mismatch", F.col("sources") > 1),
        ("boundary_mismatch", (F.col("bound") > 0) & (F.col("bound") < F.col("n"))),
        ("test_semantics_mismatch", (F.col("tests") > 0) & (F.col("tests") < F.col("n"))),
    ]
    return sizes.join(common, "cluster", "left").select("cluster", F.array_compact(F.array(*[F.when(c, k) for k, c in named])).alias("risks"))


def cluster_confidence(risks: DataFrame, kinds: DataFrame) -> DataFrame:
    """(cluster, confidence): a base raised by kinds of evidence (cluster, kinds array) and lowered by risks."""
    has = lambda *ks: F.arrays_overlap("kinds", F.array(*map(F.lit, ks)))
    score = 0.35 + F.when(has("callable_factory"), 0.05).otherwise(0.0) + F.when(has("callsite_immediate", "callsite_stored_reuse", "callsite_registered", "callsite_pipeline", "callsite_cached"), 0.07).otherwise(0.0)
    score = score + F.when(has("structural_duplicate"), 0.18).otherwise(0.0) + F.when(has("argument_normalization_wrapper"), 0.12).otherwise(0.0) - F.least(F.lit(0.18), 0.03 * F.size("risks"))
    return risks.join(kinds, "cluster").select("cluster", S.round4(F.greatest(F.lit(0.15), F.least(F.lit(0.85), score))).alias("confidence"))


def summaries(members: DataFrame, shown: int = 5) -> DataFrame:
    """(cluster, member_count, files, symbols, ranges): the first so many of each in location order."""
    n = F.row_number().over(Window.partitionBy("cluster").orderBy("file", "start_line", "symbol"))
    rows = members.withColumn("n", n)
    first = lambda c: F.slice(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col("n") <= 64, F.struct("n", F.col(c).alias("v"))))), lambda x: x["v"])), 1, shown)
    return rows.withColumn("range", F.concat_ws(":", "file", F.concat_ws("-", "start_line", "end_line"))).groupBy("cluster").agg(F.count("*").alias("member_count"), first("file").alias("files"), first("symbol").alias("symbols"), first("range").alias("ranges"))


def refactor_shapes(rel: DataFrame) -> DataFrame:
    """Per pair the rendered skeleton: stable statements, its holes with their roles, and the estimate of what a shared function would take."""
    skeleton = F.concat(F.lit("def shared("), F.array_join(F.slice("l.parameters", 1, 6), ", "), F.lit("): "), F.col("stable").cast("string"), F.lit(" stable statements"), F.when(F.col("holes") > 0, F.concat(F.lit(", "), F.col("holes").cast("string"), F.lit(" holes: "), F.array_join("c.uni_roles", "; "))).otherwise(""))
    kind = F.when(F.col("holes") == 0, "extract_function").when((F.col("holes") <= 2) & (F.col("max_hole") <= 1), "parameterize_value").when(F.col("max_hole") <= 3, "pass_callback").otherwise("keep_separate")
    return rel.select("cluster", F.col("l.signature_id").alias("left_id"), F.col("r.signature_id").alias("right_id"), skeleton.alias("skeleton"), kind.alias("shape"), (F.size("l.parameters") + F.col("holes")).alias("parameters_needed"))


def comparison_statistics(candidates: DataFrame, rel: DataFrame) -> DataFrame:
    """One row: clusters, candidate pairs, pairs related, trees measured, matched by body, and over the limit."""
    c = candidates.agg(F.count_distinct("cluster").alias("clusters"), F.count("*").alias("candidates"))
    n = lambda s: F.count_if(F.col("tree_source") == s)
    return c.join(F.broadcast(rel.agg(F.count("*").alias("related"), n("ordered_tree_edit").alias("trees_measured"), n("body_hash").alias("body_matches"), n("edit_product_limit").alias("over_limit"))))
