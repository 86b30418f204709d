"""Scoring pairs of functions: cheap similarities first, then the tree distance of pairs that can still matter, then decisions.

Everything but alignment and tree distance is column expressions over two feature structs, l and r. Trees are compared once for
each unordered pair of body hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.structure import compare, compare_trees
from ..policy import Policy
from ..vocab import CLONE_OF_RELATION, DELTA_RISK, RELATEDNESS
from .graph import strongest

EXACT_TREES = ("body_hash", "ordered_tree_edit")

COMPARED = (
    "seq_lcs int, seq_prefix int, seq_suffix int, seq_inserted int, seq_position string, seq_longest int, seq_similarity double, uni_stable int, uni_stable_ratio double, "
    "uni_prefix int, uni_suffix int, uni_holes int, uni_max_hole int, uni_variance string, uni_shared_flow boolean, uni_roles array<string>"
)
TREES = "distance long, nodes int, same_skeleton boolean, same_operators boolean, operator_changed boolean"


def sequences(*columns: Column) -> Column:
    """Alignment and anti-unification of statement sequences and their keys (left's two, right's two) as a struct."""

    @F.pandas_udf(COMPARED)
    def compared(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        names = [c.split(" ")[0] for c in COMPARED.split(", ")]
        for ls, lk, rs, rk in parts:
            rows = zip(map(list, ls), map(list, lk), map(list, rs), map(list, rk), strict=True)
            yield pd.DataFrame([compare({"statements": a, "statement_keys": k}, {"statements": b, "statement_keys": m}) for a, k, b, m in rows], columns=names)

    return compared(*columns)


def tree_comparisons(pairs: DataFrame, limit: int) -> DataFrame:
    """(h1, h2, tree struct) for the distinct unordered pairs of different body hashes whose functions have trees."""
    flip = F.col("l.body_hash") > F.col("r.body_hash")
    trees = pairs.filter("l.body_hash <> r.body_hash and l.tree is not null and r.tree is not null").select(
        F.least("l.body_hash", "r.body_hash").alias("h1"), F.greatest("l.body_hash", "r.body_hash").alias("h2"),
        F.when(flip, F.col("r.tree")).otherwise(F.col("l.tree")).alias("t1"), F.when(flip, F.col("l.tree")).otherwise(F.col("r.tree")).alias("t2"),
    ).dropDuplicates(["h1", "h2"])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = [{"h1": h1, "h2": h2, **compare_trees(t1, t2, limit)} for h1, h2, t1, t2 in pdf.itertuples(index=False, name=None)]
            out = pd.DataFrame(rows, columns=["h1", "h2", "distance", "nodes", "same_skeleton", "same_operators", "operator_changed"])
            out["distance"] = out["distance"].astype("Int64")
            yield out

    return trees.mapInPandas(run, f"h1 string, h2 string, {TREES}").select("h1", "h2", F.struct(*[c.split(" ")[0] for c in TREES.split(", ")]).alias("tree"))


def relatedness(scores: dict[str, Column], absent: dict[str, Column]) -> Column:
    """The weighted mean of the scores with evidence, lifted to 0.1..1."""
    total = sum(RELATEDNESS.values())
    weight = lambda k: F.when(absent[k], 0.0).otherwise(RELATEDNESS[k]) if k in absent else F.lit(RELATEDNESS[k])
    weighted, weights = F.lit(0.0), F.lit(0.0)
    for k in RELATEDNESS:
        weighted, weights = weighted + weight(k) * scores[k], weights + weight(k)
    return S.round4(F.least(F.lit(1.0), 0.10 + total * weighted / weights))


def aligned(side: str) -> Column:
    keys, statements = F.col(f"{side}.statement_keys"), F.col(f"{side}.statements")
    return F.when((F.size(keys) > 0) & (F.size(keys) == F.size(statements)), keys).otherwise(statements)


def differ(name: str) -> Column:
    return ~F.col(f"l.{name}").eqNullSafe(F.col(f"r.{name}"))


def has(side: str, name: str, value: str) -> Column:
    return F.array_contains(F.col(f"{side}.{name}"), value)


def starting(side: str, prefix: str) -> Column:
    return F.size(F.filter(F.col(f"{side}.statements"), lambda x: F.startswith(x, F.lit(prefix))))


def tail_reads(side: str) -> Column:
    """Parameters read in statements from the common prefix on."""
    late = F.filter(F.col(f"{side}.statement_arg_reads"), lambda x: x["idx"] >= F.col("c.seq_prefix"))
    return F.flatten(F.transform(late, lambda x: x["roles"]))


def normalization() -> Column:
    """Whether one side only decodes or encodes its argument before the operation that both share."""
    one = lambda s: (F.size(f"{s}.parameters") == 1) & (F.array_join(F.col(f"{s}.statements"), "\x1f") == "RETURN:ARG0")
    plain = lambda s: F.array_except(F.col(f"{s}.calls"), F.coalesce(F.col(f"{s}.transforms"), F.array().cast("array<string>")))
    count = lambda s: F.coalesce(F.size(f"{s}.transforms"), F.lit(0)) > 0
    return F.coalesce(
        (F.col("l.language") == F.col("r.language")) & (F.col("l.return_type") != "") & (F.col("l.return_type") == F.col("r.return_type")) & one("l") & one("r")
        & (F.col("l.parameters")[0] != F.col("r.parameters")[0]) & (count("l") != count("r")) & F.arrays_overlap(plain("l"), plain("r")), F.lit(False),
    )


def score_pairs(pairs: DataFrame, policy: Policy | None = None) -> DataFrame:
    """Relation rows of pairs (cluster, l struct, r struct) that are related enough; scores, deltas, kind, clone class, default action and labels."""
    p = (policy or Policy()).pairs
    empty = F.array().cast("array<string>")
    arr = lambda s, n: F.coalesce(F.col(f"{s}.{n}"), empty)
    used = lambda s: F.exists(F.coalesce(F.map_values(F.col(f"{s}.parameter_features")), F.array().cast("array<array<string>>")), lambda v: F.size(v) > 0)
    no_map = F.create_map().cast("map<string,array<string>>")
    first = pairs.withColumns({
        "c": sequences(F.col("l.statements"), F.col("l.statement_keys"), F.col("r.statements"), F.col("r.statement_keys")),
        "name_score": S.round4(S.name_similarity(F.col("l.normalized_symbol"), F.col("r.normalized_symbol"), p.name_gate)),
        "parameter_score": S.round4(S.mean_jaccard_by_key(F.coalesce("l.parameter_features", no_map), F.coalesce("r.parameter_features", no_map))),
        "call_score": S.round4(S.multiset_jaccard(S.counts(F.col("l.calls")), S.counts(F.col("r.calls")))),
        "graph_score": S.round4(S.jaccard(arr("l", "graph_features"), arr("r", "graph_features"))),
        "no_parameter": ~used("l") & ~used("r"),
        "no_call": (F.size("l.calls") == 0) & (F.size("r.calls") == 0),
        "no_graph": (F.size(arr("l", "graph_features")) == 0) & (F.size(arr("r", "graph_features")) == 0),
        "body_match": (F.col("l.body_hash") != "") & (F.col("l.body_hash") == F.col("r.body_hash")),
        "normalizes": normalization(),
    })
    absent = {"parameter": F.col("no_parameter"), "call": F.col("no_call"), "graph": F.col("no_graph")}
    scores = {"parameter": F.col("parameter_score"), "call": F.col("call_score"), "sequence": F.col("c.seq_similarity"), "graph": F.col("graph_score"), "name": F.col("name_score")}
    best = relatedness(scores | {"tree": F.lit(1.0)}, absent)
    # the filter stands between the cheap measures and the trees: Catalyst would not order them by cost
    hopeful = first.filter((best >= p.relatedness) | F.col("body_match") | F.col("normalizes")).withColumns({"h1": F.least("l.body_hash", "r.body_hash"), "h2": F.greatest("l.body_hash", "r.body_hash")})
    measured = hopeful.join(tree_comparisons(hopeful, p.tree_product), ["h1", "h2"], "left")
    proxy = F.when((F.size("l.statements") > 0) | (F.size("r.statements") > 0), S.jaccard(aligned("l"), aligned("r"))).otherwise(0.0)
    exact_similarity = F.when(F.col("tree.nodes") == 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1.0 - F.col("tree.distance") / F.col("tree.nodes")))
    source = F.when(F.col("body_match"), "body_hash").when(F.col("tree.distance").isNotNull(), "ordered_tree_edit").when(F.col("tree.nodes") > 0, "edit_product_limit").otherwise("lazy_proxy")
    measured = measured.withColumn("tree_source", source).withColumn(
        "tree_score", S.round4(F.when(F.col("body_match"), 1.0).when(F.col("tree_source") == "ordered_tree_edit", exact_similarity).when(F.col("tree_source") == "edit_product_limit", F.col("c.seq_similarity")).otherwise(proxy))
    )
    raw = relatedness(scores | {"tree": F.col("tree_score")}, absent)
    measured = measured.withColumn("relatedness", F.when(F.col("normalizes"), F.greatest(raw, F.lit(p.normalization_relatedness))).otherwise(raw)).filter(F.col("relatedness") >= p.relatedness)

    mismatch = ~F.col("no_parameter") & (F.col("parameter_score") < p.parameter_flow)
    last = lambda s: F.element_at(F.concat(F.array(F.lit("")), F.col(f"{s}.statements")), -1)
    returns = lambda s: F.filter(F.col(f"{s}.statements"), lambda x: F.startswith(x, F.lit("RETURN")))
    call_bag = lambda s: F.array_sort(F.col(f"{s}.calls"))
    changed = {
        "DEFAULT_ARGUMENT_DELTA": differ("parameter_default_roles"), "LITERAL_VALUE_DELTA": differ("literal_shapes"), "RECEIVER_SHAPE_DELTA": differ("receiver_shapes"), "ARGUMENT_NORMALIZATION_DELTA": F.col("normalizes"),
        "EXTRA_CONTEXT_MANAGER_DELTA": has("l", "controls", "WITH") != has("r", "controls", "WITH"), "EXTRA_LOCAL_TEMPORARY_DELTA": starting("l", "ASSIGN") != starting("r", "ASSIGN"), "EXTRA_ASSIGNMENT_DELTA": starting("l", "ASSIGN") != starting("r", "ASSIGN"),
        "EXTRA_TERMINAL_CALL_DELTA": last("l") != last("r"), "CALLEE_NAME_DELTA": call_bag("l") != call_bag("r"), "ARGUMENT_FLOW_DELTA": mismatch, "CONTROL_FLOW_DELTA": differ("controls"),
        "ERROR_HANDLING_DELTA": has("l", "controls", "TRY") != has("r", "controls", "TRY"), "LOOP_DELTA": has("l", "controls", "LOOP") != has("r", "controls", "LOOP"), "RETURN_VALUE_DELTA": returns("l") != returns("r"), "OPERATOR_DELTA": F.coalesce(F.col("tree.operator_changed"), F.lit(False)),
    }
    weight = F.create_map(*[F.lit(x) for kv in DELTA_RISK.items() for x in kv])
    errors = lambda s: F.struct(has(s, "controls", "TRY"), starting(s, "RAISE"))
    any_error = lambda s: has(s, "controls", "TRY") | (starting(s, "RAISE") > 0)
    rel = measured.withColumns({
        "deltas": F.array_sort(F.array_compact(F.array(*[F.when(v, k) for k, v in changed.items()]))),
        "parameter_mismatch": mismatch,
        "same_return": (F.size(returns("l")) > 0) & (returns("l") == returns("r")),
        "same_error": any_error("l") & (errors("l") == errors("r")),
        "same_directory": S.parent(F.col("l.file")) == S.parent(F.col("r.file")),
        "same_role": F.col("l.role") == F.col("r.role"),
        "same_shape": F.col("l.shape_hash") == F.col("r.shape_hash"),
        "same_tree": F.col("tree_source").isin(*EXACT_TREES) & (F.col("tree_score") >= p.same_tree) & (F.col("body_match") | (F.col("tree.same_skeleton") & F.col("tree.same_operators"))),
        "literals_differ": differ("literal_shapes"),
        "calls_differ": call_bag("l") != call_bag("r"),
        "same_calls": (F.size("l.calls") > 0) & (call_bag("l") == call_bag("r")),
        "controls_differ": differ("controls"),
        "shared_control": (F.size("l.controls") > 0) & ~differ("controls"),
        "parameter_flow": F.col("parameter_score") >= p.parameter_flow,
        "tail_flow": F.coalesce(F.arrays_overlap(tail_reads("l"), tail_reads("r")), F.lit(False)),
    })
    rel = rel.withColumn("risk", S.round4(F.least(F.lit(1.0), F.aggregate("deltas", F.lit(0.0), lambda a, d: a + F.coalesce(F.element_at(weight, d), F.lit(0.08))))))
    among = lambda *names: F.size(F.array_intersect("deltas", F.array(*map(F.lit, names))))
    n_params = F.greatest(F.size("l.parameters"), F.size("r.parameters"))
    strategy = F.col("parameter_mismatch") & ~F.array_contains("deltas", "ARGUMENT_NORMALIZATION_DELTA") & (among("CALLEE_NAME_DELTA", "RECEIVER_SHAPE_DELTA", "ARGUMENT_FLOW_DELTA") > 0)
    lines = F.greatest(F.col("l.body_line_count"), F.col("r.body_line_count"), F.lit(1))
    one = F.lit(1.0)
    cost = {
        "parameter_count": S.round4(0.18 * F.when(n_params <= p.easy_parameters, 0.0).otherwise(F.least(one, (n_params - p.easy_parameters) / p.many_parameters))),
        "holes": S.round4(0.16 * F.least(one, F.col("c.uni_holes") / 3)),
        "hole_size": S.round4(0.16 * F.least(one, F.col("c.uni_max_hole") / lines)),
        "branches": S.round4(0.12 * F.least(one, among("CONTROL_FLOW_DELTA", "ERROR_HANDLING_DELTA", "EXTRA_CONTEXT_MANAGER_DELTA", "LOOP_DELTA") / 3)),
        "temporaries": S.round4(0.10 * F.least(one, among("EXTRA_LOCAL_TEMPORARY_DELTA", "EXTRA_ASSIGNMENT_DELTA") / 2)),
        "strategy": F.when(strategy, 0.10).otherwise(0.0),
        "cross_module": F.when(F.col("same_directory"), 0.0).otherwise(0.10),
        "public": F.when(S.is_public(F.col("l.symbol")) | S.is_public(F.col("r.symbol")), 0.08).otherwise(0.0),
    }
    longest = F.col("c.seq_longest")
    rel = rel.withColumn("cost", S.round4(S.clamp01(sum(cost.values(), F.lit(0.0)))))
    gain = {
        "common": S.round4(0.22 * (F.col("c.seq_lcs") / longest)),
        "contiguous": S.round4(0.18 * (F.greatest("c.seq_prefix", "c.seq_suffix") / longest)),
        "few_holes": S.round4(0.16 * F.greatest(F.lit(0.0), 1.0 - F.col("c.uni_holes") / 3)),
        "small_holes": S.round4(0.14 * F.greatest(F.lit(0.0), 1.0 - F.col("c.uni_max_hole") / longest)),
        "same_return": F.when(F.col("same_return"), 0.10).otherwise(0.0),
        "same_error": F.when(F.col("same_error"), 0.08).otherwise(0.0),
        "same_role": F.when(F.col("same_role"), 0.08).otherwise(0.0),
        "local": F.when(F.col("same_directory"), 0.04).otherwise(0.0),
        "cost": -S.round4(0.35 * F.col("cost")),
    }
    fit = S.round4(S.clamp01(sum(gain.values(), F.lit(0.0))))
    rel = rel.withColumn("refactorability", F.when(F.col("normalizes"), F.greatest(fit, F.lit(p.normalization_refactorability))).otherwise(fit))
    rel = rel.withColumn("confidence", S.round4(S.clamp01(F.col("relatedness") * (1 - 0.5 * F.col("risk")))))
    return decide(rel, p)


def decide(rel: DataFrame, p) -> DataFrame:
    """Adds the kind of relation, all labels, the clone class, its basis and the default action."""
    prefix, suffix, lcs = F.col("c.seq_prefix"), F.col("c.seq_suffix"), F.col("c.seq_lcs")
    reordered = (F.size(aligned("l")) > 0) & (aligned("l") != aligned("r")) & (F.array_sort(aligned("l")) == F.array_sort(aligned("r")))
    wrapper = (prefix > 0) & (suffix > 0) & ((prefix + suffix >= p.wrapper_edges) | F.col("same_tree") | F.col("same_return") | F.col("same_error") | F.col("tail_flow"))
    kind = (
        F.when(F.col("body_match"), F.when(F.col("l.normalized_symbol") == F.col("r.normalized_symbol"), "body_identical").otherwise("body_parameterized"))
        .when(F.col("normalizes"), "argument_normalization_wrapper")
        .when(F.col("same_tree") & F.col("literals_differ"), "same_skeleton_different_literals")
        .when(F.col("same_tree") & F.col("calls_differ"), "same_skeleton_different_callees")
        .when(reordered, "same_statements_different_order")
        .when(F.col("parameter_flow") & F.col("controls_differ"), "same_argument_flow_different_control")
        .when(wrapper, "common_wrapper_different_core")
        .when(lcs > prefix + suffix, "same_core_different_wrapper")
        .when(prefix > 0, "common_prefix_divergent_tail")
        .when(suffix > 0, "common_suffix_divergent_setup")
        .when(F.col("same_calls") & (F.col("l.calls") != F.col("r.calls")), "same_call_set_different_order")
        .otherwise("none")
    )
    rel = rel.withColumn("kind", kind)
    labels = [(F.col("kind") != "none", F.col("kind")), *[(c, F.lit(k)) for c, k in (
        (F.col("body_match"), "body_identical"), (F.col("normalizes"), "argument_normalization_wrapper"), (F.col("same_tree") & F.col("literals_differ"), "same_skeleton_different_literals"),
        (F.col("same_tree") & F.col("calls_differ"), "same_skeleton_different_callees"), (F.col("parameter_flow") & F.col("controls_differ"), "same_argument_flow_different_control"), (wrapper, "common_wrapper_different_core"),
        (F.col("same_calls"), "same_call_set_different_order"), (prefix > 0, "common_prefix_divergent_tail"), (suffix > 0, "common_suffix_divergent_setup"), (lcs > prefix + suffix, "same_core_different_wrapper"),
    )]]
    clone = F.create_map(*[F.lit(x) for k, (c, _) in CLONE_OF_RELATION.items() for x in (k, c)])
    strength = F.create_map(*[F.lit(x) for k, (_, s) in CLONE_OF_RELATION.items() for x in (k, s)])
    basis = [
        (F.col("same_shape"), "same_signature_shape"), (F.col("normalizes"), "typed_argument_normalization_wrapper"), (F.col("body_match"), "normalized_body_identity"), (F.col("name_score") >= p.same_name, "normalized_name_similarity"),
        (F.col("tree_source").isin(*EXACT_TREES) & (F.col("tree_score") >= p.same_tree), "body_structure_similarity"), (F.col("parameter_flow"), "parameter_use_similarity"), (F.col("call_score") >= p.call_overlap, "call_fingerprint_overlap"),
        (F.col("graph_score") >= p.graph, "local_dataflow_similarity"), (F.col("shared_control"), "control_context_similarity"), (F.col("c.seq_lcs") >= p.min_lcs, "statement_sequence_alignment"),
        (F.col("c.uni_stable") >= p.min_stable, "anti_unification_template"), (F.size("deltas") > 0, "structural_delta_classification"),
    ]
    rel = rel.withColumns({"labels": F.array_distinct(F.array_compact(F.array(*[F.when(c, v) for c, v in labels]))), "clone_type": F.element_at(clone, F.col("kind")), "strength": F.element_at(strength, F.col("kind")), "basis": F.array_compact(F.array(*[F.when(c, v) for c, v in basis]))})
    action = (
        F.when(F.col("clone_type") == "signature_signal_only", "observe")
        .when(F.col("clone_type") == "contract_analogy", "record_shared_concern")
        .when(F.col("cost") >= p.high_cost, "record_shared_concern")
        .when(F.col("kind") == "argument_normalization_wrapper", "reuse_existing_helper")
        .when(F.col("clone_type") == "type_2_parameterized", "consolidate_clone")
        .when(F.col("kind").isin("common_wrapper_different_core", "same_statements_different_order") & (F.col("refactorability") >= p.refactor_medium), "introduce_abstraction")
        .when(F.col("kind").isin("common_prefix_divergent_tail", "common_suffix_divergent_setup", "same_core_different_wrapper"), "inspect_shared_lifecycle")
        .otherwise("record_shared_concern")
    )
    band = F.when(F.col("refactorability") >= p.refactor_high, "high").when(F.col("refactorability") >= p.refactor_medium, "medium").when(F.col("refactorability") > 0, "low").otherwise("track_only")
    return rel.withColumns({"default_action": action, "refactorability_band": band, "actions": pair_actions(p), "stable": F.col("c.uni_stable"), "holes": F.col("c.uni_holes"), "max_hole": F.col("c.uni_max_hole"), "prefix": prefix, "suffix": suffix, "lcs": lcs})


def pair_actions(p) -> Column:
    """The actions that a pair suggests: array<struct<action,status,confidence,reason>>."""
    def act(action: str, status: str, confidence: Column, reason: str = "") -> Column:
        return F.struct(F.lit(action).alias("action"), F.lit(status).alias("status"), S.round4(confidence).alias("confidence"), F.lit(reason).alias("reason"))

    kind, conf, fit = F.col("kind"), F.col("confidence"), F.col("refactorability")
    costly = F.col("cost") >= p.high_cost
    least = F.least(conf, fit)
    concern = lambda floor: act("record_shared_concern", "recommended", F.greatest(F.lit(floor), conf))
    none = F.array().cast("array<struct<action:string,status:string,confidence:double,reason:string>>")
    return (
        F.when(kind.isin("body_identical", "body_parameterized"), F.array(act("consolidate_clone", "recommended", F.greatest(F.lit(0.6), fit, conf))))
        .when(kind.isin("same_skeleton_different_literals", "same_skeleton_different_callees") & (fit >= p.refactor_high) & (F.col("cost") <= p.skeleton_cost), F.array(act("consolidate_clone", "recommended", F.greatest(F.lit(0.6), least), "parameterized_skeleton")))
        .when(kind == "argument_normalization_wrapper", F.array(act("reuse_existing_helper", "recommended", F.greatest(F.lit(0.62), least))))
        .when(kind == "common_prefix_divergent_tail", F.array(concern(0.74), act("do_not_refactor", "not_recommended", F.least(F.lit(0.51), fit), "COMMON_REGION_TOO_SMALL")))
        .when(
            kind.isin("common_wrapper_different_core", "same_statements_different_order"),
            F.when(costly, F.array(act("do_not_refactor", "not_recommended", F.greatest(F.lit(0.6), least), "HIGH_ABSTRACTION_COST"), concern(0.7))).otherwise(F.array(act("introduce_abstraction", "recommended", F.greatest(F.lit(0.6), least)), concern(0.7))),
        )
        .otherwise(none)
    )


ORDER = ("confidence", "relatedness", "refactorability")


def pair_order() -> list[Column]:
    return [*[F.desc(c) for c in ORDER], *[F.col(f"{s}.{c}") for s in "lr" for c in ("file", "start_line", "symbol")]]


def kept_pairs(rel: DataFrame, k: int) -> DataFrame:
    """The strongest pairs of each cluster."""
    return strongest(rel, ["cluster"], pair_order(), k)


def structural_duplicates(rel: DataFrame, policy: Policy | None = None) -> DataFrame:
    p = (policy or Policy()).pairs
    sure = rel.filter(F.col("same_role") & (F.col("name_score") >= p.same_name) & (F.col("tree_score") >= p.same_tree) & F.col("kind").isin("body_identical", "body_parameterized"))
    return strongest(sure, ["cluster"], pair_order(), p.duplicates_kept)
