"""Assessment of drafts: detection, fit, risk, payoff, action, tier, caps, and the ranked list of findings. Column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import groups
from ..operators.graph import reliable
from ..policy import Policy
from ..vocab import TIERS

EDITS = ("consolidate_clone", "extract_small_helper", "reuse_existing_helper", "introduce_abstraction")
NOTES = ("record_shared_concern", "inspect_shared_lifecycle")
SUPPORT = ("body_structure_similarity", "normalized_name_similarity", "call_fingerprint_overlap", "control_context_similarity", "semantic_shared_call_target", "semantic_overload_binding")


def band(c: Column, high: float, medium: float) -> Column:
    return F.when(c >= high, "high").when(c >= medium, "medium").when(c > 0, "low").otherwise("none")


def score(drafts: DataFrame, policy: Policy | None = None) -> DataFrame:
    """Adds detection, fit, risk and payoff with their bands."""
    p = policy or Policy()
    d, f, r, y, a = p.detection, p.fit, p.risk, p.payoff, p.decision
    exact = (F.col("duplicate_pairs") > 0) | (F.col("body_matches") > 0) | (F.col("blocks") > 0) | (F.col("constants") > 0)
    related = F.col("relation_pairs") > 0
    base = F.greatest("lead_confidence", F.col("lead_relatedness") * d.relation_share)
    support = F.size(F.array_intersect("basis", F.array(*map(F.lit, SUPPORT))))
    relation = F.least(F.lit(d.relation_cap), F.when(base == 0, d.relation_base).otherwise(base) + support * d.relation_boost)
    wrapped = F.array_contains("evidence_kinds", "argument_normalization_wrapper")
    found = (
        F.when(F.col("constants") > 0, d.policy_constant)
        .when(F.col("blocks") > 0, F.greatest(F.lit(d.block_least), F.col("lead_confidence")))
        .when(F.col("duplicate_pairs") > 0, F.greatest(F.lit(d.duplicate_least), F.col("lead_confidence")))
        .when(related, relation)
        .when(wrapped, F.when(F.arrays_overlap("basis", F.array(F.lit("parameter_use_similarity"), F.lit("local_dataflow_similarity"))), d.wrapper_high).otherwise(d.wrapper_low))
        .when(F.col("member_count") >= 2, d.signature)
        .otherwise(0.0)
    )
    times = F.when(F.col("extraction") == "high", d.extraction_high).when(F.col("extraction") == "medium", d.extraction_medium).when(F.col("extraction") == "low", d.extraction_low).otherwise(d.extraction_unknown)
    skeleton = F.col("editable_skeleton")
    common = F.greatest(
        F.col("lead_refactorability"), F.when(F.col("body_matches") > 0, f.exact_body).otherwise(0.0), F.when(F.col("blocks") > 0, f.block).otherwise(0.0), F.when(F.col("constants") > 0, f.policy_constant).otherwise(0.0),
        F.when(F.col("duplicate_pairs") > 0, f.duplicate).otherwise(0.0), F.when(related, F.greatest(F.lit(f.relation_least), F.lit(f.relation_pair), F.col("lead_tree") * f.relation_tree, F.col("lead_relatedness") * f.relation_relatedness)).otherwise(0.0),
        F.when(F.col("member_count") >= 2, f.members).otherwise(0.0),
    )
    stable = S.ramp(F.col("lead_stable").cast("double"), f.stable_low, f.stable_high)
    shared = F.when((F.col("semantic_shared") > 0) & related & (F.col("lead_stable") >= 2), f.shared_implementation).otherwise(0.0)
    commonality = S.clamp01(common + shared)
    commonality = F.when(exact, F.greatest(commonality, stable)).when(related, commonality * F.greatest(F.lit(f.relation_stable_least), stable)).otherwise(commonality)
    measured = (F.col("lead_holes") > 0) | (F.col("lead_hole_size") > 0) | F.array_contains("basis", "anti_unification_template")
    simple = F.when(skeleton, f.skeleton_simplicity).when(~measured & related & ~exact, f.unmeasured_simplicity).otherwise(F.least(S.inverse_ramp(F.col("lead_holes").cast("double"), 0.0, f.holes_high), S.inverse_ramp(F.col("lead_hole_size").cast("double"), 0.0, f.hole_size_high)))
    cost = S.clamp01(F.col("lead_cost"))
    cap = F.least(
        F.when(F.col("lead_cost") >= a.cost_high, f.cap_cost).otherwise(1.0),
        F.when(F.col("lead_risk") >= f.cap_risk_at, f.cap_risk).when(F.col("lead_risk") > 0, F.greatest(F.lit(f.cap_risk), 1.0 - F.col("lead_risk"))).otherwise(1.0),
        F.when((F.col("lead_stable") <= 1) & related & ~skeleton & ~exact, f.cap_unstable).otherwise(1.0),
    )
    fit = S.round4(S.clamp01(F.least(S.combine(commonality, F.greatest(F.lit(f.simplicity_least), simple), F.greatest(F.lit(f.cost_least), 1.0 - cost)), cap)))
    structural = F.when(F.col("lead_risk") > 0, F.col("lead_risk")).otherwise(F.least(F.lit(1.0), r.each * (F.col("risks") + F.when(F.col("scope") == "same_language", 0).otherwise(1))))
    semantic = F.least(F.lit(1.0), r.declaration * F.col("semantic_declarations").cast("double") + r.unresolved * F.col("semantic_unresolved").cast("double") + r.ambiguous * F.col("semantic_ambiguous").cast("double"))
    semantic = F.greatest(semantic, F.when(F.col("semantic_divergent") > 0, r.divergent).otherwise(0.0))
    quality = F.when((F.col("blocks") > 0) | (F.col("duplicate_pairs") > 0), y.exact_quality).when(related, y.relation_quality).when(F.col("member_count") >= 2, y.weak_quality).otherwise(0.0)
    volume = F.greatest(S.ramp(F.col("line_span").cast("double"), y.lines_low, y.lines_high), S.ramp(F.col("block_lines").cast("double"), y.block_low, y.block_high))
    scope = S.noisy_or(S.ramp_count(F.col("member_count"), y.members_from, y.members_high), volume, S.ramp_count(F.size(F.array_distinct("files")), y.files_from, y.files_high))
    only = lambda *roles: F.size(F.array_except("file_roles", F.array(*map(F.lit, roles)))) == 0
    exposure = F.when(F.size("file_roles") == 0, y.unknown_exposure).when(only("test", "fixture"), y.test_exposure).otherwise(1.0)
    payoff = quality * scope * exposure
    payoff = F.when((F.size("file_roles") > 0) & only("generated", "vendor", "build_output"), F.least(F.lit(y.generated_cap), payoff)).otherwise(payoff)
    out = drafts.withColumns({"detection": S.round4(F.least(F.lit(1.0), found * times)), "fit": fit, "cost": S.round4(cost), "risk": S.round4(F.greatest(structural, semantic)), "payoff": S.round4(S.clamp01(payoff)), "exact_evidence": exact})
    return out.withColumns({"detection_band": band(F.col("detection"), a.high, a.medium), "fit_band": band(F.col("fit"), a.high, a.medium), "payoff_band": band(F.col("payoff"), a.high, a.medium), "risk_band": band(F.col("risk"), a.risk_high, a.risk_medium)})


def body_lines() -> Column:
    """Lines of what would move: of the block if the draft is one, else of the largest member."""
    return F.when(F.col("blocks") > 0, F.col("block_lines")).otherwise(F.col("max_body_lines"))


def clone_gates(a) -> dict[str, Column]:
    """What makes a clone clean, whatever it costs."""
    pairs = F.when(F.col("duplicate_pairs") > 0, F.col("duplicate_pairs")).otherwise(F.col("relation_pairs"))
    return {"clean_clone_relation": F.col("clean_clone"), "body_hash_or_near_identical_tree": (F.col("body_matches") > 0) | (F.col("lead_tree") >= a.clone_tree), "same_role_semantics": F.col("same_role_pairs") >= pairs}


def gates(action: str, a) -> dict[str, Column]:
    """The conditions of an action by name."""
    local = F.col("blocks") > 0
    block = local & (body_lines() >= a.block_lines)
    out: dict[str, Column] = {}
    if action in (*EDITS, *NOTES):
        out["relation_detected"] = F.col("detection") >= a.detection
    if action in EDITS:
        out["maintenance_payoff"] = (F.col("payoff") >= a.review) | block | (F.col("editable_skeleton") if action == "consolidate_clone" else F.lit(False))
    wrapper = F.array_contains("evidence_kinds", "argument_normalization_wrapper")
    more = {
        "consolidate_clone": {**clone_gates(a), "low_semantic_risk": F.col("risk") <= a.clone_risk, "low_abstraction_cost": F.col("cost") <= a.clone_cost},
        "extract_small_helper": {
            "substantial_local_block": ~local | block, "argument_normalization": local | wrapper, "same_downstream_operation": local | wrapper, "small_common_body": body_lines().between(1, a.helper_lines),
            "low_abstraction_cost": F.col("cost") <= a.helper_cost, "low_semantic_risk": F.col("risk") <= a.helper_risk,
        },
        "reuse_existing_helper": {"argument_normalization": wrapper, "shared_operation": wrapper, "simple_transform": wrapper, "existing_boundary": wrapper, "acceptable_risk": F.col("risk") < a.risk_high, "acceptable_cost": F.col("cost") < a.cost_high},
        "introduce_abstraction": {
            "stable_region": (F.col("lead_stable") >= a.abstraction_stable) | (F.col("constants") > 0), "few_holes": F.col("lead_holes") <= a.abstraction_holes, "small_holes": F.col("lead_hole_size") <= a.abstraction_hole_size, "low_branch_delta": F.lit(True),
            "low_semantic_risk": F.col("risk") <= a.abstraction_risk, "manageable_cost": F.col("cost") <= a.abstraction_cost, "one_language": F.col("scope") != "analogous",
        },
        "record_shared_concern": {"shared_concern_only": F.col("detection") > 0},
        "inspect_shared_lifecycle": {"shared_lifecycle_only": F.col("detection") > 0},
    }
    return out | more.get(action, {})


def recommend(scored: DataFrame, policy: Policy | None = None) -> DataFrame:
    """Adds failed gates, the action after fallbacks, its score and status."""
    a = (policy or Policy()).decision
    asked = F.col("requested_action")
    failed = F.array().cast("array<string>")
    for action in (*EDITS, *NOTES):
        failed = F.when(asked == action, F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), n) for n, c in gates(action, a).items()]))).otherwise(failed)
    out = scored.withColumn("failed_gates", failed)
    bad = F.col("failed_gates")
    only_payoff = (F.size(bad) == 1) & F.array_contains(bad, "maintenance_payoff")
    action = (
        F.when((F.size(bad) == 0) | ~asked.isin(*EDITS, *NOTES), asked)
        .when(F.array_contains(bad, "relation_detected"), "observe")
        .when(only_payoff, asked)
        .when(asked.isin("introduce_abstraction", "extract_small_helper"), F.when(F.col("detection") > 0, "record_shared_concern").otherwise("observe"))
        .when(asked == "consolidate_clone", "do_not_refactor")
        .otherwise(asked)
    )
    out = out.withColumn("action", action)
    value = S.combine(F.col("detection"), F.col("fit"), F.col("payoff"), 1.0 - F.greatest("risk", "cost"))
    out = out.withColumn("action_score", S.round4(F.when(F.col("action").isin(*EDITS), value).otherwise(0.0)))
    fell = F.col("action") != asked
    open_gates = (F.size(bad) > 0) & ~fell
    block = (F.col("blocks") > 0) & (body_lines() >= a.block_lines)
    status = (
        F.when(F.col("action") == "do_not_refactor", "not_recommended")
        .when(F.col("action").isin("observe", *NOTES), "cautious")
        .when((F.col("risk") >= a.risk_high) | (F.col("cost") >= a.cost_high), "not_recommended")
        .when(open_gates, "cautious")
        .when((F.col("action") == "consolidate_clone") & (F.col("editable_skeleton") | (F.col("action_score") >= a.review)), "recommended")
        .when((F.col("action") == "introduce_abstraction") & (F.col("constants") > 0) & (F.col("risk") <= a.abstraction_risk) & (F.col("cost") <= a.abstraction_cost), "recommended")
        .when((F.col("action") == "extract_small_helper") & block & (F.col("risk") <= a.helper_risk) & (F.col("cost") <= a.helper_cost), "recommended")
        .when((F.col("action_score") >= a.recommended) & (F.col("risk") < a.risk_medium), "recommended")
        .otherwise("cautious")
    )
    return out.withColumn("status", status)


def classify(recommended: DataFrame, policy: Policy | None = None) -> DataFrame:
    """Adds the attention score and the tier.

    An edit's attention is its score; a note has attention only as a design concern: a sure and valuable recurrence that is risky
    or costly, scored by just that.
    """
    a = (policy or Policy()).decision
    edit, note = F.col("action").isin(*EDITS), F.col("action").isin(*NOTES)
    some = lambda c: F.col(c).isin("high", "medium")
    clean = F.lit(True)
    for gate in clone_gates(a).values():
        clean = clean & gate
    clean = (F.col("action") == "consolidate_clone") & F.coalesce(clean, F.lit(False))
    helper = (F.col("action") == "extract_small_helper") & (F.col("blocks") > 0)
    local = helper & body_lines().between(a.block_lines, a.helper_lines)
    reuse = (F.col("action") == "reuse_existing_helper") & F.array_contains("evidence_kinds", "argument_normalization_wrapper")
    evident = F.col("exact_evidence") | (F.col("relation_pairs") > 0) | F.array_contains("evidence_kinds", "argument_normalization_wrapper")
    concern = note & evident & (F.col("detection") >= a.high) & (F.col("payoff_band") == "high") & (some("risk_band") | (F.col("cost") >= a.cost_high))
    attention = F.when(reuse, F.greatest(F.lit(a.review), F.col("action_score"))).when(edit, F.col("action_score")).when(concern, S.round4(F.col("detection") * F.col("payoff") * F.greatest("risk", "cost"))).otherwise(0.0)
    out = recommended.withColumn("attention", attention)
    best = edit & (F.col("status") == "recommended") & ((F.col("action_score") >= a.recommended) | clean | local) & ((F.col("detection_band") == "high") | clean) & (some("payoff_band") | clean) & some("fit_band") & F.col("risk_band").isin("none", "low")
    worth = some("detection_band") & (F.col("risk_band") != "high") & (reuse | ((some("payoff_band") | clean) & some("fit_band") & (some("payoff_band") | (F.col("status") == "recommended"))))
    review = (F.col("attention") >= a.review) & (F.col("attention") > 0) & ((edit & worth) | concern)
    stopped = (F.col("action") == "do_not_refactor") & (F.col("detection_band") == "high") & some("payoff_band")
    modest = edit & some("detection_band") & (helper | (F.col("fit_band") == "low") | (F.col("payoff_band") == "low"))
    noted = (note & some("detection_band")) | stopped | modest
    return out.withColumn("tier", F.when(best, "recommended_edit").when(review, "review_candidate").when(noted, "maintenance_note").otherwise("observation"))


def cap(classified: DataFrame, policy: Policy | None = None) -> DataFrame:
    """Lowers tiers where the roles of the members say that alike code is required; the first rule that applies."""
    a = (policy or Policy()).decision
    n = F.greatest(F.col("member_count"), F.lit(1))
    mostly = lambda c: F.col(c) / n >= a.dominant
    solid = (F.col("max_body_lines") >= 8) & (F.col("lead_stable") >= 5) & (F.col("same_role_pairs") >= F.col("relation_pairs")) & (F.size(F.array_distinct("files")) == 1)
    helper = (F.col("member_count") == 2) & (F.col("test_members") == 2) & F.col("clean_clone")
    rules = [
        ("declaration", mostly("declaration_members"), F.when(mostly("api_members"), "maintenance_note").otherwise("observation")),
        ("interface", mostly("interface_members"), F.lit("observation")),
        ("trivial_body", mostly("trivial_members"), F.lit("maintenance_note")),
        ("broad_parent", (F.col("relation_pairs") > 0) & (F.col("covered_members") / n < a.dominant), F.lit("maintenance_note")),
        ("example", mostly("example_members"), F.lit("observation")),
        ("test", (F.col("test_members") > 0) & ~helper, F.lit("review_candidate")),
        ("protocol_or_api", mostly("protocol_members") | mostly("api_members"), F.when(solid, "review_candidate").otherwise("maintenance_note")),
        ("constructor", mostly("constructor_members"), F.lit("review_candidate")),
        ("special_method", mostly("special_members"), F.when(F.col("max_body_lines") <= 5, "maintenance_note").otherwise("review_candidate")),
    ]
    rule, limit = F.lit(None).cast("string"), F.lit("recommended_edit")
    for name, when, to in reversed(rules):
        rule, limit = F.when(when, name).otherwise(rule), F.when(when, to).otherwise(limit)
    rank = F.create_map(*[F.lit(x) for i, t in enumerate(TIERS) for x in (t, i)])
    out = classified.withColumns({"cap_rule": rule, "_limit": limit})
    lowered = F.element_at(rank, F.col("tier")) < F.element_at(rank, F.col("_limit"))
    action = F.when(lowered & F.col("action").isin(*EDITS), F.when(F.col("_limit") == "review_candidate", F.when(F.col("cap_rule") == "constructor", "extract_small_helper").otherwise(F.col("action"))).when(F.col("_limit") == "maintenance_note", "record_shared_concern").otherwise("do_not_refactor")).otherwise(F.col("action"))
    return out.withColumns({"tier": F.when(lowered, F.col("_limit")).otherwise(F.col("tier")), "action": action, "status": F.when(lowered & (F.col("status") == "recommended"), "cautious").otherwise(F.col("status"))}).drop("_limit")


def findings(drafts: DataFrame, policy: Policy | None = None) -> DataFrame:
    """Assessed drafts without equivalents and subsumed ones, ranked, with the surface on which each shows."""
    # each step uses the last one's columns many times; written in between, they are computed once and plans stay small
    out = reliable(drafts)
    for step in (score, recommend, classify, cap):
        out = reliable(step(out, policy))
    rank = F.element_at(F.create_map(*[F.lit(x) for i, t in enumerate(TIERS) for x in (t, i)]), F.col("tier"))
    out = out.withColumns({"tier_rank": rank, "target_id": F.concat(F.lit("rt_"), F.substring(F.sha2(F.concat(F.lit("target_type="), "target_type", F.lit("\x1emembers="), F.array_join(F.array_sort(F.array_distinct("members")), "\x1f")), 256), 1, 12))})
    order = [F.col("tier_rank"), F.desc("attention"), F.col("target_type"), F.col("title"), F.col("draft_id")]
    out = reliable(groups.equivalents(out, "members", order))
    actionable = out.filter(F.col("action").isin(*EDITS))
    out = out.join(groups.subsumed(actionable, "draft_id", "members", ["action", "target_type"], "tier_rank"), "draft_id", "left_anti")
    out = out.withColumns({
        "visible": F.col("tier") != "observation",
        "visibility": F.when(F.col("tier").isin("recommended_edit", "review_candidate"), "listed").when(F.col("tier") == "maintenance_note", "grouped").otherwise("sidecar_only"),
        "summary_eligible": (F.col("tier") == "recommended_edit") | ((F.col("tier") == "review_candidate") & F.col("payoff_band").isin("high", "medium") & (F.col("fit") >= 0.45) & F.col("action").isin(*EDITS)),
        "evidence_strength": F.when(F.col("exact_evidence") & (F.col("detection") >= 0.75), "strong").when(F.col("relation_pairs") > 0, "moderate").otherwise("weak"),
        "safety": F.when((F.col("risk") >= 0.65) | (F.col("cost") >= 0.65), "unsafe").when((F.col("risk") >= 0.30) | (F.col("cost") >= 0.45), "careful").otherwise("safe"),
    })
    return groups.surfaces(groups.ranked(reliable(out), order), "target_id", "rank", "tier", "visible")
