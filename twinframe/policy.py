"""Limits and thresholds of every stage, as one frozen record for each stage; change them with `dataclasses.replace` or overrides()."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, fields, is_dataclass, replace
from typing import Any


# The thresholds and weights below must equal those of the system whose results this engine matches.
@dataclass(frozen=True)
class Candidates:
    bucket_members: int = 32
    pairs_per_cluster: int = 400
    max_statements: int = 8
    max_tree_nodes: int = 120
    call_keys: int = 5
    wrapper_bucket_members: int = 12
    wrapper_clusters: int = 40


@dataclass(frozen=True)
class Content:
    max_df: int = 16
    min_statements: int = 2
    min_shingles: int = 4
    min_shared: int = 2
    min_jaccard: float = 0.55
    neighbours: int = 8
    component_members: int = 12


@dataclass(frozen=True)
class Blocks:
    window: int = 4
    min_distinct: int = 3
    min_lines: int = 8
    max_window_df: int = 8


@dataclass(frozen=True)
class Pairs:
    kept: int = 20
    duplicates_kept: int = 10
    relatedness: float = 0.35
    parameter_flow: float = 0.85
    call_overlap: float = 0.65
    wrapper_edges: int = 3
    normalization_relatedness: float = 0.72
    normalization_refactorability: float = 0.68
    name_gate: float = 0.5
    tree_product: int = 250_000
    graph: float = 0.60
    same_name: float = 0.85
    same_tree: float = 0.90
    min_lcs: int = 2
    min_stable: int = 2
    group_members: int = 2
    actions: int = 5
    high_cost: float = 0.65
    skeleton_cost: float = 0.25
    refactor_high: float = 0.75
    refactor_medium: float = 0.45
    easy_parameters: int = 2
    many_parameters: int = 6
    risky_parameters: int = 4


@dataclass(frozen=True)
class Broad:
    split_test: int = 40
    unknown_members: int = 500
    test_members: int = 30


@dataclass(frozen=True)
class Detection:
    policy_constant: float = 0.98
    block_least: float = 0.90
    duplicate_least: float = 0.90
    relation_base: float = 0.30
    relation_share: float = 0.85
    relation_boost: float = 0.05
    relation_cap: float = 0.85
    wrapper_low: float = 0.58
    wrapper_high: float = 0.72
    signature: float = 0.18
    extraction_high: float = 1.0
    extraction_medium: float = 0.90
    extraction_low: float = 0.75
    extraction_unknown: float = 0.85


@dataclass(frozen=True)
class Fit:
    exact_body: float = 0.95
    block: float = 0.90
    policy_constant: float = 0.85
    duplicate: float = 0.90
    relation_least: float = 0.35
    relation_pair: float = 0.65
    relation_tree: float = 0.75
    relation_relatedness: float = 0.80
    members: float = 0.15
    stable_low: float = 1.0
    stable_high: float = 5.0
    relation_stable_least: float = 0.35
    shared_implementation: float = 0.05
    skeleton_simplicity: float = 0.85
    unmeasured_simplicity: float = 0.55
    holes_high: float = 4.0
    hole_size_high: float = 8.0
    simplicity_least: float = 0.15
    cost_least: float = 0.20
    cap_cost: float = 0.40
    cap_risk: float = 0.45
    cap_risk_at: float = 0.35
    cap_unstable: float = 0.35


@dataclass(frozen=True)
class Risk:
    each: float = 0.12
    declaration: float = 0.18
    unresolved: float = 0.08
    ambiguous: float = 0.12
    divergent: float = 0.45


@dataclass(frozen=True)
class Payoff:
    exact_quality: float = 1.0
    relation_quality: float = 0.65
    weak_quality: float = 0.15
    members_from: int = 2
    members_high: int = 6
    lines_low: float = 12.0
    lines_high: float = 120.0
    block_low: float = 6.0
    block_high: float = 18.0
    files_from: int = 2
    files_high: int = 5
    test_exposure: float = 0.45
    unknown_exposure: float = 0.70
    generated_cap: float = 0.10


@dataclass(frozen=True)
class Decision:
    recommended: float = 0.42
    review: float = 0.12
    high: float = 0.75
    medium: float = 0.45
    detection: float = 0.35
    risk_medium: float = 0.30
    risk_high: float = 0.65
    cost_high: float = 0.65
    block_lines: int = 5
    clone_tree: float = 0.95
    clone_risk: float = 0.30
    clone_cost: float = 0.25
    helper_lines: int = 12
    helper_cost: float = 0.25
    helper_risk: float = 0.20
    abstraction_stable: int = 2
    abstraction_holes: int = 2
    abstraction_hole_size: int = 3
    abstraction_risk: float = 0.20
    abstraction_cost: float = 0.45
    dominant: float = 0.8
    guarded: float = 0.67


@dataclass(frozen=True)
class Policy:
    candidates: Candidates = field(default_factory=Candidates)
    content: Content = field(default_factory=Content)
    blocks: Blocks = field(default_factory=Blocks)
    pairs: Pairs = field(default_factory=Pairs)
    broad: Broad = field(default_factory=Broad)
    detection: Detection = field(default_factory=Detection)
    fit: Fit = field(default_factory=Fit)
    risk: Risk = field(default_factory=Risk)
    payoff: Payoff = field(default_factory=Payoff)
    decision: Decision = field(default_factory=Decision)


def overrides(record: Any, values: dict[str, Any]) -> Any:
    """The record with some values replaced, nested records by nested mappings. An int may stand for a float, a bool never for a number; unknown names raise."""
    known = {f.name for f in fields(record)}
    new = {}
    for name, value in values.items():
        if name not in known:
            raise ValueError(f"unknown setting {name}")
        old = getattr(record, name)
        if is_dataclass(old):
            if not isinstance(value, dict):
                raise ValueError(f"{name} must be a table")
            new[name] = overrides(old, value)
        elif isinstance(old, float) and isinstance(value, int | float) and not isinstance(value, bool):
            new[name] = float(value)
        elif type(value) is type(old):
            new[name] = value
        else:
            raise ValueError(f"{name} must be of type {type(old).__name__}")
    return replace(record, **new)


def as_dict(record: Any) -> dict[str, Any]:
    return asdict(record)
