"""Sinks: findings and relations as JSON lines, metrics and manifest, a Markdown summary, a compressed debug bundle, and their publication."""

from __future__ import annotations

import json
import os
import shutil
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import __version__
from ..operators.groups import zero_filled_counts
from ..plans.analyze import Analysis, completeness
from ..vocab import TIERS

OWNED = ".twinframe-owned"
LEAN = ("rank", "target_id", "target_type", "title", "tier", "action", "status", "detection", "fit", "risk", "payoff", "cost", "attention", "members", "files", "failed_gates", "cap_rule", "evidence_strength", "safety", "summary_eligible")


def lean(findings: DataFrame) -> DataFrame:
    return findings.select(*LEAN)


def full(findings: DataFrame) -> DataFrame:
    """Every column of a finding as one JSON string."""
    return findings.select("target_id", F.to_json(F.struct(*findings.columns)).alias("payload"))


def pair_payload(relations: DataFrame) -> DataFrame:
    columns = [c for c in relations.columns if c not in ("l", "r", "tree")]
    ref = lambda s: F.struct(*[F.col(f"{s}.{c}") for c in ("signature_id", "function_id", "file", "symbol", "start_line", "end_line", "role")]).alias(f"{s}_member")
    return relations.select(F.to_json(F.struct(ref("l"), ref("r"), *columns)).alias("payload"))


def claim(folder: Path) -> None:
    """Takes a folder for output: a new or empty one, or one taken before; never another's."""
    if folder.exists() and any(folder.iterdir()) and not (folder / OWNED).exists():
        raise ValueError(f"{folder} holds files of someone else")
    folder.mkdir(parents=True, exist_ok=True)
    (folder / OWNED).touch()


def summary(top: list, counts: dict[str, int], coverage: dict) -> str:
    lines = ["# Repetition report", "", f"Files analysed: {coverage['analysed']} of {coverage['files']} ({coverage['coverage']}).", "", "| Tier | Findings |", "|-|-|", *[f"| {t} | {n} |" for t, n in counts.items()], ""]
    for r in top:
        lines.append(f"{r['rank']}. **{r['title'].replace('|', '/')}** ({r['tier']}, {r['action']}): " + ", ".join(r["members"][:5]))
    return "\n".join(lines) + "\n"


def write(analysis: Analysis, folder: str, limit: int = 50, debug: bool = False, config: dict | None = None) -> dict:
    """Writes all reports next to the folder and then swaps them in; returns the metrics. The folder is one that the driver sees."""
    target = Path(folder)
    claim(target)
    staging = target.with_name(target.name + ".new")
    shutil.rmtree(staging, ignore_errors=True)
    staging.mkdir()
    f = analysis.findings
    for name, rows in (("analysis", f.filter("visible")), ("observations", f.filter("not visible"))):
        lean(rows).repartitionByRange(1, "rank").sortWithinPartitions("rank").write.json(f"{staging}/{name}.jsonl")
    counts = {r["label"]: r["n"] for r in zero_filled_counts(f, "tier", TIERS).collect()}
    coverage = completeness(analysis.corpus).first().asDict()
    metrics = {"tiers": {t: counts.get(t, 0) for t in TIERS}, "coverage": coverage, "functions": analysis.corpus.functions.count(), "relations": analysis.relations.count()}
    (staging / "metrics.json").write_text(json.dumps(metrics, indent=1, sort_keys=True))
    (staging / "manifest.json").write_text(json.dumps({"version": __version__, "written": datetime.now(UTC).isoformat(timespec="seconds"), "config": config or {}}, indent=1))
    top = f.filter("visible").orderBy("rank").limit(limit).collect()
    (staging / "summary.md").write_text(summary(top, metrics["tiers"], coverage))
    if debug:
        full(f).write.option("compression", "gzip").json(f"{staging}/debug/findings")
        pair_payload(analysis.relations).write.option("compression", "gzip").text(f"{staging}/debug/relations")
    (staging / OWNED).touch()
    old = target.with_name(target.name + ".old")
    shutil.rmtree(old, ignore_errors=True)
    os.replace(target, old)
    os.replace(staging, target)
    shutil.rmtree(old)
    return metrics


def ci_payload(metrics: dict, folder: str, top: list[dict] | None = None) -> dict:
    """What a continuous-integration job reads: counts, whether it fails (on recommended edits), and where the reports are."""
    failing = metrics["tiers"].get("recommended_edit", 0)
    return {
        "version": __version__, "findings": metrics["tiers"], "coverage": metrics["coverage"], "ci": {"fail_on": "recommended_edit", "failing_targets": failing, "exit_code": int(failing > 0)},
        "artifacts": [f"{folder}/{n}" for n in ("analysis.jsonl", "observations.jsonl", "metrics.json", "summary.md")], "targets": top or [],
    }


def read_back(spark, folder: str, target_id: str) -> DataFrame:
    """Findings of a report by id."""
    return spark.read.json([f"{folder}/analysis.jsonl", f"{folder}/observations.jsonl"]).filter(F.col("target_id") == target_id)
