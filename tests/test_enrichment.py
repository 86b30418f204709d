"""Cluster enrichment, callsites and compiler facts."""

import json
import sys

import pytest
from pyspark.sql import functions as F

from twinframe.operators import enrichment
from twinframe.plans import analyze
from twinframe.sources import callsites, semantic

CODE = "def {0}(rows: list[str], flag: bool) -> int:\n    n = 0\n    for r in rows:\n        n += size(r, {1})\n    log(n)\n    return n\n"


@pytest.fixture(scope="module")
def found(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("enrich")
    for i, name in enumerate(("count_rows", "count_items", "sum_cache")):
        (root / f"m{i}").mkdir()
        (root / f"m{i}" / "a.py").write_text(CODE.format(name, i))
    (root / "view.ts").write_text("export function one(a: string): string { const x = read(a); save(x); return x + a }\nexport function two(b: string): string { const y = read(b); keep(y); return y + b }\n")
    return analyze.analyze_folder(spark, str(root))


def test_cluster_enrichment(spark, found):
    rel = found.relations
    members = found.clusters.join(found.corpus.functions, "signature_id")
    sizes = members.groupBy("cluster").agg(F.count("*").alias("n"))
    acts = enrichment.cluster_actions(rel, sizes).collect()
    assert acts and max(a.place for a in acts) <= 5
    python = next(r.cluster for r in members.collect() if r.symbol == "count_rows")
    risks = {r.cluster: r.risks for r in enrichment.cluster_risks(members).collect()}[python]
    assert set(risks) == {"vocabulary_mismatch", "layer_mismatch", "boundary_mismatch"}
    kinds = sizes.select("cluster", F.array(F.lit("structural_duplicate")).alias("kinds"))
    assert {r.cluster: r.confidence for r in enrichment.cluster_confidence(enrichment.cluster_risks(members), kinds).collect()}[python] == pytest.approx(0.35 + 0.18 - 0.09)
    s = {r.cluster: r for r in enrichment.summaries(members).collect()}[python]
    assert s.member_count == 3 and s.files == ["m0/a.py", "m1/a.py", "m2/a.py"] and s.symbols[0] == "count_rows"
    assert sum(r.pairs for r in enrichment.subclusters(rel).collect()) == rel.count() == enrichment.refactor_shapes(rel).count()
    stats = enrichment.comparison_statistics(rel.select("cluster"), rel).first()
    assert stats.related == rel.count()


def test_compiler_facts(spark, found, tmp_path):
    worker = tmp_path / "worker.py"
    worker.write_text(
        "import json, sys\nq = json.loads(sys.stdin.readline())\n"
        "print(json.dumps({'protocol_version': 1, 'request_id': q['request_id'], 'items': [{'signature_id': x['signature_id'], 'resolved': True, 'ownership_ambiguous': False, 'declaration_only': False, 'overload_group_id': None, 'return_type': 'string', 'call_targets': ['read']} for x in q['items']]}))\n"
    )
    wanted = semantic.worth_enriching(found.relations)
    requests = semantic.batches(wanted, 200)
    facts = semantic.enrich(requests, semantic.stdio_provider([sys.executable, str(worker)], 20))
    assert facts.count() == wanted.count() == 2
    e = semantic.pair_evidence(found.relations, facts).filter("semantic_shared > 0").collect()
    assert len(e) == 1 and e[0].semantic_divergent == 0 and e[0].semantic_unresolved == 0
    assert semantic.enrich(requests, None).count() == 0
    assert semantic.enrich(requests, semantic.stdio_provider([sys.executable, "-c", "raise SystemExit(1)"], 20)).count() == 0


def test_protocol_checks():
    q = {"protocol_version": 1, "request_id": "a", "items": [{"signature_id": "s"}]}
    good = {"protocol_version": 1, "request_id": "a", "items": [{"signature_id": "s"}]}
    assert semantic.mismatch(q, good) == ""
    assert semantic.mismatch(q, good | {"protocol_version": 2}) == "protocol version" and semantic.mismatch(q, good | {"request_id": "b"}) == "request id"
    assert semantic.mismatch(q, good | {"items": [{"signature_id": "s"}] * 2}) == semantic.mismatch(q, good | {"items": [{"signature_id": "t"}]}) == "item ids"
    assert json.dumps(q)


def test_callsites():
    source = """
make(1)(2)
f = make(3)
f(4)
registry.add(make(5))
rows.map(f)
cache["x"] = make(6)
table2["x"] = other(6)
def g(f):
    f(7)
def h():
    k = make(8)
    k()
f = 1
f(9)
"""
    got = [(x["line"], x["kind"]) for x in callsites.callsites(source, {"make"})]
    assert got == [(2, "immediate"), (4, "stored_reuse"), (5, "registered"), (6, "pipeline"), (7, "cached"), (13, "stored_reuse")]
    assert callsites.callsites("def (", {"make"}) == callsites.callsites(source, set()) == []
    assert callsites.is_factory("Callable[[int], str]") and not callsites.is_factory("int") and callsites.factories_of([{"symbol": "a", "return_type": "(x) => y"}]) == {"a"}
