"""Source analysis: extraction, relations, findings, reports, configuration and the command line."""

import json

import pytest
from pyspark.sql import functions as F

from twinframe import cli, config
from twinframe.plans import analyze, assess
from twinframe.policy import Policy, overrides
from twinframe.sources import ecmascript, files, memo, python_code, reports

PRICE = '''
def {name}({items}, tax):
    """Text."""
    {sub} = 0
    for item in {items}:
        {sub} += item.price * item.count
    discount = {sub} {op} 0.1
    if discount > {limit}:
        discount = {limit}
    return ({sub} - discount) * (1 + tax)
'''

BLOCK = """
def {name}(config):
    {head}
    title = config["{key}"]
    root = config.get("root", "/tmp")
    path = make_path(root, title)
    if not path.exists():
        raise ValueError(
            title
        )
    cache = make_cache(path)
    cache.clear()
    {tail}
"""


def price(name, items="items", sub="subtotal", op="*", limit=50):
    return PRICE.format(name=name, items=items, sub=sub, op=op, limit=limit)


SOURCES = {
    "pkg/one.py": "MAX_SIZES = {'a': 1, 'b': 2}\nMIN_SIZES = {'x': 1, 'y': 2, 'z': 3}\n" + price("total_price") + BLOCK.format(name="setup_first", head="prepare()", key="name", tail="return cache"),
    "pkg/two.py": "MAX_SIZES = {'a': 1, 'b': 2}\nMIN_SIZES = {'x': 1, 'y': 2, 'z': 4}\n" + price("total_cost", "rows", "amount") + BLOCK.format(name="build_all", head="log(config)\n    config.run(1)\n    while config.x:\n        config.next()\n    with lock(config):\n        config.wait(1)\n    assert config\n    alpha(config)\n    beta(config, 1)\n    gamma(1)\n    delta(config, config)", key="title", tail="for x in cache:\n        emit(x)\n    send(cache, x)\n    return None"),
    "pkg/three.py": price("total_sum", op="+"),
    "tests/test_price.py": price("total_price"),
    "pkg/broken.py": "def broken(:\n",
    "pkg/view.ts": "export function f() { return 1 }\n",
    "docs/readme.md": "# Text\n",
    "vendor/lib.py": "def f():\n    pass\n",
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    for name, text in SOURCES.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    (root / "pkg/data.bin").write_bytes(b"\0\1\2")
    return root


@pytest.fixture(scope="module")
def found(spark, folder):
    return analyze.analyze_folder(spark, str(folder), exclude=("vendor/**",))


def row(source):
    rows, _, fault = python_code.extract("a/b.py", source.encode(), "source")
    assert not fault
    return rows[0]


def test_body_hash_follows_renaming_but_not_meaning():
    a, b = row(price("f")), row(price("g", "rows", "amount"))
    assert a["body_hash"] == b["body_hash"] and a["statement_keys"] == b["statement_keys"]
    assert a["body_hash"] != row(price("f", op="+"))["body_hash"] and a["body_hash"] != row(price("f", limit=60))["body_hash"]
    assert row(price("f", limit=60))["statement_keys"] == a["statement_keys"]  # literals are erased from keys
    assert row("def f(x):\n    return read(x)")["body_hash"] != row("def f(x):\n    return drop(x)")["body_hash"]


def test_tokens_and_roles():
    r = row("class K:\n    @property\n    async def go(self, x: int, *rest: T) -> T:\n        y = x.decode('utf8')\n        with open(y) as f:\n            z = self.items.get(f, key=x)\n        await self.send(z)\n        return helper(x, 1)\n")
    assert r["statements"] == ["ASSIGN:BIND", "WITH:open(args=LOCAL;kwargs=)", "CALL:ARG0.send(args=LOCAL;kwargs=)", "RETURN:ARG1"]
    assert r["calls"] == ["ARG1.decode(args=CONST_STR;kwargs=)", "open(args=LOCAL;kwargs=)", "ARG0.items.get(args=LOCAL;kwargs=key:ARG1)", "ARG0.send(args=LOCAL;kwargs=)", "helper(args=ARG1,CONST_NUM;kwargs=)"]
    assert r["canonical_shape"] == "fn(UNKNOWN,int,list[G0])->G0" and r["container"] == "K" and r["controls"] == ["AWAIT", "WITH"]
    assert r["semantic_roles"] == ["property_accessor"] and r["is_async"] and r["type_source"] == "fallback"
    kinds = lambda s: row(s)["semantic_roles"]
    assert kinds("def f(self):\n    return self.x.f(1)") == ["adapter_forwarder", "public_api_mirror", "trivial_body"]
    assert kinds("def f():\n    raise NotImplementedError") == ["abstract_or_interface_stub"] and kinds("def __radd__(a, b):\n    return a + b") == ["operator_overload", "python_special_method"]
    assert kinds("f = lambda a: a + 1") == ["normal_function"] and row("f = lambda a: a + 1")["symbol"] == "f"


def test_duplicate_blocks_and_constants():
    body = "        if {0}:\n            a = 1\n            b = two(a)\n            c = a + b\n"
    r = row("def f(x, y):\n    for i in x:\n" + body.format("i") + body.format("y"))
    assert [(b["statement_count"], b["line_count"], len(b["occurrences"])) for b in r["duplicate_blocks"]] == [(3, 3, 2)]
    _, constants, _ = python_code.extract("a.py", b"A_B = [1, -2]\nlow = [1, 2]\nC_D = (f(), 1)\nE_F: dict = {1: 'x'}\nG_H = {1}\n", "source")
    assert [c["symbol"] for c in constants] == ["A_B", "E_F"]


SCRIPT = b"""
export async function loadUsers(path: string, limit = 10): Promise<User[]> {
  const rows = await fetchRows(path, { limit })
  let out: User[] = []
  for (const row of rows) {
    if (row.active) { out.push(row.name) } else { skip(row) }
  }
  // a comment with }
  const re = /[}"]/g; const s = `a ${b} }`
  return out.filter(r => r.ok)
}
const add = (a: number, b: number): number => a + b;
class Cart extends Base {
  constructor(private readonly api: Api) { super(); }
  get size() { return this.items.length }
  private async send<T>(x: T, ...rest: string[]): Promise<void> {
    try { await this.api.post(x) } catch (e) { log(e); throw e }
  }
}
const o = { run(a) { return a + 1 }, go: function (b) { return b } }
"""


def test_scripts():
    rows, _, fault = ecmascript.extract("a/b.ts", SCRIPT, "source", "TypeScript")
    by = {r["symbol"]: r for r in rows}
    assert not fault and list(by) == ["loadUsers", "add", "constructor", "size", "send", "run", "go"]
    assert by["loadUsers"]["canonical_shape"] == "fn(string,UNKNOWN)->Promise<User[]>" and by["loadUsers"]["is_async"] and by["loadUsers"]["is_public"]
    assert by["loadUsers"]["statements"] == ["ASSIGN:BIND", "ASSIGN:BIND", "LOOP", "ASSIGN:BIND", "ASSIGN:BIND", "RETURN"] and by["loadUsers"]["controls"] == ["AWAIT", "BRANCH", "LOOP"]
    assert by["send"]["container"] == "Cart" and by["send"]["controls"] == ["AWAIT", "CATCH", "TRY"] and by["add"]["statements"] == ["RETURN:ARG0,ARG1"]
    one = lambda s: ecmascript.extract("a.js", s, "source", "JavaScript")[0][0]
    a, b = one(b"function f(a){ const x = g(a); return x + 1 }"), one(b"function h(q){\n const y = g(q)\n return y + 2\n}")
    assert a["body_hash"] == b["body_hash"] != one(b"function h(q){ const y = g(q); return y - 2 }")["body_hash"]
    assert all(ecmascript.detail_of(r["source"]) for r in rows)
    assert "parse_error" in ecmascript.extract("a.ts", b"function f( {", "source", "TypeScript")[2] and ecmascript.extract("a.ts", b"", "source", "TypeScript") == ([], [], "")


def test_odd_sources():
    assert python_code.extract("a.py", b"", "source") == ([], [], "")
    assert "python_parse_error" in python_code.extract("a.py", b"def f(:", "source")[2]
    assert python_code.extract("a.py", "# coding: latin-1\ndef f():\n    return 'é'\n".encode("latin-1"), "source")[0][0]["symbol"] == "f"
    deep = "def f(x):\n    return " + "(" * 80 + "x" + ")" * 80 + " + " + " + ".join(["x"] * 400) + "\n"
    assert python_code.detail_of(row(deep)["source"])["tree"] is None
    assert python_code.detail_of("return 1 +") is None


def test_files(spark, folder):
    d = files.describe(files.raw_files(spark, str(folder)), exclude=("vendor/**",), ignored=("docs/",))
    got = {r.path: r for r in d.collect()}
    assert set(got) == set(SOURCES)  # the binary file is dropped
    assert got["tests/test_price.py"].role == "test" and got["vendor/lib.py"].role == "vendor" and not got["vendor/lib.py"].selected
    assert got["docs/readme.md"].role == "documentation" and got["docs/readme.md"].content_hash == "" and got["pkg/one.py"].line_count == SOURCES["pkg/one.py"].count("\n")
    again = files.with_known_hashes(d.drop("content_hash"), d.filter("path = 'pkg/one.py'"))
    assert {r.path for r in again.filter("reused").collect()} == {"pkg/one.py"}
    assert files.explain_selection(d).count() == 2


def test_relations(found):
    rel = {(r.l.file, r.l.symbol, r.r.file, r.r.symbol): r for r in found.relations.collect()}
    names = {frozenset(((a, b), (c, d))): r for (a, b, c, d), r in rel.items()}
    same = names[frozenset((("pkg/one.py", "total_price"), ("pkg/two.py", "total_cost")))]
    assert same.kind == "body_parameterized" and same.tree_score == 1.0 and same.deltas == [] and same.risk == 0
    other = names[frozenset((("pkg/one.py", "total_price"), ("pkg/three.py", "total_sum")))]
    assert "OPERATOR_DELTA" in other.deltas and other.risk >= 0.5 and other.kind != "body_parameterized"


def test_blocks_and_findings(found):
    assert {(r.start_line, r.length) for r in found.blocks.collect()} and len({r.block for r in found.blocks.collect()}) == 1
    rows = {r.draft_id.split("|")[0]: r for r in found.findings.orderBy(F.desc("rank")).collect()}
    assert {"block", "constant"} <= set(rows) and ("cluster" in rows or "promoted" in rows)
    assert rows["block"].action in ("extract_small_helper", "record_shared_concern", "observe") and rows["block"].block_lines >= 8
    every = found.findings.collect()
    assert sorted(r["rank"] for r in every) == list(range(1, len(every) + 1)) or len({r.target_id for r in every}) == len(every)
    kinds = {r.draft_id.split("|")[1] for r in every if r.draft_id.startswith("constant")}
    assert kinds == {"identical", "drifted"}


def test_constant_confidence(found):
    rows = {r.kind: r for r in analyze.constant_clusters(found.corpus.constants).collect()}
    assert set(rows) == {"identical", "drifted"} and rows["identical"].members == 2
    assert rows["identical"].confidence == pytest.approx(round(1 - 0.12 * 0.15, 4)) == rows["identical"].action_confidence
    assert rows["drifted"].overlap == pytest.approx(2 / 3) and rows["drifted"].confidence == pytest.approx(round(2 / 3 * (1 - 0.12 * 0.15), 4))


def test_completeness_and_ordinals(found):
    c = analyze.completeness(found.corpus).first()
    assert (c.files, c.analysed, c.failed, c.unsupported, c.coverage) == (8, 5, 1, 0, "partial")
    ids = [r.cluster_id for r in analyze.ordinals(found.clusters).orderBy("cluster").collect()]
    assert ids == [f"sigcl_{i:06d}" for i in range(1, len(ids) + 1)]


def test_reports(spark, found, tmp_path):
    out = tmp_path / "report"
    metrics = reports.write(found, str(out), debug=True)
    assert metrics["functions"] == found.corpus.functions.count() and (out / "summary.md").read_text().startswith("# Repetition report")
    first = found.findings.filter("visible").orderBy("rank").first()
    assert reports.read_back(spark, str(out), first.target_id).first()["rank"] == first["rank"]
    assert json.loads((out / "metrics.json").read_text())["tiers"].keys() == {"recommended_edit", "review_candidate", "maintenance_note", "observation"}
    ci = reports.ci_payload(reports.write(found, str(out)), str(out))
    assert ci["ci"]["exit_code"] == int(ci["findings"]["recommended_edit"] > 0) and len(ci["artifacts"]) == 4
    other = tmp_path / "other"
    other.mkdir()
    (other / "mine.txt").write_text("x")
    with pytest.raises(ValueError):
        reports.write(found, str(other))


def draft(spark, **given):
    base = {**{k: v for k, v in analyze.NO_EVIDENCE.items()}, "draft_id": "d", "member_count": 2, "line_span": 40, "target_type": "signature_shape", "scope": "same_language", "requested_action": "observe", "title": "t", "extraction": "high"} | given
    d = spark.createDataFrame([tuple(base.values())], ", ".join(f"{k} {'boolean' if isinstance(v, bool) else 'int' if isinstance(v, int) else 'double' if isinstance(v, float) else 'string'}" for k, v in base.items()))
    arr = lambda *xs: F.array(*map(F.lit, xs)).cast("array<string>")
    return d.withColumns({"files": arr("a.py", "b.py"), "file_roles": arr("source"), "members": arr("m1", "m2"), "symbols": arr("f"), "evidence_kinds": arr("signature_shape_cluster"), "basis": arr("body_structure_similarity")})


def decided(spark, **given):
    return assess.cap(assess.classify(assess.recommend(assess.score(draft(spark, **given))))).first()


def test_decision_tables(spark):
    clone = {"relation_pairs": 1, "duplicate_pairs": 1, "body_matches": 1, "same_role_pairs": 1, "covered_members": 2, "clean_clone": True, "lead_confidence": 0.95, "lead_relatedness": 0.95, "lead_refactorability": 0.9, "lead_tree": 1.0, "lead_stable": 6, "lead_cost": 0.08, "requested_action": "consolidate_clone", "max_body_lines": 20}
    r = decided(spark, **clone)
    assert (r.tier, r.action, r.status, r.failed_gates) == ("recommended_edit", "consolidate_clone", "recommended", [])
    assert r.detection == 0.95 and r.fit == pytest.approx(round(1.0 * 1.0 * 0.92, 4)) and r.risk == 0.12 * 0 + 0.0
    risky = decided(spark, **clone | {"lead_risk": 0.5})
    assert risky.action == "do_not_refactor" and "low_semantic_risk" in risky.failed_gates and risky.fit == 0.45
    assert decided(spark, **clone | {"trivial_members": 2}).tier == "maintenance_note" and decided(spark, **clone | {"example_members": 2}).tier == "observation"
    assert decided(spark, **clone | {"constructor_members": 2}).action == "extract_small_helper"
    weak = decided(spark)
    assert (weak.tier, weak.action, weak.detection) == ("observation", "observe", 0.18)
    block = decided(spark, blocks=1, block_lines=12, lead_stable=5, requested_action="extract_small_helper", target_type="shared_block")
    assert (block.tier, block.status) == ("recommended_edit", "recommended")


def test_policy_and_config(tmp_path):
    assert overrides(Policy(), {"content": {"min_jaccard": 1}}).content.min_jaccard == 1.0
    for bad in ({"content": {"max_df": True}}, {"content": {"nope": 1}}, {"content": 3}):
        with pytest.raises(ValueError):
            overrides(Policy(), bad)
    (tmp_path / "pyproject.toml").write_text('[tool.twinframe]\nexclude = ["gen/**"]\n[tool.twinframe.policy.blocks]\nwindow = 5\n')
    (tmp_path / ".twinframeignore").write_text("# none\nold/**\n")
    c = config.load(tmp_path, environment={"TWINFRAME_SPLIT_TEST": "0"})
    assert c.exclude[-2:] == ("gen/**", "old/**") and c.policy.blocks.window == 5 and not c.split_test
    with pytest.raises(ValueError):
        config.load(tmp_path, {"include": 5}, {})
    assert config.repository_root(tmp_path / "x") == tmp_path.resolve()


def test_command_line(tmp_path, capsys):
    assert cli.main(["init", str(tmp_path)]) == 0 and cli.main(["init", str(tmp_path)]) == 2
    assert cli.main(["doctor", str(tmp_path)]) == 0 and '"parser": "ok"' in capsys.readouterr().out
    (tmp_path / "twinframe.toml").write_text("nope = 1\n")
    assert cli.main(["doctor", str(tmp_path)]) == 2


def test_memo_computes_misses_only(spark, tmp_path):
    store, seen = memo.Memo(spark, str(tmp_path), "squares"), []

    def compute(rows):
        seen.append(rows.count())
        return rows.select("_key", (F.col("id") * F.col("id")).alias("square"))

    rows = lambda n: spark.range(n).withColumn("_key", memo.key("id"))
    assert store.through(rows(5), compute).count() == 5
    assert sorted(r.square for r in store.through(rows(8), compute).collect()) == [i * i for i in range(8)]
    assert seen == [0, 5, 0, 3] and store.statistics().first().entries == 8


def test_arrivals(spark, folder, tmp_path):
    from twinframe.streaming.arrivals import extract_arrivals

    q = extract_arrivals(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination(120)
    assert q.exception() is None and {r.symbol for r in spark.read.parquet(str(tmp_path / "out")).collect()} >= {"total_price", "setup_first"}
