"""A labelled corpus: positives of each clone category and negatives, with the tier that each case must reach."""

import pytest
from pyspark.sql import functions as F

from twinframe.plans import analyze

ORDER = ("observation", "maintenance_note", "review_candidate", "recommended_edit")

INVOICE = '''
def {n}({a}: list[Row], {b}: float) -> float:
    {t} = 0.0
    for {r} in {a}:
        if {r}.cancelled:
            continue
        {t} += {r}.price * {r}.count
    if {t} > 1000:
        {t} = {t} - {t} * 0.05
    {x} = {t} * {b}
    audit({t}, {x})
    return round({t} + {x}, 2)
'''
PARSE = '''
def {n}({a}: str) -> dict[str, str]:
    {o} = {{}}
    for {l} in {a}.splitlines():
        {l} = {l}.strip()
        if not {l} or {l}.startswith("#"):
            continue
        {k}, _, {v} = {l}.partition("=")
        {o}[{k}.strip()] = {v}.strip()
    check_keys({o})
    return {o}
'''


FETCH = '''
def {n}({c}: Client, {i}: int, retries: int) -> bytes:
    {e} = None
    for _ in range(retries):
        try:
            {d} = {c}.fetch({i})
            {c}.mark_done({i})
            return decode_body({d})
        except OSError as {e}:
            pause(1)
    raise TimeoutError({i})
'''
SMOOTH = '''
def {n}(values: list[float], width: int) -> list[float]:
    window = deque()
    result = []
    acc = 0.0
    for value in values:
        window.append(value)
        acc += value
        if len(window) > width:
            acc -= window.popleft()
        result.append(acc / len(window))
    return result
'''


def invoice(n, a="rows", b="rate", t="total", r="row", x="tax"):
    return INVOICE.format(n=n, a=a, b=b, t=t, r=r, x=x)


def parse(n, a="text", o="out", l="line", k="key", v="value"):  # noqa: E741
    return PARSE.format(n=n, a=a, o=o, l=l, k=k, v=v)


LIMITS = "{0} = {{'small': 10, 'medium': 20, 'large': 40, 'huge': 80}}\n"
SHARED = '    source = open_source(config)\n    rows = source.read_all()\n    if not rows:\n        raise ValueError(\n            source\n        )\n    index = build_index(rows)\n    index.verify()\n'

CASES = {
    "t1_invoice": ("type-1", [invoice("invoice_total"), invoice("invoice_total")]),
    "t1_parse": ("type-1", [parse("read_pairs"), parse("read_pairs")]),
    "t2_renamed": ("type-2", [invoice("bill_sum").replace("audit", "report"), invoice("order_sum", "items", "factor", "acc", "it", "fee").replace("audit", "report")]),
    "t2_fetch": ("type-2", [FETCH.format(n="load_page", c="client", i="page", e="error", d="body"), FETCH.format(n="load_image", c="api", i="ident", e="fault", d="data")]),
    "t3_extra": ("type-3", [invoice("cart_sum").replace("audit", "note_cart"), invoice("basket_sum").replace("audit", "note_cart").replace("    return", "    warn_user(total)\n    return")]),
    "t3_gap": ("type-3", [SMOOTH.format(n="moving_mean"), SMOOTH.format(n="rolling_mean").replace("    acc = 0.0", "    acc = 0.0\n    check_width(width)")]),
    "t4_loop": ("type-4", ["def names_of(users: list[U]) -> list[str]:\n    out = []\n    for u in users:\n        if u.live:\n            out.append(u.name)\n    return out\n", "def titles_of(users: list[U]) -> list[str]:\n    return [u.name for u in users if u.live]\n"]),
    "partial": ("partial", ["def first_job(config):\n" + SHARED + "    for a in index:\n        emit_first(a)\n    return index\n", "def second_job(config, mode, limit):\n" + SHARED + "    with lock(mode):\n        send_batch(index, limit)\n    log_done(mode)\n    while limit:\n        limit = step(limit)\n    assert mode\n    notify(mode, limit)\n    return None\n"]),
    "constants": ("scattered-rule", [LIMITS.format("SIZE_LIMITS"), LIMITS.format("SIZE_LIMITS")]),
    "n_operator": ("negative", [invoice("gain_sum").replace("audit", "watch"), invoice("loss_sum").replace("audit", "watch").replace("* row.count", "- row.count")]),
    "n_callee": ("negative", ["def keep_file(path: Path) -> int:\n    data = read_bytes(path)\n    store(path, data)\n    return len(data)\n", "def drop_file(path: Path) -> int:\n    data = list_links(path)\n    unlink(path, data)\n    return count(data)\n"]),
    "n_getters": ("negative", ["class A:\n    def size(self) -> int:\n        return self._size\n", "class B:\n    def size(self) -> int:\n        return self._size\n"]),
    "n_dunder": ("negative", ["class P:\n    def __eq__(self, other):\n        return self.a == other.a\n\n    def __hash__(self):\n        return hash(self.a)\n", "class Q:\n    def __eq__(self, other):\n        return self.a == other.a\n\n    def __hash__(self):\n        return hash(self.a)\n"]),
    "n_stub": ("negative", ["class S:\n    def run(self, job: Job) -> None:\n        raise NotImplementedError\n", "class T:\n    def run(self, job: Job) -> None:\n        raise NotImplementedError\n"]),
    "n_shape": ("negative", ["def area(w: int, h: int) -> int:\n    side = w * h\n    return side\n", "def share(a: int, b: int) -> int:\n    while b:\n        a, b = b, a % b\n    return a\n"]),
}


@pytest.fixture(scope="module")
def tiers(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("labelled")
    for case, (_, sources) in CASES.items():
        for i, text in enumerate(sources):
            path = root / case / f"m{i}.py"
            path.parent.mkdir(exist_ok=True)
            path.write_text(text)
    found = analyze.analyze_folder(spark, str(root)).findings
    out = dict.fromkeys(CASES, "none")
    for r in found.select("tier", "files", F.size("files").alias("n")).collect():
        folders = {f.split("/")[0] for f in r.files}
        if len(folders) == 1 and r.n > 1:  # a target of one case only
            case = folders.pop()
            out[case] = max(out[case], r.tier, key=lambda t: ORDER.index(t) if t in ORDER else -1)
    return out


def rank(tier):
    return ORDER.index(tier) if tier in ORDER else -1


def test_no_negative_is_recommended(tiers):
    assert {c: t for c, t in tiers.items() if CASES[c][0] == "negative" and t == "recommended_edit"} == {}


def test_clones_are_recommended(tiers):
    for kind in ("type-1", "type-2"):
        assert {c: tiers[c] for c in CASES if CASES[c][0] == kind and tiers[c] != "recommended_edit"} == {}


def test_other_positives_surface(tiers):
    hidden = {c: t for c, t in tiers.items() if CASES[c][0] in ("type-3", "partial", "scattered-rule") and rank(t) < rank("maintenance_note")}
    assert hidden == {}, tiers
