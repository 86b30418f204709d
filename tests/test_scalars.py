"""Column functions against plain Python."""

import math
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from twinframe.functions import scalars as S
from twinframe.functions import structure as T


def column(spark, rows, schema, make):
    return [r.out for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i long, {schema}").select("i", make.alias("out")).orderBy("i").collect()]


def test_round4_is_pythons(spark):
    r = random.Random(1)
    xs = [r.random() for _ in range(3000)] + [k / 20000 for k in range(5001)] + [a / b for a in range(40) for b in range(1, 40)] + [-k / 20000 for k in range(999)]
    assert column(spark, [(x,) for x in xs], "x double", S.round4(F.col("x"))) == [round(x, 4) for x in xs]


def test_curves(spark):
    xs = [-1.0, 0.0, 0.3, 1.0, 2.0, 5.0]
    row = lambda c: column(spark, [(x,) for x in xs], "x double", c)
    assert row(S.ramp(F.col("x"), 0.0, 2.0)) == [0, 0, 0.15, 0.5, 1, 1]
    assert row(S.inverse_ramp(F.col("x"), 0.0, 2.0)) == [1, 1, 0.85, 0.5, 0, 0]
    assert row(S.ramp(F.col("x"), 1.0, 1.0)) == [0, 0, 0, 1, 1, 1]
    assert row(S.ramp_count(F.col("x"), 2, 6)) == [0, 0, 0, 0, 0.2, 0.8]
    assert row(S.noisy_or(F.col("x"), F.lit(0.5))) == pytest.approx([0.5, 0.5, 0.65, 1, 1, 1])
    assert row(S.combine(F.col("x"), F.lit(0.5))) == [0, 0, 0.15, 0.5, 0.5, 0.5]


def test_sets_and_multisets(spark):
    r = random.Random(2)
    rows = [([r.choice("abcd") for _ in range(r.randint(0, 6))], [r.choice("abcd") for _ in range(r.randint(0, 6))]) for _ in range(200)]
    a, b = F.col("a"), F.col("b")
    schema = "a array<string>, b array<string>"
    jac = lambda x, y: len(set(x) & set(y)) / len(set(x) | set(y)) if x and y else 0.0
    assert column(spark, rows, schema, S.jaccard(a, b)) == pytest.approx([jac(x, y) for x, y in rows])
    want = [sum((Counter(x) & Counter(y)).values()) / sum((Counter(x) | Counter(y)).values()) if x and y else 0.0 for x, y in rows]
    assert column(spark, rows, schema, S.multiset_jaccard(S.counts(a), S.counts(b))) == pytest.approx(want)
    maps = [({"k": x, "m": y}, {"k": y, "n": []}) for x, y in rows]

    def mean(p, q):
        used = [jac(p.get(k, []), q.get(k, [])) for k in {*p, *q} if p.get(k) or q.get(k)]
        return sum(used) / len(used) if used else 0.0

    assert column(spark, maps, "a map<string,array<string>>, b map<string,array<string>>", S.mean_jaccard_by_key(a, b)) == pytest.approx([mean(p, q) for p, q in maps])


def test_sequences(spark):
    r = random.Random(3)
    rows = [([r.choice("abc") for _ in range(r.randint(0, 7))], [r.choice("abc") for _ in range(r.randint(0, 7))]) for _ in range(150)]
    a, b = F.col("a"), F.col("b")
    schema = "a array<string>, b array<string>"
    assert column(spark, rows, schema, S.common_prefix(a, b)) == [T.shared_prefix(x, y) for x, y in rows]
    assert column(spark, rows, schema, S.common_suffix(a, b)) == [T.shared_prefix(x[::-1], y[::-1]) for x, y in rows]
    assert column(spark, rows, schema, S.lcs_length(a, b)) == [brute_lcs(x, y) for x, y in rows]


def brute_lcs(x, y):
    if not x or not y:
        return 0
    return brute_lcs(x[1:], y[1:]) + 1 if x[0] == y[0] else max(brute_lcs(x[1:], y), brute_lcs(x, y[1:]))


def test_names_and_globs(spark):
    names = ["parseHTTPBody", "load_users2", "XMLHttpRequest", "__init__", "", "a-b.c"]
    assert column(spark, [(n,) for n in names], "x string", S.normalized_identifier(F.col("x"))) == ["parse http body", "load users2", "xml http request", "init", "", "a b c"]
    pairs = [("load users", "load users"), ("load users", "load orders"), ("get", "get payload item"), ("is ok", "is bad"), ("", "x"), ("parse rows", "parse row")]
    want = [1.0, 1 / 3, 0.0, 1 / 3, 0.0, 0.9]
    assert column(spark, pairs, "a string, b string", S.name_similarity(F.col("a"), F.col("b"))) == pytest.approx(want)
    paths = ["a/b.py", "b.py", "a/c/b.js", "a/.git/x", "x[1].py"]
    match = lambda *p: column(spark, [(x,) for x in paths], "x string", S.glob_any(F.col("x"), p))
    assert match("*.py") == [True, True, False, False, True]
    assert match("a/**") == [True, False, True, True, False]
    assert match("**/.git/**") == [False, False, False, True, False] and match("a/*") == [True, False, False, False, False]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=8), st.lists(st.sampled_from("abc"), max_size=8))
def test_alignment_properties(a, b):
    m = [(i, int(j)) for i, j in enumerate(T.partners(a, b)) if j >= 0]
    assert len(m) == brute_lcs(a, b) == T.align(a, b)["lcs"]
    assert all(a[i] == b[j] for i, j in m) and m == sorted(m)
    u = T.unify(a, b, a, b)
    assert u["stable"] <= min(len(a), len(b)) and u["stable"] == sum((Counter(a) & Counter(b)).values()) or u["holes"] >= 0
    assert T.unify(b, a, b, a)["stable"] == u["stable"] and (u["holes"] == 0) == (Counter(a) == Counter(b))


def tree(spec):
    """Post-order arrays of nested (label, children)."""
    label, arity = [], []

    def walk(node):
        for c in node[1]:
            walk(c)
        label.append(node[0])
        arity.append(len(node[1]))

    walk(spec)
    return {"label": label, "arity": arity}


def brute_distance(x, y):
    """Selkow's distance by plain recursion over nested trees."""
    size = lambda t: 1 + sum(map(size, t[1]))

    def rows(p, q):
        if not p or not q:
            return sum(map(size, p)) + sum(map(size, q))
        return min(rows(p[1:], q) + size(p[0]), rows(p, q[1:]) + size(q[0]), rows(p[1:], q[1:]) + one(p[0], q[0]))

    def one(s, t):
        return (s[0] != t[0]) + rows(s[1], t[1])

    return rows(x, y)


trees = st.recursive(st.tuples(st.sampled_from("ab"), st.just([])), lambda c: st.tuples(st.sampled_from("ab"), st.lists(c, max_size=3)), max_leaves=6)


@settings(max_examples=80, deadline=None)
@given(st.lists(trees, max_size=3), st.lists(trees, max_size=3))
def test_tree_distance(x, y):
    left, right = list(x), list(y)
    for s in x:
        if s in right:
            right.remove(s)
            left.remove(s)
    a, b = tree(("body", x)), tree(("body", y))
    got = T.compare_trees(a, b, 250_000)
    assert got["distance"] == brute_distance(left, right) == T.compare_trees(b, a, 250_000)["distance"]
    assert T.compare_trees(a, b, 0)["distance"] is None and not math.isnan(got["nodes"])
