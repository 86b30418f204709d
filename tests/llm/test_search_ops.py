"""Top-k search, SimHash, passages, toxicity, HTML and the pipeline against brute force and held-out accuracy."""

import random
import re
import time

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from twinframe.llm import common, html_extract, html_train, simhash, substring, topk, toxicity


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 16)
    monkeypatch.setattr(topk, "CHUNK", 32)
    monkeypatch.setattr(topk, "SLICE_ROWS", 100)
    rng = np.random.default_rng(1)
    vecs = [(int(i), (rng.normal(size=12) * rng.choice([0.2, 1, 3])).astype(np.float32).tolist()) for i in range(600)]
    vecs += [(1000 + i, vecs[3][1]) for i in range(40)] + [(2000, None), (2020, [1.0, None]), (2040, [float("nan")] * 12), (2060, [float("inf")] + [0.0] * 11), (None, vecs[1][1]), (20, vecs[20][1]), (2080, []), (2100, [2.0]), (2120, [-0.001] * 12)]
    d = spark.createDataFrame([(*v, 7) for v in vecs], "vec_id long, embedding array<float>, score int")
    got = {}
    for r in topk.top_k(d, lambda v: v % 20 == 0, k=7).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    q = [(i, [int(np.floor(64 * float(np.float32(x)))) for x in v]) for i, v in vecs if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for i in {i for i, _ in q if i % 20 == 0}:
        x = min(v for j, v in q if j == i)
        best = sorted((-sum(a * b for a, b in zip(x, v, strict=False)), j) for j, v in q if j != i)[:7]
        assert sorted(got[i]) == [(k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert topk.top_k(d.limit(0), lambda v: v % 20 == 0).count() == 0


def test_top_k_with_fewer_candidates_and_large_numbers(spark):
    d = spark.createDataFrame([(0, [3e7, 1.0]), (1, [3e7, 0.0]), (2, [-1.0, 5.0])], "vec_id long, embedding array<double>")
    rows = sorted((r["rank"], r.vec_id, r.score) for r in topk.top_k(d, lambda v: v == 0).collect())
    assert rows == [(1, 1, 64 * 3 * 10**7 * 64 * 3 * 10**7), (2, 2, -64 * 64 * 3 * 10**7 + 64 * 320)]


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, edges):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1001 + i) for i in range(200)] + [(r.randrange(2000, 2300), r.randrange(2000, 2300)) for _ in range(200)] + [(5, 5)]
    got = {x.node: x.root for x in common.components(spark.createDataFrame(edges + [(None, 3)], "a long, b long")).collect()}
    want = brute_components({x for e in edges for x in e}, edges)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {k: v for k, v in want.items() if k in linked}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 16)
    monkeypatch.setattr(simhash, "BLOCKS", 6)  # blocks of several tiles
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(r.randint(1, 5)))
    texts = [" ".join(word() for _ in range(r.choice([0, 1, 3, 4, 5, 60, 200]))) for _ in range(250)]
    for _ in range(150):  # near and exact copies
        w = r.choice(texts).split(" ")
        for _ in range(r.randint(0, 2)):
            w[r.randrange(len(w))] = word()
        texts.append(" ".join(w))
    texts += [None, "", " \t\n\x0b\x0c\r", "A B\tC\x0bD", "a b c d", "é\xa0É 中 \x85 x", "long " * 30_000]
    rows = list(enumerate(texts, 10)) + [(10, texts[0])]
    d = spark.createDataFrame([(*x, "c") for x in rows], "doc_id long, text string, fingerprint string")
    got = simhash.near_duplicates(d).collect()
    assert len(got) == len(rows)
    fp = {i: brute_fingerprint(t) for i, t in rows}
    ids = sorted(fp)
    want = brute_components(ids, [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (fp[a] ^ fp[b]).bit_count() <= 4])
    assert len(set(want.values())) < len(ids) - 30
    for x in got:
        assert (x.fingerprint, x.component_id) == (f"{fp[x.doc_id]:016x}", want[x.doc_id])
    assert {x.doc_id for x in simhash.keep_one(d).collect()} == set(want.values())
    assert simhash.near_duplicates(d.limit(0)).count() == 0


def test_compact_windows_cover_all_subsequences_once():
    r = np.random.default_rng(5)
    for k in range(40):
        g = r.permutation(40).astype(np.uint64) if k % 2 else r.integers(0, 1 + k // 4, 40).astype(np.uint64)
        seen = {}
        for lo, c, hi in substring.compact_windows(g, 6).tolist():
            for i in range(lo, c + 1):
                for j in range(c, hi + 1):
                    if j - i + 1 >= 6:
                        assert (i, j) not in seen and g[i : j + 1].argmin() + i == c
                        seen[i, j] = c
        assert len(seen) == sum(1 for i in range(40) for j in range(i + 5, 40))
    assert len(substring.compact_windows(np.zeros(5, np.uint64), 6)) == 0
    began = time.time()
    substring.keys(substring.tokens("spam " * 1_000_000), 21, 0)
    assert time.time() - began < 10  # linear in runs of one token


def test_equal_stretches_share_a_signature():
    r = np.random.default_rng(6)
    n = substring.run()
    assert (n, substring.shared_tokens()) == (21, 41)
    for _ in range(300):
        common = r.integers(0, r.choice([3, 2**60]), n).astype(np.uint64)
        sides = [np.concatenate([r.integers(0, 2**60, r.integers(0, 60)).astype(np.uint64), common, r.integers(0, 2**60, r.integers(0, 60)).astype(np.uint64)]) for _ in range(2)]
        a, b = (set(substring.keys(x, n, 0)[0].tolist()) for x in sides)
        assert a & b


def test_signatures_of_texts_taken_together_are_those_of_compact_windows():
    r = random.Random(9)
    texts = [" ".join(r.choice([f"w{r.randrange(400)}", "a", "b"]) for _ in range(r.choice([0, 3, 60, 200]))) for _ in range(60)] + ["x " * 300, None]
    h, starts = substring.tokens_of(texts)
    for least in (5, 21):
        got = list(zip(*(x.tolist() for x in substring.keys_of(h, starts, least, 0)[1:3]), strict=True))
        half, want = (least + 1) // 2, set()
        for k, t in enumerate(texts):
            own = substring.tokens(t)
            assert own.tolist() == h[starts[k] : starts[k + 1]].tolist()
            for lo, c, hi in substring.compact_windows(substring.signatures(own, 0), least).tolist():
                want |= {(k, c)} if c - lo >= half - 1 or hi - c >= least - half + 1 else set()
            key, c, _ = substring.keys(own, least, 0)
            assert sorted(c.tolist()) == sorted(c for of, c in got if of == k)
        assert set(got) <= want and len(set(got)) > 0.5 * len(want)


def test_pairs_are_dealt_once(spark, monkeypatch):
    """The join of pairs with their source's chunks is planned for one write, not again for each use of its rows."""
    seen, stage = [], substring.stage
    monkeypatch.setattr(substring, "stage", lambda df: seen.append(df._jdf.queryExecution().optimizedPlan().toString()) or stage(df))
    words = " ".join(f"w{k}" for k in range(60))
    pairs = spark.createDataFrame([(k, 0) for k in range(1, 40)], "doc long, source long")
    assert substring.compare(pairs, spark.createDataFrame([(k, words) for k in range(40)], "doc long, text string")).count() == 39
    assert sum(plan.count("Join LeftOuter") for plan in seen) == 1


def test_alike_passages_share_a_stretch():
    """The longest stretch that two passages of 50 words or more at 0.8 have in common is never shorter than run()."""
    r = random.Random(12)
    seen = 0
    for _ in range(4000):
        a = [f"w{k}" for k in range(r.randint(50, 160))]
        b = list(a)
        for _ in range(r.randint(1, 4)):
            at = r.randrange(len(b))
            r.choice([lambda: b.__setitem__(at, "x"), lambda: b.insert(at, "y"), lambda: b.pop(at), lambda: b.insert(r.randrange(len(b)), b.pop(at))])()
        x, y = ([tuple(w[k : k + 5]) for k in range(len(w) - 4)] for w in (a, b))
        if len(b) >= 50 and len(set(x) & set(y)) >= 0.8 * len(set(x) | set(y)):
            seen += 1
            n = substring.run()
            assert {tuple(x[k : k + n]) for k in range(len(x) - n + 1)} & {tuple(y[k : k + n]) for k in range(len(y) - n + 1)}
    assert seen > 1000


def test_passages_in_repetitive_texts(spark):
    spam = " ".join(["spam"] * 4000 + ["ham", "eggs"] * 2000)
    rows = [(1, spam), (2, spam + " tail"), (3, "a b c " * 3000), (4, " ".join(f"w{i}" for i in range(60)) + " " + "a b c " * 40)]
    got = substring.near_duplicate_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(x.doc_id, x.source_doc_id) for x in got} == {(2, 1), (4, 3)}


def planted(seed=6):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7)))
    prose = lambda n: [word() for _ in range(n)]
    passage = {k: prose(n) for k, n in (("a", 52), ("b", 60), ("c", 120), ("short", 40))}
    docs = {i: prose(r.randint(0, 300)) for i in range(60)}
    want = set()
    for doc, key in ((3, "a"), (9, "a"), (20, "b"), (21, "b"), (22, "b"), (40, "c"), (41, "c"), (50, "short"), (51, "short"), (9, "c")):
        p = list(passage[key])
        if (doc, key) == (41, "c"):
            p[60] = "edited"
        at = r.randint(0, len(docs[doc]))
        docs[doc][at:at] = p
        want.add((doc, key))
    docs[58], docs[59] = list(docs[57]), prose(30_000)
    docs[57] = docs[57] + prose(60)
    docs[58] = list(docs[57])
    return docs, passage, want


def test_passages(spark):
    docs, passage, _ = planted()
    rows = [(i, " ".join(w), "x") for i, w in docs.items()] + [(70, None, "x"), (71, "", "x"), (None, " ".join(docs[3]), "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, start string")
    got = substring.near_duplicate_passages(d).collect()
    assert {(x.doc_id, x.source_doc_id) for x in got} == {(9, 3), (21, 20), (22, 20), (40, 9), (41, 9), (58, 57)}
    for x in got:
        assert x.similarity >= 0.8 and x.end - x.start >= 50 and x.source_end - x.source_start >= 50
        key = {9: "a", 21: "b", 22: "b", 40: "c", 41: "c"}.get(x.doc_id)
        if key:  # the passage is found whole, and little more
            assert abs((x.end - x.start) - len(passage[key])) <= 8
    assert {x.doc_id: x.class_id for x in got} == {9: 3, 21: 20, 22: 20, 40: 3, 41: 3, 58: 57}
    kept = {x.doc_id: x.text for x in substring.drop_repeats(d.withColumnRenamed("start", "doc")).collect()}
    assert set(kept) == set(docs) - {58} | {70, 71, None} and kept[3] == " ".join(docs[3]) and kept[70] is None
    assert " ".join(passage["a"][5:45]) not in kept[9] and " ".join(passage["b"]) in kept[20] and " ".join(passage["short"]) in kept[51]
    assert len(kept[9].split()) >= len(docs[9]) - 52 - 120 and kept[59] == " ".join(docs[59])
    assert substring.near_duplicate_passages(d.limit(0)).count() == 0


def test_passages_of_many_copies_give_a_pair_each(spark):
    docs, passage, _ = planted(7)
    rows = [(i, " ".join([f"u{i}x{k}" for k in range(40)] + passage["b"] + [f"v{i}x{k}" for k in range(40)])) for i in range(120)]
    got = substring.near_duplicate_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(x.doc_id, x.source_doc_id) for x in got} == {(i, 0) for i in range(1, 120)}
    assert all(58 <= x.end - x.start <= 64 for x in got)


def test_moved_sentences_keep_a_passage():
    r = random.Random(14)
    for _ in range(60):
        words = [f"w{k}" for k in range(r.randint(60, 90))]
        at = r.randint(20, len(words) - 20)
        turned = words[at:] + words[:at]
        a, b = ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (words, turned))
        assert len(a & b) / len(a | b) >= 0.8
        pair = [substring.Known(" ".join([*(f"{side}l{k}" for k in range(30)), *w, *(f"{side}r{k}" for k in range(30))])) for side, w in (("x", turned), ("y", words))]
        got = substring.verified(*pair)
        assert got and all(min(q - p, y - x) >= 50 and sim >= 0.8 for p, q, x, y, sim in got)


def test_verification_stays_fast():
    """Long near copies with many edits, and texts of a few lines in changing order."""
    r = random.Random(15)
    words = [f"w{r.randrange(4000)}" for _ in range(20_000)]
    lines = [" ".join(f"l{k}x{i}" for i in range(r.randint(4, 20))) for k in range(12)]
    shuffled = lambda: "\n".join(r.choice(lines) for _ in range(1500))
    for a, b in ((" ".join(words), " ".join(f"e{k}" if r.random() < 0.02 else w for k, w in enumerate(words))), (" ".join(words), " ".join(f"e{k}" if r.random() < 0.1 else w for k, w in enumerate(words))), (shuffled(), shuffled())):
        began = time.time()
        for p, q, x, y, sim in substring.verified(substring.Known(a), substring.Known(b)):
            assert sim >= 0.8 and min(q - p, y - x) >= 50
        assert time.time() - began < 5


def test_equal_runs_are_equal_and_cover_all_hits():
    r = np.random.default_rng(13)
    for k in range(200):
        words = np.sort(r.integers(0, 2**62, r.choice([3, 8, 200]))).astype(np.uint64)
        h, o = (words[r.integers(0, len(words), r.integers(1, 120))] for _ in range(2))
        if k % 2:
            o = np.concatenate([o, h[len(h) // 3 :], o[:5]])
        covered = np.zeros(len(h), bool)
        for i, j, n in substring.equal_runs(h, o):
            assert n > 0 and (h[i : i + n] == o[j : j + n]).all()
            covered[i : i + n] = True
        assert (covered == np.isin(h, o)).all()


def test_one_edited_word_keeps_a_passage():
    for n in (50, 51, 55, 60, 65, 70, 80):
        words = [f"w{k}" for k in range(n)]
        for at in range(n):
            edited = [*words[:at], "edited", *words[at + 1 :]]
            a, b = ({tuple(w[k : k + 5]) for k in range(n - 4)} for w in (words, edited))
            pair = [substring.Known(" ".join([*(f"{side}l{k}" for k in range(30)), *w, *(f"{side}r{k}" for k in range(30))])) for side, w in (("x", edited), ("y", words))]
            got = substring.verified(*pair)
            if len(a & b) / len(a | b) >= 0.8:  # the passages themselves are alike enough
                assert len(got) == 1 and all(q - p >= 50 for p, q in (got[0][:2], got[0][2:4])) and got[0][4] >= 0.8, (n, at, got)
                i, j, x, y, sim = got[0]
                own, them = (set(k.h[p : q - 4].tolist()) for k, p, q in ((pair[0], i, j), (pair[1], x, y)))
                assert abs(len(own & them) / len(own | them) - sim) < 1e-12
    once = substring.Known(" ".join(f"w{k}" for k in range(40)))
    assert substring.verified(once, substring.Known(" ".join(f"w{k}" for k in range(60)))) == []


def near_corpus(n, seed):
    """Pairs of documents with a passage of n words, edited in one to three places in the second; those at 0.8 or more."""
    r, rows, want = random.Random(seed), [], set()
    for k in range(120):
        words = [f"d{k}w{i}" for i in range(n)]
        edited = list(words)
        for _ in range(r.randint(1, max(1, n // 40))):
            edited[r.randrange(n)] = f"e{r.random()}"
        sets = [{tuple(w[i : i + 5]) for i in range(n - 4)} for w in (words, edited)]
        if len(sets[0] & sets[1]) / len(sets[0] | sets[1]) >= 0.8:
            around = lambda: [f"o{r.random()}" for _ in range(r.randint(0, 60))]
            rows += [(2 * k, " ".join([*around(), *words, *around()])), (2 * k + 1, " ".join([*around(), *edited, *around()]))]
            want.add((2 * k + 1, 2 * k))
    return rows, want


@pytest.mark.parametrize("n", [50, 55, 60, 80])
def test_near_passages_equal_brute_force(spark, n):
    rows, want = near_corpus(n, n)
    assert len(want) > 30
    got = {(x.doc_id, x.source_doc_id) for x in substring.near_duplicate_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_exact_passages_behind_a_looser_variant(spark):
    """Documents 2 and 3 share a passage word by word; document 1 has it with every 14th word changed, and hundreds hold its stock phrase."""
    rows = []
    for k in range(40):
        words = [f"p{k}w{i}" for i in range(60)]
        loose = [f"z{k}v{i}" if i % 14 == 7 else w for i, w in enumerate(words)]
        for j, w in enumerate((loose, words, words)):
            rows.append((1000 * (j + 1) + k, " ".join([f"a{k}x{j}y{i}" for i in range(30)] + w + [f"b{k}x{j}y{i}" for i in range(30)])))
    stock = [f"s{i}" for i in range(35)]
    rows += [(10_000 + k, " ".join([f"c{k}y{i}" for i in range(40)] + stock + [f"d{k // 2}y{i}" if k < 20 else f"d{k}y{i}" for i in range(40)])) for k in range(150)]
    got = {(x.doc_id, x.source_doc_id) for x in substring.near_duplicate_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(3000 + k, 2000 + k) for k in range(40)} | {(10_001 + 2 * k, 10_000 + 2 * k) for k in range(10)}


def variants_corpus(seed, n=60):
    """Documents of edited, also shortened, copies of six passages and edited copies of these copies."""
    r = random.Random(seed)
    once = lambda: f"u{r.random()}"
    variants = []
    for b in range(6):
        of = [[f"b{b}w{i}" for i in range(r.choice([50, 56, 64, 90]))]]
        for _ in range(6):
            v = list(r.choice(of))
            for _ in range(r.randint(1, 2)):
                v[r.randrange(len(v))] = once()
            of.append(v)
        variants.append(of)
    docs = {}
    for d in range(n):
        words = []
        for _ in range(r.randint(1, 3)):
            v = r.choice(r.choice(variants))
            if r.random() < 0.3:
                a = r.randint(0, 20)
                v = v[a : a + r.randint(30, 80)]
            words += [*(once() for _ in range(r.randint(0, 70))), *v]
        docs[d] = " ".join([*words, *(once() for _ in range(r.randint(0, 70)))])
    return docs


def smallest_reachable(nodes, links):
    root = {d: d for d in nodes}
    while any(root[a] != root[b] for a, b in links):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    return root


def links_and_repeated_words(docs):
    """By brute force: pairs that share a passage, and for each document the words of its passages that an earlier one has."""
    known = {d: substring.Known(t) for d, t in docs.items()}
    links, want = [], {d: set() for d in docs}
    for a in docs:
        for b in range(a):
            found = substring.verified(known[a], known[b])
            links += [(a, b)] * bool(found)
            for p, q, x, y, _ in found:
                shared = np.flatnonzero(np.isin(known[a].h[p : q - 4], known[b].h[x : y - 4])) + p
                want[a] |= {int(t) + k for t in shared for k in range(5)}
    return links, want


@pytest.mark.parametrize("seed", [0, 1])
def test_classes_and_repeated_words_are_those_of_all_pairs(spark, seed):
    docs = variants_corpus(seed)
    links, want = links_and_repeated_words(docs)
    got = {d: set() for d in docs}
    rows = substring.near_duplicate_passages(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()
    for x in rows:
        got[x.doc_id] |= set(range(x.start, x.end))
    assert {(x.doc_id, x.source_doc_id) for x in rows} <= set(links)
    roots = smallest_reachable(docs, links)
    assert {x.doc_id: x.class_id for x in rows} == {a: roots[a] for a, _ in links}
    assert all(want[d] <= got[d] for d in docs)


def test_pipeline_drops_the_repeated_words_of_all_pairs(spark):
    docs = variants_corpus(0)
    _, want = links_and_repeated_words(docs)
    rows = spark.createDataFrame([(d, t, len(t)) for d, t in docs.items()], "doc_id long, text string, n_chars int")
    kept = {x.doc_id: x.text for x in corpus_pipeline.drop_repeated_passages(spark, rows, "").collect()}
    for d, t in docs.items():
        assert len(kept.get(d, "").split()) <= len(t.split()) - len(want[d])


def test_near_repeats_of_a_document_that_another_one_stands_for(spark):
    """Documents 2 and 3 have a passage in common; 9 has a near repeat of another one of 3, which shares its signatures with a stock phrase of all."""
    stock, linking, tail = ([f"{x}{i}" for i in range(n)] for x, n in (("s", 44), ("l", 60), ("t", 18)))
    only = lambda d, n: [f"o{d}x{n}y{i}" for i in range(60)]
    docs = {1: [*only(1, 0), *stock, *only(1, 1)], 9: [*only(9, 0), *stock, "edited", *tail, *only(9, 1)]}
    docs |= {d: [*only(d, 0), *linking, *only(d, 1), *stock, *(["word", *tail] if d == 3 else []), *only(d, 2)] for d in (2, 3)}
    got = substring.near_duplicate_passages(spark.createDataFrame([(d, " ".join(w)) for d, w in docs.items()], "doc_id long, text string")).collect()
    assert {(x.doc_id, x.source_doc_id, x.class_id) for x in got} == {(3, 2, 2), (9, 3, 2)}


def whole_passages(docs):
    """By brute force: for each document the words of its passages that an earlier one has, and those between them."""
    known = {d: substring.Known(t) for d, t in docs.items()}
    want = {d: set() for d in docs}
    for a in docs:
        for b in (b for b in docs if b < a):
            for p, q, x, y, _ in substring.verified(known[a], known[b]):
                shared = np.flatnonzero(np.isin(known[a].h[p : q - 4], known[b].h[x : y - 4])) + p
                want[a] |= set(range(int(shared[0]), int(shared[-1]) + 5))
    return want


def test_edited_words_inside_a_passage_of_two_covered_halves(spark):
    """Document 9 has one half from 1 and the other from 2; only 3 has both around a word, so the pair (9, 3) makes the word a part of a passage."""
    a, b = ([f"{x}{i}" for i in range(60)] for x in "ab")
    around = lambda d, *w: " ".join([*(f"o{d}y{i}" for i in range(30)), *(x for part in w for x in part), *(f"p{d}y{i}" for i in range(30))])
    docs = {1: around(1, a), 2: around(2, b), 3: around(3, a, ["word"], b), 9: around(9, a, ["edited"], b)}
    rows = spark.createDataFrame([(d, t, len(t)) for d, t in docs.items()], "doc_id long, text string, n_chars int")
    kept = {x.doc_id: x.text for x in corpus_pipeline.drop_repeated_passages(spark, rows, "").collect()}
    assert kept == docs | {3: around(3, ["word"]), 9: around(9)}


@pytest.mark.parametrize("seed", [1, 2])
def test_pipeline_drops_whole_passages_of_all_pairs(spark, seed):
    docs = variants_corpus(seed)
    found = substring.found_in(spark.createDataFrame(list(docs.items()), "doc long, text string")).collect()
    got = {d: set() for d in docs}
    for x in found:
        got[x.doc] |= set(range(x.start, x.end))
    assert all(w <= got[d] for d, w in whole_passages(docs).items())


def edited_copies(seed, n, words=240, share=0.1):
    """Copies of one text in which other words, of a few, stand at a share of the places."""
    r = random.Random(seed)
    return {d: " ".join(f"e{r.randrange(4)}" if r.random() < share else f"w{i}" for i in range(words)) for d in range(n)}


def test_pairs_left_are_settled_at_once(spark, monkeypatch):
    """Documents left at signatures are listed, not joined pair by pair in rounds; classes and words are those of all pairs."""
    docs, seen, calls = edited_copies(0, 40), [], []
    stage, viable = substring.stage, substring.viable
    monkeypatch.setattr(substring, "stage", lambda df: seen.append(df._jdf.queryExecution().optimizedPlan().toString()) or stage(df))
    monkeypatch.setattr(substring, "viable", lambda *a: calls.append(1) or viable(*a))
    found = substring.found_in(spark.createDataFrame(list(docs.items()), "doc long, text string")).collect()
    assert len(calls) == 1 and not any("doc#" in line and "Join Inner" in line and " > y#" in line for plan in seen for line in plan.splitlines())
    got = {d: set() for d in docs}
    for x in found:
        got[x.doc] |= set(range(x.start, x.end))
    assert all(w <= got[d] for d, w in whole_passages(docs).items())
    links, _ = links_and_repeated_words(docs)
    assert smallest_reachable(docs, [(x.doc, x.source) for x in found]) == smallest_reachable(docs, links)


def test_documents_lists_give_each_pair_once(spark, monkeypatch):
    monkeypatch.setattr(substring, "KEPT", 3)
    rows = [(d, [(s, s % 2) for s in range(k, d)]) for d in (5, 6, 9) for k in range(5)] * 2
    got = substring.once(spark.createDataFrame(rows, "doc long, others array<struct<source: long, root: long>>")).collect()
    assert sorted(map(tuple, got)) == [(d, s, s % 2) for d in (5, 6, 9) for s in range(d)]


@pytest.mark.parametrize("least", [3, 400])
def test_pairs_in_several_parts(spark, monkeypatch, least):
    """Lists and sources of a document are dealt to several, and nothing is lost by that."""
    monkeypatch.setattr(substring, "LISTED", least)
    monkeypatch.setattr(substring, "TOGETHER", least)
    docs = edited_copies(1, 30)
    got = {d: set() for d in docs}
    for x in substring.found_in(spark.createDataFrame(list(docs.items()), "doc long, text string")).collect():
        got[x.doc] |= set(range(x.start, x.end))
    assert all(w <= got[d] for d, w in whole_passages(docs).items())


def test_no_passage_is_hopeless():
    """Each word of a passage, but for words that fill it up, gives hope; also among repeated and moved words."""
    r = random.Random(3)
    for case in range(300):
        words = [f"w{r.randrange([10**6, 60, 8][case % 3])}" if case % 3 else f"w{i}" for i in range(r.randint(50, 160))]
        other = [f"e{r.randrange(5)}" if r.random() < r.choice([0.0, 0.02, 0.06]) else w for w in words]
        if case % 4 == 0:
            k = r.randrange(len(other))
            other = other[k:] + other[:k]
        if case % 5 == 0:
            k = r.randrange(len(other))
            other[k:k] = [f"i{r.randrange(9)}" for _ in range(r.randint(1, 8))] * r.choice([1, 1, 2])
        a, b = substring.Known(" ".join([*words, *(f"x{i}" for i in range(30))])), substring.Known(" ".join([*(f"y{i}" for i in range(20)), *other]))
        for p, q, x, y, _ in substring.verified(a, b):
            shared = np.flatnonzero(np.isin(a.h[p : q - 4], b.h[x : y - 4])) + p
            for k in range(int(shared[0]), int(shared[-1]) + 5):
                free = np.zeros(len(a.h) + 4, bool)
                free[k] = True
                assert substring.hopeful(a, b, free)


def test_texts_that_share_an_id(spark):
    p, own = " ".join(f"p{i}" for i in range(60)), " ".join(f"o{i}" for i in range(70))
    rows = [(1, p, 9), (1, own, 9), (1, own + " " + p, 9), (2, own, 9), (2, "short", 9), (2, "short", 9)]
    d = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    kept = sorted((r.doc_id, r.text) for r in substring.drop_repeats(d).collect())
    assert sum(p in t for _, t in kept) == 1 and sum(own in t for _, t in kept) == 1 and kept[-2:] == [(2, "short")] * 2


def test_without():
    s = [{"start": 1, "end": 3}, {"start": 2, "end": 4}]
    assert substring.without(" a b  c\nd e ", s) == " a e "
    assert substring.without("a b", [{"start": 0, "end": 2}]) == "" and substring.without(None, s) is None and substring.without("a", None) == "a"


def toxic_corpus(spark, n=1200):
    r = random.Random(11)
    word = lambda: "".join(r.choice(["an", "er", "th", "in", "on", "re", "ti", "es"]) for _ in range(r.randint(1, 4)))
    docs, labels = [], []
    for i in range(n):
        bad = r.random() < 0.25
        w = [word() for _ in range(r.randint(20, 200))]
        if bad:
            for _ in range(max(1, len(w) // 30)):
                w[r.randrange(len(w))] = r.choice(["vileko", "grubbax", "scumlo" + word()])
        docs.append((i, " ".join(w), 0.5))
        labels.append((i, int(bad)))
    docs += [(n, None, 0.5), (n + 1, "", 0.5), (None, "vileko", 0.5), (n + 2, "anan " * 40_000, 0.5), (0, docs[0][1], 0.5)]
    return spark.createDataFrame(docs, "doc_id long, text string, score double"), spark.createDataFrame(labels + [(3, None), (None, 1), (n + 50, 1)], "doc_id long, toxic int"), dict(labels)


def test_toxicity_on_held_out_rows(spark):
    docs, labels, truth = toxic_corpus(spark)
    got = toxicity.classify(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 200 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    by = {r.doc_id: r for r in got}
    assert by[1200].score == by[1201].score < 0.3 and by[1202].predicted == 0
    kept = {r.doc_id for r in toxicity.keep_clean(docs, labels).collect()}
    assert kept == {i for i, r in by.items() if not r.predicted}


def test_toxicity_never_learns_held_out_labels(spark):
    docs, labels, _ = toxic_corpus(spark, 300)
    turned = labels.withColumn("toxic", toxicity.F.when(toxicity.held_out(), 1 - toxicity.F.col("toxic")).otherwise(toxicity.F.col("toxic")))
    score = lambda d: sorted((r.doc_id or -1, round(r.score, 9)) for r in toxicity.classify(docs, d).collect())
    assert score(labels) == score(turned)


def test_toxicity_counts_labels_that_the_curve_leaves(spark, monkeypatch):
    docs, labels, truth = toxic_corpus(spark, 600)
    learnable = [r.doc_id for r in labels.filter(~toxicity.held_out()).select("doc_id").distinct().collect() if r.doc_id in truth]
    kinds, count = [], toxicity.count
    monkeypatch.setattr(toxicity, "CALIBRATION_ROWS", 10)
    monkeypatch.setattr(toxicity, "count", lambda df: kinds.extend(r.kind for r in df.select("kind").collect()) or count(df))
    toxicity.fit(docs, labels)
    assert sum(k != toxicity.OTHER for k in kinds) >= len(learnable) - 10


def test_words_of_latin_texts_are_those_of_the_pattern():
    r = random.Random(3)
    texts = ["".join(chr(r.choice([r.randrange(256), r.randrange(0x400), 65])) for _ in range(r.randrange(30))) for _ in range(2000)] + [f"a{chr(k)}B" for k in range(0x250)]
    assert all(toxicity.all_words(t) == toxicity.LETTERS.findall(t.lower()) for t in texts)


def test_toxicity_features_are_each_texts_own():
    words = [f"w{k}" for k in range(40)]
    owner, orders = toxicity.grams(words)
    gram = np.unique(np.concatenate([h[top] for _, _, h, _, _, top in orders]).view(np.int64))
    r = random.Random(4)
    texts = [None, "", *(" ".join(r.choice(words) for _ in range(r.randint(1, 12))) for _ in range(300)), "w1 w1 w1", ""]
    model = toxicity.Model(gram, np.linspace(-1, 1, len(gram)))
    one = dict(zip(words, toxicity.Model(gram, np.linspace(-1, 1, len(gram))).differences(words), strict=True))
    for text, row in zip(texts, model.features(texts), strict=True):
        own = toxicity.words_of(text)
        ratio = lambda part: sum(one[w] for w in part) / sum(len(w) + 1 for w in part)
        want = (ratio(own), max(ratio(own[k : k + 4]) for k in range(max(1, len(own) - 3)))) if own else (0, 0)
        assert np.allclose(row, want, atol=1e-9)


def test_toxicity_without_labels(spark):
    docs, labels, _ = toxic_corpus(spark, 20)
    assert {(r.score, r.predicted) for r in toxicity.classify(docs, labels.limit(0)).collect()} == {(0.0, 0)}
    assert toxicity.classify(docs.limit(0), labels).count() == 0


def test_toxicity_with_few_numbers_broadcast(spark, monkeypatch):
    docs, labels, _ = toxic_corpus(spark, 120)
    score = lambda: sorted((r.doc_id or -1, round(r.score, 5)) for r in toxicity.classify(docs, labels).collect())
    want = score()
    monkeypatch.setattr(toxicity, "GAINS", 50)
    assert score() == want


def test_toxicity_does_not_depend_on_partitions(spark):
    docs, labels, _ = toxic_corpus(spark, 200)
    score = lambda d: sorted((r.doc_id or -1, r.score) for r in toxicity.classify(d, labels).collect())
    assert score(docs.coalesce(1)) == score(docs.repartition(7, "text"))


def test_kneser_ney_against_plain_counting(spark):
    """Vectorised, joined probabilities against a dictionary version."""
    toxic, ordinary, other = ["bada bada bad", "badu"], ["gado ga bado", "gad gadu ado"], ["lala badga", "zz"]
    texts = [(x, kind) for kind, xs in ((1, toxic), (0, ordinary), (2, other)) for x in xs]
    counts = toxicity.count(spark.createDataFrame(texts, "text string, kind int").repartition(3))
    rows = counts.toPandas()
    model = toxicity.Fitted(toxicity.gains(counts)).model.value
    n_max, grams = toxicity.ORDERS, {}
    for kind, texts in ((1, toxic), (0, ordinary), (2, other)):
        for x in texts:
            for w in toxicity.words_of(x):
                s = f"\x02{w}\x03"
                for i in range(1, len(s)):
                    for n in range(1, min(n_max, i + 1) + 1):
                        g = grams.setdefault(s[i - n + 1 : i + 1], [0, 0, 0])
                        g[2] += 1
                        if kind != 2:
                            g[1 - kind] += 1
    assert sum(len(g) == 5 for g in grams) == (rows.n == 5).sum() and len(rows) == len(grams)
    left = {}
    for g in grams:
        left.setdefault(g[1:], set()).add(g[0])
    cont = {g: len(left.get(g, ())) for g in grams}
    d_of = lambda v: toxicity.discount(sum(x == 1 for x in v), sum(x == 2 for x in v))

    def shared(g):
        if not g:
            return 1 / (1 + sum(len(x) == 1 for x in grams))
        same = [x for x in grams if len(x) == len(g) and x[:-1] == g[:-1]]
        own = {x: (cont[x] if len(x) < n_max else grams[x][2]) for x in same}
        d = d_of([cont[x] if len(x) < n_max else grams[x][2] for x in grams if len(x) == len(g)])
        total = sum(own.values())
        return (max(own.get(g, 0) - d, 0) + d * sum(v > 0 for v in own.values()) * shared(g[1:])) / total if total else shared(g[1:])

    def p(g, k):
        same = {x: v[k] for x, v in grams.items() if len(x) == len(g) and x[:-1] == g[:-1]}
        d, total = d_of([v[k] for x, v in grams.items() if len(x) == len(g)]), sum(same.values())
        return (max(same.get(g, 0) - d, 0) + d * sum(v > 0 for v in same.values()) * shared(g[1:])) / total if total else shared(g[1:])

    for w in ("bada", "gado", "zz", "badga", "lala"):
        s = f"\x02{w}\x03"
        want = sum(np.log(p(s[max(0, i - n_max + 1) : i + 1], 0)) - np.log(p(s[max(0, i - n_max + 1) : i + 1], 1)) for i in range(1, len(s)))
        assert model.differences([w])[0] == pytest.approx(want, rel=1e-4, abs=1e-4)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>x";</script></head><body>
<nav><ul><li><a href="/a">Alpha</a></li><li><a href="/b">Beta</a></ul></nav><div class="ad">Buy things. Now.</div>
<article><h1>The  title&nbsp;here</h1><p><b>First para &amp; more of it, with words.<br><p>Second   one
goes on. And on.</p><!-- no --><p>Third &lt;p&gt; &#x41; ends.</article><div id=comments><h3>Comments</h3><p>I liked this very much, thanks.</p></div>
<form><label>Name</label><input><button>Send</button></form><footer>&copy; Site. All of it.</footer>"""


def test_html_extraction(spark):
    rows = [(1, "u", PAGE, "x"), (2, "u", None, "x"), (3, None, "", "x"), (4, "u", "<nav><a href=x>Menu</a></nav><script>unclosed", "x"), (5, "u", "<article>" + "<p>A long sentence that goes on, for a while.</p>" * 3000 + "</article>", "x"), (1, "u", PAGE, "x"), (6, "u", "<<<>>> < a <b", "x")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {}
    for r in html_extract.extract(d).collect():
        got.setdefault(r.page_id, []).append(r)
        assert r.n_chars == len(r.text)
    text = "The title here\nFirst para & more of it, with words.\nSecond one goes on. And on.\nThird <p> A ends."
    assert [r.text for r in got[1]] == [text] * 2 and got[2][0].text == got[3][0].text == got[4][0].text == ""
    assert got[5][0].text.count("\n") == 2999
    assert html_extract.extract(d.limit(0)).count() == 0


def test_html_keeps_text_of_formulas_and_fallbacks():
    page = PAGE.replace("Second   one", "Second <math><mi>x</mi><mo>=</mo><mn>2</mn></math> one").replace("<p>Third", "<noscript><p>Shown without scripts, as it says.</p></noscript><p>Third")
    text = html_extract.main_texts([page])[0]
    assert "Second x=2 one goes on." in text and "Shown without scripts, as it says." in text
    p = html_extract.Page("<p>a</p><textarea>form</textarea><svg><text>drawn</text></svg><iframe>frame</iframe><template>t</template><p>b <!-- open")
    assert p.texts == ["a", "drawn", "b"]


@pytest.mark.parametrize("unit", ['<a href="', "<a ", '<a ">"', "<!-", "<a b='", '<p title="x>', "<", "</", "<![", "<svg>"])
def test_html_is_linear(unit):
    for tail in ("", ">", '">', "'>text"):
        began = time.time()
        html_extract.Page(unit * (300_000 // len(unit)) + tail)
        assert time.time() - began < 5, (unit, tail)


def test_html_labels_on_held_out_layouts():
    data = html_train.examples(150, 99)
    found = html_extract.label([x for x, _ in data], html_extract.weights())
    right = np.concatenate([(q >= 0.5) == (y > 0.5) for q, (_, y) in zip(found, data, strict=True)])
    assert right.mean() > 0.985


def test_html_batches_change_nothing():
    xs = [x for x, _ in html_train.examples(20, 5)]
    together = html_extract.label(xs, html_extract.weights())
    for x, q in zip(xs, together, strict=True):
        assert np.allclose(html_extract.label([x], html_extract.weights())[0], q, atol=1e-4)


def test_pipeline(spark, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "substring", "packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = docs
    for _, f in corpus_pipeline.STAGES[:-1]:
        kept = common.stage(f(spark, kept, sf))
        assert kept.columns == docs.columns
    packed = corpus_pipeline.run(spark, sf)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in kept.collect()}
    assert 0 < kept.count() < docs.count()
    assert {r.component_id for r in simhash.near_duplicates(kept).collect()} != set()
    for _, f in corpus_pipeline.STAGES[:3]:
        assert f(spark, docs.limit(0), sf).count() == 0
