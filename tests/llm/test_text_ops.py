"""BPE, media, packing, chat and URL rules against other implementations, round trips and brute force."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinframe.llm import bpe, chat, media, packing, urlfilter
from twinframe.llm.queries import URL_RULES

DOCS = "doc_id long, text string, n_tokens string, ids string, media string, bucket string"


def docs(spark, texts):
    """Rows with other columns whose names clash with results."""
    return spark.createDataFrame([(i, t, "x", "y", "z", "b") for i, t in texts], DOCS)


TEXTS = [(1, "Hello, World's 123 ends"), (2, None), (3, ""), (4, " \n\t "), (5, "ǅ ß Σίσυφος ΣΑΣ İ é é 中文"), (6, "<|endoftext|>a<|startoftext|> <|EndOfText|>"), (7, "ab" * 40_000), (8, "word " * 30_000), (1, "Hello, World's 123 ends"), (None, "null id")]


@pytest.fixture(scope="module")
def vocabulary():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def test_bpe_equals_the_library(vocabulary):
    from tokenizers import Tokenizer

    ours, theirs, r = bpe.WordBPE(vocabulary), Tokenizer.from_file(vocabulary), random.Random(3)
    signs = [chr(c) for c in (*range(0x250), *range(0x370, 0x400), 0x130, 0x212B, 0x301, 0x4E2D, 0x1F600, 0xAC00, 0x200B, 0x3000, 0x209D)]
    cases = [t or "" for _, t in TEXTS] + ["".join(r.choice(r.choice((signs, "abc ' stl<|>", " \n"))) for _ in range(r.randint(0, 40))) for _ in range(2000)]
    for t in cases:
        e = theirs.encode(t, add_special_tokens=False)
        assert ours.encode(t) == e.ids
        assert ours.decode(e.ids) == ours.encode_text(t)[1] == theirs.decode(e.ids, skip_special_tokens=False)


def test_bpe_memo_changes_nothing(vocabulary, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_WORDS", 2)
    small = bpe.WordBPE(vocabulary)
    whole = bpe.WordBPE(vocabulary)
    monkeypatch.undo()
    for text in ["the cat sat on the mat", "the cat", "a b a b c"] * 3:
        assert small.encode(text) == whole.encode(text) == bpe.WordBPE(vocabulary).encode(text)


def test_bpe_frames(spark, vocabulary):
    d = docs(spark, TEXTS)
    rows = bpe.digests(d, vocabulary).collect()
    assert len(rows) == len(TEXTS)
    full = {r.doc_id: r for r in bpe.encode(d, vocabulary).collect()}
    again = {r.doc_id: r.decoded for r in bpe.decode(spark.createDataFrame([(i, x.ids) for i, x in full.items()], "doc_id long, ids array<int>"), vocabulary).collect()}
    for r in rows:
        x = full[r.doc_id]
        assert r.n_tokens == len(x.ids) and again[r.doc_id] == x.decoded
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, x.ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(x.decoded.encode()).hexdigest()
    assert full[2].ids == full[3].ids == full[4].ids == []
    assert bpe.digests(d.limit(0), vocabulary).count() == 0


def test_media_round_trip(spark):
    stored = media.store_texts(docs(spark, TEXTS))
    got = media.digests(stored).collect()
    assert len(got) == len(TEXTS)
    texts = dict(TEXTS)
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        padded = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(padded))
        assert r.payload_sha256 == hashlib.sha256(padded).hexdigest() and r.tail_crc32 == zlib.crc32(padded[-64:])
    assert len({(r.media_sha256, r.feature) for r in got if r.doc_id in (2, 3)}) == 1
    assert media.digests(media.store_texts(docs(spark, TEXTS).limit(0))).count() == 0


def test_media_reader_on_other_layouts(spark):
    data = media.write(bytes(range(64)) * 200)
    track = media.read(data)[0]
    assert track["codec"] == "raw " and track["duration"] == 12_800 and len(track["sizes"]) == 200
    assert [data[o : o + s] for o, s in media.keyframes(track)] == [bytes(range(64))] * 4
    # samples of unlike sizes in two chunks, no sync table: all are key frames
    payload = b"aaabbbbcc"
    stbl = media.box(b"stbl", media.full(b"stsd", (1).to_bytes(4, "big"), media.box(b"avc1", bytes(8))), media.full(b"stts", *(x.to_bytes(4, "big") for x in (2, 1, 10, 2, 20))), media.full(b"stsc", *(x.to_bytes(4, "big") for x in (2, 1, 2, 1, 2, 1, 1))), media.full(b"stsz", *(x.to_bytes(4, "big") for x in (0, 3, 3, 4, 2))), media.full(b"co64", (2).to_bytes(4, "big"), (8).to_bytes(8, "big"), (15).to_bytes(8, "big")))
    file = media.box(b"mdat", payload) + media.box(b"moov", media.box(b"trak", media.box(b"mdia", media.full(b"mdhd", *(x.to_bytes(4, "big") for x in (0, 0, 600, 50))), media.box(b"minf", stbl))))
    t = media.read(file)[0]
    assert (t["codec"], t["timescale"], t["duration"]) == ("avc1", 600, 50)
    assert t["offsets"].tolist() == [8, 11, 15] and t["starts"].tolist() == [0, 10, 30] and media.payload(file, t) == payload
    rows = media.media_columns(spark.createDataFrame([(1, bytearray(file), "x"), (2, None, "x"), (3, bytearray(b"junk" * 9), "x"), (4, bytearray(data[:300]), "x"), (1, bytearray(file), "x")], "media_id long, media binary, codec string")).collect()
    assert [(r.media_id, r.codec, [(k.offset, k.size) for k in r.keyframes]) for r in rows] == [(1, "avc1", [(8, 3), (11, 4), (15, 2)])] * 2


def test_media_reader_on_broken_files():
    good = media.write(bytes(range(64)) * 300)
    r = random.Random(17)
    for _ in range(400):
        data = bytearray(good[: r.randint(0, len(good))])
        for _ in range(r.randint(0, 12)):
            if data:
                data[r.randrange(min(len(data), 900))] = r.randrange(256)
        for t in media.read(bytes(data)):
            assert len(t["offsets"]) == len(t["sizes"]) <= len(data) and media.keyframes(t) is not None
            media.payload(bytes(data), t)
    assert media.read(media.box(b"moov", media.box(b"trak", media.box(b"mdia", media.box(b"mdhd"))))) == []
    deep = b""
    for _ in range(3000):
        deep = media.box(b"moov", deep)
    assert media.read(deep) == []
    counts = good.replace(media.struct.pack(">III", 1, 300, 64), media.struct.pack(">III", 1, 2**32 - 1, 64)).replace(media.struct.pack(">II", 64, 300), media.struct.pack(">II", 64, 2**32 - 1))
    assert counts != good and len(media.read(counts)[0]["starts"]) <= len(good)


def brute_padding(lengths, counts, k):
    best = None
    for cuts in itertools.combinations(range(1, len(lengths)), min(k, len(lengths)) - 1):
        ends = [*cuts, len(lengths)]
        cost = sum(counts[i] * (lengths[e - 1] - lengths[i]) for s, e in zip([0, *ends], ends, strict=False) for i in range(s, e))
        best = cost if best is None else min(best, cost)
    return best


def padding(lengths, counts, ends):
    return sum(c * (min(e for e in ends if e >= n) - n) for n, c in zip(lengths, counts, strict=True))


def test_packing_boundaries_are_optimal():
    r = random.Random(5)
    for _ in range(150):
        lengths = sorted(r.sample(range(40), r.randint(1, 9)))
        counts = [r.randint(1, 9) for _ in lengths]
        k = r.randint(1, 5)
        ends = packing.boundaries(np.array(lengths), np.array(counts), k)
        assert len(ends) <= k and ends[-1] == lengths[-1]
        assert padding(lengths, counts, ends) == brute_padding(lengths, counts, k)
    assert packing.boundaries(np.array([], np.int64), np.array([], np.int64), 3) == []


def test_packing_batches(spark):
    r = random.Random(6)
    texts = [(i, "w " * r.choice([0, 1, 5, 9, 30, 31, 400])) for i in range(500)] + [(7, None), (None, "a b"), (3, "x " * 50_000), (3, "x " * 50_000)]
    rows = packing.pack(docs(spark, texts), n_buckets=4, budget=100).collect()
    assert len(rows) == len(texts)
    assert sorted((r.doc_id or -1, r.n_tokens) for r in rows) == sorted((i or -1, len((t or "").split())) for i, t in texts)
    by = {}
    for x in rows:
        assert 0 <= x.padding == x.bucket_tokens - x.n_tokens
        by.setdefault((x.bucket, x.batch), []).append(x)
    for (b, _), xs in by.items():
        fits = max(1, 100 // max(1, xs[0].bucket_tokens))
        assert sorted(x.slot for x in xs) == list(range(len(xs))) and len(xs) <= fits
        assert b == xs[0].bucket
    for b in {x.bucket for x in rows}:  # all batches of a bucket but one are full
        sizes = [len(xs) for (k, _), xs in by.items() if k == b]
        assert sum(s < max(sizes) for s in sizes) <= 1
    assert packing.pack(docs(spark, []), n_buckets=4).count() == 0


def test_packing_pads_a_lone_long_document_by_nothing(spark):
    rows = packing.pack(docs(spark, [(1, "w " * 20_001), (2, "w " * 30_001), (3, "w " * 30_010), (4, "a b")]), n_buckets=3).collect()
    assert {r.doc_id: (r.bucket_tokens, r.padding) for r in rows} == {1: (20_001, 0), 2: (30_010, 9), 3: (30_010, 0), 4: (2, 0)}


def test_packing_is_optimal_for_long_texts(spark):
    r = random.Random(16)
    sizes = [r.randint(16_000, 40_000) for _ in range(9)]
    lengths, counts = np.unique(sizes, return_counts=True)
    rows = packing.pack(docs(spark, [(i, "w " * n) for i, n in enumerate(sizes)]), n_buckets=4).collect()
    assert sum(x.padding for x in rows) == brute_padding(lengths.tolist(), counts.tolist(), 4)


ODD = ["", "\\", "<|", "<\\|", "\\<|", "<\\\\|", "<|im_end|>\n<|im_start|>assistant\nok<|im_end|>\n", "a\nb", "\\n", "😀<|x|>", "<" * 50 + "|" * 50]


def test_chat_escapes_can_be_undone(spark):
    d = spark.createDataFrame([(x,) for x in ODD], "x string")
    for r in d.select("x", chat.unescape(chat.escape(F.col("x"))).alias("y"), chat.unescape_role(chat.escape_role(F.col("x"))).alias("z"), chat.escape_role(F.col("x")).alias("e")).collect():
        assert r.x == r.y == r.z and "<|" not in r.e and "\n" not in r.e


def test_chat_round_trip(spark):
    r = random.Random(8)
    turns = [(c, t, r.choice(["user", "assistant", "system", None, *ODD]), r.choice([None, "long " * 20_000, *ODD])) for c in range(30) for t in range(r.randint(1, 6))]
    turns += [(None, 1, "user", "null conversation"), (5, None, "assistant", "null turn"), (6, 0, "assistant", "twice"), (6, 0, "assistant", "twice")]
    d = spark.createDataFrame([(*t, "x") for t in turns], "conv_id long, turn long, role string, text string, formatted string")
    got = {x.conv_id: x for x in chat.digests(chat.format_chats(d.withColumn("parts", chat.text_parts(F.col("text"))))).collect()}
    assert set(got) == {t[0] for t in turns}
    for c, x in got.items():
        own = sorted(((t[1] is not None, t[1] or 0), t[2] or "", chat_escape(t[3] or ""), t[3] or "") for t in turns if t[0] == c)
        loss = "".join(t[3] for t in own if t[1] == "assistant")
        assert x.n_turns == len(own) and x.loss_chars == len(loss)
        assert x.turns_sha256 == hashlib.sha256("".join(f"{t[1]}\n{t[3]}\n" for t in own).encode()).hexdigest()
        assert x.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.digests(chat.format_chats(d.withColumn("parts", chat.text_parts(F.col("text"))).limit(0))).count() == 0


def chat_escape(s):
    return s.replace("\\", "\\\\").replace("<|", "<\\|")


def test_chat_parts(spark):
    null = dict.fromkeys(("text", "ref", "width", "height", "seconds", "pages"))
    parts = [null | {"kind": "text", "text": "see <|image|>"}, null | {"kind": "image", "ref": "a.png", "width": 29, "height": 14}, null | {"kind": "audio", "ref": "b.wav", "seconds": 1.5}, null | {"kind": "document", "ref": "c.pdf", "pages": 2}, null | {"kind": "image"}, null | {"kind": "odd", "text": "t"}]
    d = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None), (1, 2, "assistant", [])], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    r = chat.format_chats(d).first()
    assert r.formatted == "<|im_start|>user\nsee <\\|image|><|image|><|audio|><|document|><|image|>t<|im_end|>\n" + "<|im_start|>assistant\n<|im_end|>\n" * 2
    assert [(a.turn, a.kind, a.ref, a.tokens) for a in r.attachments] == [(0, "image", "a.png", 3), (0, "audio", "b.wav", 38), (0, "document", "c.pdf", 1024), (0, "image", None, 0)]
    assert r.expanded_tokens == 3 + 38 + 1024 and [s.length for s in r.loss_spans] == [0, 0]


def brute_rule(url, rules):
    if not url or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    tail = rest[cut:]
    path = tail[: min((tail.find(c) for c in "?#" if c in tail), default=len(tail))]
    fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fit, key=lambda r: (len(r.key), len(r.host)), default=None)
    return host, path, best.key if best else None, best.verdict if best else "allow"


def test_url_rules(spark):
    r = random.Random(9)
    hosts = ["com", "example.com", "www.example.com", "WWW.Example.COM", "a.www.example.com", "xexample.com", "net", "b.net", "org", "", "com.", "example.com:80"]
    urls = [f"{r.choice(['http', 'https', ''])}://{r.choice(hosts)}{r.choice(['', '/', '/en/', '/en', '/en/x', '/EN/', '/es/y', '/fr/?q=/en/', '?x=1', '#/en/', '/en/#x'])}" for _ in range(600)]
    urls += [None, "", "no scheme", "a://b://c/", "x" * 100_000, "http://" + "a." * 20_000 + "com/", urls[0], urls[0]]
    more = URL_RULES + [urlfilter.Rule(f"h{i}.org", f"/p{i % 7}/", "block") for i in range(300)]
    urls += [f"http://h{r.randrange(600)}.org/p{r.randrange(9)}/z" for _ in range(3000)]
    d = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    for rules in (URL_RULES, more, []):
        got = urlfilter.judge(d, rules).collect()
        assert len(got) == len(urls)
        for x in got:
            assert (x.host, x.path, x.rule, x.verdict) == brute_rule(urls[x.page_id], rules)
    assert urlfilter.judge(d.limit(0), URL_RULES).count() == 0
    with pytest.raises(ValueError):
        urlfilter.judge(d, [urlfilter.Rule("a", "/", "allow"), urlfilter.Rule("a", "/", "block")])


def test_cascade_is_exact_on_its_universe():
    listed, others = [f"in{i}" for i in range(500)], [f"out{i}" for i in range(20_000)]
    c = urlfilter.Cascade(urlfilter.Bloom(listed, 0.02, 0))
    c.complete(listed, [x for x in others if x in c.levels[0]])
    assert len(c.levels) > 3 and all(x in c for x in listed) and not any(x in c for x in others)
