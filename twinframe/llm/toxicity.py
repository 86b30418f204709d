"""Toxicity from class-conditional Kneser-Ney models of letter sequences inside words.

Two models, of toxic and of ordinary texts, give each word's letters (with a mark at either end) a probability. Both hold their
own counts of the longest contexts only and back off to one shared model, whose lower orders are Kneser-Ney continuation counts
over all documents, labelled or not; a rare expression so costs both models alike unless one class has seen it. A text's
features are the difference of its two log-likelihoods a letter (length-normalised), over the whole text and over its most toxic
window of WINDOW words; a logistic curve fitted on labelled rows that the models' class counts leave out makes them a score.

The model grows with the corpus: n-grams are 64-bit hashes, counted, summed and smoothed order by order in tables of Spark,
none is dropped or merged, and nothing depends on how the files are split. Scoring needs one number for each n-gram that ends a
longest context: log p_toxic - log p_ordinary. Of these the GAINS most frequent are broadcast (all of them, if they are fewer);
a text that has others gets their numbers by a join.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain, compress
from operator import ne

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ROWS_AT_ONCE, release, small_batches, stage

#: Letters of the longest n-gram.
ORDERS = 5

#: Words of the window; different words counted before they are turned into n-grams, and words remembered when scoring.
WINDOW, COUNTED_WORDS, MEMO_WORDS = 4, 200_000, 200_000

#: Words turned into n-grams at a time, which bounds temporary arrays (about 40 MB).
GRAM_WORDS = 20_000

#: n-grams whose numbers are broadcast at most (12 bytes each: 48 MB).
GAINS = 4_000_000

#: At most so many labelled rows fit the logistic curve (the bounded sample; the n-gram counts take all rows).
CALIBRATION_ROWS = 20_000

#: Labelled rows beyond this many are joined by shuffling instead of being broadcast (20 MB or so at the bound).
BROADCAST_LABELS = 1_000_000

#: A text is predicted toxic from this score on.
THRESHOLD = 0.3

LETTERS = re.compile(r"[^\W_]+")
#: All bytes of Latin-1, spaces for those that LETTERS leaves out.
LATIN = bytes(k if LETTERS.fullmatch(chr(k)) else 0x20 for k in range(256))
TOXIC, ORDINARY, OTHER = 1, 0, 2


def all_words(text: str | None) -> list[str]:
    """Lower-cased runs of letters and digits; texts of Latin-1 only are cut without the pattern, which is faster."""
    lower = (text or "").lower()
    try:
        return lower.encode("latin-1").translate(LATIN).decode("latin-1").split()
    except UnicodeEncodeError:
        return LETTERS.findall(lower)


def words_of(text: str | None) -> list[str]:
    """All words; of a word repeated in a row, one, so that junk doesn't pile up evidence."""
    words = all_words(text)
    return list(compress(words, map(ne, words, ["", *words])))


def grams(words: list[str]):
    """For each order: hashes of the n-grams that end at each letter or end mark, of their contexts and of their suffixes.

    Returns each symbol's word, and for each order (n, places, hash, context, suffix, top), places being positions among the
    joined words' symbols; top n-grams end a longest context: those of the last order and those that begin with their word's
    start mark. An n-gram never reaches beyond that mark.
    """
    codes = np.frombuffer((f"\x02{'\x03\x02'.join(words)}\x03" if words else "").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    starts = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(words)), sizes)
    depth = np.arange(len(codes)) - starts[owner]
    out, before, acc = [], np.zeros(len(codes), np.uint64), np.zeros(len(codes), np.uint64)
    for n in range(1, ORDERS + 1):
        shifted = np.zeros(len(codes), np.uint64)
        shifted[n - 1 :] = codes[: max(0, len(codes) - n + 1)]
        # each symbol is mixed by itself before it is weighted by its place, so that sums of n-grams don't meet
        shifted = (shifted + np.uint64(n << 32)) * np.uint64(0xFF51AFD7ED558CCD)
        shifted = (shifted ^ (shifted >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        acc = acc + (shifted ^ (shifted >> np.uint64(29)))
        h = (acc ^ (acc >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        h = h ^ (h >> np.uint64(32))
        at = np.flatnonzero(depth >= max(1, n - 1))
        nothing = np.zeros(len(at), np.uint64)
        out.append((n, at, h[at], before[at - 1] if n > 1 else nothing, before[at] if n > 1 else nothing, (depth[at] == n - 1) | (n == ORDERS)))
        before = h
    return owner, out


GRAMS = "n int, gram long, context long, suffix long, top boolean, toxic long, ordinary long, total long"


def counted(words: list[Counter]) -> Iterator[pa.RecordBatch]:
    """n-grams of counted words (toxic, ordinary, other): a row for each different one."""
    weights = Counter()
    for c in words:
        weights.update(c)
    every = list(weights)
    for a in range(0, len(every), GRAM_WORDS):
        part = every[a : a + GRAM_WORDS]
        n_of = [np.fromiter((c.get(w, 0) for w in part), np.int64, len(part)) for c in (words[0], words[1], weights)]
        owner, orders = grams(part)
        for n, at, h, context, suffix, top in orders:
            order = np.argsort(h)
            each = h[order]
            start = np.flatnonzero(np.append(True, each[1:] != each[:-1])[: len(each)])
            gram, first, of = each[start], order[start], owner[at[order]]
            sums = [np.add.reduceat(k[of], start) if len(start) else k[:0] for k in n_of]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(gram), n, np.int32)), *(pa.array(x.view(np.int64)) for x in (gram, context[first], suffix[first])), pa.array(top[first]), *map(pa.array, sums)], names=["n", "gram", "context", "suffix", "top", "toxic", "ordinary", "total"])


def count(df: DataFrame) -> DataFrame:
    """n-grams of (text, kind) rows with their counts, one row for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = [Counter(), Counter(), Counter()]
        place = {TOXIC: 0, ORDINARY: 1, OTHER: 2}
        for b in batches:
            for start in range(0, b.num_rows, ROWS_AT_ONCE):
                part = b.slice(start, ROWS_AT_ONCE)
                for text, kind in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    words[place[kind]].update(words_of(text))
                    if sum(map(len, words)) > COUNTED_WORDS:
                        yield from counted(words)
                        for c in words:
                            c.clear()
        yield from counted(words)
        del words
        release()

    rows = df.select("text", "kind").mapInArrow(run, GRAMS)
    return stage(rows.groupBy("n", "gram").agg(F.min("context").alias("context"), F.min("suffix").alias("suffix"), F.max("top").alias("top"), *(F.sum(c).alias(c) for c in ("toxic", "ordinary", "total"))))


def discount(once: int, twice: int) -> float:
    """Kneser and Ney's estimate from the numbers of n-grams seen once and twice."""
    return min(0.9, max(0.1, once / max(once + 2 * twice, 1))) if once else 0.5


def gains(counts: DataFrame) -> DataFrame | None:
    """(gram, gain, total) of the top n-grams: gain is log p_toxic - log p_ordinary of the last letter after its longest context. None without both classes.

    Order by order: how many different letters precede an n-gram (its number, for the last order) are the shared model's counts;
    p = (max(count - discount, 0) + discount x different continuations x p of the suffix) / count of the context, and p of the
    suffix alone for contexts that the model lacks.
    """
    classes = counts.filter("n = 1").agg(F.sum("toxic"), F.sum("ordinary"), F.count("*")).first()
    if not classes[0] or not classes[1]:
        return None
    out, below = [], None
    for n in range(1, ORDERS + 1):
        own = counts.filter(F.col("n") == n)
        if n < ORDERS:
            seen = counts.filter(F.col("n") == n + 1).groupBy(F.col("suffix").alias("gram")).agg(F.count("*").alias("seen"))
            own = own.join(seen, "gram", "left").withColumn("seen", F.coalesce("seen", F.lit(0)))
        else:
            own = own.withColumn("seen", F.col("total"))
        names = ("seen", "toxic", "ordinary")
        few = own.agg(*(F.count_if(F.col(c) == k) for c in names for k in (1, 2))).first()
        d = {c: discount(few[2 * k], few[2 * k + 1]) for k, c in enumerate(names)}
        around = own.groupBy("context").agg(*(f.alias(f"{c}_{name}") for c in names for f, name in ((F.sum(c), "sum"), (F.count_if(F.col(c) > 0), "kinds"))))
        own = own.join(around, "context")
        if below is None:
            own = own.withColumn("lower", F.lit(1.0 / (1 + classes[2])))
        else:
            own = own.join(below.select(F.col("gram").alias("suffix"), F.col("shared").alias("lower")), "suffix")
        p = {c: F.when(F.col(f"{c}_sum") > 0, (F.greatest(F.col(c) - d[c], F.lit(0.0)) + d[c] * F.col(f"{c}_kinds") * F.col("lower")) / F.col(f"{c}_sum")).otherwise(F.col("lower")) for c in names}
        below = stage(own.select("gram", "top", "total", F.greatest(p["seen"], F.lit(1e-12)).alias("shared"), (F.log(p["toxic"]) - F.log(p["ordinary"])).alias("gain")))
        out.append(below.filter("top").select("gram", "gain", "total"))
    rows = out[0]
    for more in out[1:]:
        rows = rows.union(more)
    return rows


class Model:
    """Numbers of the n-grams by hash, complete or the most frequent ones, and the curve that makes features scores."""

    def __init__(self, gram: np.ndarray, gain: np.ndarray):
        order = np.argsort(gram)
        self.gram, self.gain = gram[order], gain[order].astype(np.float32)
        self.forget()

    def forget(self) -> None:
        """Empties the memo: words' places in the arrays of their differences and lengths."""
        self.memo: dict[str, int] = {}
        self.difference, self.length = np.zeros(0), np.zeros(0)

    def __getstate__(self):
        return self.__dict__ | {"memo": {}, "difference": np.zeros(0), "length": np.zeros(0)}

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of n-grams (0 for those that it lacks) and whether it has them."""
        if not len(self.gram):
            return np.zeros(len(h)), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(self.gram, h), len(self.gram) - 1)
        known = self.gram[at] == h
        return np.where(known, self.gain[at], 0.0).astype(np.float64), known

    def differences(self, words: list[str], lacking: list[np.ndarray] | None = None) -> np.ndarray:
        """log p_toxic - log p_ordinary of each word; n-grams that the model lacks add nothing and go to lacking."""
        owner, orders = grams(words)
        total = np.zeros(len(words))
        for _, at, h, _, _, top in orders:
            value, known = self.find(h[top].view(np.int64))
            total += np.bincount(owner[at[top]], value, len(words))
            if lacking is not None and not known.all():
                lacking.append(np.unique(h[top].view(np.int64)[~known]))
        return total

    def features(self, texts: list[str | None], more: list | None = None) -> np.ndarray:
        """A row of two numbers for each text. Words that the memo lacks are scored together, so texts should come many at a time.

        more: for each text None, or rows (gram, gain) of the n-grams that the model lacks.
        """
        out = np.zeros((len(texts), 2))
        found = [all_words(t) for t in texts]
        if len(self.memo) > MEMO_WORDS:
            self.forget()
        every = list(chain.from_iterable(found))
        missing = list(set(every).difference(self.memo))
        for a in range(0, len(missing), GRAM_WORDS):
            part = missing[a : a + GRAM_WORDS]
            self.memo.update(zip(part, range(len(self.memo), len(self.memo) + len(part)), strict=True))
            self.difference = np.append(self.difference, self.differences(part))
            self.length = np.append(self.length, np.fromiter(map(len, part), np.float64, len(part)) + 1)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        word, owner = np.fromiter(map(self.memo.__getitem__, every), np.int64, len(every)), np.repeat(np.arange(len(found)), sizes)
        d = self.difference[word]
        for i, words in enumerate(found if more is not None else ()):
            if words and more[i]:
                rest, own = Model(*(np.array([x[k] for x in more[i]], t) for k, t in (("gram", np.int64), ("gain", np.float64)))), sorted(set(words))
                added = dict(zip(own, rest.differences(own).tolist(), strict=True))
                end = int(sizes[: i + 1].sum())
                d[end - len(words) : end] += np.fromiter(map(added.__getitem__, words), np.float64, len(words))
        once = np.append(True, (word[1:] != word[:-1]) | (owner[1:] != owner[:-1]))[: len(word)]  # as words_of(): a word in a row counts once
        d, letters, owner = d[once], self.length[word[once]], owner[once]
        sizes = np.bincount(owner, minlength=len(found))
        some = np.flatnonzero(sizes)
        if not len(some):
            return out
        starts = (np.cumsum(sizes) - sizes)[some]
        out[some] = (np.add.reduceat(d, starts) / np.add.reduceat(letters, starts))[:, None]
        n = len(d) - WINDOW + 1
        if n > 0:  # sums of each window by itself, which no other text changes
            whole = owner[:n] == owner[WINDOW - 1 :]
            ratio = sum(d[k : k + n] for k in range(WINDOW)) / sum(letters[k : k + n] for k in range(WINDOW))
            most = np.maximum.reduceat(np.append(np.where(whole, ratio, -np.inf), np.full(WINDOW - 1, -np.inf)), starts)
            long = sizes[some] > WINDOW
            out[some[long], 1] = most[long]
        return out


def curve_of(features: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Weights of a logistic regression on the two features, by Newton steps with a little ridge; fixed ones unless both classes occur."""
    y = labels.astype(float)
    if not 0 < y.sum() < len(y):
        return np.array([-2.0, 4.0, 2.0])
    x = np.hstack([np.ones((len(y), 1)), features])
    w, ridge = np.zeros(3), np.diag([1e-3, 1e-2, 1e-2])
    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve(x.T @ (x * (q * (1 - q))[:, None]) + ridge, x.T @ (y - q) - ridge @ w)
        w = w + np.clip(step, -20, 20)
    return w


def fold(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary"))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels are never learnt from."""
    return F.coalesce(fold(id_col) % 4 == 2, F.lit(False))


class Fitted:
    """The numbers of all n-grams, the broadcast ones, and the curve; score() adds its columns to tables."""

    def __init__(self, rows: DataFrame | None):
        self.weights, self.rest, self.model = None, None, None
        if rows is None:
            return
        held = rows
        if rows.count() > GAINS:
            least = rows.orderBy(F.desc("total"), "gram").limit(GAINS)
            held, self.rest = least, rows.join(least.select("gram"), "gram", "left_anti").select("gram", "gain")
        held = held.select("gram", "gain").toArrow()
        self.model = rows.sparkSession.sparkContext.broadcast(Model(*(held.column(k).to_numpy() for k in range(2))))

    def features(self, df: DataFrame, text_col: str, name: str) -> DataFrame:
        """df with a column of two numbers."""
        shared, pairs = self.model, "array<struct<gram:long,gain:double>>"

        @F.arrow_udf("array<double>")
        def numbers(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
            m = shared.value
            for texts, more in batches:
                parts = [m.features(texts.slice(a, ROWS_AT_ONCE).to_pylist(), more.slice(a, ROWS_AT_ONCE).to_pylist()) for a in range(0, len(texts), ROWS_AT_ONCE)]
                flat = np.concatenate([np.zeros((0, 2)), *parts])
                yield pa.ListArray.from_arrays(pa.array(np.arange(0, 2 * len(flat) + 1, 2, dtype=np.int32)), pa.array(flat.ravel()))
            m.forget()
            release()

        if self.rest is None:
            return df.withColumn(name, numbers(F.col(text_col), F.lit(None).cast(pairs)))

        def lacking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = shared.value
            for b in batches:
                for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    found: list[np.ndarray] = []
                    m.differences(sorted(set(words_of(text))), found)
                    if found:
                        gram = np.concatenate(found)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(gram), key)), pa.array(gram)], names=["key", "gram"])
            release()

        wanted = df.select(F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text")).mapInArrow(lacking, "key long, gram long").distinct()
        more = wanted.join(self.rest, "gram").groupBy("key").agg(F.collect_list(F.struct("gram", "gain")).alias("more"))  # bounded by the text's own n-grams
        row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")
        met = df.select(row, F.xxhash64(text_col).alias("key")).join(stage(more), "key", "left")
        return met.select("row.*", numbers(F.col(f"row.`{text_col}`"), F.col("more").cast(pairs)).alias(name))

    def score(self, df: DataFrame, text_col: str, name: str) -> DataFrame:
        """df with a column of scores, 0 to 1."""
        if self.model is None:
            return df.withColumn(name, F.lit(0.0))
        w = [float(x) for x in self.weights]
        z = F.lit(w[0]) + F.col(name)[0] * w[1] + F.col(name)[1] * w[2]
        return self.features(df, text_col, name).withColumn(name, F.lit(1.0) / (1 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), z)))))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Fitted:
    """Counts all documents and fits the curve; labels are used of rows that aren't held out, of which up to CALIBRATION_ROWS (one in eight, least hashes first) only for the curve.

    A document with several labels is toxic if one of them is 1; null labels, ids and texts count as absent. The driver sees three
    numbers of each row of the curve's sample, and no texts.
    """
    marks = labels.filter(~held_out(id_col) & F.col("toxic").isin(0, 1)).groupBy(id_col).agg(F.max("toxic").alias("toxic"))
    if labels.count() <= BROADCAST_LABELS:
        marks = F.broadcast(marks)
    joined = docs.select(id_col, F.col(text_col).alias("text")).join(marks, id_col, "left")
    h = F.xxhash64(id_col)
    curve = F.coalesce(F.floor(fold(id_col) / 4) % 8 == 3, F.lit(False)) & F.col("toxic").isNotNull()
    sample = joined.filter(curve).select(h.alias("h")).orderBy("h").limit(CALIBRATION_ROWS).toArrow()
    if len(sample) == CALIBRATION_ROWS:  # rows beyond the sample are learnt from
        curve = curve & (h <= max(sample["h"].to_pylist()))
    kind = F.when(F.col("toxic").isNull() | curve, OTHER).otherwise(F.col("toxic")).cast("int")
    with small_batches(docs.sparkSession):
        fitted = Fitted(gains(count(joined.select("text", kind.alias("kind")))))
        if fitted.model is not None:
            rows = fitted.features(joined.filter(curve).select(h.alias("h"), "toxic", "text"), "text", "f").select("h", "toxic", F.col("f")[0].alias("a"), F.col("f")[1].alias("b")).toArrow()
            x = np.array([rows[c].to_numpy() for c in ("h", "a", "b", "toxic")], float).T
            x = x[np.lexsort(x.T)]  # sums that don't depend on the order of rows
            fitted.weights = curve_of(x[:, 1:3], x[:, 3])
    return fitted


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's id, held_out boolean, score double in 0..1, predicted int.

    Null and empty texts get the score of a text without evidence; without labels of both classes every score is 0; repeated
    rows give repeated results; only the id and text columns are read, and of labels the id and toxic.
    """
    fitted = fit(docs, labels, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    scored = fitted.score(rows, "text", "score").select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "score")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that aren't predicted toxic, with all their columns, whatever their names."""
    fitted = fit(docs, labels, id_col, text_col)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"), F.col(f"`{text_col}`").alias("text"))
    return fitted.score(rows, "text", "score").filter(F.col("score") < THRESHOLD).select("whole.*")
