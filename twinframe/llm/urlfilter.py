"""URL rules through Bloom filter cascades, exact for every key of the corpus and without a join.

A rule is a host, a path prefix and a verdict. A URL's candidate keys are its host suffixes times its path prefixes of the
lengths that rules have. For each verdict a cascade of Bloom filters encodes the listed keys against the corpus's complete key
universe: level 0 holds the listed keys, level 1 the corpus keys that level 0 takes falsely, level 2 the listed keys that
level 1 takes falsely, and so on until nothing is taken falsely. A key of the universe is listed if the first level that
rejects it has an odd number, or, if none does, if the number of levels is odd.

Level 0's error rate is (number of listed keys) / (sqrt(2) x number of corpus keys), the rest's 1/2, so that the expected false
positives, which the driver gathers to build the further levels, are fewer than the listed keys however large the corpus is.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

#: The smallest error rate of level 0, and the most levels tried (each halves what is left).
LEAST_RATE, MOST_LEVELS = 2.0**-30, 64


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def key(self) -> str:
        return self.host + self.path


def host_path(url: str | None) -> tuple[str, str]:
    """Host (after the first "://", A-Z lower-cased) and path (up to "?", "#" or the end) of a URL; both empty without "://"."""
    if not url or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    for mark in "?#":
        rest = rest.partition(mark)[0]
    host, slash, path = rest.partition("/")
    return host.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"), slash + path


class Bloom:
    def __init__(self, keys: list[str], rate: float, seed: int):
        self.seed, self.k = seed, max(1, round(-math.log2(rate)))
        self.m = max(64, math.ceil(len(keys) * -math.log(rate) / math.log(2) ** 2))
        self.bits = np.zeros(self.m, np.bool_)
        for x in keys:
            self.bits[self.places(x)] = True
        self.bits = np.packbits(self.bits)

    def places(self, key: str) -> list[int]:
        h = xxhash.xxh3_128_intdigest(key.encode("utf-8", "surrogatepass"), self.seed)
        a, b = h >> 64, (h & (2**64 - 1)) | 1
        return [(a + i * b) % self.m for i in range(self.k)]

    def __contains__(self, key: str) -> bool:
        bits = self.bits
        return all(bits[p >> 3] >> (7 - (p & 7)) & 1 for p in self.places(key))


class Cascade:
    """Exact membership of the universe's keys; others get an answer too, which may be wrong at level 0's error rate."""

    def __init__(self, first: Bloom):
        self.levels = [first]

    def complete(self, listed: list[str], false_positives: list[str]) -> None:
        inside, outside = listed, false_positives
        while outside:
            if len(self.levels) >= MOST_LEVELS:
                raise RuntimeError("the cascade does not end: a key is both listed and not")
            level = Bloom(outside, 0.5, len(self.levels))
            self.levels.append(level)
            inside, outside = outside, [x for x in inside if x in level]

    def __contains__(self, key: str) -> bool:
        for i, level in enumerate(self.levels):
            if key not in level:
                return i % 2 == 1
        return len(self.levels) % 2 == 1


class Keys:
    """Candidate keys of URLs under a list of rules, longest first (ties: the longer host)."""

    def __init__(self, rules: list[Rule]):
        self.labels = sorted({r.host.count(".") + 1 for r in rules})
        self.lengths = sorted({len(r.path) for r in rules})

    def __call__(self, host: str, path: str) -> list[str]:
        labels = host.split(".")
        found = [(s, path[:n]) for k in self.labels if k <= len(labels) for s in [".".join(labels[len(labels) - k :])] for n in self.lengths if n <= len(path)]
        return [s + p for s, p in sorted(found, key=lambda x: (-len(x[0]) - len(x[1]), -len(x[0])))]


def build(df: DataFrame, rules: list[Rule], url_col: str = "url") -> dict[str, Cascade]:
    """A cascade for each verdict over all keys of df's URLs."""
    keys = Keys(rules)
    urls = df.select(url_col).distinct()
    total = map_rows(urls, lambda: lambda part: [(k,) for (u,) in part for k in keys(*host_path(u))], "key string").agg(F.approx_count_distinct("key")).first()[0]
    listed = {v: sorted({r.key for r in rules if r.verdict == v}) for v in sorted({r.verdict for r in rules})}
    out = {v: Cascade(Bloom(ks, min(0.5, max(LEAST_RATE, len(ks) / (math.sqrt(2) * max(total, 1)))), 0)) for v, ks in listed.items()}

    def make():
        sets = {v: set(ks) for v, ks in listed.items()}

        def rows(part):
            found = {(v, k) for (u,) in part for k in keys(*host_path(u)) for v, c in out.items() if k not in sets[v] and k in c.levels[0]}
            return sorted(found)

        return rows

    wrong: dict[str, list[str]] = {v: [] for v in out}
    for r in map_rows(urls, make, "verdict string, key string").distinct().collect():  # fewer than the listed keys are expected
        wrong[r["verdict"]].append(r["key"])
    for v, c in out.items():
        c.complete(listed[v], sorted(wrong[v]))
    return out


def judge(df: DataFrame, rules: list[Rule], default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Every row's host, path, the longest rule that fits (null if none) and its verdict (the default if none).

    A null URL, or one without "://", has empty host and path and so no rule; repeated rows give repeated results; without
    rules all rows get the default; other columns are not read. A key under two verdicts raises ValueError.
    """
    if len({r.key for r in rules}) < len(set(rules)):
        raise ValueError("a rule stands under two verdicts")
    cascades = build(df, rules, url_col) if rules else {}
    keys = Keys(rules)

    def make():
        def rows(part):
            out = []
            for i, u in part:
                host, path = host_path(u)
                rule, verdict = next(((k, v) for k in keys(host, path) for v, c in cascades.items() if k in c), (None, default))
                out.append((i, host, path, rule, verdict))
            return out

        return rows

    kind = df.schema[id_col].dataType.simpleString()
    return map_rows(df.select(id_col, url_col), make, f"`{id_col}` {kind}, host string, path string, rule string, verdict string")
