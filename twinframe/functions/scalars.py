"""Column functions: rounding, curves, set and multiset similarity, names, sequences, digests and paths. All run in the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def round4(x: Column) -> Column:
    """Rounds to four places as Python's round() does: to even on the exact binary value.

    x * 10000 is split into a double and its exact error (Dekker's product), so that a product that only rounds to a tie isn't
    taken for one.
    """

    def rounded(v: Column) -> Column:
        product = v * 10000.0
        big = v * 134217729.0
        high = big - (big - v)
        error = (high * 10000.0 - product) + (v - high) * 10000.0
        near = F.rint(product)
        down = F.floor(product).cast("double")
        tie = F.abs(product - near) == 0.5
        return F.when(tie & (error != 0), F.when(error > 0, down + 1).otherwise(down)).otherwise(near) / 10000.0

    return let(x.cast("double"), rounded)


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def ramp(x: Column, low: float, high: float) -> Column:
    """0 at low, 1 at high, straight between; a step if they don't differ."""
    if high <= low:
        return F.when(x >= high, 1.0).otherwise(0.0)
    return clamp01((x - low) / (high - low))


def inverse_ramp(x: Column, low: float, high: float) -> Column:
    return 1.0 - ramp(x, low, high)


def ramp_count(x: Column, starts_at: int, high_at: int) -> Column:
    """A ramp of counts whose first meaningful count is above 0."""
    return F.when(x < starts_at, 0.0).otherwise(ramp(x.cast("double"), float(starts_at - 1), float(high_at)))


def combine(*scores: Column) -> Column:
    """The product of clamped scores."""
    out = F.lit(1.0)
    for s in scores:
        out = out * clamp01(s)
    return clamp01(out)


def noisy_or(*scores: Column) -> Column:
    """1 - the product of (1 - score)."""
    out = F.lit(1.0)
    for s in scores:
        out = out * (1.0 - clamp01(s))
    return clamp01(1.0 - out)


def jaccard(a: Column, b: Column) -> Column:
    """Set similarity of two arrays; 0 if either is empty. Not rounded."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) <= 0) | (F.size(b) <= 0), 0.0).otherwise(shared / F.size(F.array_union(a, b)))


def counts(a: Column) -> Column:
    """An array as a multiset: map of value to number."""
    return F.map_from_arrays(F.array_distinct(a), F.transform(F.array_distinct(a), lambda x: F.size(F.filter(a, lambda y: y == x)).cast("long")))


def multiset_jaccard(a: Column, b: Column) -> Column:
    """Sum of the smaller over sum of the larger counts of two maps; 0 if either is empty. Not rounded."""
    both = F.map_values(F.map_zip_with(a, b, lambda _, x, y: F.struct(F.coalesce(x, F.lit(0)).cast("long").alias("x"), F.coalesce(y, F.lit(0)).cast("long").alias("y"))))
    add = lambda pick: F.aggregate(both, F.lit(0).cast("long"), lambda s, c: s + pick(c["x"], c["y"]))
    return F.when((F.size(a) <= 0) | (F.size(b) <= 0), 0.0).otherwise(add(F.least) / add(F.greatest))


def mean_jaccard_by_key(a: Column, b: Column) -> Column:
    """The mean of jaccard() over the keys of two maps of arrays; keys without values on both sides are left out; 0 if none is left. Not rounded."""
    empty = F.array().cast("array<string>")
    both = F.map_values(F.map_zip_with(a, b, lambda _, x, y: F.struct(F.coalesce(x, empty).alias("x"), F.coalesce(y, empty).alias("y"))))
    used = F.filter(both, lambda c: (F.size(c["x"]) > 0) | (F.size(c["y"]) > 0))
    total = F.aggregate(used, F.lit(0.0), lambda s, c: s + jaccard(c["x"], c["y"]))
    return F.when(F.size(used) > 0, total / F.size(used)).otherwise(0.0)


def identifier_tokens(name: Column) -> Column:
    """Lower-cased words of an identifier, split at signs and at changes of case."""
    spaced = F.regexp_replace(F.regexp_replace(name, r"([A-Z]+)([A-Z][a-z])", "$1 $2"), r"([a-z0-9])([A-Z])", "$1 $2")
    return F.transform(F.regexp_extract_all(F.replace(spaced, F.lit("_"), F.lit(" ")), F.lit(r"([A-Za-z0-9]+)")), F.lower)


def normalized_identifier(name: Column) -> Column:
    return F.array_join(identifier_tokens(name), " ")


def is_public(name: Column) -> Column:
    return (F.coalesce(name, F.lit("")) != "") & ~F.startswith(F.coalesce(name, F.lit("")), F.lit("_"))


def edit_ratio(a: Column, b: Column) -> Column:
    """1 - edit distance over the longer length; 1 for equal strings, 0 if one is empty. Not rounded."""
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(1.0 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)))


def name_similarity(a: Column, b: Column, gate: float = 0.5) -> Column:
    """Similarity of normalised names: edit_ratio() where words overlap enough or one name begins or ends with the other, else their words' Jaccard. Not rounded."""
    longest = F.greatest(F.length(a), F.length(b))
    gap = F.abs(F.length(a) - F.length(b)) > longest * 0.5
    words = lambda c: F.array_distinct(F.filter(F.split(c, r"\s+"), lambda w: w != ""))
    overlap = jaccard(words(a), words(b))
    contains = F.startswith(a, b) | F.startswith(b, a) | F.endswith(a, b) | F.endswith(b, a)
    wordless = (F.size(words(a)) == 0) | (F.size(words(b)) == 0)
    return F.when(a == b, 1.0).when((a == "") | (b == "") | gap, 0.0).when(wordless, edit_ratio(a, b)).when(overlap == 0, 0.0).when((overlap < gate) & ~contains, overlap).otherwise(edit_ratio(a, b))


def common_prefix(a: Column, b: Column) -> Column:
    """Number of leading elements that two arrays share."""
    n = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, 1, F.greatest(n, F.lit(0))), F.slice(b, 1, F.greatest(n, F.lit(0))), lambda x, y: x.eqNullSafe(y))
    off = F.array_position(same, False)
    return F.when(n <= 0, 0).when(off == 0, n).otherwise(off - 1).cast("int")


def common_suffix(a: Column, b: Column) -> Column:
    return common_prefix(F.reverse(a), F.reverse(b))


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two short arrays: one row of the table is folded over a's elements."""
    zero = F.array_repeat(F.lit(0), F.size(b) + 1)

    def row(previous: Column, x: Column) -> Column:
        steps = F.sequence(F.lit(1), F.size(b))
        return F.aggregate(
            steps,
            F.array(F.lit(0)),
            lambda now, j: F.concat(now, F.array(F.when(F.element_at(b, j) == x, F.element_at(previous, j) + 1).otherwise(F.greatest(F.element_at(previous, j + 1), F.element_at(now, j))))),
        )

    return F.when((F.size(a) <= 0) | (F.size(b) <= 0), 0).otherwise(F.element_at(F.aggregate(a, zero, row), -1))


def content_digest(*parts: Column) -> Column:
    """SHA-256 of the parts joined by the unit separator, its first 16 hexadecimal digits."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 16)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def glob_regex(pattern: str) -> str:
    """A regular expression for a path glob: * within a segment, ** across segments, ? one sign, [..] a class."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if pattern.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "[" and (end := pattern.find("]", i + 2)) > 0:
            inner = pattern[i + 1 : end].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + inner[1:] if inner[0] == "!" else inner) + "]", end + 1
            continue
        out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)), i + 1
    return f"^{out}$"


def glob_any(path: Column, patterns: Sequence[str]) -> Column:
    """Whether a path matches one of the globs; a pattern without a slash is also tried on the last segment, "dir/**" takes what is below."""
    tests = F.lit(False)
    for p in patterns:
        tests = tests | path.rlike(glob_regex(p))
        if "/" not in p:
            tests = tests | basename(path).rlike(glob_regex(p))
    return tests
