"""Near-duplicates by SimHash with tiled exact comparison.

Distinct fingerprints are sorted by their population count and the counts of their halves and quarters and cut into tiles of
at most TILE. Two fingerprints that differ in r bits have counts that differ by at most r, and the differences of the counts
of their quarters add up to at most r; tile pairs whose ranges of counts lie further apart are skipped, all others are compared
exactly with numpy exclusive-or and bit counts. A tile pair yields the links of a spanning forest of what it finds, not all
pairs, so that large groups of near copies stay linear; copies with equal fingerprints are grouped before.

Only descriptions of tiles meet at first: neighbouring tiles make blocks, blocks meet by an equi-join on the population count, and
those whose ranges lie too far apart go. A tile's fingerprints are then sent once to each pair of blocks that is left, so what
is copied is the fingerprints times the blocks that a block meets: with b blocks at most 16 bytes x fingerprints x b. Blocks grow with
the corpus, to MOST_TILES tiles; beyond that copies grow with the square of the input, as the comparison itself does.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.groups import ranked
from .common import components, cut, release, small, stage

SHINGLE, RADIUS, SEED = 4, 4, 42

#: Fingerprints of a tile, blocks that are aimed at, tiles of a block at most (16 KB each), and pairs of blocks for each task.
TILE, BLOCKS, MOST_TILES, TASK_PAIRS = 1024, 128, 128, 4

#: Partitions of the comparison at most.
MOST_PARTS = 20_000


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text's word shingles; 0 without words.

    Words are runs of anything but ASCII white space, with A-Z lower-cased; repeated shingles count each time; a text of fewer
    words is one shingle.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return int(xxhash.xxh64_intdigest(joined, SEED) if words else 0)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = (np.append(0, ends[:-1] + 1))[: len(words) - shingle + 1].tolist()
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)])
    n = len(starts)
    ones = np.zeros(64, np.int64)
    rows = np.frombuffer(hashes, np.uint8).reshape(n, 8)
    for a in range(0, n, 16_384):
        ones += np.unpackbits(rows[a : a + 16_384], axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprint_column(text_col: str = "text", shingle: int = SHINGLE) -> Column:
    """The fingerprint of a text column as a signed long."""

    @F.arrow_udf("long")
    def f(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(np.array([fingerprint(t.as_py(), shingle) for t in texts], np.uint64).view(np.int64))

    return f(F.col(text_col))


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def quarter(fp: Column, k: int) -> Column:
    return F.bit_count(F.shiftrightunsigned(fp, 16 * k).bitwiseAND(F.lit(0xFFFF)))


def tiles(fps: DataFrame) -> DataFrame:
    """Tiles of distinct fingerprints (fp, id) as rows: pop, first, lo and hi (arrays of the quarters' counts), fps and ids (packed)."""
    keyed = fps.withColumn("pop", F.bit_count("fp")).withColumns({f"q{k}": quarter(F.col("fp"), k) for k in range(4)}).withColumn("half", F.col("q0") + F.col("q1"))
    order = ["pop", "half", "q0", "q2", "fp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, pop = [], None

        def tile(rows):
            rows = np.concatenate(rows)
            q = rows[:, 3:]
            return pa.RecordBatch.from_arrays([pa.array([int(rows[0, 2])]), pa.array([int(rows[0, 0])]), pa.array([q.min(0).tolist()]), pa.array([q.max(0).tolist()]), pa.array([rows[:, 0].tobytes()]), pa.array([rows[:, 1].tobytes()])], names=["pop", "first", "lo", "hi", "fps", "ids"])

        for b in batches:
            rows = np.stack([c.to_numpy().astype(np.int64) for c in b.columns], 1)
            cuts = [0, *(np.flatnonzero(np.diff(rows[:, 2])) + 1).tolist(), len(rows)]
            for x, y in pairwise(cuts):
                if held and (rows[x, 2] != pop):
                    yield tile(held)
                    held = []
                pop = rows[x, 2]
                while x < y:
                    room = TILE - sum(map(len, held))
                    held.append(rows[x : min(y, x + room)])
                    x += room
                    if sum(map(len, held)) >= TILE:
                        yield tile(held)
                        held = []
        if held:
            yield tile(held)

    spread = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    return spread.select("fp", "id", "pop", "q0", "q1", "q2", "q3").mapInArrow(run, "pop long, first long, lo array<long>, hi array<long>, fps binary, ids binary")


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Edges (node, smallest node of its component) of the graph on n nodes that the pairs (a, b) span."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    nodes = np.flatnonzero(label != np.arange(n))
    return np.stack([nodes, label[nodes]], 1)


def compare(x: np.ndarray, y: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs of two tiles that differ in at most radius bits."""
    x, y = x.view(np.uint64), y.view(np.uint64)  # bit counts of signed numbers are those of their absolute values
    a, b = [], []
    step = 256
    for s in range(0, len(x), step):
        near = np.bitwise_count(x[s : s + step, None] ^ y[None, :]) <= radius
        i, j = np.nonzero(near)
        a.append(i + s)
        b.append(j)
    return np.concatenate(a), np.concatenate(b)


def block_pairs(described: DataFrame, radius: int) -> DataFrame:
    """Pairs (a, b), a <= b, of blocks whose ranges of counts lie within the radius, from rows (block, pop, lo, hi) of tiles."""
    q = [f(F.col(c)[k]).alias(f"{c}{k}") for k in range(4) for f, c in ((F.min, "lo"), (F.max, "hi"))]
    blocks = described.groupBy("block").agg(F.min("pop").alias("least"), F.max("pop").alias("most"), *q)
    left = blocks.select(F.col("block").alias("a"), *(F.col(c).alias(f"a_{c}") for c in blocks.columns[1:]), F.explode(F.sequence("least", "most")).alias("pop"))
    right = blocks.select(F.col("block").alias("b"), *(F.col(c).alias(f"b_{c}") for c in blocks.columns[1:]), F.explode(F.sequence(F.col("least") - radius, F.col("most") + radius)).alias("pop"))
    gap = sum((F.greatest(F.lit(0), F.col(f"b_lo{k}") - F.col(f"a_hi{k}"), F.col(f"a_lo{k}") - F.col(f"b_hi{k}")) for k in range(4)), F.lit(0))
    return left.join(right, "pop").filter("a <= b").filter(gap <= radius).select("a", "b").distinct()


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) between the ids of distinct fingerprints (fp, id) that suffice to reach every one within the radius of another."""
    t = stage(tiles(fps))
    n = t.count()
    size = max(1, min(MOST_TILES, -(-n // BLOCKS)))
    place = ranked(t.select("first", "pop", "lo", "hi"), [F.col("pop"), F.col("lo")[0] + F.col("lo")[1], F.col("lo")[0], F.col("lo")[2], F.col("first")], "place")
    described = stage(place.withColumn("block", F.floor((F.col("place") - 1) / size).cast("long")).drop("place"))
    pairs = stage(block_pairs(described, radius))
    sides = pairs.select("a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("block"))
    parts = max(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_PARTS, pairs.count() // TASK_PAIRS))
    sent = sides.join(described.select("block", "first"), "block").join(t, "first").select("a", "b", "block", "pop", "lo", "hi", "fps", "ids")
    sent = sent.repartition(parts, "a", "b").sortWithinPartitions("a", "b", "block")

    def met(a: int, b: int, held: list[tuple]) -> np.ndarray | None:
        """Links inside a pair of blocks; held: their tiles."""
        found = []
        for x, (block, pop, lo, hi, xs, xi) in enumerate(held):
            for y in range(x, len(held)):
                other, pop2, lo2, hi2, ys, yi = held[y]
                if a != b and other == block or abs(pop - pop2) > radius or np.maximum(0, np.maximum(lo2 - hi, lo - hi2)).sum() > radius:
                    continue  # tiles of one block meet in that block's pair with itself
                i, j = compare(xs, ys, radius)
                ids, places = np.unique(np.concatenate([xi, yi]), return_inverse=True)
                i, j = places[i], places[len(xi) + j]
                if (keep := i != j).any():
                    found.append(ids[forest(i[keep], j[keep], len(ids))])
        return np.concatenate(found) if found else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, held = None, []

        def done():
            if pair is not None and (e := met(*pair, held)) is not None:
                yield pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], names=["a", "b"])

        for batch in batches:
            for a, b, block, pop, lo, hi, f, ids in zip(*(c for c in batch.columns), strict=True):
                if (now := (a.as_py(), b.as_py())) != pair:
                    yield from done()
                    pair, held = now, []
                held.append((block.as_py(), pop.as_py(), np.array(lo.as_py()), np.array(hi.as_py()), *(np.frombuffer(v.as_py(), np.int64) for v in (f, ids))))
        yield from done()
        release()

    return sent.mapInArrow(run, "a long, b long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """Every row's id, fingerprint (16 hex digits) and component_id, the smallest id that it reaches over links, itself included.

    Null and empty texts have the fingerprint zero and link like others; rows with equal ids are nodes of one name; a null id
    has its fingerprint's component; an empty table gives none; other columns are not read.
    """
    prints = stage(df.select(F.col(id_col).cast("long").alias("id"), fingerprint_column(text_col, shingle).alias("fp")))
    return with_components(prints, radius).select(F.col("id").alias(id_col), hexadecimal(F.col("fp")).alias("fingerprint"), F.coalesce(F.least("component_id", F.col("id")), F.col("component_id")).alias("component_id"))


def with_components(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(id, fp) with component_id."""
    distinct = stage(prints.groupBy("fp").agg(F.min("id").alias("id")))
    named = distinct.filter("id is not null")
    roots = components(links(named, radius))
    classes = distinct.join(roots, distinct["id"] == roots["node"], "left").select("fp", F.coalesce("root", "id").alias("component_id"))
    return prints.join(classes, "fp")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, that with the smallest id (of equal ids one), with all columns; rows with a null id are kept.

    The ids that go are few beside the texts, so these aren't shuffled unless the ids are too many to broadcast.
    """
    classes = stage(near_duplicates(df, id_col, text_col))
    gone = cut(classes.filter(F.col(id_col) != F.col("component_id")).select(id_col).distinct())
    repeated = cut(classes.filter(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count("*").alias("n")).filter("n > 1").select(id_col))
    kept = df.join(small(gone), id_col, "left_anti")
    if not repeated.count():
        return kept
    repeated = small(repeated)
    return kept.join(repeated, id_col, "left_anti").unionByName(kept.join(repeated, id_col, "left_semi").dropDuplicates([id_col]))
