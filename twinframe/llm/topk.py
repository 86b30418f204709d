"""Exact top-k search by inner product over norm-sorted vectors.

All vectors are rotated by the eigenvectors of their Gram matrix (the right singular vectors), so that the first coordinates
hold most of each inner product. A task takes one block of queries and one slice of the candidates in order of descending
length. A chunk of candidates is bounded first by length alone (|q| |c|; once that is under every query's k-th score, the rest
of the slice is skipped), then by partial sums over the leading rotated coordinates plus the Cauchy-Schwarz bound
|q_rest| |c_rest| of the others; only candidates that may still enter get their exact integer product.

Queries meet candidates in a grid of blocks: the candidates are copied once for each block of QUERY_BLOCK queries, the queries
once for each slice. Memory of a task is a block of queries, k results for each, and one chunk. A slice's best k of each query
are merged by a window over slices x k rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

QUERY_BLOCK, CHUNK, SLICES, SLICE_ROWS = 8192, 1024, 32, 512

#: The leading rotated coordinates hold at least this share of all squared components.
HEAD_SHARE = 0.75

#: Slack of float bounds, relative to the product of lengths.
SLACK = 1e-9


def quantised(df: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """vec_id, x array<long> = floor(scale * component); rows with a null vector or a null or non-finite component take no part."""
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v")).filter("vec_id is not null and v is not null")
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.filter(sound).select("vec_id", F.transform("v", lambda x: F.floor(float(scale) * x).cast("long")).alias("x"))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A list column as int64 rows of dim numbers; shorter vectors end in zeros."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if (sizes == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(sizes), dim), np.int64)
    at = 0
    for i, n in enumerate(sizes):
        out[i, :n] = flat[at : at + n]
        at += n
    return out


def gram(vectors: DataFrame, dim: int) -> np.ndarray:
    """The sum of x x' over all vectors: dim x dim numbers, summed on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = np.zeros((dim, dim))
        for b in batches:
            x = matrix(b.column(0), dim).astype(np.float64)
            g += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim * dim)), pa.array(g.ravel())], names=["cell", "value"])

    rows = vectors.select("x").mapInArrow(run, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(dim * dim)
    for r in rows:
        out[r["cell"]] = r["value"]
    return out.reshape(dim, dim)


class Block:
    """The queries of a block with the best k that they have met so far."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, rotation: np.ndarray, head: int, k: int):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x, self.rotation, self.head, self.k = ids[order], x[order], rotation, head, k
        y = self.x.astype(np.float64) @ rotation
        self.y, self.rest, self.norm = y[:, :head], np.linalg.norm(y[:, head:], axis=1), np.linalg.norm(y, axis=1)
        self.least = np.full(len(ids), -np.inf)  # k-th score so far
        self.found = np.empty((0, 3), np.int64)  # query's place, score, vec_id
        self.more: list[np.ndarray] = []
        #: Products of integers stay exact in doubles under this bound.
        self.most = np.abs(self.x).max(initial=0)

    def meet(self, ids: np.ndarray, x: np.ndarray) -> bool:
        """Takes a chunk of candidates in order of descending length; false if no later one can enter."""
        y = x.astype(np.float64) @ self.rotation
        norm = np.linalg.norm(y, axis=1)
        slack = SLACK * self.norm * norm[0] + 1e-6
        live = self.norm * norm[0] + slack >= self.least
        if not live.any():
            return False
        q = np.flatnonzero(live)
        bound = self.y[q] @ y[:, : self.head].T + np.outer(self.rest[q], np.linalg.norm(y[:, self.head :], axis=1)) + slack[q, None]
        may = bound >= self.least[q, None]
        rows, cols = np.flatnonzero(may.any(1)), np.flatnonzero(may.any(0))
        if not len(rows):
            return True
        q, x, ids = q[rows], x[cols], ids[cols]
        if float(self.most) * float(np.abs(x).max(initial=0)) * x.shape[1] < 2**53:
            score = (self.x[q].astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
        else:
            score = self.x[q] @ x.T
        # a query's own row: its id among the candidates
        own = self.ids[q][:, None] == ids[None, :]
        enter = (score >= self.least[q, None]) & ~own
        if len(ids) > self.k + 1:
            part = np.where(own, np.iinfo(np.int64).min, score)
            enter &= score >= np.partition(part, len(ids) - self.k, axis=1)[:, len(ids) - self.k, None]
        a, b = np.nonzero(enter)
        self.more.append(np.stack([q[a], score[a, b], ids[b]], 1))
        if sum(map(len, self.more)) > max(4 * self.k * len(self.ids) // 2, 1):
            self.settle()
        return True

    def settle(self) -> np.ndarray:
        r = np.concatenate([self.found, *self.more])
        self.more = []
        r = r[np.lexsort((r[:, 2], -r[:, 1], r[:, 0]))]
        first = np.searchsorted(r[:, 0], r[:, 0])
        place = np.arange(len(r)) - first
        self.found = r[place < self.k]
        full = place == self.k - 1
        self.least[r[full, 0]] = r[full, 1]
        return self.found


def top_k(df: DataFrame, is_query, k: int = 20, scale: int = 64, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k highest integer inner products of each query (rows for which the column is_query holds of vec_id): query_id, rank int, vec_id, score.

    Components become floor(scale * x). Candidates are all rows but those with the query's id; ties go to the smaller id. Rows
    with a null id or vector, or a null or non-finite component, take no part. If rows repeat a query's id, its smallest
    vector asks; as candidates all of them count. Shorter vectors end in zeros, empty ones are zero; other columns are not read.
    """
    v = stage(quantised(df, id_col, vec_col, scale))
    n, n_queries, dim = v.agg(F.count("*"), F.count_if(is_query(F.col("vec_id"))), F.max(F.size("x"))).first()
    dim = max(1, dim or 0)
    values, vectors = np.linalg.eigh(gram(v, dim))
    rotation = vectors[:, ::-1].copy()
    share = np.cumsum(np.maximum(values[::-1], 0)) / max(values.sum(), 1e-300)
    head = min(dim, 1 + int(np.searchsorted(share, HEAD_SHARE)))
    blocks, slices = max(1, -(-n_queries // QUERY_BLOCK)), max(1, min(SLICES, -(-n // SLICE_ROWS)))
    queries = v.filter(is_query(F.col("vec_id"))).groupBy("vec_id").agg(F.min("x").alias("x"))
    part = lambda salt, of: F.pmod(F.xxhash64(F.col("vec_id"), F.lit(salt)), F.lit(of))
    left = queries.select((part(1, blocks) * slices).alias("b"), "vec_id", "x").select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(slices - 1)), lambda s: F.col("b") + s)).alias("cell"), F.lit(0).alias("side"), F.lit(0).cast("long").alias("size"), "vec_id", "x")
    square = F.aggregate("x", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))
    right = v.select(part(2, slices).alias("s"), square.alias("n"), "vec_id", "x").select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda b: F.col("s") + b * slices)).alias("cell"), F.lit(1).alias("side"), (-F.col("n")).alias("size"), "vec_id", "x")
    grid = left.select("cell", "side", F.col("size").cast("double").alias("size"), "vec_id", "x").union(right)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, block, ids, xs, over = None, None, [], [], False

        def result():
            found = block.settle()
            return pa.RecordBatch.from_arrays([pa.array(block.ids[found[:, 0]]), pa.array(found[:, 2]), pa.array(found[:, 1])], names=["query_id", "vec_id", "score"])

        for batch in batches:
            cells, sides = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            marks = np.flatnonzero((np.diff(cells) != 0) | (np.diff(sides) != 0)) + 1
            for a, b in zip([0, *marks], [*marks, len(cells)], strict=True):
                if cells[a] != cell:
                    if block:
                        yield result()
                    cell, block, ids, xs, over = cells[a], None, [], [], False
                run_ids, run_x = batch.column(3).slice(a, b - a).to_numpy(), matrix(batch.column(4).slice(a, b - a), dim)
                if sides[a] == 0:
                    ids.append(run_ids)
                    xs.append(run_x)
                    continue
                if block is None and ids:
                    block = Block(np.concatenate(ids), np.concatenate(xs), rotation, head, k)
                for c in range(0, b - a, CHUNK):
                    if block and not over:
                        over = not block.meet(run_ids[c : c + CHUNK], run_x[c : c + CHUNK])
        if block:
            yield result()

    best = grid.repartition(blocks * slices, "cell").sortWithinPartitions("cell", "side", "size", "vec_id").mapInArrow(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
