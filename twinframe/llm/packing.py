"""Packing documents into batches of like length.

A global histogram of lengths is the only thing that the driver sees. Dynamic programming over it finds the boundaries of at
most n_buckets length buckets with the least padding in total; each document is padded to its bucket's boundary. Inside a
bucket, token-budget batches take as many documents as fit: budget // boundary, one at least.

The histogram has a bar for each distinct length, so the boundaries are the optimum. d distinct lengths need d(d - 1)/2 words at least:
16 bytes a bar make at most 100 MB for 100 TB of text, and far less for real lengths.

A document's place in its bucket comes from exact ranks without a global sort: each bucket is cut in SHARDS shards by a hash
of the row, the shards' counts (n_buckets x SHARDS rows) are summed up in order, and ranks inside one shard are added.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

N_BUCKETS, TOKEN_BUDGET, SHARDS = 16, 32_768, 256

#: Fixed value: a word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def boundaries(lengths: np.ndarray, counts: np.ndarray, n_buckets: int) -> list[int]:
    """Upper ends of the buckets that pad least in total; lengths are distinct and ascending.

    The cost of lengths i..j in a bucket is length[j] x their number - their sum, which satisfies the quadrangle inequality, so
    the best last cut moves one way with j and each layer is found by divide and conquer. Ties take the smallest cut.
    """
    m = len(lengths)
    if not m:
        return []
    c = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    s = np.concatenate([[0], np.cumsum(counts * lengths)]).astype(np.int64)
    best = lengths.astype(np.int64) * c[1:] - s[1:]
    best = np.concatenate([[0], best])  # best[j]: of the first j lengths in one bucket
    cuts = [np.zeros(m + 1, np.int64)]
    for _ in range(min(n_buckets, m) - 1):
        now, cut = np.zeros(m + 1, np.int64), np.zeros(m + 1, np.int64)
        todo = [(1, m, 0, m - 1)]
        while todo:
            lo, hi, a, b = todo.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            i = np.arange(a, min(b, j - 1) + 1)
            cost = best[i] + lengths[j - 1] * (c[j] - c[i]) - (s[j] - s[i])
            k = int(np.argmin(cost))
            now[j], cut[j] = cost[k], i[k]
            todo += [(lo, j - 1, a, int(i[k])), (j + 1, hi, int(i[k]), b)]
        if now[m] >= best[m] and len(cuts) > 1:
            break
        best = now
        cuts.append(cut)
    ends, j = [], m
    for cut in reversed(cuts):
        if j <= 0:
            break
        ends.append(int(lengths[j - 1]))
        j = int(cut[j])
    return sorted(set(ends))


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_buckets: int = N_BUCKETS, budget: int = TOKEN_BUDGET) -> DataFrame:
    """Every row's batch: id, n_tokens, bucket int (from 0), bucket_tokens (the boundary), batch string, slot long (place in the batch, from 0), padding long.

    Tokens are words. Null and empty texts have no tokens and go to the first bucket; a text longer than the budget has a
    batch of its own; rows alike, and null ids, are kept and placed in a fixed but arbitrary order; an empty table gives none;
    other columns are not read.
    """
    counted = df.select(id_col, F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("n_tokens"))
    tokens = stage(counted)  # texts are read and counted once; else each use of the number would count again
    bars = tokens.groupBy("n_tokens").agg(F.count("*").alias("n")).orderBy("n_tokens").toArrow()
    ends = boundaries(*(bars.column(k).to_numpy().astype(np.int64) for k in range(2)), n_buckets)
    ends = ends or [0]
    bucket = F.lit(0)
    for e in ends[:-1]:
        bucket = bucket + (F.col("n_tokens") > e).cast("int")
    placed = (
        tokens.withColumn("bucket", bucket)
        .withColumn("_shard", F.pmod(F.xxhash64(id_col, "n_tokens"), F.lit(SHARDS)).cast("int"))
    )
    # shards of equal rows still tie: the rank among them is arbitrary, and the rows are alike
    shards = placed.groupBy("bucket", "_shard").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("bucket").orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1))
    offsets = shards.select("bucket", "_shard", F.coalesce(before, F.lit(0)).alias("_before"))
    # n_buckets x SHARDS rows at most, so the broadcast has a fixed bound
    ranked = placed.withColumn("_rank", F.row_number().over(Window.partitionBy("bucket", "_shard").orderBy(F.col("n_tokens"), F.col(id_col))) - 1)
    place = F.col("_before") + F.col("_rank")
    end = F.element_at(F.array(*[F.lit(e).cast("long") for e in ends]), F.col("bucket") + 1)
    fits = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(end, F.lit(1)))).cast("long")
    return ranked.join(F.broadcast(offsets), ["bucket", "_shard"]).select(
        id_col,
        "n_tokens",
        "bucket",
        end.alias("bucket_tokens"),
        F.concat_ws("-", F.col("bucket"), F.floor(place / fits).cast("long")).alias("batch"),
        (place % fits).cast("long").alias("slot"),
        (end - F.col("n_tokens")).alias("padding"),
    )
