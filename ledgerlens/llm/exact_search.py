"""Exact nearest vectors by statistics of their segments, coarse to fine.

The product of two vectors is known from their lengths and their distance, and
the distance of two segments of ``m`` components is at least ``m`` times that of
their points (mean, standard deviation). Summed over the segments this bounds the
distance from below, and the product from above. A shard holds vectors with the
statistics of 1, 4, 16, ... segments. For a block of queries the vectors with the
best bounds are scored exactly, which gives each query a score that its answers
reach; then the coarsest level bounds all of the shard. Only vectors whose bound reaches it go on to the
next finer level (a level of many survivors is bounded by one matrix product, one
of few pair by pair), and the survivors of the finest are scored exactly. Bounds
are floating-point numbers with room for their rounding; scores are integers.

Every shard is a group of rows followed by the blocks of queries, in the order
of a sort: a task reads one shard and then block after block, so that memory
does not grow with the queries, and shards are not copied. Each shard returns at
most ``k`` rows a query, and these are merged by a window.

Equal vectors are one point with its smallest ids (as many as a result can hold,
and one more for the query itself), so that a vector that very many rows share
is scored once.

Defined cases: vectors that are null or hold null or non-finite components take
no part; zero and empty vectors do; vectors are compared with those of their own
length; repeated rows of one id and vector are one; one id with two vectors is
a candidate with both and a query with both, which merges their answers;
components are scaled and rounded down as doubles; vectors whose product with
themselves is beyond ``LARGEST``, so that products need not fit into a long, take
no part either; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlens.llm.common import buckets_for, col, written

SCALE, K = 256, 5
#: Largest product of a scaled vector with itself; products of any two such vectors are no larger.
LARGEST = 2.0 ** 62
#: Doubles add up integers exactly below this.
EXACT = 2.0 ** 53
#: Distinct vectors of a shard, queries of a block, each level's segments are so many times those of the one before.
SHARD_ROWS, BLOCK, FINER = 8192, 256, 4
#: Vectors scored exactly at the start, per query, beside those asked for; pairs handled at once; share of survivors above which a level is one matrix product.
FIRST, PAIRS, MANY = 16, 262_144, 0.05


def scaled(vector: Column, scale: int = SCALE) -> Column:
    """Components times ``scale`` as doubles, rounded down, as integers; null if the vector can't take part."""
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    square = F.aggregate(vector, F.lit(0.0), lambda total, x: total + F.pow(x.cast("double") * scale, F.lit(2.0)))
    return F.when(square <= LARGEST, whole)  # null if a component is, and not true of one that isn't finite


def points_of(vectors: DataFrame, key: str, vector: str, ids: int, scale: int = SCALE) -> DataFrame:
    """Distinct scaled vectors: ``size`` (length), ``v``, ``ids`` (the ``ids`` smallest)."""
    good = vectors.where(col(key).isNotNull()).select(col(key).cast("bigint").alias("id"), scaled(col(vector), scale).alias("v")).where("v is not null")
    good = good.withColumn("h", F.xxhash64("v"))
    rank = F.dense_rank().over(Window.partitionBy("h", "v").orderBy("id"))  # limited before the shuffle, so that a vector of many rows stays small
    return good.withColumn("rank", rank).where(F.col("rank") <= ids).groupBy("h", "v").agg(
        F.array_sort(F.collect_set("id")).alias("ids")).select(F.size("v").alias("size"), "v", "ids")


def levels(size: int, finer: int = FINER) -> list[np.ndarray]:
    """Where the segments of each level begin, coarse to fine."""
    out, n = [], 1
    while n < size:
        out.append(np.unique(np.arange(n) * size // n))
        n *= finer
    return out


def statistics(vectors: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Mean and deviation of every segment, both times the root of its length: distances between these rows are at most those between the vectors."""
    lengths = np.diff(np.append(begins, vectors.shape[1]))
    mean = np.add.reduceat(vectors, begins, axis=1) / lengths
    square = np.add.reduceat((vectors - np.repeat(mean, lengths, axis=1)) ** 2, begins, axis=1)
    return np.concatenate([mean * np.sqrt(lengths), np.sqrt(square)], 1)


class Shard:
    """Distinct vectors of one length with the statistics of all levels."""

    def __init__(self, vectors: np.ndarray, ids: list[np.ndarray], finer: int = FINER):
        self.whole = vectors
        real = vectors.astype(np.float64)
        self.cuts = levels(vectors.shape[1], finer)
        self.stats = [statistics(real, c) for c in self.cuts]
        self.counts = np.array([len(x) for x in ids])
        self.ids = np.concatenate(ids)
        self.begins = np.cumsum(self.counts) - self.counts
        self.exact = real if float((real ** 2).sum(1).max(initial=0.0)) < EXACT else None
        self.room = 1 + 1e-9 * float(np.sqrt((real ** 2).sum(1).max(initial=0.0)))

    def nearest(self, queries: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, score): every candidate that can be among a query's ``k`` highest of this shard, and few others."""
        n, real = len(self.whole), queries.astype(np.float64)
        room = 1 + 1e-9 * np.sqrt((real ** 2).sum(1)) * self.room
        if self.cuts and n > k + 1 + FIRST:
            # products of statistics: half of (both squared lengths less the bound of the squared distance)
            bound = statistics(real, self.cuts[0]) @ self.stats[0].T
            ahead = np.argpartition(-(statistics(real, self.cuts[-1]) @ self.stats[-1].T), k + FIRST, 1)[:, :k + 1 + FIRST]
            score = np.einsum("qcd,qd->qc", self.whole[ahead], queries)
            reach = -np.partition(-score, k, 1)[:, k] - room  # k + 1 points: one may be the query's own
            q, c = np.nonzero(bound >= reach[:, None])
            for cut, stats in zip(self.cuts[1:], self.stats[1:]):
                asked = statistics(real, cut)
                if len(q) > MANY * len(queries) * n:
                    q, c = np.nonzero(asked @ stats.T >= reach[:, None])
                    continue
                stays = [np.einsum("pd,pd->p", asked[q[lo:lo + PAIRS]], stats[c[lo:lo + PAIRS]]) >= reach[q[lo:lo + PAIRS]] for lo in range(0, len(q), PAIRS)]
                stays = np.concatenate(stays) if stays else np.zeros(0, bool)
                q, c = q[stays], c[stays]
            if len(q) > MANY * len(queries) * n and self.exact is not None and (real ** 2).sum(1).max() < EXACT:
                q, c = np.nonzero(real @ self.exact.T >= reach[:, None])  # most are left: their scores as one product, too
        else:
            q, c = np.divmod(np.arange(len(queries) * n), n)
        score = np.concatenate([np.einsum("pd,pd->p", queries[q[lo:lo + PAIRS]], self.whole[c[lo:lo + PAIRS]]) for lo in range(0, max(len(q), 1), PAIRS)])
        times = self.counts[c]
        at = np.repeat(self.begins[c], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        q, score, ids = np.repeat(q, times), np.repeat(score, times), self.ids[at]
        other = ids != own[q]
        q, score, ids = q[other], score[other], ids[other]
        by = np.lexsort((ids, -score, q))
        q, score, ids = q[by], score[by], ids[by]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        return q[rank < k], ids[rank < k], score[rank < k]


def search(vectors: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = K, scale: int = SCALE,
           shard_rows: int = SHARD_ROWS, block: int = BLOCK) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` (integer product of the scaled vectors) of each query's ``k`` highest, ties to the smaller id, the query's own id left out."""
    import pandas as pd

    points = written(points_of(vectors, key, vector, k + 1, scale), "exact-points")
    shards = buckets_for(points.count(), shard_rows)
    asked = queries.where(col(key).isNotNull()).select(col(key).cast("bigint").alias("id"), scaled(col(vector), scale).alias("v")).where("v is not null").distinct()
    sizes = F.size("v").alias("size")
    dealt = points.select("size", F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int").alias("shard"), F.lit(False).alias("asks"), "v", "ids")
    spread = asked.select(sizes, F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("asks"), "v", F.array("id").alias("ids"))
    none = {"query_id": [], "vec_id": [], "score": []}

    def answered(shard: Shard | None, rows: list) -> pd.DataFrame:
        if shard is None or not rows:
            return pd.DataFrame(none)
        own = np.array([i[0] for _, i in rows], np.int64)
        q, ids, score = shard.nearest(np.array([v for v, _ in rows], np.int64).reshape(len(rows), -1), own, k)
        return pd.DataFrame({"query_id": own[q], "vec_id": ids, "score": score})

    def walk(frames):
        at, shard, points_, rows = None, None, [], []
        for frame in frames:
            for size, number, asks, v, ids in zip(frame["size"].tolist(), frame["shard"].tolist(), frame["asks"].tolist(), frame["v"], frame["ids"]):
                if (size, number) != at:
                    yield answered(shard, rows)
                    at, shard, points_, rows = (size, number), None, [], []
                if not asks:
                    points_.append((v, ids))
                    continue
                if points_:
                    shard = Shard(np.array([x for x, _ in points_], np.int64).reshape(len(points_), -1), [np.asarray(x, np.int64) for _, x in points_])
                    points_ = []
                if shard is not None:
                    rows.append((v, ids))
                if len(rows) == block:
                    yield answered(shard, rows)
                    rows = []
        yield answered(shard, rows)

    met = dealt.unionByName(spread).repartition(shards, "shard").sortWithinPartitions("size", "shard", "asks")
    met = met.mapInPandas(walk, "query_id bigint, vec_id bigint, score bigint").distinct()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
