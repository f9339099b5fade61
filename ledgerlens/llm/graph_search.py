"""Approximate nearest neighbours by a robust-pruned directed graph per shard.

Vectors are dealt over shards. In each shard a graph is built point by point (in
batches): a greedy search proposes neighbours, relaxed pruning keeps those that
no kept one is much nearer to, and edges back are pruned alike. A query walks
every shard's graph with a beam, and the shards' nearest are merged. Largest
inner product becomes nearest neighbour by one more coordinate that gives all
vectors of a shard the same length; queries have zero there.

Equal vectors are one point of the graph with its smallest ids (as many as a
result can hold, and one more for the query itself), so that a vector that
very many rows share neither crowds the graph nor hides a smaller id. The
index is a table of one row per shard. A search sorts each shard's row before
the queries, so that a task reads one shard and then block after block of
queries: it holds one of each at any input size, and no index is copied.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components take no part; vectors are compared within their own length; repeated
rows of one id and vector are one, as candidates and as queries; one id with two
vectors is a candidate with both and a query with both, and each id is returned
once, with its highest score; fewer candidates than asked for are all returned
if the beam holds them; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlens.llm.common import buckets_for, col, written

#: Rows of a shard, fewest shards, queries that walk together.
SHARD_ROWS, LEAST_SHARDS, BLOCK = 8192, 4, 512
#: Edges of a point, beams of building and searching, relaxation of pruning, points expanded and inserted together, points where a walk begins.
DEGREE, BUILD_BEAM, BEAM, RELAX, EXPAND, BATCH, ENTRIES = 32, 48, 80, 1.2, 4, 512, 32


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def walk(points: np.ndarray, graph: np.ndarray, entries: np.ndarray, queries: np.ndarray, beam: int, expand: int = EXPAND) -> tuple[np.ndarray, np.ndarray]:
    """Beam search of all queries in step: ids and inner products of the nearest points met, best first; -1 where there are fewer."""
    n_q = len(queries)
    rows = np.arange(n_q)[:, None]
    seen = np.zeros((n_q, len(points) + 1), bool)  # one column more, for the missing
    start = np.broadcast_to(entries, (n_q, len(entries)))
    seen[:, entries] = True
    ids = np.full((n_q, beam), -1, np.int32)
    sims = np.full((n_q, beam), -np.inf, np.float32)
    done = np.ones((n_q, beam), bool)
    found, near = start, queries @ points[entries].T
    while True:
        every = np.concatenate([ids, found], 1)
        close = np.concatenate([sims, near], 1)
        over = np.concatenate([done, np.zeros(found.shape, bool)], 1)
        top = np.argpartition(-close, beam - 1, 1)[:, :beam]
        top = top[rows, np.argsort(-close[rows, top], 1, kind="stable")]
        ids, sims, done = every[rows, top].astype(np.int32), close[rows, top], over[rows, top]
        done |= sims == -np.inf
        open_ = ~done
        if not open_.any():
            return ids, sims
        rank = np.cumsum(open_, 1)
        pick = open_ & (rank <= expand)
        done |= pick
        at, which = np.nonzero(pick)
        place = rank[at, which] - 1
        chosen = np.full((n_q, expand), -1, np.int32)
        chosen[at, place] = ids[at, which]
        found = np.where(chosen[:, :, None] >= 0, graph[chosen], -1).reshape(n_q, -1)
        ordered = np.sort(found, 1)  # a point may be reached from two at once
        fresh = (ordered >= 0) & ~seen[rows, ordered]
        fresh[:, 1:] &= ordered[:, 1:] != ordered[:, :-1]
        width = max(1, int(fresh.sum(1).max()))
        found = np.full((n_q, width), -1, np.int32)
        at, which = np.nonzero(fresh)
        place = np.cumsum(fresh, 1)[at, which] - 1
        found[at, place] = ordered[at, which]
        seen[at, ordered[at, which]] = True
        near = np.full((n_q, width), -np.inf, np.float32)
        near[at, place] = np.einsum("ij,ij->i", points[found[at, place]], queries[at])


def prune(points: np.ndarray, own: np.ndarray, candidates: np.ndarray, square: float, degree: int = DEGREE, relax: float = RELAX) -> np.ndarray:
    """For each point of ``own``, the kept ones of its candidates (-1: none): the nearest, then again the nearest of those that no kept one is ``relax`` times nearer to."""
    rows = np.arange(len(own))[:, None]
    gathered = points[candidates]
    sims = np.einsum("bcd,bd->bc", gathered, points[own])
    ordered = np.sort(candidates, 1)
    twice = np.zeros(candidates.shape, bool)
    order = np.argsort(candidates, 1, kind="stable")
    twice[rows, order[:, 1:]] = ordered[:, 1:] == ordered[:, :-1]
    sims[(candidates < 0) | (candidates == own[:, None]) | twice] = -np.inf
    order = np.argsort(-sims, 1, kind="stable")
    candidates, sims, gathered = candidates[rows, order], sims[rows, order], gathered[rows, order]
    alive = sims > -np.inf
    away = 2 * (square - sims)
    kept = np.full((len(own), degree), -1, np.int32)
    for k in range(degree):
        first = alive.argmax(1)
        some = alive[rows[:, 0], first]
        if not some.any():
            break
        kept[some, k] = candidates[rows[:, 0], first][some]
        between = 2 * (square - np.einsum("bcd,bd->bc", gathered, gathered[rows[:, 0], first]))
        alive &= ~(some[:, None] & (relax * relax * between <= away))
        alive[rows[:, 0], first] = False
    return kept


def lifted(vectors: np.ndarray) -> tuple[np.ndarray, float]:
    """Vectors with one more coordinate that gives them all the largest length, and that length squared."""
    squares = np.einsum("ij,ij->i", vectors, vectors, dtype=np.float64)
    most = float(squares.max())
    return np.concatenate([vectors, np.sqrt(np.maximum(most - squares, 0))[:, None].astype(np.float32)], 1), most


def build(vectors: np.ndarray, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Graph (row of neighbours per point, -1 where there are fewer) and the points where walks begin."""
    points, square = lifted(vectors.astype(np.float32))
    n = len(points)
    graph = np.full((n, DEGREE), -1, np.int32)
    order = np.random.default_rng(seed).permutation(n).astype(np.int32)
    entries = order[:ENTRIES]
    at = 0
    while at < n:
        batch = order[at:at + (BATCH if at else min(BATCH, 2 * ENTRIES))]
        if at:
            candidates, _ = walk(points, graph, entries, points[batch], BUILD_BEAM)
            more = np.broadcast_to(batch, (len(batch), len(batch)))  # the batch's own nearest, which no walk can reach yet
            sims = points[batch] @ points[batch].T
            np.fill_diagonal(sims, -np.inf)
            k = min(16, len(batch) - 1)
            if k:
                candidates = np.concatenate([candidates, more[np.arange(len(batch))[:, None], np.argpartition(-sims, k - 1, 1)[:, :k]]], 1)
        else:
            candidates = np.broadcast_to(batch, (len(batch), len(batch)))
        graph[batch] = kept = prune(points, batch, np.ascontiguousarray(candidates), square)
        src, k = np.nonzero(kept >= 0)
        to, back = kept[src, k], batch[src]
        by = np.argsort(to, kind="stable")
        to, back = to[by], back[by]
        nodes, first, counts = np.unique(to, return_index=True, return_counts=True)
        for group in np.array_split(np.argsort(counts, kind="stable"), max(1, len(nodes) // 512)):  # of like width together
            width = int(counts[group].max(initial=0))
            added = np.full((len(group), width), -1, np.int32)
            cells = np.repeat(np.arange(len(group)), counts[group])
            place = np.arange(len(cells)) - np.repeat(np.cumsum(counts[group]) - counts[group], counts[group])
            added[cells, place] = back[np.repeat(first[group], counts[group]) + place]
            both = np.concatenate([graph[nodes[group]], added], 1)
            graph[nodes[group]] = prune(points, nodes[group], both, square)
        at += len(batch)
    return graph, entries


def points_of(vectors: DataFrame, key: str, vector: str, ids: int) -> DataFrame:
    """Distinct vectors: ``size`` (length), ``v``, ``ids`` (the ``ids`` smallest)."""
    good = vectors.where(col(key).isNotNull() & usable(col(vector))).select(col(key).cast("bigint").alias("id"), col(vector).alias("v"))
    good = good.withColumns({"size": F.size("v"), "h": F.xxhash64("v")})
    rank = F.dense_rank().over(Window.partitionBy("h", "v").orderBy("id"))  # limited before the shuffle, so that a vector of many rows stays small
    return good.withColumn("rank", rank).where(F.col("rank") <= ids).groupBy("h", "v").agg(
        F.first("size").alias("size"), F.array_sort(F.collect_set("id")).alias("ids")).select("size", "v", "ids")


def index(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 20) -> DataFrame:
    """One row per shard: ``size``, ``shard``, ``shards``, points, graph and ids as bytes."""
    import pandas as pd

    distinct = written(points_of(vectors, key, vector, k + 1), "search-points")
    shards = max(LEAST_SHARDS, buckets_for(distinct.count(), SHARD_ROWS))
    dealt = distinct.withColumn("shard", F.pmod(F.xxhash64(F.col("ids")[0]), F.lit(shards)).cast("int"))

    def make(key_, frame):
        points = np.array(frame["v"].tolist(), np.float64)
        graph, entries = build(points)
        counts = np.array([len(x) for x in frame["ids"]], np.int64)
        ids = np.concatenate(frame["ids"].tolist()).astype(np.int64)
        return pd.DataFrame([(key_[0], key_[1], points.tobytes(), graph.tobytes(), entries.tobytes(), counts.tobytes(), ids.tobytes())],
                            columns=["size", "shard", "points", "graph", "entries", "counts", "ids"])

    made = dealt.groupBy("size", "shard").applyInPandas(make, "size int, shard int, points binary, graph binary, entries binary, counts binary, ids binary")
    return written(made.withColumn("shards", F.lit(shards)), "search-index")


def search(found: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 20, beam: int = BEAM) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` of the ``k`` nearest that the index' graphs lead to, the query's own id left out."""
    import pandas as pd

    asked = queries.where(col(key).isNotNull() & usable(col(vector))).select(col(key).cast("bigint").alias("query_id"), col(vector).cast("array<double>").alias("v")).distinct()
    first = found.select("shards").first()
    shards = first["shards"] if first else 1
    spread = asked.select(F.size("v").alias("size"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("asks"), "query_id", "v")
    held = found.drop("shards").withColumn("asks", F.lit(False))

    def look(row, block) -> pd.DataFrame:
        vectors = np.frombuffer(row["points"]).reshape(-1, int(row["size"]))
        graph = np.frombuffer(row["graph"], np.int32).reshape(-1, DEGREE)
        entries = np.frombuffer(row["entries"], np.int32)
        counts, ids = np.frombuffer(row["counts"], np.int64), np.frombuffer(row["ids"], np.int64)
        begins = np.cumsum(counts) - counts
        points, _ = lifted(vectors.astype(np.float32))
        exact = np.array(block["v"].tolist(), np.float64)
        near, _ = walk(points, graph, entries, np.concatenate([exact, np.zeros((len(exact), 1))], 1).astype(np.float32), max(beam, k + 1))
        at, place = np.nonzero(near >= 0)
        node = near[at, place]
        score = np.einsum("ij,ij->i", vectors[node], exact[at])
        times = counts[node]
        q = np.repeat(at, times)
        member = ids[np.repeat(begins[node], times) + np.arange(len(q)) - np.repeat(np.cumsum(times) - times, times)]
        frame = pd.DataFrame({"asked": q, "query_id": block["query_id"].to_numpy(np.int64)[q], "vec_id": member, "score": np.repeat(score, times)})
        frame = frame[frame["query_id"] != frame["vec_id"]].sort_values(["asked", "score", "vec_id"], ascending=[True, False, True])
        return frame.groupby("asked").head(2 * k)[["query_id", "vec_id", "score"]]  # an id may be there with two vectors

    def in_turn(frames):
        at, row = None, None
        for frame in frames:
            for number, part in frame.groupby(["size", "shard"], sort=False):
                if number != at:
                    at, row = number, None
                index_rows = part[~part["asks"]]
                if len(index_rows):
                    row = index_rows.iloc[0]
                asking = part[part["asks"]]
                for lo in range(0, len(asking) if row is not None else 0, BLOCK):
                    yield look(row, asking.iloc[lo:lo + BLOCK])

    met = held.unionByName(spread, allowMissingColumns=True).repartition(shards, "shard").sortWithinPartitions("size", "shard", "asks")
    met = met.mapInPandas(in_turn, "query_id bigint, vec_id bigint, score double").repartition("query_id")  # serves both steps that follow
    met = met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
