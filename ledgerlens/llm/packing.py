"""Packing token sequences by a configuration linear program.

The pieces' lengths make a histogram. A configuration is a multiset of lengths
that fits into one sequence; the linear program covers the histogram with as
few configurations as possible. Multiplicative weights on the lengths solve it:
each round prices the lengths, a knapsack dynamic program finds the best
configuration around every length for these prices, and the weight of a length
falls by a factor with the share of it that is covered. Steps are shares of
what the scarcest length of a configuration still has, rounded to whole
sequences at once, so that the solution is whole at any time. Prices begin at a
power of the length a little above one, for which full sequences of few pieces
are best: small pieces stay for the end, where gaps are small. If no full
configuration is left, one with a few tokens of slack may do; the last pieces
are placed best fit. A few settings are tried and the one with the fewest
sequences is taken, plain best fit among them, so that the result is never
worse than that.

Spark counts the histogram (at most ``size`` rows, whatever the input), the
driver solves it, and every piece finds its place from its rank among the
pieces of its length: ranks come from counts per (length, bucket), so that a
length that most pieces share is still dealt over many tasks.

Defined cases: a null or empty text has only the end mark; a document of
several pieces has its shorter piece first; the vocabulary's added tokens are
found in texts; repeated rows, and rows that share an id, are packed as often as
they occur; an empty table gives an empty table.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import groupby

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlens.llm.common import buckets_for, col, written

SIZE, END = 1024, 2
#: Pieces per (length, bucket) group are about so many at most; more input makes more buckets.
PER_BUCKET = 20_000


@lru_cache(2)
def tokenizer(path: str):
    """Encoder of a vocabulary of the tokenizers library's file, by its ids (the rank file beside it holds the same ids); added tokens are found in texts, as that library does."""
    import json

    import tiktoken

    with open(path, encoding="utf-8") as f:
        held = json.load(f)
    points = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that are written as themselves
    others = [b for b in range(256) if b not in points]
    as_byte = {chr(b): b for b in points} | {chr(256 + i): b for i, b in enumerate(others)}
    added = {t["content"]: t["id"] for t in held["added_tokens"]}
    ranks = {bytes(map(as_byte.__getitem__, token)): i for token, i in held["model"]["vocab"].items() if i not in added.values() and all(c in as_byte for c in token)}
    import public_tokenizers

    return tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)


def cuts(n: int, size: int = SIZE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens: one if they fit, else full ones after a first that may be shorter."""
    if n <= size:
        return [(0, n)]
    first = n % size or size
    return [(0, first), *((at, size) for at in range(first, n, size))]


def pieces(docs: DataFrame, path: str, doc: str = "doc_id", text: str = "text", size: int = SIZE, end: int = END, ids: bool = False) -> DataFrame:
    """Per piece: ``doc``, ``piece``, ``start``, ``length``, ``ids_crc32`` and, if asked for, ``ids``."""
    import pandas as pd

    kind = dict(docs.select(col(doc).alias("d")).dtypes)["d"]
    names = [doc, "piece", "start", "length", "ids_crc32", *["ids"] * ids]

    def encode(frames):
        import zlib

        enc = tokenizer(path)
        for frame in frames:
            texts = frame["t"].tolist()
            for lo in range(0, max(1, len(texts)), 500):
                rows = []
                for d, t in zip(frame["d"].iloc[lo:lo + 500], texts[lo:lo + 500]):
                    found = np.append(enc.encode_to_numpy(t, allowed_special="all"), end).astype("<u4")
                    for k, (at, n) in enumerate(cuts(len(found), size)):
                        part = found[at:at + n]
                        rows.append((d, k, at, n, zlib.crc32(part.tobytes()), *[part.astype(np.int32)] * ids))
                yield pd.DataFrame(rows, columns=names)

    schema = f"`{doc}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * ids
    return docs.select(col(doc).alias("d"), F.coalesce(col(text), F.lit("")).alias("t")).mapInPandas(encode, schema)


def knapsack(sizes: np.ndarray, prices: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Dynamic program over capacities up to ``size``: the highest price of a multiset that fits, and the length it takes last (0: none). A block of capacities at a time, for which lengths above the block need no order."""
    block = 16
    big = sizes >= block
    bs, bp = sizes[big], prices[big]
    little = [(int(s), float(p)) for s, p in zip(sizes[~big], prices[~big])]
    pad = int(sizes.max()) + 1
    best = np.full(size + 1 + pad, -np.inf)
    best[pad:] = 0.0
    take = np.zeros(size + 1, np.int64)
    for lo in range(1, size + 1, block):
        hi = min(lo + block, size + 1)
        span = np.arange(hi - lo)
        if len(bs):
            offers = best[pad + lo - bs + span[:, None]] + bp
            at = offers.argmax(1)
            top, first = offers[span, at].tolist(), bs[at].tolist()
        for c in range(lo, hi):
            value, chosen = best[pad + c - 1], 0
            if len(bs) and top[c - lo] > value:
                value, chosen = top[c - lo], first[c - lo]
            for s, p in little:
                if s <= c and best[pad + c - s] + p > value:
                    value, chosen = best[pad + c - s] + p, s
            best[pad + c], take[c] = value, chosen
    return best[pad:], take


def trace(take: np.ndarray, capacity: int, found: dict[int, int]) -> tuple[tuple[int, int], ...]:
    """The configuration that the dynamic program found for ``capacity``, beside what is in ``found``: (length, times) pairs."""
    while capacity > 0:
        s = int(take[capacity])
        if s:
            found[s] = found.get(s, 0) + 1
        capacity -= s or 1
    return tuple(sorted(found.items(), reverse=True))


def best_fit(left: dict[int, int], size: int) -> list[tuple[tuple, int]]:
    """Lengths and their numbers, the longest first, each into the fullest sequence it fits; equal sequences are handled together."""
    open_: dict[int, list[list]] = {}
    for s in sorted(left, reverse=True):
        n = left[s]
        while n:
            gap = min((g for g in open_ if g >= s and open_[g]), default=None)
            if gap is None:
                per = min(size // s, n)
                times = n // per
                open_.setdefault(size - per * s, []).append([((s, per),), times])
                n -= per * times
                continue
            config, times = open_[gap].pop()
            per = min(gap // s, n)
            now = min(times, n // per)
            if now < times:
                open_[gap].append([config, times - now])
            merged = dict(config)
            merged[s] = merged.get(s, 0) + per
            open_.setdefault(gap - per * s, []).append([tuple(sorted(merged.items(), reverse=True)), now])
            n -= per * now
    return [(c, t) for group in open_.values() for c, t in group if t]


def program(histogram: dict[int, int], size: int, rate: float, power: float, slack: int, rest: float, longest_first: bool,
            share: float = 0.2, rounds: int = 400) -> tuple[dict[tuple, int], dict[int, int]]:
    """Whole configurations with their multiplicities for all but about ``rest`` of the pieces, and the pieces that are left.

    ``rate`` is that of the weights, ``slack`` the most tokens that a sequence may lack.
    """
    sizes = np.array(sorted(histogram), np.int64)
    counts = np.array([histogram[int(s)] for s in sizes], np.int64)
    place = {int(s): i for i, s in enumerate(sizes)}
    left, out, room = counts.copy(), {}, 0
    for _ in range(rounds):
        if left.sum() <= rest * counts.sum():
            break
        covered = 1 - left / counts
        have = np.flatnonzero(left)
        prices = sizes[have] ** power * np.exp(-rate * (covered[have] - covered.mean()))
        _, take = knapsack(sizes[have], prices, size)
        used = False
        for i in have[np.argsort(-sizes[have] if longest_first else covered[have], kind="stable")].tolist():
            if not left[i]:
                continue
            config = trace(take, size - int(sizes[i]), {int(sizes[i]): 1})
            if sum(s * k for s, k in config) < size - room:
                continue
            most = min(int(left[place[s]]) // k for s, k in config)
            times = min(most, max(1, int(share * most)))
            if times:
                out[config] = out.get(config, 0) + times
                for s, k in config:
                    left[place[s]] -= k * times
                used = True
        if not used:
            if room >= slack:
                break
            room = 2 * room + 1
    return out, {int(s): int(n) for s, n in zip(sizes, left) if n}


#: (rate, power, slack, rest, longest first) that are tried in turn.
SETTINGS = ((0.1, 1.2, 3, 0.02, False), (6.0, 1.2, 7, 0.1, True), (0.5, 1.8, 3, 0.02, False), (2.0, 1.2, 7, 0.1, True), (0.1, 1.8, 3, 0.02, True), (0.5, 1.4, 3, 0.1, False))


def solve(histogram: dict[int, int], size: int = SIZE, settings: tuple = SETTINGS) -> tuple[list[tuple[tuple, int]], int]:
    """Whole configurations with their multiplicities that hold exactly the histogram's pieces; how many pieces the program has placed (the others are best fit)."""
    pieces = {int(s): int(n) for s, n in histogram.items() if n > 0}
    full = {((size, 1),): pieces.pop(size)} if size in pieces else {}
    least = -(-sum(s * n for s, n in pieces.items()) // size)
    best: dict[tuple, int] = {}
    for config, times in best_fit(dict(pieces), size):
        best[config] = best.get(config, 0) + times
    fewest, placed = sum(best.values()), 0
    for setting in settings if pieces else ():
        found, left = program(pieces, size, *setting)
        for config, times in best_fit(dict(left), size):
            found[config] = found.get(config, 0) + times
        by_program = sum(pieces.values()) - sum(left.values())
        if (sum(found.values()), -by_program) < (fewest, -placed):
            best, fewest, placed = found, sum(found.values()), by_program
        if fewest == least:
            break
    return sorted((best | full).items()), placed + sum(full.values())


def slots(solution: list[tuple[tuple, int]]) -> dict[int, dict[str, np.ndarray]]:
    """Per length: where the ranks of each configuration's share begin, its first sequence, how many of the length a sequence takes, and their first offset."""
    rows, sequence, ranks = [], 0, {}
    for config, times in solution:
        at = 0
        for s, k in config:
            lo = ranks.get(s, 0)
            rows.append((s, lo, sequence, k, at))
            ranks[s] = lo + k * times
            at += s * k
        sequence += times
    rows.sort()
    return {s: dict(zip(("rank", "sequence", "per", "offset"), np.array([r[1:] for r in group], np.int64).T)) for s, group in groupby(rows, key=lambda r: r[0])}


def with_rank(found: DataFrame, length: str, keys: list[str], buckets: int) -> DataFrame:
    """Adds ``rank``, from 0 without gaps among the rows of each length, and ``bucket``."""
    spread = F.pmod(F.xxhash64(*[col(k) for k in keys]), F.lit(buckets))
    dealt = found.withColumn("bucket", spread)
    sums = dealt.groupBy(length, "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy(length).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(length, "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy(length, "bucket").orderBy(*keys)
    return dealt.withColumn("at", F.row_number().over(inside) - 1).join(sums, [length, "bucket"]).withColumn("rank", F.col("at") + F.col("base")).drop("at", "base")


def pack(found: DataFrame, doc: str = "doc_id", size: int = SIZE) -> DataFrame:
    """``found`` (as of ``pieces``) with ``sequence_id`` and ``offset``."""
    import pandas as pd

    found = written(found, "packing-pieces")
    histogram = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most size rows
    places = found.sparkSession.sparkContext.broadcast(slots(solve(histogram, size)[0]))  # bounded by lengths and rounds
    ranked = with_rank(found, "length", [doc, "piece"], buckets_for(sum(histogram.values()), PER_BUCKET) * 16)
    names = [*found.columns, "sequence_id", "offset"]

    def place(frames):
        for frame in frames:
            lengths, ranks = frame["length"].to_numpy(), frame["rank"].to_numpy()
            sequence, offset = np.empty(len(frame), np.int64), np.empty(len(frame), np.int64)
            for s in np.unique(lengths):
                rows, slot = lengths == s, places.value[int(s)]
                k = np.searchsorted(slot["rank"], ranks[rows], "right") - 1
                along = ranks[rows] - slot["rank"][k]
                sequence[rows] = slot["sequence"][k] + along // slot["per"][k]
                offset[rows] = slot["offset"][k] + along % slot["per"][k] * s
            yield frame.assign(sequence_id=sequence, offset=offset)[names]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema) + ", sequence_id bigint, offset bigint"
    return ranked.drop("bucket").mapInPandas(place, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id``, ``ids`` of every sequence; a group holds ``size`` tokens at most. Needs pieces with ``ids``."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(ordered, lambda x: x["ids"])).alias("ids"))


