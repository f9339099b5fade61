"""Periodic runs of words by an enhanced suffix array.

A run of period ``q`` ends where two suffixes ``q`` words apart stop to agree.
If it is at least twice its period long, its last square begins at a suffix
that agrees with the one ``q`` words on in exactly ``q`` words: the two stand in
different children of the LCP interval of that depth. So for every interval the
suffixes of its smaller child are tested: does the suffix ``depth`` words on, or
back, stand in the other child (its place is the inverse suffix array)? No tree
is built; an interval is two bounds per place of the LCP array. Runs are at
least ``LEAST`` words long, and those of a period below half of that have a pair
of suffixes that agree in exactly ``LEAST // 2`` words, so that intervals of that
depth are tested for all the shorter periods as well, and none below it are
needed. Each square found is rotated to the left as far as its period holds;
squares of one run (its multiples) end at one place and are merged there.

Suffixes of many documents are sorted together, as the words of a document are
numbered apart from those of all others. The smaller-child rule bounds the
tests by ``n log n`` for any text. A row of Spark is one document, so that a task
holds a batch of short texts or one long one, and nothing is shuffled.

Defined cases: a null or empty text, or one of white space, has no words and no
run; the planted repeat needs a document number, so that none is planted where
it is null; repeated rows are documents of their own; an empty table gives an
empty table; other columns are left out.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import col

#: Shortest run, in words.
LEAST = 12
#: Words sorted together, smaller-child suffixes tested together.
WORDS_AT_ONCE, TESTS_AT_ONCE = 400_000, 2_000_000


def planted(doc: int, n: int) -> tuple[int, int] | None:
    """(start, period) of the repeat that the contract plants in a document of ``n`` words, if any."""
    import zlib

    h = zlib.crc32(str(doc).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def sort_suffixes(words: np.ndarray, ends: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix array and its inverse, and the places whose suffix may share ``least`` words with the one before: those that share the highest power of two in it.

    ``words`` are numbers that no two documents share; ``ends`` is the end of each position's document.
    Prefixes double each round, and only suffixes that are not yet alone are sorted again.
    """
    n = len(words)
    order = np.argsort(words, kind="stable")
    head = np.empty(n, bool)
    head[:1] = True
    head[1:] = words[order[1:]] != words[order[:-1]]
    begin = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = begin
    share, k = ~head, 1
    while True:
        tail = np.append(head[1:], True)
        open_ = np.flatnonzero(~(head & tail))  # places of groups of two and more
        if k <= least:
            share = ~head
        if not len(open_):
            break
        at = order[open_]
        after = at + k
        second = np.where(after < ends[at], rank[np.minimum(after, n - 1)] + 1, 0)
        by = np.argsort(rank[at] * (n + 1) + second, kind="stable")
        at, second = at[by], second[by]
        order[open_] = at
        group = rank[at]
        new = np.empty(len(at), bool)
        new[0] = True
        new[1:] = (group[1:] != group[:-1]) | (second[1:] != second[:-1])
        head[open_] = new
        rank[at] = np.maximum.accumulate(np.where(new, open_, 0))
        k *= 2
    return order, rank, share


def agreements(words: np.ndarray, ends: np.ndarray, order: np.ndarray, place: np.ndarray, share: np.ndarray, least: int) -> np.ndarray:
    """Words that the suffix of each place shares with the one before; 0 where these are fewer than ``least``."""
    found = np.zeros(len(order), np.int64)
    active = np.zeros(len(order), bool)
    active[order[share]] = True
    at = np.flatnonzero(active)
    before = order[place[at] - 1]
    w, until = words.tolist(), np.minimum(ends[at] - at, ends[at] - before).tolist()  # both are of one document
    h, last, lcp = 0, -2, []
    for i, j, most in zip(at.tolist(), before.tolist(), until):
        h = max(h - 1, 0) if i == last + 1 else 0  # the next suffix shares one word less at least
        while h < most and w[i + h] == w[j + h]:
            h += 1
        last = i
        lcp.append(h)
    lcp = np.array(lcp, np.int64)
    found[place[at]] = np.where(lcp >= least, lcp, 0)
    return found


def intervals(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each place with an agreement: the place, the first and the last place around it that agree at least as far (of equal ones the first is the outer)."""
    nodes = np.flatnonzero(lcp)
    first, last = [], [0] * len(nodes)
    stack: list[tuple[int, int, int]] = []  # depth, first place, number
    before = -1
    for number, (place, depth) in enumerate(zip(nodes.tolist(), lcp[nodes].tolist())):
        if place != before + 1:
            for _, _, x in stack:
                last[x] = before
            stack.clear()
        left = place - 1
        while stack and stack[-1][0] > depth:
            _, left, x = stack.pop()
            last[x] = place - 1
        first.append(left)
        stack.append((depth, left, number))
        before = place
    for _, _, x in stack:
        last[x] = before
    return nodes, np.array(first, np.int64), np.array(last, np.int64)


def squares(words: np.ndarray, ends: np.ndarray, begins: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, period, depth) of pairs of suffixes, a period apart, that agree in exactly ``depth`` words: the period itself, or ``least // 2`` if that is more."""
    shallow = least // 2
    order, place, share = sort_suffixes(words, ends, shallow)
    lcp = agreements(words, ends, order, place, share, shallow)
    nodes, first, last = intervals(lcp)
    depth = lcp[nodes]
    left, right = nodes - first, last - nodes + 1
    small_left = left <= right
    size = np.where(small_left, left, right)
    begin = np.where(small_left, first, nodes)
    other_lo, other_hi = np.where(small_left, nodes, first), np.where(small_left, last, nodes - 1)
    n, out = len(words), []
    reach = np.cumsum(size)
    lo = 0
    while lo < len(nodes):
        hi = max(lo + 1, int(np.searchsorted(reach, (reach[lo - 1] if lo else 0) + TESTS_AT_ONCE, "right")))
        part = np.repeat(np.arange(lo, hi), size[lo:hi])
        suffix = order[begin[part] + np.arange(len(part)) - np.repeat(reach[lo:hi] - size[lo:hi] - (reach[lo - 1] if lo else 0), size[lo:hi])]
        for period in (0, *range(1, shallow)):  # 0: the depth
            of, at = (part, suffix) if not period else ((p := part[short := depth[part] == shallow]), suffix[short])
            step = depth[of] if not period else period
            for sign in (1, -1):
                there = at + sign * step
                inside = (there >= begins[at]) & (there < ends[at])
                where = place[np.clip(there, 0, n - 1)]
                hit = inside & (where >= other_lo[of]) & (where <= other_hi[of])
                if hit.any():
                    x = np.broadcast_to(step, at.shape)[hit]
                    out.append(np.stack([np.minimum(at[hit], there[hit]), x, depth[of][hit]]))
        lo = hi
    found = np.concatenate(out, 1) if out else np.empty((3, 0), np.int64)
    return found[0], found[1], found[2]


def rotated(words: np.ndarray, begin: int, position: int, period: int) -> int:
    """How far to the left, down to ``begin``, the period holds before ``position``."""
    step = 64
    while position > begin:
        lo = max(begin, position - step)
        differs = np.flatnonzero(words[lo:position] != words[lo + period:position + period])
        if len(differs):
            return lo + int(differs[-1]) + 1
        position, step = lo, step * 2
    return position


def runs(words: np.ndarray, ends: np.ndarray, begins: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, end, period) of all runs, by end and period."""
    position, period, depth = squares(words, ends, begins, least)
    stop = position + period + depth
    known: list[tuple[int, int, int]] = []
    end = None
    for k in np.lexsort((period, stop)).tolist():
        p, q, e = int(position[k]), int(period[k]), int(stop[k])
        if e != end:
            end, here = e, []
        if any(s <= p for s, _, _ in here):  # a multiple of a shorter period, or the same square again
            continue
        here.append((rotated(words, int(begins[p]), p, q), e, q))
        s, _, _ = here[-1]
        if e - s >= max(least, 2 * q):
            known.append(here[-1])
    return known


def find_runs(docs: DataFrame, doc: str = "doc_id", text: str = "text", plant: bool = False, least: int = LEAST) -> DataFrame:
    """Per document: ``doc``, ``runs`` (array of ``start``, ``length``, ``period``, by start and period) and ``collapsed``: the words without all but the first period of each run.

    ``plant`` replaces words as the contract of the query says before runs are searched.
    """
    import pandas as pd
    from pyspark.sql import types as T

    kind = docs.select(col(doc).alias(doc)).schema[0]
    run = T.StructType([T.StructField(x, T.LongType()) for x in ("start", "length", "period")])
    schema = T.StructType([kind, T.StructField("runs", T.ArrayType(run)), T.StructField("collapsed", T.StringType())])

    def solved(ids: list, texts: list[list[bytes]]) -> pd.DataFrame:
        numbers: dict[bytes, int] = {}
        coded = []
        for i, (d, words) in enumerate(zip(ids, texts)):
            of = [numbers.setdefault(w, len(numbers)) for w in words]
            if plant and d is not None and (a := planted(int(d), len(words))):
                a, p = a
                again = a + np.arange(len(words) - a) % p
                words[a:] = [words[k] for k in again.tolist()]
                of = np.concatenate([np.array(of[:a], np.int64), np.array(of, np.int64)[again]])
            coded.append(np.asarray(of, np.int64))
        lengths = np.array([len(x) for x in coded], np.int64)
        last = np.cumsum(lengths)
        begins, ends = np.repeat(last - lengths, lengths), np.repeat(last, lengths)
        flat = np.concatenate(coded) + np.repeat(np.arange(len(coded)), lengths) * len(numbers) if len(coded) else np.empty(0, np.int64)
        by_doc: dict[int, list] = {}
        for s, e, q in runs(flat, ends, begins, least):
            k = int(np.searchsorted(last, s, "right"))
            at = int(last[k] - lengths[k])
            by_doc.setdefault(k, []).append((s - at, e - s, q))
        out = []
        for k, (d, words) in enumerate(zip(ids, texts)):
            found = sorted(by_doc.get(k, ()), key=lambda r: (r[0], r[2]))
            if found:
                cover = np.zeros(len(words) + 1, np.int64)
                for s, n, q in found:
                    cover[s + q] += 1
                    cover[s + n] -= 1
                words = [words[i] for i in np.flatnonzero(np.cumsum(cover[:-1]) == 0).tolist()]
            out.append((d, [{"start": s, "length": n, "period": q} for s, n, q in found], b" ".join(words).decode("utf-8", "surrogatepass")))
        return pd.DataFrame(out, columns=[doc, "runs", "collapsed"])

    def each(frames):
        for frame in frames:
            ids, texts, held = [], [], 0
            for d, missing, t in zip(frame["d"].tolist(), frame["d"].isna().tolist(), frame["t"].tolist()):
                words = t.encode("utf-8", "surrogatepass").split()  # bytes: ASCII white space only
                if texts and held + len(words) > WORDS_AT_ONCE:
                    yield solved(ids, texts)
                    ids, texts, held = [], [], 0
                ids.append(None if missing else d)
                texts.append(words)
                held += len(words)
            if texts:
                yield solved(ids, texts)

    return docs.select(col(doc).alias("d"), F.coalesce(col(text), F.lit("")).alias("t")).mapInPandas(each, schema)


def summary(found: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Per row of ``find_runs``: number of runs, the longest, and digests of the list and of the words that are left."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    best = found.withColumn("best", longest)
    length, period = F.col("best.length"), -F.col("best.period")
    return best.select(
        col(doc), F.size("runs").cast("bigint").alias("n_runs"), (-F.col("best.start")).alias("start"), length.alias("length"), period.alias("period"),
        F.floor((1000 * length) / period).cast("bigint").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
