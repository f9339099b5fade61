"""Spelling variants, exact search and periodic runs against brute force."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import exact_search, repeat_runs, spelling_variants


def brute_variants(rows, damage):
    counts = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if damage and h % damage == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if n >= 3 and len(w) >= 5}

    def one_apart(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        return len(b) - len(a) == 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))

    around = {w: [v for v in words if one_apart(w, v)] for w in words}
    form = {w: min(vs, key=lambda v: (-words[v], v), default=None) for w, vs in around.items()}
    form = {w: v if v is not None and words[v] >= 2 * words[w] else None for w, v in form.items()}

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], root(w), n, len(around[w]), words.get(form[w])) for w, n in words.items()}


@pytest.mark.parametrize(("shard", "crowded", "damage"), [(4096, 2048, 97), (16, 5, 3)])
def test_variants_equal_brute_force(spark, shard, crowded, damage):
    rng = np.random.default_rng(crowded)
    letters = list("abé×")
    rows = []
    for i in range(60):
        words = ["".join(rng.choice(letters, rng.integers(3, 9), p=[0.78, 0.14, 0.05, 0.03])) for _ in range(30)]
        rows.append((i, " ".join(w.upper() if k % 3 else w for k, w in enumerate(words * 2)) + ", Straße3straße\nÉtage étage"))
    rows += [(100, None), (101, ""), (102, "aaaaaaa " * 40), (103, ("ab" * 700 + " ") * 5 + ("ab" * 700 + "a ") * 3), (None, "aaaaaaa bbbbbbb 12 日本"), rows[0], rows[0]]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"word": F.lit("clash"), "n": F.lit(1), "length": F.lit(2)})
    got = [tuple(r) for r in spelling_variants.variants(docs, damage=damage, shard=shard, crowded=crowded).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    want = brute_variants(rows, damage)
    assert {r[0]: r[1:] for r in got} == want and len(got) == len(want)
    assert sum(v[0] is not None for v in want.values()) > 5 and any(v[0] is not None and v[0] != v[1] for v in want.values())
    assert spelling_variants.variants(docs.limit(0)).count() == 0


@pytest.mark.parametrize(("shard_rows", "block"), [(10_000, 256), (40, 7)])
def test_exact_search_equals_brute_force(spark, shard_rows, block):
    rng = np.random.default_rng(block)
    x = rng.normal(size=(400, 24)).astype(np.float32) * np.exp(rng.normal(size=(400, 1))).astype(np.float32)
    x[30:160] = x[30]  # a third of all rows share one vector
    x[200:230] = np.round(x[200:230])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(500, None), (550, [float("nan")] * 24), (600, [None] * 24), (650, [1.0] * 23 + [float("inf")]), (700, []), (750, []), (800, [0.0] * 24), (850, [1.0, 2.0]),
             (900, [3e38] * 24), (50, x[50].tolist()), (1000, x[30].tolist())]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumns({"size": F.lit(1), "ids": F.lit("clash"), "v": F.lit(0), "shard": F.lit(9)})
    got: dict[int, list] = {}
    found = exact_search.search(vectors, vectors.where("vec_id % 50 = 0"), shard_rows=shard_rows, block=block)
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    whole = {i: np.floor(256 * np.array(v, np.float64)).astype(object) for i, v in rows if v is not None and i != 900 and all(c is not None and np.isfinite(c) for c in v)}
    want = {}
    for q in (i for i in whole if i % 50 == 0):
        best = sorted((-int(sum(whole[q] * whole[c])), c) for c in whole if c != q and len(whole[c]) == len(whole[q]))[:5]
        if best:
            want[q] = [(k + 1, c, -s) for k, (s, c) in enumerate(best)]
    want = {q: [(k, c, int(s)) for k, c, s in v] for q, v in want.items()}
    assert got == want
    none = vectors.limit(0)
    assert exact_search.search(none, vectors).count() == 0 and exact_search.search(vectors, none).count() == 0


def test_segment_bounds_hold():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(50, 37)), rng.normal(size=(50, 37)) + 1
    before = None
    for cut in exact_search.levels(37):
        bound = (exact_search.statistics(a, cut) * exact_search.statistics(b, cut)).sum(1)
        assert (bound >= (a * b).sum(1) - 1e-9).all() and (before is None or (bound <= before + 1e-9).all())  # ever tighter
        before = bound


def brute_runs(words, least=12):
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i + q - start >= max(least, 2 * q):
                found.setdefault((start, i + q), q)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def flat(texts):
    lengths = np.array([len(t) for t in texts])
    last = np.cumsum(lengths)
    kinds = max([int(max(t, default=0)) + 1 for t in texts])
    words = np.concatenate([np.asarray(t, np.int64) + kinds * k for k, t in enumerate(texts)])
    return words, np.repeat(last, lengths), np.repeat(last - lengths, lengths), last - lengths


@pytest.mark.parametrize("least", [8, 12, 17])
def test_runs_equal_brute_force(least):
    rng = np.random.default_rng(least)
    for _ in range(150):
        texts = []
        for _ in range(rng.integers(1, 6)):
            t = rng.integers(0, rng.integers(1, 5), rng.integers(0, 80))
            if len(t) > 4:
                a = rng.integers(0, len(t))
                t[a:] = t[a + np.arange(len(t) - a) % min(int(rng.integers(1, 14)), len(t) - a)]
            texts.append(np.concatenate([t, t[:rng.integers(0, len(t) + 1)]] * int(rng.integers(1, 3))))
        words, ends, begins, first = flat(texts)
        want = [(s + a, s + a + n, q) for t, a in zip(texts, first) for s, n, q in brute_runs(t.tolist(), least)]
        assert sorted(repeat_runs.runs(words, ends, begins, least)) == sorted(want)


def test_runs_of_long_regular_texts():
    a, b = [0], [0, 1]
    while len(b) < 1500:
        a, b = b, b + a
    for t in (b, [0] * 3000, [0, 1, 2] * 800 + [5] + [0, 1, 2] * 800):
        words, ends, begins, _ = flat([t])
        assert sorted((s, e - s, q) for s, e, q in repeat_runs.runs(words, ends, begins)) == brute_runs(t)


def test_run_documents(spark):
    rng = np.random.default_rng(3)
    words = ["w%d" % k for k in range(50)] + ["é", "日本"]
    rows = [(i, " ".join(rng.choice(words, rng.integers(0, 200)))) for i in range(80)]
    rows += [(1000, None), (1001, ""), (1002, " \t\n\x0b"), (1003, "a " * 50000), (1004, "no break " * 7 + "x\x85y " * 12), (None, "a b " * 9), rows[7], rows[7]]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"runs": F.lit("clash"), "start": F.lit(1), "d": F.lit(2), "best": F.lit(3)})
    found = repeat_runs.summary(repeat_runs.find_runs(docs, plant=True)).collect()
    n_planted, want = 0, []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        h = -1 if i is None else zlib.crc32(str(i).encode())
        if h >= 0 and h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
            n_planted += 1
        runs = brute_runs(w) if len(w) < 1000 else [(0, len(w), 1)]
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        listed = "".join("%d,%d,%d\n" % r for r in sorted(runs, key=lambda r: (r[0], r[2])))
        left = " ".join(x for k, x in enumerate(w) if k not in gone)
        want.append((i, len(runs), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None,
                     hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(left.encode()).hexdigest()))
    assert sorted(map(tuple, found), key=repr) == sorted(want, key=repr) and n_planted > 3
    assert repeat_runs.summary(repeat_runs.find_runs(docs.limit(0))).count() == 0
