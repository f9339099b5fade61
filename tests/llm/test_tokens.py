"""Byte-level BPE, packing and their brute-force counterparts."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from ledgerlens.llm import bpe, packing

RANKS, JSON = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [None, "", " ", "a", "it's they're  x\n\n y", "Straße 日本 🙂 é", "don't 'sx''s \t\r\n'll", "a" * 3000, "word " * 900, "it's they're  x\n\n y", "<|endoftext|>"]


@pytest.fixture(scope="module")
def reference():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def docs_of(spark, texts, extra=True):
    rows = [(i, t, "src", "en", i * 2, 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string, n_tokens int, ids int").select(
        "doc_id", "text", "source", "lang", *(["n_tokens", "ids"] if extra else []))


def test_splits_and_merges_equal_the_library(reference):
    random.seed(3)
    signs = "aZ é9٣' \n\t 　.#'sтrevlmd日🙂\r\x1c\x85\x00"
    texts = ["".join(random.choices(signs, k=random.randint(0, 30))) for _ in range(4000)] + [t or "" for t in TEXTS]
    vocab = bpe.Vocabulary(RANKS, cache_slices=500)  # so small that it is emptied on the way
    for part in bpe.batches(texts, 2000):
        for i, ids in zip(part, vocab.encode([texts[i] for i in part])):
            assert list(ids) == reference.encode_ordinary(texts[i]), texts[i]
            assert vocab.decode(ids) == texts[i].encode()
            assert vocab.offsets(ids)[-1] == len(texts[i].encode())


def test_scan_equals_one_step_after_the_other():
    ids, compose, images = bpe._monoid()
    kinds = np.random.default_rng(0).integers(0, 9, 200_000)
    state, expected = 0, []
    nxt, _ = bpe._automaton()
    for k in kinds[:3000]:
        expected.append(state)
        state = nxt[k][state]
    assert images[bpe._scan(ids[kinds]), 0][:3000].tolist() == expected


def test_encode_documents(spark, reference):
    docs = docs_of(spark, TEXTS)
    got = {r["doc_id"]: r for r in bpe.encode_documents(docs, RANKS, digests=True).collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        ids = reference.encode_ordinary(t or "")
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    encoded = bpe.encode_documents(docs, RANKS, offsets=True)
    back = {r["doc_id"]: bytes(r["bytes"]).decode() for r in bpe.decode_documents(encoded, RANKS).collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}
    assert bpe.encode_documents(docs.limit(0), RANKS).count() == 0


def test_packing_ids_are_those_of_the_tokenizers_library():
    t = Tokenizer.from_file(JSON)
    mine = packing.tokenizer(JSON)
    random.seed(5)
    parts = ["<|endoftext|>", "<|endoftext", "|>", " ", "  ", "\n", "a", " b", "é", "日", "'s", "12"]
    texts = TEXTS + ["a <|endoftext|> b"] + ["".join(random.choices(parts, k=random.randint(0, 12))) for _ in range(2000)]
    for text in texts:
        assert mine.encode(text or "", allowed_special="all") == t.encode(text or "", add_special_tokens=False).ids
    assert mine.encode("a <|endoftext|> b", allowed_special="all") == [64, 220, 50256, 275]


@pytest.mark.parametrize("seed", range(4))
def test_solution_holds_the_histogram(seed):
    rng = np.random.default_rng(seed)
    lengths = np.concatenate([rng.integers(1, 1024, 300), rng.integers(1, 80, 300), [1024] * 5, [700] * 200])
    histogram = {int(s): int(n) for s, n in zip(*np.unique(lengths, return_counts=True))}
    solution, placed = packing.solve(histogram)
    held: dict[int, int] = {}
    for config, times in solution:
        assert sum(s * k for s, k in config) <= 1024
        for s, k in config:
            held[s] = held.get(s, 0) + k * times
    assert held == histogram
    plain = sum(t for _, t in packing.best_fit(dict(histogram), 1024))
    assert sum(t for _, t in solution) <= plain and 0 <= placed <= sum(histogram.values())


def test_the_program_places_the_pieces_of_a_dense_histogram():
    lengths, counts = np.unique(np.random.default_rng(1).integers(1, 1025, 20_000), return_counts=True)
    histogram = {int(s): int(n) for s, n in zip(lengths, counts)}
    solution, placed = packing.solve(histogram)
    assert placed >= 0.9 * 20_000 and sum(t for _, t in solution) <= sum(t for _, t in packing.best_fit(dict(histogram), 1024))


def fewest(pieces, size):
    """Optimum by trying every way."""
    best = len(pieces)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(pieces):
            best = len(rooms)
            return
        for k in range(len(rooms)):
            if rooms[k] >= pieces[i] and rooms[k] not in rooms[:k]:
                go(i + 1, rooms[:k] + [rooms[k] - pieces[i]] + rooms[k + 1:])
        go(i + 1, rooms + [size - pieces[i]])

    go(0, [])
    return best


def test_small_solutions_against_the_optimum():
    rng = np.random.default_rng(7)
    exact = 0
    for _ in range(60):
        pieces = sorted(rng.integers(1, 21, rng.integers(0, 11)).tolist(), reverse=True)
        histogram = {s: pieces.count(s) for s in pieces}
        got = sum(t for _, t in packing.solve(histogram, 20)[0])
        best = fewest(pieces, 20)
        assert best <= got <= sum(t for _, t in packing.best_fit(dict(histogram), 20))
        exact += got == best
    assert exact >= 57
    assert packing.solve({}) == ([], 0) and packing.solve({1024: 3}) == ([(((1024, 1),), 3)], 3) and packing.solve({7: 1})[0] == [(((7, 1),), 1)]


def test_knapsack_equals_trying_everything():
    sizes, prices = np.array([3, 5, 7, 20]), np.array([1.0, 2.1, 3.0, 9.5])
    best, take = packing.knapsack(sizes, prices, 30)
    every = [0.0] * 31
    for c in range(1, 31):
        every[c] = max([every[c - 1], *(every[c - s] + p for s, p in zip(sizes, prices) if s <= c)])
    assert np.allclose(best, every)
    config = packing.trace(take, 30, {})
    assert np.isclose(sum(k * prices[list(sizes).index(s)] for s, k in config), every[30])


def test_packed_documents(spark):
    texts = TEXTS + ["copy of one text"] * 400 + ["x y z " * n for n in range(40)]
    docs = docs_of(spark, texts)
    found = packing.pieces(docs, JSON, size=64, ids=True)
    packed = packing.pack(found, size=64)
    rows = packed.collect()
    enc = packing.tokenizer(JSON)
    by_doc: dict[int, list] = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"]
    for i, t in enumerate(texts):
        ids = [*enc.encode(t or "", allowed_special="all"), 2]
        parts = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [x for r in parts for x in r["ids"]] == ids
        assert [r["start"] for r in parts] == list(np.cumsum([0, *(r["length"] for r in parts)]))[:-1]
        assert all(r["length"] == 64 for r in parts[1:]) and (len(parts) == 1) == (len(ids) <= 64)
    sequences = {r["sequence_id"]: r["ids"] for r in packing.sequences(packed).collect()}
    for s, ids in sequences.items():
        inside = sorted((r["offset"], r["length"]) for r in rows if r["sequence_id"] == s)
        assert [o for o, _ in inside] == list(np.cumsum([0, *(n for _, n in inside)]))[:-1] and len(ids) <= 64
    assert packing.pack(packing.pieces(docs.limit(0), JSON)).count() == 0
