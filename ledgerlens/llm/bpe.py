"""Byte-level BPE without a regular expression.

Pre-tokenisation is vectorised over a batch of texts: code points become
classes (a table lookup), each class is a transition function on the eight
states of the splitting automaton, and an associative scan composes the
functions. The functions that can occur form a small monoid, so that composing
two of them is one lookup in a table. The state before each code point and its
class say whether a token starts there. The slices then feed pair merging with
a bounded cache; byte offsets per token are kept for decoding.

Defined cases: a null or empty text has no tokens; texts of any length work
(pair merging is n log n in a slice); repeated rows give repeated results; an
empty table gives an empty table.
"""

from __future__ import annotations

import base64
import heapq
import sys
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np

# Classes of code points. An apostrophe that begins a contraction is ONE ('s) or TWO ('re); the last white space before a
# non-space joins what follows (SPACE) or stands alone (LONE); other white space is RUN. BREAK stands between texts.
LETTER, NUMBER, OTHER, ONE, TWO, SPACE, LONE, RUN, BREAK = range(9)
# States: what the code point before belongs to. CLOSED: nothing that could go on; PREFIX: a space that takes what follows;
# C1, C2: a contraction with so many letters to come.
CLOSED, IN_LETTERS, IN_NUMBERS, IN_OTHERS, PREFIX, IN_RUN, C1, C2 = range(8)
STATES = 8


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """next[class][state], starts[class][state]."""
    nxt = np.zeros((9, STATES), np.uint8)
    starts = np.ones((9, STATES), bool)
    for kind, into in ((LETTER, IN_LETTERS), (NUMBER, IN_NUMBERS), (OTHER, IN_OTHERS), (ONE, C1), (TWO, C2), (SPACE, PREFIX), (LONE, CLOSED), (RUN, IN_RUN)):
        nxt[kind] = into
    for kind in (LETTER, NUMBER, OTHER):
        starts[kind, [nxt[kind, 0], PREFIX]] = False
    for kind in (ONE, TWO):  # after a space or within other signs the apostrophe is one of them
        nxt[kind, [IN_OTHERS, PREFIX]] = IN_OTHERS
        starts[kind, [IN_OTHERS, PREFIX]] = False
    nxt[LETTER, C1], nxt[LETTER, C2] = CLOSED, C1
    starts[LETTER, [C1, C2]] = False
    starts[RUN, IN_RUN] = False
    nxt[BREAK] = CLOSED
    starts[BREAK] = True
    return nxt, starts


@lru_cache(1)
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """id of each class's function, compose[first * 16 + second], what each function makes of each state."""
    nxt, _ = _automaton()
    functions = [tuple(map(int, f)) for f in nxt]
    known: dict[tuple[int, ...], int] = {tuple(range(STATES)): 0}
    for f in functions:
        known.setdefault(f, len(known))
    grown = True
    while grown:
        grown = False
        for f in list(known):
            for g in functions:
                h = tuple(g[x] for x in f)
                if h not in known:
                    known[h] = len(known)
                    grown = True
    n, order = len(known), list(known)
    assert n <= 16, n
    compose = np.zeros((16, 16), np.uint8)
    for i, f in enumerate(order):
        for j, g in enumerate(order):
            compose[i, j] = known[tuple(g[x] for x in f)]
    return np.array([known[f] for f in functions], np.uint8), compose.ravel(), np.array(order, np.uint8)


def _scan(ids: np.ndarray, width: int = 256) -> np.ndarray:
    """Exclusive prefix compositions, as ids of functions: blocks are reduced side by side, then the blocks' totals, then down again."""
    compose = _monoid()[1]
    size = len(ids)
    if size <= width:
        out = np.empty(size, np.uint8)
        acc = 0
        for i, x in enumerate(ids.tolist()):
            out[i] = acc
            acc = int(compose[acc * 16 + x])
        return out
    rows = -(-size // width)
    block = np.zeros(rows * width, np.uint8)
    block[:size] = ids
    block = np.ascontiguousarray(block.reshape(rows, width).T)
    acc = np.zeros(rows, np.uint8)
    for x in block:
        acc = compose[(acc << 4) | x]
    acc = _scan(acc, width)
    out = np.empty_like(block)
    for i, x in enumerate(block):
        out[i] = acc
        acc = compose[(acc << 4) | x]
    return np.ascontiguousarray(out.T).ravel()[:size]


@lru_cache(1)
def _classes() -> np.ndarray:
    """LETTER, NUMBER, OTHER or RUN (white space) of every code point, asked once from the library whose splits are to be met, so that its version of Unicode holds."""
    import tiktoken

    table = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    every = "".join(map(chr, chain(range(0xD800), range(0xE000, sys.maxunicode + 1))))
    for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", RUN)):
        only = tiktoken.Encoding(pattern, pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        table[np.frombuffer(bytes(only.encode_ordinary(every)).decode().encode("utf-32-le"), "<u4")] = kind
    return table


def token_starts(texts: list[str]) -> list[np.ndarray]:
    """For each text, the code points at which its pre-tokens start."""
    joined = "\x00".join(texts) + "\x00"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    kinds = _classes()[points]
    kinds[ends] = BREAK
    white = kinds == RUN
    follows = np.empty_like(kinds)
    follows[:-1], follows[-1] = kinds[1:], BREAK
    last = white & (follows != RUN) & (follows != BREAK)
    for at in np.flatnonzero(points == 39):
        a = points[at + 1: at + 3]
        if kinds[at] == BREAK or at + 1 >= len(points) or kinds[at + 1] == BREAK:
            continue
        if a[0] in (115, 116, 109, 100):  # s t m d
            kinds[at] = ONE
        elif len(a) == 2 and kinds[at + 2] != BREAK and (int(a[0]), int(a[1])) in ((114, 101), (118, 101), (108, 108)):  # re ve ll
            kinds[at] = TWO
    kinds[last] = np.where(points[last] == 32, SPACE, LONE)
    ids, _, images = _monoid()
    before = images[_scan(ids[kinds]), CLOSED]
    _, starts = _automaton()
    at = np.flatnonzero(starts[kinds, before] & (kinds != BREAK))
    cuts = np.searchsorted(at, ends)
    begins = ends - np.array([len(t) for t in texts])
    return [at[lo:hi] - first for lo, hi, first in zip(chain([0], cuts[:-1]), cuts, begins)]


#: Rank of a pair that is no token, and the length in bytes from which slices are merged one by one.
NONE, LONG = 1 << 30, 64


class Vocabulary:
    """Ranks of a public vocabulary file; encodes slices by merging and decodes ids."""

    def __init__(self, path: str, cache_slices: int = 400_000):
        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.bytes = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.bytes[rank] = token
        self.sizes = np.array(list(map(len, self.bytes)), np.int64)
        self.words = list(map(str, range(len(self.bytes))))
        self.single = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self._pairs()
        self.cache: dict[str, tuple[int, ...]] = {}
        self.cache_slices = cache_slices

    def _pairs(self) -> None:
        """All pairs of tokens that together are a token, sorted by pair, for lookups of many pairs at once."""
        ranks, get = self.ranks, self.ranks.get
        found = [(left * len(self.bytes) + right, rank) for token, rank in ranks.items() for i in range(1, len(token))
                 if (left := get(token[:i])) is not None and (right := get(token[i:])) is not None]
        keys, into = np.array(found, np.int64).T
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = np.append(keys[order], np.iinfo(np.int64).max), np.append(into[order], NONE).astype(np.int32)

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) * len(self.bytes) + b
        at = np.searchsorted(self.pair_keys, key)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NONE)

    def merge_all(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of slices: in each round, every slice's pair of lowest rank, the leftmost first, becomes one token."""
        out: list[tuple[int, ...]] = [()] * len(pieces)
        short = []
        for i, p in enumerate(pieces):
            if (rank := self.ranks.get(p)) is not None:
                out[i] = (rank,)
            elif len(p) >= LONG:
                out[i] = self._merge_long(self.single[np.frombuffer(p, np.uint8)].tolist())
            elif p:
                short.append(i)
        if not short:
            return out
        which = np.array(short)
        sizes = np.array([len(pieces[i]) for i in short])
        ids = self.single[np.frombuffer(b"".join([pieces[i] for i in short]), np.uint8)]
        ranks = np.full(len(ids), NONE, np.int32)
        ranks[:-1] = self.pair_rank(ids[:-1], ids[1:])
        ranks[np.cumsum(sizes) - 1] = NONE
        while len(which):
            first = np.cumsum(sizes) - sizes
            own = np.repeat(np.arange(len(sizes)), sizes)
            least = np.minimum.reduceat(ranks, first)
            done = least == NONE
            if done.any():
                kept = ~done[own]
                for k in np.flatnonzero(done):
                    out[which[k]] = tuple(ids[first[k]: first[k] + sizes[k]].tolist())
                ids, ranks, which, sizes, least = ids[kept], ranks[kept], which[~done], sizes[~done], least[~done]
                if not len(which):
                    break
                first = np.cumsum(sizes) - sizes
                own = np.repeat(np.arange(len(sizes)), sizes)
            at = np.flatnonzero(ranks == least[own])
            at = at[np.append(True, own[at][1:] != own[at][:-1])]
            ids[at] = least
            gone = np.zeros(len(ids), bool)
            gone[at + 1] = True
            after = at + 2
            inside = after < first + sizes
            ranks[at] = NONE
            ranks[at[inside]] = self.pair_rank(ids[at[inside]], ids[after[inside]])
            left = at > first
            ranks[at[left] - 1] = self.pair_rank(ids[at[left] - 1], ids[at[left]])
            ids, ranks, sizes = ids[~gone], ranks[~gone], sizes - 1
        return out

    def _merge_long(self, ids: list[int]) -> tuple[int, ...]:
        """One slice, with a heap of pairs over a linked list."""
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        known: dict[tuple[int, int], int] = {}

        def rank_of(a: int, b: int) -> int:
            if (a, b) not in known:
                known[a, b] = self.ranks.get(self.bytes[a] + self.bytes[b], NONE)
            return known[a, b]

        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank_of(ids[i], ids[i + 1])) < NONE]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j] = rank, False
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < n and (r := rank_of(ids[left], ids[right])) < NONE:
                    heapq.heappush(heap, (r, left, ids[left], ids[right]))
        return tuple(x for x, ok in zip(ids, alive) if ok)

    def encode(self, texts: list[str]) -> Iterator[array]:
        """Ids of each text; slices that the bounded cache lacks are merged together."""
        cache, cut = self.cache, []
        for text, starts in zip(texts, token_starts(texts)):
            at = starts.tolist()
            cut.append([text[a:b] for a, b in zip(at, chain(at[1:], (len(text),)))])
        lacking = {p for pieces in cut for p in pieces if p not in cache}
        if len(cache) + len(lacking) > self.cache_slices:
            cache.clear()
            lacking = {p for pieces in cut for p in pieces}
        if lacking:
            order = list(lacking)
            cache.update(zip(order, self.merge_all([p.encode("utf-8", "surrogatepass") for p in order])))
        for pieces in cut:
            yield array("I", chain.from_iterable(map(cache.__getitem__, pieces)))

    def offsets(self, ids) -> np.ndarray:
        """Byte offset of each token and, last, the length in bytes."""
        return np.append(0, np.cumsum(self.sizes[np.asarray(ids, np.int64)]))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


def batches(texts: list[str], points: int = 1_000_000) -> Iterator[list[int]]:
    """Positions of texts, so many at a time that about ``points`` code points are together."""
    now, size = [], 0
    for i, t in enumerate(texts):
        if now and size + len(t) > points:
            yield now
            now, size = [], 0
        now.append(i)
        size += len(t)
    if now:
        yield now


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    """One per worker process and file, so that the cache lasts over batches."""
    return Vocabulary(path)


def encode_documents(docs, path: str, doc: str = "doc_id", text: str = "text", offsets: bool = False, digests: bool = False):
    """Per row: ``doc``, ``n_tokens``, ``ids`` (array<int>) and, if asked for, ``offsets`` (array<long>: where each token starts in the
    UTF-8 bytes, and their number). With ``digests`` the columns ``ids_sha256`` and ``decoded_sha256`` take the place of the arrays, so that they needn't leave the task.
    """
    import hashlib

    import pandas as pd
    from pyspark.sql import functions as F

    from ledgerlens.llm.common import col

    kind = dict(docs.select(col(doc).alias("d")).dtypes)["d"]
    schema = f"`{doc}` {kind}, n_tokens bigint, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>" + ", offsets array<bigint>" * offsets)

    def encode(frames):
        vocab = vocabulary(path)
        for frame in frames:
            texts = frame["t"].fillna("").tolist()
            for part in batches(texts):
                rows = []
                for i, ids in zip(part, vocab.encode([texts[i] for i in part])):
                    if digests:
                        told = hashlib.sha256(" ".join(map(vocab.words.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(vocab.decode(ids)).hexdigest()
                    else:
                        told = (np.frombuffer(ids, np.uint32).astype(np.int32),) + ((vocab.offsets(ids),) if offsets else ())
                    rows.append((frame["d"].iat[i], len(ids), *told))
                yield pd.DataFrame(rows, columns=schema_names)

    schema_names = [doc, "n_tokens", *(("ids_sha256", "decoded_sha256") if digests else ("ids",) + ("offsets",) * offsets)]
    return docs.select(col(doc).alias("d"), F.coalesce(col(text), F.lit("")).alias("t")).mapInPandas(encode, schema)


def decode_documents(encoded, path: str, doc: str = "doc_id", ids: str = "ids"):
    """``doc``, ``bytes``: the bytes that ids stand for."""
    import pandas as pd
    from ledgerlens.llm.common import col

    kind = dict(encoded.select(col(doc).alias("d")).dtypes)["d"]

    def decode(frames):
        vocab = vocabulary(path)
        for frame in frames:
            yield pd.DataFrame({doc: frame["d"], "bytes": [vocab.decode(x.tolist()) if x is not None else None for x in frame["i"]]})

    return encoded.select(col(doc).alias("d"), col(ids).alias("i")).mapInPandas(decode, f"`{doc}` {kind}, bytes binary")
