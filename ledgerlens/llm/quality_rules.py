"""Quality rules by tokeniser fertility.

A public vocabulary with byte fallback encodes each word of a text; characters
per token, the share of byte tokens and the entropy of the tokens say how
foreign the text is to it. Bands of these three measures per language, from the
measures of all documents (quartiles, counted by Spark), reject what lies far
outside. A few counting rules come first.

Every text with a token is judged, with tolerances that grow as texts get
shorter; entropy is taken from long texts only.

Defined cases: a null or empty text has no words and fails the first rule; an
unknown (null) language is a language of its own; the texts that fail the base
rules don't shape the bands; the fewer texts a language has, the wider its
bands are, and those of other languages never judge it; repeated rows count as often as they occur; an empty table gives an empty
table.
"""

from __future__ import annotations

from array import array
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import col, fresh, keyed, written

# The base rules of the contract.
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
WORDS_LEAST, REPEATED_PERCENT, WINDOW = 10, 20, 5
#: Byte share and entropy may lie so many interquartile ranges outside the quartiles, the range being at least the share given of the median.
REACH, LEAST_RANGE = 4.0, 0.05
#: Characters per token may be this share away from the language's median, or so many times their spread, which falls with the root of the tokens.
NEAR, DEVIATIONS = 0.03, 6.0
#: The spread of characters per token is taken as at least this share of the median, as many copies of one text have none.
SPREAD_LEAST = 0.25
#: A clean text may hold so many tokens of other kinds (a key, numbers, a notice), of about one character each; they weigh much in a
#: short text. The allowance falls over as many tokens to nothing at the second number, as what a longer text holds averages out.
ODD_TOKENS, ODD_END = 60, 160
#: A character makes so many byte tokens at most about, which raises the deviation of their share.
BYTES_TOGETHER = 3
#: Tokens that a text needs for its entropy to be taken; the other two measures judge every text with a token.
TOKENS_LEAST = 100
#: Entropy is taken relative to that of as many different tokens as the text has, or to this many, as it hardly grows in longer texts.
TOKENS_FULL = 1000
CACHE_WORDS = 200_000
MEASURES = ("chars_per_token", "byte_share", "entropy")
BANDS = ("middle", "spread", "most_bytes", "least_entropy", "widened")


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words within windows that occur twice or more, the first occurrence included."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    keys = np.zeros(n, np.uint64)
    for k in range(window):
        keys = keys * np.uint64(0x100000001B3) + mixed[k: k + n]
    order = np.sort(keys)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(keys, twice))
    seen: dict[bytes, list[int]] = {}
    for i in at.tolist():  # equal keys may hide different windows
        seen.setdefault(ids[i: i + window].tobytes(), []).append(i)
    starts = np.array([i for found in seen.values() if len(found) > 1 for i in found], np.int64)
    if not len(starts):
        return 0
    edges = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


class Fertility:
    """Tokens of words under a public vocabulary, with a bounded cache of words."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.model.vocab_size())])
        self.cache: dict[str, bytes] = {}  # ids as 32-bit numbers: a fraction of the memory of lists

    def tokens(self, words: list[str]) -> np.ndarray:
        """Ids of the tokens of all words, in order."""
        cache = self.cache
        lacking = [w for w in set(words) if w not in cache]
        if len(cache) + len(lacking) > CACHE_WORDS:
            cache.clear()
            lacking = list(set(words))
        if lacking:
            cache.update((w, array("I", ids).tobytes()) for w, ids in zip(lacking, self.model.encode(lacking, num_threads=1)))
        return np.frombuffer(b"".join(map(cache.__getitem__, words)), np.uint32)

    def measure(self, words: list[str], chars: int) -> tuple[int, float | None, float | None, float | None]:
        """Tokens, characters per token, share of byte tokens, relative entropy."""
        ids = self.tokens(words)
        if not len(ids):
            return 0, None, None, None
        counts = np.bincount(ids, minlength=len(self.is_byte))
        share = counts[counts > 0] / len(ids)
        entropy = float(-(share * np.log(share)).sum() / np.log(min(len(ids), TOKENS_FULL))) if len(ids) >= TOKENS_LEAST else None
        return len(ids), chars / len(ids), float(counts[self.is_byte].sum() / len(ids)), entropy


@lru_cache(1)
def fertility(path: str) -> Fertility:
    return Fertility(path)


def measures(docs: DataFrame, path: str, doc: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Per row: ``doc``, ``lang``, the counts of the base rules, ``base_failed``, ``n_tokens`` and the measures."""
    import pandas as pd

    kind = dict(docs.select(col(doc).alias("d")).dtypes)["d"]
    names = [doc, "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_tokens", *MEASURES]

    def measure(frames):
        meter = fertility(path)
        for frame in frames:
            rows = []
            for d, lang_, t in zip(frame["d"], frame["l"], frame["t"]):
                words = [w.decode("utf-8", "surrogatepass") for w in t.encode("utf-8", "surrogatepass").split()]  # of bytes: ASCII white space only
                chars = len(t) - sum(map(t.count, SPACES))
                lines = [x for x in t.split("\n") if x.strip(SPACES)]
                numbers: dict[str, int] = {}
                ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
                repeated = repeated_words(ids)
                failed = len(words) < WORDS_LEAST or 100 * repeated > REPEATED_PERCENT * len(words)
                rows.append((d, lang_, len(words), chars, sum(map(t.count, SYMBOLS)), len(lines) - len(set(lines)), repeated, failed, *meter.measure(words, chars)))
            yield pd.DataFrame(rows, columns=names).astype({m: "float64" for m in MEASURES})

    schema = (f"`{doc}` {kind}, lang string, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint,"
              " base_failed boolean, n_tokens bigint, " + ", ".join(f"{m} double" for m in MEASURES))
    return docs.select(col(doc).alias("d"), col(lang).cast("string").alias("l"), F.coalesce(col(text), F.lit("")).alias("t")).mapInPandas(measure, schema)


def widened(texts: Column) -> Column:
    """How much wider than that of many texts the band of so few must be: Student's quantile (by Wallace's formula) over the normal one. One text rejects nothing, itself included."""
    free = F.greatest(texts - 1, F.lit(1)).cast("double")
    scaled = DEVIATIONS * (8 * free + 3) / (8 * free + 1)
    return F.sqrt(free * F.expm1(scaled * scaled / free)) / DEVIATIONS


def bands(measured: DataFrame) -> DataFrame:
    """Per language: the median of characters per token and its spread per root of the tokens, the highest byte share, the lowest entropy, and how much wider few texts make the tolerances."""
    good = measured.where(~F.col("base_failed")).select("lang", "n_tokens", *[F.nanvl(m, F.lit(None).cast("double")).alias(m) for m in MEASURES])
    # a language's bands are a few numbers
    quartiles = {m: F.percentile_approx(m, [0.25, 0.5, 0.75], 10_000) for m in MEASURES}
    reach = {m: F.greatest(q[2] - q[0], LEAST_RANGE * q[1]) * REACH for m, q in quartiles.items()}
    wider = widened(F.count("*"))
    first = written(good.groupBy("lang").agg(
        wider.alias("widened"), quartiles["chars_per_token"][1].alias("middle"),
        (quartiles["byte_share"][2] + F.greatest(reach["byte_share"], F.lit(0.05)) * wider).alias("most_bytes"),
        (quartiles["entropy"][0] - reach["entropy"] * wider).alias("least_entropy")), "quality-middles")
    away = F.abs(F.col("chars_per_token") - F.col("middle")) * F.sqrt("n_tokens")
    spread = good.join(first, good["lang"].eqNullSafe(first["lang"])).groupBy(first["lang"]).agg(
        F.first("middle").alias("middle"), F.greatest(F.percentile_approx(away, 0.5, 10_000) / 0.6745, SPREAD_LEAST * F.first("middle")).alias("spread"),
        F.first("most_bytes").alias("most_bytes"), F.first("least_entropy").alias("least_entropy"), F.first("widened").alias("widened"))
    return spread.select("lang", *BANDS)


def judged(measured: DataFrame) -> DataFrame:
    """``measured`` with ``kept``: passes the base rules and lies within the bands of its language."""
    own = written(bands(measured), "quality-bands").withColumnRenamed("lang", "own_lang")
    joined = measured.join(own, F.col("lang").eqNullSafe(F.col("own_lang")), "left")
    tokens = F.greatest("n_tokens", F.lit(1))
    chance = F.greatest(NEAR * F.col("middle"), DEVIATIONS * F.col("spread") / F.sqrt(tokens))
    odd = F.least(ODD_TOKENS / tokens, F.lit(1.0)) * F.least(F.greatest((ODD_END - tokens) / ODD_TOKENS, F.lit(0.0)), F.lit(1.0)) * F.abs(F.col("middle") - 1)
    near = F.abs(F.col("chars_per_token") - F.col("middle")) <= F.col("widened") * F.hypot(chance, odd)
    # a short text's byte share deviates by chance, as much as tokens in groups of a character's bytes do
    most = F.least(F.col("most_bytes"), F.lit(1.0))
    few_bytes = F.col("byte_share") <= F.col("most_bytes") + F.col("widened") * DEVIATIONS * F.sqrt(most * (1 - most) * BYTES_TOGETHER / tokens)
    verdict = [F.coalesce(x, F.lit(True)) for x in (near, few_bytes, F.col("entropy") >= F.col("least_entropy"))]
    return joined.select(*measured.columns, (~F.col("base_failed") & verdict[0] & verdict[1] & verdict[2]).alias("kept"))


def judge(docs: DataFrame, path: str, doc: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Per row: the measures and ``kept``."""
    return judged(written(measures(docs, path, doc, text, lang), "quality-measures"))


def keep_good(docs: DataFrame, path: str, doc: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``docs`` without the rows that the rules reject; each row is judged by its own text, whatever its id is."""
    rows, key = keyed(docs, "quality-rows")
    rejected = written(judge(rows, path, key, text, lang).where(~F.col("kept")).select(key), "quality-rejected")
    return rows.join(rejected, key, "left_anti").select(*[col(c) for c in docs.columns])
