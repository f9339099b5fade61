"""Spelling variants of words by a bit-sliced position index.

The words of the corpus are counted, and every word is set against the words
that differ from it by one inserted, deleted or replaced letter. For each
position and letter the index has the set of words with that letter there, as
bits. A word read letter by letter keeps three sets at a time, each updated by a
few word-parallel operations: those that agree so far (``exact``), those with
one letter replaced (``replaced``), and those with one letter more, which are
read one position further on (``longer``). At the end the length tells which
words of these sets are near. A deletion is an insertion seen from the longer
word, so each such pair is found from its shorter word.

The vocabulary grows with the corpus, so it is dealt over shards, each with an
index of its own: if two words are near and ``L`` is the length of the shorter,
they share the first ``L // 2`` letters or else the other ``L - L // 2`` at the
end. So a word meets its near ones under one of its two parts, for ``L`` its own
length and one less. Parts of one ``L`` are dealt over shards by hash; a part
that very many words share is cut into blocks, each an index of its own that all
the part's words are read against. No pair is lost, and only near pairs leave a
shard.

Forms: a word's form is its most frequent near word, if that is at least twice
as frequent. Counts double along a chain of forms, so chains are short; roots
are found by doubling steps, each of them written.

Defined cases: a null or empty text has no words; the planted deletions take a
null document number as an empty one; repeated rows count as often as they
occur; an empty table gives an empty table; other columns are left out.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import col, written

#: Letters of a word, fewest letters, fewest occurrences, how much more frequent a form is.
LETTERS, LEAST_LENGTH, LEAST_COUNT, TIMES = "A-Za-zÀ-ÿ", 5, 3, 2
#: Entries of a shard on average; words of one part above which it is cut into blocks of so many.
SHARD, CROWDED = 4096, 2048
#: Distinct words held by a task before they are passed on; words read together.
HELD, TOGETHER = 200_000, 512


def count_words(docs: DataFrame, doc: str = "doc_id", text: str = "text", damage: int = 0) -> DataFrame:
    """``word``, ``n``: words of ``LEAST_LENGTH`` letters that occur ``LEAST_COUNT`` times.

    ``damage``: where it divides the checksum of document and word, one letter is deleted first, as the contract of the query says; 0 for none.
    """
    import pandas as pd

    def counted(frames):
        import re
        import zlib
        from collections import Counter

        pattern = re.compile(f"[{LETTERS}]+")
        lower = {c: c + 32 for c in range(65, 91)}
        sums: Counter = Counter()

        def flush():
            out = pd.DataFrame({"word": list(sums), "n": list(sums.values())}, columns=["word", "n"])
            sums.clear()
            return out

        for frame in frames:
            for d, t in zip(frame["d"].tolist(), frame["t"].tolist()):
                of: Counter = Counter()
                for run, n in Counter(pattern.findall(t)).items():
                    of[run.lower() if run.isascii() else run.translate(lower)] += n
                start = zlib.crc32(f"{d}:".encode())
                for run, n in of.items():
                    if damage and not (h := zlib.crc32(run.encode(), start)) % damage:
                        at = h % len(run)
                        run = run[:at] + run[at + 1:]
                    if len(run) >= LEAST_LENGTH:
                        sums[run] += n
                if len(sums) > HELD:
                    yield flush()
        yield flush()

    found = docs.select(F.coalesce(col(doc).cast("string"), F.lit("")).alias("d"), F.coalesce(col(text), F.lit("")).alias("t"))
    found = found.mapInPandas(counted, "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def dealt(words: DataFrame, shard: int = SHARD, crowded: int = CROWDED) -> DataFrame:
    """Entries of the shards: ``length`` (of the shorter word), ``shard``, ``block``, ``word``, ``n``, ``held`` (is in the shard's index), ``asked`` (is read against it)."""
    size = F.length("word")
    own = words.select("word", "n", F.explode(F.array(size, size - 1)).alias("length")).where(F.col("length") >= LEAST_LENGTH)
    half = F.floor(F.col("length") / 2).cast("int")
    parts = own.select("word", "n", "length", F.explode(F.array(
        F.concat(F.lit("^"), F.col("word").substr(F.lit(1), half)),
        F.concat(F.col("word").substr(size - (F.col("length") - half) + 1, F.col("length") - half), F.lit("$")))).alias("part"))
    parts = parts.withColumn("asked", size == F.col("length"))
    sums = written(parts.groupBy("length", "part").agg(F.count("*").alias("n")), "variant-parts")
    blocks = sums.where(F.col("n") > crowded).select("length", "part", F.ceil(F.col("n") / crowded).cast("int").alias("blocks"))
    shards = sums.where(F.col("n") <= crowded).groupBy("length").agg(F.ceil(F.sum("n") / shard).cast("int").alias("shards"))
    blocks, shards = written(blocks, "variant-blocks"), written(shards, "variant-shards")
    few = parts.join(blocks, ["length", "part"], "left_anti").join(shards, "length")
    few = few.select("length", F.concat(F.lit("few "), F.pmod(F.xxhash64("part"), F.col("shards")).cast("string")).alias("shard"), F.lit(0).alias("block"),
                     "word", "n", F.lit(True).alias("held"), "asked")
    many = parts.join(blocks, ["length", "part"]).withColumn("home", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
    many = many.withColumn("block", F.explode(F.when(F.col("asked"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("home"))))
    many = many.select("length", F.col("part").alias("shard"), "block", "word", "n", (F.col("home") == F.col("block")).alias("held"), "asked")
    return few.unionByName(many)


def _bits(there: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words."""
    packed = np.packbits(there, axis=-1, bitorder="little")
    room = -packed.shape[-1] % 8
    return np.ascontiguousarray(np.pad(packed, [(0, 0)] * (packed.ndim - 1) + [(0, room)])).view(np.uint64)


def _members(sets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, member) of rows of 64-bit words."""
    row, word = np.nonzero(sets)
    bits = np.unpackbits(sets[row, word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    k, bit = np.nonzero(bits)
    return row[k], word[k] * 64 + bit


def near(held: list[str], asked: list[str], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(asked word, held word) of the near pairs. Asked words have ``length`` letters, held ones as many or one more."""
    index = np.array(held, f"U{length + 1}").view(np.uint32).reshape(len(held), length + 1)
    sizes = np.array([len(w) for w in held])
    letters, code = np.unique(index, return_inverse=True)
    code = code.reshape(index.shape)
    same, more = _bits(sizes == length), _bits(sizes == length + 1)
    out = []
    read = np.array(asked, f"U{length}").view(np.uint32).reshape(len(asked), length)
    slot = np.minimum(np.searchsorted(letters, read), len(letters) - 1)
    slot = np.where(letters[slot] == read, slot, len(letters))  # a letter that no held word has
    kinds = np.arange(len(letters) + 1)[:, None]
    for lo in range(0, len(asked), TOGETHER):
        part = slot[lo:lo + TOGETHER]
        exact = np.full((len(part), same.shape[-1]), ~np.uint64(0))
        replaced, longer = np.zeros_like(exact), exact.copy()
        ahead = _bits(kinds == code[:, 0])
        for i in range(length):
            here, ahead = ahead, _bits(kinds == code[:, i + 1])
            fits = here[part[:, i]]
            replaced = replaced & fits | exact & ~fits
            exact &= fits
            longer = longer & ahead[part[:, i]] | exact
        for found in (replaced & same, longer & more):
            a, b = _members(found)
            out.append((a + lo, b))
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def near_pairs(words: DataFrame, shard: int = SHARD, crowded: int = CROWDED) -> DataFrame:
    """``word``, ``n``, ``near``, ``near_n``: every near pair of ``words`` (``word``, ``n``), both ways."""
    import pandas as pd

    def met(key, frame):
        frame = frame.groupby("word", as_index=False).agg({"n": "first", "held": "any", "asked": "any"})
        held, asked = frame[frame["held"]], frame[frame["asked"]]
        if not len(held) or not len(asked):
            return pd.DataFrame(columns=["word", "n", "near", "near_n"])
        a, b = near(held["word"].tolist(), asked["word"].tolist(), int(key[0]))
        u, v = asked.iloc[a].reset_index(drop=True), held.iloc[b].reset_index(drop=True)
        one = pd.DataFrame({"word": u["word"], "n": u["n"], "near": v["word"], "near_n": v["n"]})
        back = one.rename(columns={"word": "near", "n": "near_n", "near": "word", "near_n": "n"})
        return pd.concat([one, back])[["word", "n", "near", "near_n"]].drop_duplicates()

    entries = dealt(words, shard, crowded)
    return entries.groupBy("length", "shard", "block").applyInPandas(met, "word string, n bigint, near string, near_n bigint").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """``word``, ``root`` for every word of ``forms`` (``word``, ``form``): the end of its chain of forms."""
    found = written(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "variant-roots")
    while found.where("moved").limit(1).count():
        onward = found.select(F.col("word").alias("root"), F.col("root").alias("further"))
        found = written(found.drop("moved").join(onward, "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "variant-roots")
    return found.drop("moved")


def variants(docs: DataFrame, doc: str = "doc_id", text: str = "text", damage: int = 0, shard: int = SHARD, crowded: int = CROWDED) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n`` of every word of the corpus."""
    words = written(count_words(docs, doc, text, damage), "variant-words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best")
    around = near_pairs(words, shard, crowded).groupBy("word", "n").agg(F.count("*").alias("n_near"), best)
    is_form = -F.col("best.less") >= TIMES * F.col("n")
    around = written(around.select("word", "n_near", F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n")), "variant-forms")
    ends = roots(around.where("form is not null"))
    return words.join(around, "word", "left").join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), "form_n")
