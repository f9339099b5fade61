"""Quality by compression.

Two zstandard dictionaries, one trained on texts labelled good and one on texts
labelled bad, compress every text in chunks. The difference of the two sizes,
divided by the text's length, says which of the two the text is more like; a
logistic curve fitted on labelled texts that no dictionary has seen turns it
into a score. Only dictionaries and the curve are fitted on a sample, bounded by
``PER_LABEL`` rows and ``SAMPLE_BYTES``; every text is scored whole.

Defined cases: a null or empty text has the difference zero and so the curve's
score there; without labels of both kinds every score is the share of good
ones (a half if there are none); several labels of one document count each;
repeated rows give repeated scores; a row without an id is not held out and has no
label; the sample is taken in the order of the ids' hashes, so that the model does
not depend on how the table lies; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import col

#: Bound of the sample: rows of each label, and bytes of each label that reach the driver at most.
PER_LABEL, SAMPLE_BYTES = 3000, 24_000_000
#: Longer texts are scored like all others but not learned from, so that no single one fills the sample.
LONGEST = 2_000_000
#: Share of the sample that fits the curve instead of the dictionaries.
CURVE_SHARE = 3
DICTIONARY_BYTES, CHUNK, LEVEL = 112_640, 1024, 3
THRESHOLD = 0.3


@dataclass
class Model:
    """Dictionaries and the curve: score = 1 / (1 + exp(-(intercept + slope * difference)))."""

    good: bytes
    bad: bytes
    intercept: float
    slope: float


def held_out(doc: Column) -> Column:
    """Whether a row is in fold 0; one without an id is not, and has no label to learn from either."""
    return F.coalesce(fold(doc) == 0, F.lit(False))


def fold(doc: Column) -> Column:
    """0 to 4, by the CRC-32 of the id as text; fold 0 is held out."""
    return F.pmod(F.crc32(doc.cast("string")), F.lit(5))


def chunks(data: bytes) -> list[bytes]:
    return [data[i:i + CHUNK] for i in range(0, len(data), CHUNK)]


class Scorer:
    """Compressors for the two dictionaries."""

    def __init__(self, good: bytes, bad: bytes):
        import zstandard as z

        self.both = []
        for content in (good, bad):
            made = z.ZstdCompressionDict(content)
            made.precompute_compress(level=LEVEL)
            self.both.append(z.ZstdCompressor(dict_data=made, write_content_size=False, write_checksum=False, write_dict_id=False))

    def difference(self, text: str) -> float:
        """(size with the bad dictionary - size with the good one) / length: positive for texts like good ones."""
        data = text.encode("utf-8", "surrogatepass")
        if not data:
            return 0.0
        good, bad = (sum(len(c.compress(part)) for part in chunks(data)) for c in self.both)
        return (bad - good) / len(data)


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Intercept and slope of a logistic curve, by Newton's method with a small ridge."""
    scale = max(float(x.std()), 1e-9)
    a = np.stack([np.ones(len(x)), x / scale], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag([1e-6, 1e-2]), a.T @ (y - p) - np.array([0, 1e-2]) * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1] / scale)


def sample(docs: DataFrame, labels: DataFrame, doc: str, text: str, label: str, per_label: int) -> DataFrame:
    """``text``, ``label``, ``share`` of the labelled documents outside fold 0 whose ids have the lowest hashes, ``per_label`` of each label at most, in the order of these hashes."""
    ids = docs.where((col(text) != "") & (F.octet_length(col(text)) <= LONGEST)).select(col(doc).alias("doc"))
    known = labels.where(col(label).isin(0, 1) & (fold(col(doc)) != 0)).select(col(doc).alias("doc"), col(label).alias("label"))
    known = known.join(ids, "doc", "left_semi").withColumn("h", F.xxhash64("doc"))
    parts = [known.where(F.col("label") == k).orderBy("h").limit(per_label) for k in (0, 1)]
    chosen = F.broadcast(parts[0].unionAll(parts[1]))  # 2 * per_label rows of an id, a label and a hash
    return docs.select(col(doc).alias("doc"), col(text).alias("text")).join(chosen, "doc").where(
        (F.col("text") != "") & (F.octet_length("text") <= LONGEST)).orderBy("h", "label", F.xxhash64("text")).select(
        "text", "label", F.pmod("h", F.lit(CURVE_SHARE)).alias("share"))


def fit(docs: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text", label: str = "quality", per_label: int = PER_LABEL) -> Model:
    """From the labelled rows outside fold 0."""
    import zstandard as z

    texts: dict[tuple[int, bool], list[bytes]] = {(k, curve): [] for k in (0, 1) for curve in (False, True)}
    room = {0: SAMPLE_BYTES, 1: SAMPLE_BYTES}
    for row in sample(docs, labels, doc, text, label, per_label).toLocalIterator():
        data = row["text"].encode("utf-8", "surrogatepass")
        if room[row["label"]] > 0:  # a text counts whole; the bound stops those after it
            room[row["label"]] -= len(data)
            texts[row["label"], row["share"] == 0].append(data)
    counts = [len(texts[k, False]) + len(texts[k, True]) for k in (0, 1)]
    share = min(max((counts[1] + 0.5) / (sum(counts) + 1), 0.01), 0.99)
    if not all(len(texts[k, curve]) for k in (0, 1) for curve in (False, True)):
        return Model(b"good", b"bad", float(np.log(share / (1 - share))), 0.0)
    made = []
    for k in (1, 0):
        parts = [c for t in texts[k, False] for c in chunks(t)]
        try:
            made.append(z.train_dictionary(DICTIONARY_BYTES, parts).as_bytes())
        except z.ZstdError:  # too little to train on: the texts themselves serve
            made.append(b"".join(parts)[-DICTIONARY_BYTES:])
    scorer = Scorer(*made)
    x = np.array([scorer.difference(t.decode("utf-8", "surrogatepass")) for k in (0, 1) for t in texts[k, True]])
    y = np.array([k for k in (0, 1) for _ in texts[k, True]], float)
    return Model(*made, *_curve(x, y))


def score(docs: DataFrame, model: Model, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``doc``, ``difference``, ``score``."""
    import pandas as pd

    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of a fixed size
    kind = dict(docs.select(col(doc).alias("d")).dtypes)["d"]

    def compress(frames):
        m = shared.value
        scorer = Scorer(m.good, m.bad)
        for frame in frames:
            x = np.array([scorer.difference(t) for t in frame["t"]], float)
            yield pd.DataFrame({doc: frame["d"], "difference": x, "score": 1 / (1 + np.exp(-np.clip(m.intercept + m.slope * x, -30, 30)))})

    return docs.select(col(doc).alias("d"), F.coalesce(col(text), F.lit("")).alias("t")).mapInPandas(
        compress, f"`{doc}` {kind}, difference double, score double")
