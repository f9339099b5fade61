"""Secrets in text: fixed patterns, and character Markov models for the rest.

Two first-order models over the characters that tokens are made of, one of
random strings and one of ordinary identifiers, are trained from labelled
samples: the values that the fixed patterns find are random strings, all other
tokens of the corpus are ordinary. Transitions are counted in every document by
Spark (at most two square tables, whatever the input). A token that the fixed
patterns don't cover is a secret if the log-likelihood ratio of the two models
is high, in all and per character.

Defined cases: a null or empty text has no secrets; matches of one kind don't
overlap, those of different kinds may; repeated rows give repeated results;
without any sample the random model is uniform; an empty table gives an empty
table.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import col

KINDS = ("assign", "access", "hex", "model")
# The patterns of the contract, with the failing matches left out by their own lengths.
ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
#: Tokens that the models judge: shorter ones hold too little to tell.
TOKEN_LEAST = 16
TOKEN = re.compile(rf"[A-Za-z0-9+/_=-]{{{TOKEN_LEAST},}}")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
STATES = len(ALPHABET) + 1  # 0: not of a token
CLASS_OF = bytes(ALPHABET.find(chr(b)) + 1 if chr(b) in ALPHABET else 0 for b in range(256))
#: Log-likelihood ratio a token needs, in nats: in all and per character.
LEAST_TOTAL, LEAST_PER_CHAR = 30.0, 2.0
#: Share of the random model that is uniform, as samples are few kinds of secret out of many.
UNIFORM = 0.3
#: Occurrences that the distribution of single characters counts as, in each row of a model.
BACK_OFF = 5.0


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the value), leftmost non-overlapping per kind, in code points."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    out += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return out


def _codes(classes: bytes) -> np.ndarray:
    """Pairs of neighbouring classes, from before the first to after the last."""
    c = np.frombuffer(b"\0" + classes + b"\0", np.uint8).astype(np.int32)
    return c[:-1] * STATES + c[1:]


def train(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Log-likelihood ratio (random over ordinary) of each pair of classes."""
    def count(frames):
        for frame in frames:
            sums = np.zeros((2, STATES * STATES), np.int64)
            for t in frame["t"]:
                spans = base_spans(t)
                if spans:  # values are samples of the one class, what is around them of the other
                    rest, at = [], 0
                    for start, _, end, value in sorted(spans):
                        sums[1] += np.bincount(_codes(t[value:end].encode("ascii", "replace").translate(CLASS_OF)), minlength=STATES * STATES)
                        rest.append(t[at:start])
                        at = max(at, end)
                    t = " ".join([*rest, t[at:]])
                coded = t.encode("latin-1", "replace").translate(CLASS_OF)
                for lo in range(0, len(coded), 1 << 20):
                    sums[0] += np.bincount(_codes(coded[lo:lo + (1 << 20)]), minlength=STATES * STATES)
            label, pair = np.nonzero(sums)
            yield pd.DataFrame({"label": label.astype(np.int32), "pair": pair.astype(np.int32), "n": sums[label, pair]})

    counted = docs.select(F.coalesce(col(text), F.lit("")).alias("t")).mapInPandas(count, "label int, pair int, n bigint")
    sums = np.zeros((2, STATES, STATES))
    for r in counted.groupBy("label", "pair").agg(F.sum("n").alias("n")).collect():  # 2 * STATES ** 2 rows at most
        sums[r["label"], r["pair"] // STATES, r["pair"] % STATES] = r["n"]
    sums[:, 0, 0] = 0  # between tokens
    single = sums.sum(1, keepdims=True) + 0.1
    backed = sums + BACK_OFF * single / single.sum(2, keepdims=True)  # what a model hasn't seen follows single characters
    flat = backed / backed.sum(2, keepdims=True)
    random = (1 - UNIFORM) * flat[1] + UNIFORM / STATES if sums[1].sum() else np.full((STATES, STATES), 1 / STATES)
    return np.log(random / flat[0])


def model_spans(text: str, ratios: np.ndarray, taken: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of tokens that look random and touch no span of ``taken``."""
    out = []
    for m in TOKEN.finditer(text):
        lo, hi = m.span()
        if any(a < hi and lo < b for a, b in taken):
            continue
        total = float(ratios[_codes(m[0].encode().translate(CLASS_OF))].sum())
        if total >= LEAST_TOTAL and total >= LEAST_PER_CHAR * (hi - lo):
            out.append((lo, 3, hi))
    return out


def scan(docs: DataFrame, doc: str = "doc_id", text: str = "text", ratios: np.ndarray | None = None) -> DataFrame:
    """Per row: ``doc``, ``spans`` (array of kind, start, end, by start, then kind as listed)."""
    flat = docs.sparkSession.sparkContext.broadcast((train(docs, text) if ratios is None else ratios).ravel())
    kind = dict(docs.select(col(doc).alias("d")).dtypes)["d"]

    def find(frames):
        for frame in frames:
            rows = []
            for t in frame["t"]:
                base = [s[:3] for s in base_spans(t)]
                every = sorted(base + model_spans(t, flat.value, [(s, e) for s, _, e in base]))
                rows.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in every])
            yield pd.DataFrame({doc: frame["d"], "spans": rows})

    return docs.select(col(doc).alias("d"), F.coalesce(col(text), F.lit("")).alias("t")).mapInPandas(
        find, f"`{doc}` {kind}, spans array<struct<kind: string, start: bigint, end: bigint>>")


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]", ratios: np.ndarray | None = None) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``mark``; spans that overlap become one. Null stays null."""
    from pyspark.sql.functions import pandas_udf

    flat = docs.sparkSession.sparkContext.broadcast((train(docs, text) if ratios is None else ratios).ravel())

    def clean(t):
        if not t:
            return t
        base = [(s, e) for s, _, e, _ in base_spans(t)]
        out, at = [], 0
        for lo, hi in sorted(base + [(s, e) for s, _, e in model_spans(t, flat.value, base)]):
            if lo >= at:
                out += [t[at:lo], mark]
            at = max(at, hi)
        return "".join([*out, t[at:]]) if out else t

    @pandas_udf("string")
    def redacted(texts: pd.Series) -> pd.Series:
        return texts.map(clean, na_action="ignore")

    return docs.withColumn(text, redacted(col(text)))
