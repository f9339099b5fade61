"""Near copies by 64-bit SimHash, candidates filtered by the pigeonring principle.

A fingerprint is a ring of ``SEGMENTS`` segments. If two fingerprints differ in
at most ``BUDGET`` bits, some segment starts a chain in which, for every length,
the differences added up so far stay within their share of the budget
(``length * BUDGET / SEGMENTS``). With seven segments and three bits the first
two segments of that chain are equal, the first four differ in at most one bit,
and so on round the ring. Equal first two segments are the join key; the whole
chain condition prunes before the full Hamming check.

Equal fingerprints are one class from the start, so copies are never paired.
Keys that many fingerprints share are refined by the chain's next budget: of
the following two segments at most one bit differs, so two such fingerprints
agree in one of the variants with one bit masked. No candidate is lost.

Defined cases: a null or empty text, or one of white space, has fingerprint
zero, which is linked like any other; fewer words than a shingle make one
shingle; repeated rows of one id are copies of each other; an empty table gives
an empty table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import col, keyed, written
from ledgerlens.llm.components import components

WORDS, SEED, BITS, BUDGET = 3, 42, 64, 3
#: First bits of the ring's segments; the last ends at BITS.
CUTS = (0, 9, 18, 27, 36, 45, 54)
SEGMENTS = len(CUTS)
#: Bits of the widest two neighbouring segments.
NEXT_BITS = 19
#: Fingerprints of one key compared with each other directly; above, the key is refined.
DIRECT = 64


def fingerprints(docs: DataFrame, doc: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """``doc``, ``fp`` (long holding the 64 bits)."""
    import pandas as pd
    from pyspark.sql.types import LongType, StructField, StructType

    kind = docs.select(col(doc).alias(doc)).schema[0]

    def hashed(frames):
        import numpy as np
        from xxhash import xxh64_intdigest

        shifts = np.arange(BITS, dtype=np.uint64)

        def fingerprint(t: str) -> int:
            found = t.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
            if not found:
                return 0
            if len(found) <= words:
                return xxh64_intdigest(b" ".join(found), SEED)
            joined = b" ".join(found)
            ends, at = [], -1
            for w in found:
                at += len(w) + 1
                ends.append(at)
            begins = [0, *[e + 1 for e in ends]]
            h = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(begins, ends[words - 1:])], np.uint64)
            ones = np.zeros(BITS, np.int64)
            for lo in range(0, len(h), 65536):  # bounded memory for texts of any length
                part = h[lo:lo + 65536]
                ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            return int((np.uint64(1) << shifts)[2 * ones > len(h)].sum(dtype=np.uint64))

        for frame in frames:
            fp = np.array([fingerprint(t) for t in frame["t"].fillna("")], np.uint64).view(np.int64)
            yield pd.DataFrame({doc: frame["d"], "fp": fp})

    schema = StructType([kind, StructField("fp", LongType())])
    return docs.select(col(doc).alias("d"), F.coalesce(col(text), F.lit("")).alias("t")).mapInPandas(hashed, schema)


def _segment(fp: Column, i: int) -> Column:
    lo = CUTS[i % SEGMENTS]
    hi = (*CUTS, BITS)[i % SEGMENTS + 1]
    return F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1))


def _width(i: int) -> int:
    return (*CUTS, BITS)[i % SEGMENTS + 1] - CUTS[i % SEGMENTS]


def _chain(difference: Column, start: int) -> Column:
    """Whether the differing bits stay within the chain's budgets from segment ``start`` on."""
    bits = [F.bit_count(_segment(difference, start + k)) for k in range(SEGMENTS)]
    sums = [reduce(lambda a, b: a + b, bits[:k + 1]) for k in range(SEGMENTS)]
    return reduce(lambda a, b: a & b, [s <= (k + 1) * BUDGET // SEGMENTS for k, s in enumerate(sums)])


def _chained(difference: Column, start: Column) -> Column:
    """Whether ``start`` is the first segment from which the chain holds, so that each pair is met once."""
    first = F.lit(SEGMENTS)
    for i in reversed(range(SEGMENTS)):
        first = F.when(_chain(difference, i), F.lit(i)).otherwise(first)
    return start == first


def links(prints: DataFrame, direct: int = DIRECT) -> DataFrame:
    """``a``, ``b`` (``a < b``): distinct fingerprints (column ``fp``) within the budget, each pair once."""
    keyed = prints.select("fp", F.explode(F.array(*[
        F.struct(F.lit(i).alias("start"), _segment(F.col("fp"), i).bitwiseOR(F.shiftleft(_segment(F.col("fp"), i + 1), _width(i))).alias("key"))
        for i in range(SEGMENTS)])).alias("k")).select("fp", "k.start", "k.key")
    crowded = written(keyed.groupBy("start", "key").agg(F.count("*").alias("n")).where(F.col("n") > direct).drop("n"), "simhash-crowded")
    pair = lambda extra: (F.col("a.fp") < F.col("b.fp")) & (F.col("a.start") == F.col("b.start")) & (F.col("a.key") == F.col("b.key")) & extra
    difference = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    near = _chained(difference, F.col("a.start")) & (F.bit_count(difference) <= BUDGET)
    few = keyed.join(crowded, ["start", "key"], "left_anti")
    plain = few.alias("a").join(few.alias("b"), pair(near)).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))
    many = keyed.join(crowded, ["start", "key"], "left_semi")
    following = F.lit(0).cast("bigint")
    for i in range(SEGMENTS):
        both = _segment(F.col("fp"), i + 2).bitwiseOR(F.shiftleft(_segment(F.col("fp"), i + 3), _width(i + 2)))
        following = F.when(F.col("start") == i, both).otherwise(following)
    masked = many.withColumn("next", following).select("fp", "start", "key", "next", F.explode(F.array(*[
        F.struct(F.lit(i).alias("bit"), F.col("next").bitwiseAND(F.lit(~(1 << i))).alias("rest")) for i in range(NEXT_BITS)])).alias("m"))
    masked = masked.select("fp", "start", "key", "next", "m.bit", "m.rest")
    # a pair that agrees in several variants is met in one: at its differing bit, or at the first
    apart = F.col("a.next").bitwiseXOR(F.col("b.next"))
    once = F.col("a.bit") == F.when(apart == 0, F.lit(0)).otherwise(F.bit_count(apart - 1))
    refined = masked.alias("a").join(masked.alias("b"), pair((F.col("a.bit") == F.col("b.bit")) & (F.col("a.rest") == F.col("b.rest")) & once & near))
    return plain.union(refined.select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b")))


def near_copies(docs: DataFrame, doc: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """``doc``, ``fingerprint`` (16 hex digits), ``component_id``: the smallest id that can be reached over links."""
    prints = written(fingerprints(docs, doc, text, words), "simhash-prints")
    classes = written(prints.groupBy("fp").agg(F.min(col(doc)).alias("least")), "simhash-classes")
    named = components(links(classes.select("fp")).distinct())  # node, root: fingerprints that have links
    rooted = classes.join(named.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    reached = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    found = written(rooted.join(reached, "root").select("fp", "component_id"), "simhash-components")
    return prints.join(found, "fp").select(col(doc), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group: that of the smallest id, rows without an id last. Rows that share an id or have none are documents of their own."""
    rows, key = keyed(docs, "simhash-rows")
    groups = near_copies(rows, key, text).select(key, "component_id").join(rows.select(key, col(doc).alias("doc")), key)
    groups = written(groups.select(F.col(key).alias("row"), "doc", "component_id"), "simhash-groups")
    # a component that has one row only, most of them, is its own first
    firsts = groups.groupBy("component_id").agg(F.min(F.struct(F.col("doc").isNull().alias("nameless"), "doc", "row")).alias("first"), F.count("*").alias("n"))
    firsts = written(firsts.where("n > 1").select("component_id", F.col("first.row").alias("first")), "simhash-firsts")
    gone = written(groups.join(firsts, "component_id").where("row <> first").select(F.col("row").alias(key)), "simhash-gone")
    return rows.join(gone, key, "left_anti").select(*[col(c) for c in docs.columns])
