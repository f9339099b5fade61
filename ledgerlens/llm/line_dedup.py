"""Boilerplate lines by their frequency relative to the site.

Pages are grouped by host; the pages of a host that contain a line, divided by
all pages of the host, give the line's ratio; lines above ``ratio`` go. Pages of
one text are one page, so that copies of a text don't make its lines boilerplate;
texts are told apart by 96 bits of hash, which is all of them that is shuffled.

Defined cases: a null text has no lines, is no page and stays null; a null host is
no site, so such pages are neither counted nor changed; blank lines are never
dropped; a line that occurs several times on a page counts once; repeated rows
are one page; an empty table gives an empty table; other columns pass through
whatever their names are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import WORD, col, fresh, written

#: Lines that repeat by chance or in near copies stay below this share of a site at every size measured; see the figures in the README.
RATIO = 0.01
MIN_PAGES = 5
#: Rows without a host are dealt over so many join keys.
LOOSE = 4096


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _distinct_lines(text: Column) -> Column:
    return F.array_distinct(F.filter(_lines(text), lambda x: x.rlike(WORD)))


def _site_keys(df: DataFrame, host: str) -> tuple[Column, Column]:
    """Equal for pages of one host; pages without one are spread out, as they match nothing."""
    others = F.xxhash64(*[col(c) for c in df.columns if not dict(df.dtypes)[c].startswith(("map", "variant"))])
    return F.coalesce(col(host), F.lit("")), F.when(col(host).isNull(), F.pmod(others, F.lit(LOOSE)) + 1).otherwise(F.lit(0))


def boilerplate(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """One row per host with boilerplate: ``host``, ``lines`` (array).

    Line hashes are counted first (two numbers per line instead of its text);
    only lines whose hash passes are counted again by their text, so that equal
    hashes of different lines change nothing.
    """
    base = pages.where(col(host).isNotNull() & col(text).isNotNull()).select(
        col(host).alias("host"), col(text).alias("text"), F.xxhash64(col(text)).alias("a"), F.hash(col(text)).alias("b"))
    totals = written(base.select("host", "a", "b").distinct().groupBy("host").agg(F.count("*").alias("pages")), "line-totals")
    enough = (F.col("n") >= min_pages) & (F.col("n") > F.col("pages") * F.lit(ratio))
    hashed = base.select("host", "a", "b", F.explode(F.transform(_distinct_lines(F.col("text")), lambda x: F.xxhash64(x))).alias("h")).distinct()
    frequent = hashed.groupBy("host", "h").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    frequent = frequent.join(totals, "host").where(enough).groupBy("host").agg(F.collect_list("h").alias("hs"))
    frequent = written(frequent, "line-hashes")
    seen = base.join(frequent, "host").select("host", "a", "b", F.explode(F.filter(
        _distinct_lines(F.col("text")), lambda x: F.array_contains("hs", F.xxhash64(x)))).alias("line")).distinct()
    exact = seen.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    return exact.join(totals, "host").where(enough).groupBy("host").agg(F.collect_list("line").alias("lines"))


def drop_boilerplate(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO,
                     min_pages: int = MIN_PAGES, counts: bool = False) -> DataFrame:
    """``pages`` with boilerplate lines removed from ``text``; ``counts`` adds ``n_lines`` and ``n_dropped``."""
    a, b, gone = fresh(pages, "_site"), fresh(pages, "_loose"), fresh(pages, "_gone")
    found = written(boilerplate(pages, host, text, ratio, min_pages), "line-boilerplate")
    found = found.select(F.col("host").alias(a), F.lit(0).cast("bigint").alias(b), F.col("lines").alias(gone))
    site, loose = _site_keys(pages, host)
    joined = pages.withColumns({a: site, b: loose.cast("bigint")}).join(found, [a, b], "left")
    kept = F.filter(_lines(col(text)), lambda x: ~F.array_contains(col(gone), x))
    clean = F.when(col(gone).isNull() | col(text).isNull(), col(text)).otherwise(F.array_join(kept, "\n"))
    out = {c: clean.alias(c) if c == text else col(c) for c in pages.columns}
    if counts:
        n = F.coalesce(F.size(_lines(col(text))), F.lit(0)).cast("bigint")
        out["n_lines"] = F.when(col(text).isNull(), F.lit(0)).otherwise(n).alias("n_lines")
        out["n_dropped"] = F.when(col(gone).isNull() | col(text).isNull(), F.lit(0)).otherwise(
            n - F.size(kept)).cast("bigint").alias("n_dropped")
    return joined.select(*out.values())
