"""Connected components of a link table, without gathering any component in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """``node``, ``root`` (smallest node of the component) for every node of ``links`` (``a``, ``b``).

    Alternates two steps until nothing changes: each node's larger neighbours
    are linked to the smallest node near it, then each node's smaller
    neighbours are. Both are a grouped minimum and a join, so that a node with
    very many neighbours is spread like any other skewed join side; the number
    of rounds grows with the logarithm of the component size. Every round is
    written, as executors may be lost.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "components")
    before = None
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        edges = written(small.unionAll(least.select("u", F.col("m").alias("v"))).distinct(), "components")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    stars = edges.groupBy("u").agg(F.min("v").alias("root"))
    roots = stars.select(F.col("root").alias("node"), "root").distinct()
    return stars.select(F.col("u").alias("node"), "root").unionAll(roots)
