"""Numeric column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

INF = float("inf")


def finite(c: Column) -> Column:
    """The value as double, or NULL for NaN and infinities."""
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < F.lit(INF)), d)


def not_nan(c: Column) -> Column:
    """NaN is a missing value, infinities are kept."""
    d = c.cast("double")
    return F.when(~F.isnan(d), d)


def percent_of(part: Column, whole: Column) -> Column:
    return F.try_divide(part, whole) * 100


def clean_decimal_text(c: Column) -> Column:
    """Text of a number in Brazilian or plain notation, without marks.

    A comma is the decimal separator; dots are thousands only next to a comma.
    """
    bare = F.regexp_replace(F.trim(c.cast("string")), r"R\$|%| ", "")
    with_comma = F.contains(bare, F.lit(","))
    with_dot = F.contains(bare, F.lit("."))
    return (
        F.when(with_comma & with_dot, F.translate(F.translate(bare, ".", ""), ",", "."))
        .when(with_comma, F.translate(bare, ",", "."))
        .otherwise(bare)
    )


def parse_decimal_text(c: Column) -> Column:
    """Double value of :func:`clean_decimal_text`, NULL when it is no number."""
    text = F.trim(clean_decimal_text(c))
    numeric = text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
    return F.when(numeric, text.try_cast("double"))


def exact_medians(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row with the exact median of every column.

    ``percentile`` keeps every distinct value of the group in one aggregation
    buffer, so a global median of row-level amounts would grow with the data on
    a single task. Here the middle ranks are located by three counting passes
    over ever finer slices of the value axis, shared by all columns; each pass
    is a partially aggregated ``groupBy`` and only the last slice is ordered.
    """
    x, slices = F.col("x"), Window.partitionBy("name")
    upto_before = Window.unboundedPreceding, -1
    cells = F.array(*[F.struct(F.lit(c).alias("name"), finite(F.col(f"`{c}`")).alias("x")) for c in columns])
    base = df.select(F.inline(cells)).where(x.isNotNull())

    def holds_rank() -> Column:
        inside = lambda r: (F.col(r) > F.col("before")) & (F.col(r) <= F.col("before") + F.col("n"))
        return inside("r1") | inside("r2")

    def running(*keys: str, order: str) -> Column:
        w = Window.partitionBy("name", *keys).orderBy(order).rowsBetween(*upto_before)
        return F.coalesce(F.sum("n").over(w), F.lit(0))

    # Slice 1: sign and binary order of magnitude, monotone in x (under 70k keys).
    magnitude = F.floor(F.log2(F.abs(x)) * 32).cast("long") + 40000
    keyed = base.withColumn("k1", F.when(x == 0, F.lit(0)).when(x > 0, magnitude).otherwise(-magnitude))
    first = keyed.groupBy("name", "k1").agg(
        F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    hit1 = (
        first.withColumn("before", running(order="k1")).withColumn("total", F.sum("n").over(slices))
        .withColumn("r1", F.floor((F.col("total") + 1) / 2)).withColumn("r2", F.floor((F.col("total") + 2) / 2))
        .where(holds_rank()).select("name", "k1", "lo", "hi", "before", "r1", "r2")
    )

    # Slice 2: equal steps inside the one or two slices that hold the ranks.
    step = F.when(F.col("hi") > F.col("lo"),
                  F.floor((x - F.col("lo")) / (F.col("hi") - F.col("lo")) * 65536)).otherwise(0)
    fine = keyed.join(F.broadcast(hit1), ["name", "k1"]).withColumn("k2", step.cast("long"))
    carried = [F.first(c).alias(c) for c in ("base", "r1", "r2")]
    second = fine.withColumnRenamed("before", "base").groupBy("name", "k1", "k2").agg(
        F.count(F.lit(1)).alias("n"), *carried)
    hit2 = (
        second.withColumn("before", F.col("base") + running("k1", order="k2"))
        .where(holds_rank()).select("name", "k1", "k2", F.col("before").alias("base"), "r1", "r2")
    )

    # Last slice: distinct values with multiplicities, then the two middle ranks.
    last = (
        fine.select("name", "k1", "k2", "x").join(F.broadcast(hit2), ["name", "k1", "k2"])
        .groupBy("name", "k1", "k2", "x").agg(F.count(F.lit(1)).alias("n"), *carried)
        .withColumn("before", F.col("base") + running("k1", "k2", order="x"))
    )

    def at(rank: str, name: str) -> Column:
        inside = (F.col(rank) > F.col("before")) & (F.col(rank) <= F.col("before") + F.col("n"))
        return F.max(F.when(inside & (F.col("name") == name), x))

    return last.agg(*[(at("r1", c) / 2 + at("r2", c) / 2).alias(c) for c in columns])
