"""Dates that lie outside the predominant span of years."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
MIN_DATES = 50
CORE_SHARE = 0.95
SPARSE_FLOOR = 3
SPARSE_SHARE = 0.01
OUTSIDE_SHARE = 0.05


def year_profile(df: DataFrame, date: str) -> DataFrame:
    """Dates per year; the only pass over the rows."""
    ts = F.col(f"`{date}`")
    return df.where(ts.isNotNull()).groupBy(F.year(ts).alias("year")).agg(
        F.count(F.lit(1)).alias("n"), F.min(ts).alias("first_date"), F.max(ts).alias("last_date")
    )


def predominant_span(years: DataFrame) -> DataFrame:
    """One row: narrowest run of adjacent years with at least 95 % of the dates.

    Prefix sums inside each run of adjacent years turn the sum of any span into
    a difference; for each first year the shortest sufficient span is the first
    one whose prefix reaches the required count.
    """
    every = Window.partitionBy(F.lit(0))
    run_order = Window.partitionBy(F.lit(0)).orderBy("year")
    prepared = years.select(
        "year", "n", "first_date", "last_date",
        F.sum("n").over(every).alias("total"),
        (F.col("year") - F.row_number().over(run_order)).alias("run"),
    ).withColumn("upto", F.sum("n").over(Window.partitionBy("run").orderBy("year")))
    need = F.ceil(F.col("total") * CORE_SHARE - 1e-6)
    left = prepared.select(
        "run", F.col("year").alias("y1"), (F.col("upto") - F.col("n")).alias("before"), "total", need.alias("need")
    )
    right = prepared.select("run", F.col("year").alias("y2"), "upto")
    spans = (
        left.join(right, "run")
        .where((F.col("y2") >= F.col("y1")) & (F.col("upto") - F.col("before") >= F.col("need")))
        .select("y1", "y2", (F.col("upto") - F.col("before")).alias("inside"), "total",
                (F.col("y2") - F.col("y1")).alias("width"))
    )
    per_start = spans.groupBy("y1").agg(F.min(F.struct("width", "inside", "y1", "y2", "total")).alias("s"))
    best = per_start.agg(F.min("s").alias("s")).where(F.col("s").isNotNull()).select("s.*")
    outside = (
        years.join(F.broadcast(best), (F.col("year") < F.col("y1")) | (F.col("year") > F.col("y2")), "inner")
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("outside"), F.coalesce(F.max("n"), F.lit(0)).alias("largest_outside"))
    )
    limit = F.greatest(F.lit(SPARSE_FLOOR), F.floor(F.col("total") * SPARSE_SHARE))
    return best.withColumn("j", F.lit(1)).join(outside.withColumn("j", F.lit(1)), "j").select(
        F.col("y1").alias("start_year"), F.col("y2").alias("end_year"), "inside", "total", "outside",
        F.round(F.col("inside") / F.col("total"), 4).alias("confidence"),
        (
            (F.col("total") >= MIN_DATES)
            & (F.col("inside") / F.col("total") >= CORE_SHARE)
            & (F.col("outside") > 0)
            & (F.col("outside") / F.col("total") <= OUTSIDE_SHARE)
            & (F.col("largest_outside") <= limit)
            & (F.col("y2") > F.col("y1"))
        ).alias("flagged"),
    )


def outlier_years(df: DataFrame, date: str) -> DataFrame:
    """(year, n) of the years to leave out of time analysis; empty unless the evidence is strong."""
    years = year_profile(df, date)
    span = predominant_span(years).where("flagged")
    outside = (F.col("year") < F.col("start_year")) | (F.col("year") > F.col("end_year"))
    return years.join(F.broadcast(span), outside).select("year", "n", "first_date", "last_date")


def anomaly_report(df: DataFrame, date: str) -> DataFrame:
    """Span, confidence and number of flagged dates, one row."""
    span = predominant_span(year_profile(df, date))
    return span.select(
        "start_year", "end_year",
        F.when(F.col("total") >= MIN_DATES, F.col("confidence")).otherwise(F.lit(0.0)).alias("confidence"),
        F.when(F.col("flagged"), F.col("outside")).otherwise(F.lit(0)).cast("bigint").alias("flagged_dates"),
    )


def without_anomalies(df: DataFrame, date: str) -> DataFrame:
    """Rows for time analysis: flagged years dropped, undated rows kept."""
    bad = outlier_years(df, date).select(F.col("year").alias("_bad_year"))
    return df.join(F.broadcast(bad), F.year(F.col(f"`{date}`")) == F.col("_bad_year"), "left_anti")
