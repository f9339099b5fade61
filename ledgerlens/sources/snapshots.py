"""Append-only store of analyses, partitioned by date.

Each snapshot is two rows-sets under one folder: ``index`` (one row per
analysis) and ``kpis``/``series``/``rankings`` details keyed by id.
"""

from __future__ import annotations

import re
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ID_FORMAT = re.compile(r"analysis_\d{8}_\d{12}_[0-9a-f]{32}")


def new_analysis_id(now: datetime | None = None) -> str:
    now = now or datetime.now(timezone.utc)
    return f"analysis_{now:%Y%m%d_%H%M%S%f}_{uuid.uuid4().hex}"


def snapshot_day(analysis_id: str) -> str:
    """The date inside an id, which is the partition it lives in."""
    if not ID_FORMAT.fullmatch(analysis_id):
        raise ValueError(f"malformed analysis id {analysis_id!r}")
    return f"{analysis_id[9:13]}-{analysis_id[13:15]}-{analysis_id[15:17]}"


def index_record(
    spark: SparkSession, analysis_id: str, created_at: str, files: list[str], kpis: DataFrame, series: DataFrame,
    quality: DataFrame, status: DataFrame, dimensions: list[str],
) -> DataFrame:
    """One index row: mode, size, period, metrics, dimensions, quality, score."""
    base = spark.createDataFrame([(analysis_id, created_at, files, dimensions)],
                                 "id string, created_at string, files array<string>, available_dimensions array<string>")
    span = series.agg(F.min("period").alias("a"), F.max("period").alias("b"))
    return base.select(
        "id", "created_at", "files", F.when(F.size("files") > 1, "multi").otherwise("single").alias("mode"),
        F.lit("success").alias("analysis_status"),
        quality.select("rows").scalar().alias("rows"), quality.select("columns").scalar().alias("columns"),
        span.select("a").scalar().alias("period_start"), span.select("b").scalar().alias("period_end"),
        kpis.agg(F.sort_array(F.collect_list("indicador"))).scalar().alias("available_metrics"), "available_dimensions",
        quality.select("score").scalar().alias("quality_score"), quality.select("grade").scalar().alias("quality_grade"),
        quality.select("total_nulls").scalar().alias("total_nulls"), quality.select("duplicates").scalar().alias("duplicates"),
        status.select("score").scalar().alias("score"), status.select("status").scalar().alias("status"),
    )


def save_snapshot(path: str, analysis_id: str, index: DataFrame, details: dict[str, DataFrame]) -> None:
    """Details first, index last: an id that is listed is complete."""
    day = snapshot_day(analysis_id)
    for name, frame in details.items():
        frame.withColumn("id", F.lit(analysis_id)).withColumn("dt", F.lit(day)).write.mode("append").partitionBy("dt").parquet(f"{path}/{name}")
    index.withColumn("dt", F.lit(day)).write.mode("append").partitionBy("dt").parquet(f"{path}/index")


def list_snapshots(spark: SparkSession, path: str, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Newest first, one page."""
    rows = spark.read.parquet(f"{path}/index").orderBy(F.desc("created_at"), F.desc("id"))
    rows = rows.offset(max(0, offset)) if offset else rows
    return rows.limit(limit) if limit is not None else rows


def latest_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return list_snapshots(spark, path, limit=1)


def fetch_snapshot(spark: SparkSession, path: str, analysis_id: str, part: str = "index") -> DataFrame:
    """Rows of one analysis; the date in the id prunes to one partition."""
    return spark.read.parquet(f"{path}/{part}").where((F.col("dt") == snapshot_day(analysis_id)) & (F.col("id") == analysis_id))
