"""What the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.session import shared_folder

#: White space that separates words in every contract of this subpackage.
WORD = r"[^\x20\x09-\x0D]"


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` is called so (names are case-insensitive)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def col(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def written(df: DataFrame, prefix: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back.

    Cuts the lineage, survives lost executors, and gives the planner the
    measured size, so that a side is broadcast only if it is really small.
    """
    spark = df.sparkSession
    path = shared_folder(spark, prefix)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keyed(df: DataFrame, prefix: str) -> tuple[DataFrame, str]:
    """``df`` written with a number of each row; the number's column. Once written it names the row, whatever the other columns hold."""
    key = fresh(df, "_row")
    return written(df.withColumn(key, F.monotonically_increasing_id()), prefix), key


def buckets_for(rows: int, per_bucket: int) -> int:
    """So many buckets that each holds about ``per_bucket`` rows at every input size."""
    return max(1, -(-rows // per_bucket))
