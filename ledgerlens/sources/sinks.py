"""Writing cleaned tables and results; Spark writes one file per partition."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_cleaned(df: DataFrame, path: str, parquet: bool = False) -> None:
    """Cleaned table as semicolon CSV in UTF-8 (or Parquet)."""
    if parquet:
        df.write.mode("overwrite").parquet(path)
    else:
        df.write.mode("overwrite").option("sep", ";").option("header", True).option("encoding", "UTF-8").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """Diagnostic, analysis or summary frame as JSON lines; nested structs stay nested."""
    df.write.mode("overwrite").json(path)
