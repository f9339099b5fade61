"""Row-order computations that never put a whole file into one task.

A plain ``Window.partitionBy(file).orderBy(row)`` sorts each file on a single
executor. Here rows are cut into chunks of consecutive row numbers; windows run
per chunk, each chunk contributes one summary row, the (small) summaries are
scanned in order, and what a chunk needs from its predecessors is joined back.
The results equal the plain window exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_ROWS = 32_768


def with_chunk(df: DataFrame, order: str, rows: int = CHUNK_ROWS) -> DataFrame:
    """``df`` with the number of each row's chunk. Scans of a frame that has it keep it, so that scans in a row share one shuffle and sort."""
    return df.withColumn("_chunk", F.floor(F.col(order) / rows))


def _chunked(df: DataFrame, order: str, rows: int) -> DataFrame:
    return df if "_chunk" in df.columns else with_chunk(df, order, rows)


def _added(df: DataFrame) -> list[str]:
    return [] if "_chunk" in df.columns else ["_chunk"]


def _join_back(df: DataFrame, summary: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(summary, [*keys, "_chunk"], "left")


def running_sums(df: DataFrame, keys: list[str], order: str, sums: dict[str, Column], rows: int = CHUNK_ROWS) -> DataFrame:
    """Adds inclusive running sums (name -> summand) along ``order`` within ``keys``."""
    work = _chunked(df, order, rows)
    for n, c in sums.items():
        work = work.withColumn(f"_v_{n}", c)
    totals = work.groupBy(*keys, "_chunk").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    prev = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(*keys, "_chunk", *[F.coalesce(F.sum(f"_t_{n}").over(prev), F.lit(0)).alias(f"_b_{n}") for n in sums])
    inside = Window.partitionBy(*keys, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = _join_back(work, base, keys)
    for n in sums:
        out = out.withColumn(n, F.coalesce(F.sum(f"_v_{n}").over(inside), F.lit(0)) + F.col(f"_b_{n}"))
    return out.drop(*_added(df), *[f"_v_{n}" for n in sums], *[f"_b_{n}" for n in sums])


def last_known(df: DataFrame, keys: list[str], order: str, values: dict[str, Column], rows: int = CHUNK_ROWS,
               before: bool | tuple[str, ...] = False) -> DataFrame:
    """Adds the latest non-null value at or before each row (strictly before with ``before``, which may name the values it is meant for)."""
    strict = tuple(values) if before is True else before or ()
    work = _chunked(df, order, rows)
    for n, c in values.items():
        work = work.withColumn(f"_v_{n}", c)
    latest = work.groupBy(*keys, "_chunk").agg(
        *[F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), F.col(order))).alias(f"_t_{n}") for n in values])
    prev = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = latest.select(*keys, "_chunk", *[F.last(f"_t_{n}", ignorenulls=True).over(prev).alias(f"_b_{n}") for n in values])
    inside = Window.partitionBy(*keys, "_chunk").orderBy(order)
    out = _join_back(work, base, keys)
    for n in values:
        upto = inside.rowsBetween(Window.unboundedPreceding, -1 if n in strict else 0)
        out = out.withColumn(n, F.coalesce(F.last(f"_v_{n}", ignorenulls=True).over(upto), F.col(f"_b_{n}")))
    return out.drop(*_added(df), *[f"_v_{n}" for n in values], *[f"_b_{n}" for n in values])


def next_known(df: DataFrame, keys: list[str], order: str, values: dict[str, Column], rows: int = CHUNK_ROWS) -> DataFrame:
    """Adds the nearest non-null value strictly after each row."""
    work = _chunked(df, order, rows)
    for n, c in values.items():
        work = work.withColumn(f"_v_{n}", c)
    firsts = work.groupBy(*keys, "_chunk").agg(
        *[F.min_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), F.col(order))).alias(f"_t_{n}") for n in values])
    after = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(1, Window.unboundedFollowing)
    base = firsts.select(*keys, "_chunk", *[F.first(f"_t_{n}", ignorenulls=True).over(after).alias(f"_b_{n}") for n in values])
    inside = Window.partitionBy(*keys, "_chunk").orderBy(order).rowsBetween(1, Window.unboundedFollowing)
    out = _join_back(work, base, keys)
    for n in values:
        out = out.withColumn(n, F.coalesce(F.first(f"_v_{n}", ignorenulls=True).over(inside), F.col(f"_b_{n}")))
    return out.drop(*_added(df), *[f"_v_{n}" for n in values], *[f"_b_{n}" for n in values])


def with_dense_row_number(df: DataFrame, keys: list[str], order: str, name: str = "row_no", start: int = 1,
                          rows: int = CHUNK_ROWS) -> DataFrame:
    """Dense numbering along ``order`` within ``keys``."""
    numbered = running_sums(df, keys, order, {name: F.lit(1)}, rows)
    return numbered if start == 1 else numbered.withColumn(name, F.col(name) + (start - 1))
