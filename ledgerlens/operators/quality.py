"""Profiling, type inference, issues, coherence audit and quality score.

Profiles and type shares are one aggregation over the rows; only what needs the
values themselves (frequencies, distinct identifiers, duplicates) shuffles.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import DATE_PATTERN, parse_date_text
from ..functions.numeric import exact_medians, not_nan, parse_decimal_text
from ..session import cut_lineage
from .metrics import Roles

# Fixed values.
DATE_NAME_TERMS = ("data", "date", "dt", "nascimento", "vencimento")
ID_NAME_TERMS = ("id", "codigo", "cod", "pedido", "transacao", "transaction")
MIN_RATE = 0.8
MIN_UNIQUE = 0.7
MIN_ID_CONFIDENCE = 60
COHERENT_PERCENT = 50
TOLERANCE = 0.01
LEVEL_ORDER = {"alta": 0, "media": 1, "baixa": 2}
MSG_DUPLICATES = "%d linhas duplicadas encontradas."
MSG_NULLS = "A coluna '%s' possui %d valores nulos (%s%%)."
MSG_LIKE_DATE = "A coluna '%s' está como %s, mas parece ser datetime com confiança de %s%%."
MSG_LIKE_NUMBER = "A coluna '%s' está como %s, mas parece ser numérica com confiança de %s%%."
MSG_INCOHERENT = (
    "Faturamento, Custo e Lucro não reconciliam na maior parte dos registros "
    "(%s%% conciliados; tolerância de R$ %s). Os valores originais foram preservados."
)
MSG_OUTLYING_DATES = (
    "%d datas estao fora do periodo predominante e foram desconsideradas somente nas analises temporais."
)


def kind_of(dtype: str) -> str:
    """numeric, text, date or other."""
    if dtype in ("tinyint", "smallint", "int", "bigint", "float", "double") or dtype.startswith("decimal"):
        return "numeric"
    if dtype in ("date", "timestamp", "timestamp_ntz"):
        return "date"
    return "text" if dtype == "string" or dtype.startswith(("char", "varchar")) else "other"


def column_kinds(df: DataFrame) -> DataFrame:
    """(column, position, dtype, kind): schema only, no job."""
    spark = df.sparkSession
    rows = [(n, i, t, kind_of(t)) for i, (n, t) in enumerate(df.dtypes)]
    return spark.createDataFrame(rows, "column string, position int, dtype string, kind string")


def _missing(name: str, dtype: str) -> Column:
    c = F.col(f"`{name}`")
    return c.isNull() | F.isnan(c) if dtype in ("double", "float") else c.isNull()


def value_frequencies(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, value, n) of the chosen columns; missing cells have a NULL value."""
    types = dict(df.dtypes)
    names = columns or df.columns
    cells = F.array(
        *[F.struct(F.lit(n).alias("column"),
                   F.when(~_missing(n, types[n]), F.col(f"`{n}`").cast("string")).alias("value")) for n in names]
    )
    return df.select(F.inline(cells)).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def null_profile(df: DataFrame) -> DataFrame:
    """(column, dtype, kind, rows, nulls, null_percent) from one aggregation, no shuffle of rows."""
    counts = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count_if(_missing(n, t)).alias(f"c{i}") for i, (n, t) in enumerate(df.dtypes)],
    )
    entries = F.array(
        *[F.struct(F.lit(n).alias("column"), F.lit(i).alias("position"), F.lit(t).alias("dtype"),
                   F.lit(kind_of(t)).alias("kind"), F.col(f"c{i}").alias("nulls"))
          for i, (n, t) in enumerate(df.dtypes)]
    )
    return counts.select(F.col("_rows").alias("rows"), F.inline(entries)).select(
        "column", "position", "dtype", "kind", "rows", "nulls",
        F.coalesce(F.try_divide(F.col("nulls"), F.col("rows")) * 100, F.lit(0.0)).alias("null_percent"),
    )


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Number of rows that repeat an earlier row, one row.

    A 64-bit row hash is counted first; only rows whose hash repeats are
    compared in full, so unique wide rows never travel and the count is exact.
    """
    cells = [F.col(f"`{c}`") for c in df.columns]
    hashed = df.withColumn("_h", F.xxhash64(*cells))
    repeated = hashed.groupBy("_h").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).select("_h")
    same = hashed.join(repeated, "_h", "left_semi").groupBy(*cells).agg(F.count(F.lit(1)).alias("_n"))
    return same.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("bigint").alias("duplicates"))


def _name_has(name: str, terms: tuple[str, ...], whole_words: bool) -> bool:
    plain = name.strip().lower()
    return bool(set(re.split(r"[_\-\s]+", plain)) & set(terms)) if whole_words else any(t in plain for t in terms)


def infer_types(df: DataFrame) -> DataFrame:
    """One row per column with its suggested type: identifier, then date, then number.

    Shares of letters, dates and numbers come from one aggregation over the
    rows, without a shuffle of them. Distinct values are counted only for the
    columns whose decision can depend on them: those named like an identifier.
    """
    types = list(df.dtypes)
    value = {n: F.when(~_missing(n, t), F.col(f"`{n}`").cast("string")) for n, t in types}
    facts = []
    for i, (n, t) in enumerate(types):
        text, is_text = F.trim(value[n]), kind_of(t) == "text"
        facts.append(F.count(value[n]).alias(f"f{i}"))
        if is_text:
            facts += [
                F.coalesce(F.bool_or(value[n].rlike("[A-Za-z]")), F.lit(False)).alias(f"l{i}"), F.count_if(text.rlike(DATE_PATTERN)).alias(f"p{i}"),
                F.count(parse_date_text(text)).alias(f"d{i}"), F.count(parse_decimal_text(text)).alias(f"n{i}")]
    none, no = F.lit(0).cast("bigint"), F.lit(False)
    entries = [F.struct(
        F.lit(n).alias("column"), F.lit(i).alias("position"), F.lit(t).alias("dtype"), F.lit(kind_of(t)).alias("kind"),
        F.lit(_name_has(n, ID_NAME_TERMS, True)).alias("id_name"), F.lit(_name_has(n, DATE_NAME_TERMS, False)).alias("date_name"), F.col(f"f{i}").alias("filled"),
        *[(F.col(f"{k}{i}") if kind_of(t) == "text" else default).alias(a)
          for k, a, default in (("l", "lettered", no), ("p", "date_like", none), ("d", "dates", none), ("n", "numbers", none))]) for i, (n, t) in enumerate(types)]
    stats = df.agg(*facts).select(F.inline(F.array(*entries))).where("filled > 0")
    named = [n for n, _ in types if _name_has(n, ID_NAME_TERMS, True)]
    distinct = None
    for n in named:
        part = df.select(F.trim(value[n]).alias("v")).where("v is not null").distinct().agg(F.count(F.lit(1)).alias("distinct_values")).select(F.lit(n).alias("column"), "distinct_values")
        distinct = part if distinct is None else distinct.unionByName(part)
    if distinct is None:
        stats = stats.withColumn("distinct_values", none)
    else:
        stats = stats.join(distinct, "column", "left").withColumn("distinct_values", F.coalesce("distinct_values", none))
    is_text = F.col("kind") == "text"
    share = lambda c: F.col(c) / F.col("filled")
    id_score = (
        F.when(F.col("id_name"), 60).otherwise(0)
        + F.when(F.col("lettered"), 20).otherwise(0)
        + F.when(share("distinct_values") >= MIN_UNIQUE, 20).otherwise(0)
    )
    date_ok = is_text & (F.col("date_name") | (share("date_like") >= MIN_RATE)) & (share("dates") >= MIN_RATE)
    number_ok = is_text & (share("numbers") >= MIN_RATE)
    suggested = (
        F.when(id_score >= MIN_ID_CONFIDENCE, F.lit("identificador"))
        .when(date_ok, F.lit("datetime")).when(number_ok, F.lit("numerico"))
    )
    confidence = (
        F.when(id_score >= MIN_ID_CONFIDENCE, id_score.cast("double"))
        .when(date_ok, F.round(share("dates") * 100, 2)).when(number_ok, F.round(share("numbers") * 100, 2))
    )
    return stats.select("column", "position", "dtype", suggested.alias("suggested"), confidence.alias("confidence"))


def issues(profile: DataFrame, inference: DataFrame, duplicates: DataFrame) -> DataFrame:
    """(kind, column, level, message) rows from profile, inference and duplicate count."""
    no_column = F.lit(None).cast("string").alias("column")
    dup = duplicates.where(F.col("duplicates") > 0).select(
        F.lit("duplicidade").alias("kind"), no_column, F.lit("media").alias("level"),
        F.format_string(MSG_DUPLICATES, F.col("duplicates")).alias("message"),
    )
    nulls = profile.where(F.col("nulls") > 0).select(
        F.lit("valor_nulo").alias("kind"), "column", F.lit("baixa").alias("level"),
        F.format_string(MSG_NULLS, F.col("column"), F.col("nulls"),
                        F.round(F.col("null_percent"), 2).cast("string")).alias("message"),
    )
    typed = inference.where(F.col("suggested").isin("datetime", "numerico"))
    args = (F.col("column"), F.col("dtype"), F.col("confidence").cast("string"))
    wrong = typed.select(
        F.lit("tipo_incorreto").alias("kind"), "column", F.lit("media").alias("level"),
        F.when(F.col("suggested") == "datetime", F.format_string(MSG_LIKE_DATE, *args))
        .otherwise(F.format_string(MSG_LIKE_NUMBER, *args)).alias("message"),
    )
    return dup.unionByName(nulls).unionByName(wrong)


def coherence_audit(df: DataFrame, roles: Roles, tolerance: float = TOLERANCE) -> DataFrame:
    """One row: how far revenue − cost − profit reconciles on rows that have all three."""
    v = {r: not_nan(F.col(f"`{roles[r]}`").try_cast("double")) for r in ("faturamento", "custo", "lucro")}
    base = df.select(*[c.alias(r) for r, c in v.items()])
    whole = F.col("faturamento").isNotNull() & F.col("custo").isNotNull() & F.col("lucro").isNotNull()
    residual = F.when(whole, F.col("faturamento") - F.col("custo") - F.col("lucro"))
    # written once: the sums and the three counting passes of the medians read these columns, not what they come from
    measured = cut_lineage(base.withColumn("residual", residual).withColumn("error", F.abs(residual)))
    agg = measured.agg(
        *[F.count(r).alias(f"{r}_valid") for r in v],
        *[F.count_if(F.col(r).isNull()).alias(f"{r}_nulls") for r in v],
        *[F.sum(r).alias(f"{r}_sum") for r in v],
        F.count("residual").alias("complete_rows"),
        F.count_if(F.col("error") <= tolerance).alias("reconciled_rows"),
        F.sum("residual").alias("residual_total"),
        F.avg("error").alias("mean_abs_error"),
    )
    rate = F.try_divide(F.col("reconciled_rows"), F.col("complete_rows")) * 100
    status = (
        F.when(F.col("complete_rows") == 0, F.lit("insuficiente"))
        .when(rate < COHERENT_PERCENT, F.lit("inconsistente")).otherwise(F.lit("coerente"))
    )
    medians = exact_medians(measured, ["error", "residual"]).select(F.struct("error", "residual")).scalar()
    return agg.select(
        "*", rate.alias("reconciled_percent"), status.alias("status"),
        medians["error"].alias("median_abs_error"), medians["residual"].alias("median_residual"),
    )


def coherence_examples(df: DataFrame, roles: Roles, order: list[str], k: int = 5) -> DataFrame:
    """First complete rows in source order with their residual (a fixed-length report)."""
    cols = [F.col(f"`{roles[r]}`").try_cast("double").alias(r) for r in ("faturamento", "custo", "lucro")]
    keys = [F.col(f"`{o}`").alias(f"key_{i}") for i, o in enumerate(order, 1)]
    full = df.select(*keys, *cols).dropna(subset=["faturamento", "custo", "lucro"])
    residual = F.col("faturamento") - F.col("custo") - F.col("lucro")
    return full.withColumn("residual", residual).orderBy(*[f"key_{i}" for i in range(1, len(order) + 1)]).limit(k)


def quality_score(
    profile: DataFrame,
    duplicates: DataFrame,
    issue_rows: DataFrame,
    header_missing: bool = False,
    empty_columns_removed: int = 0,
) -> DataFrame:
    """Score 0–100 and class from null share, duplicates and issue levels; one row."""
    profile, duplicates, issue_rows = (cut_lineage(x) for x in (profile, duplicates, issue_rows))  # each is read several times
    cells = profile.agg(
        F.max("rows").alias("rows"), F.count(F.lit(1)).alias("columns"), F.sum("nulls").alias("nulls")
    )
    weights = F.when(F.col("level") == "alta", 10).when(F.col("level") == "media", 5).otherwise(0)
    penalty = issue_rows.agg(F.coalesce(F.sum(weights), F.lit(0)).alias("w"), F.count(F.lit(1)).alias("issues"))
    row = cells.select(
        "*", duplicates.scalar().alias("duplicates"),
        penalty.select("w").scalar().alias("w"), penalty.select("issues").scalar().alias("issues"),
    )
    total = F.col("rows") * F.col("columns")
    null_percent = F.try_divide(F.col("nulls"), total) * 100
    deducted = (
        F.least(F.lit(30.0), null_percent)
        + F.least(F.lit(20.0), F.try_divide(F.col("duplicates"), F.col("rows")) * 100)
        + F.least(F.lit(30), F.col("w"))
        + F.lit(10 if header_missing else 0)
        + F.lit(min(10, empty_columns_removed))
    )
    score = F.when(total > 0, F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.lit(100.0) - deducted)))
    grade = (
        F.when(score >= 90, F.lit("excelente")).when(score >= 75, F.lit("boa"))
        .when(score >= 50, F.lit("atencao")).when(score.isNotNull(), F.lit("critica"))
    )
    return row.select(
        "rows", "columns", F.col("nulls").alias("total_nulls"), "duplicates", null_percent.alias("null_percent"),
        "issues", score.alias("score"), grade.alias("grade"),
    )


def quality_report(
    issue_rows: DataFrame, coherence: DataFrame | None = None, anomalies: DataFrame | None = None
) -> DataFrame:
    """All issues incl. coherence and outlying dates, most serious first."""
    out = issue_rows
    no_column = F.lit(None).cast("string").alias("column")
    if coherence is not None:
        out = out.unionByName(coherence.where(F.col("status") == "inconsistente").select(
            F.lit("incoerencia_metricas_financeiras").alias("kind"), no_column, F.lit("media").alias("level"),
            F.format_string(MSG_INCOHERENT, F.round("reconciled_percent", 2).cast("string"),
                            F.lit(f"{TOLERANCE:.2f}")).alias("message")))
    if anomalies is not None:
        out = out.unionByName(anomalies.where(F.col("flagged_dates") > 0).select(
            F.lit("data_temporal_anomala").alias("kind"), no_column, F.lit("media").alias("level"),
            F.format_string(MSG_OUTLYING_DATES, F.col("flagged_dates")).alias("message")))
    rank = F.lit(3)
    for level, pos in LEVEL_ORDER.items():
        rank = F.when(F.col("level") == level, pos).otherwise(rank)
    return out.orderBy(rank, "kind", F.col("column").asc_nulls_first())
