"""Guarded conversions and null handling, with an audit of what was done.

Each step makes one aggregation over the raw columns; its schema-sized result
decides on the driver which casts are compiled into the lazy frame.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import parse_date_text
from ..functions.numeric import parse_decimal_text

# Guard, audit kinds and texts, calendar columns.
MIN_CONVERTED = 0.95
LOG_SCHEMA = "coluna string, tipo_transformacao string, antes string, depois string, detalhes string"
TXT_OK = "Conversão realizada com sucesso."
TXT_PARTIAL = (
    "Conversão realizada com {:.2%} de confiança; {} valores não numéricos ficaram nulos no dataset "
    "analítico. Os dados originais permanecem preservados."
)
TXT_CANCELLED = (
    "Conversão cancelada: somente {:.2%} dos valores não nulos puderam ser interpretados como números; "
    "{} valores foram preservados sem conversão."
)
TXT_DATE_CANCELLED = "A conversão geraria {} novos valores nulos."
TXT_CALENDAR = "{} valores preenchidos a partir da coluna Data."
TXT_PROFIT = "{} valores recalculados usando Valor_liquido - Total_custo."
CALENDAR = {"Ano": F.year, "Mês": F.month, "Trimestre": F.quarter}
NO_DATE = "Não foi possível preencher porque a Data também está ausente."
LEFT_NULL = {
    "Data": "Não existe informação confiável para reconstruir a data.",
    "Lucro": "A regra original de cálculo do lucro não é conhecida.",
    "Percentual_lucro": "A regra original de cálculo não é conhecida.",
    "Ano": NO_DATE,
    "Mês": NO_DATE,
    "Nome_mes": NO_DATE,
    "Trimestre": NO_DATE,
}


@dataclass
class Cleaned:
    """A frame and the audit rows of the steps that led to it."""

    frame: DataFrame
    log: list[tuple[str, str, str, str, str]] = field(default_factory=list)

    def log_frame(self) -> DataFrame:
        return self.frame.sparkSession.createDataFrame(self.log, LOG_SCHEMA)


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def convert_numbers(state: Cleaned, columns: list[str]) -> Cleaned:
    """Text to double; undone for a column if it would lose more than 5 % of its values."""
    if not columns:
        return state
    df = state.frame
    row = df.agg(
        *[F.count(_c(c)).alias(f"f{i}") for i, c in enumerate(columns)],
        *[F.count(parse_decimal_text(_c(c))).alias(f"p{i}") for i, c in enumerate(columns)],
    ).first()
    types, out, log = dict(df.dtypes), df, list(state.log)
    for i, c in enumerate(columns):
        filled, parsed = row[f"f{i}"], row[f"p{i}"]
        lost, rate = filled - parsed, parsed / max(1, filled)
        if lost > 0 and rate < MIN_CONVERTED:
            log.append((c, "conversao_numerica_cancelada", types[c], types[c], TXT_CANCELLED.format(rate, lost)))
            continue
        out = out.withColumn(c, parse_decimal_text(_c(c)))
        if lost:
            log.append((c, "conversao_numerica_parcial", types[c], "double", TXT_PARTIAL.format(rate, lost)))
        else:
            log.append((c, "conversao_numerica", types[c], "double", TXT_OK))
    return Cleaned(out, log)


def convert_dates(state: Cleaned, columns: list[str]) -> Cleaned:
    """Text to timestamp; undone for a column if any value would be lost."""
    if not columns:
        return state
    df = state.frame
    row = df.agg(
        *[F.count(_c(c)).alias(f"f{i}") for i, c in enumerate(columns)],
        *[F.count(parse_date_text(_c(c))).alias(f"p{i}") for i, c in enumerate(columns)],
    ).first()
    types, out, log = dict(df.dtypes), df, list(state.log)
    for i, c in enumerate(columns):
        lost = row[f"f{i}"] - row[f"p{i}"]
        if lost > 0:
            log.append((c, "conversao_data_cancelada", types[c], types[c], TXT_DATE_CANCELLED.format(lost)))
            continue
        out = out.withColumn(c, parse_date_text(_c(c)))
        log.append((c, "conversao_data", types[c], "timestamp", TXT_OK))
    return Cleaned(out, log)


def fill_calendar(state: Cleaned, date: str = "Data") -> Cleaned:
    """Year, month and quarter columns completed from the date column."""
    df = state.frame
    types = dict(df.dtypes)
    present = [c for c in CALENDAR if c in types]
    if not present or types.get(date) not in ("timestamp", "date", "timestamp_ntz"):
        return state
    row = df.agg(
        *[F.count_if(_c(c).isNull()).alias(f"n{i}") for i, c in enumerate(present)],
        *[F.count_if(_c(c).isNull() & _c(date).isNotNull()).alias(f"r{i}") for i, c in enumerate(present)],
    ).first()
    out, log = df, list(state.log)
    for i, c in enumerate(present):
        out = out.withColumn(c, F.coalesce(_c(c), CALENDAR[c](_c(date)).cast(types[c])))
        if row[f"r{i}"]:
            before, filled = row[f"n{i}"], row[f"r{i}"]
            log.append((c, "preenchimento_nulo", f"{before} nulos", f"{before - filled} nulos", TXT_CALENDAR.format(filled)))
    return Cleaned(out, log)


def fill_profit(state: Cleaned) -> Cleaned:
    """Profit from net value and cost where missing; opt-in, not part of :func:`run_etl`."""
    df = state.frame
    if not {"Lucro", "Valor_liquido", "Total_custo"} <= set(df.columns):
        return state
    value = _c("Valor_liquido") - _c("Total_custo")
    row = df.agg(F.count_if(_c("Lucro").isNull()).alias("n"),
                 F.count_if(_c("Lucro").isNull() & value.isNotNull()).alias("r")).first()
    out = df.withColumn("Lucro", F.coalesce(_c("Lucro"), value))
    log = list(state.log)
    if row["r"]:
        log.append(("Lucro", "recalculo_valor_nulo", f"{row['n']} nulos", f"{row['n'] - row['r']} nulos", TXT_PROFIT.format(row["r"])))
    return Cleaned(out, log)


def untreated_nulls(df: DataFrame) -> DataFrame:
    """Audit rows of known columns that still hold nulls, with the reason."""
    known = [c for c in LEFT_NULL if c in df.columns]
    if not known:
        return df.sparkSession.createDataFrame([], LOG_SCHEMA)
    counts = df.agg(*[F.count_if(_c(c).isNull()).alias(f"n{i}") for i, c in enumerate(known)])
    entries = F.array(*[F.struct(F.lit(c).alias("coluna"), F.col(f"n{i}").alias("n"), F.lit(LEFT_NULL[c]).alias("detalhes"))
                        for i, c in enumerate(known)])
    amount = F.concat(F.col("n").cast("string"), F.lit(" nulos"))
    return counts.select(F.inline(entries)).where(F.col("n") > 0).select(
        "coluna", F.lit("nulo_nao_tratado").alias("tipo_transformacao"),
        amount.alias("antes"), amount.alias("depois"), "detalhes",
    )


def run_etl(df: DataFrame, inference: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Numbers, then dates, then calendar columns; returns the frame and its audit."""
    wanted = {r["column"]: r["suggested"] for r in inference.where(F.col("suggested").isNotNull()).collect()}
    numbers = [c for c in df.columns if wanted.get(c) == "numerico"]
    dates = [c for c in df.columns if wanted.get(c) == "datetime"]
    state = fill_calendar(convert_dates(convert_numbers(Cleaned(df), numbers), dates))
    return state.frame, state.log_frame().unionByName(untreated_nulls(state.frame))


def etl_summary(before: DataFrame, after: DataFrame, before_dup: DataFrame, after_dup: DataFrame) -> DataFrame:
    """Nulls and duplicates before and after, from two profiles; one row."""
    nulls = lambda p: p.agg(F.sum("nulls").alias("n")).scalar()
    one = before.agg(F.max("rows").alias("rows"))
    return one.select(
        "rows", nulls(before).alias("nulls_before"), nulls(after).alias("nulls_after"),
        (nulls(before) - nulls(after)).alias("nulls_treated"),
        before_dup.scalar().alias("duplicates_before"), after_dup.scalar().alias("duplicates_after"),
    )
