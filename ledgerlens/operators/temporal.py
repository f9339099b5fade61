"""Monthly series, guarded month-over-month changes and growth.

Rows are reduced to months first; every ordered window below runs over months,
whose number is bounded by the calendar, not by the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.comparison import COMPARISON_FIELDS, month_label, month_ordinal, period_ordinal, with_comparison
from ..functions.numeric import finite, not_nan
from ..session import cut_lineage
from .metrics import Roles

# Metric preference, thresholds, public reason names.
TIME_METRICS = ("faturamento", "valor_total", "valor_com_desconto", "margem_bruta", "lucro", "custo")
METRIC_LABELS = {
    "faturamento": "Faturamento",
    "valor_total": "Valor Total",
    "valor_com_desconto": "Valor com Desconto",
    "lucro": "Lucro",
    "margem_bruta": "Margem Bruta",
    "custo": "Custo",
}
FEW_RECORDS = 5
TREND_PERCENT = 5
PUBLIC_REASONS = {
    "zero_reference": "base_zero",
    "negative_reference": "base_negativa",
    "sign_change": "mudanca_de_sinal",
    "low_reference_base": "base_muito_baixa",
    "invalid_value": "dados_insuficientes",
    "invalid_period": "periodo_invalido",
}


def time_metric(roles: Roles) -> str | None:
    """The preferred monetary metric that the table has."""
    return next((m for m in TIME_METRICS if m in roles), None)


def monthly_series(df: DataFrame, date: str, metrics: dict[str, str]) -> DataFrame:
    """(metric, ord, period, value, records): sums over rows with a date and a value."""
    ts = F.col(f"`{date}`")
    slim = df.select(
        month_ordinal(ts).alias("ord"),
        *[not_nan(F.col(f"`{c}`").try_cast("double")).alias(m) for m, c in metrics.items()],
    ).where(F.col("ord").isNotNull())
    sums = slim.groupBy("ord").agg(
        *[F.sum(m).alias(f"s_{m}") for m in metrics], *[F.count(m).alias(f"n_{m}") for m in metrics]
    )
    entries = F.array(
        *[F.struct(F.lit(m).alias("metric"), F.col(f"s_{m}").alias("value"), F.col(f"n_{m}").alias("records"))
          for m in metrics]
    )
    return (
        sums.select("ord", F.inline(entries))
        .where(F.col("records") > 0)
        .select("metric", "ord", month_label(F.col("ord")).alias("period"), "value", "records")
    )


def coverage(df: DataFrame, date: str, metrics: dict[str, str]) -> DataFrame:
    """Input rows and rows usable for the series, per metric."""
    ts = F.col(f"`{date}`")
    agg = df.agg(
        F.count(F.lit(1)).alias("input_records"),
        *[F.count_if(ts.isNotNull() & not_nan(F.col(f"`{c}`").try_cast("double")).isNotNull()).alias(m)
          for m, c in metrics.items()],
    )
    return agg.unpivot(["input_records"], list(metrics), "metric", "valid_records").select(
        "metric", "input_records", "valid_records"
    )


def series_magnitude(series: DataFrame, keys: list[str]) -> DataFrame:
    """Median of the absolute non-zero finite values of each series."""
    size = F.abs(finite(F.col("value")))
    return series.groupBy(*keys).agg(F.coalesce(F.median(F.when(size > 0, size)), F.lit(0.0)).alias("magnitude"))


def compare_series(series: DataFrame, keys: list[str] | None = None, granularity: str = "M") -> DataFrame:
    """Change from each observed period to the next one; a gap is reported, not bridged."""
    keys = ["metric"] if keys is None else keys
    ordered = series if "ord" in series.columns else series.withColumn("ord", period_ordinal(F.col("period"), granularity))
    w = Window.partitionBy(*keys).orderBy(F.col("ord").asc_nulls_last(), F.col("period"))
    size = F.abs(finite(F.col("value")))
    magnitude = F.coalesce(F.median(F.when(size > 0, size)).over(Window.partitionBy(*keys)), F.lit(0.0))
    stepped = ordered.select(
        *keys, "ord", "period", "value", "records",
        magnitude.alias("series_magnitude"),
        F.row_number().over(w).alias("pos"),
        F.lag("value").over(w).alias("prev_value"),
        F.lag("period").over(w).alias("previous_period"),
        F.lag("ord").over(w).alias("prev_ord"),
        F.lag("records").over(w).alias("previous_records"),
    ).where(F.col("pos") > 1)
    compared = with_comparison(
        stepped, F.col("prev_value"), F.col("value"), F.col("series_magnitude"), F.col("prev_ord"), F.col("ord"), True)
    return compared.select(
        *keys, "previous_period", F.col("period").alias("current_period"), "ord",
        "previous_records", F.col("records").alias("current_records"), "series_magnitude", *COMPARISON_FIELDS,
    )


def extremes(series: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Best and worst period of each series, the earliest on a tie."""
    keys = ["metric"] if keys is None else keys
    point = F.struct("period", "value")
    best = F.max_by(point, F.struct(F.col("value"), -F.col("ord")))
    worst = F.min_by(point, F.struct(F.col("value"), F.col("ord")))
    return series.groupBy(*keys).agg(best.alias("b"), worst.alias("w")).select(
        *keys,
        F.col("b.period").alias("best_period"), F.col("b.value").alias("best_value"),
        F.col("w.period").alias("worst_period"), F.col("w.value").alias("worst_value"),
    )


def sparse_periods(series: DataFrame) -> DataFrame:
    """Periods backed by too few records to be trusted."""
    return series.where(F.col("records") < FEW_RECORDS).select("metric", "period", "records", F.col("value").alias("value"))


def public_reason(reason: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in PUBLIC_REASONS.items() for x in pair])
    return F.coalesce(F.try_element_at(names, reason), reason)


def trend(evolution: Column) -> Column:
    return (
        F.when(evolution.isNull(), F.lit("dados_insuficientes"))
        .when(evolution > TREND_PERCENT, F.lit("crescimento"))
        .when(evolution < -TREND_PERCENT, F.lit("queda"))
        .otherwise(F.lit("estavel"))
    )


def total_evolution(series: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """First against last period of each series, with the trend class."""
    keys = ["metric"] if keys is None else keys
    point = F.struct("period", "ord", "value")
    size = F.abs(finite(F.col("value")))
    ends = series.groupBy(*keys).agg(
        F.min_by(point, "ord").alias("a"),
        F.max_by(point, "ord").alias("z"),
        F.count(F.lit(1)).alias("periods"),
        F.coalesce(F.median(F.when(size > 0, size)), F.lit(0.0)).alias("magnitude"),
    )
    compared = with_comparison(
        ends, F.col("a.value"), F.col("z.value"), F.col("magnitude"), F.col("a.ord"), F.col("z.ord"))
    enough = F.col("periods") >= 2
    facts = compared.select(
        *keys, "periods",
        F.col("a.period").alias("first_period"), F.col("z.period").alias("last_period"),
        F.col("a.value").alias("first_value"), F.col("z.value").alias("last_value"),
        F.when(enough, F.col("percentage_change")).alias("evolution"),
        F.when(enough, F.col("absolute_change")).alias("absolute_change"),
        F.when(enough, F.coalesce("reason", F.lit(""))).otherwise("invalid_value").alias("reason"),
    )
    named = F.when(F.col("reason") != "", public_reason(F.col("reason")))
    return facts.withColumn("reason", named).withColumn("trend", trend(F.col("evolution")))


def decline_runs(changes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Runs of at least two negative percentage changes in a row."""
    keys = ["metric"] if keys is None else keys
    w = Window.partitionBy(*keys).orderBy("ord")
    falling = F.coalesce(F.col("percentage_change") < 0, F.lit(False))
    marked = changes.select(
        *keys, "ord", "current_period", "percentage_change", falling.alias("falling"),
        F.sum(F.when(falling, 0).otherwise(1)).over(w).alias("run"),
    )
    return (
        marked.where("falling").groupBy(*keys, "run")
        .agg(
            F.min_by("current_period", "ord").alias("run_start"),
            F.max_by("current_period", "ord").alias("run_end"),
            F.count(F.lit(1)).alias("length"),
            F.min("ord").alias("start_ord"),
            F.sum("percentage_change").alias("sum_percent"),
        )
        .where(F.col("length") >= 2)
        .drop("run")
    )


def growth_extremes(changes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Largest growth and largest drop of each series, the earliest on a tie."""
    keys = ["metric"] if keys is None else keys
    p = F.col("percentage_change")
    point = F.struct(F.col("current_period").alias("period"), p.alias("v"))
    up = F.max_by(F.when(p > 0, point), F.when(p > 0, F.struct(p, -F.col("ord"))))
    down = F.min_by(F.when(p < 0, point), F.when(p < 0, F.struct(p, F.col("ord"))))
    return changes.groupBy(*keys).agg(up.alias("u"), down.alias("d")).select(
        *keys,
        F.col("u.period").alias("growth_period"), F.col("u.v").alias("growth_percent"),
        F.col("d.period").alias("drop_period"), F.col("d.v").alias("drop_percent"),
    )


def growth_summary(series: DataFrame) -> DataFrame:
    """Evolution, trend, extremes and the longest decline run of every metric. The series is written once, as four rules read it."""
    series = cut_lineage(series)
    changes = cut_lineage(compare_series(series))
    runs = decline_runs(changes).groupBy("metric").agg(
        F.count(F.lit(1)).alias("decline_runs"),
        F.max_by(F.struct("run_start", "run_end", "length"), F.struct(F.col("length"), -F.col("start_ord"))).alias("r"),
    ).select(
        "metric", "decline_runs", F.col("r.length").alias("longest_decline"),
        F.col("r.run_start").alias("longest_decline_start"), F.col("r.run_end").alias("longest_decline_end"),
    )
    return (
        total_evolution(series)
        .join(growth_extremes(changes), "metric", "left")
        .join(runs, "metric", "left")
        .withColumn("decline_runs", F.coalesce("decline_runs", F.lit(0).cast("bigint")))
    )


def profit_performance(df: DataFrame, profit: str) -> DataFrame:
    """Total, loss records and the evidence behind negative results."""
    v = not_nan(F.col(f"`{profit}`").try_cast("double"))
    loss = F.sum(F.when(v < 0, v))
    return df.agg(
        F.coalesce(F.sum(v), F.lit(0.0)).alias("lucro_total"),
        F.count_if(v < 0).alias("registros_prejuizo"),
        F.coalesce(loss, F.lit(0.0)).alias("prejuizo_total"),
        F.count(F.lit(1)).alias("registros"),
        F.count(v).alias("registros_validos"),
        F.coalesce(loss, F.lit(0.0)).alias("soma_negativos"),
        F.coalesce(F.sum(F.abs(v)), F.lit(0.0)).alias("soma_absoluta"),
    )


def loss_periods(series: DataFrame, metric: str = "lucro") -> DataFrame:
    return series.where((F.col("metric") == metric) & (F.col("value") < 0)).select(
        "period", F.col("value").alias("value")
    )


def chart_series(series: DataFrame, main_metric: str) -> DataFrame:
    """Main metric, revenue and profit side by side, any period that has one of them."""
    def one(metric: str, alias: str) -> DataFrame:
        return series.where(F.col("metric") == metric).select("period", F.col("value").alias(alias))

    return (
        one(main_metric, "metric_value")
        .join(one("faturamento", "faturamento"), "period", "full")
        .join(one("lucro", "lucro"), "period", "full")
    )


def temporal_summary(series: DataFrame, main_metric: str) -> DataFrame:
    """One row: range, first and last value, best and worst month, growth extremes."""
    main = series.where(F.col("metric") == main_metric)
    return (
        growth_summary(main).join(extremes(main), "metric")
        .select(
            "metric",
            F.concat(F.col("first_period"), F.lit(" a "), F.col("last_period")).alias("analysed_range"),
            F.col("first_value").alias("first_value"),
            F.col("last_value").alias("last_value"),
            "evolution", "absolute_change", "reason", "trend",
            "best_period", "best_value", "worst_period", "worst_value",
            "growth_period", "growth_percent", "drop_period", "drop_percent", "decline_runs",
        )
    )
