"""Comparison of two stored analyses; every input is a short long-format frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import finite
from .findings import filled

# Fixed values.
STABLE_PERCENT = 0.5
SIMILAR_RATIO = 1.1
MARGINS = ("margem_lucro", "margem_bruta_percentual")
LABELS = {
    "faturamento_total": "Faturamento", "lucro_total": "Lucro", "custo_total": "Custo", "margem_lucro": "Margem de lucro",
    "ticket_medio": "Ticket médio", "quantidade_pedidos": "Pedidos", "quantidade_registros": "Registros",
    "quantidade_vendida": "Quantidade vendida", "valor_total": "Valor Total", "valor_com_desconto": "Valor com Desconto",
    "margem_bruta": "Margem Bruta", "margem_bruta_percentual": "Margem Bruta %",
}
TOP = 5
MESSAGE = "{} {} {} entre as análises."
NO_PERCENT = "sem variação percentual calculável"


def snapshot_kpis(current: DataFrame, previous: DataFrame) -> DataFrame:
    """(indicador, atual, anterior, percent, points): points for margins, percent otherwise."""
    a = current.select("indicador", F.col("valor").alias("atual"))
    b = previous.select("indicador", F.col("valor").alias("anterior"))
    margin = F.col("indicador").isin(*MARGINS)
    x, y = F.col("atual"), F.col("anterior")
    return a.join(b, "indicador", "full").select(
        "indicador", "atual", "anterior",
        F.when(~margin, F.round(finite(F.try_divide(x - y, y) * 100), 2)).alias("percent"),
        F.when(margin, F.round(finite(x - y), 2)).alias("points"))


def metric_changes(left: DataFrame, right: DataFrame) -> DataFrame:
    """Indicators both analyses have, with change, percentage or points, and direction."""
    names = left.sparkSession.createDataFrame(list(LABELS.items()), "indicador string, label string")
    both = (
        left.select("indicador", finite(F.col("valor")).alias("left")).join(right.select("indicador", finite(F.col("valor")).alias("right")), "indicador")
        .join(F.broadcast(names), "indicador").where("left is not null and right is not null")
    )
    delta = F.round(F.col("right") - F.col("left"), 2)
    sized = both.withColumn("absolute_change", delta).withColumn(
        "p", F.round(F.try_divide(F.col("absolute_change"), F.col("left")) * 100, 2))
    d, p, margin = F.col("absolute_change"), F.col("p"), F.col("indicador").isin(*MARGINS)
    still = F.when(p.isNotNull(), F.abs(p) < STABLE_PERCENT).otherwise(d == 0)
    return sized.select(
        "indicador", "label", "left", "right", "absolute_change", F.when(~margin, p).alias("percentage_change"),
        F.when(margin, d).alias("point_change"),
        F.when(still, "stable").when(d > 0, "increase").otherwise("decrease").alias("direction"))


def change_messages(changes: DataFrame) -> DataFrame:
    signed = lambda c: F.format_string("%+.2f", c)
    variation = (
        F.when(F.col("point_change").isNotNull(), F.concat(signed(F.col("point_change")), F.lit(" pontos percentuais")))
        .when(F.col("percentage_change").isNotNull(), F.concat(signed(F.col("percentage_change")), F.lit("%"))).otherwise(NO_PERCENT)
    )
    verb = F.when(F.col("absolute_change") > 0, "aumentou").otherwise("diminuiu")
    return changes.where("direction <> 'stable'").select(
        F.concat(F.lit("comparison_"), "indicador").alias("category"), filled(MESSAGE, F.col("label"), verb, variation).alias("message"))


def period_range(series: DataFrame) -> DataFrame:
    return series.agg(F.min("period").alias("start"), F.max("period").alias("end"))


def period_comparability(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: both ranges, their days, and whether the durations compare."""
    def days(r: DataFrame, s: str) -> DataFrame:
        first, last = F.to_date(F.concat("start", F.lit("-01"))), F.last_day(F.to_date(F.concat("end", F.lit("-01"))))
        return r.select(F.col("start").alias(f"{s}_start"), F.col("end").alias(f"{s}_end"), (F.datediff(last, first) + 1).alias(f"{s}_days"), F.lit(1).alias("j"))

    a, b = F.col("left_days"), F.col("right_days")
    ratio = F.greatest(a, b) / F.greatest(F.lit(1), F.least(a, b))
    grade = (
        F.when(a.isNull() | b.isNull(), "unknown").when(a == b, "same_duration")
        .when(ratio <= SIMILAR_RATIO, "similar_duration").otherwise("different_duration")
    )
    return days(period_range(left), "left").join(days(period_range(right), "right"), "j").drop("j").withColumn("comparability", grade)


def _matched(left: DataFrame, right: DataFrame) -> DataFrame:
    """Full outer match of two rankings by id, or by label where there is no id."""
    def keyed(df: DataFrame, s: str) -> DataFrame:
        has_id = F.coalesce(F.col("entity_id") != "", F.lit(False))
        key = F.when(has_id, F.col("entity_id").cast("string")).otherwise(F.lower(F.trim(F.coalesce("label", F.lit("")))))
        return df.select(
            key.alias("key"), F.col("label").alias(f"{s}_label"), finite(F.col("value")).alias(s), has_id.alias(f"{s}_id"),
        ).where(F.col(s).isNotNull() & (F.col("key") != ""))

    both = keyed(left, "left").join(keyed(right, "right"), "key", "full")
    part = F.when(F.col("left").isNull(), "only_right").when(F.col("right").isNull(), "only_left").otherwise("common")
    return both.select(
        part.alias("part"), "key", F.coalesce("right_label", "left_label").alias("label"), "left", "right",
        (F.col("right") - F.col("left")).alias("absolute_change"), (F.col("left_id") & F.col("right_id")).alias("identity_reliable"))


def ranking_comparison(left: DataFrame, right: DataFrame, k: int = TOP) -> DataFrame:
    """(part, position, …) of two rankings (entity_id, label, value): common by largest change, only left, only right."""
    order = F.coalesce(F.abs("absolute_change"), F.abs(F.coalesce("left", "right")))
    w = Window.partitionBy("part").orderBy(order.desc(), "key")
    return _matched(left, right).withColumn("position", F.row_number().over(w).cast("bigint")).where(F.col("position") <= k)


def identity_reliability(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: are all common entities matched by a stable id?"""
    common = _matched(left, right).where("part = 'common'")
    sure = (F.count(F.lit(1)) > 0) & F.coalesce(F.bool_and("identity_reliable"), F.lit(False))
    return common.agg(F.when(sure, "stable_id").otherwise("label_or_mixed").alias("identity_reliability"))


def shared_periods(left: DataFrame, right: DataFrame) -> DataFrame:
    """Periods both series of one metric have."""
    a = left.select("metric", "period", F.col("value").alias("left"))
    b = right.select("metric", "period", F.col("value").alias("right"))
    return a.join(b, ["metric", "period"]).where("left is not null and right is not null")


def quality_changes(left: DataFrame, right: DataFrame) -> DataFrame:
    """Change of quality score, nulls and duplicates from two one-row quality frames."""
    keys = ["score", "total_nulls", "duplicates"]
    long = lambda q, s: q.select(*[F.col(k).cast("double").alias(k) for k in keys]).unpivot([], keys, "measure", s)
    return long(left, "left").join(long(right, "right"), "measure").where("left is not null and right is not null").withColumn(
        "absolute_change", F.col("right") - F.col("left"))
