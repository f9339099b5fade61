"""Executive selection of findings: few, strong and diverse.

The input is a findings frame whose length is limited by the rules, so the
ordered windows here run over at most a few hundred rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .findings import distinct_findings, level_order

# Fixed values.
MAX_SELECTED = 8
MAX_LOW_IMPACT = 2
MAX_LOW_CONFIDENCE = 2
PAGE_SIZE = 10
POLICY = "diversity_within_same_rank"


def family(rule: Column, scope: Column) -> Column:
    return (
        F.when(rule == "customer_concentration", "concentracao")
        .when(rule == "negative_results", "resultados_negativos")
        .when(F.startswith(rule, F.lit("temporal_")), "temporal")
        .when(scope == "customers", "clientes").when(scope == "products", "produtos").otherwise("outros")
    )


def _rank() -> list[Column]:
    return [level_order(F.col(c)) for c in ("priority", "impact", "confidence")]


def _order() -> list[Column]:
    return [*_rank(), F.col("materiality").isNull(), -F.coalesce("materiality", F.lit(0.0)), F.col("id")]


def collapse_events(findings: DataFrame) -> DataFrame:
    """One finding per event; the contributor reading wins over the plain one."""
    event = [F.replace("rule", F.lit("_contributor_"), F.lit("_")), F.col("metric"), F.col("scope"),
             F.coalesce("entity.id", "entity.value"), F.col("period.start"), F.col("period.end")]
    w = Window.partitionBy(*event).orderBy(~F.contains("rule", F.lit("_contributor_")), *_order())
    return findings.withColumn("_e", F.row_number().over(w)).where(F.col("_e") == 1).drop("_e")


def select_findings(findings: DataFrame, limit: int = MAX_SELECTED) -> DataFrame:
    """The main findings in order, with why each was taken and whose advice is repeated.

    Inside one rank (same priority, impact and confidence) families take turns:
    the n-th finding of every family comes before the (n+1)-th of any. A rank
    has a single confidence, so the cap on low confidence removes a tail of it.
    """
    limit = max(0, limit)
    events = collapse_events(distinct_findings(findings)).withColumn("family", family(F.col("rule"), F.col("scope")))
    everything = Window.partitionBy(F.lit(0))
    some_impact = F.max(F.when(F.col("impact") != "low", 1).otherwise(0)).over(everything)
    kept = events.withColumn("_some", some_impact).where((F.col("_some") == 0) | (F.col("impact") != "low"))
    kept = kept.withColumn("_limit", F.when(F.col("_some") == 0, F.lit(min(limit, MAX_LOW_IMPACT))).otherwise(F.lit(limit)))
    kept = kept.withColumn("_strong", F.count_if(F.col("confidence") != "low").over(everything))
    low_cap = F.when(F.col("_strong") > 0, F.least(F.lit(MAX_LOW_CONFIDENCE), F.col("_strong"))).otherwise(F.col("_limit"))
    turn = Window.partitionBy(*_rank(), "family").orderBy(*_order())
    ordered = kept.withColumn("_turn", F.row_number().over(turn))
    sequence = [*_rank(), F.col("_turn"), *_order()]
    low_first = Window.partitionBy(F.col("confidence") == "low").orderBy(*sequence)
    allowed = ordered.withColumn("_low", F.row_number().over(low_first)).where(
        (F.col("confidence") != "low") | (F.col("_low") <= low_cap))
    placed = allowed.withColumn("position", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*sequence))).where(
        F.col("position") <= F.col("_limit"))
    advice = F.lower(F.trim(F.regexp_replace(F.coalesce("recommendation", F.lit("")), r"\s+", " ")))
    same = Window.partitionBy("_advice").orderBy("position")
    return (
        placed.withColumn("_advice", advice)
        .withColumn("_first", F.first("id").over(same)).withColumn("_nth", F.row_number().over(same))
        .withColumn("show_recommendation", (F.col("_advice") != "") & (F.col("_nth") == 1))
        .withColumn("recommendation_reference", F.when((F.col("_advice") != "") & (F.col("_nth") > 1), F.col("_first")))
        .withColumn("policy", F.lit(POLICY))
        .drop("_some", "_limit", "_strong", "_turn", "_low", "_advice", "_first", "_nth")
    )


def filter_findings(findings: DataFrame, page: int = 1, **wanted: str) -> DataFrame:
    """Findings of a family, priority, impact or confidence, ten per page, in finding order."""
    rows = findings.withColumn("family", family(F.col("rule"), F.col("scope")))
    for column, value in wanted.items():
        rows = rows.where(F.col(column) == value)
    return rows.orderBy(*_rank(), "id").offset((page - 1) * PAGE_SIZE).limit(PAGE_SIZE)
