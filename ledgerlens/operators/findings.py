"""Rule-based findings with evidence, confidence and a deterministic id."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import digest24, fixed2, json_text
from .temporal import METRIC_LABELS

# Thresholds, order of levels, priority table, limits.
MIN_POPULATION = 10
HIGH_COVERAGE = 0.95
TOP5_MEDIUM, TOP5_HIGH = 50, 80
LOSS_MEDIUM, LOSS_HIGH = 0.05, 0.2
CENT = 0.005
TEMPORAL_DELTA, TEMPORAL_DELTA_HIGH, TEMPORAL_PERCENT_HIGH = 0.2, 0.5, 20
ENTITY_DELTA, ENTITY_DELTA_HIGH = 0.02, 0.2
GLOBAL_DELTA, CONTRIBUTION_MIN, CONTRIBUTION_HIGH = 0.1, 10, 30
MIN_RECORDS = 5
PER_RULE, PER_SCOPE = 5, 100
LEVELS = ("high", "medium", "low")
PRIORITY = {
    ("high", "high"): "high", ("high", "medium"): "medium", ("high", "low"): "medium",
    ("medium", "high"): "medium", ("medium", "medium"): "medium", ("medium", "low"): "low",
    ("low", "high"): "low", ("low", "medium"): "low", ("low", "low"): "low",
}
# Texts.
R_METRIC = "Métrica identificada como {}; descreve valores informados."
R_NO_COVERAGE = "Cobertura da população não documentada neste resultado."
R_LOW_COVERAGE = "Menos de 95% dos registros têm os campos necessários preenchidos."
R_HIGH_COVERAGE = "Ao menos 95% dos registros têm os campos necessários preenchidos."
R_NO_POPULATION = "População com métrica válida desconhecida."
R_SMALL = "População com menos de 10 observações; interpretação restrita."
R_NAMES = "Identidade baseada em nomes; variantes podem representar a mesma entidade."
R_SHARE = "Denominador positivo e valores não negativos para a participação."
R_CONCEPT = "Conceito preservado: {}; períodos consecutivos."
R_CALENDAR = "Cobertura do calendário operacional desconhecida; não se presume período completo."
R_FIELDS = "Cobertura dos campos inferior a 95% ou desconhecida."
R_FEW = "Menos de três períodos ou contagem inferior a cinco/desconhecida em um dos períodos comparados."
R_DELTA = "Percentual indisponível: {}; conclusão baseada no delta absoluto."
R_WHOLE = "População completa consultada; valores observados nos dois períodos consecutivos."
R_MONTH = "Cobertura do calendário operacional desconhecida; não se presume mês completo."
R_IDENTITY = "Identidade: {}; conceito: {}."
R_ALIAS = "Identidade textual, mesmo após confirmação de alias, não equivale a ID estável."
R_ENTITY_FIELDS = "Cobertura de campos inferior a 95%, nulos na entidade ou menos de cinco registros válidos em um período."
R_ABSOLUTE = "Percentual indisponível: {}; usa-se variação absoluta."
T_CONCENTRATION = "Participação dos principais clientes"
T_NEGATIVE = "Resultados negativos de {}"
S_CONCENTRATION = "Os {} maiores clientes representam {}% de {}, entre {} clientes com valor válido."
S_NEGATIVE = "{} {} {} {}, em uma população de {} {}s com valor válido. Soma dos resultados negativos: {}."
A_CONCENTRATION = "Monitorar a participação dos principais clientes e investigar possibilidades de diversificação da carteira."
A_NEGATIVE = "Revisar os valores informados de {} e investigar os resultados negativos dessa população."
A_TEMPORAL = "Investigar os componentes da variação observada de {} e conferir a cobertura dos períodos."
A_ENTITY = "Investigar a variação observada de {} associada a {} e conferir a cobertura dos períodos."

EVIDENCE = "array<struct<name:string,value:double,unit:string,source:string,numerator:double,denominator:double>>"
COLUMNS = (
    "id", "rule", "title", "summary", "metric", "metric_label", "scope", "entity", "impact", "confidence",
    "confidence_reasons", "priority", "period", "absolute_change", "percentage_change", "materiality", "evidence",
    "recommendation",
)


def filled(template: str, *args: Column | str) -> Column:
    """Template with ``{}`` slots filled by columns."""
    pieces = template.split("{}")
    out: list[Column] = [F.lit(pieces[0])]
    for a, p in zip(args, pieces[1:]):
        out += [a if isinstance(a, Column) else F.lit(a), F.lit(p)]
    return F.concat(*out)


def level_order(c: Column) -> Column:
    return F.when(c == "high", 0).when(c == "medium", 1).otherwise(2)


def priority(impact: Column, confidence: Column) -> Column:
    out = F.lit(None).cast("string")
    for (i, c), p in PRIORITY.items():
        out = F.when((impact == i) & (confidence == c), p).otherwise(out)
    return out


def metric_label(metric: Column) -> Column:
    out = F.lit(None).cast("string")
    for m, label in METRIC_LABELS.items():
        out = F.when(metric == m, label).otherwise(out)
    return out


def finding_id(analysis: str | None, rule: Column, metric: Column, scope: Column, identity: Column | None = None,
               start: Column | None = None, end: Column | None = None) -> Column:
    """Digest of the event: same analysis, rule, metric, scope, entity and period give the same id."""
    period = F.lit("null") if start is None else F.concat(
        F.lit('{"end": '), json_text(end), F.lit(', "granularity": "M", "start": '), json_text(start), F.lit("}"))
    parts = [json_text(F.lit(analysis).cast("string")), json_text(rule), json_text(metric), json_text(scope),
             F.lit("null") if identity is None else json_text(identity.cast("string")), period, F.lit("null")]
    payload = F.concat(F.lit("["), F.concat_ws(", ", *parts), F.lit("]"))
    return F.concat(F.lit("finding-"), digest24(payload))


def _reasons(*items: Column) -> Column:
    return F.array_compact(F.array(*items))


def _evidence(*items: tuple) -> Column:
    """(name, value, unit, source[, numerator, denominator]) tuples as an evidence array."""
    def entry(name, value, unit, source, num=None, den=None):
        none = F.lit(None).cast("double")
        return F.struct(
            F.lit(name).alias("name"), value.cast("double").alias("value"), F.lit(unit).cast("string").alias("unit"),
            F.lit(source).alias("source"), (none if num is None else num.cast("double")).alias("numerator"),
            (none if den is None else den.cast("double")).alias("denominator"))
    return F.array(*[entry(*i) for i in items])


def _no_entity() -> Column:
    return F.lit(None).cast("struct<id:string,value:string,label:string,identity_source:string>")


def _no_period() -> Column:
    return F.lit(None).cast("struct<start:string,end:string,granularity:string>")


def _population_confidence(by_name: bool) -> tuple[Column, Column]:
    """Confidence and reasons from coverage and population columns."""
    rows, valid, population = F.col("registros"), F.col("registros_validos"), F.col("populacao")
    documented = F.coalesce(rows > 0, F.lit(False)) & valid.isNotNull()
    covered = documented & (F.try_divide(valid, rows) >= HIGH_COVERAGE)
    small = population.isNull() | (population < MIN_POPULATION)
    level = F.when(small | (documented & ~covered), "low").when(~documented | F.lit(by_name), "medium").otherwise("high")
    return level, _reasons(
        filled(R_METRIC, metric_label(F.col("metric"))),
        F.when(~documented, R_NO_COVERAGE).when(covered, R_HIGH_COVERAGE).otherwise(R_LOW_COVERAGE),
        F.when(population.isNull(), R_NO_POPULATION).when(population < MIN_POPULATION, R_SMALL),
        F.lit(R_NAMES if by_name else None).cast("string"),
    )


def concentration_finding(stats: DataFrame, metric: str, with_id: bool, analysis: str | None = None) -> DataFrame:
    """Share of the five largest customers, if the total is positive and nothing is negative."""
    total, top1, top5, n = (F.col(c) for c in ("total_metrica", "top1_valor", "top5_valor", "populacao"))
    share = F.try_divide(top5, total) * 100
    usable = (
        (total > 0) & (n > 0) & (top1 >= 0) & (top1 <= top5) & (top5 <= total + CENT) & (F.col("registros_negativos") == 0)
    )
    impact = F.when((n >= MIN_POPULATION) & (share >= TOP5_HIGH), "high").when(
        (n >= MIN_POPULATION) & (share >= TOP5_MEDIUM), "medium").otherwise("low")
    rows = stats.where((F.col("concept") == metric) & usable).withColumn("metric", F.col("concept"))
    confidence, reasons = _population_confidence(not with_id)
    src = f"clientes.evidencias_metricas.{metric}"
    label = metric_label(F.col("metric"))
    rule, scope = F.lit("customer_concentration"), F.lit("customers")
    return rows.select(
        finding_id(analysis, rule, F.col("metric"), scope).alias("id"), rule.alias("rule"), F.lit(T_CONCENTRATION).alias("title"),
        filled(S_CONCENTRATION, F.least(F.lit(5), n).cast("string"), fixed2(share), label, n.cast("string")).alias("summary"),
        "metric", label.alias("metric_label"), scope.alias("scope"), _no_entity().alias("entity"),
        impact.alias("impact"), confidence.alias("confidence"),
        F.array_append(reasons, F.lit(R_SHARE)).alias("confidence_reasons"), priority(impact, confidence).alias("priority"),
        _no_period().alias("period"), F.lit(None).cast("double").alias("absolute_change"),
        F.lit(None).cast("double").alias("percentage_change"), (F.abs(share) / 100).alias("materiality"),
        _evidence(
            ("registros", F.col("registros"), "count", f"{src}.registros"),
            ("registros_validos", F.col("registros_validos"), "count", f"{src}.registros_validos"),
            ("populacao", n, "count", f"{src}.populacao"), ("total_metrica", total, None, f"{src}.total_metrica"),
            ("top1_valor", top1, None, f"{src}.top1_valor"), ("top5_valor", top5, None, f"{src}.top5_valor"),
            ("top1_percentual", F.try_divide(top1, total) * 100, "%", src, top1, total), ("top5_percentual", share, "%", src, top5, total),
        ).alias("evidence"),
        F.when(impact != "low", A_CONCENTRATION).alias("recommendation"),
    )


def negative_findings(stats: DataFrame, scope: str, with_id: bool = True, analysis: str | None = None) -> DataFrame:
    """Negative results of a population; ``stats`` has one row per metric with the negative evidence."""
    count, n, loss, size = (F.col(c) for c in ("negativos", "populacao", "soma_negativos", "soma_absoluta"))
    usable = (count > 0) & (n >= count) & (loss < 0) & (size >= F.abs(loss)) & (size > 0)
    relative = F.try_divide(F.abs(loss), size)
    enough = n >= MIN_POPULATION
    impact = F.when(enough & (count >= 5) & (F.try_divide(count, n) >= LOSS_HIGH) & (relative >= LOSS_HIGH), "high").when(
        enough & (count >= 2) & (relative >= LOSS_MEDIUM), "medium").otherwise("low")
    rows = stats.where(F.col("concept").isin("lucro", "margem_bruta") & usable).withColumn("metric", F.col("concept"))
    customers = scope == "customers"
    confidence, reasons = _population_confidence(customers and not with_id)
    noun = "cliente" if customers else "registro"
    label = metric_label(F.col("metric"))
    verb = F.when(count == 1, f"{noun} apresenta").otherwise(f"{noun}s apresentam")
    adjective = F.when(F.col("metric") == "margem_bruta", "negativa").otherwise("negativo")
    src = "clientes.evidencias_metricas" if customers else "desempenho.evidencias_negativos"
    rule, scope_c = F.lit("negative_results"), F.lit(scope)
    return rows.select(
        finding_id(analysis, rule, F.col("metric"), scope_c).alias("id"), rule.alias("rule"),
        filled(T_NEGATIVE, label).alias("title"),
        filled(S_NEGATIVE, count.cast("string"), verb, label, adjective, n.cast("string"), noun, fixed2(loss)).alias("summary"),
        "metric", label.alias("metric_label"), scope_c.alias("scope"), _no_entity().alias("entity"), impact.alias("impact"),
        confidence.alias("confidence"), reasons.alias("confidence_reasons"), priority(impact, confidence).alias("priority"),
        _no_period().alias("period"), F.lit(None).cast("double").alias("absolute_change"),
        F.lit(None).cast("double").alias("percentage_change"), relative.alias("materiality"),
        _evidence(
            ("registros", F.col("registros"), "count", src), ("registros_validos", F.col("registros_validos"), "count", src),
            ("populacao", n, "count", src), ("negativos", count, "count", src), ("soma_negativos", loss, None, src),
            ("soma_absoluta", size, None, src),
            ("participacao_magnitude_negativa", relative * 100, "%", src, F.abs(loss), size),
            ("participacao_populacao_negativa", F.try_divide(count, n) * 100, "%", src, count, n),
        ).alias("evidence"),
        filled(A_NEGATIVE, label).alias("recommendation"),
    )


def temporal_findings(changes: DataFrame, coverage: DataFrame, analysis: str | None = None) -> DataFrame:
    """Month-over-month changes that matter against the usual size of the series.

    ``changes`` is the compared series, ``coverage`` its (metric, input, valid) counts;
    both have calendar size.
    """
    observed = Window.partitionBy("metric")
    rows = changes.withColumn("periods", F.count(F.lit(1)).over(observed) + 1).join(F.broadcast(coverage), "metric")
    delta, percent = F.col("absolute_change"), F.col("percentage_change")
    scale = F.greatest(F.col("series_magnitude"), F.coalesce("reference_magnitude", F.lit(0.0)))
    ratio = F.try_divide(F.abs(delta), scale)
    rows = rows.where(F.col("comparable") & F.col("continuous") & (delta != 0) & (scale > 0)).where(ratio >= TEMPORAL_DELTA)
    covered = (F.col("input_records") > 0) & (F.try_divide(F.col("valid_records"), F.col("input_records")) >= HIGH_COVERAGE)
    counted = (F.col("previous_records") >= MIN_RECORDS) & (F.col("current_records") >= MIN_RECORDS)
    solid = covered & counted & (F.col("periods") >= 3)
    confidence = F.when(solid, "medium").otherwise("low")
    impact = F.when(
        solid & F.coalesce(F.abs(percent) >= TEMPORAL_PERCENT_HIGH, F.lit(False)) & (ratio >= TEMPORAL_DELTA_HIGH), "high"
    ).otherwise("medium")
    up = F.col("direction") == "increase"
    rule = F.when(up, "temporal_growth").otherwise("temporal_decline")
    label, before, after = metric_label(F.col("metric")), F.col("previous_period"), F.col("current_period")
    tail = F.when(percent.isNotNull(), filled(" ({}%)", fixed2(F.abs(percent)))).otherwise("; percentual indisponível")
    scope = F.lit("temporal")
    return rows.select(
        finding_id(analysis, rule, F.col("metric"), scope, None, before, after).alias("id"), rule.alias("rule"),
        filled("{} relevante de {}", F.when(up, "Aumento").otherwise("Redução"), label).alias("title"),
        filled("{} {} {} entre {} e {}{}.", label, F.when(up, "aumentou").otherwise("diminuiu"), fixed2(F.abs(delta)), before, after, tail).alias("summary"),
        "metric", label.alias("metric_label"), scope.alias("scope"), _no_entity().alias("entity"),
        impact.alias("impact"), confidence.alias("confidence"),
        _reasons(
            filled(R_CONCEPT, label), F.lit(R_CALENDAR), F.when(~covered, R_FIELDS),
            F.when(~counted | (F.col("periods") < 3), R_FEW), F.when(~F.col("percentage_valid"), filled(R_DELTA, F.col("reason"))),
        ).alias("confidence_reasons"),
        priority(impact, confidence).alias("priority"),
        F.struct(before.alias("start"), after.alias("end"), F.lit("M").alias("granularity")).alias("period"),
        "absolute_change", "percentage_change", ratio.alias("materiality"),
        _evidence(
            ("materialidade_absoluta", ratio, "ratio", "analise_temporal", F.abs(delta), scale),
            ("registros_periodo_anterior", F.col("previous_records"), "count", "analise_temporal"),
            ("registros_periodo_atual", F.col("current_records"), "count", "analise_temporal"),
            ("periodos_observados", F.col("periods"), "count", "analise_temporal"),
        ).alias("evidence"),
        filled(A_TEMPORAL, label).alias("recommendation"),
    )


def entity_findings(changes: DataFrame, movements: DataFrame, kind: str, analysis: str | None = None) -> DataFrame:
    """Entities whose own change, or share of the global change, is material.

    At most five per rule and window and a hundred per entity type are reported,
    which is the length of the report; both limits are ranked windows.
    """
    prefix, scope_name = ("customer", "customers") if kind == "cliente" else ("product", "products")
    delta, total = F.col("absolute_change"), F.col("global_change")
    scale = F.greatest(F.col("series_magnitude"), F.coalesce("global_magnitude", F.lit(0.0)))
    ratio = F.try_divide(F.abs(delta), scale)
    rows = changes.where((scale > 0) & (ratio >= ENTITY_DELTA))
    together = delta * total > 0
    contribution = F.when(together, F.try_divide(delta, total) * 100)
    contributor = together & F.col("complete_fields") & (F.try_divide(F.abs(total), scale) >= GLOBAL_DELTA) & (contribution >= CONTRIBUTION_MIN)
    full = lambda s: (F.col(f"valid_{s}") >= MIN_RECORDS) & (F.col(f"valid_{s}") == F.col(f"records_{s}"))
    sufficient = full("before") & full("after")
    solid = F.col("complete_fields") & sufficient
    confidence = F.when(solid, "medium").otherwise("low")
    impact = F.when(
        solid & ((ratio >= ENTITY_DELTA_HIGH) | (contributor & (contribution >= CONTRIBUTION_HIGH))), "high").otherwise("medium")
    up = delta > 0
    rule = F.concat(F.lit(prefix), F.when(contributor, "_contributor_").otherwise("_"), F.when(up, "growth").otherwise("decline"))
    scope = F.lit(scope_name)
    value, before, after = F.col("entity").cast("string"), F.col("previous_period"), F.col("current_period")
    label, name = metric_label(F.col("metric")), F.col("label")
    movement, seen = F.when(up, "aumento").otherwise("redução"), F.when(up, "observado").otherwise("observada")
    summary = F.concat(
        filled("{}: {} {} de {} em {}, entre {} e {}.", name, movement, seen, fixed2(F.abs(delta)), label, before, after),
        F.when(contributor, filled(" Equivale a {}% da variação líquida global; outras entidades podem compensar esse movimento.",
                                   fixed2(contribution))).otherwise(""),
    )
    moves = movements.select("metric", "ord_before", "gross_growth", "gross_decline", "unexplained")
    rows = rows.join(F.broadcast(moves), ["metric", "ord_before"])
    gross = F.when(up, F.col("gross_growth")).otherwise(F.col("gross_decline"))
    src = "entity_evolution.population"
    stable = F.col("identity_source") == "stable_id"
    found = rows.select(
        finding_id(analysis, rule, F.col("metric"), scope, value, before, after).alias("id"), rule.alias("rule"),
        filled("{} {} por {}", F.initcap(movement), seen, kind).alias("title"), summary.alias("summary"), "metric",
        label.alias("metric_label"), scope.alias("scope"),
        F.struct(F.when(stable, value).alias("id"), value.alias("value"), name.alias("label"), "identity_source").alias("entity"),
        impact.alias("impact"), confidence.alias("confidence"),
        _reasons(
            F.lit(R_WHOLE), F.lit(R_MONTH), filled(R_IDENTITY, F.col("identity_source"), label), F.when(~stable, R_ALIAS),
            F.when(~solid, R_ENTITY_FIELDS), F.when(~F.col("percentage_valid"), filled(R_ABSOLUTE, F.col("reason"))),
        ).alias("confidence_reasons"),
        priority(impact, confidence).alias("priority"),
        F.struct(before.alias("start"), after.alias("end"), F.lit("M").alias("granularity")).alias("period"),
        "absolute_change", "percentage_change", ratio.alias("materiality"),
        _evidence(
            ("materialidade_entidade", ratio, "ratio", src, F.abs(delta), scale),
            ("contribuicao", contribution, "%", src, delta, F.when(together, total)),
            ("participacao_anterior", F.col("previous_share"), "%", src), ("participacao_atual", F.col("current_share"), "%", src),
            ("participacao_na_direcao", F.when(gross > 0, F.abs(delta) / gross * 100), "%", src, F.abs(delta), gross),
            ("nao_explicado_pelos_pares", F.col("unexplained"), None, src),
        ).alias("evidence"),
        filled(A_ENTITY, label, name).alias("recommendation"), F.col("ord_before"),
    )
    rank = [level_order(F.col("priority")), level_order(F.col("impact")), F.abs(F.col("absolute_change")).desc(), F.col("id")]
    per_rule = Window.partitionBy("metric", "ord_before", "rule").orderBy(*rank)
    per_scope = Window.partitionBy("scope").orderBy(*rank)
    top = found.withColumn("_r", F.row_number().over(per_rule)).where(F.col("_r") <= PER_RULE)
    return top.withColumn("_s", F.row_number().over(per_scope)).where(F.col("_s") <= PER_SCOPE).select(*COLUMNS)


def distinct_findings(findings: DataFrame) -> DataFrame:
    """One row per id, the strongest one."""
    w = Window.partitionBy("id").orderBy(*[level_order(F.col(c)) for c in ("priority", "impact", "confidence")])
    return findings.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == 1).drop("_n")


def ordered_findings(findings: DataFrame) -> DataFrame:
    return findings.orderBy(*[level_order(F.col(c)) for c in ("priority", "impact", "confidence")], "id")


def all_findings(*parts: DataFrame) -> DataFrame:
    return distinct_findings(reduce(lambda a, b: a.unionByName(b), [p.select(*COLUMNS) for p in parts]))
