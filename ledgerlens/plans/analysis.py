"""From tables to an executive summary: the operators composed into one analysis."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import (
    clean, entities, enrich, evolution, findings, grid, insights, mapping, metrics, quality, rankings, relate, selection, temporal,
    time_quality,
)
from ..operators.roles import detect_roles
from ..session import cut_lineage
from ..sources.files import union_continuations


@dataclass
class Analysis:
    """The frames of one analysis; each is lazy or a small materialised aggregate."""

    data: DataFrame
    roles: metrics.Roles
    results: dict[str, DataFrame] = field(default_factory=dict)

    def __getitem__(self, name: str) -> DataFrame:
        return self.results[name]


def relate_tables(tables: dict[str, DataFrame]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """One analytic frame from many tables, with the logs of how it was built."""
    if len(tables) == 1:
        return next(iter(tables.values())), {}
    relations = cut_lineage(relate.detect_relationships(tables))
    star = relate.build_star(tables, relations)
    enriched = enrich.enrich(star.frame, tables)
    return enriched.frame, {"relationships": relations, "star_log": star.log_frame(), "enrichment_log": enriched.log_frame()}


def analyze(
    tables: dict[str, DataFrame],
    confirmed: dict[str, str] | None = None,
    decisions: DataFrame | None = None,
    analysis_id: str | None = None,
    row_no: str | None = None,
) -> Analysis:
    """Runs the whole analysis over the given tables.

    ``confirmed`` maps columns to concepts the user chose, ``decisions`` are
    entity decisions to apply before the analytics. The joined tables, the
    derived frame and aggregates that several rules read are written once.
    """
    frame, results = relate_tables(tables)
    if confirmed:
        frame, results["mapping_audit"] = mapping.apply_mapping(frame, {}, confirmed)
    if len(tables) > 1:
        frame = cut_lineage(frame)  # joined once: the profiles below read it column by column
    profile = cut_lineage(quality.null_profile(frame))
    inference = cut_lineage(quality.infer_types(frame))
    duplicates = cut_lineage(quality.duplicate_rows(frame))
    issues = quality.issues(profile, inference, duplicates)
    cleaned, results["etl_log"] = clean.run_etl(frame, inference)
    derived = metrics.derive_metrics(cleaned, detect_roles(cleaned))
    data, roles = cut_lineage(derived.frame), derived.roles  # written once: every aggregate below reads a few of its columns

    open_types, _ = entities.resolvable_types(data.columns, roles)
    merged = None
    if open_types:
        candidates = cut_lineage(entities.entity_candidates(data, roles, analysis_id, row_no))
        if decisions is not None:
            candidates = cut_lineage(entities.record_decisions(candidates, decisions))
            aliases = entities.alias_map(candidates)
            data = entities.apply_aliases(data, aliases, list(open_types.values()))
            merged = aliases.select("canonical_value")
        results["entity_candidates"] = candidates
        results["entity_counts"] = entities.candidate_counts(candidates)

    kpi_row = cut_lineage(metrics.kpis(data, roles))
    results["kpis"] = metrics.kpis_long(kpi_row)
    results["sufficiency"] = insights.sufficiency(kpi_row)
    coherence = anomalies = None
    if {"faturamento", "custo", "lucro"} <= set(roles):
        coherence = results["coherence"] = cut_lineage(quality.coherence_audit(data, roles))

    date, main = roles.get("data"), temporal.time_metric(roles)
    found = []
    series = None
    if date and main and dict(data.dtypes)[date] in ("timestamp", "date", "timestamp_ntz"):
        anomalies = results["anomalies"] = cut_lineage(time_quality.anomaly_report(data, date))
        timed = time_quality.without_anomalies(data, date)
        chosen = {m: roles[m] for m in dict.fromkeys((main, "lucro")) if m in roles}
        series = results["series"] = cut_lineage(temporal.monthly_series(timed, date, chosen))
        changes = results["changes"] = cut_lineage(temporal.compare_series(series))
        results["growth"] = cut_lineage(temporal.growth_summary(series))
        results["temporal_summary"] = temporal.temporal_summary(series, main)
        found.append(findings.temporal_findings(changes, temporal.coverage(timed, date, chosen), analysis_id))
        for kind in ("cliente", "produto"):
            ident, label = roles.get(f"{kind}_id"), roles.get(kind)
            if ident or label:
                raw = evolution.entity_months(timed, date, chosen, ident, label)
                months = cut_lineage(evolution.with_identity(raw, bool(ident), bool(label), merged))
                windows = evolution.comparison_windows(
                    evolution.period_coverage(months, list(chosen)), series, evolution.undated_share(months).scalar())
                moved = cut_lineage(evolution.entity_changes(evolution.matched_pairs(months, list(chosen)), windows))
                results[f"{kind}_changes"] = moved
                found.append(findings.entity_findings(moved, evolution.window_movements(moved), kind, analysis_id))

    if "lucro" in roles:
        performance = results["performance"] = cut_lineage(temporal.profit_performance(data, roles["lucro"]))
        stats = performance.select(
            F.lit("lucro").alias("concept"), "registros", "registros_validos", F.col("registros_validos").alias("populacao"),
            F.col("registros_prejuizo").alias("negativos"), "soma_negativos", "soma_absoluta")
        found.append(findings.negative_findings(stats, "records", analysis=analysis_id))

    key, label = rankings.entity_columns(roles, "cliente")
    shown = [m for m in rankings.CUSTOMER_METRICS if m in roles]
    if key and shown:
        totals = cut_lineage(rankings.entity_totals(data, key, label, {m: roles[m] for m in shown}, row_no))
        stats = results["customer_evidence"] = cut_lineage(rankings.evidence_stats(totals, shown))
        results["customer_ranking"] = rankings.customer_ranking(totals, shown, "cliente_id" in roles)
        results["customer_messages"] = rankings.customer_messages(totals, shown)
        primary = rankings.primary_metric(roles)
        if primary:
            results["concentration"] = rankings.concentration(stats, primary)
            found.append(findings.concentration_finding(stats, primary, "cliente_id" in roles, analysis_id))
        found.append(findings.negative_findings(stats, "customers", "cliente_id" in roles, analysis_id))

    if "produto_id" in roles or "produto" in roles:
        detail = results["product_detail"] = cut_lineage(insights.product_detail(data, roles, row_no))
        results["product_ranking"] = insights.product_ranking(detail)
        results["product_means"] = insights.product_means(detail)
    if rankings.available_dimensions(roles) and "faturamento" in roles:
        dims = results["dimension_totals"] = cut_lineage(rankings.dimension_totals(data, roles, row_no))
        results["dimension_top"] = rankings.dimension_top(dims, "faturamento")

    results["quality"] = quality.quality_score(profile, duplicates, quality.quality_report(issues, coherence, anomalies))
    results["issues"] = quality.quality_report(issues, coherence, anomalies)
    if found:
        every = results["findings"] = cut_lineage(findings.all_findings(*found))
        results["selected_findings"] = selection.select_findings(every)
    _executive(results, data, roles, main)
    return Analysis(data, roles, results)


class ReviewRequired(ValueError):
    """A report whose structure is in doubt; ``detail`` has its metrics."""

    def __init__(self, detail: DataFrame):
        super().__init__("the structure of the report needs review before it is analysed")
        self.detail = detail


def report_tables(recovered: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables of a recovered report, one name each; those of one layout are continued."""
    found: dict[str, DataFrame] = {}
    for records, plan in (("records", "plan"), ("region_records", "region_plan")):
        if plan not in recovered:
            continue
        planned = cut_lineage(recovered[plan])
        for t in planned.select("file", "sheet", "table_no").distinct().orderBy("file", "sheet", "table_no").collect():  # one per table
            name = f"{t['sheet'].replace(grid.REGION_MARK, ' ')} {t['table_no']}" if t["table_no"] > 0 else t["sheet"].replace(grid.REGION_MARK, " ")
            found[name if name not in found else f"{t['file']} {name}"] = grid.table_of(recovered[records], planned, *t).drop("row_no")
    return union_continuations(found)


def analyze_report(cells: DataFrame, formulas: DataFrame | None = None, merged: DataFrame | None = None, reviewed: bool = False, **settings) -> Analysis:
    """From the grid of a report to its analysis: rows are recovered, tables named and typed, and analysed like any others.

    A report that needs review is not analysed before it is ``reviewed``. Late headers say what the columns of a headerless
    table may be called, and stand among the results as evidence; they name nothing by themselves.
    """
    recovered = grid.recover(cells, formulas, merged)
    metrics_ = cut_lineage(recovered["metrics"])
    if not reviewed and not metrics_.where("review_required").isEmpty():
        raise ReviewRequired(metrics_)
    out = analyze(report_tables(recovered), **settings)
    out.results |= {"structure": metrics_, "review": grid.review_detail(metrics_), "blocks": grid.detected_blocks(recovered["audit"]),
                    "late_headers": grid.late_headers(recovered["audit"], recovered["headers"])}
    return out


# What the rules read, where an analysis has no such part.
PARTS = {
    "growth": "metric string, trend string, evolution double, drop_percent double, drop_period string, growth_percent double, growth_period string",
    "runs": "metric string, length bigint, start_ord bigint, periods array<string>",
    "performance": "registros_prejuizo bigint, prejuizo_total double",
    "candidates": "product string, position int, lucro double",
    "extremes": "concept string, position int, product string, quantidade double, estoque_atual double, estoque_minimo double, taxa_devolucao double, avaliacao_media double",
    "means": "taxa_devolucao_media double, avaliacao_media_geral double, produtos_estoque_excessivo bigint",
    "concentration": "concentracao_top_5 double",
    "series_extremes": "metric string, best_period string, best_value double",
    "product_top": "concept string, position int, product_id string, product string, value double",
    "leader": "concept string, customer string, value double",
    "dimension_top": "dimension string, position int, value_label string, faturamento double",
}


def _executive(results: dict[str, DataFrame], data: DataFrame, roles: metrics.Roles, main: str | None) -> None:
    """Adds opportunities, insights, the organised lists, the status, the customer summary and the one-row summary.

    Everything here is made of the aggregates above; no rule reads the rows again.
    """
    spark = data.sparkSession
    parts = {name: spark.createDataFrame([], schema) for name, schema in PARTS.items()}
    parts |= {k: results[k] for k in ("growth", "performance", "concentration", "dimension_top") if k in results}
    if "series" in results:
        parts["series_extremes"] = cut_lineage(temporal.extremes(results["series"]))
        parts["runs"] = cut_lineage(insights.run_periods(results["changes"]))
    if "product_detail" in results:
        detail = results["product_detail"]
        parts["extremes"] = cut_lineage(insights.product_extremes(detail))
        parts["means"] = cut_lineage(insights.product_means(detail))
        if "lucro" in roles and "faturamento" in roles:
            parts["candidates"] = cut_lineage(rankings.growth_candidates(detail.select("entity", "label", "faturamento", "lucro")))
        values = F.array(*[F.struct(F.lit(m).alias("concept"), F.col(m).alias("value")) for m in ("quantidade", "faturamento") if m in roles])
        if {"quantidade", "faturamento"} & set(roles):
            parts["product_top"] = cut_lineage(rankings.top_entities(detail.select("entity", "label", F.inline(values)), 1).select(
                "concept", "position", F.col("entity").cast("string").alias("product_id"), rankings.display_entity(F.col("entity"), F.col("label")).alias("product"), "value"))
    if "customer_ranking" in results:
        leaders = results["customer_ranking"].where("position = 1")
        parts["leader"] = leaders if "customer" in leaders.columns else parts["leader"]
    opportunity_rows = cut_lineage(insights.opportunities(
        parts["growth"], parts["runs"], parts["performance"], parts["candidates"], parts["extremes"], parts["means"], parts["concentration"]))
    insight_rows = cut_lineage(insights.insights(
        main or "faturamento", parts["series_extremes"], parts["growth"], parts["performance"], parts["product_top"], parts["extremes"], parts["means"],
        parts["candidates"], parts["concentration"], parts["leader"], parts["dimension_top"], (main or "faturamento").replace("_", " ").capitalize()))
    results["opportunities"] = insights.by_priority(opportunity_rows)
    results["insights"] = insights.by_priority(insight_rows)
    results["organised_lists"] = cut_lineage(insights.organise(opportunity_rows, insight_rows))
    results["status"] = cut_lineage(insights.status(parts["growth"], parts["performance"], opportunity_rows))
    summary = {"kpis": results["kpis"], "sufficiency": results["sufficiency"], "status": results["status"], "lists": results["organised_lists"]}
    if "customer_evidence" in results:
        summary["customers"] = results["customer_evidence"]
        results["customer_summary"] = insights.executive_summary(evidence=results["customer_evidence"], messages=results["customer_messages"])
    if "product_means" in results:
        summary["products"] = results["product_means"]
    results["executive_summary"] = insights.executive_summary(**summary)
