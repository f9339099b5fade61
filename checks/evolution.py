"""Entity evolution, findings and their selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.session import cut_lineage
from ledgerlens.operators import evolution, findings, rankings, selection, temporal

from .common import ROLES, SALES, check, once, rounded, sales
from .rankings import STATS
from .temporal import changes_sql, comparison_sql

M = {m: ROLES[m] for m in ("faturamento", "lucro")}
NAMES = list(M)


@once
def sold(spark, d):
    """The sales that all findings read, joined and written once. Profit and margin are not written but taken from the two amounts that are."""
    kept = cut_lineage(sales(spark, d, parts_first=True).select("Data", "Cliente_ID", "Cliente", "Faturamento", "Custo"))
    net, cost = F.col("Faturamento"), F.col("Custo")
    return kept.withColumns({"Lucro": net - cost, "Margem_Bruta": net - 2 * cost})


def months(spark, d, kind="cliente", with_id=True, rows=None):
    """``rows``: the sales, if they are written already; here and below."""
    ident, label = (f"{kind.capitalize()}_ID", kind.capitalize()) if with_id else (None, "Categoria")
    em = evolution.entity_months(sales(spark, d) if rows is None else rows, "Data", M, ident, label)
    return cut_lineage(evolution.with_identity(em, with_id, True))


def windows(spark, d, em):
    s = evolution.series_of(em, NAMES)
    share = evolution.undated_share(em).scalar()
    return evolution.comparison_windows(evolution.period_coverage(em, NAMES), s, share)


def changes(spark, d, kind="cliente", with_id=True, rows=None):
    em = months(spark, d, kind, with_id, rows)
    return evolution.entity_changes(evolution.matched_pairs(em, NAMES), windows(spark, d, em))


def em_sql(entity="cliente_id", label="cliente") -> str:
    part = lambda m: (f"SELECT '{m}' AS metric, {entity} AS entity, ord, min({label}) AS label, count(*) AS records, sum({m}) AS s, "
                      f"count({m}) AS n FROM sales GROUP BY 2, 3")
    return f"em AS ({part('faturamento')} UNION ALL {part('lucro')})"


PAIR = comparison_sql("a.s", "b.s", "r.ref", True, "a.ord", "b.ord", True)
EVOLUTION = """
cov AS (SELECT metric, ord, sum(records) AS records, sum(n) AS valid, sum(CASE WHEN entity IS NOT NULL THEN n ELSE 0 END) AS identified_valid,
  count(entity) AS population, sum(s) AS total, count(*) FILTER (WHERE s < 0) AS negative_groups FROM em GROUP BY 1, 2),
win AS (SELECT c.metric, c.ord - 1 AS ord_before, c.previous_period, c.current_period, c.series_magnitude, c.reference_magnitude AS global_magnitude,
  c.previous_value AS global_before, c.current_value AS global_after, c.absolute_change AS global_change,
  x.population AS population_before, y.population AS population_after, x.negative_groups AS ng_before, y.negative_groups AS ng_after,
  (x.identified_valid / x.records >= 0.95 AND y.identified_valid / y.records >= 0.95) AS complete_fields
  FROM changes c JOIN cov x ON x.metric = c.metric AND x.ord = c.ord - 1 JOIN cov y ON y.metric = c.metric AND y.ord = c.ord
  WHERE c.comparable AND c.continuous),
refs AS (SELECT metric, entity, coalesce(median(abs(s)) FILTER (WHERE s <> 0), 0) AS ref FROM em GROUP BY 1, 2),
ch AS (SELECT a.metric, a.entity, {label} AS label, w.previous_period, w.current_period, a.ord AS ord_before, a.s AS previous_value, b.s AS current_value,
  a.records AS records_before, b.records AS records_after, a.n AS valid_before, b.n AS valid_after,
  {delta} AS absolute_change, {pct} AS percentage_change, {reason} AS reason,
  CASE WHEN global_before > 0 AND ng_before = 0 THEN a.s / global_before * 100 END AS previous_share,
  CASE WHEN global_after > 0 AND ng_after = 0 THEN b.s / global_after * 100 END AS current_share,
  series_magnitude, global_magnitude, global_change, complete_fields
  FROM em a JOIN em b ON a.metric = b.metric AND a.entity = b.entity AND b.ord = a.ord + 1
  JOIN refs r ON r.metric = a.metric AND r.entity = a.entity JOIN win w ON w.metric = a.metric AND w.ord_before = a.ord
  WHERE {ok})""".replace("{delta}", PAIR["absolute_change"]).replace("{pct}", PAIR["percentage_change"]).replace(
    "{reason}", PAIR["reason"]).replace("{ok}", PAIR["comparable"])
MOVES = """
moves AS (SELECT metric, ord_before, sum(greatest(absolute_change, 0)) AS gross_growth, -sum(least(absolute_change, 0)) AS gross_decline,
  count(*) AS matched, any_value(global_change) - sum(absolute_change) AS unexplained, any_value(previous_period) AS previous_period,
  any_value(current_period) AS current_period FROM ch GROUP BY 1, 2)"""


def base_sql(entity="cliente_id", label="cliente", shown=None) -> str:
    shown = shown or "(SELECT min(label) FROM em q WHERE q.entity = a.entity)"
    return (changes_sql("faturamento", "lucro") + ", " + em_sql(entity, label) + ","
            + EVOLUTION.replace("{label}", "a.label" if shown == "text" else "coalesce(a.label, CAST(a.entity AS VARCHAR))"))


@check("entity_months", f"""WITH {SALES}, {em_sql()} SELECT entity, ord, label, records, round(max(s) FILTER (WHERE metric = 'faturamento'), 4) AS s_faturamento,
 round(max(s) FILTER (WHERE metric = 'lucro'), 4) AS s_lucro, max(n) AS n_faturamento FROM em GROUP BY 1, 2, 3, 4""")
def entity_months(spark, d):
    em = evolution.entity_months(sales(spark, d), "Data", M, "Cliente_ID", "Cliente")
    return rounded(em.select("entity", "ord", "label", "records", "s_faturamento", "s_lucro", "n_faturamento"))


@check("entity_identity", f"""WITH {SALES}
SELECT CAST(produto_id AS VARCHAR) AS value, min(produto) AS label, 'stable_id' AS identity_source FROM sales GROUP BY 1
UNION ALL SELECT categoria, categoria, CASE WHEN categoria = 'STANDARD' THEN 'confirmed_alias' ELSE 'text' END FROM sales GROUP BY 1""")
def identity(spark, d):
    s = sales(spark, d)
    by_id = evolution.with_identity(evolution.entity_months(s, "Data", M, "Produto_ID", "Produto"), True, True)
    merged = s.where("Categoria = 'STANDARD'").select(F.col("Categoria").alias("canonical_value"))
    by_text = evolution.with_identity(evolution.entity_months(s, "Data", M, None, "Categoria"), False, True, merged)
    pick = lambda df: df.select(F.col("entity").cast("string").alias("value"), "label", "identity_source").distinct()
    return pick(by_id).unionByName(pick(by_text))


@check("entity_period_coverage", f"""WITH {base_sql()}
SELECT metric, ord, CAST(records AS BIGINT) AS records, CAST(valid AS BIGINT) AS valid, CAST(identified_valid AS BIGINT) AS identified_valid, population,
       round(total, 4) AS "sum", negative_groups FROM cov""")
def period_coverage(spark, d):
    return rounded(evolution.period_coverage(months(spark, d), NAMES))


@check("entity_reference_magnitude", f"""WITH {base_sql()} SELECT metric, entity, round(ref, 6) AS magnitude FROM refs""")
def entity_magnitude(spark, d):
    em = months(spark, d)
    long = em.select("entity", F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(f"s_{m}").alias("value")) for m in NAMES])))
    return rounded(temporal.series_magnitude(long, ["metric", "entity"]), 6)


@check("comparison_windows", f"""WITH {base_sql()}
SELECT metric, previous_period, current_period, round(global_change, 4) AS global_change, population_before, population_after, complete_fields FROM win""")
def comparison_windows(spark, d):
    return rounded(windows(spark, d, months(spark, d)).select(
        "metric", "previous_period", "current_period", "global_change", "population_before", "population_after", "complete_fields"), 4)


CH = """SELECT metric, CAST(entity AS VARCHAR) AS entity, label, previous_period, current_period, round(absolute_change, 4) AS absolute_change,
 percentage_change, reason, round(previous_share, 6) AS previous_share, round(current_share, 6) AS current_share, records_before, valid_after FROM ch"""


def _ch(df):
    out = df.select("metric", F.col("entity").cast("string").alias("entity"), "label", "previous_period", "current_period",
                    F.round("absolute_change", 4).alias("absolute_change"), "percentage_change", "reason", "previous_share",
                    "current_share", "records_before", "valid_after")
    return rounded(out, 6)


@check("customer_changes", f"WITH {base_sql()} {CH}")
def customer_changes(spark, d):
    return _ch(changes(spark, d))


@check("category_changes_by_text", f"WITH {base_sql('categoria', 'categoria')} {CH}")
def category_changes(spark, d):
    return _ch(changes(spark, d, with_id=False))


@check("window_movements", f"""WITH {base_sql()}, {MOVES}
SELECT metric, previous_period, current_period, matched, round(gross_growth, 4) AS gross_growth, round(gross_decline, 4) AS gross_decline,
       round(unexplained, 4) AS unexplained FROM moves""")
def movements(spark, d):
    return rounded(evolution.window_movements(changes(spark, d)).select(
        "metric", "previous_period", "current_period", "matched", "gross_growth", "gross_decline", "unexplained"), 4)


@check("window_absences", f"""WITH {base_sql()}, m AS (SELECT a.metric, a.ord AS ord_before, count(*) AS matched,
  count(*) FILTER (WHERE a.s IS NULL OR b.s IS NULL) AS missing FROM em a JOIN em b ON a.metric = b.metric AND a.entity = b.entity AND b.ord = a.ord + 1 GROUP BY 1, 2)
SELECT w.metric, previous_period, current_period, population_after - coalesce(matched, 0) AS newly_observed, population_before - coalesce(matched, 0) AS not_observed_current,
  coalesce(missing, 0) AS missing_metric FROM win w LEFT JOIN m ON w.metric = m.metric AND w.ord_before = m.ord_before""")
def absences(spark, d):
    em = months(spark, d)
    return evolution.window_absences(evolution.matched_pairs(em, NAMES), windows(spark, d, em)).drop("ord_before")


def sql_id(rule: str, metric: str, scope: str, entity: str | None = None, dated: bool = False) -> str:
    ident = "null" if entity is None else "\"' || " + entity + " || '\""
    period = "null" if not dated else ("{\"end\": \"' || current_period || '\", \"granularity\": \"M\", \"start\": \"' || previous_period || '\"}")
    return (f"'finding-' || substr(sha256('[null, \"' || {rule} || '\", \"' || {metric} || '\", \"{scope}\", {ident}, {period}, null]'), 1, 24)")


def prio(i: str, c: str) -> str:
    return (f"CASE WHEN {i} = 'high' THEN CASE WHEN {c} = 'high' THEN 'high' ELSE 'medium' END "
            f"WHEN {i} = 'medium' THEN CASE WHEN {c} = 'low' THEN 'low' ELSE 'medium' END ELSE 'low' END")


SHOW = ["id", "rule", "metric", "scope", "impact", "confidence", "priority"]
STAT_RULES = f"""
conc AS (SELECT {sql_id("'customer_concentration'", 'concept', 'customers')} AS id, 'customer_concentration' AS rule, concept AS metric, 'customers' AS scope,
  CASE WHEN populacao >= 10 AND top5_valor / total_metrica >= 0.8 THEN 'high' WHEN populacao >= 10 AND top5_valor / total_metrica >= 0.5 THEN 'medium' ELSE 'low' END AS impact,
  CASE WHEN populacao < 10 OR registros_validos / registros < 0.95 THEN 'low' ELSE 'high' END AS confidence, top5_valor / total_metrica AS materiality
  FROM stats WHERE concept = 'faturamento' AND total_metrica > 0 AND registros_negativos = 0),
perf AS (SELECT 'lucro' AS concept, count(*) AS registros, count(lucro) AS registros_validos, count(lucro) AS populacao, count(*) FILTER (WHERE lucro < 0) AS negativos,
  sum(lucro) FILTER (WHERE lucro < 0) AS soma_negativos, sum(abs(lucro)) AS soma_absoluta FROM sales),
negs AS (SELECT concept, 'customers' AS scope, registros, registros_validos, populacao, negativos, soma_negativos, soma_absoluta FROM stats WHERE concept IN ('lucro', 'margem_bruta')
  UNION ALL SELECT concept, 'records', registros, registros_validos, populacao, negativos, soma_negativos, soma_absoluta FROM perf),
neg AS (SELECT 'finding-' || substr(sha256('[null, "negative_results", "' || concept || '", "' || scope || '", null, null, null]'), 1, 24) AS id,
  'negative_results' AS rule, concept AS metric, scope,
  CASE WHEN populacao >= 10 AND negativos >= 5 AND negativos / populacao >= 0.2 AND abs(soma_negativos) / soma_absoluta >= 0.2 THEN 'high'
       WHEN populacao >= 10 AND negativos >= 2 AND abs(soma_negativos) / soma_absoluta >= 0.05 THEN 'medium' ELSE 'low' END AS impact,
  CASE WHEN populacao < 10 OR registros_validos / registros < 0.95 THEN 'low' ELSE 'high' END AS confidence, abs(soma_negativos) / soma_absoluta AS materiality
  FROM negs WHERE negativos > 0 AND soma_negativos < 0)"""


def show(df):
    return rounded(df.select(*SHOW, F.round("materiality", 6).alias("materiality")), 6)


def stats(spark, d, rows=None):
    names = ["faturamento", "margem_bruta", "lucro"]
    t = rankings.entity_totals(sales(spark, d) if rows is None else rows, "Cliente_ID", "Cliente", {m: ROLES[m] for m in names})
    return rankings.evidence_stats(cut_lineage(t), names)


def record_stats(spark, d, rows=None):
    p = temporal.profit_performance(sales(spark, d) if rows is None else rows, "Lucro")
    return p.select(F.lit("lucro").alias("concept"), "registros", "registros_validos", F.col("registros_validos").alias("populacao"),
                    F.col("registros_prejuizo").alias("negativos"), "soma_negativos", "soma_absoluta")


@check("concentration_finding", f"WITH {STATS}, {STAT_RULES} SELECT id, rule, metric, scope, impact, confidence, {prio('impact', 'confidence')} AS priority, round(materiality, 6) AS materiality FROM conc")
def concentration(spark, d):
    return show(findings.concentration_finding(stats(spark, d), "faturamento", True))


@check("negative_findings", f"WITH {STATS}, {STAT_RULES} SELECT id, rule, metric, scope, impact, confidence, {prio('impact', 'confidence')} AS priority, round(materiality, 6) AS materiality FROM neg")
def negative(spark, d):
    return show(findings.negative_findings(stats(spark, d), "customers").unionByName(findings.negative_findings(record_stats(spark, d), "records")))


@check("finding_confidence", f"""WITH {STATS}
SELECT concept AS metric, CASE WHEN populacao < 10 OR registros_validos / registros < 0.95 THEN 'low' ELSE 'medium' END AS confidence,
 'Métrica identificada como ' || CASE concept WHEN 'lucro' THEN 'Lucro' ELSE 'Margem Bruta' END || '; descreve valores informados.' || ' | ' ||
 'Ao menos 95% dos registros têm os campos necessários preenchidos.' || ' | ' || 'Identidade baseada em nomes; variantes podem representar a mesma entidade.' AS reasons
FROM stats WHERE concept IN ('lucro', 'margem_bruta') AND negativos > 0""")
def confidence(spark, d):
    f = findings.negative_findings(stats(spark, d), "customers", with_id=False)
    return f.select("metric", "confidence", F.array_join("confidence_reasons", " | ").alias("reasons"))


TEMP = """
tmp0 AS (SELECT *, count(*) OVER (PARTITION BY metric) + 1 AS periods, greatest(series_magnitude, coalesce(reference_magnitude, 0)) AS scale FROM changes),
tmp1 AS (SELECT *, CASE WHEN direction = 'increase' THEN 'temporal_growth' ELSE 'temporal_decline' END AS rule, abs(absolute_change) / scale AS materiality,
  previous_records >= 5 AND current_records >= 5 AND periods >= 3 AS solid FROM tmp0
  WHERE comparable AND continuous AND absolute_change <> 0 AND scale > 0 AND abs(absolute_change) / scale >= 0.2),
temp AS (SELECT """ + sql_id("rule", "metric", "temporal", None, True) + """ AS id, rule, metric, 'temporal' AS scope,
  CASE WHEN solid AND abs(percentage_change) >= 20 AND materiality >= 0.5 THEN 'high' ELSE 'medium' END AS impact,
  CASE WHEN solid THEN 'medium' ELSE 'low' END AS confidence, materiality, previous_period, current_period, absolute_change FROM tmp1)"""


def found_temporal(spark, d, rows=None):
    s = sales(spark, d) if rows is None else rows
    return findings.temporal_findings(temporal.compare_series(temporal.monthly_series(s, "Data", M)), temporal.coverage(s, "Data", M))


@check("temporal_findings", f"WITH {changes_sql('faturamento', 'lucro')}, {TEMP} SELECT id, rule, metric, scope, impact, confidence, {prio('impact', 'confidence')} AS priority, round(materiality, 6) AS materiality FROM temp")
def temporal_found(spark, d):
    return show(found_temporal(spark, d))


def entity_sql(prefix: str, scope: str) -> str:
    return """
ef0 AS (SELECT *, greatest(series_magnitude, coalesce(global_magnitude, 0)) AS scale, absolute_change * global_change > 0 AS same FROM ch),
ef1 AS (SELECT *, abs(absolute_change) / scale AS materiality, CASE WHEN same THEN absolute_change / global_change * 100 END AS contribution,
  complete_fields AND valid_before >= 5 AND valid_before = records_before AND valid_after >= 5 AND valid_after = records_after AS solid
  FROM ef0 WHERE scale > 0 AND abs(absolute_change) / scale >= 0.02),
ef2 AS (SELECT *, same AND complete_fields AND abs(global_change) / scale >= 0.1 AND contribution >= 10 AS contributor FROM ef1),
ef3 AS (SELECT *, '""" + prefix + """' || CASE WHEN contributor THEN '_contributor_' ELSE '_' END || CASE WHEN absolute_change > 0 THEN 'growth' ELSE 'decline' END AS rule,
  CASE WHEN solid AND (materiality >= 0.2 OR (contributor AND contribution >= 30)) THEN 'high' ELSE 'medium' END AS impact,
  CASE WHEN solid THEN 'medium' ELSE 'low' END AS confidence FROM ef2),
ef4 AS (SELECT *, """ + sql_id("rule", "metric", scope, "CAST(entity AS VARCHAR)", True) + " AS id, " + prio("impact", "confidence") + """ AS priority FROM ef3),
ef5 AS (SELECT *, CASE priority WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END AS p, CASE impact WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END AS i FROM ef4),
ef6 AS (SELECT * FROM ef5 QUALIFY row_number() OVER (PARTITION BY metric, ord_before, rule ORDER BY p, i, abs(absolute_change) DESC, id) <= 5),
ef AS (SELECT id, rule, metric, '""" + scope + """' AS scope, impact, confidence, materiality, priority, entity, label, previous_period, current_period, absolute_change, contribution
  FROM ef6 QUALIFY row_number() OVER (ORDER BY p, i, abs(absolute_change) DESC, id) <= 100)"""


def found_entities(spark, d, kind="cliente", with_id=True, rows=None):
    c = cut_lineage(changes(spark, d, kind, with_id, rows))  # read for the movements of a window and for the findings
    return findings.entity_findings(c, evolution.window_movements(c), kind)


ESHOW = """SELECT id, rule, metric, scope, impact, confidence, priority, round(materiality, 6) AS materiality, CAST(entity AS VARCHAR) AS value,
  previous_period, current_period, round(absolute_change, 4) AS absolute_change, round(contribution, 4) AS contribution FROM ef"""


def eshow(df):
    out = df.select(*SHOW, F.round("materiality", 6).alias("materiality"), F.col("entity.value").alias("value"),
                    F.col("period.start").alias("previous_period"), F.col("period.end").alias("current_period"),
                    F.round("absolute_change", 4).alias("absolute_change"),
                    F.round(F.filter("evidence", lambda e: e["name"] == "contribuicao")[0]["value"], 4).alias("contribution"))
    return rounded(out, 6)


@check("customer_findings", f"WITH {base_sql()}, {entity_sql('customer', 'customers')} {ESHOW}")
def customer_findings(spark, d):
    return eshow(found_entities(spark, d))


@check("product_findings", f"WITH {base_sql('produto', 'produto')}, {entity_sql('product', 'products')} {ESHOW}")
def product_findings(spark, d):
    em = cut_lineage(evolution.with_identity(evolution.entity_months(sales(spark, d), "Data", M, None, "Produto"), False, True))
    c = evolution.entity_changes(evolution.matched_pairs(em, NAMES), windows(spark, d, em))
    return eshow(findings.entity_findings(c, evolution.window_movements(c), "produto"))


@check("text_entity_findings", f"WITH {base_sql('categoria', 'categoria')}, {entity_sql('customer', 'customers')} {ESHOW}")
def text_findings(spark, d):
    return eshow(found_entities(spark, d, with_id=False))


ALL_SQL = f"""{base_sql()}, {entity_sql('customer', 'customers')}, {TEMP}, {STATS.replace(SALES + ',', '')}, {STAT_RULES},
pool AS (SELECT id, rule, metric, scope, impact, confidence, materiality, CAST(NULL AS VARCHAR) AS value, CAST(NULL AS VARCHAR) AS p1, CAST(NULL AS VARCHAR) AS p2 FROM conc
  UNION ALL SELECT id, rule, metric, scope, impact, confidence, materiality, NULL, NULL, NULL FROM neg
  UNION ALL SELECT id, rule, metric, scope, impact, confidence, materiality, NULL, previous_period, current_period FROM temp
  UNION ALL SELECT id, rule, metric, scope, impact, confidence, materiality, CAST(entity AS VARCHAR), previous_period, current_period FROM ef),
f0 AS (SELECT *, {prio('impact', 'confidence')} AS priority FROM pool),
f1 AS (SELECT *, CASE priority WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END AS p, CASE impact WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END AS i,
  CASE confidence WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END AS c,
  CASE WHEN rule = 'customer_concentration' THEN 'concentracao' WHEN rule = 'negative_results' THEN 'resultados_negativos' WHEN rule LIKE 'temporal%' THEN 'temporal'
       WHEN scope = 'customers' THEN 'clientes' WHEN scope = 'products' THEN 'produtos' ELSE 'outros' END AS family FROM f0)"""


@once
def pool(spark, d):
    rows = sold(spark, d)
    customers = stats(spark, d, rows)
    return cut_lineage(findings.all_findings(
        findings.concentration_finding(customers, "faturamento", True),
        findings.negative_findings(customers, "customers"), findings.negative_findings(record_stats(spark, d, rows), "records"),
        found_temporal(spark, d, rows), found_entities(spark, d, rows=rows)))


@check("all_findings", f"WITH {ALL_SQL} SELECT id, rule, metric, scope, impact, confidence, priority, round(materiality, 6) AS materiality FROM f1")
def all_found(spark, d):
    return show(findings.ordered_findings(pool(spark, d)))


@check("selected_findings", f"""WITH {ALL_SQL},
e AS (SELECT * FROM f1 QUALIFY row_number() OVER (PARTITION BY replace(rule, '_contributor_', '_'), metric, scope, value, p1, p2
      ORDER BY contains(rule, '_contributor_') DESC, p, i, c, materiality DESC, id) = 1),
k AS (SELECT * FROM e WHERE impact <> 'low' OR NOT EXISTS (SELECT 1 FROM e WHERE impact <> 'low')),
t AS (SELECT *, row_number() OVER (PARTITION BY p, i, c, family ORDER BY materiality DESC, id) AS turn FROM k),
l AS (SELECT *, row_number() OVER (PARTITION BY confidence = 'low' ORDER BY p, i, c, turn, materiality DESC, id) AS lo,
      count(*) FILTER (WHERE confidence <> 'low') OVER () AS strong FROM t)
SELECT id, family, row_number() OVER (ORDER BY p, i, c, turn, materiality DESC, id) AS position, priority, impact, confidence FROM l
WHERE confidence <> 'low' OR lo <= CASE WHEN strong > 0 THEN least(2, strong) ELSE 8 END QUALIFY position <= 8""")
def selected(spark, d):
    return rounded(selection.select_findings(pool(spark, d)).select("id", "family", "position", "priority", "impact", "confidence"))


@check("findings_page", f"""WITH {ALL_SQL} SELECT id, family, priority, impact, confidence FROM f1 WHERE family = 'temporal'
ORDER BY p, i, c, id LIMIT 10 OFFSET 10""")
def page(spark, d):
    return selection.filter_findings(pool(spark, d), page=2, family="temporal").select("id", "family", "priority", "impact", "confidence")
