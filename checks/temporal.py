"""Derived metrics, indicators, monthly series, growth."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.functions.comparison import with_comparison
from ledgerlens.operators import metrics, temporal, time_quality

from .common import ROLES, SALES, check, rounded, sales, table

SERIES_METRICS = {"faturamento": "Faturamento", "lucro": "Lucro"}


def series(spark, d, names=("faturamento", "lucro")):
    return temporal.monthly_series(sales(spark, d), "Data", {m: ROLES[m] for m in names})


def series_sql(*names: str) -> str:
    parts = [
        f"SELECT '{m}' AS metric, ord, period, sum({m}) AS value, count({m}) AS records FROM sales GROUP BY ord, period"
        for m in names
    ]
    return SALES + ", series AS (" + " UNION ALL ".join(parts) + ")"


def comparison_sql(prev: str, cur: str, ref: str, dated: bool = False, po: str = "", co: str = "",
                   consecutive: bool = False) -> dict[str, str]:
    """SQL expressions of the guarded comparison."""
    usable = f"({prev} IS NOT NULL AND {cur} IS NOT NULL)"
    later = f"coalesce({co} > {po}, false)" if dated else "true"
    nxt = f"({co} = {po} + 1)" if dated else "true"
    ok = f"({usable} AND {later}" + (f" AND {nxt})" if consecutive else ")")
    own = (f"(CASE WHEN {prev} <> 0 AND {cur} <> 0 THEN (abs({prev}) + abs({cur})) / 2 "
           f"WHEN {prev} <> 0 THEN abs({prev}) WHEN {cur} <> 0 THEN abs({cur}) ELSE 0 END)")
    mag = f"(CASE WHEN {ok} THEN greatest({own}, {ref}) END)"
    reason = (f"(CASE WHEN NOT {usable} THEN 'invalid_value' WHEN NOT {later} THEN 'invalid_period' "
              + (f"WHEN NOT {nxt} THEN 'non_consecutive_periods' " if consecutive else "")
              + f"WHEN {prev} = 0 THEN 'zero_reference' WHEN {prev} < 0 THEN 'negative_reference' "
              f"WHEN {cur} < 0 THEN 'sign_change' WHEN {prev} < {mag} * 0.05 THEN 'low_reference_base' END)")
    return {
        "absolute_change": f"({cur} - {prev})",
        "direction": f"(CASE WHEN {cur} - {prev} > 0 THEN 'increase' WHEN {cur} - {prev} < 0 THEN 'decrease' "
                     f"WHEN {usable} THEN 'stable' END)",
        "comparable": ok,
        "continuous": f"(CASE WHEN {usable} AND {later} THEN {nxt} END)" if dated else "CAST(NULL AS BOOLEAN)",
        "reference_magnitude": mag,
        "reason": reason,
        "percentage_change": f"(CASE WHEN {ok} AND {reason} IS NULL THEN round(({cur} - {prev}) / {prev} * 100, 2) END)",
    }


STEP = comparison_sql("pv", "value", "mag", True, "po", "ord", True)
MAGNITUDE = """
mags AS (SELECT metric, coalesce(median(abs(value)) FILTER (WHERE value <> 0), 0) AS mag FROM series GROUP BY metric)"""
CHANGES = f"""{MAGNITUDE},
steps AS (
  SELECT s.metric, s.ord, s.period, s.value, s.records, m.mag,
         lag(value) OVER w AS pv, lag(s.ord) OVER w AS po, lag(period) OVER w AS pp, lag(records) OVER w AS pr,
         row_number() OVER w AS pos
  FROM series s JOIN mags m ON s.metric = m.metric
  WINDOW w AS (PARTITION BY s.metric ORDER BY s.ord)),
changes AS (
  SELECT metric, ord, pp AS previous_period, period AS current_period, pv AS previous_value, value AS current_value,
         pr AS previous_records, records AS current_records, mag AS series_magnitude,
         {', '.join(f'{v} AS {k}' for k, v in STEP.items())}
  FROM steps WHERE pos > 1)"""


def changes_sql(*names: str) -> str:
    return series_sql(*names) + "," + CHANGES


@check("derived_metrics", """
SELECT l_returnflag AS flag, round(sum(l_quantity * p_retailprice), 4) AS faturamento,
       round(sum(l_quantity * p_size), 4) AS custo,
       round(sum(l_quantity * p_retailprice - l_quantity * p_size), 4) AS lucro,
       round(avg(CASE WHEN l_quantity * p_retailprice = 0 THEN 0
                 ELSE (l_quantity * p_retailprice - l_quantity * p_size) / (l_quantity * p_retailprice) * 100 END), 6) AS margem
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_returnflag""")
def derived(spark, d):
    base = table(spark, d, "lineitem").join(table(spark, d, "part"), F.expr("l_partkey = p_partkey")).select(
        F.col("l_returnflag").alias("flag"), F.col("l_quantity").alias("q"),
        F.col("p_retailprice").alias("price"), F.col("p_size").cast("double").alias("cost"))
    done = metrics.derive_metrics(base, {"quantidade": "q", "preco_unitario": "price", "custo_unitario": "cost"})
    out = done.frame.groupBy("flag").agg(
        F.sum(metrics.DERIVED_REVENUE).alias("faturamento"), F.sum(metrics.DERIVED_COST).alias("custo"),
        F.sum(metrics.DERIVED_PROFIT).alias("lucro"), F.avg(metrics.DERIVED_MARGIN).alias("margem"))
    return out.select("flag", *[F.round(c, 4).alias(c) for c in ("faturamento", "custo", "lucro")],
                      F.round("margem", 6).alias("margem"))


KPI_SQL = f"""
WITH {SALES}, k AS (
  SELECT sum(faturamento) AS f, sum(valor_total) AS vt, sum(valor_com_desconto) AS vd, sum(margem_bruta) AS mb,
         count(*) AS n, sum(custo) AS c, sum(lucro) AS l, sum(quantidade) AS q, count(DISTINCT pedido) AS o FROM sales)
SELECT round(f, 2) AS faturamento_total, round(vt, 2) AS valor_total, round(vd, 2) AS valor_com_desconto,
       round(mb, 2) AS margem_bruta, CAST(n AS DOUBLE) AS quantidade_registros, round(c, 2) AS custo_total,
       round(l, 2) AS lucro_total, round(q, 2) AS quantidade_vendida, CAST(o AS DOUBLE) AS quantidade_pedidos,
       round(f / o, 4) AS ticket_medio, round(l / f * 100, 6) AS margem_lucro FROM k"""


@check("kpis", KPI_SQL)
def kpi_row(spark, d):
    k = metrics.kpis(sales(spark, d), ROLES).drop("margem_bruta_percentual")
    digits = {"ticket_medio": 4, "margem_lucro": 6}
    return k.select(*[F.round(c, digits.get(c, 2)).alias(c) for c in k.columns])


@check("kpis_by_name", f"""
WITH {SALES}, k AS (SELECT round(sum(faturamento), 2) AS faturamento_total, round(sum(custo), 2) AS custo_total,
  round(sum(lucro), 2) AS lucro_total, CAST(count(*) AS DOUBLE) AS quantidade_registros,
  round(sum(lucro) / sum(faturamento) * 100, 2) AS margem_lucro FROM sales)
UNPIVOT k ON faturamento_total, custo_total, lucro_total, quantidade_registros, margem_lucro INTO NAME indicador VALUE valor""")
def kpi_rows(spark, d):
    roles = {r: ROLES[r] for r in ("faturamento", "custo", "lucro")}
    return rounded(metrics.kpis_long(metrics.kpis(sales(spark, d), roles)), 2)


@check("weighted_margin", """
SELECT round(sum(l_discount * 100 * l_extendedprice) / sum(l_extendedprice), 6) AS margem_bruta_percentual FROM lineitem
WHERE l_extendedprice <> 0""")
def weighted(spark, d):
    df = table(spark, d, "lineitem").select((F.col("l_discount") * 100).alias("p"), F.col("l_extendedprice").alias("v"))
    return rounded(metrics.kpis(df, {"margem_bruta_percentual": "p", "valor_total": "v"}).select("margem_bruta_percentual"), 6)


@check("formula_margin", """
WITH r AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS row_no, * FROM lineitem)
SELECT round(sum(l_extendedprice * l_discount) / sum(l_extendedprice) * 100, 6) AS margem_bruta_percentual,
       count(*) AS linhas_base, 'ponderada_por_soma_da_margem_e_base_referenciada_em_formula' AS metodo
FROM lineitem WHERE l_returnflag = 'R' AND l_extendedprice <> 0""")
def formula_rate(spark, d):
    rows = table(spark, d, "lineitem").select(
        F.lit("s").alias("sheet"), F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
                                              "l_shipdate", "l_quantity").alias("row_no"),
        (F.col("l_extendedprice") * F.col("l_discount")).alias("margin"), F.col("l_extendedprice").alias("gross"),
        "l_returnflag")
    formulas = rows.where("l_returnflag = 'R'").select(
        "sheet", "row_no", F.lit(4).alias("col_no"), F.concat(F.lit("=B"), F.lit("7/$C$7")).alias("formula"))
    concepts = spark.createDataFrame(
        [(2, "margem_bruta"), (3, "valor_total"), (4, "margem_bruta_percentual")], "position int, concept string")
    return rounded(metrics.formula_margin(rows, formulas, concepts, {"margem_bruta": "margin", "valor_total": "gross"}), 6)


@check("monthly_series", f"WITH {series_sql('faturamento', 'lucro')} SELECT metric, period, round(value, 4) AS value, records FROM series")
def monthly(spark, d):
    return rounded(series(spark, d).drop("ord"))


@check("monthly_change", f"""WITH {changes_sql('faturamento')}
SELECT previous_period, current_period, round(previous_value, 4) AS previous_value, round(current_value, 4) AS current_value,
       round(absolute_change, 4) AS absolute_change, direction, comparable, continuous, reason, percentage_change,
       round(reference_magnitude, 6) AS reference_magnitude FROM changes""")
def monthly_change(spark, d):
    c = temporal.compare_series(series(spark, d, ("faturamento",)))
    amounts = [F.round(n, 4).alias(n) for n in ("previous_value", "current_value", "absolute_change")]
    return rounded(c.select(
        "previous_period", "current_period", *amounts, "direction", "comparable", "continuous", "reason", "percentage_change",
        "reference_magnitude"), 6)


@check("change_by_customer_segment_gap", f"""
WITH series AS (
  SELECT c_mktsegment || '/' || c_nationkey AS metric, year(o_orderdate) * 12 + month(o_orderdate) - 1 AS ord,
         strftime(o_orderdate, '%Y-%m') AS period, sum(o_totalprice) AS value, count(*) AS records
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3), {CHANGES}
SELECT metric, previous_period, current_period, round(absolute_change, 2) AS absolute_change, comparable, continuous, reason,
       percentage_change FROM changes""")
def segment_changes(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.expr("o_custkey = c_custkey"))
    s = o.groupBy(F.concat_ws("/", "c_mktsegment", "c_nationkey").alias("metric"),
                  temporal.month_ordinal(F.col("o_orderdate")).alias("ord")).agg(
        F.sum("o_totalprice").alias("value"), F.count(F.lit(1)).alias("records"))
    s = s.withColumn("period", temporal.month_label(F.col("ord")))
    return rounded(temporal.compare_series(s).select(
        "metric", "previous_period", "current_period", "absolute_change", "comparable", "continuous", "reason",
        "percentage_change"), 2)


@check("guarded_comparison", f"""
WITH p AS (SELECT l_orderkey, sum(CASE WHEN l_returnflag = 'R' THEN -l_quantity WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END) AS a,
                  sum(CASE WHEN l_linestatus = 'F' THEN -l_quantity ELSE l_tax END) AS b FROM lineitem GROUP BY 1)
SELECT l_orderkey, {', '.join((f"round({v}, 6) AS {k}" if k in ('absolute_change', 'reference_magnitude') else f"{v} AS {k}")
                              for k, v in comparison_sql("a", "b", "40").items())} FROM p""")
def compare_pairs(spark, d):
    p = table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.sum(F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).when(F.col("l_returnflag") == "A", F.col("l_quantity")).otherwise(0.0)).alias("a"),
        F.sum(F.when(F.col("l_linestatus") == "F", -F.col("l_quantity")).otherwise(F.col("l_tax"))).alias("b"))
    c = with_comparison(p, F.col("a"), F.col("b"), F.lit(40.0))
    return rounded(c.select("l_orderkey", "absolute_change", "direction", "comparable", "continuous", "reference_magnitude",
                            "reason", "percentage_change"), 6)


@check("series_magnitude", f"WITH {series_sql('faturamento', 'lucro')}, {MAGNITUDE} SELECT metric, round(mag, 6) AS magnitude FROM mags")
def magnitude(spark, d):
    return rounded(temporal.series_magnitude(series(spark, d), ["metric"]), 6)


@check("period_positions", """
SELECT period, CASE WHEN g = 'M' THEN CAST(substr(period, 1, 4) AS BIGINT) * 12 + CAST(substr(period, 6, 2) AS BIGINT) - 1
            WHEN g = 'Q' THEN CAST(substr(period, 1, 4) AS BIGINT) * 4 + CAST(substr(period, 6, 1) AS BIGINT) - 1
            ELSE CAST(period AS BIGINT) END AS position, n
FROM (SELECT 'M' AS g, strftime(o_orderdate, '%Y-%m') AS period, count(*) AS n FROM orders GROUP BY 1, 2
      UNION ALL SELECT 'Q', year(o_orderdate) || 'Q' || quarter(o_orderdate), count(*) FROM orders GROUP BY 1, 2
      UNION ALL SELECT 'Y', CAST(year(o_orderdate) AS VARCHAR), count(*) FROM orders GROUP BY 1, 2)""")
def positions(spark, d):
    ts = F.col("o_orderdate")
    forms = {"M": F.date_format(ts, "yyyy-MM"), "Q": F.concat(F.year(ts), F.lit("Q"), F.quarter(ts)), "Y": F.year(ts).cast("string")}
    out = None
    for g, c in forms.items():
        part = table(spark, d, "orders").groupBy(c.alias("period")).agg(F.count(F.lit(1)).alias("n")).select(
            "period", temporal.period_ordinal(F.col("period"), g).cast("bigint").alias("position"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@check("best_worst_month", f"""WITH {series_sql('faturamento', 'lucro')}
SELECT metric, arg_max(period, value) AS best_period, round(max(value), 4) AS best_value,
       arg_min(period, value) AS worst_period, round(min(value), 4) AS worst_value FROM series GROUP BY metric""")
def best_worst(spark, d):
    return rounded(temporal.extremes(series(spark, d)))


@check("sparse_periods", """
SELECT c_nationkey || c_mktsegment AS metric, strftime(o_orderdate, '%Y-%m') AS period, count(*) AS records,
       round(sum(o_totalprice), 2) AS value
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2 HAVING count(*) < 5""")
def sparse(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.expr("o_custkey = c_custkey"))
    s = o.groupBy(F.concat("c_nationkey", "c_mktsegment").alias("metric"),
                  F.date_format("o_orderdate", "yyyy-MM").alias("period")).agg(
        F.sum("o_totalprice").alias("value"), F.count("o_totalprice").alias("records"))
    return rounded(temporal.sparse_periods(s), 2)


@check("series_coverage", """
SELECT m AS metric, count(*) AS input_records, count(CASE WHEN m = 'kept' THEN CASE WHEN l_discount > 0.02 THEN 1 END ELSE 1 END) AS valid_records
FROM lineitem, (VALUES ('kept'), ('full')) t(m) GROUP BY m""")
def cover(spark, d):
    li = table(spark, d, "lineitem").select("l_shipdate", F.col("l_quantity").alias("full"),
                                           F.when(F.col("l_discount") > 0.02, F.col("l_quantity")).alias("kept"))
    return temporal.coverage(li, "l_shipdate", {"kept": "kept", "full": "full"})


END = comparison_sql("fv", "lv", "mag", True, "fo", "lo")
EVOLUTION = f"""{MAGNITUDE},
ends AS (SELECT metric, count(*) AS periods, min(period) AS first_period, max(period) AS last_period, min(ord) AS fo, max(ord) AS lo,
         arg_min(value, ord) AS fv, arg_max(value, ord) AS lv FROM series GROUP BY metric),
evo AS (SELECT e.metric, periods, first_period, last_period, fv AS first_value, lv AS last_value,
        CASE WHEN periods > 1 THEN {END['percentage_change']} END AS evolution,
        CASE WHEN periods > 1 THEN {END['absolute_change']} END AS absolute_change,
        CASE WHEN periods < 2 THEN 'dados_insuficientes' ELSE CASE {END['reason']} WHEN 'zero_reference' THEN 'base_zero'
          WHEN 'negative_reference' THEN 'base_negativa' WHEN 'sign_change' THEN 'mudanca_de_sinal'
          WHEN 'low_reference_base' THEN 'base_muito_baixa' WHEN 'invalid_value' THEN 'dados_insuficientes'
          WHEN 'invalid_period' THEN 'periodo_invalido' END END AS reason
        FROM ends e JOIN mags m ON e.metric = m.metric)"""
TREND = """CASE WHEN evolution IS NULL THEN 'dados_insuficientes' WHEN evolution > 5 THEN 'crescimento'
       WHEN evolution < -5 THEN 'queda' ELSE 'estavel' END"""


@check("total_evolution", f"""WITH {series_sql('faturamento', 'lucro', 'custo')}, {EVOLUTION}
SELECT metric, periods, first_period, last_period, round(first_value, 4) AS first_value, round(last_value, 4) AS last_value,
       evolution, round(absolute_change, 4) AS absolute_change, reason, {TREND} AS trend FROM evo""")
def evolution(spark, d):
    return rounded(temporal.total_evolution(series(spark, d, ("faturamento", "lucro", "custo"))))


RUNS = """
flagged AS (SELECT metric, ord, current_period, percentage_change, coalesce(percentage_change < 0, false) AS falling,
  sum(CASE WHEN coalesce(percentage_change < 0, false) THEN 0 ELSE 1 END) OVER (PARTITION BY metric ORDER BY ord) AS run FROM changes),
runs AS (SELECT metric, run, min(current_period) AS run_start, max(current_period) AS run_end, count(*) AS length,
  min(ord) AS start_ord, sum(percentage_change) AS sum_percent FROM flagged WHERE falling GROUP BY metric, run HAVING count(*) >= 2)"""


@check("decline_runs", f"""WITH {changes_sql('faturamento', 'lucro')}, {RUNS}
SELECT metric, run_start, run_end, length, start_ord, round(sum_percent, 4) AS sum_percent FROM runs""")
def declines(spark, d):
    return rounded(temporal.decline_runs(temporal.compare_series(series(spark, d))))


@check("growth_extremes", f"""WITH {changes_sql('faturamento', 'lucro')}
SELECT metric,
 max(percentage_change) FILTER (WHERE percentage_change > 0) AS growth_percent,
 min(percentage_change) FILTER (WHERE percentage_change < 0) AS drop_percent,
 (arg_max(current_period, percentage_change * 100000 - ord / 1000.0) FILTER (WHERE percentage_change > 0)) AS growth_period,
 (arg_min(current_period, percentage_change * 100000 + ord / 1000.0) FILTER (WHERE percentage_change < 0)) AS drop_period
FROM changes GROUP BY metric""")
def growth_ext(spark, d):
    return rounded(temporal.growth_extremes(temporal.compare_series(series(spark, d))))


@check("growth_summary", f"""WITH {changes_sql('faturamento', 'lucro')}, {RUNS}, {EVOLUTION.replace(MAGNITUDE + ',', '')},
longest AS (SELECT metric, length, run_start, run_end, count(*) OVER (PARTITION BY metric) AS n,
            row_number() OVER (PARTITION BY metric ORDER BY length DESC, start_ord) AS r FROM runs)
SELECT evo.metric, evolution, reason, {TREND} AS trend, coalesce(n, 0) AS decline_runs, length AS longest_decline,
       run_start AS longest_decline_start, run_end AS longest_decline_end
FROM evo LEFT JOIN longest ON evo.metric = longest.metric AND r = 1""")
def growth(spark, d):
    return rounded(temporal.growth_summary(series(spark, d)).select(
        "metric", "evolution", "reason", "trend", "decline_runs", "longest_decline", "longest_decline_start", "longest_decline_end"))


@check("profit_performance", f"""WITH {SALES}
SELECT round(sum(lucro), 2) AS lucro_total, count(*) FILTER (WHERE lucro < 0) AS registros_prejuizo,
 round(sum(lucro) FILTER (WHERE lucro < 0), 2) AS prejuizo_total, count(*) AS registros, count(lucro) AS registros_validos,
 round(sum(lucro) FILTER (WHERE lucro < 0), 2) AS soma_negativos, round(sum(abs(lucro)), 2) AS soma_absoluta FROM sales""")
def performance(spark, d):
    return rounded(temporal.profit_performance(sales(spark, d), "Lucro"), 2)


@check("loss_months", f"""WITH {SALES}, s AS (SELECT categoria, period, sum(lucro) AS value FROM sales GROUP BY 1, 2)
SELECT categoria || ' ' || period AS period, round(value, 4) AS value FROM s WHERE value < 0""")
def loss_months(spark, d):
    s = sales(spark, d).groupBy(
        F.concat_ws(" ", "Categoria", F.date_format("Data", "yyyy-MM")).alias("period")).agg(F.sum("Lucro").alias("value"))
    return rounded(temporal.loss_periods(s.withColumn("metric", F.lit("lucro"))))


@check("chart_series", f"""WITH {SALES}
SELECT period, round(sum(valor_total), 4) AS metric_value, round(sum(faturamento), 4) AS faturamento, round(sum(lucro), 4) AS lucro
FROM sales GROUP BY period""")
def chart(spark, d):
    return rounded(temporal.chart_series(series(spark, d, ("valor_total", "faturamento", "lucro")), "valor_total"))


@check("temporal_summary", f"""WITH {changes_sql('faturamento')}, {EVOLUTION.replace(MAGNITUDE + ',', '')},
best AS (SELECT metric, arg_max(period, value) AS best_period, max(value) AS best_value, arg_min(period, value) AS worst_period,
         min(value) AS worst_value FROM series GROUP BY metric)
SELECT evo.metric, first_period || ' a ' || last_period AS analysed_range, round(first_value, 4) AS first_value,
       round(last_value, 4) AS last_value, evolution, reason, {TREND} AS trend, best_period, round(best_value, 4) AS best_value,
       worst_period, round(worst_value, 4) AS worst_value FROM evo JOIN best ON evo.metric = best.metric""")
def summary(spark, d):
    return rounded(temporal.temporal_summary(series(spark, d, ("faturamento",)), "faturamento").drop(
        "absolute_change", "growth_period", "growth_percent", "drop_period", "drop_percent", "decline_runs"))


SPAN = """
years AS (SELECT year(ts) AS y, count(*) AS n FROM dated WHERE ts IS NOT NULL GROUP BY 1),
t AS (SELECT sum(n) AS total FROM years),
spans AS (SELECT a.y AS y1, b.y AS y2, b.y - a.y AS width, sum(m.n) AS inside, count(*) AS cnt
          FROM years a JOIN years b ON b.y >= a.y JOIN years m ON m.y BETWEEN a.y AND b.y GROUP BY a.y, b.y),
best AS (SELECT y1, y2, inside, total FROM spans, t WHERE cnt = width + 1 AND inside >= total * 0.95 ORDER BY width, inside, y1 LIMIT 1),
outside AS (SELECT coalesce(sum(n), 0) AS o, coalesce(max(n), 0) AS mx FROM years, best WHERE y < y1 OR y > y2),
span AS (SELECT y1, y2, inside, total, o, (total >= 50 AND o > 0 AND o <= 0.05 * total AND mx <= greatest(3, floor(total * 0.01)) AND y2 > y1) AS flagged
         FROM best, outside)"""
DATED = """dated AS (SELECT l_orderkey, l_extendedprice AS v, CASE WHEN l_orderkey % 997 = 0 AND l_linenumber = 1
           THEN l_shipdate + INTERVAL 40 YEAR ELSE l_shipdate END AS ts FROM lineitem)"""


def dated(spark, d):
    ts = F.when((F.col("l_orderkey") % 997 == 0) & (F.col("l_linenumber") == 1),
                F.col("l_shipdate") + F.expr("INTERVAL '40' YEAR")).otherwise(F.col("l_shipdate"))
    return table(spark, d, "lineitem").select("l_orderkey", F.col("l_extendedprice").alias("v"), ts.alias("ts"))


@check("time_anomaly_report", f"""WITH {DATED}, {SPAN}
SELECT y1 AS start_year, y2 AS end_year, round(inside / total, 4) AS confidence,
       CAST(CASE WHEN flagged THEN o ELSE 0 END AS BIGINT) AS flagged_dates FROM span""")
def anomalies(spark, d):
    return rounded(time_quality.anomaly_report(dated(spark, d), "ts"))


@check("monthly_without_anomalies", f"""WITH {DATED}, {SPAN}
SELECT strftime(ts, '%Y-%m') AS period, round(sum(v), 2) AS value, count(*) AS records FROM dated, span
WHERE NOT (flagged AND (year(ts) < y1 OR year(ts) > y2)) GROUP BY 1""")
def cleaned_months(spark, d):
    kept = time_quality.without_anomalies(dated(spark, d), "ts")
    return rounded(temporal.monthly_series(kept, "ts", {"faturamento": "v"}).select("period", "value", "records"), 2)
