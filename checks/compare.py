"""Two analyses compared, and the snapshot store."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.operators import compare, metrics, quality, rankings, temporal
from ledgerlens.session import shared_folder
from ledgerlens.sources import snapshots

from .common import ROLES, SALES, check, rounded, sales

HALVES = "1998-06-01"
K = ("faturamento_total", "lucro_total", "custo_total", "margem_lucro", "ticket_medio", "quantidade_pedidos", "quantidade_registros", "quantidade_vendida")


def half(spark, d, which):
    s = sales(spark, d)
    cut = F.lit(HALVES).cast("timestamp")
    return s.where(F.col("Data") < cut) if which == "left" else s.where(F.col("Data") >= cut)


def kpis(spark, d, which):
    roles = {r: ROLES[r] for r in ("faturamento", "lucro", "custo", "quantidade", "pedido")}
    return metrics.kpis_long(metrics.kpis(half(spark, d, which), roles))


def _k(cond):
    return f"""SELECT sum(faturamento) AS faturamento_total, sum(lucro) AS lucro_total, sum(custo) AS custo_total, sum(lucro) / sum(faturamento) * 100 AS margem_lucro,
 sum(faturamento) / count(DISTINCT pedido) AS ticket_medio, CAST(count(DISTINCT pedido) AS DOUBLE) AS quantidade_pedidos, CAST(count(*) AS DOUBLE) AS quantidade_registros,
 sum(quantidade) AS quantidade_vendida FROM sales WHERE {cond}"""


L, R = f"data < TIMESTAMP '{HALVES}'", f"data >= TIMESTAMP '{HALVES}'"
KPIS = f"""{SALES}, lw AS ({_k(L)}), rw AS ({_k(R)}), lk AS (UNPIVOT lw ON {', '.join(K)} INTO NAME indicador VALUE v),
rk AS (UNPIVOT rw ON {', '.join(K)} INTO NAME indicador VALUE v), kk AS (SELECT indicador, lk.v AS l, rk.v AS r FROM lk JOIN rk USING (indicador))"""


@check("snapshot_kpi_comparison", f"""WITH {KPIS} SELECT indicador, round(r, 1) AS atual, round(l, 1) AS anterior,
 CASE WHEN indicador <> 'margem_lucro' THEN round((r - l) / l * 100, 2) END AS percent, CASE WHEN indicador = 'margem_lucro' THEN round(r - l, 2) END AS points FROM kk""")
def snapshot_kpis(spark, d):
    return rounded(compare.snapshot_kpis(kpis(spark, d, "right"), kpis(spark, d, "left")).withColumn(
        "atual", F.round("atual", 1)).withColumn("anterior", F.round("anterior", 1)), 2)


CHANGES = f"""{KPIS}, dd AS (SELECT *, round(r - l, 2) AS d, round(round(r - l, 2) / l * 100, 2) AS p FROM kk),
chg AS (SELECT *, CASE WHEN abs(p) < 0.5 THEN 'stable' WHEN d > 0 THEN 'increase' ELSE 'decrease' END AS direction FROM dd)"""


@check("metric_changes", f"""WITH {CHANGES} SELECT indicador, round(d, 0) AS absolute_change, CASE WHEN indicador <> 'margem_lucro' THEN p END AS percentage_change,
 CASE WHEN indicador = 'margem_lucro' THEN d END AS point_change, direction FROM chg""")
def metric_changes(spark, d):
    c = compare.metric_changes(kpis(spark, d, "left"), kpis(spark, d, "right"))
    return rounded(c.select("indicador", F.round("absolute_change", 0).alias("absolute_change"), "percentage_change", "point_change", "direction"))


@check("comparison_messages", f"""WITH {CHANGES}, lab(indicador, label) AS (VALUES ('faturamento_total', 'Faturamento'), ('lucro_total', 'Lucro'), ('custo_total', 'Custo'),
 ('margem_lucro', 'Margem de lucro'), ('ticket_medio', 'Ticket médio'), ('quantidade_pedidos', 'Pedidos'), ('quantidade_registros', 'Registros'), ('quantidade_vendida', 'Quantidade vendida'))
SELECT 'comparison_' || indicador AS category, label || CASE WHEN d > 0 THEN ' aumentou ' ELSE ' diminuiu ' END ||
 CASE WHEN indicador = 'margem_lucro' THEN printf('%+.2f', d) || ' pontos percentuais' ELSE printf('%+.2f', p) || '%' END || ' entre as análises.' AS message
FROM chg JOIN lab USING (indicador) WHERE direction <> 'stable'""")
def messages(spark, d):
    return compare.change_messages(compare.metric_changes(kpis(spark, d, "left"), kpis(spark, d, "right")))


def series(spark, d, which):
    return temporal.monthly_series(half(spark, d, which), "Data", {"faturamento": "Faturamento"})


@check("period_comparability", f"""WITH {SALES}, a AS (SELECT min(period) AS s, max(period) AS e FROM sales WHERE {L}), b AS (SELECT min(period) AS s, max(period) AS e FROM sales WHERE {R}),
x AS (SELECT a.s AS left_start, a.e AS left_end, CAST(date_diff('day', CAST(a.s || '-01' AS DATE), last_day(CAST(a.e || '-01' AS DATE))) + 1 AS BIGINT) AS left_days,
 b.s AS right_start, b.e AS right_end, CAST(date_diff('day', CAST(b.s || '-01' AS DATE), last_day(CAST(b.e || '-01' AS DATE))) + 1 AS BIGINT) AS right_days FROM a, b)
SELECT *, CASE WHEN left_days = right_days THEN 'same_duration' WHEN greatest(left_days, right_days) / greatest(1, least(left_days, right_days)) <= 1.1 THEN 'similar_duration' ELSE 'different_duration' END AS comparability FROM x""")
def comparability(spark, d):
    return rounded(compare.period_comparability(series(spark, d, "left"), series(spark, d, "right")))


def ranking(spark, d, which):
    t = rankings.entity_totals(half(spark, d, which), "Cliente_ID", "Cliente", {"faturamento": "Faturamento"})
    return rankings.customer_ranking(t, ["faturamento"], True).select(F.col("customer_id").alias("entity_id"), F.col("customer").alias("label"), "value")


RANKS = f"""{SALES}, lr AS (SELECT CAST(cliente_id AS VARCHAR) AS k, min(cliente) || ' (ID ' || cliente_id || ')' AS label, sum(faturamento) AS v FROM sales WHERE {L} GROUP BY cliente_id ORDER BY v DESC, cliente_id LIMIT 10),
rr AS (SELECT CAST(cliente_id AS VARCHAR) AS k, min(cliente) || ' (ID ' || cliente_id || ')' AS label, sum(faturamento) AS v FROM sales WHERE {R} GROUP BY cliente_id ORDER BY v DESC, cliente_id LIMIT 10),
m AS (SELECT coalesce(lr.k, rr.k) AS key, coalesce(rr.label, lr.label) AS label, lr.v AS l, rr.v AS r, CASE WHEN lr.v IS NULL THEN 'only_right' WHEN rr.v IS NULL THEN 'only_left' ELSE 'common' END AS part FROM lr FULL JOIN rr ON lr.k = rr.k)"""


@check("ranking_comparison", f"""WITH {RANKS}
SELECT part, key, label, round(l, 4) AS "left", round(r, 4) AS "right", round(r - l, 4) AS absolute_change,
 row_number() OVER (PARTITION BY part ORDER BY coalesce(abs(r - l), coalesce(l, r)) DESC, key) AS position FROM m QUALIFY position <= 5""")
def ranking_comparison(spark, d):
    return rounded(compare.ranking_comparison(ranking(spark, d, "left"), ranking(spark, d, "right")).drop("identity_reliable"))


@check("identity_reliability", f"""WITH {RANKS} SELECT CASE WHEN count(*) FILTER (WHERE part = 'common') > 0 THEN 'stable_id' ELSE 'label_or_mixed' END AS identity_reliability FROM m""")
def reliability(spark, d):
    return compare.identity_reliability(ranking(spark, d, "left"), ranking(spark, d, "right"))


@check("shared_periods", f"""WITH {SALES}, a AS (SELECT period, sum(faturamento) AS v FROM sales GROUP BY 1), b AS (SELECT period, sum(faturamento) AS v FROM sales WHERE categoria = 'STANDARD' AND {R} GROUP BY 1)
SELECT 'faturamento' AS metric, period, round(a.v, 4) AS "left", round(b.v, 4) AS "right" FROM a JOIN b USING (period)""")
def shared(spark, d):
    whole = temporal.monthly_series(sales(spark, d), "Data", {"faturamento": "Faturamento"})
    part = temporal.monthly_series(half(spark, d, "right").where("Categoria = 'STANDARD'"), "Data", {"faturamento": "Faturamento"})
    return rounded(compare.shared_periods(whole, part))


def quality_row(spark, d, which):
    s = half(spark, d, which).select("Pedido_ID", F.when(F.col("Quantidade") > 5, F.col("Quantidade")).alias("Quantidade"))
    p, dup = quality.null_profile(s), quality.duplicate_rows(s)
    return quality.quality_score(p, dup, quality.issues(p, quality.infer_types(s), dup))


def _q(cond):
    return f"""SELECT n, nulls, dup, nulls / (n * 2) * 100 AS np FROM (SELECT count(*) AS n, count(*) FILTER (WHERE quantidade <= 5) AS nulls,
 count(*) - count(DISTINCT (pedido, CASE WHEN quantidade > 5 THEN quantidade END)) AS dup FROM sales WHERE {cond})"""


@check("quality_changes", f"""WITH {SALES}, a AS ({_q(L)}), b AS ({_q(R)}),
s AS (SELECT 100 - (least(30, a.np) + least(20, a.dup / a.n * 100) + 5) AS sa, 100 - (least(30, b.np) + least(20, b.dup / b.n * 100) + 5) AS sb, a.nulls AS na, b.nulls AS nb, a.dup AS da, b.dup AS db FROM a, b)
SELECT 'score' AS measure, round(sa, 6) AS "left", round(sb, 6) AS "right", round(sb - sa, 6) AS absolute_change FROM s
UNION ALL SELECT 'total_nulls', na, nb, nb - na FROM s UNION ALL SELECT 'duplicates', da, db, db - da FROM s""")
def quality_changes(spark, d):
    return rounded(compare.quality_changes(quality_row(spark, d, "left"), quality_row(spark, d, "right")), 6)


@check("snapshot_store", f"""WITH {KPIS}
SELECT 'b' AS which, 'multi' AS mode, (SELECT min(period) FROM sales WHERE {R}) AS period_start, (SELECT max(period) FROM sales WHERE {R}) AS period_end, CAST(8 AS BIGINT) AS metrics, round(max(CASE WHEN indicador = 'quantidade_registros' THEN r END), 0) AS records FROM kk
UNION ALL SELECT 'a', 'single', (SELECT min(period) FROM sales WHERE {L}), (SELECT max(period) FROM sales WHERE {L}), 8, round(max(CASE WHEN indicador = 'quantidade_registros' THEN l END), 0) FROM kk""")
def snapshot_store(spark, d):
    path = shared_folder(spark, "snapshots")
    status = spark.createDataFrame([(90, "saudavel")], "score int, status string")
    ids = {"left": "analysis_20250101_101010000001_" + "a" * 32, "right": "analysis_20250102_101010000001_" + "b" * 32}
    for which, ident in ids.items():
        k, s = kpis(spark, d, which), series(spark, d, which)
        q = spark.createDataFrame([(1, 2, 0, 0, 90.0, "excelente")], "rows long, columns long, total_nulls long, duplicates long, score double, grade string")
        files = ["x.csv"] if which == "left" else ["x.csv", "y.csv"]
        snapshots.save_snapshot(path, ident, snapshots.index_record(spark, ident, ident[9:17], files, k, s, q, status, ["cliente"]), {"kpis": k})
    listed = snapshots.list_snapshots(spark, path)
    records = None
    for ident in ids.values():
        one = snapshots.fetch_snapshot(spark, path, ident, "kpis").where("indicador = 'quantidade_registros'").select("id", F.col("valor").alias("records"))
        records = one if records is None else records.unionByName(one)
    return listed.join(records, "id").select(F.substring("id", -1, 1).alias("which"), "mode", "period_start", "period_end",
                                             F.size("available_metrics").cast("bigint").alias("metrics"), "records")
