"""Product detail, opportunities, insights, status and summary."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.operators import enrich, insights, metrics, rankings, temporal
from ledgerlens.plans import analysis
from ledgerlens.session import cut_lineage, shared_folder
from ledgerlens.sources import sinks

from .common import ROLES, SALES, check, once, rounded, sales, table
from .rankings import DIM_SQL, DNAME, NAME, PM, STATS, dims, long_sql, totals_sql
from .star import RETURNS_SQL
from .temporal import EVOLUTION, MAGNITUDE, RUNS, TREND, changes_sql

DETAIL_ROLES = {
    "produto_id": "Produto_ID", "produto": "Produto", "quantidade": "Quantidade", "faturamento": "Faturamento", "lucro": "Lucro",
    "avaliacao_media": "Avaliacao_Media", "estoque_atual": "Estoque_Atual", "estoque_minimo": "Estoque_Minimo",
    "estoque_maximo": "Estoque_Maximo", "taxa_devolucao": "Taxa_Devolucao", "risco_ruptura": "Risco_Ruptura",
    "estoque_excessivo": "Estoque_Excessivo",
}


@once
def sold(spark, d):
    """The sales as one written table: the queries below read them many times over and join them once. Each file holds whole products."""
    return cut_lineage(sales(spark, d, spread=True).select("Data", "Cliente_ID", "Cliente", "Produto_ID", "Produto", "Quantidade", "Faturamento", "Lucro"))


@once
def detail(spark, d):
    """Product detail over sales enriched with ratings, stock and returns; reduced to products once."""
    from .star import tables

    t = tables(spark, d)
    done = enrich.enrich(sold(spark, d), {n: t[n] for n in ("Avaliacoes", "Stock", "Devolucoes")}, spread=True)
    return cut_lineage(insights.product_detail(done.frame, DETAIL_ROLES))


DETAIL = f"""{totals_sql('produto')}, {RETURNS_SQL.strip()},
rate AS (SELECT l_partkey AS p, CAST(round(CAST(avg(l_linenumber) AS DECIMAL(18, 10)), 2) AS DOUBLE) AS m FROM lineitem GROUP BY 1),
det AS (SELECT entity, label, quantidade, faturamento, lucro, m AS avaliacao_media, CAST(p_size AS DOUBLE) AS estoque_atual, 10.0 AS estoque_minimo,
  round(CASE WHEN s > 0 THEN coalesce(q, 0) / s * 100 ELSE 0 END, 2) AS taxa_devolucao, p_size <= 10 AS risco, p_size >= 45 AS excesso, {NAME} AS product
  FROM ent JOIN part ON p_partkey = entity LEFT JOIN rate ON rate.p = entity LEFT JOIN sold ON sold.p = entity LEFT JOIN ret ON ret.p = entity)"""
MEANS = """means AS (SELECT avg(avaliacao_media) AS mr, avg(taxa_devolucao) AS mt, count(*) FILTER (WHERE risco) AS nr, count(*) FILTER (WHERE excesso) AS ne, count(*) AS n FROM det)"""
EXTREMES = """ext AS (
  SELECT 'risco_ruptura' AS concept, row_number() OVER (ORDER BY quantidade DESC, entity) AS position, * FROM det WHERE risco
  UNION ALL SELECT 'estoque_excessivo', row_number() OVER (ORDER BY quantidade, entity), * FROM det WHERE excesso
  UNION ALL SELECT 'maior_devolucao', row_number() OVER (ORDER BY taxa_devolucao DESC, entity), * FROM det
  UNION ALL SELECT 'melhor_avaliado', row_number() OVER (ORDER BY avaliacao_media DESC, entity), * FROM det
  UNION ALL SELECT 'pior_avaliado', row_number() OVER (ORDER BY avaliacao_media, entity), * FROM det)"""


@check("product_detail", f"""WITH {DETAIL} SELECT entity, label, round(quantidade, 4) AS quantidade, round(faturamento, 4) AS faturamento, round(lucro, 4) AS lucro,
 avaliacao_media, estoque_atual, taxa_devolucao, risco AS risco_ruptura, excesso AS estoque_excessivo, product FROM det""")
def product_detail(spark, d):
    return rounded(detail(spark, d).select("entity", "label", "quantidade", "faturamento", "lucro", "avaliacao_media", "estoque_atual",
                                           "taxa_devolucao", "risco_ruptura", "estoque_excessivo", "product"))


@check("product_means", f"""WITH {DETAIL}, {MEANS} SELECT round(mr, 6) AS avaliacao_media_geral, round(mt, 6) AS taxa_devolucao_media, nr AS produtos_risco_ruptura,
 ne AS produtos_estoque_excessivo, n AS quantidade_produtos FROM means""")
def product_means(spark, d):
    return rounded(insights.product_means(detail(spark, d)), 6)


@check("product_extremes", f"""WITH {DETAIL}, {EXTREMES} SELECT concept, position, entity, product, round(quantidade, 4) AS quantidade, taxa_devolucao, avaliacao_media FROM ext WHERE position <= 5""")
def product_extremes(spark, d):
    return rounded(insights.product_extremes(detail(spark, d)).select("concept", "position", "entity", "product", "quantidade", "taxa_devolucao", "avaliacao_media"))


@check("product_ranking", f"""WITH {DETAIL} SELECT row_number() OVER (ORDER BY faturamento DESC, entity) AS position, CAST(entity AS VARCHAR) AS product_id, product,
 round(quantidade, 4) AS quantidade, round(faturamento, 4) AS faturamento, round(lucro, 4) AS lucro, avaliacao_media, estoque_atual, taxa_devolucao FROM det QUALIFY position <= 10""")
def product_ranking(spark, d):
    return rounded(insights.product_ranking(detail(spark, d)))


@check("merged_product_ranking", f"""WITH {totals_sql('produto')}, {long_sql(PM)}, r AS (SELECT *, row_number() OVER (PARTITION BY concept ORDER BY value DESC, entity) AS pos FROM long),
m AS (SELECT entity, min(label) AS label, max(value) FILTER (WHERE concept = 'quantidade') AS quantidade, max(value) FILTER (WHERE concept = 'faturamento') AS faturamento,
  max(value) FILTER (WHERE concept = 'lucro') AS lucro FROM r WHERE pos <= 5 GROUP BY entity)
SELECT row_number() OVER (ORDER BY coalesce(faturamento, 0) DESC, CAST(entity AS VARCHAR)) AS position, CAST(entity AS VARCHAR) AS product_id, {NAME} AS product,
 round(quantidade, 4) AS quantidade, round(faturamento, 4) AS faturamento, round(lucro, 4) AS lucro FROM m QUALIFY position <= 10""")
def merged_ranking(spark, d):
    t = rankings.entity_totals(sales(spark, d), "Produto_ID", "Produto", {m: ROLES[m] for m in PM})
    return rounded(insights.merged_product_ranking(rankings.product_rankings(t, PM)))


def num(e: str) -> str:
    return f"regexp_replace(printf('%.2f', {e}), '(\\.\\d)0$', '\\1')"


SUMMARY_SQL = f"""{changes_sql('faturamento', 'lucro')}, {RUNS}, {EVOLUTION.replace(MAGNITUDE + ',', '')},
growth AS (SELECT *, {TREND} AS trend FROM evo),
ext0 AS (SELECT metric, max(percentage_change) FILTER (WHERE percentage_change > 0) AS gp, min(percentage_change) FILTER (WHERE percentage_change < 0) AS dp,
  arg_max(current_period, percentage_change * 100000 - ord / 1000.0) FILTER (WHERE percentage_change > 0) AS gper,
  arg_min(current_period, percentage_change * 100000 + ord / 1000.0) FILTER (WHERE percentage_change < 0) AS dper FROM changes GROUP BY metric),
perf AS (SELECT count(*) FILTER (WHERE lucro < 0) AS n, sum(lucro) FILTER (WHERE lucro < 0) AS loss FROM sales),
cand AS (SELECT row_number() OVER (ORDER BY lucro DESC, entity) AS position, product, lucro FROM det
  WHERE lucro > (SELECT avg(lucro) FROM det) AND faturamento < (SELECT avg(faturamento) FROM det) QUALIFY position <= 5),
cust AS (SELECT cliente_id, min(cliente) AS label, sum(faturamento) AS v FROM sales GROUP BY 1),
conc AS (SELECT (SELECT sum(v) FROM (SELECT v FROM cust ORDER BY v DESC LIMIT 5)) / sum(v) * 100 AS top5 FROM cust),
lead AS (SELECT label || ' (ID ' || cliente_id || ')' AS customer, v FROM cust ORDER BY v DESC, cliente_id LIMIT 1),
canal AS (SELECT l_returnflag AS f, sum(l_extendedprice * (1 - l_discount)) AS v FROM lineitem GROUP BY 1),
longest AS (SELECT * FROM runs WHERE metric = 'faturamento' ORDER BY length DESC, start_ord LIMIT 1),
run_list AS (SELECT string_agg(current_period, ' -> ' ORDER BY current_period) AS a, string_agg(current_period, ', ' ORDER BY current_period) AS b FROM flagged, longest
  WHERE flagged.metric = 'faturamento' AND flagged.falling AND flagged.run = longest.run HAVING count(*) > 0),
opp AS (
  SELECT 100 AS seq, 'tendencia_faturamento' AS category, 'atencao' AS type, 'alta' AS priority, 'O faturamento diminuiu entre o primeiro e o último período observado (' || {num('evolution')} || '%). Vale investigar os períodos e dimensões que mais contribuíram para essa redução.' AS message, evolution AS value, NULL AS metric, NULL AS period FROM growth WHERE metric = 'faturamento' AND trend = 'queda'
  UNION ALL SELECT 200, 'sequencia_quedas_faturamento', 'atencao', 'alta', 'Foi identificada uma sequência de quedas no faturamento nos períodos: ' || a || '.', NULL, NULL, b FROM run_list
  UNION ALL SELECT 300, 'tendencia_lucro', 'atencao', 'alta', 'O lucro diminuiu entre o primeiro e o último período observado (' || {num('evolution')} || '%). Vale revisar custos, margens e fontes de receita.', evolution, NULL, NULL FROM growth WHERE metric = 'lucro' AND trend = 'queda'
  UNION ALL SELECT 400, 'resultado_negativo', 'revisao', 'media', 'Foram encontrados ' || n || ' registros com resultado negativo, totalizando ' || {num('loss')} || '. Esses registros podem ser investigados para identificar fontes de perda.', n, NULL, NULL FROM perf WHERE n > 0
  UNION ALL SELECT 500 + position, 'produto_crescimento', 'oportunidade', 'media', 'O produto ''' || product || ''' apresenta lucro acima da média e faturamento abaixo da média, indicando possível espaço para crescimento.', lucro, NULL, NULL FROM cand WHERE position <= 3
  UNION ALL SELECT 600 + position, 'estoque_ruptura', 'atencao', 'alta', 'O produto ''' || product || ''' está em risco de ruptura de estoque, com estoque atual de ' || {num('estoque_atual')} || ' e mínimo de 10.0.', estoque_atual, NULL, NULL FROM ext WHERE concept = 'risco_ruptura' AND position <= 3
  UNION ALL SELECT 700 + position, 'estoque_excessivo', 'revisao', 'media', 'O produto ''' || product || ''' apresenta estoque elevado em relação ao limite definido. Vale avaliar giro, compras futuras ou ações comerciais.', estoque_atual, NULL, NULL FROM ext WHERE concept = 'estoque_excessivo' AND position <= 2
  UNION ALL SELECT 800 + position, 'produto_devolucao', 'atencao', 'media', 'O produto ''' || product || ''' possui taxa de devolução de ' || {num('taxa_devolucao')} || '%, acima da média de ' || {num('mt')} || '%. Vale investigar motivos de devolução e qualidade do produto.', taxa_devolucao, NULL, NULL FROM ext, means WHERE concept = 'maior_devolucao' AND position <= 3 AND taxa_devolucao > mt
  UNION ALL SELECT 900 + position, 'produto_avaliacao_negativa', 'revisao', 'media', 'O produto ''' || product || ''' possui avaliação média de ' || {num('avaliacao_media')} || ', abaixo da média geral de ' || {num('mr')} || '. Vale investigar possíveis problemas de qualidade ou expectativa do cliente.', avaliacao_media, NULL, NULL FROM ext, means WHERE concept = 'pior_avaliado' AND position <= 3 AND avaliacao_media < mr
  UNION ALL SELECT 1000, 'cliente_concentracao', 'informativo', 'baixa', 'Os 5 maiores clientes representam ' || {num('top5')} || '% do faturamento. A receita apresenta baixa concentração entre os principais clientes.', top5, NULL, NULL FROM conc WHERE top5 < 20),
ins AS (
  SELECT 100 AS seq, 'melhor_periodo' AS category, 'positivo' AS type, 'media' AS priority, 'O período ' || period || ' apresentou o maior valor de Faturamento, totalizando ' || {num('value')} || '.' AS message, value, 'faturamento' AS metric, period
    FROM (SELECT period, value FROM series WHERE metric = 'faturamento' ORDER BY value DESC LIMIT 1)
  UNION ALL SELECT 200, 'maior_queda', 'atencao', 'alta', 'A maior queda mensal ocorreu em ' || dper || ', com redução de ' || {num('abs(dp)')} || '%.', dp, NULL, dper FROM ext0 WHERE metric = 'faturamento' AND dp < 0
  UNION ALL SELECT 300, 'maior_crescimento', 'positivo', 'media', 'O maior crescimento mensal ocorreu em ' || gper || ', com aumento de ' || {num('gp')} || '%.', gp, NULL, gper FROM ext0 WHERE metric = 'faturamento' AND gp > 0
  UNION ALL SELECT 400, 'tendencia_faturamento', 'atencao', 'alta', 'Entre o primeiro e o último período observado, o faturamento apresentou redução ' || {num('abs(evolution)')} || '%.', evolution, NULL, NULL FROM growth WHERE metric = 'faturamento' AND trend = 'queda'
  UNION ALL SELECT 500, 'resultado_negativo', 'atencao', 'alta', 'Foram identificados ' || n || ' registros com resultado negativo, totalizando ' || {num('loss')} || '.', n, NULL, NULL FROM perf WHERE n > 0
  UNION ALL SELECT 600, 'produto_volume', 'informativo', 'media', 'O produto ''' || product || ''' apresentou o maior volume de vendas, com ' || {num('quantidade')} || ' unidades.', quantidade, NULL, NULL FROM (SELECT * FROM det ORDER BY quantidade DESC, entity LIMIT 1)
  UNION ALL SELECT 700, 'produto_faturamento', 'positivo', 'media', 'O produto ''' || product || ''' apresentou o maior faturamento, totalizando ' || {num('faturamento')} || '.', faturamento, NULL, NULL FROM (SELECT * FROM det ORDER BY faturamento DESC, entity LIMIT 1)
  UNION ALL SELECT 800, 'produto_rentabilidade', 'informativo', 'media', 'O produto com maior volume (''' || a.product || ''') é diferente do produto com maior faturamento (''' || b.product || ''').', NULL, NULL, NULL
    FROM (SELECT * FROM det ORDER BY quantidade DESC, entity LIMIT 1) a, (SELECT * FROM det ORDER BY faturamento DESC, entity LIMIT 1) b WHERE a.entity <> b.entity
  UNION ALL SELECT 900, 'estoque_ruptura', 'atencao', 'alta', 'O produto ''' || product || ''' está entre os produtos com risco de ruptura e possui volume relevante de vendas.', NULL, NULL, NULL FROM ext WHERE concept = 'risco_ruptura' AND position = 1
  UNION ALL SELECT 1000, 'estoque_excessivo', 'informativo', 'media', 'Foram identificados ' || ne || ' produtos com estoque acima do nível máximo definido.', ne, NULL, NULL FROM means WHERE ne > 0
  UNION ALL SELECT 1100, 'produto_devolucao', 'atencao', 'media', 'O produto ''' || product || ''' apresentou uma das maiores taxas de devolução, com ' || {num('taxa_devolucao')} || '%.', taxa_devolucao, NULL, NULL FROM ext WHERE concept = 'maior_devolucao' AND position = 1
  UNION ALL SELECT 1200, 'produto_avaliacao_positiva', 'positivo', 'media', 'O produto ''' || product || ''' está entre os melhores avaliados, com nota média de ' || {num('avaliacao_media')} || '.', avaliacao_media, NULL, NULL FROM ext WHERE concept = 'melhor_avaliado' AND position = 1
  UNION ALL SELECT 1300, 'produto_avaliacao_negativa', 'informativo', 'media', 'O produto ''' || product || ''' está entre os produtos com menor avaliação média, com nota ' || {num('avaliacao_media')} || '.', avaliacao_media, NULL, NULL FROM ext WHERE concept = 'pior_avaliado' AND position = 1
  UNION ALL SELECT 1400, 'produto_crescimento', 'oportunidade', 'media', 'O produto ''' || product || ''' apresenta lucro acima da média e faturamento abaixo da média, sendo um possível candidato para investigação de crescimento.', lucro, NULL, NULL FROM cand WHERE position = 1
  UNION ALL SELECT 1500, 'cliente_concentracao', 'informativo', 'baixa', 'Os 5 maiores clientes representam ' || {num('top5')} || '% do faturamento total.', top5, NULL, NULL FROM conc
  UNION ALL SELECT 1600, 'cliente_destaque', 'positivo', 'media', 'O cliente ''' || customer || ''' apresentou o maior faturamento da carteira, totalizando ' || {num('v')} || '.', v, NULL, NULL FROM lead
  UNION ALL SELECT 1700, 'canal_desempenho', 'positivo', 'baixa', 'O destaque de faturamento na dimensão canal foi ''' || f || ''', totalizando ' || {num('v')} || '.', v, 'faturamento', NULL
    FROM (SELECT *, lead(v) OVER (ORDER BY v DESC) AS nxt, row_number() OVER (ORDER BY v DESC) AS r FROM canal) WHERE r = 1 AND v > nxt)"""
FULL = DETAIL + ", " + MEANS + ", " + EXTREMES + "," + SUMMARY_SQL.replace(SALES + ",", "", 1)


@once
def parts(spark, d):
    """The aggregate frames the rules read, each reduced once."""
    s = sold(spark, d)
    det = detail(spark, d)
    series = cut_lineage(temporal.monthly_series(s, "Data", {m: ROLES[m] for m in ("faturamento", "lucro")}))
    changes = temporal.compare_series(series)
    cust = cut_lineage(rankings.entity_totals(s, "Cliente_ID", "Cliente", {"faturamento": "Faturamento"}))
    stats = rankings.evidence_stats(cust, ["faturamento"])
    known = det.select("entity", "label", "faturamento", "lucro")
    values = det.select("entity", "label", F.inline(F.array(
        F.struct(F.lit("quantidade").alias("concept"), F.col("quantidade").alias("value")),
        F.struct(F.lit("faturamento").alias("concept"), F.col("faturamento").alias("value")))))
    top = rankings.top_entities(values, 1).select(
        "concept", "position", F.col("entity").cast("string").alias("product_id"), rankings.display_entity(F.col("entity"), F.col("label")).alias("product"), "value")
    li = table(spark, d, "lineitem")
    channel = rankings.dimension_totals(
        li.select("l_returnflag", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v")), {"canal_venda": "l_returnflag", "faturamento": "v"})
    return {
        "growth": cut_lineage(temporal.growth_summary(series)), "runs": insights.run_periods(changes), "performance": cut_lineage(temporal.profit_performance(s, "Lucro")),
        "candidates": cut_lineage(rankings.growth_candidates(known)), "extremes": cut_lineage(insights.product_extremes(det)), "means": cut_lineage(insights.product_means(det)),
        "concentration": cut_lineage(rankings.concentration(stats, "faturamento")), "series_extremes": temporal.extremes(series), "product_top": top,
        "leader": rankings.leaders(cust, ["faturamento"], True), "dimension_top": rankings.dimension_top(channel, "faturamento"),
    }


def opportunity_rows(p):
    return insights.opportunities(p["growth"], p["runs"], p["performance"], p["candidates"], p["extremes"], p["means"], p["concentration"])


def insight_rows(p):
    return insights.insights("faturamento", p["series_extremes"], p["growth"], p["performance"], p["product_top"], p["extremes"], p["means"],
                             p["candidates"], p["concentration"], p["leader"], p["dimension_top"], "Faturamento")


ROWS = "SELECT seq, category, type, priority, message, round(value, 4) AS value, metric, period FROM "


@check("opportunities", f"WITH {FULL} {ROWS} opp")
def opportunities(spark, d):
    return rounded(insights.by_priority(opportunity_rows(parts(spark, d))).drop("origin"))


@check("insights", f"WITH {FULL} {ROWS} ins")
def insight_list(spark, d):
    return rounded(insights.by_priority(insight_rows(parts(spark, d))).drop("origin"))


ORGANISED = """
allr AS (SELECT * FROM opp UNION ALL SELECT seq + 10000, category, type, priority, message, value, metric, period FROM ins),
k0 AS (SELECT *, CASE WHEN type IN ('atencao', 'revisao') THEN 'risco' WHEN type = 'positivo' THEN 'destaque' ELSE type END AS kind,
  CASE priority WHEN 'alta' THEN 3 WHEN 'media' THEN 2 ELSE 1 END AS rp,
  (CASE WHEN value IS NULL THEN 0 ELSE 1 END) + (CASE WHEN metric IS NULL THEN 0 ELSE 1 END) + (CASE WHEN period IS NULL THEN 0 ELSE 1 END) AS rc,
  CASE WHEN regexp_matches(message, '[0-9]') THEN 1 ELSE 0 END AS rd, length(message) AS rl FROM allr),
k1 AS (SELECT *, CASE kind WHEN 'risco' THEN 2 WHEN 'oportunidade' THEN 1 ELSE 0 END AS prec, min(seq) OVER (PARTITION BY category) AS cseq FROM k0),
k2 AS (SELECT * FROM k1 QUALIFY row_number() OVER (PARTITION BY category ORDER BY prec DESC, rp DESC, rc DESC, rd DESC, rl DESC, seq) = 1),
k3 AS (SELECT *, row_number() OVER (ORDER BY prec DESC, rp DESC, rc DESC, rd DESC, rl DESC, cseq) AS s2,
  CASE kind WHEN 'risco' THEN 'principais_riscos' WHEN 'oportunidade' THEN 'oportunidades' ELSE 'principais_insights' END AS list,
  CASE WHEN category LIKE 'cliente\\_%' ESCAPE '\\' OR category LIKE 'produto\\_%' ESCAPE '\\' OR category LIKE 'estoque\\_%' ESCAPE '\\' THEN split_part(category, '_', 1)
       WHEN category LIKE 'tendencia%' OR category LIKE 'maior\\_%' ESCAPE '\\' OR category LIKE 'melhor_periodo%' OR category LIKE 'sequencia%' THEN 'temporal' ELSE category END AS subj FROM k2),
k4 AS (SELECT *, row_number() OVER (PARTITION BY list ORDER BY rp DESC, rc DESC, rd DESC, rl DESC, s2) AS rank,
  row_number() OVER (PARTITION BY list, subj ORDER BY rp DESC, rc DESC, rd DESC, rl DESC, s2) AS turn FROM k3),
k5 AS (SELECT *, row_number() OVER (PARTITION BY list ORDER BY (list = 'principais_insights' AND turn > 1), rank) AS slot FROM k4),
k6 AS (SELECT * FROM k5 WHERE slot <= CASE WHEN list = 'principais_insights' THEN 8 ELSE 5 END)
SELECT list, row_number() OVER (PARTITION BY list ORDER BY rp DESC, rc DESC, rd DESC, rl DESC, slot) AS position, category, priority,
  CASE kind WHEN 'risco' THEN 'atencao' WHEN 'destaque' THEN 'positivo' ELSE kind END AS type, message FROM k6"""


@check("organised_lists", f"WITH {FULL}, {ORGANISED}")
def organised(spark, d):
    p = parts(spark, d)
    return insights.organise(opportunity_rows(p), insight_rows(p))


@check("status_score", f"""WITH {FULL},
t AS (SELECT bool_or(metric = 'faturamento' AND trend = 'queda') AS r, bool_or(metric = 'lucro' AND trend = 'queda') AS p FROM growth),
a AS (SELECT count(*) AS n FROM opp WHERE priority = 'alta' AND type IN ('atencao', 'revisao')),
s AS (SELECT r, p, greatest(0, 100 - CASE WHEN r THEN 20 ELSE 0 END - CASE WHEN p THEN 20 ELSE 0 END - CASE WHEN perf.n > 0 THEN 10 ELSE 0 END - least(a.n * 5, 20)) AS score FROM t, a, perf)
SELECT CAST(score AS BIGINT) AS score, CASE WHEN score >= 80 THEN 'saudavel' WHEN score >= 60 THEN 'atencao' ELSE 'critico' END AS status FROM s""")
def status(spark, d):
    p = parts(spark, d)
    return insights.status(p["growth"], p["performance"], opportunity_rows(p)).select("score", "status")


@check("analytic_sufficiency", """
SELECT 'parcial' AS sufficiency, false AS score_shown FROM (SELECT sum(l_extendedprice) AS v FROM lineitem) WHERE v IS NOT NULL
UNION ALL SELECT CASE WHEN sum(l_quantity) IS NOT NULL THEN 'suficiente' END, true FROM lineitem
UNION ALL SELECT CASE WHEN count(*) > 0 THEN 'insuficiente' END, false FROM lineitem""")
def sufficiency(spark, d):
    li = table(spark, d, "lineitem")
    rows = [insights.sufficiency(metrics.kpis(li, r)) for r in (
        {"valor_total": "l_extendedprice"}, {"faturamento": "l_quantity"}, {"pedido": "l_orderkey"})]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@check("mapping_provenance", """
SELECT n_name AS "column", CASE WHEN n_regionkey = 0 THEN 'usuario' WHEN n_regionkey = 1 THEN 'cabecalho_posterior' ELSE 'conteudo' END AS origin,
 CASE WHEN n_regionkey = 0 THEN 1.0 WHEN n_regionkey = 1 THEN 0.97 END AS confidence FROM nation""")
def provenance(spark, d):
    n = table(spark, d, "nation")
    header = F.col("n_regionkey") == 1
    auto = n.select(F.col("n_name").alias("column"), F.when(header, "cabecalho_posterior").alias("header_origin"), F.when(header, 0.97).alias("header_confidence"))
    return insights.mapping_provenance(auto, n.where("n_regionkey = 0").select(F.col("n_name").alias("column")))


@once
def whole(spark, d):
    """The whole analysis of the sales and product tables."""
    li, o, p = (table(spark, d, t) for t in ("lineitem", "orders", "part"))
    return analysis.analyze({
        "Vendas": li.join(o, F.expr("l_orderkey = o_orderkey")).select(
            F.col("l_orderkey").alias("Pedido_ID"), F.col("o_orderdate").alias("Data"), F.col("o_custkey").alias("Cliente_ID"),
            F.col("l_partkey").alias("Produto_ID"), F.col("l_quantity").alias("Quantidade"), F.col("l_extendedprice").alias("Faturamento")),
        "Produtos": p.select(F.col("p_partkey").alias("Produto_ID"), F.col("p_name").alias("Nome"), F.col("p_type").alias("Categoria"),
                             F.col("p_retailprice").alias("Custo_Aquisicao"))})


WHOLE = """WITH v AS (SELECT l_extendedprice AS f, l_quantity * p_retailprice AS c, l_orderkey AS p, o_custkey AS k, l_partkey AS i
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""


@check("executive_summary", f"""{WHOLE} SELECT round(sum(f), 2) AS revenue, round(sum(f - c), 2) AS profit, count(*) AS records, count(DISTINCT i) AS products,
  true AS lists_bounded, true AS scored FROM v""")
def summary_row(spark, d):
    """The one row that holds everything, taken apart again."""
    row = whole(spark, d)["executive_summary"]
    value = lambda name: F.element_at(F.filter("kpis", lambda k: k["indicador"] == name), 1)["valor"]
    counts = F.size(F.filter("lists", lambda x: x["list"] == "principais_riscos")) <= insights.MAX_RISKS
    return rounded(row.select(
        value("faturamento_total").alias("revenue"), value("lucro_total").alias("profit"), value("quantidade_registros").cast("bigint").alias("records"),
        F.col("products")[0]["quantidade_produtos"].alias("products"), (counts & (F.size("lists") > 0)).alias("lists_bounded"),
        F.col("status")[0]["score"].between(0, 100).alias("scored")), 2)


@check("analysis_json", f"""{WHOLE} SELECT 'faturamento_total' AS indicador, round(sum(f), 2) AS valor FROM v UNION ALL SELECT 'custo_total', round(sum(c), 2) FROM v
  UNION ALL SELECT 'quantidade_registros', count(*) FROM v""")
def analysis_json(spark, d):
    """The summary written as JSON and read back."""
    path = shared_folder(spark, "analysis")
    sinks.write_json(whole(spark, d)["executive_summary"], path)
    back = spark.read.json(path).select(F.inline("kpis"))
    return rounded(back.where(F.col("indicador").isin("faturamento_total", "custo_total", "quantidade_registros")).select("indicador", "valor"), 2)
