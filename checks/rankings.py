"""Customers, products and dimensions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.operators import rankings
from ledgerlens.session import cut_lineage

from .common import ROLES, SALES, check, rounded, sales, table

METRICS = ["faturamento", "valor_total", "valor_com_desconto", "margem_bruta", "lucro"]


def customers(spark, d, metrics=METRICS):
    return rankings.entity_totals(sales(spark, d), "Cliente_ID", "Cliente", {m: ROLES[m] for m in metrics})


def products(spark, d, metrics=("faturamento", "quantidade", "lucro")):
    return rankings.entity_totals(sales(spark, d), "Produto_ID", "Produto", {m: ROLES[m] for m in metrics})


def totals_sql(kind: str) -> str:
    sums = ", ".join(f"sum({m}) AS {m}" for m in METRICS + ["quantidade", "custo"])
    return f"{SALES}, ent AS (SELECT {kind}_id AS entity, min({kind}) AS label, {sums}, count(*) AS records FROM sales GROUP BY 1)"


def long_sql(metrics) -> str:
    return "long AS (" + " UNION ALL ".join(f"SELECT '{m}' AS concept, entity, label, {m} AS value FROM ent" for m in metrics) + ")"


RANKED = "ranked AS (SELECT *, row_number() OVER (PARTITION BY concept ORDER BY value DESC, entity) AS position FROM long)"
NAME = "label || ' (ID ' || entity || ')'"


@check("entity_totals", f"""WITH {SALES} SELECT cliente_id AS entity, min(cliente) AS label, count(*) AS records,
 round(sum(faturamento), 4) AS faturamento, round(sum(lucro), 4) AS lucro, count(lucro) AS lucro_valid,
 count(*) FILTER (WHERE lucro < 0) AS lucro_neg_rows FROM sales GROUP BY 1""")
def entity_totals(spark, d):
    return rounded(customers(spark, d, ["faturamento", "lucro"]).select(
        "entity", "label", "records", "faturamento", "lucro", "lucro_valid", "lucro_neg_rows"))


@check("customer_ranking", f"""WITH {totals_sql('cliente')}, {long_sql(METRICS)}, {RANKED}
SELECT concept, position, {NAME} AS customer, CAST(entity AS VARCHAR) AS customer_id, round(value, 4) AS value FROM ranked WHERE position <= 10""")
def customer_ranking(spark, d):
    return rounded(rankings.customer_ranking(customers(spark, d), METRICS, True))


@check("ranking_by_label_without_id", f"""WITH {SALES}, ent AS (SELECT categoria AS entity, sum(faturamento) AS value FROM sales GROUP BY 1)
SELECT 'faturamento' AS concept, row_number() OVER (ORDER BY value DESC, entity) AS position, entity AS customer,
       CAST(NULL AS VARCHAR) AS customer_id, round(value, 4) AS value FROM ent QUALIFY position <= 10""")
def label_ranking(spark, d):
    t = rankings.entity_totals(sales(spark, d), "Categoria", None, {"faturamento": "Faturamento"})
    return rounded(rankings.customer_ranking(t, ["faturamento"], False))


@check("customer_leaders", f"""WITH {totals_sql('cliente')}, {long_sql(METRICS)}, {RANKED}
SELECT concept, {NAME} AS customer, CAST(entity AS VARCHAR) AS customer_id, round(value, 4) AS value FROM ranked WHERE position = 1""")
def customer_leaders(spark, d):
    return rounded(rankings.leaders(customers(spark, d), METRICS, True))


def _paired(by, other):
    return f"""WITH {totals_sql('cliente')}
SELECT row_number() OVER (ORDER BY {by} DESC, entity) AS position, {NAME} AS customer, CAST(entity AS VARCHAR) AS customer_id,
       round({by}, 4) AS {by}, round({other}, 4) AS {other} FROM ent QUALIFY position <= 10"""


@check("revenue_ranking_with_profit", _paired("faturamento", "lucro"))
def revenue_ranking(spark, d):
    return rounded(rankings.paired_ranking(customers(spark, d, ["faturamento", "lucro"]), "faturamento", "lucro"))


@check("profit_ranking_with_revenue", _paired("lucro", "faturamento"))
def profit_ranking(spark, d):
    return rounded(rankings.paired_ranking(customers(spark, d, ["faturamento", "lucro"]), "lucro", "faturamento"))


STATS = f"""{totals_sql('cliente')}, {long_sql(METRICS)}, {RANKED},
rows_neg AS (SELECT count(*) FILTER (WHERE valor_total < 0) AS n0, count(*) FILTER (WHERE faturamento < 0) AS n1,
             count(*) FILTER (WHERE lucro < 0) AS n2,
             count(*) FILTER (WHERE margem_bruta < 0) AS n3, count(*) AS n FROM sales),
stats AS (SELECT concept, (SELECT n FROM rows_neg) AS registros, (SELECT n FROM rows_neg) AS registros_validos, count(value) AS populacao,
  count(*) FILTER (WHERE value < 0) AS negativos, coalesce(sum(value) FILTER (WHERE value < 0), 0) AS soma_negativos,
  sum(abs(value)) AS soma_absoluta, max(value) AS top1_valor, sum(value) FILTER (WHERE position <= 5) AS top5_valor,
  sum(value) AS total_metrica,
  (SELECT CASE WHEN concept = 'valor_total' THEN n0 WHEN concept IN ('faturamento', 'valor_com_desconto') THEN n1 WHEN concept = 'lucro' THEN n2 ELSE n3 END FROM rows_neg) AS registros_negativos
  FROM ranked GROUP BY concept)"""


@check("customer_evidence", f"""WITH {STATS}
SELECT concept, registros, registros_validos, populacao, negativos, round(soma_negativos, 2) AS soma_negativos,
 round(soma_absoluta, 2) AS soma_absoluta, round(top1_valor, 2) AS top1_valor, round(top5_valor, 2) AS top5_valor,
 round(total_metrica, 2) AS total_metrica, registros_negativos FROM stats""")
def evidence(spark, d):
    return rounded(rankings.evidence_stats(cut_lineage(customers(spark, d)), METRICS), 2)


@check("customer_concentration", f"""WITH {STATS}
SELECT concept, round(top1_valor / total_metrica * 100, 6) AS participacao_maior_cliente,
       round(top5_valor / total_metrica * 100, 6) AS concentracao_top_5 FROM stats WHERE concept = 'faturamento'""")
def concentration(spark, d):
    return rounded(rankings.concentration(rankings.evidence_stats(cut_lineage(customers(spark, d)), METRICS), "faturamento"), 6)


@check("negative_customers", f"""WITH {totals_sql('cliente')}
SELECT CAST(entity AS VARCHAR) AS entity_id, {NAME} AS entity, round(margem_bruta, 4) AS margem_bruta FROM ent WHERE margem_bruta < 0""")
def negatives(spark, d):
    return rounded(rankings.negative_entities(customers(spark, d, ["margem_bruta"]), "margem_bruta"))


@check("customer_count", "SELECT count(DISTINCT o_custkey) AS entities FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def customer_count(spark, d):
    return rankings.entity_count(customers(spark, d, ["faturamento"]))


def comma(e: str) -> str:
    return f"replace(printf('%.2f', {e}), '.', ',')"


@check("customer_messages", f"""WITH {STATS}
SELECT 1 AS position, 'Os cinco maiores clientes representam ' || {comma('top5_valor / total_metrica * 100')} || '% de Faturamento.' AS message FROM stats WHERE concept = 'faturamento'
UNION ALL SELECT 2, 'O maior cliente representa ' || {comma('top1_valor / total_metrica * 100')} || '% de Faturamento.' FROM stats WHERE concept = 'faturamento'
UNION ALL SELECT 3, 'O cliente com maior faturamento difere do cliente com maior lucro.'
  WHERE (SELECT entity FROM ranked WHERE concept = 'faturamento' AND position = 1) <> (SELECT entity FROM ranked WHERE concept = 'lucro' AND position = 1)
UNION ALL SELECT 4, CASE WHEN negativos = 1 THEN '1 cliente apresenta Lucro negativo.' ELSE negativos || ' clientes apresentam Lucro negativo.' END
  FROM stats WHERE concept = 'lucro' AND negativos > 0""")
def messages(spark, d):
    return rounded(rankings.customer_messages(cut_lineage(customers(spark, d)), METRICS))


PM = ["quantidade", "faturamento", "lucro"]


@check("product_rankings", f"""WITH {totals_sql('produto')}, {long_sql(PM)}, {RANKED}
SELECT concept, position, CAST(entity AS VARCHAR) AS product_id, {NAME} AS product, round(value, 4) AS value FROM ranked WHERE position <= 5""")
def product_rankings(spark, d):
    return rounded(rankings.product_rankings(products(spark, d), PM))


@check("loss_products", f"""WITH {totals_sql('produto')}
SELECT CAST(entity AS VARCHAR) AS entity_id, {NAME} AS entity, round(margem_bruta, 4) AS margem_bruta FROM ent WHERE margem_bruta < 0""")
def loss_products(spark, d):
    return rounded(rankings.negative_entities(products(spark, d, ("margem_bruta",)), "margem_bruta"))


@check("product_count", "SELECT count(DISTINCT l_partkey) AS entities FROM lineitem")
def product_count(spark, d):
    return rankings.entity_count(products(spark, d))


@check("growth_candidates", f"""WITH {totals_sql('produto')}
SELECT row_number() OVER (ORDER BY lucro DESC, entity) AS position, CAST(entity AS VARCHAR) AS product_id, {NAME} AS product,
       round(faturamento, 4) AS faturamento, round(lucro, 4) AS lucro FROM ent
WHERE lucro > (SELECT avg(lucro) FROM ent) AND faturamento < (SELECT avg(faturamento) FROM ent) QUALIFY position <= 5""")
def candidates(spark, d):
    return rounded(rankings.growth_candidates(products(spark, d)))


DIM_ROLES = {**{k: ROLES[k] for k in ("produto_id", "produto", "categoria", "regiao", "faturamento", "quantidade", "lucro")},
             "cidade_cliente": "Cidade", "canal_venda": "Canal", "tamanho_produto": "Tamanho"}
DIM_SQL = SALES.replace("r_name AS regiao", "r_name AS regiao, n_name AS cidade, l_returnflag AS canal, CAST(p_size AS VARCHAR) AS tamanho") + """,
fan AS (SELECT 'produto' AS dimension, CAST(produto_id AS VARCHAR) AS entity, produto AS label, faturamento, quantidade, lucro FROM sales
  UNION ALL SELECT 'categoria', categoria, NULL, faturamento, quantidade, lucro FROM sales
  UNION ALL SELECT 'regiao', regiao, NULL, faturamento, quantidade, lucro FROM sales
  UNION ALL SELECT 'cidade_cliente', cidade, NULL, faturamento, quantidade, lucro FROM sales
  UNION ALL SELECT 'canal_venda', canal, NULL, faturamento, quantidade, lucro FROM sales
  UNION ALL SELECT 'tamanho_produto', tamanho, NULL, faturamento, quantidade, lucro FROM sales),
dims AS (SELECT dimension, entity, min(label) AS label, sum(faturamento) AS faturamento, sum(quantidade) AS quantidade, sum(lucro) AS lucro
  FROM fan GROUP BY 1, 2)"""
DNAME = "CASE WHEN label IS NULL THEN entity ELSE label || ' (ID ' || entity || ')' END"


def dims(spark, d):
    li, o, c, p = (table(spark, d, t) for t in ("lineitem", "orders", "customer", "part"))
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    df = (li.join(o, F.expr("l_orderkey = o_orderkey")).join(c, F.expr("o_custkey = c_custkey"))
          .join(n, F.expr("c_nationkey = n_nationkey")).join(r, F.expr("n_regionkey = r_regionkey"))
          .join(p, F.expr("l_partkey = p_partkey")).select(
        F.col("l_partkey").alias("Produto_ID"), F.col("p_name").alias("Produto"), F.col("p_type").alias("Categoria"),
        F.col("r_name").alias("Regiao"), F.col("n_name").alias("Cidade"), F.col("l_returnflag").alias("Canal"),
        F.col("p_size").alias("Tamanho"), F.col("l_quantity").alias("Quantidade"), net.alias("Faturamento"),
        (net - F.col("l_quantity") * F.col("p_retailprice")).alias("Lucro")))
    return rankings.dimension_totals(df, DIM_ROLES)


@check("dimension_sizes", f"WITH {DIM_SQL} SELECT dimension, count(*) AS distinct_values FROM dims GROUP BY 1")
def dimension_sizes(spark, d):
    return rankings.dimension_sizes(dims(spark, d))


def _top(measure):
    return f"""WITH {DIM_SQL}
SELECT dimension, row_number() OVER (PARTITION BY dimension ORDER BY {measure} DESC, entity) AS position, entity AS value_id,
 {DNAME} AS value_label, round({measure}, 4) AS {measure},
 round({measure} / sum({measure}) OVER (PARTITION BY dimension) * 100, 6) AS share FROM dims QUALIFY position <= 5"""


def _round_share(df, measure):
    return rounded(df.withColumn("share", F.round("share", 6)).withColumn(measure, F.round(measure, 4)), 6)


@check("dimension_top_revenue", _top("faturamento"))
def dim_revenue(spark, d):
    return _round_share(rankings.dimension_top(dims(spark, d), "faturamento"), "faturamento")


@check("dimension_top_volume", _top("quantidade"))
def dim_volume(spark, d):
    return _round_share(rankings.dimension_top(dims(spark, d), "quantidade"), "quantidade")


@check("dimension_top_profit", _top("lucro"))
def dim_profit(spark, d):
    return _round_share(rankings.dimension_top(dims(spark, d), "lucro"), "lucro")


@check("dimension_unit_value", f"""WITH {DIM_SQL}, u AS (SELECT *, CASE WHEN quantidade > 0 THEN faturamento / quantidade ELSE 0 END AS v FROM dims)
SELECT dimension, row_number() OVER (PARTITION BY dimension ORDER BY v DESC, entity) AS position, entity AS value_id,
       {DNAME} AS value_label, round(v, 6) AS unit_value FROM u QUALIFY position <= 5""")
def dim_unit(spark, d):
    return rounded(rankings.dimension_unit_value(dims(spark, d)), 6)


@check("dimension_losses", f"""WITH {DIM_SQL}
SELECT dimension, entity AS value_id, {DNAME} AS value_label, round(lucro, 4) AS lucro FROM dims WHERE lucro < 0""")
def dim_losses(spark, d):
    return rounded(rankings.dimension_losses(dims(spark, d)))
