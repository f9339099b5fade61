"""Assisted mapping over orders written as an unnamed report."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.operators import mapping

from .common import check, rounded, table


def report(spark, d):
    k = F.col("o_orderkey")
    pay = F.element_at(F.array(*[F.lit(p) for p in ("Dinheiro", "PIX", "Credito 2x", "Debito", "Cheque")]), (k % 5 + 1).cast("int"))
    return table(spark, d, "orders").select(
        k.alias("coluna_1"), F.date_format("o_orderdate", "dd/MM/yyyy").alias("coluna_2"), F.col("o_totalprice").alias("coluna_3"),
        pay.alias("coluna_4"), F.col("o_orderpriority").alias("coluna_5"), (k % 40).alias("Quantidade"), F.concat(F.lit("c"), "o_custkey").alias("coluna_7"),
        F.lit(None).cast("string").alias("coluna_8"))


TYPES = {"coluna_1": "identificador_provavel", "coluna_2": "data", "coluna_3": "valor_monetario", "coluna_4": "categoria_pagamento",
         "coluna_5": "texto", "Quantidade": "valor_numerico", "coluna_7": "texto", "coluna_8": "vazio"}
STEP = """step AS (SELECT avg(CASE WHEN o_orderkey - p = 1 THEN 1.0 ELSE 0.0 END) AS s FROM (SELECT o_orderkey, lag(o_orderkey) OVER (ORDER BY o_orderkey) AS p FROM orders) WHERE p IS NOT NULL)"""
STRUCT = {
    "coluna_1": ("CASE WHEN (SELECT s FROM step) >= 0.35 THEN 'identificador_provavel' ELSE 'valor_numerico' END", "o_orderkey"),
    "coluna_2": ("'data'", "CAST(o_orderdate AS DATE)"), "coluna_3": ("'valor_monetario'", "o_totalprice"), "coluna_4": ("'categoria_pagamento'", "o_orderkey % 5"),
    "coluna_5": ("'texto'", "o_orderpriority"), "Quantidade": ("'valor_numerico'", "o_orderkey % 40"), "coluna_7": ("'texto'", "o_custkey")}


@check("structural_types", f"WITH {STEP} " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {r} AS role, 1.0 AS role_confidence, count(*) AS filled, count(DISTINCT {e}) AS cardinality FROM orders" for c, (r, e) in STRUCT.items())
    + " UNION ALL SELECT 'coluna_8', 'vazio', 0.0, 0, 0 FROM orders WHERE o_orderkey = (SELECT min(o_orderkey) FROM orders)")
def structural(spark, d):
    return rounded(mapping.structural_types(report(spark, d)).select("column", "role", "role_confidence", "filled", "cardinality"))


@check("consecutive_steps", f"WITH {STEP} SELECT 'o_orderkey' AS \"column\", round(s, 6) AS step_share FROM step")
def steps(spark, d):
    return rounded(mapping.step_shares(table(spark, d, "orders"), ["o_orderkey"], None), 6)


PROFILE = {"coluna_1": ("identificador", "provavel", True, 1.0), "coluna_2": ("data", "confirmado", False, 1.0), "coluna_3": (None, "desconhecido", True, 0.0),
           "coluna_4": ("forma_pagamento", "provavel", False, 1.0), "coluna_5": (None, "desconhecido", True, 0.1), "Quantidade": ("quantidade", "confirmado", False, 1.0),
           "coluna_7": (None, "desconhecido", True, 0.1)}


@check("column_profiles", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", {f"'{k}'" if k else 'NULL'} AS concept, '{s}' AS state, {str(r).lower()} AS required, count(*) >= greatest(3, floor(count(*) * 0.02)) AS relevant,
 round((1 - count({STRUCT[c][1]}) / count(*)) * 100, 2) AS null_percent FROM orders""" for c, (k, s, r, _) in PROFILE.items()))
def profiles(spark, d):
    p = mapping.profile_columns(report(spark, d).drop("coluna_8"))
    return rounded(p.select("column", "concept", "state", "required", "relevant", "null_percent"))


@check("masked_examples", """
SELECT 'coluna_1' AS "column", 'Identificadores preservados|Valores ocultados por privacidade' AS examples FROM region WHERE r_regionkey = 0
UNION ALL SELECT 'coluna_5', string_agg(p, '|' ORDER BY p) FROM (SELECT DISTINCT o_orderpriority AS p FROM orders ORDER BY p LIMIT 3)
UNION ALL SELECT 'coluna_7', CASE WHEN count(DISTINCT o_custkey) > 30 THEN 'Exemplo textual ocultado|Valores com alta cardinalidade|Conteúdo preservado' END FROM orders""")
def examples(spark, d):
    p = mapping.profile_columns(report(spark, d).select("coluna_1", "coluna_5", "coluna_7"))
    return p.select("column", F.array_join("examples", "|").alias("examples"))


@check("confirmation_needed", """SELECT 'whole' AS t, false AS ask, CAST(4 AS BIGINT) AS required_columns FROM region WHERE r_regionkey = 0
UNION ALL SELECT 'unnamed', count(*) > 0, 4 FROM orders""")
def confirmation(spark, d):
    r = report(spark, d)
    whole = mapping.needs_confirmation(mapping.profile_columns(r), True)
    unnamed = mapping.needs_confirmation(mapping.profile_columns(r.drop("Quantidade")), True)
    return whole.select(F.lit("whole").alias("t"), "ask", "required_columns").unionByName(unnamed.select(F.lit("unnamed").alias("t"), "ask", "required_columns"))


@check("mapping_errors", """SELECT c AS "column", k AS concept, e AS error FROM (VALUES ('coluna_7', NULL, 'missing'), ('coluna_9', 'cliente', 'unknown_column'),
 ('coluna_2', 'data', 'incompatible'), ('coluna_3', 'cliente', 'incompatible'), ('coluna_5', 'nada', 'unknown_concept')) t(c, k, e), (SELECT count(*) AS n FROM orders) WHERE n > 0""")
def errors(spark, d):
    chosen = {"coluna_9": "cliente", "coluna_2": "data", "coluna_3": "cliente", "coluna_5": "nada", "coluna_1": "pedido"}
    return mapping.mapping_errors(mapping.profile_columns(report(spark, d)), chosen)


@check("applied_mapping", """SELECT strftime(o_orderdate, '%Y-%m') AS period, count(DISTINCT o_orderkey) AS pedidos, round(sum(o_totalprice), 2) AS total,
 count(DISTINCT o_orderpriority) AS generica FROM orders GROUP BY 1""")
def applied(spark, d):
    out, _ = mapping.apply_mapping(report(spark, d), {"coluna_2": "data"}, {"coluna_1": "pedido", "coluna_3": "valor_total", "coluna_5": "outro", "coluna_7": "ignorar"})
    assert "coluna_7" not in out.columns
    return rounded(out.groupBy(F.date_format("Data", "yyyy-MM").alias("period")).agg(
        F.count_distinct("Pedido").alias("pedidos"), F.sum("Valor_Total").alias("total"), F.count_distinct("Dimensao_Generica_1").alias("generica")), 2)
