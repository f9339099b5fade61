"""Column roles, relationships, the star and its enrichment."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.operators import enrich, relate, roles

from .common import ROLES, check, rounded, sales, table


def values(rows) -> str:
    lit = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"
    return "VALUES " + ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)


WORDS = values([(r, i, k, a, w) for i, (r, k, a, ws) in enumerate(roles.CATALOGUE) for w in ws])
NUMERIC = "', '".join(roles.NUMERIC_ROLES)
KEYS = "', '".join(roles.KEY_ROLES)

COLUMNS = [("Pedido_ID", "pedido_id", "n"), ("Data", "data", "d"), ("Cliente_ID", "cliente_id", "n"), ("Cliente", "cliente", "t"),
           ("Produto_ID", "produto_id", "n"), ("Produto", "produto", "t"), ("Categoria", "categoria", "t"), ("Regiao", "regiao", "t"),
           ("Quantidade", "quantidade", "n"), ("Faturamento", "faturamento", "n"), ("Valor_Total", "valor_total", "n"),
           ("Valor_Com_Desconto", "valor_com_desconto", "n"), ("Custo", "custo", "n"), ("Lucro", "lucro", "n"),
           ("Margem_Bruta", "margem_bruta", "n")]
ROLE_SQL = f"""
cols(col, name, kind) AS ({values(COLUMNS)}), words(role, rule, kind2, agg, word) AS ({WORDS}),
u AS (SELECT count(DISTINCT l_orderkey) / count(*) AS share FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
sc AS (SELECT col, kind, role, rule, kind2, agg, max(CASE WHEN name = word THEN 80 WHEN contains(word, '_') AND contains(name, word) THEN 70
   WHEN list_contains(string_split(name, '_'), word) THEN 50 WHEN contains(name, word) THEN 20 ELSE 0 END) AS s FROM cols, words GROUP BY ALL),
tot AS (SELECT col, role, rule, kind2, agg, least(100, s + CASE WHEN kind = 'n' AND role IN ('{NUMERIC}') THEN 20 WHEN role = 'data' AND kind = 'd' THEN 20
   WHEN role IN ('pedido', 'venda_id') AND col = 'Pedido_ID' AND (SELECT share FROM u) >= 0.7 THEN 20 WHEN role IN ('{KEYS}') THEN 20
   WHEN kind = 't' THEN 10 ELSE 0 END) AS score FROM sc),
best AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY score DESC, rule) AS r FROM tot),
mapped AS (SELECT col, CASE WHEN score >= 50 THEN role ELSE 'desconhecido' END AS role, CASE WHEN score >= 50 THEN kind2 ELSE 'desconhecido' END AS role_kind,
   CASE WHEN score >= 50 THEN agg END AS aggregation, CAST(score AS BIGINT) AS confidence FROM best WHERE r = 1)"""


@check("column_roles", f'WITH {ROLE_SQL} SELECT col AS "column", role, role_kind, aggregation, confidence FROM mapped')
def column_roles(spark, d):
    m = roles.classify_columns(roles.column_frame({"vendas": sales(spark, d)}))
    return rounded(m.select("column", "role", "role_kind", "aggregation", "confidence"))


@check("columns_by_role", f"WITH {ROLE_SQL} SELECT role, arg_max(col, confidence) AS \"column\" FROM mapped WHERE role <> 'desconhecido' GROUP BY role")
def by_role(spark, d):
    m = roles.classify_columns(roles.column_frame({"vendas": sales(spark, d)}))
    return roles.columns_by_role(m).select("role", "column")


def tables(spark, d):
    li, p, s, o, c = (table(spark, d, t) for t in ("lineitem", "part", "supplier", "orders", "customer"))
    return {
        "Vendas": li.select(F.col("l_orderkey").alias("Pedido_ID"), F.col("l_partkey").alias("Produto_ID"),
                            F.col("l_suppkey").alias("Fornecedor_ID"), F.col("l_quantity").alias("Quantidade"),
                            F.col("l_extendedprice").alias("Receita"), "l_returnflag", "l_linestatus"),
        "Produtos": p.select(F.col("p_partkey").alias("Produto_ID"), F.col("p_name").alias("Nome"), F.col("p_type").alias("Categoria"),
                             F.col("p_retailprice").alias("Preco")),
        "Fornecedores": s.select(F.col("s_suppkey").alias("Fornecedor_ID"), F.col("s_name").alias("Nome"), F.col("s_acctbal").alias("Saldo")),
        "Pedidos": o.select(F.col("o_orderkey").alias("Pedido_ID"), F.col("o_custkey").alias("Cliente_ID"), F.col("o_orderdate").alias("Data")),
        "Clientes": c.select(F.col("c_custkey").alias("Cliente_ID"), F.col("c_name").alias("Nome"), F.col("c_mktsegment").alias("Segmento")),
        "Devolucoes": li.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("Produto_ID"), F.col("l_quantity").alias("Quantidade"),
                                                            F.col("l_linestatus").alias("Motivo")),
        "Avaliacoes": li.select(F.col("l_partkey").alias("Produto_ID"), F.col("l_linenumber").alias("Nota")),
        "Stock": p.select(F.col("p_partkey").alias("Produto_ID"), F.col("p_size").alias("Quantidade em stock"),
                          F.lit(10).alias("Nível Mínimo"), F.lit(45).alias("Nível Máximo"), (F.col("p_size") % 7).alias("Tempo Médio de Entrega (dias)")),
    }


CORE = ("Vendas", "Produtos", "Fornecedores", "Pedidos", "Clientes")


def core(spark, d):
    t = tables(spark, d)
    return {n: t[n] for n in CORE}


@check("key_columns", """
SELECT * FROM (VALUES ('Vendas', 'Pedido_ID', 'pedido'), ('Vendas', 'Produto_ID', 'produto'), ('Vendas', 'Fornecedor_ID', 'fornecedor'),
 ('Produtos', 'Produto_ID', 'produto'), ('Fornecedores', 'Fornecedor_ID', 'fornecedor'), ('Pedidos', 'Pedido_ID', 'pedido'),
 ('Pedidos', 'Cliente_ID', 'cliente'), ('Clientes', 'Cliente_ID', 'cliente')) t("table", "column", entity)""")
def key_columns(spark, d):
    return relate.key_columns(core(spark, d)).select("table", "column", "entity")


RATES = [("Vendas", "Pedido_ID", "lineitem", "l_orderkey"), ("Vendas", "Produto_ID", "lineitem", "l_partkey"),
         ("Vendas", "Fornecedor_ID", "lineitem", "l_suppkey"), ("Produtos", "Produto_ID", "part", "p_partkey"),
         ("Fornecedores", "Fornecedor_ID", "supplier", "s_suppkey"), ("Pedidos", "Pedido_ID", "orders", "o_orderkey"),
         ("Pedidos", "Cliente_ID", "orders", "o_custkey"), ("Clientes", "Cliente_ID", "customer", "c_custkey")]


@check("key_uniqueness", " UNION ALL ".join(
    f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", count({s}) AS filled, count(DISTINCT {s}) AS distinct_values, round(count(DISTINCT {s}) / count({s}), 4) AS rate FROM {f}"
    for t, c, f, s in RATES))
def uniqueness(spark, d):
    wanted: dict[str, list[str]] = {}
    for t, c, _, _ in RATES:
        wanted.setdefault(t, []).append(c)
    return relate.uniqueness(relate.key_values(core(spark, d), wanted))


def _pair(ta, ca, fa, sa, tb, cb, fb, sb, affinity, pk):
    rate = lambda f, s: f"(SELECT round(count(DISTINCT {s}) / count({s}), 4) FROM {f})"
    fk_t, fk_s, pk_t, pk_s = (fa, sa, fb, sb) if pk == "b" else (fb, sb, fa, sa)
    names = (tb, cb, ta, ca) if pk == "b" else (ta, ca, tb, cb)
    return f"""SELECT '{ta}' AS tabela_a, '{ca}' AS coluna_a, '{tb}' AS tabela_b, '{cb}' AS coluna_b, 'um_para_muitos' AS tipo_relacionamento,
 '{names[0]}' AS tabela_pk, '{names[1]}' AS coluna_pk, '{names[2]}' AS tabela_fk, '{names[3]}' AS coluna_fk,
 round((SELECT count(DISTINCT {fk_s}) FROM {fk_t} WHERE {fk_s} IN (SELECT {pk_s} FROM {pk_t})) / (SELECT count(DISTINCT {fk_s}) FROM {fk_t}) * 100, 2) AS cobertura,
 {affinity}.0 AS afinidade_pk, {rate(fa, sa)} AS unicidade_a, {rate(fb, sb)} AS unicidade_b"""


REL_SQL = "rel AS (SELECT *, round(least(100, 30 + cobertura * 0.4 + afinidade_pk * 0.3), 2) AS confianca FROM (" + " UNION ALL ".join([
    _pair("Vendas", "Produto_ID", "lineitem", "l_partkey", "Produtos", "Produto_ID", "part", "p_partkey", 100, "b"),
    _pair("Vendas", "Fornecedor_ID", "lineitem", "l_suppkey", "Fornecedores", "Fornecedor_ID", "supplier", "s_suppkey", 70, "b"),
    _pair("Vendas", "Pedido_ID", "lineitem", "l_orderkey", "Pedidos", "Pedido_ID", "orders", "o_orderkey", 100, "b"),
    _pair("Pedidos", "Cliente_ID", "orders", "o_custkey", "Clientes", "Cliente_ID", "customer", "c_custkey", 100, "b"),
]) + "))"


@check("relationships", f"WITH {REL_SQL} SELECT * FROM rel")
def relationships(spark, d):
    return relate.detect_relationships(core(spark, d))


@check("one_to_one_relationship", """
SELECT 'Cadastro' AS tabela_a, 'Ficha' AS tabela_b, 'um_para_um' AS tipo_relacionamento,
 round((SELECT count(*) FROM customer WHERE c_acctbal > 2000) / (SELECT count(*) FROM customer WHERE c_acctbal > 2000) * 100, 2) AS cobertura, 90.0 AS confianca
FROM region WHERE r_regionkey = 0""")
def one_to_one(spark, d):
    c = table(spark, d, "customer")
    t = {"Cadastro": c.select(F.col("c_custkey").alias("Cliente_ID"), "c_name"),
         "Ficha": c.where("c_acctbal > 2000").select(F.col("c_custkey").alias("ID_Cliente"), "c_acctbal")}
    return relate.detect_relationships(t).select("tabela_a", "tabela_b", "tipo_relacionamento", "cobertura", "confianca")


@check("key_coverage", """
SELECT 'Devolucoes' AS tabela_fk, round(count(DISTINCT l_partkey) / (SELECT count(DISTINCT l_partkey) FROM lineitem WHERE l_returnflag = 'R') * 100, 2) AS cobertura
FROM lineitem WHERE l_returnflag = 'R' AND l_partkey IN (SELECT p_partkey FROM part)""")
def coverage(spark, d):
    t = tables(spark, d)
    return relate.detect_relationships({n: t[n] for n in ("Devolucoes", "Produtos")}).select("tabela_fk", "cobertura")


@check("fact_choice", """
SELECT 'Vendas' AS "table", count(*) + 3 * 10000 + 20000 AS score FROM lineitem UNION ALL SELECT 'Produtos', count(*) FROM part
UNION ALL SELECT 'Fornecedores', count(*) FROM supplier UNION ALL SELECT 'Pedidos', count(*) + 10000 FROM orders UNION ALL SELECT 'Clientes', count(*) FROM customer""")
def fact_choice(spark, d):
    t = core(spark, d)
    return relate.fact_scores(relate.table_sizes(t), relate.detect_relationships(t)).select("table", "score")


@check("dimension_choice", f"""WITH {REL_SQL}
SELECT coluna_fk, tabela_pk, coluna_pk, cobertura, confianca, confianca + 50 - CASE WHEN tabela_pk = 'Pedidos' THEN 100 ELSE 0 END AS score,
       tabela_pk = 'Pedidos' AS transactional FROM rel WHERE tabela_fk = 'Vendas'""")
def dimension_choice(spark, d):
    return relate.dimension_candidates(relate.detect_relationships(core(spark, d)), "Vendas")


@check("unique_key", """SELECT 'Produtos' AS t, count(p_partkey) = count(DISTINCT p_partkey) AS is_key FROM part
UNION ALL SELECT 'Vendas', count(l_orderkey) = count(DISTINCT l_orderkey) FROM lineitem""")
def unique_key(spark, d):
    t = core(spark, d)
    return relate.unique_key(t["Produtos"], "Produto_ID").select(F.lit("Produtos").alias("t"), "is_key").unionByName(
        relate.unique_key(t["Vendas"], "Pedido_ID").select(F.lit("Vendas").alias("t"), "is_key"))


@check("star_dataset", """
SELECT p_type AS categoria, s_suppkey % 10 AS fornecedor, count(*) AS n, round(sum(l_extendedprice), 2) AS receita, round(sum(s_acctbal), 2) AS saldo
FROM lineitem LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2""")
def star_dataset(spark, d):
    t = core(spark, d)
    star = relate.build_star(t, relate.detect_relationships(t))
    return rounded(star.frame.groupBy(F.col("Produtos__Categoria").alias("categoria"), (F.col("Fornecedor_ID") % 10).alias("fornecedor")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("Receita").alias("receita"), F.sum("Fornecedores__Saldo").alias("saldo")), 2)


@check("star_log", f"""WITH {REL_SQL}
SELECT CASE WHEN tabela_pk = 'Pedidos' THEN 'ignorado' ELSE 'sucesso' END AS status, 'Vendas' AS tabela_base, tabela_pk AS tabela_adicionada, coluna_fk, coluna_pk,
 confianca + 50 - CASE WHEN tabela_pk = 'Pedidos' THEN 100 ELSE 0 END AS score_dimensao,
 CAST(CASE tabela_pk WHEN 'Produtos' THEN 3 WHEN 'Fornecedores' THEN 2 ELSE 0 END AS BIGINT) AS colunas_adicionadas,
 CASE WHEN tabela_pk = 'Pedidos' THEN 'Tabela classificada como transacional/auxiliar.' END AS motivo FROM rel WHERE tabela_fk = 'Vendas'""")
def star_log(spark, d):
    t = core(spark, d)
    return rounded(relate.build_star(t, relate.detect_relationships(t)).log_frame())


def sides(spark, d):
    t = tables(spark, d)
    return t["Vendas"], {n: t[n] for n in ("Devolucoes", "Avaliacoes", "Stock")}


@check("ids_present_in_base", """SELECT count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size <= 10)""")
def known_ids(spark, d):
    small = table(spark, d, "part").where("p_size <= 10")
    kept = enrich.only_known(table(spark, d, "lineitem"), "l_partkey", small, "p_partkey")
    return rounded(kept.agg(F.count(F.lit(1)).alias("n"), F.sum("l_extendedprice").alias("total")), 2)


@check("rating_enrichment", """
WITH r AS (SELECT l_partkey AS p, avg(l_linenumber) AS m, count(*) AS n FROM lineitem WHERE l_linenumber IS NOT NULL GROUP BY 1)
SELECT l_returnflag AS flag, count(*) AS n, round(sum(CAST(round(CAST(m AS DECIMAL(18, 10)), 2) AS DOUBLE)), 2) AS media, sum(r.n)::BIGINT AS avaliacoes FROM lineitem LEFT JOIN r ON l_partkey = p GROUP BY 1""")
def ratings(spark, d):
    base, side = sides(spark, d)
    out = enrich.add_ratings(enrich.Enriched(base), side).frame
    return rounded(out.groupBy(F.col("l_returnflag").alias("flag")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("Avaliacao_Media").alias("media"), F.sum("Quantidade_Avaliacoes").alias("avaliacoes")), 2)


@check("stock_enrichment", """
SELECT l_returnflag AS flag, count(*) AS n, round(sum(p_size), 2) AS atual, count(*) FILTER (WHERE p_size <= 10) AS risco,
 count(*) FILTER (WHERE p_size >= 45) AS excesso, round(sum(p_size % 7), 2) AS prazo FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def stock(spark, d):
    base, side = sides(spark, d)
    out = enrich.add_stock(enrich.Enriched(base), side).frame
    return rounded(out.groupBy(F.col("l_returnflag").alias("flag")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("Estoque_Atual").alias("atual"), F.count_if("Risco_Ruptura").alias("risco"),
        F.count_if("Estoque_Excessivo").alias("excesso"), F.sum("Tempo_Medio_Entrega_Dias").alias("prazo")), 2)


@check("latest_stock_level", """
SELECT l_partkey AS produto, round(arg_max(l_quantity, k), 4) AS atual, round(arg_max(l_tax, k), 4) AS minimo, arg_max(l_quantity, k) <= arg_max(l_tax, k) AS risco,
       round(avg(l_linenumber), 6) AS prazo
FROM (SELECT *, CAST(epoch(l_shipdate) AS HUGEINT) * 100000000 + CAST(l_extendedprice * 100 AS BIGINT) AS k FROM lineitem) GROUP BY 1""")
def latest_stock(spark, d):
    li = table(spark, d, "lineitem").withColumn("k", F.struct("l_shipdate", "l_extendedprice"))
    out = enrich.stock_summary(li, "l_partkey", "l_quantity", "l_tax", None, "l_linenumber", "k")
    return rounded(out.select(F.col("_p").alias("produto"), F.col("Estoque_Atual").alias("atual"), F.col("Estoque_Minimo").alias("minimo"),
                              F.col("Risco_Ruptura").alias("risco"), F.col("Tempo_Medio_Entrega_Dias").alias("prazo")), 6)


RETURNS_SQL = """
ret AS (SELECT l_partkey AS p, sum(l_quantity) AS q, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
why AS (SELECT p, arg_min(m, (-c) * 1000 + ascii(m)) AS m FROM (SELECT l_partkey AS p, l_linestatus AS m, count(*) AS c FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2) GROUP BY p),
sold AS (SELECT l_partkey AS p, sum(l_quantity) AS s FROM lineitem GROUP BY 1)"""


@check("return_enrichment", f"""WITH {RETURNS_SQL}
SELECT sold.p AS produto, coalesce(q, 0) AS devolvida, coalesce(n, 0) AS devolucoes, m AS motivo, round(CASE WHEN s > 0 THEN coalesce(q, 0) / s * 100 ELSE 0 END, 2) AS taxa
FROM sold LEFT JOIN ret ON sold.p = ret.p LEFT JOIN why ON sold.p = why.p""")
def returns(spark, d):
    base, side = sides(spark, d)
    out = enrich.add_returns(enrich.Enriched(base), side).frame
    return rounded(out.select(F.col("Produto_ID").alias("produto"), F.col("Quantidade_Devolvida").alias("devolvida"),
                              F.col("Numero_Devolucoes").alias("devolucoes"), F.col("Principal_Motivo_Devolucao").alias("motivo"),
                              F.col("Taxa_Devolucao").alias("taxa")).distinct())


@check("enrichment_chain", """
SELECT count(*) AS n, sum((SELECT count(*) FROM region))::BIGINT AS k FROM lineitem""")
def chain(spark, d):
    base, side = sides(spark, d)
    done = enrich.enrich(base, side)
    assert [s for _, s, _ in done.log] == ["sucesso"] * 3, done.log
    regions = table(spark, d, "region").agg(F.count(F.lit(1))).scalar()
    full = done.frame.where("Avaliacao_Media is not null and Estoque_Atual is not null and Taxa_Devolucao is not null")
    return full.agg(F.count(F.lit(1)).alias("n")).select("n", (F.col("n") * regions).alias("k"))


@check("enrichment_with_broken_table", """SELECT 'avaliacoes' AS modulo, 'sucesso' AS status, count(*) AS "rows", count(*) AS rated, count(*) AS stocked FROM lineitem
UNION ALL SELECT 'stock', 'sucesso', count(*), count(*), count(*) FROM lineitem UNION ALL SELECT 'devolucoes', 'erro', count(*), count(*), count(*) FROM lineitem""")
def broken_chain(spark, d):
    """A value of the returns can't be read when they are; the other two modules are there all the same."""
    base, side = sides(spark, d)
    returns = side["Devolucoes"]
    bad = returns.select(*[F.when(F.monotonically_increasing_id() >= 0, F.raise_error(F.lit("unreadable"))).otherwise(F.col(c)).alias(c) if c == returns.columns[-1] else F.col(c) for c in returns.columns])
    done = enrich.enrich(base, {**side, "Devolucoes": bad})
    counts = done.frame.agg(F.count(F.lit(1)).alias("rows"), F.count("Avaliacao_Media").alias("rated"), F.count("Estoque_Atual").alias("stocked"))
    return done.log_frame().select("modulo", "status").join(counts, F.lit(True))


LABELS = ["Pedido ID", "Data da Venda", "Valor Bruto", "Valor c/ Desconto", "Valor Líquido", "Total", "Margem Bruta %", "Meio de Pagamento", "Cliente"]


@check("header_concepts", f"""
WITH l(label, concept) AS (VALUES ('Pedido ID', 'pedido'), ('Data da Venda', 'data'), ('Valor Bruto', 'valor_total'), ('Valor c/ Desconto', 'valor_com_desconto'),
 ('Valor Líquido', NULL), ('Total', NULL), ('Margem Bruta %', 'margem_bruta_percentual'), ('Meio de Pagamento', 'forma_pagamento'), ('Cliente', 'cliente'))
SELECT label, concept, count(*) AS n FROM l, customer GROUP BY 1, 2""")
def header_concepts(spark, d):
    n = table(spark, d, "customer").select(F.explode(F.array(*[F.lit(x) for x in LABELS])).alias("label"), F.col("c_custkey").alias("g"))
    return roles.concept_of_label(n, "label", "g").groupBy("label", "concept").agg(F.count(F.lit(1)).alias("n"))
