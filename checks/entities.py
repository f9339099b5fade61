"""Entity candidates, decisions and aliases."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.operators import entities, metrics, temporal
from ledgerlens.session import cut_lineage

from .common import check, once, rounded, table

VARIANT = """CASE l_linenumber WHEN 1 THEN upper(base) WHEN 2 THEN replace(base, ' ', '  ') WHEN 3 THEN replace(base, 'e', 'é')
 WHEN 4 THEN replace(base, 'small', 'smal') WHEN 5 THEN regexp_replace(base, 'widget|gadget', 'wigdet') ELSE base END"""
NAMES = f"""
typed AS (SELECT l_orderkey AS pedido, l_extendedprice AS valor, l_orderkey, l_linenumber, lower(p_name || ' ' || p_type || ' ' || p_brand) AS base FROM lineitem JOIN part ON l_partkey = p_partkey),
named AS (SELECT pedido, valor, {VARIANT} AS produto FROM typed),
labels AS (SELECT produto AS value, count(*) AS records, count(DISTINCT pedido) AS orders, sum(valor) AS metric_value,
  lower(translate(trim(regexp_replace(produto, '\\s+', ' ', 'g')), 'áàâãäåéèêëíìîïóòôõöúùûüçñýÿ', 'aaaaaaeeeeiiiiooooouuuucnyy')) AS key FROM named GROUP BY 1),
leads AS (SELECT key, min(value) AS lead, count(*) AS variants FROM labels GROUP BY 1)"""
ROLES = {"produto": "Produto", "pedido": "Pedido", "valor_total": "Valor_Total"}


def named(spark, d):
    base = F.lower(F.concat_ws(" ", "p_name", "p_type", "p_brand"))
    n = F.col("l_linenumber")
    name = (F.when(n == 1, F.upper(base)).when(n == 2, F.replace(base, F.lit(" "), F.lit("  "))).when(n == 3, F.translate(base, "e", "é"))
            .when(n == 4, F.replace(base, F.lit("small"), F.lit("smal"))).when(n == 5, F.regexp_replace(base, "widget|gadget", "wigdet")).otherwise(base))
    return table(spark, d, "lineitem").join(table(spark, d, "part"), F.expr("l_partkey = p_partkey")).select(
        name.alias("Produto"), F.col("l_orderkey").alias("Pedido"), F.col("l_extendedprice").alias("Valor_Total"), F.col("l_shipdate").alias("Data"))


def labels(spark, d):
    return entities.label_context(named(spark, d), "Produto", "Valor_Total", "Pedido")


@check("entity_labels", f"WITH {NAMES} SELECT value, key, records, orders, round(metric_value, 2) AS metric_value FROM labels")
def entity_labels(spark, d):
    return rounded(labels(spark, d).select("value", "key", "records", "orders", "metric_value"), 2)


EXACT = """exact AS (SELECT lead AS "left", value AS "right", trim(regexp_replace(lead, '\\s+', ' ', 'g')) AS a, trim(regexp_replace(value, '\\s+', ' ', 'g')) AS b
  FROM labels JOIN leads USING (key) WHERE variants > 1 AND value <> lead)"""


@check("exact_name_variants", f"""WITH {NAMES}, {EXACT}
SELECT "left", "right", concat_ws(',', CASE WHEN "left" <> a OR "right" <> b THEN 'diferenca_espacamento' END,
  CASE WHEN a <> b AND lower(a) = lower(b) THEN 'diferenca_caixa' END, CASE WHEN lower(a) <> lower(b) THEN 'diferenca_acentuacao' END) AS reasons FROM exact""")
def exact_variants(spark, d):
    return entities.exact_variant_pairs(labels(spark, d)).select("left", "right", F.concat_ws(",", "reasons").alias("reasons"))


BLOCKED = """
k AS (SELECT key, row_number() OVER (ORDER BY key COLLATE C) AS r, length(key) AS n, regexp_extract_all(key, '\\d+') AS dg, string_split(key, ' ') AS tk FROM leads WHERE length(key) >= 10),
g AS (SELECT *, tk[len(tk)] AS tail, list_sort(list_distinct(list_filter(list_transform(tk, lambda x: trim(x, '.,')), lambda x: list_contains(['mm', 'cm', 'm', 'km', 'g', 'kg', 'ml', 'l'], x)))) AS un FROM k),
blocked AS (SELECT a.key AS left_key, b.key AS right_key FROM g a JOIN g b ON b.r > a.r AND b.r <= a.r + 20 AND left(a.key, 3) = left(b.key, 3)
  WHERE abs(a.n - b.n) <= greatest(a.n, b.n) * 0.12 AND a.dg = b.dg AND a.un = b.un
  AND NOT ((a.tail IN ('ltda', 'me', 'sa', 'eireli') OR b.tail IN ('ltda', 'me', 'sa', 'eireli')) AND a.tail <> b.tail))""".replace(" COLLATE C", "")


@check("neighbour_pairs", f"WITH {NAMES}, {BLOCKED} SELECT left_key, right_key FROM blocked")
def neighbours(spark, d):
    keys = labels(spark, d).select("key").distinct().where(F.length("key") >= entities.MIN_LENGTH)
    return entities.neighbour_pairs(entities.ranked_keys(keys), chunk=256)


@check("blocking_statistics", f"""WITH {NAMES}, {BLOCKED}
SELECT (SELECT count(*) FROM labels) AS unique_entities, (SELECT CAST(floor(count(*) * (count(*) - 1) / 2) AS BIGINT) FROM labels) AS theoretical_pairs,
 CAST((SELECT sum(variants - 1) FROM leads) + (SELECT count(*) FROM blocked) AS BIGINT) AS blocked_pairs, (SELECT count(*) FROM blocked) AS fuzzy_comparisons,
 CAST((SELECT floor(count(*) * (count(*) - 1) / 2) FROM labels) - (SELECT sum(variants - 1) FROM leads) - (SELECT count(*) FROM blocked) AS BIGINT) AS pairs_left_out""")
def statistics(spark, d):
    return rounded(entities.blocking_statistics(labels(spark, d)))


SIMILAR = BLOCKED[:BLOCKED.index("blocked AS")].strip() + """
paired AS (SELECT a.key AS left_key, b.key AS right_key, 1 - levenshtein(a.key, b.key) / greatest(a.n, b.n)::DOUBLE AS similarity
  FROM g a JOIN g b ON a.dg = b.dg AND a.un = b.un AND a.key < b.key AND abs(a.n - b.n) <= greatest(a.n, b.n) * 0.12
  WHERE NOT ((a.tail IN ('ltda', 'me', 'sa', 'eireli') OR b.tail IN ('ltda', 'me', 'sa', 'eireli')) AND a.tail <> b.tail)),
alike AS (SELECT * FROM paired WHERE similarity >= 0.9)"""
FUZZY = f"""{SIMILAR},
fuzzy AS (SELECT x.lead AS "left", y.lead AS "right", similarity FROM alike JOIN leads x ON x.key = left_key JOIN leads y ON y.key = right_key)"""


@check("similarity_statistics", f"""WITH {NAMES}, {SIMILAR}, {BLOCKED[BLOCKED.index("blocked AS"):]}
SELECT (SELECT count(*) FROM k) AS names, (SELECT CAST(floor(count(*) * (count(*) - 1) / 2) AS BIGINT) FROM k) AS theoretical_pairs,
 (SELECT count(*) FROM alike) AS similar_pairs, (SELECT count(*) FROM alike ANTI JOIN blocked USING (left_key, right_key)) AS lost_by_neighbourhood""")
def similar(spark, d):
    return rounded(entities.similarity_statistics(labels(spark, d)))


@check("fuzzy_name_pairs", f"""WITH {NAMES}, {FUZZY} SELECT "left", "right", round(similarity, 4) AS similarity, 'grafia_muito_semelhante' AS reasons FROM fuzzy""")
def fuzzy(spark, d):
    return rounded(entities.fuzzy_pairs(labels(spark, d)).select("left", "right", "similarity", F.concat_ws(",", "reasons").alias("reasons")))


@once
def candidates(spark, d):
    return cut_lineage(entities.entity_candidates(named(spark, d), ROLES))


CAND = f"""{NAMES}, {EXACT}, {FUZZY},
every AS (SELECT "left", "right", 1.0 AS similarity, concat_ws(',', CASE WHEN "left" <> a OR "right" <> b THEN 'diferenca_espacamento' END,
  CASE WHEN a <> b AND lower(a) = lower(b) THEN 'diferenca_caixa' END, CASE WHEN lower(a) <> lower(b) THEN 'diferenca_acentuacao' END) AS reasons FROM exact
  UNION ALL SELECT "left", "right", similarity, 'grafia_muito_semelhante' FROM fuzzy),
cand AS (SELECT substr(sha256('[null, "produto", "Produto", ["' || least("left", "right") || '", "' || greatest("left", "right") || '"]]'), 1, 24) AS candidate_id, "left", "right",
  similarity, reasons, x.records AS left_records, y.records AS right_records, x.orders AS left_orders, y.orders AS right_orders, x.metric_value + y.metric_value AS combined_preview,
  CASE WHEN y.records > x.records THEN "right" ELSE "left" END AS recommended_value FROM every JOIN labels x ON x.value = "left" JOIN labels y ON y.value = "right")"""


@check("entity_candidates", f"""WITH {CAND} SELECT candidate_id, 'produto' AS entity_type, "left", "right", round(similarity, 2) AS similarity, reasons,
 CASE WHEN similarity >= 0.97 THEN 'alta' ELSE 'media' END AS confidence, 'pending' AS status FROM cand""")
def all_candidates(spark, d):
    return rounded(candidates(spark, d).select("candidate_id", "entity_type", "left", "right", "similarity", F.concat_ws(",", "reasons").alias("reasons"), "confidence", "status"))


@check("candidate_context", f"""WITH {CAND} SELECT candidate_id, "left", "right", left_records, right_records, left_orders, right_orders, round(combined_preview, 2) AS combined_preview, recommended_value FROM cand""")
def context(spark, d):
    return rounded(candidates(spark, d).select("candidate_id", "left", "right", "left_records", "right_records", "left_orders", "right_orders",
                                                     "combined_preview", "recommended_value"), 2)


DECIDE = f"""{CAND},
asked AS (SELECT min(candidate_id) AS candidate_id FROM cand GROUP BY "left"),
wanted AS (SELECT candidate_id, unnest(["left", "right"]) AS value FROM asked JOIN cand USING (candidate_id)),
one AS (SELECT candidate_id FROM wanted JOIN (SELECT value, min(candidate_id) AS f FROM wanted GROUP BY value) USING (value) GROUP BY candidate_id HAVING bool_and(f = candidate_id)),
stat AS (SELECT c.*, CASE WHEN o.candidate_id IS NOT NULL THEN 'merged' ELSE 'pending' END AS status FROM cand c LEFT JOIN one o ON o.candidate_id = c.candidate_id)"""


def decided(spark, d):
    """The first candidate of every lead value is to be merged; where two of them share a value, the first stands."""
    c = candidates(spark, d)
    first = c.groupBy("left").agg(F.min("candidate_id").alias("candidate_id"))
    return c, cut_lineage(entities.record_decisions(c, first.select("candidate_id", F.lit("merge").alias("decision"), F.lit(None).cast("string").alias("canonical_value"))))


@check("recorded_decisions", f"""WITH {DECIDE} SELECT candidate_id, status, CASE WHEN status = 'merged' THEN recommended_value END AS canonical_value FROM stat""")
def recorded(spark, d):
    return decided(spark, d)[1].select("candidate_id", "status", "canonical_value")


@check("decision_counts", f"""WITH {DECIDE} SELECT 'produto' AS entity_type, count(*) AS total, count(*) FILTER (WHERE status = 'pending') AS pending,
 count(*) FILTER (WHERE status = 'merged') AS merged, CAST(0 AS BIGINT) AS kept_separate FROM stat""")
def counts(spark, d):
    return entities.candidate_counts(decided(spark, d)[1])


@check("decision_errors", f"""WITH {DECIDE},
sides AS (SELECT candidate_id, status, unnest(["left", "right"]) AS value FROM stat),
taken AS (SELECT value, min(candidate_id) AS f FROM sides GROUP BY value UNION ALL SELECT value, candidate_id FROM sides WHERE status = 'merged'),
clash AS (SELECT DISTINCT candidate_id FROM sides JOIN taken USING (value) WHERE f <> candidate_id)
SELECT candidate_id, CASE WHEN status = 'merged' THEN 'Alterar uma decisão confirmada ainda não é suportado.' END AS error FROM stat
UNION ALL SELECT candidate_id, CASE WHEN status = 'pending' AND candidate_id IN (SELECT candidate_id FROM clash) THEN 'Uma variante já participa de outra união. Uniões sobrepostas não são suportadas nesta etapa.' END FROM stat
UNION ALL SELECT 'x' || candidate_id, 'O candidato não pertence a esta análise.' FROM stat UNION ALL SELECT candidate_id, 'Decisão inválida. Escolha unir ou manter separadas.' FROM stat
UNION ALL SELECT candidate_id, 'O label deve ser a variante recomendada deste candidato.' FROM stat""")
def errors(spark, d):
    _, c = decided(spark, d)
    none = F.lit(None).cast("string")
    ask = lambda ident, what, label=none: entities.validate_decisions(
        c, c.select(ident.alias("candidate_id"), F.lit(what).alias("decision"), label.alias("canonical_value"))).select("candidate_id", "error")
    ident = F.col("candidate_id")
    return (ask(ident, "keep_separate").unionByName(ask(ident, "merge")).unionByName(ask(F.concat(F.lit("x"), ident), "merge"))
            .unionByName(ask(ident, "join")).unionByName(ask(ident, "merge", F.lit("?"))))


ALIAS = f"""{DECIDE}, alias AS (SELECT DISTINCT value, recommended_value AS canon FROM (SELECT "left" AS value, recommended_value FROM stat WHERE status = 'merged'
  UNION ALL SELECT "right", recommended_value FROM stat WHERE status = 'merged') WHERE value <> recommended_value)"""


@check("applied_aliases", f"""WITH {ALIAS} SELECT coalesce(canon, produto) AS produto, count(*) AS n, round(sum(valor), 2) AS total FROM named LEFT JOIN alias ON produto = value GROUP BY 1""")
def applied(spark, d):
    _, c = decided(spark, d)
    out = entities.apply_aliases(named(spark, d), entities.alias_map(c), ["Produto"])
    return rounded(out.groupBy(F.col("Produto").alias("produto")).agg(F.count(F.lit(1)).alias("n"), F.sum("Valor_Total").alias("total")), 2)


@check("totals_unchanged_by_merge", """SELECT 'kpis' AS part, true AS unchanged, CAST(3 AS BIGINT) AS compared FROM region WHERE r_regionkey = 0
UNION ALL SELECT 'series', true, count(DISTINCT strftime(l_shipdate, '%Y-%m')) FROM lineitem""")
def invariant(spark, d):
    before = named(spark, d)
    _, c = decided(spark, d)
    after = entities.apply_aliases(before, entities.alias_map(c), ["Produto"])
    k = lambda df: metrics.kpis_long(metrics.kpis(df, {"valor_total": "Valor_Total", "pedido": "Pedido"}))
    s = lambda df: temporal.monthly_series(df, "Data", {"valor_total": "Valor_Total"}).select("period", "value", "records")
    return entities.unchanged(k(before), k(after), ["indicador"]).select(F.lit("kpis").alias("part"), "unchanged", "compared").unionByName(
        entities.unchanged(s(before), s(after), ["period"]).select(F.lit("series").alias("part"), "unchanged", "compared"))
