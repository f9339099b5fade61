"""Profiles, inference, coherence, cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.functions.dates import parse_date_text
from ledgerlens.functions.numeric import exact_medians
from ledgerlens.operators import clean, quality

from .common import SALES, check, rounded, sales, table

RAW_COLS = {
    "Pedido_Cod": "'P' || o_orderkey",
    "Data": "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE strftime(o_orderdate, '%d/%m/%Y') END",
    "Valor": "CASE WHEN o_orderkey % 7 = 0 THEN 'R$ ' || replace(printf('%.2f', o_totalprice), '.', ',') WHEN o_orderkey % 50 = 1 THEN 'n/d' ELSE printf('%.2f', o_totalprice) END",
    "Misto": "CASE WHEN o_orderkey % 2 = 0 THEN printf('%.2f', o_totalprice) ELSE o_orderpriority END",
    "Prioridade": "o_orderpriority",
    "Ano": "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(year(o_orderdate) AS INTEGER) END",
}
RAW = "raw AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in RAW_COLS.items()) + " FROM orders)"


def raw(spark, d):
    """Orders written the way people type them: marked numbers, day-first dates, gaps."""
    k = F.col("o_orderkey")
    plain = F.format_string("%.2f", "o_totalprice")
    return table(spark, d, "orders").select(
        F.concat(F.lit("P"), k).alias("Pedido_Cod"),
        F.when(k % 11 != 0, F.date_format("o_orderdate", "dd/MM/yyyy")).alias("Data"),
        F.when(k % 7 == 0, F.concat(F.lit("R$ "), F.translate(plain, ".", ","))).when(k % 50 == 1, F.lit("n/d")).otherwise(plain).alias("Valor"),
        F.when(k % 2 == 0, plain).otherwise(F.col("o_orderpriority")).alias("Misto"),
        F.col("o_orderpriority").alias("Prioridade"),
        F.when(k % 3 != 0, F.year("o_orderdate")).alias("Ano"))


@check("column_kinds", """
SELECT column_name AS "column", CAST(ordinal_position - 1 AS BIGINT) AS position,
  CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' ELSE 'timestamp' END AS dtype,
  CASE WHEN data_type IN ('BIGINT', 'INTEGER', 'DOUBLE') THEN 'numeric' WHEN data_type = 'VARCHAR' THEN 'text' ELSE 'date' END AS kind
FROM (SELECT row_number() OVER () AS ordinal_position, column_name, column_type AS data_type FROM (DESCRIBE SELECT * FROM lineitem))""")
def kinds(spark, d):
    return rounded(quality.column_kinds(table(spark, d, "lineitem")).replace({"timestamp_ntz": "timestamp"}, subset=["dtype"]))


@check("null_profile", f"""WITH {RAW}, c AS (SELECT count(*) AS n, {', '.join(f'count({c}) AS {c}' for c in RAW_COLS)} FROM raw)
{' UNION ALL '.join(f'''SELECT '{c}' AS "column", n AS "rows", n - {c} AS nulls, round((n - {c}) / n * 100, 6) AS null_percent FROM c''' for c in RAW_COLS)}""")
def profile(spark, d):
    return rounded(quality.null_profile(raw(spark, d)).select("column", "rows", "nulls", "null_percent"), 6)


@check("duplicate_rows", """
SELECT (SELECT count(*) FROM (SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_returnflag = 'R')) - (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem)) AS duplicates""")
def duplicates(spark, d):
    """Whole rows, those of returned items twice."""
    li = table(spark, d, "lineitem")
    return quality.duplicate_rows(li.unionAll(li.where("l_returnflag = 'R'")))


@check("value_frequencies", """
SELECT 'l_returnflag' AS "column", l_returnflag AS value, count(*) AS n FROM lineitem GROUP BY 2
UNION ALL SELECT 'l_linestatus', l_linestatus, count(*) FROM lineitem GROUP BY 2
UNION ALL SELECT 'l_partkey', CAST(l_partkey AS VARCHAR), count(*) FROM lineitem GROUP BY 2""")
def frequencies(spark, d):
    return quality.value_frequencies(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus", "l_partkey"])


NUM = "try_cast(replace(replace(replace(regexp_replace({0}, 'R\\$|%| ', '', 'g'), ',', '.'), '', ''), ' ', '') AS DOUBLE)"
INFER = f"""{RAW}, s AS (SELECT count(*) AS n, count(Data) AS nd, count(Valor) AS nv, count(Misto) AS nm,
  count({NUM.format('Valor')}) AS pv, count({NUM.format('Misto')}) AS pm FROM raw)"""


@check("infer_types", f"""WITH {INFER}
SELECT 'Pedido_Cod' AS "column", 'identificador' AS suggested, 100.0 AS confidence FROM s
UNION ALL SELECT 'Data', 'datetime', 100.0 FROM s
UNION ALL SELECT 'Valor', 'numerico', round(pv / nv * 100, 2) FROM s WHERE pv / nv >= 0.8
UNION ALL SELECT 'Misto', CASE WHEN pm / nm >= 0.8 THEN 'numerico' END, CASE WHEN pm / nm >= 0.8 THEN round(pm / nm * 100, 2) END FROM s
UNION ALL SELECT 'Prioridade', NULL, NULL FROM s
UNION ALL SELECT 'Ano', NULL, NULL FROM s""")
def infer(spark, d):
    return rounded(quality.infer_types(raw(spark, d)).select("column", "suggested", "confidence"), 2)


#: The same date in a notation that depends on the order; the month comes first only where the day can't be one.
NOTATIONS = ("yyyy-MM-dd", "dd/MM/yyyy", "d.M.yy", "d MMM yyyy", "MMMM d, yyyy", "yyyyMMdd", "dd-MM-yyyy HH:mm", "M/d/yyyy h:mm a", "yyyy/M/d'T'HH:mm:ss")


def mixed(spark, d):
    kind = F.col("o_orderkey") % len(NOTATIONS)
    late = F.col("o_orderdate") + F.expr("INTERVAL 13 HOURS 5 MINUTES")
    written = F.lit(None).cast("string")
    for i, layout in enumerate(NOTATIONS):
        day = layout.replace("M/d/yyyy", "d/M/yyyy") if layout.startswith("M/") else layout
        text = F.when(F.dayofmonth("o_orderdate") > 12, F.date_format(late, layout)).otherwise(F.date_format(late, day))
        written = F.when(kind == i, text).otherwise(written)
    return table(spark, d, "orders").select(kind.alias("notation"), written.alias("Data_Emissao"), "o_orderpriority")


@check("mixed_dates", f"""SELECT o_orderkey % {len(NOTATIONS)} AS notation, count(*) AS n, count(*) AS dates, CAST(sum(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE))) AS BIGINT) AS days,
 CAST(sum(CASE WHEN o_orderkey % {len(NOTATIONS)} IN (6, 7, 8) THEN 13 * 60 + 5 ELSE 0 END) AS BIGINT) AS minutes FROM orders GROUP BY 1""")
def mixed_dates(spark, d):
    read = parse_date_text(F.col("Data_Emissao"))
    return mixed(spark, d).withColumn("t", read).groupBy("notation").agg(
        F.count(F.lit(1)).alias("n"), F.count("t").alias("dates"), F.sum(F.datediff("t", F.lit("1970-01-01"))).alias("days"),
        F.sum(F.hour("t") * 60 + F.minute("t")).cast("bigint").alias("minutes"))


@check("mixed_date_column", """SELECT 'Data_Emissao' AS "column", 'datetime' AS suggested, 100.0 AS confidence, count(*) AS converted, strftime(min(o_orderdate), '%Y-%m-%d') AS first_date,
 strftime(max(o_orderdate), '%Y-%m-%d') AS last_date FROM orders""")
def mixed_column(spark, d):
    """Inferred as a date column and converted without loss."""
    m = mixed(spark, d).drop("notation")
    kinds = quality.infer_types(m).where("suggested is not null")
    out, _ = clean.run_etl(m, kinds)
    dates = out.agg(F.count("Data_Emissao").alias("converted"), F.date_format(F.min("Data_Emissao"), "yyyy-MM-dd").alias("first_date"), F.date_format(F.max("Data_Emissao"), "yyyy-MM-dd").alias("last_date"))
    return kinds.select("column", "suggested", "confidence").join(dates, F.lit(True))


@check("quality_issues", f"""WITH {INFER}, c AS (SELECT count(*) - count(Data) AS d, count(*) - count(Ano) AS a, count(*) AS n,
  (SELECT count(*) FROM raw WHERE Prioridade = '1-URGENT') AS dup FROM raw)
SELECT 'duplicidade' AS kind, NULL AS "column", 'media' AS level, dup || ' linhas duplicadas encontradas.' AS message FROM c
UNION ALL SELECT 'valor_nulo', 'Data', 'baixa', 'A coluna ''Data'' possui ' || d || ' valores nulos (' || round(d / n * 100, 2) || '%).' FROM c
UNION ALL SELECT 'valor_nulo', 'Ano', 'baixa', 'A coluna ''Ano'' possui ' || a || ' valores nulos (' || round(a / n * 100, 2) || '%).' FROM c
UNION ALL SELECT 'tipo_incorreto', 'Data', 'media', 'A coluna ''Data'' está como string, mas parece ser datetime com confiança de 100.0%.' FROM c
UNION ALL SELECT 'tipo_incorreto', 'Valor', 'media', 'A coluna ''Valor'' está como string, mas parece ser numérica com confiança de ' || round(pv / nv * 100, 2) || '%.' FROM s""")
def issue_rows(spark, d):
    """Duplicates are those of whole rows, the urgent orders being there twice."""
    r = raw(spark, d)
    return quality.issues(quality.null_profile(r), quality.infer_types(r), quality.duplicate_rows(r.unionAll(r.where("Prioridade = '1-URGENT'"))))


@check("quality_score", f"""WITH {RAW}, c AS (SELECT count(*) AS n, sum(({' + '.join(f'CASE WHEN {c} IS NULL THEN 1 ELSE 0 END' for c in RAW_COLS)})) AS nulls,
  count(*) - count(DISTINCT (Pedido_Cod)) AS dup FROM raw), p AS (SELECT *, nulls / (n * 6) * 100 AS np FROM c),
z AS (SELECT *, 100 - (least(30, np) + least(20, dup / n * 100) + 10) AS score FROM p)
SELECT n AS "rows", CAST(6 AS BIGINT) AS columns, CAST(nulls AS BIGINT) AS total_nulls, dup AS duplicates, round(np, 6) AS null_percent,
       CAST(4 AS BIGINT) AS issues, round(score, 6) AS score,
       CASE WHEN score >= 90 THEN 'excelente' WHEN score >= 75 THEN 'boa' WHEN score >= 50 THEN 'atencao' ELSE 'critica' END AS grade FROM z""")
def score(spark, d):
    r = raw(spark, d)
    p, dup = quality.null_profile(r), quality.duplicate_rows(r)
    return rounded(quality.quality_score(p, dup, quality.issues(p, quality.infer_types(r), dup)), 6)


AUDIT = f"""{SALES}, a AS (SELECT *, CASE WHEN pedido % 5 = 0 THEN NULL ELSE custo END AS c2, CASE WHEN pedido % 3 = 0 THEN lucro + quantidade ELSE lucro END AS l2 FROM sales),
m AS (SELECT *, faturamento - c2 - l2 AS residual, abs(faturamento - c2 - l2) AS err FROM a)"""


def audited(spark, d):
    return sales(spark, d).select(
        "Pedido_ID", "Faturamento",
        F.when(F.col("Pedido_ID") % 5 != 0, F.col("Custo")).alias("Custo"),
        F.when(F.col("Pedido_ID") % 3 == 0, F.col("Lucro") + F.col("Quantidade")).otherwise(F.col("Lucro")).alias("Lucro"))


AUDIT_ROLES = {"faturamento": "Faturamento", "custo": "Custo", "lucro": "Lucro"}


@check("coherence_audit", f"""WITH {AUDIT}
SELECT count(faturamento) AS faturamento_valid, count(c2) AS custo_valid, count(l2) AS lucro_valid,
 count(*) - count(c2) AS custo_nulls, round(sum(c2), 2) AS custo_sum, count(residual) AS complete_rows,
 count(*) FILTER (WHERE err <= 0.01) AS reconciled_rows, round(sum(residual), 2) AS residual_total, round(avg(err), 6) AS mean_abs_error,
 round(count(*) FILTER (WHERE err <= 0.01) / count(residual) * 100, 6) AS reconciled_percent,
 CASE WHEN count(*) FILTER (WHERE err <= 0.01) / count(residual) < 0.5 THEN 'inconsistente' ELSE 'coerente' END AS status,
 round(median(err), 6) AS median_abs_error, round(median(residual), 6) + 0 AS median_residual FROM m""")
def audit(spark, d):
    out = quality.coherence_audit(audited(spark, d), AUDIT_ROLES).select(
        "faturamento_valid", "custo_valid", "lucro_valid", "custo_nulls", "custo_sum", "complete_rows", "reconciled_rows",
        "residual_total", "mean_abs_error", "reconciled_percent", "status", "median_abs_error", "median_residual")
    return rounded(out.withColumn("custo_sum", F.round("custo_sum", 2)).withColumn("residual_total", F.round("residual_total", 2)), 6)


@check("coherence_examples", f"""WITH {AUDIT}
SELECT pedido AS key_1, round(faturamento, 4) AS faturamento, round(c2, 4) AS custo, round(l2, 4) AS lucro, round(residual, 4) + 0 AS residual
FROM m WHERE residual IS NOT NULL ORDER BY pedido, faturamento LIMIT 5""")
def examples(spark, d):
    return rounded(quality.coherence_examples(audited(spark, d), AUDIT_ROLES, ["Pedido_ID", "Faturamento"]).select(
        "key_1", "faturamento", "custo", "lucro", "residual"))


@check("exact_medians", """SELECT round(median(l_extendedprice * (1 - l_discount)), 6) AS net, round(median(l_quantity), 6) AS quantity,
 round(median(l_tax - 0.04), 6) + 0 AS signed FROM lineitem""")
def median(spark, d):
    li = table(spark, d, "lineitem").select(
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"), F.col("l_quantity").alias("quantity"),
        (F.col("l_tax") - 0.04).alias("signed"))
    return rounded(exact_medians(li, ["net", "quantity", "signed"]), 6)


@check("quality_report", f"""WITH {AUDIT}, r AS (SELECT count(*) FILTER (WHERE err <= 0.01) / count(residual) * 100 AS p FROM m),
 n AS (SELECT count(*) FILTER (WHERE c2 IS NULL) AS k, count(*) AS n FROM m), w AS (SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT faturamento, c2, l2 FROM m)) AS dup FROM m)
SELECT 'valor_nulo' AS kind, 'Custo' AS "column", 'baixa' AS level, 'A coluna ''Custo'' possui ' || k || ' valores nulos (' || round(k / n * 100, 2) || '%).' AS message FROM n
UNION ALL SELECT 'incoerencia_metricas_financeiras', NULL, 'media', 'Faturamento, Custo e Lucro não reconciliam na maior parte dos registros (' || round(p, 2) || '% conciliados; tolerância de R$ 0.01). Os valores originais foram preservados.' FROM r WHERE p < 50
UNION ALL SELECT 'duplicidade', NULL, 'media', dup || ' linhas duplicadas encontradas.' FROM w WHERE dup > 0""")
def report(spark, d):
    a = audited(spark, d).drop("Pedido_ID")
    issues = quality.issues(quality.null_profile(a), quality.infer_types(a), quality.duplicate_rows(a))
    return quality.quality_report(issues, quality.coherence_audit(a, AUDIT_ROLES))


@check("clean_conversions", f"""WITH {RAW}, c AS (SELECT {NUM.format('Valor')} AS v, strptime(Data, '%d/%m/%Y') AS dt, Misto, Ano FROM raw)
SELECT count(v) AS numbers, round(sum(v), 2) AS total, count(dt) AS dates, strftime(min(dt), '%Y-%m-%d') AS first_date,
  strftime(max(dt), '%Y-%m-%d') AS last_date, count(Misto) AS kept_text, count(coalesce(Ano, year(dt))) AS years, sum(coalesce(Ano, year(dt)))::BIGINT AS year_sum FROM c""")
def conversions(spark, d):
    r = raw(spark, d)
    out, _ = clean.run_etl(r, quality.infer_types(r))
    return rounded(out.agg(
        F.count("Valor").alias("numbers"), F.sum("Valor").alias("total"), F.count("Data").alias("dates"),
        F.date_format(F.min("Data"), "yyyy-MM-dd").alias("first_date"), F.date_format(F.max("Data"), "yyyy-MM-dd").alias("last_date"),
        F.count("Misto").alias("kept_text"), F.count("Ano").alias("years"), F.sum("Ano").alias("year_sum")), 2)


@check("clean_log", f"""WITH {INFER}, k AS (SELECT count(*) FILTER (WHERE Ano IS NULL) AS a, count(*) FILTER (WHERE Ano IS NULL AND Data IS NOT NULL) AS f,
  count(*) FILTER (WHERE Data IS NULL) AS dn FROM raw)
SELECT 'Valor' AS coluna, CASE WHEN pv = nv THEN 'conversao_numerica' ELSE 'conversao_numerica_parcial' END AS tipo_transformacao, 'string' AS antes, 'double' AS depois,
 'Conversão realizada com ' || printf('%.2f', pv / nv * 100) || '% de confiança; ' || (nv - pv) || ' valores não numéricos ficaram nulos no dataset analítico. Os dados originais permanecem preservados.' AS detalhes FROM s
UNION ALL SELECT 'Data', 'conversao_data', 'string', 'timestamp', 'Conversão realizada com sucesso.' FROM s
UNION ALL SELECT 'Ano', 'preenchimento_nulo', a || ' nulos', (a - f) || ' nulos', f || ' valores preenchidos a partir da coluna Data.' FROM k
UNION ALL SELECT 'Data', 'nulo_nao_tratado', dn || ' nulos', dn || ' nulos', 'Não existe informação confiável para reconstruir a data.' FROM k
UNION ALL SELECT 'Ano', 'nulo_nao_tratado', (a - f) || ' nulos', (a - f) || ' nulos', 'Não foi possível preencher porque a Data também está ausente.' FROM k""")
def clean_log(spark, d):
    r = raw(spark, d)
    return clean.run_etl(r, quality.infer_types(r))[1]


@check("clean_guards", f"""WITH {RAW}, c AS (SELECT count(Misto) AS n, count({NUM.format('Misto')}) AS p FROM raw)
SELECT 'Misto' AS coluna, 'conversao_numerica_cancelada' AS tipo_transformacao, 'string' AS antes, 'string' AS depois,
 'Conversão cancelada: somente ' || printf('%.2f', p / n * 100) || '% dos valores não nulos puderam ser interpretados como números; ' || (n - p) || ' valores foram preservados sem conversão.' AS detalhes FROM c
UNION ALL SELECT 'Prioridade', 'conversao_data_cancelada', 'string', 'string', 'A conversão geraria ' || n || ' novos valores nulos.' FROM c""")
def guards(spark, d):
    state = clean.convert_dates(clean.convert_numbers(clean.Cleaned(raw(spark, d)), ["Misto"]), ["Prioridade"])
    return state.log_frame()


@check("fill_profit", f"""WITH {SALES}
SELECT count(CASE WHEN pedido % 4 = 0 AND pedido % 8 = 0 THEN NULL ELSE 1 END) AS filled,
 round(sum(CASE WHEN pedido % 4 = 0 THEN CASE WHEN pedido % 8 = 0 THEN NULL ELSE faturamento - custo END ELSE 1 END), 2) AS total FROM sales""")
def profit_fill(spark, d):
    s = sales(spark, d).select(
        F.when(F.col("Pedido_ID") % 4 != 0, F.lit(1.0)).alias("Lucro"), F.col("Faturamento").alias("Valor_liquido"),
        F.when(F.col("Pedido_ID") % 8 != 0, F.col("Custo")).alias("Total_custo"))
    out = clean.fill_profit(clean.Cleaned(s)).frame
    return rounded(out.agg(F.count("Lucro").alias("filled"), F.sum("Lucro").alias("total")), 2)


@check("etl_summary", f"""WITH {RAW}, c AS (SELECT {NUM.format('Valor')} AS v, Data, Valor, Ano FROM raw),
b AS (SELECT count(*) AS n, sum(({' + '.join(f'CASE WHEN {c} IS NULL THEN 1 ELSE 0 END' for c in RAW_COLS)})) AS nulls FROM raw)
SELECT n AS "rows", CAST(nulls AS BIGINT) AS nulls_before,
 CAST(nulls + (SELECT count(*) FILTER (WHERE v IS NULL AND Valor IS NOT NULL) - count(*) FILTER (WHERE Ano IS NULL AND Data IS NOT NULL) FROM c) AS BIGINT) AS nulls_after,
 CAST(-(SELECT count(*) FILTER (WHERE v IS NULL AND Valor IS NOT NULL) - count(*) FILTER (WHERE Ano IS NULL AND Data IS NOT NULL) FROM c) AS BIGINT) AS nulls_treated,
 CAST(0 AS BIGINT) AS duplicates_before, CAST(0 AS BIGINT) AS duplicates_after FROM b""")
def etl_report(spark, d):
    r = raw(spark, d)
    out, _ = clean.run_etl(r, quality.infer_types(r))
    return rounded(clean.etl_summary(quality.null_profile(r), quality.null_profile(out),
                                     quality.duplicate_rows(r), quality.duplicate_rows(out)))
