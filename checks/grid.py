"""Structural recovery of reports written from the orders table, one sheet per year."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import cells as cl
from ledgerlens.functions.ordered import with_dense_row_number
from ledgerlens.operators import grid, headers
from ledgerlens.session import cut_lineage

from .common import check, once, rounded, table

MONTHS = cl.MONTHS[:12]
NUMBER = "CASE WHEN month(o_orderdate) = {} THEN '{}'"
STEP = 10_000_000_000


def _row(*cells):
    return F.array(*[c.cast("string") if not isinstance(c, str) else F.lit(c) for c in cells])


@once
def report(spark, d):
    """Header, and per month a period row, its orders, a total and a note, with a blank row after it."""
    o = table(spark, d, "orders").select(
        F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m"), "o_orderkey", "o_totalprice", "o_orderpriority",
        F.date_format("o_orderdate", "dd/MM/yyyy").alias("day"))
    months = o.groupBy("y", "m").agg(F.format_string("%.2f", F.sum("o_totalprice")).alias("t"))
    years = o.select("y").distinct()
    name = F.upper(F.get(F.array(*[F.lit(x) for x in MONTHS]), F.col("m") - 1))
    none = F.lit(None).cast("string")
    at = lambda m, k: (m * STEP + k).cast("bigint").alias("ord")
    m = F.col("m").cast("bigint")
    parts = [
        years.select("y", at(F.lit(0).cast("bigint"), 0), _row("Pedido", "Data", "Valor Total", "Status").alias("cells")),
        months.select("y", at(m, 0), _row(name, none, none, none).alias("cells")),
        o.select("y", at(m, F.col("o_orderkey") + 1), _row(F.col("o_orderkey"), F.col("day"), F.format_string("R$ %.2f", "o_totalprice"), F.col("o_orderpriority")).alias("cells")),
        months.select("y", at(m, STEP - 3), _row(F.lit("TOTAL"), none, F.col("t"), none).alias("cells")),
        months.select("y", at(m, STEP - 2), _row(F.lit("Obs.: conferir"), none, none, none).alias("cells")),
        months.select("y", at(m, STEP - 1), _row(none, F.lit("  "), none, none).alias("cells")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.select(F.lit("orders").alias("file"), F.col("y").cast("string").alias("sheet"), "ord", "cells")
    return cut_lineage(with_dense_row_number(out, ["file", "sheet"], "ord").drop("ord"))


@once
def recovery(spark, d):
    return grid.recover(report(spark, d))


ORD = """o AS (SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, * FROM orders),
mon AS (SELECT y, m, count(*) AS n, sum(o_totalprice) AS t FROM o GROUP BY 1, 2),
pos AS (SELECT *, 1 + sum(n + 4) OVER (PARTITION BY y ORDER BY m) - (n + 4) AS before FROM mon)"""


@check("grid_rows", f"WITH {ORD} SELECT CAST(y AS VARCHAR) AS sheet, CAST(sum(n) + 4 * count(*) + 1 AS BIGINT) AS n, CAST(sum(n) + 4 * count(*) + 1 AS BIGINT) AS last_row FROM mon GROUP BY y")
def grid_rows(spark, d):
    return report(spark, d).groupBy("sheet").agg(F.count(F.lit(1)).alias("n"), F.max("row_no").alias("last_row"))


@check("cell_numbers", r"""
WITH c AS (SELECT CASE l_linenumber WHEN 1 THEN '(' || printf('%.2f', l_extendedprice) || ')' WHEN 2 THEN 'R$ ' || replace(printf('%.2f', l_extendedprice), '.', ',')
  WHEN 3 THEN printf('%.3f', l_extendedprice) WHEN 4 THEN printf('%d,%03d.50', CAST(l_quantity AS INTEGER), CAST(l_partkey % 1000 AS INTEGER)) WHEN 5 THEN l_shipdate::DATE::VARCHAR
  WHEN 6 THEN printf('%.1f', l_discount * 100) || '%' ELSE l_returnflag END AS cell, l_linenumber, l_extendedprice, l_quantity, l_partkey FROM lineitem)
SELECT CASE l_linenumber WHEN 3 THEN 'T' WHEN 5 THEN 'D' WHEN 6 THEN 'P' WHEN 7 THEN 'T' ELSE 'N' END AS kind, count(*) AS n,
 round(sum(CASE l_linenumber WHEN 1 THEN -l_extendedprice WHEN 2 THEN l_extendedprice WHEN 4 THEN CAST(l_quantity AS INTEGER) * 1000 + l_partkey % 1000 + 0.5 END), 2) AS total FROM c GROUP BY 1""")
def cell_numbers(spark, d):
    n, price = F.col("l_linenumber"), F.col("l_extendedprice")
    cell = (F.when(n == 1, F.format_string("(%.2f)", price)).when(n == 2, F.concat(F.lit("R$ "), F.translate(F.format_string("%.2f", price), ".", ",")))
            .when(n == 3, F.format_string("%.3f", price)).when(n == 4, F.format_string("%d,%03d.50", F.col("l_quantity").cast("int"), (F.col("l_partkey") % 1000).cast("int")))
            .when(n == 5, F.date_format("l_shipdate", "yyyy-MM-dd")).when(n == 6, F.format_string("%.1f%%", F.col("l_discount") * 100)).otherwise(F.col("l_returnflag")))
    c = table(spark, d, "lineitem").select(cell.alias("c"))
    return rounded(c.groupBy(cl.cell_kind(F.col("c")).alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum(cl.parse_number(F.col("c"))).alias("total")), 2)


@check("row_first_types", f"""WITH {ORD}
SELECT type, CAST(n AS BIGINT) AS n FROM (SELECT 'periodo' AS type, count(*) AS n FROM mon UNION ALL SELECT 'total', count(*) FROM mon UNION ALL SELECT 'comentario', count(*) FROM mon
 UNION ALL SELECT 'vazia', count(*) FROM mon UNION ALL SELECT 'open', sum(n) + count(DISTINCT y) FROM mon)""")
def first_types(spark, d):
    rows = grid.described_rows(report(spark, d))
    typed = rows.select(F.coalesce(grid.basic_type(rows), F.lit("open")).alias("type"))
    return typed.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@check("header_detection", f"""WITH {ORD} SELECT CAST(y AS VARCHAR) AS sheet, CASE WHEN y % 4 < 3 THEN CAST(1 + y % 4 AS BIGINT) END AS header_row FROM mon GROUP BY y""")
def header_detection(spark, d):
    """A sheet has as many title rows above its header as its year leaves by four; where that is three, it has no header."""
    g = report(spark, d)
    titles = F.col("sheet").cast("int") % 4
    none = F.lit(None).cast("string")
    moved = g.where((titles < 3) | (F.col("row_no") > 1)).withColumn("row_no", F.col("row_no") + F.when(titles < 3, titles).otherwise(-1))
    above = g.where((F.col("row_no") == 1) & (titles < 3)).select("file", "sheet", F.explode(F.slice(F.array(F.lit(1).cast("bigint"), F.lit(2).cast("bigint")), 1, titles)).alias("row_no"))
    return headers.top_header(moved.unionByName(above.withColumn("cells", _row(F.concat(F.lit("Relatorio "), "sheet"), none, none, none))), grid.KEYS).select("sheet", "header_row")


@check("report_gate", f"WITH {ORD} SELECT CAST(y AS VARCHAR) AS sheet, true AS is_report FROM mon GROUP BY y UNION ALL SELECT 'plain', false FROM customer WHERE c_custkey = (SELECT min(c_custkey) FROM customer)")
def report_gate(spark, d):
    c = table(spark, d, "customer").select(F.lit("orders").alias("file"), F.lit("plain").alias("sheet"), (F.col("c_custkey") + 2).alias("row_no"),
                                           _row(F.col("c_custkey"), F.col("c_name"), F.col("c_nationkey"), F.col("c_mktsegment")).alias("cells"))
    head = c.where("row_no = 2").select("file", "sheet", F.lit(1).cast("bigint").alias("row_no"), _row("Codigo", "Nome", "Loja", "Categoria").alias("cells"))
    return grid.report_gate(*grid.classify_first(report(spark, d).unionByName(c).unionByName(head))).select("sheet", "is_report")


@check("grid_sections", f"""WITH {ORD}
SELECT CAST(y AS VARCHAR) AS sheet, CAST(before + 2 AS BIGINT) AS start_row, CAST(before + 1 + n AS BIGINT) AS end_row, n AS candidate_rows, n AS compatible_rows, 100.0 AS compatibility, n >= 20 AS strong FROM pos""")
def sections(spark, d):
    return recovery(spark, d)["sections"].select("sheet", "start_row", "end_row", "candidate_rows", "compatible_rows", "compatibility", "strong")


@check("grid_pattern", f"""WITH {ORD}
SELECT CAST(y AS VARCHAR) AS sheet, 'NDNT' AS dominant, CAST(sum(n) AS BIGINT) AS equal_rows, count(*) AS sequences, 100.0 AS compatibility,
 (sum(n) >= 20 AND count(*) >= 2) OR max(n) >= 20 AS strong, CASE WHEN sum(n) >= 20 THEN '1' ELSE '' END AS id_positions FROM mon GROUP BY y""")
def pattern(spark, d):
    p = recovery(spark, d)["pattern"]
    return rounded(p.select("sheet", F.array_join("dominant", "").alias("dominant"), "equal_rows", "sequences", "compatibility", "strong",
                            F.array_join(F.transform("id_positions", lambda i: i.cast("string")), ",").alias("id_positions")))


@check("grid_audit", f"""WITH {ORD}
SELECT CAST(y AS VARCHAR) AS sheet, type, CAST(n AS BIGINT) AS n FROM (SELECT y, 'transacao' AS type, sum(n) AS n FROM mon GROUP BY y UNION ALL SELECT y, 'cabecalho', 1 FROM mon GROUP BY y
 UNION ALL SELECT y, unnest(['periodo', 'total', 'comentario', 'vazia']), count(*) FROM mon GROUP BY y)""")
def audit(spark, d):
    return recovery(spark, d)["audit"].groupBy("sheet", "type").agg(F.count(F.lit(1)).alias("n"))


@check("grid_period_context", f"""WITH {ORD}, names AS (SELECT * FROM (VALUES {', '.join(f"({i + 1}, '{n.upper()}')" for i, n in enumerate(MONTHS))}) t(m, name))
SELECT CAST(y AS VARCHAR) AS sheet, name AS context, n FROM mon JOIN names USING (m)""")
def context(spark, d):
    a = recovery(spark, d)["audit"].where("type = 'transacao'")
    return a.groupBy("sheet", "context").agg(F.count(F.lit(1)).alias("n"))


@check("grid_metrics", f"""WITH {ORD}
SELECT CAST(y AS VARCHAR) AS sheet, CAST(sum(n) + 4 * count(*) + 1 AS BIGINT) AS "rows", CAST(sum(n) AS BIGINT) AS records, count(*) AS summaries, count(*) AS periods, count(*) AS empty,
 CAST(0 AS BIGINT) AS unknown, 100.0 AS recognised_percent, 100.0 AS structural_confidence, 100.0 AS classified_coverage,
 round(sum(n) / (sum(n) + 3 * count(*) + 1) * 100, 2) AS record_coverage, 'accepted' AS status, 
 CASE WHEN sum(n) >= 20 AND count(*) < 2 AND max(n) < 20 THEN 'No dominant transaction signature reached sufficient consistency.' ELSE 'Rows were extracted with a consistent structure.' END AS reason FROM mon GROUP BY y""")
def sheet_metrics(spark, d):
    m = recovery(spark, d)["metrics"]
    return rounded(m.select("sheet", "rows", "records", "summaries", "periods", "empty", "unknown", "recognised_percent", "structural_confidence",
                            "classified_coverage", "record_coverage", "status", "reason"), 2)


@check("grid_blocks", f"""WITH {ORD}
SELECT CAST(y AS VARCHAR) AS sheet, CAST(3 AS BIGINT) AS start_row, CAST(max(before + 1 + n) AS BIGINT) AS end_row, CAST(sum(n) AS BIGINT) AS records,
 round(sum(n) / (max(before + 1 + n) - 2) * 100, 2) AS coverage FROM pos GROUP BY y""")
def blocks(spark, d):
    return rounded(grid.detected_blocks(recovery(spark, d)["audit"]).select("sheet", "start_row", "end_row", "records", "coverage"), 2)


@check("grid_review_detail", f"""WITH {ORD} SELECT 100.0 AS confidence, CAST(sum(n) + 3 * count(*) + count(DISTINCT y) AS BIGINT) AS content_rows, CAST(sum(n) AS BIGINT) AS record_rows, CAST(0 AS BIGINT) AS unknown_rows FROM mon""")
def review(spark, d):
    return rounded(grid.review_detail(recovery(spark, d)["metrics"]).drop("reason"), 2)


@check("recovered_table", """SELECT CAST(year(o_orderdate) AS VARCHAR) AS sheet, count(*) AS n, round(sum(o_totalprice), 2) AS total, count(DISTINCT strftime(o_orderdate, '%d/%m/%Y')) AS days,
 count(DISTINCT o_orderpriority) AS status FROM orders GROUP BY 1""")
def recovered(spark, d):
    r = recovery(spark, d)
    tables = r["plan"].select("file", "sheet", "table_no").distinct().collect()  # one per recovered table
    every = [grid.table_of(r["records"], r["plan"], *t).select(F.lit(t["sheet"]).alias("sheet"), "Pedido", "Valor Total", "Data", "Status") for t in tables]
    t = reduce(DataFrame.unionByName, every)
    return rounded(t.groupBy("sheet").agg(F.count("Pedido").alias("n"), F.sum("Valor Total").alias("total"), F.count_distinct("Data").alias("days"), F.count_distinct("Status").alias("status")), 2)


@check("recovered_columns", f"""WITH {ORD} SELECT CAST(y AS VARCHAR) AS sheet, name, action FROM (SELECT DISTINCT y FROM mon), (VALUES ('Pedido', 'keep'), ('Data', 'keep'), ('Valor Total', 'parse'), ('Status', 'keep')) t(name, action)""")
def recovered_columns(spark, d):
    return recovery(spark, d)["plan"].select("sheet", "name", "action")


@check("side_by_side_tables", f"""WITH {ORD} SELECT CAST(y AS VARCHAR) AS sheet, CAST(f AS BIGINT) AS first_col, CAST(l AS BIGINT) AS last_col, CAST(h AS BIGINT) AS header_row, CAST(r AS BIGINT) AS region
FROM (SELECT DISTINCT y FROM mon), (VALUES (0, 3, 1, 1), (5, 6, 3, 2)) t(f, l, h, r)""")
def lateral(spark, d):
    none = F.lit(None).cast("string")
    right = F.when(F.col("row_no") == 3, _row("Loja", "Nome")).when(F.col("row_no") > 3, F.array(F.col("row_no").cast("string"), F.get(F.col("cells"), F.lit(3)))).otherwise(F.array(none, none))
    g = report(spark, d).select("file", "sheet", "row_no", F.concat("cells", F.array(none), right).alias("cells"))
    return rounded(grid.lateral_regions(g).select("sheet", "first_col", "last_col", "header_row", "region"))


@check("unknown_row_regions", f"""WITH {ORD} SELECT CAST(y AS VARCHAR) AS sheet, count(*) AS regions, CAST(2 * count(*) AS BIGINT) AS unknown FROM mon GROUP BY y""")
def unknown(spark, d):
    """Every note is followed by a stray word and so are the blank rows after it."""
    g = report(spark, d)
    stray = F.when(F.startswith(F.col("cells")[0], F.lit("Obs.")) | (F.size(F.filter("cells", lambda v: ~cl.blank(v))) == 0), _row("conferido", "por", F.lit(None).cast("string"), F.lit(None).cast("string")))
    a = grid.recover(g.withColumn("cells", F.coalesce(stray, F.col("cells"))))
    return grid.unknown_regions(a["audit"]).groupBy("sheet").agg(F.count(F.lit(1)).alias("regions"), F.sum("n").alias("unknown"))


NUMBERED = f"""{ORD}, numbered AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY m) AS k FROM pos),
moved AS (SELECT y, sum(n) AS n, coalesce(sum(n) FILTER (k <= 2), 0) AS early, coalesce(sum(n) FILTER (k > 2), 0) AS late, max(before) FILTER (k = 3) AS head FROM numbered GROUP BY y HAVING count(*) >= 3)"""


@once
def moved(spark, d):
    """The header stands after the second month instead of at the top; sheets of fewer months are left out."""
    g = report(spark, d)
    third = g.where(F.upper(F.col("cells")[0]).isin(*[m.upper() for m in MONTHS])).groupBy("file", "sheet").agg(F.sort_array(F.collect_list("row_no"))[2].alias("at"))
    out = g.join(third, ["file", "sheet"]).where("at is not null").withColumn(
        "row_no", F.when(F.col("row_no") == 1, F.col("at") - 1).when(F.col("row_no") < F.col("at"), F.col("row_no") - 1).otherwise(F.col("row_no"))).drop("at")
    return grid.recover(cut_lineage(out))


@check("late_header_evidence", f"""WITH {NUMBERED} SELECT CAST(y AS VARCHAR) AS sheet, CAST(p AS BIGINT) AS position, label, k AS kind_after, true AS valid, true AS allowed
FROM moved, (VALUES (1, 'Pedido', 'N'), (2, 'Data', 'D'), (3, 'Valor Total', 'N'), (4, 'Status', 'T')) t(p, label, k) WHERE head > 20 AND early >= 10 AND late >= 10""")
def late(spark, d):
    r = moved(spark, d)
    return rounded(grid.late_headers(r["audit"], r["headers"]).select("sheet", "position", "label", "kind_after", "valid", "allowed"))


@check("headerless_continuation", f"""WITH {NUMBERED} SELECT CAST(y AS VARCHAR) AS sheet, CAST(1 AS BIGINT) AS tables, CAST(n AS BIGINT) AS records, 'coluna_1,coluna_2,coluna_3,coluna_4' AS names FROM moved""")
def continuation(spark, d):
    """What stands before the late header and after it is one table, whose columns get no names from that header."""
    r = moved(spark, d)
    named = r["plan"].groupBy("sheet").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("table_no", "pos", "name"))), lambda c: c["name"]), ",").alias("names"))
    tables = grid.detected_blocks(r["audit"]).groupBy("sheet").agg(F.count(F.lit(1)).alias("tables"), F.sum("records").alias("records"))
    return tables.join(named, "sheet")


@check("side_by_side_recovery", f"""WITH {ORD}, sides AS (SELECT y, n, side FROM mon, (VALUES (1, ''), (2, ' b')) t(side, b))
SELECT CAST(y AS VARCHAR) AS sheet, CAST(side AS BIGINT) AS region, CAST(sum(n) AS BIGINT) AS records, count(*) AS periods, count(*) AS summaries, CAST(count(*) + 1 AS BIGINT) AS empty, CAST(0 AS BIGINT) AS unknown,
 'review_required' AS status, CASE WHEN side = 1 THEN 'Pedido,Data,Valor Total,Status' ELSE 'Codigo,Dia,Quantia,Forma' END AS names FROM sides GROUP BY y, side""")
def side_by_side(spark, d):
    """The report and, beyond an empty column and one row further down, a copy of it with other headers."""
    g = report(spark, d)
    renamed = F.when(F.col("row_no") == 1, _row("Codigo", "Dia", "Quantia", "Forma")).otherwise(F.col("cells"))
    left, right = g.select("file", "sheet", "row_no", "cells"), g.select("file", "sheet", (F.col("row_no") + 1).alias("row_no"), renamed.alias("beside"))
    none = F.lit(None).cast("string")
    blank = F.array(none, none, none, none)
    both = left.join(right, ["file", "sheet", "row_no"], "full").select(
        "file", "sheet", "row_no", F.concat(F.coalesce("cells", blank), F.array(none), F.coalesce("beside", blank)).alias("cells"))
    r = grid.recover(cut_lineage(both))
    parted = lambda df: df.select(F.split("sheet", grid.REGION_MARK)[0].alias("sheet"), F.split("sheet", grid.REGION_MARK)[1].cast("bigint").alias("region"), *[c for c in df.columns if c not in ("file", "sheet")])
    named = parted(r["plan"]).groupBy("sheet", "region").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("table_no", "pos", "name"))), lambda c: c["name"]), ",").alias("names"))
    return rounded(parted(r["metrics"]).select("sheet", "region", "records", "periods", "summaries", "empty", "unknown", "status").join(named, ["sheet", "region"]))


@once
def rich(spark, d):
    """A report with a merged upper header, a column of currency marks, a formula column, headers that repeat each quarter,
    and after each total an unlabelled sum. In odd years the marks differ."""
    o = table(spark, d, "orders").select(
        F.year("o_orderdate").alias("y"), F.month("o_orderdate").cast("bigint").alias("m"), "o_orderkey", "o_totalprice", "o_orderpriority", F.date_format("o_orderdate", "dd/MM/yyyy").alias("day"))
    months = o.groupBy("y", "m").agg(F.format_string("%.2f", F.sum("o_totalprice")).alias("t"))
    years = o.select("y").distinct().withColumn("m", F.lit(0).cast("bigint"))
    none = F.lit(None).cast("string")
    name = F.upper(F.get(F.array(*[F.lit(x) for x in MONTHS]), (F.col("m") - 1).cast("int")))
    head = _row("Pedido", "Data", none, "Valor", "Metade", "Status")
    mark = F.when((F.col("y") % 2 == 1) & (F.col("m") % 2 == 0), "US$").otherwise("R$")
    broken = F.col("o_orderkey") % 97 == 0
    half = F.when(broken, F.lit("=D/2")).otherwise(F.format_string("%.2f", F.col("o_totalprice") / 2))
    sort = lambda k: (F.col("m") * STEP + k).cast("bigint").alias("ord")
    part = lambda df, k, cells, kind="": df.select("y", sort(k), cells.alias("cells"), F.lit(kind).alias("kind") if isinstance(kind, str) else kind.alias("kind"))
    parts = [
        part(years, 0, _row("Cadastro", none, "Financeiro", none, none, none), "upper"), part(years, 1, head),
        part(months.where("m in (4, 7, 10)"), 0, head), part(months, 1, _row(name, none, none, none, none, none)),
        part(o, F.col("o_orderkey") + 2, _row(F.col("o_orderkey"), F.col("day"), mark, F.format_string("%.2f", "o_totalprice"), half, F.col("o_orderpriority")), F.when(broken, "broken").otherwise("order")),
        part(months, STEP - 4, _row("TOTAL", none, none, F.col("t"), none, none), "total"), part(months, STEP - 3, _row(none, none, none, none, F.col("t"), none)),
        part(months, STEP - 2, _row("Obs.: conferir", none, none, none, none, none)), part(months, STEP - 1, _row(none, F.lit("  "), none, none, none, none)),
    ]
    out = reduce(DataFrame.unionByName, parts).select(F.lit("rich").alias("file"), F.col("y").cast("string").alias("sheet"), "ord", "cells", "kind")
    out = cut_lineage(with_dense_row_number(out, ["file", "sheet"], "ord").drop("ord"))
    row = F.col("row_no").cast("string")
    formulas = out.where("kind in ('order', 'broken', 'total')").select(
        "file", "sheet", "row_no", F.when(F.col("kind") == "total", 4).otherwise(5).alias("col_no"),
        F.when(F.col("kind") == "total", F.concat(F.lit("=SUM(D1:D"), row, F.lit(")"))).otherwise(F.concat(F.lit("=D"), row, F.lit("/2"))).alias("formula"), (F.col("kind") == "broken").alias("uncached"))
    merged = out.where("kind = 'upper'").select("file", "sheet", F.inline(F.array(
        F.struct(F.lit(1).alias("row1"), F.lit(1).alias("row2"), F.lit(1).alias("col1"), F.lit(2).alias("col2")),
        F.struct(F.lit(1).alias("row1"), F.lit(1).alias("row2"), F.lit(3).alias("col1"), F.lit(5).alias("col2")))))
    formulas = cut_lineage(formulas)
    return {**grid.recover(out.drop("kind"), formulas, cut_lineage(merged)), "formulas": formulas}


@check("report_with_formulas", f"""WITH {ORD}
SELECT CAST(y AS VARCHAR) AS sheet, type, CAST(n AS BIGINT) AS n FROM (SELECT y, 'transacao' AS type, sum(n) AS n FROM mon GROUP BY y UNION ALL SELECT y, 'cabecalho_superior', 1 FROM mon GROUP BY y
 UNION ALL SELECT y, 'cabecalho', 1 + count(*) FILTER (m IN (4, 7, 10)) FROM mon GROUP BY y UNION ALL SELECT y, unnest(['periodo', 'total', 'resumo', 'comentario', 'vazia']), count(*) FROM mon GROUP BY y)""")
def rich_audit(spark, d):
    return rich(spark, d)["audit"].groupBy("sheet", "type").agg(F.count(F.lit(1)).alias("n"))


@check("merged_header_columns", f"""WITH {ORD}, blocks AS (SELECT DISTINCT y, m >= 4 AS later FROM mon)
SELECT CAST(y AS VARCHAR) AS sheet, later, CAST(p AS BIGINT) AS position, CASE WHEN later THEN b ELSE a END AS name, action FROM blocks, (VALUES (1, 'Cadastro / Pedido', 'Pedido', 'keep'), (2, 'Cadastro / Data', 'Data', 'keep'),
 (3, 'Financeiro', 'coluna_3', 'drop'), (4, 'Financeiro / Valor', 'Valor', 'parse'), (5, 'Financeiro / Metade', 'Metade', 'keep'), (6, 'Status', 'Status', 'keep')) t(p, a, b, action)""")
def rich_columns(spark, d):
    """Two-row names up to the first repeated header, plain ones from there; the marks' column goes and its neighbour is read."""
    plan = rich(spark, d)["plan"]
    return plan.select("sheet", (F.col("table_no") > 1).alias("later"), (F.col("pos") + 1).cast("bigint").alias("position"), "name", "action")


@check("formula_values", f"""WITH {ORD} SELECT CAST(y AS VARCHAR) AS sheet, m >= 4 AS later, count(*) AS n, round(sum(o_totalprice), 2) AS total, count(*) FILTER (o_orderkey % 97 = 0) AS missing,
 count(*) FILTER (o_orderkey % 97 <> 0) AS known FROM o GROUP BY y, m >= 4""")
def formula_values(spark, d):
    """Formulas without a stored value are NULL in the records."""
    r = rich(spark, d)["records"]
    half = F.get(F.col("cells"), F.lit(4))
    return rounded(r.groupBy("sheet", (F.col("table_no") > 1).alias("later")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(cl.parse_number(F.get(F.col("cells"), F.lit(3)))).alias("total"), F.count_if(half.isNull()).alias("missing"), F.count_if(cl.parse_number(half).isNotNull()).alias("known")), 2)


@check("unavailable_formulas", f"""WITH {ORD}, placed AS (SELECT o.y, o.m, o_orderkey, 2 + sum(p.add) AS r FROM o JOIN (SELECT y, m, n + 5 + CAST(m IN (4, 7, 10) AS INTEGER) AS add FROM mon) p ON p.y = o.y AND p.m < o.m GROUP BY ALL
  UNION ALL SELECT o.y, o.m, o_orderkey, 2 FROM o WHERE m = (SELECT min(m) FROM mon WHERE mon.y = o.y)),
rowed AS (SELECT *, r + 1 + CAST(m IN (4, 7, 10) AS INTEGER) + row_number() OVER (PARTITION BY y, m ORDER BY o_orderkey) AS row_no FROM placed)
SELECT CAST(y AS VARCHAR) AS sheet, CAST(row_no AS BIGINT) AS row_no, CAST(5 AS BIGINT) AS col_no, '=D' || CAST(CAST(row_no AS BIGINT) AS VARCHAR) || '/2' AS formula FROM rowed WHERE o_orderkey % 97 = 0""")
def unavailable(spark, d):
    r = rich(spark, d)
    return rounded(grid.unavailable_formulas(r["audit"], r["formulas"]).select("sheet", "row_no", "col_no", "formula"))


@check("mixed_currency_review", f"""WITH {ORD}, blocks AS (SELECT y, m >= 4 AS later, count(DISTINCT m % 2) AS kinds FROM mon GROUP BY ALL)
SELECT CAST(y AS VARCHAR) AS sheet, CASE WHEN y % 2 = 1 AND max(kinds) > 1 THEN 'review_required' ELSE 'accepted' END AS status, 'Rows were extracted with a consistent structure.' AS reason FROM blocks GROUP BY y""")
def mixed_currency(spark, d):
    return rich(spark, d)["metrics"].select("sheet", "status", "reason")
