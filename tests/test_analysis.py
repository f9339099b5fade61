"""The whole analysis, and the registered queries against their SQL."""

import re
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from checks import insights as queries
from checks.common import table
from checks.compare_tool import compare, connect
from ledgerlens.operators import quality
from ledgerlens.plans.analysis import analyze

DIR = "/root/testdata/sf0.001"
QUICK = ["monthly_change", "kpis", "customer_ranking", "dimension_top_revenue", "null_profile", "duplicate_rows", "infer_types",
         "relationships", "return_enrichment", "window_movements", "exact_name_variants", "metric_changes"]


def test_analyze_end_to_end(spark):
    li, o, p = (table(spark, DIR, t) for t in ("lineitem", "orders", "part"))
    tables = {
        "Vendas": li.join(o, F.expr("l_orderkey = o_orderkey")).select(
            F.col("l_orderkey").alias("Pedido_ID"), F.col("o_orderdate").alias("Data"), F.col("o_custkey").alias("Cliente_ID"),
            F.col("l_partkey").alias("Produto_ID"), F.col("l_quantity").alias("Quantidade"), F.col("l_extendedprice").alias("Faturamento")),
        "Produtos": p.select(F.col("p_partkey").alias("Produto_ID"), F.col("p_name").alias("Nome"), F.col("p_type").alias("Categoria"),
                             F.col("p_retailprice").alias("Custo_Aquisicao")),
    }
    a = analyze(tables)
    assert {"faturamento", "custo", "lucro", "margem_lucro", "produto", "categoria"} <= set(a.roles)
    want = li.agg(F.sum("l_extendedprice").alias("v")).first()["v"]
    got = {r["indicador"]: r["valor"] for r in a["kpis"].collect()}
    assert abs(got["faturamento_total"] - want) < 1e-3 and got["quantidade_registros"] == li.count()
    assert a["selected_findings"].count() <= 8 and a["quality"].first()["score"] is not None
    row = a["executive_summary"].first()
    assert row["status"][0]["score"] <= 100 and row["lists"] and {k["indicador"]: k["valor"] for k in row["kpis"]}["quantidade_registros"] == li.count()
    assert a["opportunities"].columns == a["insights"].columns and a["customer_summary"].count() == 1


def test_analyze_without_dates_or_customers(spark):
    a = analyze({"Itens": spark.createDataFrame([("x", 1.0, 2), ("y", 3.0, 4)], "Produto string, Faturamento double, Quantidade int")})
    assert a["executive_summary"].count() == 1 and "series" not in a.results


@pytest.mark.parametrize("name", QUICK)
def test_query_agrees_with_sql(spark, name):
    import __spark_entry__ as entry

    message, _, good = compare(spark, connect(DIR), DIR, name, entry.queries()[name], entry.oracle_sql()[name])
    assert good, message


def test_a_report_is_analysed_in_one_step(spark):
    from ledgerlens.plans.analysis import ReviewRequired, analyze_report

    def cells(rows):
        return spark.createDataFrame([("f", "Vendas", i, [None if c is None else str(c) for c in r]) for i, r in enumerate(rows, 1)],
                                     "file string, sheet string, row_no bigint, cells array<string>")

    rows = [["Pedido_ID", "Data", "Cliente", "Faturamento", "Lucro"]]
    for m in (1, 2, 3):
        rows.append([["JANEIRO", "FEVEREIRO", "MARCO"][m - 1], None, None, None, None])
        rows += [[m * 100 + k, f"2025-0{m}-{k + 1:02d}", "ab"[k % 2] * 12, f"{100 + k}.50", k + 1] for k in range(12)]
        rows.append(["TOTAL", None, None, "1.0", None])
    a = analyze_report(cells(rows))
    got = {r["indicador"]: r["valor"] for r in a["kpis"].collect()}
    assert got["quantidade_registros"] == 36 and got["faturamento_total"] == 3 * sum(100.5 + k for k in range(12)) and got["quantidade_pedidos"] == 36
    assert a["structure"].first()["status"] == "accepted" and a["series"].where("metric = 'faturamento'").count() == 3
    with pytest.raises(ReviewRequired):
        analyze_report(cells([["Janeiro"], ["Texto inexplicavel"], [1, 2], ["X", "Y", "Z"]]))


@pytest.mark.parametrize("name", ["growth_summary", "growth_candidates", "dimension_top_revenue", "coherence_audit", "quality_score"])
def test_rules_read_what_is_written(spark, name, monkeypatch):
    """No rule goes back to the tables: of the six that make the joined frame, each is read once, when the rule's base is written."""
    import __spark_entry__ as entry
    from ledgerlens.operators import quality, rankings, temporal

    read = []
    from ledgerlens import session
    for module in (quality, rankings, temporal):
        def written(df, cut=session.cut_lineage):
            read.append(df._jdf.queryExecution().executedPlan().toString().count(f"{DIR}/lineitem.parquet") + df._jdf.queryExecution().executedPlan().toString().count(f"{DIR}/orders.parquet"))
            return cut(df)
        monkeypatch.setattr(module, "cut_lineage", written)
    out = entry.queries()[name](spark, DIR)
    assert str(DIR) not in out._jdf.queryExecution().executedPlan().toString() and out.count() > 0
    assert 0 < sum(n > 0 for n in read) <= 3 and (name == "quality_score" or max(read) <= 2)


def test_joined_tables_are_written_before_they_are_profiled(spark, monkeypatch):
    """What profiles read is the joined table as written, and not the join again."""
    seen = []
    profile = quality.null_profile
    monkeypatch.setattr(quality, "null_profile", lambda df: seen.append(df._jdf.queryExecution().optimizedPlan().toString()) or profile(df))
    facts = spark.createDataFrame([(i, i % 5, float(i)) for i in range(40)], "Pedido_ID long, Produto_ID long, Faturamento double")
    products = spark.createDataFrame([(i, f"P{i}", 2.0) for i in range(5)], "Produto_ID long, Nome string, Custo_Aquisicao double")
    out = analyze({"Vendas": facts, "Produtos": products})
    assert len(seen) == 1 and "Join" not in seen[0] and out["kpis"].where("indicador = 'faturamento_total'").first()["valor"] == 780.0


def test_insight_queries_join_the_sales_once(spark, tmp_path):
    rows = {
        "customer": ([(1, "A", 0, 1.0, "M")], "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"),
        "nation": ([(0, "N", 0)], "n_nationkey int, n_name string, n_regionkey int"),
        "region": ([(0, "R")], "r_regionkey int, r_name string"), "part": ([(1, "p", "b", "t", 5, 2.0)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"),
        "supplier": ([(1, "s", 0, 1.0)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double"),
        "orders": ([(1, 1, "O", 9.0, datetime(2020, 1, 2), "5-LOW")], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"),
        "lineitem": ([(1, 1, 1, 1, 3.0, 10.0, 0.0, "R", "O", datetime(2020, 1, 3))],
                     "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_returnflag string, l_linestatus string, l_shipdate timestamp")}
    for name, (data, schema) in rows.items():
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    sold = queries.sold(spark, str(tmp_path))
    assert "Join" not in sold._jdf.queryExecution().optimizedPlan().toString() and sold is queries.sold(spark, str(tmp_path))
    detail = queries.detail(spark, str(tmp_path)).first()
    assert (detail["entity"], detail["quantidade"], detail["faturamento"], detail["lucro"]) == (1, 3.0, 10.0, 4.0)


def test_many_products_are_not_broadcast(spark):
    """Where products grow with the sales their values are joined by shuffles, as are the sales' own tables; the results are those of the planner's choice."""
    from checks.common import sales
    from ledgerlens.operators import enrich

    plan = lambda df: df._jdf.queryExecution().sparkPlan().toString()
    base = spark.createDataFrame([(i % 4 if i % 9 else None, float(i)) for i in range(40)], "Produto_ID long, Quantidade double")
    tables = {"Avaliacoes": spark.createDataFrame([(0, 4.0), (0, 5.0), (1, None), (9, 1.0), (None, 2.0)], "Produto_ID long, Nota double"),
              "Stock": spark.createDataFrame([(1, 5.0, 10.0), (1, 7.0, 10.0), (9, 1.0, 2.0)], "Produto_ID long, `Estoque Atual` double, `Estoque Minimo` double"),
              "Devolucoes": spark.createDataFrame([(2, 3.0, "x"), (2, 1.0, "y"), (2, 1.0, "y"), (9, 1.0, "z")], "Produto_ID long, Quantidade double, Motivo string")}
    wide, usual = enrich.enrich(base, tables, spread=True), enrich.enrich(base, tables)
    assert "Broadcast" not in plan(wide.frame) and [x[1] for x in wide.log] == ["sucesso"] * 3 == [x[1] for x in usual.log]
    rows = lambda e: sorted(map(str, e.frame.collect()))
    assert rows(wide) == rows(usual) and wide.per_product().count() == 4
    none = enrich.enrich(base, {"Avaliacoes": tables["Avaliacoes"].where("Produto_ID = 9")}, spread=True)
    assert none.log[0] == ("avaliacoes", "ignorado", enrich.NO_RATING)
    assert plan(sales(spark, str(DIR), spread=True)).count("SortMergeJoin") == 3


def test_findings_join_the_sales_once(spark, tmp_path, monkeypatch):
    """All rules read one written table of sales, whose rows are those of the join: keys that repeat, miss or are null included."""
    import __spark_entry__ as entry
    from checks import evolution
    from checks.common import sales
    from ledgerlens.operators import findings

    d = str(tmp_path)
    at = lambda m: datetime(2020 + m // 12, m % 12 + 1, 5)
    orders = [(m * 10 + k, k % 3, at(m)) for m in range(14) for k in range(6)] + [(900, None, at(3)), (901, 7, at(4)), (902, 1, None), (20, 0, at(2)), (None, 1, at(5))]
    lines = [(o, (o + n) % 4, 1.0 + n, 100.0 * (1 + 2 * (o // 10 % 2)) + o, 0.05 * n) for o, _, _ in orders if o is not None for n in range(2)]
    lines += [(11, None, 1.0, 50.0, 0.0), (11, 8, 1.0, 50.0, 0.0), (None, 1, 1.0, 50.0, 0.0), (12, 1, None, 50.0, 0.0), (13, 1, 1.0, None, 0.0), (13, 5, 1.0, 50.0, 0.0), lines[0]]
    rows = {
        "region": ([(0, "R")], "r_regionkey int, r_name string"), "nation": ([(0, "N", 0), (1, "X", 9)], "n_nationkey int, n_name string, n_regionkey int"),
        "customer": ([(0, "A", 0), (1, "B", 0), (2, None, 0), (2, None, 0), (7, "G", 1), (None, "H", 0)], "c_custkey long, c_name string, c_nationkey int"),
        "part": ([(0, "p", "t", 2.0), (1, "q", "t", 30.0), (1, "q", "t", 30.0), (2, "r", "u", 6.0), (3, "s", "u", 4.0), (5, "v", "u", None)], "p_partkey long, p_name string, p_type string, p_retailprice double"),
        "orders": (orders, "o_orderkey long, o_custkey long, o_orderdate timestamp"),
        "lineitem": (lines, "l_orderkey long, l_partkey long, l_quantity double, l_extendedprice double, l_discount double")}
    for name, (data, schema) in rows.items():
        spark.createDataFrame(data, schema).write.parquet(f"{d}/{name}.parquet")
    kept = ("id", "priority", "impact", "confidence")
    rows_of = lambda df: [tuple(r) for r in df.select(*kept).collect()]
    apart = findings.all_findings(
        findings.concentration_finding(evolution.stats(spark, d), "faturamento", True), findings.negative_findings(evolution.stats(spark, d), "customers"),
        findings.negative_findings(evolution.record_stats(spark, d), "records"), evolution.found_temporal(spark, d), evolution.found_entities(spark, d))
    want = rows_of(findings.ordered_findings(apart))
    months = set(rows_of(apart.where("scope = 'temporal'")))
    joined = []
    monkeypatch.setattr(evolution, "sales", lambda *a, **b: joined.append(b) or sales(*a, **b))
    assert rows_of(entry.queries()["findings_page"](spark, d)) == [r for r in want if r in months][10:20] and len(months) >= 20
    assert rows_of(entry.queries()["all_findings"](spark, d)) == want and len(joined) == 1
    written, columns = evolution.sold(spark, d), ["Data", "Cliente_ID", "Cliente", "Faturamento", "Custo", "Lucro", "Margem_Bruta"]
    assert "Join" not in written._jdf.queryExecution().optimizedPlan().toString()
    listed = lambda df: sorted(map(str, df.select(*columns).collect()))
    assert listed(written) == listed(sales(spark, d))


def test_lines_are_shuffled_without_texts(spark):
    """Parts are joined first and by a shuffle; of a line only its order, net and cost go on to the orders."""
    from checks.common import sales

    plan = sales(spark, DIR, parts_first=True).select("Data", "Cliente_ID", "Cliente", "Lucro")._jdf.queryExecution()
    assert plan.sparkPlan().toString().count("SortMergeJoin") == 3
    bare = re.sub(r"#\d+L?", "", plan.optimizedPlan().toString())
    assert "Project [l_orderkey, _net, (l_quantity * p_retailprice) AS _cost]\n   :  +- Join Inner, (l_partkey = p_partkey)" in bare


def test_pairs_of_months_take_one_shuffle(spark):
    """Steps and usual size of an entity come from the same rows; the size is the median of all its months, those without a successor too."""
    from ledgerlens.operators import evolution

    months = spark.createDataFrame([(1, "A", "t", o, 2, v, 2) for o, v in [(10, 5.0), (11, -7.0), (13, 0.0), (20, 100.0)]] + [(2, "B", "t", 10, 1, None, 0), (2, "B", "t", 11, 1, 3.0, 1), (None, None, "t", 10, 1, 4.0, 1)],
                                   "entity long, label string, identity_source string, ord int, records long, s_faturamento double, n_faturamento long")
    pairs = evolution.matched_pairs(months, ["faturamento"])
    assert pairs._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted((r["entity"], r["ord_before"], r["a"], r["b"], r["ref"]) for r in pairs.collect()) == [(1, 10, 5.0, -7.0, 7.0), (2, 10, None, 3.0, 3.0)]


def test_a_written_table_leaves_no_shuffle_files(spark):
    from ledgerlens import session

    def files():
        return set(re.findall(r"shuffle_\d+_\d+_\d+\.data", spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")))

    before, setting = files(), spark.conf.get(session.FREES_SHUFFLES, None)
    written = session.cut_lineage(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    until = time.time() + 10
    while files() - before and time.time() < until:
        time.sleep(0.1)
    assert not files() - before
    assert spark.conf.get(session.FREES_SHUFFLES, None) == setting and written.count() == written.count() == 7
