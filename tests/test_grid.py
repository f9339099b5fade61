"""Recovery of small report sheets."""

import pytest

from pyspark.sql import functions as F

from ledgerlens.functions import cells as cl
from ledgerlens.functions.ordered import last_known, with_chunk
from ledgerlens.operators import grid
from ledgerlens.operators.headers import top_header
from ledgerlens.sources import files, sinks, snapshots

SCHEMA = "file string, sheet string, row_no bigint, cells array<string>"


def sheet(spark, rows, name="s"):
    return spark.createDataFrame([("f", name, i, [None if c is None else str(c) for c in r]) for i, r in enumerate(rows, 1)], SCHEMA)


def test_period_and_total(spark):
    rows = [["Pedido_ID", "Data", "Faturamento", "Lucro"], ["JANEIRO", None, None, None], [1, "2025-01-01", 100, 40],
            [2, "2025-01-02", 200, 50], ["TOTAL", None, 300, 90]]
    m = grid.recover(sheet(spark, rows))["metrics"].first()
    assert (m["records"], m["periods"], m["summaries"], m["status"]) == (2, 1, 1, "accepted")


def test_headerless_repetition_and_summary_run(spark):
    rows = [[i, f"2025-01-{i % 28 + 1:02d}", f"{i}.25", "Texto", f"{i}.5"] for i in range(1, 101)]
    rows += [["TOTAL", None, None, None, "10.5"], [None, None, "99.5", None, None], ["Obs.: x", None, None, None, None]]
    r = grid.recover(sheet(spark, rows))
    types = [x["type"] for x in r["audit"].orderBy("row_no").collect()]
    assert types[:100] == ["transacao"] * 100 and types[100:] == ["total", "resumo", "comentario"]
    assert r["pattern"].first()["strong"]


def test_short_repeated_blocks(spark):
    rows = []
    for b in range(20):
        rows += [[["janeiro", "fevereiro", "marco", "abril"][b % 4], None, None, None]]
        rows += [[b * 4 + k + 1, f"2025-02-{k + 1:02d}", f"{k}.75", "Pix"] for k in range(4)] + [["Total", None, "3.5", None]]
    m = grid.recover(sheet(spark, rows))["metrics"].first()
    assert (m["records"], m["structure_confidence"], m["unknown"]) == (80, 100.0, 0)


def test_plain_table_is_left_alone(spark):
    rows = [["Codigo", "Nome", "Valor"]] + [[i, "abc", 5] for i in range(8)]
    assert not grid.report_gate(*grid.classify_first(sheet(spark, rows))).first()["is_report"]


def test_header_scores(spark):
    def found(rows):
        sample = spark.createDataFrame([("s", i + 1, r) for i, r in enumerate(rows)], "sheet string, row_no bigint, cells array<string>")
        r = top_header(sample, ["sheet"]).first()
        return r["header_row"], r["header_score"]

    assert found([["Relatorio", None, None], ["Data", "Cliente", "Valor"], ["2025-01-01", "x1", "10"]]) == (2, 100.0)
    assert found([["1", "2"], ["3", "4"]]) == (None, 0.0)
    assert found([["Alfa", "Beta"]]) == (1, 75.0)
    assert found([["Alfa", "Beta"], ["Gama", "Delta"]]) == (None, 0.0)
    assert found([["Preço Médio", "coluna_2", None], ["a", "b", "1"], ["c", "7", ""]])[0] == 1


def test_files_and_snapshots(spark, tmp_path):
    df = spark.createDataFrame([(i, f"n{i}") for i in range(30)], "Codigo int, Nome string")
    sinks.write_cleaned(df.coalesce(1), str(tmp_path / "t"))
    (tmp_path / "src").mkdir()
    part = next((tmp_path / "t").glob("part-*"))
    (tmp_path / "src" / "clientes.csv").write_text(part.read_text())
    (tmp_path / "src" / "latin.csv").write_bytes("Nome;Valor\nJo\xe3o;1\nAna;2\n".encode("latin-1"))
    tables = files.load_tables(spark, str(tmp_path / "src"))
    assert set(tables) == {"clientes", "latin"} and tables["clientes"].count() == 30
    assert {r["Nome"] for r in tables["latin"].collect()} == {"João", "Ana"}
    odd = tmp_path / "odd"
    odd.mkdir()
    (odd / "titulos.csv").write_text("\ufeffRelatorio mensal\n\nCliente,Valor,,Valor\nALFA,100\n,,,\n\"B; C\nlinha 2\",7,,9\n", encoding="utf-8")
    (odd / "dados.txt").write_text("20686\t2020-01-06\t128.7\n20687\t2020-01-07\t90\n")
    found = files.load_tables(spark, str(odd))
    assert found["titulos"].columns == ["Cliente", "Valor", "Valor_2"]
    assert {tuple(r) for r in found["titulos"].collect()} == {("ALFA", "100", None), ("B; C\nlinha 2", "7", "9")}
    assert found["dados"].columns == ["coluna_1", "coluna_2", "coluna_3"] and found["dados"].count() == 2
    (odd / "aberto.csv").write_text("Cliente,Valor\n\"sem fechamento")
    with pytest.raises(Exception, match="never closed"):
        files.load_tables(spark, str(odd))["aberto"].collect()
    status = spark.createDataFrame([(90, "saudavel")], "score int, status string")
    q = spark.createDataFrame([(1, 2, 0, 0, 90.0, "boa")], "rows long, columns long, total_nulls long, duplicates long, score double, grade string")
    k = spark.createDataFrame([("lucro_total", 1.0)], "indicador string, valor double")
    s = spark.createDataFrame([("2025-01", 1.0)], "period string, value double")
    for g in range(1, 5):
        ident = f"analysis_2025010{g}_101010000001_" + str(g) * 32
        snapshots.save_snapshot(str(tmp_path / "h"), ident, snapshots.index_record(spark, ident, ident[9:17], ["x"], k, s, q, status, []), {"kpis": k})
    page = snapshots.list_snapshots(spark, str(tmp_path / "h"), limit=2, offset=1).collect()
    assert [r["id"][16:17] for r in page] == ["3", "2"]
    assert snapshots.fetch_snapshot(spark, str(tmp_path / "h"), page[0]["id"], "kpis").count() == 1


def test_rows_of_a_long_sheet_stay_spread(spark):
    """A sheet of 100,000 rows is several chunks, and what holds for a sheet or table is brought to its rows, not they to it."""
    def plan(df):
        return df._jdf.queryExecution().sparkPlan().toString()

    g = spark.range(1, 100_001).select(
        F.lit("f").alias("file"), F.lit("s").alias("sheet"), F.col("id").alias("row_no"),
        F.array(F.col("id").cast("string"), F.lit("01/02/2020"), F.lit("R$ 1.00"), F.when(F.col("id") % 2 == 0, "US$").otherwise("R$")).alias("cells"))
    assert with_chunk(g, "row_no").select("_chunk").distinct().count() > 3
    rows = grid.described_rows(g)
    assert "SortMergeJoin" not in plan(rows) and {r["formulas"] for r in rows.limit(3).collect()} == {0}
    facts = grid.column_facts(g.withColumn("table_no", F.lit(1)))
    assert "SortAggregate" not in plan(facts)
    assert [(r["mark_a"], r["mark_b"]) for r in facts.orderBy("pos").collect()] == [(None, None)] * 3 + [("R$", "US$")]


def test_compatibility_of_equal_signatures(spark):
    df = spark.createDataFrame([(list("ND_$"), list("ND_$")), (list("N__$"), list("N__$")), (list("NDTT"), list("NDNT")), (list("ND_T"), list("NDNT")), (list("N___"), list("NDNT"))],
                               "s array<string>, r array<string>")
    assert [round(r[0], 4) for r in df.select(grid.compatibility(F.col("s"), F.col("r"))).collect()] == [1.0, 0.0, 0.75, 1.0, 0.0]


def test_blocks_count_changes_of_the_header(spark):
    """The same header again goes on with a block, another one opens the next."""
    rows = [("Pedido", "Data", "Valor", "Status")] + [(str(i), "01/02/2020", f"{i}.50", "ok") for i in range(30)]
    rows += rows[:1] + [(str(i), "01/02/2020", f"{i}.50", "ok") for i in range(30, 60)]
    rows += [("Nota", "Emissao", "Quantia", "Cliente")] + [(str(i), "01/02/2020", f"{i}.50", "ok") for i in range(60, 90)] + [("TOTAL", None, "9.00", None)]
    audit = grid.recover(spark.createDataFrame([("f", "s", i + 1, list(r)) for i, r in enumerate(rows)], "file string, sheet string, row_no long, cells array<string>"))["audit"]
    got = audit.where("type = 'transacao'").groupBy("block", "head_row").count().orderBy("head_row").collect()
    assert [tuple(r) for r in got] == [(1, 1, 30), (1, 32, 30), (2, 63, 30)]


def test_quoted_lines_are_joined_over_chunks(spark, tmp_path):
    """Records run over the ends of chunks of any length; what is read is written records, and no line is moved for each use."""
    text = 'a;b\n1;"x\n\ny"\n2;"p"\n3;"q\nr\ns\nt\nu\nv\nw"\n4;z\n5;"\n"\n'
    lines = spark.createDataFrame([("f", "UTF-8", i + 1, x) for i, x in enumerate(text.split("\n")[:-1])], "file string, encoding string, row_no long, line string")
    want = [(1, "a;b"), (2, '1;"x\n\ny"'), (3, '2;"p"'), (4, '3;"q\nr\ns\nt\nu\nv\nw"'), (5, "4;z"), (6, '5;"\n"')]
    for rows in (1, 2, 3, 5, 100):
        assert [(r["row_no"], r["line"]) for r in files._joined(lines, rows).orderBy("row_no").collect()] == want
    (tmp_path / "a.csv").write_text(text)
    (tmp_path / "b.csv").write_text("k;l\n7;8\n9;10\n")
    found = files.read_records(spark, str(tmp_path))
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r["file"][-5], r["row_no"], r["line"]) for r in found.collect()) == [("a", *w) for w in want] + [("b", 1, "k;l"), ("b", 2, "7;8"), ("b", 3, "9;10")]


def test_numbers_of_a_column_are_read_once(spark):
    """Counting numbers and amounts of money reads each cell once; both counts are those of the rules."""
    cells = ["R$ 1.00", "(5)", " (7.5) ", "1.000,5", "1,5", "12", "US$", "R$ x", "(x)", None, " ", "01/02/2020", "5%", "1.234"]
    g = spark.createDataFrame([("f", "s", 1, i, [c]) for i, c in enumerate(cells, 1)], "file string, sheet string, table_no int, row_no long, cells array<string>")
    facts = grid.column_facts(g)
    reads = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count(r"^[+-]?\d+$")
    assert reads(facts) == reads(facts.select("numbers"))
    f = facts.first()
    assert (f["filled"], f["numbers"], f["money"], f["marks"]) == (12, 6, 4, 1)
    rows = {r["row_no"]: r["money"] for r in grid.described_rows(g.drop("table_no")).select("row_no", "money").collect()}
    assert [i for i, m in sorted(rows.items()) if m] == [1, 2, 3, 4]


def test_one_scan_for_values_before_and_at_a_row(spark):
    """What counts strictly before a row and what counts at it too come from one scan of the rows, over chunks of any length."""
    v = [None, 1, None, 0, None, None, 1, None]
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(v)], "k string, o int, v int")
    for rows in (2, 3, 100):
        got = last_known(df, ["k"], "o", {"b": F.col("v"), "l": F.col("v")}, rows=rows, before=("b",))
        assert [r["l"] for r in got.orderBy("o").collect()] == [None, 1, 1, 0, 0, 0, 1, 1]
        assert [r["b"] for r in got.orderBy("o").collect()] == [None, None, 1, 1, 0, 0, 0, 1]
        assert got._jdf.queryExecution().optimizedPlan().toString().count("Window [last(_v_") == 1


def test_kinds_tell_the_numbers_of_a_column(spark):
    """Records bring the kinds of their cells, so that no cell is read again; the counts are those of reading it."""
    cells = ["R$ 1.00", "(5)", "1.000,5", "12", "US$", "R$ x", None, " ", "01/02/2020", "5%", "1.234", "=A1/2"]
    g = spark.createDataFrame([("f", "s", 1, i, [c]) for i, c in enumerate(cells, 1)], "file string, sheet string, table_no int, row_no long, cells array<string>")
    told = grid.column_facts(g.withColumn("sig", F.transform("cells", cl.cell_kind)))
    assert told.first() == grid.column_facts(g).first()
    gone = g.withColumn("sig", F.transform("cells", cl.cell_kind)).withColumn("cells", F.when(F.col("row_no") != 4, F.col("cells")).otherwise(F.array(F.lit(None).cast("string"))))
    assert (told.first()["numbers"], grid.column_facts(gone).first()["numbers"]) == (4, 3)
    held = g.withColumn("sig", F.array(F.lit("N")))
    assert r"^[+-]?\d+$" not in grid.column_facts(held)._jdf.queryExecution().optimizedPlan().toString()


def test_plain_numbers_and_dates_are_told_by_one_pattern(spark):
    """Cells of the common forms are read as the others are; days that a month lacks, blanks and line ends around them included."""
    want = {"12": ("N", 12.0), "R$ 1.50": ("N", 1.5), "US$5": ("N", 5.0), "€ 7.": ("N", 7.0), "R$  3": ("N", 3.0), " 4 ": ("N", 4.0), "-4": ("N", -4.0), "1.234": ("T", None),
            "R$ 1.2345": ("N", 1.2345), "UR$S$5": ("T", None), "12\u2028": ("T", None), "29/02/2020": ("D", None), "29/02/2021": ("T", None), "28/02/2021": ("D", None), "2020-02-30": ("T", None),
            "2020-12-28": ("D", None), "1/13/2020": ("T", None), "31/1/2020": ("D", None), "12%": ("P", None), "$": ("$", None), "": ("_", None)}
    df = spark.createDataFrame([(c,) for c in want], "c string")
    assert {r["c"]: (r["k"], r["n"]) for r in df.select("c", cl.cell_kind(F.col("c")).alias("k"), cl.parse_number(F.col("c")).alias("n")).collect()} == want
    plan = df.select(cl.is_date(F.col("c")), cl.parse_number(F.col("c")))._jdf.queryExecution().optimizedPlan().toString()
    assert cl._SIMPLE in plan and cl._SLASH_DAY in plan
