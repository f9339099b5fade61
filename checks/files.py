"""Files written from the given tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.session import shared_folder
from ledgerlens.sources import files, sinks

from .common import check, rounded, table


def folder(spark, d):
    path = shared_folder(spark, "files")
    part = table(spark, d, "part").select(F.col("p_partkey").alias("Produto ID"), F.col("p_name").alias("Nome"), F.col("p_retailprice").alias("Preco"))
    sinks.write_cleaned(part, f"{path}/produtos")
    return path


@check("csv_roundtrip", "SELECT count(*) AS n, count(DISTINCT p_partkey) AS ids, round(sum(p_retailprice), 2) AS total FROM part")
def roundtrip(spark, d):
    df = files.read_csv(spark, folder(spark, d) + "/produtos")
    return rounded(df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("Produto ID").alias("ids"), F.sum(F.col("Preco").try_cast("double")).alias("total")), 2)


@check("delimiter_choice", "SELECT ';' AS delimiter, CAST(3 AS BIGINT) AS width, least(20, count(*) + 1) AS lines FROM part")
def delimiter(spark, d):
    return rounded(files.delimiter_scores(files.read_records(spark, folder(spark, d) + "/produtos")).select("delimiter", "width", "lines"))


@check("grid_scan", "SELECT count(*) AS records, CAST(1 AS BIGINT) AS first_row, count(DISTINCT p_partkey) AS ids FROM part")
def grid_scan(spark, d):
    g = files.read_grid(spark, folder(spark, d) + "/produtos")
    body = g.where("cells[0] <> 'Produto ID'")
    return body.agg(F.count(F.lit(1)).alias("records"), (F.min("row_no") - 1).alias("first_row"), F.count_distinct(F.col("cells")[0]).alias("ids"))


@check("table_summary", """SELECT 'part' AS "table", count(*) AS "rows", CAST(6 AS BIGINT) AS columns FROM part UNION ALL SELECT 'orders', count(*), 6 FROM orders""")
def summary(spark, d):
    return rounded(files.table_summary({t: table(spark, d, t) for t in ("part", "orders")}).drop("names"))


@check("continuation_union", "SELECT 'a' AS t, count(*) AS n FROM orders UNION ALL SELECT 'p', count(*) FROM part")
def continuation(spark, d):
    o = table(spark, d, "orders")
    merged = files.union_continuations({"a": o.where("o_orderkey % 2 = 0"), "p": table(spark, d, "part"), "b": o.where("o_orderkey % 2 = 1")})
    out = None
    for name, df in merged.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("t"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@check("json_sink", "SELECT r_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def json_sink(spark, d):
    path = shared_folder(spark, "json")
    n, r, c = (table(spark, d, t) for t in ("nation", "region", "customer"))
    counts = c.join(n, F.expr("c_nationkey = n_nationkey")).join(r, F.expr("n_regionkey = r_regionkey")).groupBy("r_name").agg(F.count(F.lit(1)).alias("n"))
    sinks.write_json(counts.select(F.struct("r_name", "n").alias("row")), path)
    return spark.read.json(path).select("row.r_name", "row.n")


def written_lines(spark, name, lines):
    """Text lines below a fresh folder, in as many parts as their size asks for, in the order of ``at``."""
    path = f"{shared_folder(spark, name)}/{name}"
    lines.repartitionByRange("at").sortWithinPartitions("at").select("line").write.text(path)
    return path


def typed(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("at"), F.concat_ws(";", "p_partkey", F.concat(F.lit('"'), "p_name", F.lit('"')), F.format_string("%.2f", "p_retailprice")).alias("line"))


def above(spark, *lines):
    return spark.range(len(lines)).select((F.col("id") - len(lines)).alias("at"), F.get(F.array(*[F.lit(x) for x in lines]), F.col("id").cast("int")).alias("line"))


@check("csv_title_rows", "SELECT count(*) AS n, count(DISTINCT p_partkey) AS ids, round(sum(p_retailprice), 2) AS total FROM part")
def title_rows(spark, d):
    """Two title lines and a blank one above the header."""
    path = written_lines(spark, "titles", above(spark, "Relatorio mensal", "Emitido pela loja", "", "Produto;Nome;Valor").unionByName(typed(spark, d)))
    df = files.read_csv(spark, path)
    return rounded(df.agg(F.count("Nome").alias("n"), F.count_distinct("Produto").alias("ids"), F.sum(F.col("Valor").try_cast("double")).alias("total")), 2)


@check("csv_quoted_breaks", "SELECT count(*) AS n, sum(len(string_split(text, chr(10)))) AS lines, CAST(sum(length(text)) AS BIGINT) AS letters FROM documents")
def quoted_breaks(spark, d):
    """Whole documents, line ends included, as quoted fields."""
    quoted = F.concat(F.lit('"'), F.replace("text", F.lit('"'), F.lit("'")), F.lit('"'))
    lines = table(spark, d, "documents").select(F.col("doc_id").alias("at"), F.concat_ws(";", "doc_id", quoted).alias("line"))
    g = files.read_grid(spark, written_lines(spark, "breaks", lines))
    text = F.col("cells")[1]
    return g.agg(F.count(text).alias("n"), F.sum(F.size(F.split(text, "\n", -1))).alias("lines"), F.sum(F.length(text)).cast("bigint").alias("letters"))


@check("grid_latin1", "SELECT count(*) AS n, count(DISTINCT source) AS sources, CAST(sum(length(text)) AS BIGINT) AS letters, CAST(sum(length(regexp_replace(text, '[^à-ÿ]', '', 'g'))) AS BIGINT) AS accented FROM documents")
def latin1(spark, d):
    """Whole documents in a Latin-1 file, a line each; what that alphabet hasn't got is written as a question mark."""
    text = F.regexp_replace(F.translate(F.col("text"), '|"', "/'"), "[^ -~\u00a1-\u00ff]", "?")
    line = F.concat_ws("|", "source", F.concat(F.lit("="), text, F.lit("=")))
    path = f"{shared_folder(spark, 'latin')}/latin"
    table(spark, d, "documents").select(line.alias("line")).write.option("encoding", "ISO-8859-1").option("quote", "").option("sep", "\u0001").csv(path)
    g = files.read_grid(spark, path)
    read = F.col("cells")[1]
    accented = F.length(F.regexp_replace(read, "[^à-ÿ]", ""))
    return g.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.col("cells")[0]).alias("sources"), F.sum(F.length(read) - 2).cast("bigint").alias("letters"), F.sum(accented).cast("bigint").alias("accented"))


@check("many_files", "SELECT o_orderpriority AS p, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def many_files(spark, d):
    """One file per priority, each with a delimiter of its own, below one folder."""
    path = shared_folder(spark, "many")
    o = table(spark, d, "orders").select("o_orderpriority", "o_orderkey", F.format_string("%.2f", "o_totalprice").alias("v"))
    sign = F.get(F.array(F.lit(";"), F.lit("|"), F.lit("\t")), F.pmod(F.crc32("o_orderpriority"), F.lit(3)).cast("int"))
    lines = o.select("o_orderpriority", F.concat(F.col("o_orderkey"), sign, "o_orderpriority", sign, "v").alias("line"))
    lines.repartition("o_orderpriority").write.partitionBy("o_orderpriority").text(path)
    g = files.read_grid(spark, path + "/*")
    return rounded(g.groupBy(F.col("cells")[1].alias("p")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("cells")[2].try_cast("double")).alias("total")), 2)
