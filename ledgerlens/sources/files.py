"""Finding and reading delimited files, as tables or as raw grids."""

from __future__ import annotations

from pathlib import PurePosixPath
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ordered import with_chunk
from ..operators.headers import top_header
from ..session import cut_lineage

# File kinds, delimiters in order of preference, sample length.
PATTERN = "*.{csv,txt,tsv}"
DELIMITERS = (",", ";", "\t", "|")
SAMPLE_LINES = 20
#: Lines that are numbered and joined in one task.
CHUNK_LINES = 8_192


def find_files(spark: SparkSession, folder: str, pattern: str = PATTERN) -> DataFrame:
    """(path, name, size) sorted by name; file contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "length")
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", name.alias("name"), F.col("length").alias("size")).orderBy("name")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, split, place, raw): lines as they stand in the files, ``place`` ordering those of a split; ``file`` is the full path."""
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("place"), F.col("value").alias("raw"))


def _outside_quotes(line: Column) -> Column:
    return F.regexp_replace(line, '"[^"]*"', "")


def _count(line: Column, sign: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, sign, F.lit("")))


def line_facts(spark: SparkSession, path: str) -> DataFrame:
    """(file, encoding, open_quotes): UTF-8 if every line is valid UTF-8, else Latin-1; whether a quoted field runs over a line end."""
    return _lines(spark, path).groupBy("file").agg(
        F.when(F.bool_and(F.is_valid_utf8("raw")), "UTF-8").otherwise("ISO-8859-1").alias("encoding"),
        F.bool_or(_count(F.col("raw"), F.lit('"')) % 2 == 1).alias("open_quotes"))


def _numbered(lines: DataFrame) -> DataFrame:
    """``lines`` with ``row_no`` instead of their place, without moving a line: places in a split are consecutive, splits get the offset of those before them."""
    spans = lines.groupBy("file", "split").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut_lineage(spans.select("file", "split", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first") + 1).alias("offset")))
    return lines.join(offsets, ["file", "split"]).withColumn("row_no", F.col("place") + F.col("offset")).drop("split", "place", "offset")


def _joined(lines: DataFrame, rows: int = CHUNK_LINES) -> DataFrame:
    """(file, encoding, row_no, line): records of files whose quotes stay open over line ends.

    A record starts at the lines before which the number of quotes is even. Lines are brought together by chunks, once; a
    chunk's lines become pieces of records there, and only the pieces of records that run over a chunk's end meet again.
    """
    work = with_chunk(lines, "row_no", rows).withColumn("quotes", _count(F.col("line"), F.lit('"')))
    before = Window.partitionBy("file").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = work.groupBy("file", "_chunk").agg(F.sum("quotes").alias("n"))
    base = cut_lineage(totals.select(
        "file", "_chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), (F.sum("n").over(Window.partitionBy("file")) % 2 == 1).alias("left_open")))
    inside = Window.partitionBy("file", "_chunk").orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0)
    counted = work.join(base, ["file", "_chunk"]).withColumn("upto", F.col("base") + F.sum("quotes").over(inside))
    counted = counted.withColumn("nth", F.count_if((F.col("upto") - F.col("quotes")) % 2 == 0).over(inside))
    text = lambda order: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, "line"))), lambda x: x["line"]), "\n").alias("line")
    pieces = cut_lineage(counted.groupBy("file", "encoding", "left_open", "_chunk", "nth").agg(text("row_no")))
    starts = pieces.groupBy("file", "_chunk").agg(F.max("nth").alias("n"))
    earlier = cut_lineage(starts.select("file", "_chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier")))
    named = pieces.join(earlier, ["file", "_chunk"]).withColumn("row_no", F.col("earlier") + F.col("nth"))  # nth is 0 in what goes on with an earlier chunk's record
    broken = cut_lineage(named.where("nth = 0").select("file", "row_no").distinct())
    whole = named.join(broken, ["file", "row_no"], "left_anti").select("file", "encoding", "left_open", "row_no", "line")
    mended = named.join(broken, ["file", "row_no"], "left_semi").groupBy("file", "encoding", "left_open", "row_no").agg(text("_chunk"))
    closed = F.when(F.col("left_open"), F.raise_error(F.concat(F.lit("a quoted field is never closed in "), "file"))).otherwise(F.col("line"))
    return whole.unionByName(mended).select("file", "encoding", "row_no", closed.alias("line"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, encoding, row_no, line) of all files below ``path``: numbered records, lines of one quoted field joined.

    ``file`` is the full path, the encoding that of the file. Lines are written once, as their places hold for one reading of the files.
    """
    facts = cut_lineage(line_facts(spark, path))
    raw = _lines(spark, path).join(facts, "file")
    text = F.when(F.col("encoding") == "UTF-8", F.col("raw")).otherwise(F.decode(F.col("raw").cast("binary"), "ISO-8859-1"))
    numbered = _numbered(cut_lineage(raw.withColumn("line", F.regexp_replace(text, "^\ufeff", "")).drop("raw")))
    plain = numbered.where("not open_quotes").select("file", "encoding", "row_no", "line")
    if facts.where("open_quotes").isEmpty():
        return plain
    return plain.unionByName(_joined(numbered.where("open_quotes").drop("open_quotes")))


def delimiter_scores(records: DataFrame, sample: int = SAMPLE_LINES) -> DataFrame:
    """(file, rank, delimiter, width, lines): the most regular multi-column width of each delimiter in the first ``sample`` filled records of each file."""
    first = F.row_number().over(Window.partitionBy("file").orderBy("row_no"))
    head = records.where(F.trim("line") != "").withColumn("i", first).where(F.col("i") <= sample)
    options = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(s).alias("delimiter")) for i, s in enumerate(DELIMITERS)])
    counts = head.select("file", "line", F.inline(options)).withColumn("width", _count(_outside_quotes(F.col("line")), F.col("delimiter")) + 1).where(
        "width > 1").groupBy("file", "rank", "delimiter", "width").agg(F.count(F.lit(1)).alias("lines"))
    return counts.groupBy("file", "rank", "delimiter").agg(F.max(F.struct("lines", "width")).alias("b")).select(
        "file", "rank", "delimiter", F.col("b.width").alias("width"), F.col("b.lines").alias("lines"))


def delimiters(records: DataFrame, sample: int = SAMPLE_LINES) -> DataFrame:
    """(file, delimiter) of the files that have one; a comma is taken for the others."""
    return delimiter_scores(records, sample).groupBy("file").agg(F.min_by("delimiter", F.struct(-F.col("lines"), -F.col("width"), "rank")).alias("delimiter"))


def read_grid(spark: SparkSession, path: str) -> DataFrame:
    """(file, sheet, row_no, cells) of delimited files, before any header decision."""
    found = read_records(spark, path)
    chosen = cut_lineage(delimiters(found))
    records = found.join(chosen, "file", "left").withColumn("delimiter", F.coalesce("delimiter", F.lit(DELIMITERS[0])))
    signs = {DELIMITERS[0], *(r["delimiter"] for r in chosen.select("delimiter").distinct().collect())}  # four at most
    width = records.agg(F.max(_count(_outside_quotes(F.col("line")), F.col("delimiter")) + 1).alias("w")).first()["w"] or 1
    schema = ", ".join(f"c{i} string" for i in range(width))
    cells = F.lit(None).cast("array<string>")
    for sign in sorted(signs):
        parsed = F.from_csv("line", schema, {"sep": sign, "multiLine": "true"})
        cells = F.when(F.col("delimiter") == sign, F.array(*[parsed[f"c{i}"] for i in range(width)])).otherwise(cells)
    return records.select("file", F.lit("csv").alias("sheet"), "row_no", cells.alias("cells"))


def _names(cells: list[str | None]) -> list[str]:
    """Column names of a header row: blank ones by position, repeated ones numbered, real ones keeping their own."""
    given = [(c or "").strip() for c in cells]
    taken, names = {g for g in given if g}, []
    for i, g in enumerate(given):
        base = g if g and not g.lower().startswith("unnamed:") else f"coluna_{i + 1}"
        name, k = base, 2
        while name in names or (name != g and name in taken):
            name, k = f"{base}_{k}", k + 1
        names.append(name)
    return names


def used_columns(grid: DataFrame, plans: DataFrame) -> DataFrame:
    """(file, width, used): how wide the rows below each file's header are, and at which positions something stands.

    Rows are reduced to which of their cells are filled, of which there are few kinds, and these are counted for all files at once.
    """
    filled = F.transform("cells", lambda c: F.coalesce(F.trim(c) != "", F.lit(False)))
    body = grid.join(plans.select("file", "header_row"), "file", "left").where(F.col("row_no") > F.coalesce("header_row", F.lit(0)))
    kinds = body.groupBy("file", filled.alias("filled")).agg(F.count(F.lit(1)).alias("n"))
    each = kinds.select("file", F.size("filled").alias("size"), F.posexplode("filled").alias("pos", "there")).where("there")
    return each.groupBy("file").agg(F.max("size").alias("width"), F.array_sort(F.collect_set("pos")).alias("used"))


def table_plans(spark: SparkSession, path: str) -> tuple[DataFrame, list[Row]]:
    """The grid of all files, and per file (file, header_row, header, width, used): decided for all files at once, in as many jobs for one file as for a thousand."""
    grid = cut_lineage(read_grid(spark, path))
    head = cut_lineage(grid.where(F.col("row_no") <= SAMPLE_LINES))
    cells = head.select("file", F.col("row_no").alias("header_row"), "cells")
    plans = top_header(head, ["file"]).join(cells, ["file", "header_row"], "left").select("file", "header_row", F.col("cells").alias("header"))
    plans = cut_lineage(plans)
    plans = plans.join(used_columns(grid, plans), "file", "left")
    return grid, plans.orderBy("file").collect()  # one row per file, as there is one table per file


def _table(grid: DataFrame, plan: Row, files: list[Row]) -> DataFrame:
    """Text columns below the header of one file, or of the parts of one; empty rows and columns are left out."""
    skip = F.create_map(*[x for f in files for x in (F.lit(f["file"]), F.lit(f["header_row"] or 0))])
    body = grid.where(F.col("file").isin(*[f["file"] for f in files])).where(F.col("row_no") > skip[F.col("file")])
    body = body.where(F.exists("cells", lambda c: F.coalesce(F.trim(c) != "", F.lit(False))))
    header = list(plan["header"]) if plan["header"] else []
    width = max((f["width"] or 0 for f in files), default=0) or len(header)
    used = {i for f in files for i in f["used"] or ()}
    names = _names(header + [None] * (width - len(header)))
    kept = [i for i in range(width) if i in used or not used and i < len(header)]
    return body.select(*[F.when(F.col("cells")[i] != "", F.col("cells")[i]).alias(names[i]) for i in kept])


def read_csv(spark: SparkSession, path: str, header: bool | None = None) -> DataFrame:
    """One delimited file (or the parts of one) as a table of text columns.

    The header is found among the first rows, whatever stands above it; ragged
    rows are filled up, and fields may hold line ends. ``header`` forces the
    first row to be one or not.
    """
    grid, plans = table_plans(spark, path)
    if header is not None:
        first = {r["file"]: r["cells"] for r in grid.where("row_no = 1").select("file", "cells").collect()}
        row = 1 if header else None
        forced = spark.createDataFrame([(p["file"], row) for p in plans], "file string, header_row bigint")
        used = {r["file"]: r for r in used_columns(grid, forced).collect()}  # one row per file
        plans = [Row(file=p["file"], header_row=row, header=first.get(p["file"]) if header else None,
                     width=used[p["file"]]["width"] if p["file"] in used else None, used=used[p["file"]]["used"] if p["file"] in used else None) for p in plans]
    return _table(grid, plans[0], plans)


def table_name(path: str) -> str:
    return PurePosixPath(unquote(path)).stem


def load_tables(spark: SparkSession, folder: str, strict: bool = False) -> dict[str, DataFrame]:
    """Every file of a folder as a named table; two files of one name are an error. How to read them is decided for all at once."""
    names: dict[str, str] = {}
    found = find_files(spark, folder).select("path").collect()
    for row in found:
        name = table_name(row["path"])
        if name in names:
            raise ValueError(f"two files define table {name!r}")
        names[name] = row["path"]
    if not names:
        raise FileNotFoundError(f"no supported file in {folder}")
    grid, plans = table_plans(spark, f"{folder.rstrip('/')}/{PATTERN}")
    tables = {table_name(p["file"]): _table(grid, p, [p]) for p in plans}
    for name, df in tables.items():
        if strict and df.isEmpty():
            raise ValueError(f"table {name!r} is empty")
    if strict and set(names) - set(tables):
        raise ValueError(f"empty files: {sorted(set(names) - set(tables))}")
    return {name: tables[name] for name in names if name in tables}


def load_single(spark: SparkSession, path: str) -> DataFrame:
    """The only table of a source."""
    tables = load_tables(spark, path)
    if len(tables) != 1:
        raise ValueError(f"expected one table, found {sorted(tables)}")
    return next(iter(tables.values()))


def union_continuations(tables: dict[str, DataFrame], has_header: dict[str, bool] | None = None) -> dict[str, DataFrame]:
    """Tables with the same real header and types become one; tables without header never do."""
    out: dict[str, DataFrame] = {}
    seen: dict[tuple, str] = {}
    for name, df in tables.items():
        layout = tuple(df.dtypes)
        real = has_header.get(name, True) if has_header else not all(c.startswith("coluna_") for c in df.columns)
        if real and layout in seen:
            out[seen[layout]] = out[seen[layout]].unionByName(df)
        else:
            out[name] = df
            if real:
                seen[layout] = name
    return out


def table_summary(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, rows, columns, names)."""
    out = None
    for name, df in tables.items():
        part = df.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(name).alias("table"), "rows", F.lit(len(df.columns)).alias("columns"), F.array(*[F.lit(c) for c in df.columns]).alias("names"))
        out = part if out is None else out.unionByName(part)
    return out
