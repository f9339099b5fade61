"""Recovering transaction rows from operational reports.

Input is a grid ``(file, sheet, row_no, cells)`` with dense row numbers from 1,
plus optional ``formulas`` and ``merged`` tables. Whatever depends on earlier
rows of a sheet (summary runs, current block, period context) is expressed as
"latest event before this row" and computed by the chunked scans of
``functions.ordered``, so a long sheet is spread over many tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cells as cl
from ..functions.ordered import last_known, running_sums, with_chunk
from ..functions.text import fold
from ..session import cut_lineage
from .headers import SAMPLE, best_rows, candidate_headers, top_header

# Thresholds and weights of the row rules, reasons.
KEYS = ["file", "sheet"]
MIN_STRONG, SAME, MIN_FIELDS, MIN_SEQUENCES = 20, 0.95, 3, 2
PRESENT_SHARE, ALIKE_REPEATED, ALIKE_IN_BLOCK = 0.6, 0.85, 0.5
W_REPEAT, W_VALUE, W_FIELDS, W_BLOCK, MIN_ROW_SCORE = 0.45, 0.25, 0.2, 0.1, 0.8
OPTIONAL_MIN, OPTIONAL_CACHED = 20, 0.95
LATE_ROW, LATE_SIDE, LATE_CORE, LATE_SHARE, LATE_KIND = 20, 10, 3, 0.8, 0.9
MAX_UNKNOWN = 0.15
#: Number of the table that a sheet's continued blocks are merged into.
MERGED = -1
EMPTY, PERIOD, SUMMARY, TARGET, SUBTOTAL, TOTAL, COMMENT, SEPARATOR, HEADER, UPPER, TITLE, UNKNOWN, RECORD = (
    "vazia", "periodo", "resumo", "meta", "subtotal", "total", "comentario", "separador", "cabecalho", "cabecalho_superior",
    "titulo", "desconhecida", "transacao")
SUMMARIES = (TOTAL, SUBTOTAL, SUMMARY, TARGET)
BOUNDARIES = (PERIOD, HEADER, *SUMMARIES)
WHY_FAMILIES = "Incompatible transaction families were found."
WHY_AMBIGUOUS = "Ambiguous rows exceed the safe partial-preservation limit."
WHY_NO_PATTERN = "No dominant transaction signature reached sufficient consistency."
WHY_REGIONS = "Side-by-side regions were separated; review them before choosing or relating tables."
#: Between the name of a sheet and the number of its region.
REGION_MARK = "\u0001#"
OK_PARTIAL = "Rows were extracted partially; unknown rows remain in the audit."
OK_FULL = "Rows were extracted with a consistent structure."


def _without(sig: Column, *kinds: str) -> Column:
    return reduce(F.array_remove, kinds, sig)


def count_kinds(sig: Column, *kinds: str) -> Column:
    return F.size(sig) - F.size(_without(sig, *kinds))


def data_cells(sig: Column) -> Column:
    return F.size(_without(sig, cl.BLANK, cl.MARK))


def compatibility(sig: Column, reference: Column) -> Column:
    """Share of equal kinds among the used positions both have; 0 if too few are present."""
    used = data_cells(reference)
    pairs = F.filter(F.arrays_zip(sig.alias("s"), reference.alias("r")), lambda p: ~p["r"].isin(cl.BLANK, cl.MARK) & (p["s"] != cl.BLANK))
    present, equal = F.size(pairs), F.size(F.filter(pairs, lambda p: p["s"] == p["r"]))
    alike = F.when(used >= 2, 1.0).otherwise(0.0)  # equal ones, by far the most, are not taken apart
    return F.when(sig == reference, alike).when(present < F.greatest(F.lit(2.0), used * PRESENT_SHARE), 0.0).otherwise(F.coalesce(F.try_divide(equal, present), F.lit(0.0)))


def _empty(df: DataFrame, schema: str) -> DataFrame:
    return df.sparkSession.createDataFrame([], schema)


def described_rows(grid: DataFrame, formulas: DataFrame | None = None) -> DataFrame:
    """Row facts that need no other row: kinds, filled cells, label, period, formula marks."""
    width = cut_lineage(grid.groupBy(*KEYS).agg(F.max(F.size("cells")).alias("width")))
    full = F.transform(F.sequence(F.lit(1), F.greatest("width", F.lit(1))), lambda i: F.get(F.col("cells"), i - 1))
    padded = grid.join(width, KEYS).withColumn("cells", F.when((F.size("cells") == F.col("width")) & (F.col("width") > 0), F.col("cells")).otherwise(full)).drop("width")
    sig = F.transform("cells", cl.cell_kind)
    filled = F.filter("cells", lambda v: ~cl.blank(v))
    rows = padded.withColumn("sig", sig).withColumn("filled", filled)
    rows = rows.withColumns({
        "n_filled": F.size("filled"), "label": F.coalesce(fold(F.get(F.col("filled"), F.lit(0))), F.lit("")), "period": cl.period_of(F.col("cells")),
        "data": data_cells(F.col("sig")), "money": F.exists(F.zip_with("cells", "sig", lambda v, k: cl.money_like(v, k == cl.NUMBER)), lambda m: m)})
    if formulas is None:
        at = [*KEYS, "row_no"]
        return rows.select(*at, *[c for c in rows.columns if c not in at]).withColumns({
            "formulas": F.lit(0).cast("bigint"), "aggregate": F.lit(False), "ranged": F.lit(False), "uncached": F.array().cast("array<int>")})
    per_row = formulas.groupBy(*KEYS, "row_no").agg(
        F.count(F.lit(1)).alias("formulas"), F.bool_or(F.col("formula").rlike(cl.AGGREGATE_FORMULA)).alias("aggregate"),
        F.bool_or(F.col("formula").rlike(cl.RANGE_FORMULA)).alias("ranged"),
        F.collect_set(F.when(F.col("uncached"), F.col("col_no"))).alias("uncached"))
    return rows.join(per_row, [*KEYS, "row_no"], "left").withColumns({
        "formulas": F.coalesce("formulas", F.lit(0)), "aggregate": F.coalesce("aggregate", F.lit(False)),
        "ranged": F.coalesce("ranged", F.lit(False)), "uncached": F.coalesce("uncached", F.array().cast("array<int>"))})


def basic_type(rows: DataFrame) -> Column:
    """Type of a row from its own content; NULL where its neighbours must decide."""
    label, has_date = F.col("label"), F.array_contains("sig", cl.DATE)
    summary = (
        F.when(has_date, UNKNOWN).when(label.rlike("^(meta|target)"), TARGET).when(F.startswith(label, F.lit("subtotal")), SUBTOTAL)
        .when(F.startswith(label, F.lit("total")), TOTAL).otherwise(SUMMARY)
    )
    return (
        F.when(F.col("n_filled") == 0, EMPTY).when(F.col("aggregate") & (F.col("n_filled") <= 3), SUMMARY)
        .when(F.col("period").isNotNull(), PERIOD).when(label.rlike(cl.SUMMARY), summary)
        .when(label.rlike(cl.COMMENT) & (F.col("n_filled") <= 2), COMMENT)
        .when((F.col("n_filled") == 1) & F.get(F.col("filled"), F.lit(0)).rlike(cl.SEPARATOR), SEPARATOR)
    )


def _folded() -> Column:
    """A row's cells as one text, whatever their case and accents."""
    return F.array_join(F.transform("cells", lambda v: F.coalesce(fold(v), F.lit(""))), "\u0001")


def header_rows(rows: DataFrame, top: DataFrame) -> DataFrame:
    """(keys, row_no, score): rows that read as headers, and every repetition of such a row. ``top``: see :func:`top_header`."""
    like = F.col("type").isNull() & (count_kinds(F.col("sig"), cl.TEXT) >= 2) & ~F.array_contains("sig", cl.DATE) & ~F.array_contains("sig", cl.NUMBER)
    ends = rows.groupBy(*KEYS).agg(F.max("row_no").alias("last_row"))
    found = candidate_headers(rows, KEYS, like).join(ends, KEYS).join(top, KEYS, "left").where(
        (F.col("row_no") < F.col("last_row")) | F.coalesce(F.col("row_no") == F.col("header_row"), F.lit(False)))
    own = rows.select(*KEYS, "row_no", "n_filled", "label", "cells")
    texts = cut_lineage(found.select(*KEYS, "row_no", "score")).join(own, [*KEYS, "row_no"]).withColumn("folded", _folded())
    known = cut_lineage(texts.groupBy(*KEYS, "n_filled", "label", "folded").agg(F.max_by("score", "row_no").alias("score")))
    # Only rows that begin like a header and are as full are compared as a whole.
    alike = own.join(known.select(*KEYS, "n_filled", "label").distinct(), [*KEYS, "n_filled", "label"], "left_semi").withColumn("folded", _folded())
    return alike.join(known, [*KEYS, "n_filled", "label", "folded"]).select(*KEYS, "row_no", "score")


def header_names(rows: DataFrame, headers: DataFrame, merged: DataFrame | None = None) -> DataFrame:
    """(keys, row_no, names, score, upper): column names, joined with an upper header row where there is one."""
    cells = rows.select(*KEYS, "row_no", "cells", "n_filled")
    own = headers.join(cells.drop("n_filled"), [*KEYS, "row_no"])
    above = cells.select(*KEYS, (F.col("row_no") + 1).alias("row_no"), F.col("cells").alias("parent"), F.col("n_filled").alias("parent_filled"))
    above = above.join(headers.select(*KEYS, "row_no"), [*KEYS, "row_no"], "left_semi")
    also_header = headers.select(*KEYS, (F.col("row_no") + 1).alias("row_no"), F.lit(True).alias("stacked"))
    out = own.join(above, [*KEYS, "row_no"], "left").join(also_header, [*KEYS, "row_no"], "left")
    if merged is not None:
        wide = merged.where("row1 = row2 and col2 > col1").groupBy(*KEYS, (F.col("row1") + 1).cast("bigint").alias("row_no")).agg(
            F.collect_list(F.struct("col1", "col2")).alias("spans"))
        out = out.join(wide, [*KEYS, "row_no"], "left")
    else:
        out = out.withColumn("spans", F.lit(None).cast("array<struct<col1:int,col2:int>>"))
    start_of = lambda i: F.coalesce(F.array_max(F.transform(
        F.filter(F.col("spans"), lambda s: (s["col1"] <= i) & (i <= s["col2"])), lambda s: s["col1"])), i)
    spread = F.transform(F.sequence(F.lit(1), F.size("parent")), lambda i: F.get(F.col("parent"), start_of(i) - 1))
    out = out.withColumn("parent", F.when(F.col("spans").isNotNull(), spread).otherwise(F.col("parent")))
    upper = (F.coalesce("stacked", F.lit(False)) | F.col("spans").isNotNull()) & (F.coalesce("parent_filled", F.lit(0)) >= 2)

    def joined(p: Column, c: Column) -> Column:
        parts = F.array_distinct(F.transform(F.filter(F.array(p, c), lambda v: ~cl.blank(v)), lambda v: F.trim(v)))
        return F.when(F.size(parts) > 0, F.array_join(parts, " / "))

    names = F.when(upper, F.zip_with("parent", "cells", joined)).otherwise(F.col("cells"))
    return out.select(*KEYS, "row_no", names.alias("names"), "score", upper.alias("upper"))


def classify_first(grid: DataFrame, formulas: DataFrame | None = None, merged: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows with first types, headers with names, header of the first rows of each sheet)."""
    rows = described_rows(grid, formulas)
    rows = cut_lineage(rows.withColumn("type", basic_type(rows)).drop("filled"))
    top = cut_lineage(top_header(rows, KEYS))
    heads = cut_lineage(header_names(rows, cut_lineage(header_rows(rows, top)), merged))
    mark = heads.select(*KEYS, "row_no", "names", F.col("score").alias("header_score"))
    over = heads.where("upper").select(*KEYS, (F.col("row_no") - 1).alias("row_no"), F.lit(True).alias("is_upper"))
    rows = rows.join(mark, [*KEYS, "row_no"], "left").join(over, [*KEYS, "row_no"], "left")
    kind = F.when(F.col("is_upper"), UPPER).when(F.col("names").isNotNull(), HEADER).otherwise(F.col("type"))
    return rows.withColumn("type", kind).drop("is_upper"), heads, top


def signature_counts(rows: DataFrame) -> DataFrame:
    """(keys, sig, n, first_row) of signatures with at least two data cells."""
    return rows.where("data >= 2").groupBy(*KEYS, "sig").agg(F.count(F.lit(1)).alias("n"), F.min("row_no").alias("first_row"))


def report_gate(rows: DataFrame, heads: DataFrame, top: DataFrame) -> DataFrame:
    """(keys, is_report): does the sheet need recovery, or is it an ordinary table?"""
    first = heads.groupBy(*KEYS).agg(F.min("row_no").alias("first_head"), F.count(F.lit(1)).alias("heads"), F.bool_or("upper").alias("stacked"))
    dense = signature_counts(rows).where((F.col("n") >= 2) & (F.size(F.filter("sig", lambda k: k != cl.BLANK)) >= 3)).select(*KEYS).distinct().withColumn("dense", F.lit(True))
    facts = rows.join(top, KEYS, "left").join(first, KEYS, "left").withColumn("head", F.coalesce("first_head", "header_row"))
    lone = (F.size(_without(F.col("sig"), cl.BLANK)) == 1) & F.array_contains("sig", cl.TEXT) & (F.col("row_no") > F.coalesce("head", F.lit(0)))
    agg = facts.groupBy(*KEYS).agg(
        F.bool_or(F.coalesce(F.col("type").isin(PERIOD, TARGET, SUBTOTAL, TOTAL, SUMMARY, COMMENT, SEPARATOR, UNKNOWN), F.lit(False))).alias("a"),
        F.bool_or((F.coalesce("heads", F.lit(0)) > 1) | F.coalesce("stacked", F.lit(False)) | F.coalesce(F.col("head") > LATE_ROW, F.lit(False))).alias("b"),
        F.bool_or((F.col("formulas") > 0) | F.array_contains("sig", cl.MARK) | F.col("money")).alias("c"), F.bool_or(lone).alias("d"))
    out = agg.join(dense, KEYS, "left")
    return out.select(*KEYS, (F.col("a") | F.col("b") | F.col("c") | (F.coalesce("dense", F.lit(False)) & F.col("d"))).alias("is_report"))


def optional_columns(formulas: DataFrame) -> DataFrame:
    """(keys, optional): formula columns that are filled often enough to be optional."""
    per = formulas.groupBy(*KEYS, "col_no").agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("uncached"), 0.0).otherwise(1.0)).alias("cached"))
    return per.where((F.col("n") >= OPTIONAL_MIN) & (F.col("cached") >= OPTIONAL_CACHED)).groupBy(*KEYS).agg(F.collect_set("col_no").alias("optional"))


def _slim(rows: DataFrame) -> DataFrame:
    """``rows`` with adjusted signatures only where they may differ from the plain ones, so that few are moved and written; see :func:`_whole`."""
    return rows.withColumn("adjusted", F.when(F.size("uncached") > 0, F.col("adjusted")))


def _whole(rows: DataFrame) -> DataFrame:
    return rows.withColumn("adjusted", F.coalesce("adjusted", "sig"))


def candidates(rows: DataFrame, formulas: DataFrame | None = None) -> DataFrame:
    """Rows with the adjusted signature, the candidate mark and the number of their block."""
    if formulas is None:
        out = rows.withColumn("optional", F.array().cast("array<int>"))
    else:
        out = rows.join(cut_lineage(optional_columns(formulas)), KEYS, "left").withColumn("optional", F.coalesce("optional", F.array().cast("array<int>")))
    hide = lambda k, i: F.when(F.array_contains("uncached", i + 1) & F.array_contains("optional", i + 1), cl.BLANK).otherwise(k)
    out = out.withColumn("adjusted", F.when(F.size("uncached") > 0, F.transform("sig", hide)).otherwise(F.col("sig")))
    a = F.col("adjusted")
    mark = F.col("type").isNull() & (data_cells(a) >= MIN_FIELDS) & (
        F.array_contains(a, cl.DATE) | ((count_kinds(a, cl.NUMBER) >= 2) & (count_kinds(a, cl.TEXT) >= 1)))
    out = out.withColumn("candidate", mark)
    closes = F.coalesce(F.col("type").isin(*BOUNDARIES), F.lit(False)) | (~F.col("candidate") & F.col("ranged") & ~F.array_contains("sig", cl.DATE))
    out = _slim(out.withColumn("closes", closes))
    return _whole(running_sums(out, KEYS, "row_no", {"section": F.when(F.col("closes"), 1).otherwise(0)}).drop("closes"))


def _most_common(rows: DataFrame, keys: list[str], sig: str, alias: str) -> DataFrame:
    counts = rows.groupBy(*keys, sig).agg(F.count(F.lit(1)).alias("n"), F.min("row_no").alias("f"))
    return counts.groupBy(*keys).agg(F.max_by(sig, F.struct(F.col("n"), -F.col("f"))).alias(alias))


def sections(cand: DataFrame) -> DataFrame:
    """(keys, section, …): pattern, compatible share and strength of every run of candidate rows."""
    rows = cand.where("candidate")
    pattern = cut_lineage(_most_common(rows, [*KEYS, "section"], "adjusted", "pattern"))
    fits = compatibility(F.col("adjusted"), F.col("pattern")) >= SAME
    out = rows.join(pattern, [*KEYS, "section"]).groupBy(*KEYS, "section").agg(
        F.min("row_no").alias("start_row"), F.max("row_no").alias("end_row"), F.count(F.lit(1)).alias("candidate_rows"),
        F.count_if(fits).alias("compatible_rows")).join(pattern, [*KEYS, "section"])
    share = F.col("compatible_rows") / F.col("candidate_rows")
    return out.withColumn("compatibility", F.round(share * 100, 2)).withColumn("strong", (F.col("compatible_rows") >= MIN_STRONG) & (share >= SAME))


def sheet_pattern(cand: DataFrame, parts: DataFrame) -> DataFrame:
    """One row per sheet: dominant signature, compatibility, sequences, id and date positions, strength."""
    rows = cand.where("candidate")
    dominant = cut_lineage(_most_common(rows, KEYS, "adjusted", "dominant"))
    marked = rows.join(dominant, KEYS).withColumn("same", compatibility(F.col("adjusted"), F.col("dominant")) >= SAME)
    same = marked.where("same")
    facts = rows.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("candidates")).join(dominant, KEYS)
    before = last_known(same.select(*KEYS, "row_no", *[c for c in same.columns if c == "_chunk"]), KEYS, "row_no", {"prev": F.col("row_no")}, before=True)
    runs = before.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("equal_rows"), (1 + F.count_if(F.col("row_no") - F.col("prev") > 1)).alias("sequences"))
    values = same.select(*KEYS, "dominant", F.posexplode(F.arrays_zip("cells", "adjusted")).alias("pos", "cell")).where(
        (F.get(F.col("dominant"), F.col("pos")) == cl.NUMBER) & (F.col("cell.adjusted") == cl.NUMBER))
    number = F.trim(F.col("cell.cells")).try_cast("double")
    distinct = values.groupBy(*KEYS, "pos", number.alias("v")).agg(F.count(F.lit(1)).alias("n"))
    ids = distinct.groupBy(*KEYS, "pos").agg(
        F.sum("n").alias("n"), F.count("v").alias("distinct_values"), F.bool_and(F.coalesce(F.col("v") % 1 == 0, F.lit(False))).alias("whole"))
    ids = ids.where((F.col("n") >= MIN_STRONG) & F.col("whole") & (F.col("distinct_values") / F.col("n") >= SAME)).groupBy(*KEYS).agg(
        F.sort_array(F.collect_set(F.col("pos") + 1)).alias("id_positions"))
    clash = parts.where("strong").join(facts.select(*KEYS, "dominant"), KEYS).groupBy(*KEYS).agg(
        F.bool_or(compatibility(F.col("pattern"), F.col("dominant")) < SAME).alias("incompatible"), F.count(F.lit(1)).alias("strong_sections"))
    out = facts.join(runs, KEYS, "left").join(ids, KEYS, "left").join(clash, KEYS, "left").withColumns({
        "equal_rows": F.coalesce("equal_rows", F.lit(0)), "sequences": F.coalesce("sequences", F.lit(0)),
        "id_positions": F.when(F.col("equal_rows") >= MIN_STRONG, F.coalesce("id_positions", F.array().cast("array<int>"))).otherwise(F.array().cast("array<int>")),
        "incompatible": F.coalesce("incompatible", F.lit(False)), "strong_sections": F.coalesce("strong_sections", F.lit(0))})
    rate = F.col("equal_rows") / F.col("candidates")
    globally = (F.col("equal_rows") >= MIN_STRONG) & (rate >= SAME) & (data_cells(F.col("dominant")) >= MIN_FIELDS) & (
        F.col("sequences") >= MIN_SEQUENCES) & ~F.col("incompatible")
    out = out.withColumn("compatibility", F.round(rate * 100, 2)).withColumn("strong_global", globally)
    strong = (F.col("strong_global") | (F.col("strong_sections") > 0)) & (F.col("compatibility") >= SAME * 100) & ~F.col("incompatible")
    dates = F.filter(F.transform("dominant", lambda k, i: F.when(k == cl.DATE, i + 1)), lambda i: i.isNotNull())
    return out.withColumn("strong", strong).withColumn("date_positions", dates)


def similarity_to_common(rows: DataFrame) -> DataFrame:
    """(keys, sig, repeats, similar): how often a signature occurs and how near it is to the frequent one that is nearest.

    Frequent signatures are those that occur twice, however many there are. They are indexed by their used positions
    and kinds, and the entries that a signature shares with each are counted.
    """
    distinct = rows.groupBy(*KEYS, "sig").agg(F.count(F.lit(1)).alias("all_rows"), F.first("data").alias("data"))
    distinct = distinct.withColumn("sid", F.array_join("sig", ""))
    entries = distinct.select(*KEYS, "sid", "data", "all_rows", F.posexplode("sig").alias("pos", "kind")).where(F.col("kind") != cl.BLANK)
    frequent = entries.where("data >= 2 and all_rows >= 2").select(*KEYS, F.col("sid").alias("pid"), "pos", "kind")
    shared = entries.select(*KEYS, "sid", "pos", "kind").join(frequent, [*KEYS, "pos", "kind"]).groupBy(*KEYS, "sid", "pid").agg(F.count(F.lit(1)).alias("n"))
    best = shared.groupBy(*KEYS, "sid").agg(F.max("n").alias("n"))
    some = frequent.select(*KEYS).distinct().withColumn("some", F.lit(True))
    blanks = F.size(F.filter("sig", lambda k: k == cl.BLANK))
    near = (F.coalesce("n", F.lit(0)) + blanks) / F.greatest(F.lit(1), F.size("sig"))
    return distinct.join(best, [*KEYS, "sid"], "left").join(some, KEYS, "left").select(
        *KEYS, "sig", F.when(F.col("data") >= 2, F.col("all_rows")).otherwise(0).alias("repeats"), F.when(F.col("some"), near).otherwise(0.0).alias("similar"))


def mark_summary_runs(cand: DataFrame, pattern: DataFrame) -> DataFrame:
    """Sparse numeric rows after a summary row belong to the summary, until records resume.

    A row is inside a run if the latest event before it opened one. Rows that
    would themselves be absorbed change nothing, whichever state they meet.

    Headers and periods are never absorbed, so the block number, the last header
    and the period context of every row come from the same ordered scan.
    """
    rows = cand.join(pattern.select(*KEYS, "dominant", "strong", "id_positions", "date_positions"), KEYS, "left").withColumn("strong", F.coalesce("strong", F.lit(False)))
    at = lambda positions, kind: F.exists(F.coalesce(positions, F.array().cast("array<int>")), lambda p: F.get(F.col("sig"), p - 1) == kind)
    identified = at(F.col("id_positions"), cl.NUMBER) | at(F.col("date_positions"), cl.DATE)
    asked = (F.col("strong") & F.col("aggregate")) | (F.col("data") <= 3)  # most rows are told without it
    rows = rows.withColumn("identified", asked & identified)
    totals = F.col("strong") & F.col("aggregate") & ~F.col("identified")
    kind = F.when(totals, TOTAL).otherwise(F.col("type"))
    absorbable = kind.isNull() & (F.col("data") <= 3) & ~F.array_contains("sig", cl.DATE) & (
        F.array_contains("sig", cl.NUMBER) | F.array_contains("sig", cl.PERCENT) | (F.col("formulas") > 0)) & ~F.col("identified")
    opens = F.coalesce(kind.isin(*SUMMARIES), F.lit(False))
    closes = F.coalesce(kind.isin(PERIOD, HEADER), F.lit(False)) | (
        kind.isNull() & ~absorbable & (compatibility(F.col("adjusted"), F.col("dominant")) >= SAME))
    # Blocks are counted on the header rows alone, so that all rows are scanned in order once for what lies above them.
    name_text = F.array_join(F.transform("names", lambda v: F.coalesce(fold(v), F.lit(""))), "\u0001")
    marks = cut_lineage(rows.where((F.col("type") == HEADER) & (kind == HEADER)).select(*KEYS, "row_no", name_text.alias("head_text")))
    marks = last_known(marks, KEYS, "row_no", {"prev_head": F.col("head_text")}, before=True)
    starts = F.col("prev_head").isNull() | (F.col("prev_head") != F.col("head_text"))
    marks = running_sums(marks, KEYS, "row_no", {"own_block": F.when(starts, 1).otherwise(0)}).drop("prev_head")
    rows = _slim(rows.withColumns({"type": kind, "absorbable": absorbable, "event": F.when(opens, 1).when(closes, 0)}).drop("identified"))
    rows = rows.join(cut_lineage(marks), [*KEYS, "row_no"], "left")
    rows = last_known(rows, KEYS, "row_no", {
        "state": F.col("event"), "block": F.col("own_block"), "context": F.when(F.col("type") == PERIOD, F.col("period")),
        "head_row": F.when(F.col("type") == HEADER, F.col("row_no"))}, before=("state",))
    inside = F.col("strong") & F.col("absorbable") & F.coalesce(F.col("state") == 1, F.lit(False))
    return _whole(rows.withColumns({"type": F.when(inside, SUMMARY).otherwise(F.col("type")), "block": F.coalesce("block", F.lit(0))}).drop(
        "event", "state", "absorbable", "own_block"))


def classify_rows(rows: DataFrame, heads: DataFrame, parts: DataFrame, top: DataFrame, alike: DataFrame) -> DataFrame:
    """Final type and score of every row. ``rows``: see :func:`mark_summary_runs`; ``alike``: see :func:`similarity_to_common`."""
    first = heads.groupBy(*KEYS).agg(F.min("row_no").alias("first_head")).join(top, KEYS, "full")
    first = cut_lineage(first.select(*KEYS, F.coalesce("first_head", "header_row").alias("head")))
    strong_rows = parts.where("strong").select(*KEYS, "section", F.col("pattern").alias("section_pattern"))
    rows = rows.join(first, KEYS, "left").join(alike, [*KEYS, "sig"]).join(strong_rows, [*KEYS, "section"], "left")
    in_section = F.col("candidate") & F.col("section_pattern").isNotNull() & (compatibility(F.col("adjusted"), F.col("section_pattern")) >= SAME)
    in_global = F.col("candidate") & F.coalesce("strong_global", F.lit(False)) & (compatibility(F.col("adjusted"), F.col("dominant")) >= SAME)
    rows = rows.withColumn("firm", F.coalesce(in_section | in_global, F.lit(False)))
    valued = F.array_contains("sig", cl.DATE) | F.array_contains("sig", cl.NUMBER)
    repeated = (F.col("repeats") >= 2) | (F.col("similar") >= ALIKE_REPEATED)
    open_row = F.col("type").isNull()
    title = open_row & F.coalesce(F.col("row_no") < F.col("head"), F.lit(False)) & (F.col("data") <= 1)
    thin = F.col("strong") & (F.col("data") < F.greatest(F.lit(float(MIN_FIELDS)), data_cells(F.col("dominant")) * 0.6))
    fine_gaps = F.col("strong") & F.col("firm") & F.forall("uncached", lambda c: F.array_contains("optional", c))
    broken = (F.size("uncached") > 0) & ~fine_gaps
    rows = rows.withColumns({
        "base_score": F.when(repeated, W_REPEAT).otherwise(0.0) + F.when(valued, W_VALUE).otherwise(0.0) + F.when(F.col("data") >= 2, W_FIELDS).otherwise(0.0),
        "blocked": F.coalesce(title | thin | broken, F.lit(False)), "title": F.coalesce(title, F.lit(False))})
    free = open_row & ~F.col("blocked") & ((F.col("strong") & F.col("firm")) | (F.col("base_score") >= MIN_ROW_SCORE))
    carried = open_row & ~F.col("blocked") & (F.col("data") >= 2) & valued & (F.col("similar") >= ALIKE_IN_BLOCK)
    # Written out here: what follows refers to these marks many times over.
    rows = _whole(cut_lineage(_slim(rows.withColumns({"free": F.coalesce(free, F.lit(False)), "carried": F.coalesce(carried, F.lit(False))}).drop(
        "section_pattern", "repeats", "similar", "blocked", "dominant", "id_positions", "date_positions", "optional", "head"))))
    begin = cut_lineage(rows.where(F.col("free") | (F.col("type") == HEADER)).groupBy(*KEYS).agg(F.min("row_no").alias("begin")))
    rows = rows.join(begin, KEYS, "left").withColumn("in_block", F.coalesce(F.col("row_no") > F.col("begin"), F.lit(False)))
    rows = rows.withColumn("eligible", F.col("free") | (F.col("in_block") & F.col("carried"))).drop("free", "carried", "begin")
    earliest = cut_lineage(rows.where("eligible").groupBy(*KEYS, "block").agg(F.min("row_no").alias("row_no")))
    anchor = cut_lineage(rows.join(earliest, [*KEYS, "block", "row_no"], "left_semi").select(*KEYS, "block", F.col("sig").alias("anchor")))
    rows = rows.join(anchor, [*KEYS, "block"], "left")
    differs = lambda a, b: (a != b) & (a != cl.BLANK) & (b != cl.BLANK)
    conflicts = F.when(F.col("sig") == F.col("anchor"), 0).otherwise(F.size(F.filter(F.zip_with("sig", "anchor", differs), lambda x: x)))
    allowed = F.greatest(F.lit(1), F.floor(F.col("data") / 3))
    clash = ~(F.col("strong") & F.col("firm")) & F.coalesce(conflicts > allowed, F.lit(False))
    final = (
        F.when(~open_row, F.col("type")).when(F.col("title"), TITLE).when(F.col("eligible") & ~clash, RECORD).otherwise(UNKNOWN)
    )
    score = F.round((F.col("base_score") + F.when(F.col("in_block"), W_BLOCK).otherwise(0.0)) * 100, 2)
    return rows.withColumn("type", final).withColumn(
        "confidence", F.when(F.col("type") == RECORD, score).when(F.col("type") == UNKNOWN, 0.0).otherwise(100.0)).drop("anchor", "eligible", "in_block", "title", "base_score")


def late_headers(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """(keys, head_row, position, label, kinds and shares before/after, valid, allowed, confidence).

    Records are assigned to the segment between two late headers; kinds are
    counted per segment and column, and running totals over the segments give
    what lies before and after each header, so that the work grows with the
    number of headers and not with its square.
    """
    late = heads.where(F.col("row_no") > LATE_ROW).select(*KEYS, F.col("row_no").alias("head_row"), "names", F.col("score").alias("head_score"))
    marks = rows.join(late.select(*KEYS, F.col("head_row").alias("row_no"), F.lit(1).alias("mark")), [*KEYS, "row_no"], "left")
    marks = running_sums(marks, KEYS, "row_no", {"segment": F.coalesce("mark", F.lit(0))})
    numbered = marks.where("mark = 1").select(*KEYS, F.col("row_no").alias("head_row"), "segment")
    records = marks.where(F.col("type") == RECORD)
    sized = records.groupBy(*KEYS, "segment").agg(F.count(F.lit(1)).alias("n"))
    kinds = records.select(*KEYS, "segment", F.posexplode("sig").alias("pos", "kind")).where(F.col("kind") != cl.BLANK).groupBy(
        *KEYS, "segment", "pos", "kind").agg(F.count(F.lit(1)).alias("n"))
    # A header's rows before it are the running total of the segments before its own, those after it the rest of the total.
    # Every late header opens the segment of its number, so the segments that a total is wanted for are the headers' own.
    def both_sides(counts: DataFrame, keys: list[str]) -> DataFrame:
        wanted = counts.select(*keys).distinct().join(numbered.select(*KEYS, "segment", "head_row"), KEYS)
        joined = wanted.join(counts, [*keys, "segment"], "full")
        summed = running_sums(joined, keys, "segment", {"upto": F.coalesce("n", F.lit(0))})
        total = counts.groupBy(*keys).agg(F.sum("n").alias("total"))
        before = F.col("upto") - F.coalesce("n", F.lit(0))
        return summed.where(F.col("head_row").isNotNull()).join(total, keys).select(*keys, "head_row", before.alias("b"), (F.col("total") - before).alias("a"))

    sides = both_sides(sized, KEYS).select(*KEYS, "head_row", F.col("b").alias("rows_before"), F.col("a").alias("rows_after"))
    per = both_sides(kinds, [*KEYS, "pos", "kind"])
    stats = per.groupBy(*KEYS, "head_row", "pos").agg(
        F.max_by("kind", "b").alias("kind_before"), F.max("b").alias("bmax"), F.sum("b").alias("bsum"),
        F.max_by("kind", "a").alias("kind_after"), F.max("a").alias("amax"), F.sum("a").alias("asum")).where("asum > 0")
    optional = F.col("bsum") == 0
    share_b = F.when(optional, 1.0).otherwise(F.try_divide(F.col("bmax"), F.col("bsum")))
    share_a = F.col("amax") / F.col("asum")
    fits = (optional | (F.col("kind_before") == F.col("kind_after"))) & (share_a >= LATE_KIND) & (optional | (share_b >= LATE_KIND))
    columns = stats.select(*KEYS, "head_row", "pos", optional.alias("optional"), F.when(~optional, F.col("kind_before")).alias("kind_before"), "kind_after",
                           F.round(share_b, 4).alias("share_before"), F.round(share_a, 4).alias("share_after"), fits.alias("compatible"))
    verdict = columns.where("not optional").groupBy(*KEYS, "head_row").agg(
        ((F.count(F.lit(1)) >= LATE_CORE) & (F.avg(F.when(F.col("compatible"), 1.0).otherwise(0.0)) >= LATE_SHARE)).alias("valid"))
    labels = late.select(*KEYS, "head_row", "head_score", F.posexplode("names").alias("pos", "label"))
    out = columns.join(labels, [*KEYS, "head_row", "pos"]).join(verdict, [*KEYS, "head_row"], "left").join(sides, [*KEYS, "head_row"]).where(
        (F.col("rows_before") >= LATE_SIDE) & (F.col("rows_after") >= LATE_SIDE))
    allowed = F.coalesce("valid", F.lit(False)) & F.col("compatible")
    sure = F.least(F.col("head_score"), F.col("share_before") * 100, F.col("share_after") * 100)
    return out.select(*KEYS, "head_row", (F.col("pos") + 1).alias("position"), "label", "kind_before", "kind_after", "share_before", "share_after", "optional",
                      F.coalesce("valid", F.lit(False)).alias("valid"), allowed.alias("allowed"), F.when(allowed, F.round(sure, 2)).otherwise(0.0).alias("confidence"))


def merge_continuations(rows: DataFrame) -> DataFrame:
    """Blocks of one strong layout are one table if some have no header and at most one real header exists."""
    used = rows.where(F.col("type") == RECORD).groupBy(*KEYS, "block").agg(F.count(F.lit(1)).alias("n"), F.first("strong").alias("strong"))
    names = rows.where(F.col("type") == HEADER).groupBy(*KEYS, "block").agg(F.min("head_text").alias("names"))
    facts = used.join(names, [*KEYS, "block"], "left").groupBy(*KEYS).agg(
        (F.bool_or("strong") & (F.count(F.lit(1)) > 1) & F.bool_or(F.col("names").isNull()) & (F.count_distinct("names") <= 1)).alias("merge"))
    return rows.join(cut_lineage(facts), KEYS, "left").withColumn("table_no", F.when(F.coalesce("merge", F.lit(False)), F.lit(MERGED)).otherwise(F.col("block"))).drop("merge")


def sheet_metrics(rows: DataFrame, pattern: DataFrame, plan: DataFrame | None = None) -> DataFrame:
    """One row per sheet: counts by type, coverage, confidence, status and reason.

    A sheet needs review as well if a column of its ``plan`` does, and if it is one of several regions of a sheet.
    """
    n = lambda *t: F.count_if(F.col("type").isin(*t))
    agg = rows.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("rows"), n(RECORD).alias("records"), n(*SUMMARIES).alias("summaries"), n(PERIOD).alias("periods"), n(EMPTY).alias("empty"),
        n(UNKNOWN).alias("unknown"), n(RECORD, *SUMMARIES, PERIOD, HEADER, UPPER, TITLE, COMMENT, SEPARATOR).alias("recognised"))
    out = agg.join(pattern.select(*KEYS, F.col("compatibility").alias("c"), F.col("strong").alias("s"), F.col("incompatible").alias("i")), KEYS, "left").withColumns({
        "compatibility": F.coalesce("c", F.lit(0.0)), "strong": F.coalesce("s", F.lit(False)), "incompatible": F.coalesce("i", F.lit(False)),
        "content": F.greatest(F.lit(1), F.col("rows") - F.col("empty"))}).drop("c", "s", "i")
    share = F.col("unknown") / F.col("content")
    safe = F.col("strong") & (F.col("records") >= MIN_STRONG) & (F.col("compatibility") >= 95) & ~F.col("incompatible") & (share <= MAX_UNKNOWN)
    doubtful = plan.where("review").select(*KEYS).distinct().withColumn("doubtful", F.lit(True)) if plan is not None else _empty(rows, "file string, sheet string, doubtful boolean")
    out = out.join(doubtful, KEYS, "left")
    regional = F.contains("sheet", F.lit(REGION_MARK))
    review = F.col("incompatible") | ((F.col("unknown") > 0) & ~safe) | F.coalesce("doubtful", F.lit(False)) | regional
    reasons = F.array_compact(F.array(
        F.when(regional, WHY_REGIONS),
        F.when(F.col("incompatible"), WHY_FAMILIES), F.when((F.col("unknown") > 0) & ~safe, WHY_AMBIGUOUS),
        F.when(~F.col("strong") & (F.col("records") >= MIN_STRONG), WHY_NO_PATTERN)))
    return out.select(
        *KEYS, "rows", "records", "summaries", "periods", "empty", "unknown", "content",
        F.round((F.col("rows") - F.col("unknown")) / F.col("rows") * 100, 2).alias("recognised_percent"),
        F.round(F.col("records") / F.greatest(F.lit(1), F.col("records") + F.col("unknown")) * 100, 2).alias("structural_confidence"),
        F.round(F.col("recognised") / F.col("content") * 100, 2).alias("classified_coverage"),
        F.round(F.col("records") / F.col("content") * 100, 2).alias("record_coverage"),
        F.when(F.col("strong"), F.col("compatibility")).otherwise(0.0).alias("structure_confidence"),
        F.round((1 - share) * 100, 2).alias("file_confidence"), review.alias("review_required"),
        F.when(review, "review_required").when(F.col("unknown") > 0, "partial").otherwise("accepted").alias("status"),
        F.when(F.size(reasons) > 0, F.array_join(reasons, "; ")).when(F.col("unknown") > 0, OK_PARTIAL).otherwise(OK_FULL).alias("reason"))


def unknown_regions(rows: DataFrame, examples: int = 3, width: int | None = 5) -> DataFrame:
    """(keys, start_row, end_row, n, examples): consecutive unknown rows with the first cells of a few of them; all cells if ``width`` is None."""
    shown_cells = F.col("cells") if width is None else F.slice("cells", 1, width)
    unknown = last_known(rows.where(F.col("type") == UNKNOWN), KEYS, "row_no", {"prev": F.col("row_no")}, before=True)
    broke = F.when(F.col("prev").isNull() | (F.col("row_no") > F.col("prev") + 1), 1).otherwise(0)
    numbered = running_sums(unknown, KEYS, "row_no", {"region": broke})
    first = numbered.groupBy(*KEYS, "region").agg(F.min("row_no").alias("start_row"), F.max("row_no").alias("end_row"), F.count(F.lit(1)).alias("n"))
    shown = numbered.join(first.select(*KEYS, "region", "start_row"), [*KEYS, "region"]).where(F.col("row_no") < F.col("start_row") + examples).groupBy(*KEYS, "region").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("row_no", shown_cells.alias("cells")))), lambda r: r["cells"]).alias("examples"))
    return first.join(shown, [*KEYS, "region"]).drop("region")


def detected_blocks(rows: DataFrame) -> DataFrame:
    """(keys, table_no, start, end, records, coverage) of the extracted tables."""
    out = rows.where(F.col("type") == RECORD).groupBy(*KEYS, "table_no").agg(
        F.min("row_no").alias("start_row"), F.max("row_no").alias("end_row"), F.count(F.lit(1)).alias("records"),
        F.min_by("adjusted", "row_no").alias("signature"))
    return out.withColumn("coverage", F.round(F.col("records") / (F.col("end_row") - F.col("start_row") + 1) * 100, 2))


def review_detail(metrics: DataFrame) -> DataFrame:
    """One row over all sheets: what a user sees when the structure needs review."""
    return metrics.agg(
        F.min("structural_confidence").alias("confidence"), F.min(F.when(F.col("review_required"), F.col("reason"))).alias("reason"),
        F.sum("content").alias("content_rows"), F.sum("records").alias("record_rows"), F.sum("unknown").alias("unknown_rows"))


def records_of(audit: DataFrame) -> DataFrame:
    """The audit's records. Cells whose formula has no stored value are NULL here; the audit keeps what stands there."""
    known = F.transform("cells", lambda v, i: F.when(~F.array_contains("uncached", i + 1), v))
    return audit.where(F.col("type") == RECORD).withColumn("cells", F.when(F.size("uncached") > 0, known).otherwise(F.col("cells")))


def unavailable_formulas(audit: DataFrame, formulas: DataFrame) -> DataFrame:
    """(keys, row_no, col_no, formula): formulas of records that have no stored value."""
    rows = audit.where((F.col("type") == RECORD) & (F.size("uncached") > 0)).select(*KEYS, "row_no")
    return formulas.where("uncached").join(rows, [*KEYS, "row_no"]).select(*KEYS, "row_no", "col_no", "formula")


def column_facts(records: DataFrame) -> DataFrame:
    """(keys, table_no, pos, …) counts that decide what happens to each column of a table. Numbers are told by the kinds, where ``sig`` has them."""
    kinds = [F.col("sig")] if "sig" in records.columns else []
    cells = records.select(*KEYS, "table_no", *kinds, F.posexplode("cells").alias("pos", "v"))
    full = ~cl.blank(F.col("v"))
    marks = sorted(cl.CURRENCY)
    mark = F.trim("v").isin(*marks)
    order = F.when(full & mark, F.array_position(F.array(*[F.lit(m) for m in marks]), F.trim("v")).cast("int"))  # a number, as sums of texts are sorted
    named = lambda i: F.get(F.array(*[F.lit(m) for m in marks]), F.col(i) - 1)
    number = F.col("v").isNotNull() & (F.get(F.col("sig"), F.col("pos")) == cl.NUMBER) if kinds else cl.parse_number(F.col("v")).isNotNull()
    cells = cells.withColumn("number", number)  # read once for both counts
    return cells.groupBy(*KEYS, "table_no", "pos").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(full).alias("filled"), F.count_if(full & mark).alias("marks"),
        F.count_if(full & F.col("number")).alias("numbers"), F.count_if(full & (F.contains("v", F.lit(",")) | F.contains("v", F.lit(".")))).alias("explicit"),
        F.count_if(full & cl.money_like(F.col("v"), F.col("number"))).alias("money"), F.min(order).alias("mark_a"), F.max(order).alias("mark_b")).withColumns({"mark_a": named("mark_a"), "mark_b": named("mark_b")})


def column_plan(records: DataFrame, heads: DataFrame) -> DataFrame:
    """(keys, table_no, pos, name, action, review): keep, parse, drop or empty, and the final column name."""
    facts = column_facts(records)
    w = Window.partitionBy(*KEYS, "table_no").orderBy("pos")
    marks = (F.col("filled") > 0) & (F.col("marks") == F.col("filled"))
    amount = (F.col("filled") > 0) & (F.col("numbers") == F.col("filled"))
    facts = facts.withColumns({"is_mark": marks, "is_amount": amount})
    near = lambda f: (f(F.col("is_amount")).over(w), f(F.col("explicit")).over(w))
    (pa, pe), (na, ne) = near(F.lag), near(F.lead)
    facts = facts.withColumns({"pa": F.coalesce(pa, F.lit(False)), "na": F.coalesce(na, F.lit(False)), "pe": F.coalesce(pe, F.lit(0)) > 0, "ne": F.coalesce(ne, F.lit(0)) > 0})
    both = F.col("pa") & F.col("na")
    target = (
        F.when(~F.col("is_mark"), None).when(both & F.col("pe") & ~F.col("ne"), -1).when(both & F.col("ne") & ~F.col("pe"), 1)
        .when(both, None).when(F.col("pa"), -1).when(F.col("na"), 1)
    )
    facts = facts.withColumn("target", target)
    claimed = F.coalesce(F.lag("target").over(w) == 1, F.lit(False)) | F.coalesce(F.lead("target").over(w) == -1, F.lit(False))
    mixed = F.col("is_mark") & ((F.col("mark_a") != F.col("mark_b")) | F.col("target").isNull())
    action = (
        F.when(F.col("target").isNotNull(), "drop").when(F.col("filled") == 0, "empty").when(claimed | ((F.col("money") > 0) & F.col("is_amount")), "parse").otherwise("keep")
    )
    review = mixed | ((F.col("money") > 0) & ~F.col("is_amount"))
    facts = facts.withColumn("action", action).withColumn("review", F.coalesce(review, F.lit(False)))
    named = heads.select(*KEYS, F.col("row_no"), F.posexplode("names").alias("pos", "label"))
    # a table made of blocks without a header takes no names from a header that stands later
    start = records.where(F.col("table_no") != MERGED).groupBy(*KEYS, "table_no").agg(F.max("head_row").alias("row_no"))
    labels = named.join(start, [*KEYS, "row_no"]).select(*KEYS, "table_no", "pos", F.trim("label").alias("label"))
    return clean_names(facts.join(labels, [*KEYS, "table_no", "pos"], "left"))


def clean_names(plan: DataFrame) -> DataFrame:
    """Final column names: neutral where missing, numbered where repeated."""
    usable = (F.col("label") != "") & ~F.startswith(F.lower("label"), F.lit("unnamed:"))
    base = F.coalesce(F.when(usable, F.col("label")), F.concat(F.lit("coluna_"), F.col("pos") + 1))
    w = Window.partitionBy(*KEYS, "table_no", "base", F.col("action").isin("drop", "empty")).orderBy("pos")
    out = plan.withColumn("base", base).withColumn("nth", F.row_number().over(w))
    name = F.when(F.col("nth") > 1, F.concat("base", F.lit("_"), F.col("nth"))).otherwise(F.col("base"))
    return out.select(
        *KEYS, "table_no", "pos", name.alias("name"), "action", "review", "filled", "rows",
        (1 - F.col("filled") / F.col("rows") >= 0.95).alias("mostly_null"), (F.coalesce("label", F.lit("")) != name).alias("renamed"))


def table_of(records: DataFrame, plan: DataFrame, file: str, sheet: str, table_no: int) -> DataFrame:
    """One recovered table with its column names; the plan of one table is schema-sized."""
    here = (F.col("file") == file) & (F.col("sheet") == sheet) & (F.col("table_no") == table_no)
    columns = plan.where(here).orderBy("pos").collect()
    out = [F.col("row_no")]
    for c in columns:
        cell = F.get(F.col("cells"), F.lit(c["pos"]))
        if c["action"] == "parse":
            out.append(cl.parse_number(cell).alias(c["name"]))
        elif c["action"] == "keep":
            out.append(F.when(~cl.blank(cell), cell).alias(c["name"]))
    return records.where(here).select(*out)


def lateral_regions(grid: DataFrame) -> DataFrame:
    """(keys, region, first_col, last_col, header_row) of sheets that hold several tables side by side.

    Active columns are found by one aggregation; a sheet is split if empty
    corridors separate regions of two or more columns whose headers start on
    different rows.
    """
    used = F.transform("cells", lambda v: ~cl.blank(v))  # few different ones, so they are counted before they are taken apart
    cells = grid.groupBy(*KEYS, used.alias("used")).agg(F.count(F.lit(1)).alias("n")).select(*KEYS, F.posexplode("used").alias("pos", "v")).where("v").select(*KEYS, "pos").distinct()
    w = Window.partitionBy(*KEYS).orderBy("pos")
    runs = cells.withColumn("run", F.col("pos") - F.row_number().over(w)).groupBy(*KEYS, "run").agg(F.min("pos").alias("first_col"), F.max("pos").alias("last_col"))
    runs = cut_lineage(runs)
    several = runs.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.min(F.col("last_col") - F.col("first_col")).alias("least")).where("n > 1 and least > 0").select(*KEYS)
    if several.isEmpty():  # no sheet has two regions, so no header has to be judged
        return _empty(grid, "file string, sheet string, first_col int, last_col int, header_row bigint, region int")
    runs = runs.join(several, KEYS, "left_semi")
    inside = F.transform(F.sequence(F.col("first_col"), F.col("last_col")), lambda i: F.get(F.col("cells"), i))
    sample = runs.join(grid.where(F.col("row_no") <= SAMPLE), KEYS).select(*KEYS, "first_col", "last_col", "row_no", inside.alias("cells"))
    found = best_rows(sample, [*KEYS, "first_col", "last_col"], "row_no").select(*KEYS, "first_col", F.col("row_no").alias("header_row"))
    scored = runs.select(*KEYS, "first_col", "last_col").join(found, [*KEYS, "first_col"], "left")
    facts = scored.groupBy(*KEYS).agg(
        ((F.count(F.lit(1)) > 1) & F.bool_and(F.col("last_col") > F.col("first_col")) & (F.count("header_row") == F.count(F.lit(1)))
         & (F.count_distinct("header_row") > 1)).alias("split"))
    order = Window.partitionBy(*KEYS).orderBy("first_col")
    return scored.join(facts.where("split").select(*KEYS), KEYS).withColumn("region", F.row_number().over(order))


def split_regions(grid: DataFrame, regions: DataFrame) -> DataFrame:
    """Rows of split sheets once per region (the sheet's name, ``REGION_MARK`` and a number) with the cells of that region; other sheets unchanged."""
    slim = regions.select(*KEYS, "region", "first_col", "last_col")
    cut = F.transform(F.sequence(F.col("first_col"), F.col("last_col")), lambda i: F.get(F.col("cells"), i))
    joined = grid.join(slim, KEYS, "left")
    return joined.select(
        "file", F.when(F.col("region").isNotNull(), F.concat("sheet", F.lit(REGION_MARK), "region")).otherwise(F.col("sheet")).alias("sheet"), "row_no",
        F.when(F.col("region").isNotNull(), cut).otherwise(F.col("cells")).alias("cells"))


def plain_tables(grid: DataFrame, audit: DataFrame, sheets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, headers) of ``sheets`` that are ordinary tables, in the form that :func:`column_plan` and :func:`table_of` take."""
    plain = grid.join(sheets, KEYS, "left_semi").join(audit.select(*KEYS).distinct(), KEYS, "left_anti")
    top = top_header(plain, KEYS)
    rows = plain.join(top, KEYS, "left").where(F.col("row_no") > F.coalesce("header_row", F.lit(0)))
    records = rows.where(F.exists("cells", lambda v: ~cl.blank(v))).select(
        *KEYS, "row_no", "cells", F.col("header_row").cast("bigint").alias("head_row"), F.lit(0).cast("bigint").alias("table_no"))
    heads = plain.join(top, KEYS).where("row_no = header_row").select(*KEYS, "row_no", F.col("cells").alias("names"))
    return records, heads


def recover(grid: DataFrame, formulas: DataFrame | None = None, merged: DataFrame | None = None) -> dict[str, DataFrame]:
    """All steps: audit rows, headers, sections, pattern, records, column plan and metrics per sheet.

    A sheet of several tables side by side is cut into its regions first, and each region is a sheet of its own from
    there on; a region's columns hang together, so that it can't be cut again. Formulas and merged ranges belong to
    whole sheets and are not used in regions. Sheets that are ordinary tables are left out of the audit, see
    :func:`report_gate`; ordinary tables among the regions are in ``region_records``.
    """
    regions = cut_lineage(lateral_regions(grid))
    split = not regions.isEmpty()
    if split:
        grid = cut_lineage(split_regions(grid, regions))
    rows, heads, top = classify_first(grid, formulas, merged)
    gate = cut_lineage(report_gate(rows, heads, top).where("is_report").select(*KEYS))
    cand = _whole(cut_lineage(_slim(candidates(with_chunk(rows.drop("money", "label").join(gate, KEYS, "left_semi"), "row_no"), formulas))))  # the scans from here on share their chunks
    parts = cut_lineage(sections(cand))
    pattern = cut_lineage(sheet_pattern(cand, parts))
    marked = mark_summary_runs(cand, pattern).join(pattern.select(*KEYS, "strong_global"), KEYS, "left")
    audit = classify_rows(marked, heads, parts, top, cut_lineage(similarity_to_common(cand)))
    audit = merge_continuations(_whole(cut_lineage(_slim(audit.drop("_chunk")))))  # adds what holds for a sheet
    records = records_of(audit)
    plan = cut_lineage(column_plan(records, heads))
    out = {"audit": audit, "headers": heads, "sections": parts, "pattern": pattern, "records": records, "plan": plan,
           "metrics": sheet_metrics(audit, pattern, plan), "regions": regions}
    if split:
        named = rows.select(*KEYS).distinct().where(F.contains("sheet", F.lit(REGION_MARK)))
        plain, plain_heads = plain_tables(grid, audit, named)
        out |= {"region_records": plain, "region_plan": column_plan(plain, plain_heads)}
    return out
