"""Reading single spreadsheet cells given as text."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import fold

# Currency marks, month names, summary and comment words, patterns.
CURRENCY = ("R$", "US$", "$", "£", "€", "¥", "₹")
MONTHS = (
    "janeiro", "fevereiro", "marco", "abril", "maio", "junho", "julho", "agosto", "setembro", "outubro", "novembro", "dezembro",
    "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december",
)
SUMMARY = (r"^(?:(?:\d+(?:[.,]\d+)?\s+)?dias uteis|subtotal|total|meta|media|saldo|resultado|percentual|average|target|balance)"
           r"(?:\s|:|$)")
COMMENT = r"^(obs\.?|observacao|observacoes|nota|notas|comentario|comentarios|fonte)(?:\s|:|$)"
SEPARATOR = r"^[-_=.* ]+$"
AGGREGATE_FORMULA = r"(?i)\b(?:SUM|SUBTOTAL|AVERAGE|COUNT|COUNTA|MIN|MAX)\s*\("
RANGE_FORMULA = r"(?i)\b(?:SUM|SUBTOTAL|AVERAGE|COUNT|MIN|MAX)\s*\([^)]*:"
BLANK, DATE, MARK, PERCENT, NUMBER, TEXT = "_", "D", "$", "P", "N", "T"

# A period is a month with or without its year, a year with or without a month, or a quarter of a year.
_MONTH = "(?:" + "|".join(f"{m[:3]}(?:{m[3:]})?" if len(m) > 3 else m for m in MONTHS) + ")"
_YEAR, _GAP = r"\d{4}", "[ /-]+"
PERIOD = "^(?:" + "|".join((
    f"{_MONTH}(?:{_GAP}{_YEAR})?",
    f"{_YEAR}(?:{_GAP}{_MONTH})?",
    rf"[1-4][ºo°]?\s*trimestre(?:{_GAP}{_YEAR})?",
    f"q[1-4](?:{_GAP}{_YEAR})?",
)) + ")$"
_MARKS = "R\\$|US\\$|[$£€¥₹]"
#: Most numbers: digits, at most a decimal point that can't group thousands, at most a mark before them. Most dates: a day that every month has.
_SIMPLE = rf"^(?:(?:{_MARKS}) ?)?\d+(?:\.(?:\d{{0,2}}|\d{{4,}}))?\z"
_ISO_DAY, _SLASH_DAY = r"^[1-9]\d{3}-(?:0[1-9]|1[0-2])-(?:0[1-9]|1\d|2[0-8])\z", r"^(?:0?[1-9]|1\d|2[0-8])/(?:0?[1-9]|1[0-2])/[1-9]\d{3}\z"


def blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once per row, wherever it stands in the result."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def parse_number(c: Column) -> Column:
    """Number of a cell whose notation has one reading only, else NULL.

    With both separators the last one is decimal and the other must group by
    three; a single separator followed by exactly three digits is ambiguous.
    """
    def read(body: Column) -> Column:
        comma_decimal, dot_decimal = body.rlike(r"^[+-]?\d{1,3}(\.\d{3})+,\d+$"), body.rlike(r"^[+-]?\d{1,3}(,\d{3})+\.\d+$")
        plain, single = body.rlike(r"^[+-]?\d+$"), body.rlike(r"^[+-]?\d+[.,](\d{0,2}|\d{4,})$")
        text = (
            F.when(plain, body).when(single, F.translate(body, ",", "."))
            .when(comma_decimal, F.translate(F.translate(body, ".", ""), ",", ".")).when(dot_decimal, F.translate(body, ",", ""))
        )
        return text.try_cast("double")

    def signed(s: Column) -> Column:
        negative = s.rlike(r"^\(.*\)$")
        bare = F.when(negative, F.substring(s, F.lit(2), F.length(s) - 2)).otherwise(s)
        value = _once(F.regexp_replace(F.regexp_replace(bare, _MARKS, ""), "[ \u00a0]", ""), read)
        return F.when(negative, -value).otherwise(value)

    return F.when(c.rlike(_SIMPLE), F.translate(c, "RUS$£€¥₹ ", "").try_cast("double")).when(c.rlike("[0-9]"), _once(F.trim(c), signed))


def is_date(c: Column) -> Column:
    s = F.trim(c)
    return (
        F.when(F.contains(s, F.lit("-")) & s.rlike(r"^\d{4}-\d{2}-\d{2}$"), s.rlike(_ISO_DAY) | F.try_to_timestamp(s, F.lit("yyyy-MM-dd")).isNotNull())
        .when(F.contains(s, F.lit("/")) & s.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), s.rlike(_SLASH_DAY) | F.try_to_timestamp(s, F.lit("d/M/yyyy")).isNotNull()).otherwise(F.lit(False))
    )


def cell_kind(c: Column) -> Column:
    """One letter for what a cell holds. Dates, shares and numbers have a digit, so that texts are told by one test."""
    s = F.trim(c)
    share = F.endswith(s, F.lit("%")) & parse_number(F.regexp_replace(s, "%$", "")).isNotNull()
    return (
        F.when(c.rlike(_SIMPLE), NUMBER).when(blank(c), BLANK).when(s.isin(*CURRENCY), MARK).when(~c.rlike("[0-9]"), TEXT).when(is_date(c), DATE).when(share, PERCENT)
        .when(parse_number(c).isNotNull(), NUMBER).otherwise(TEXT)
    )


def money_like(c: Column, number: Column) -> Column:
    """A number written with a currency mark, both separators or accounting brackets; ``number`` says whether it is one."""
    signs = F.contains(c, F.lit(",")) & F.contains(c, F.lit("."))
    sign = reduce(or_, [F.contains(c, F.lit(m)) for m in "$£€¥₹"])
    marked = signs | sign | F.startswith(F.ltrim(c), F.lit("(")) & F.trim(c).rlike(r"^\(.*\)$")
    return F.coalesce(number & marked, F.lit(False))


def period_of(cells: Column) -> Column:
    """The period a row names with at most two filled cells, else NULL."""
    filled = F.filter(cells, lambda v: ~blank(v))
    joined = F.array_join(F.transform(filled, lambda v: fold(v)), " ")
    shown = F.array_join(F.transform(filled, lambda v: F.trim(v)), " ")
    return F.when((F.size(filled) > 0) & (F.size(filled) <= 2) & joined.rlike(PERIOD), shown)
