"""Reading dates from text in any mixture of notations, the day before the month where both are possible.

What a cell begins with tells its order: a year, a day or a month's name; a
number above twelve in the month's place changes places with the day. The parts
are put into year, month and day by one replacement, and the result is cast.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names by their first letters, the pattern that marks a date column.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
DATE_PATTERN = r"^\d{4}-\d{1,2}-\d{1,2}$|^\d{1,2}/\d{1,2}/\d{4}$"

_NAME = "(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
#: Days that can't be months; years of two digits of the last century (from 69 on); what may follow a date: a time, kept as the last group.
_DAY, _OLD, _REST = r"(1[3-9]|2\d|3[01])", r"(69|[7-9]\d)", r"(?:(?:t| +)(\d{1,2}:\d{2}.*))?$"

# Notations by what they begin with: pattern, and the same as year, month, day and time (``@`` is the month's name).
YEAR_FIRST = (
    (rf"^(\d{{4}})([-/. ]){_DAY}\2(\d{{1,2}}){_REST}", "$1-$4-$3 $5"), (rf"^(\d{{4}})([-/. ])(\d{{1,2}})\2(\d{{1,2}}){_REST}", "$1-$3-$4 $5"),
    (r"^(\d{4})[-/](\d{1,2})$", "$1-$2-01"), (rf"^(\d{{4}})[-/. ]{_NAME}[-/. ](\d{{1,2}}){_REST}", "$1-@-$2 $3"),
)
DAY_FIRST = (
    (rf"^(\d{{1,2}})([-/. ]){_DAY}\2(\d{{4}}){_REST}", "$4-$1-$3 $5"), (rf"^(\d{{1,2}})([-/. ])(\d{{1,2}})\2(\d{{4}}){_REST}", "$4-$3-$1 $5"),
    (rf"^(\d{{1,2}})([-/. ]){_DAY}\2{_OLD}{_REST}", "19$4-$1-$3 $5"), (rf"^(\d{{1,2}})([-/. ])(\d{{1,2}})\2{_OLD}{_REST}", "19$4-$3-$1 $5"),
    (rf"^(\d{{1,2}})([-/. ]){_DAY}\2(\d{{2}}){_REST}", "20$4-$1-$3 $5"), (rf"^(\d{{1,2}})([-/. ])(\d{{1,2}})\2(\d{{2}}){_REST}", "20$4-$3-$1 $5"),
    (r"^(\d{1,2})/(\d{4})$", "$2-$1-01"),
    (rf"^(\d{{1,2}})[-/. ]{_NAME}[-/. ,]+(\d{{4}}){_REST}", "$2-@-$1 $3"), (rf"^(\d{{1,2}})[-/. ]{_NAME}[-/. ,]+{_OLD}{_REST}", "19$2-@-$1 $3"),
    (rf"^(\d{{1,2}})[-/. ]{_NAME}[-/. ,]+(\d{{2}}){_REST}", "20$2-@-$1 $3"),
)
DIGITS = ((rf"^(\d{{4}})(\d{{2}})(\d{{2}}){_REST}", "$1-$2-$3 $4"),)
NAME_FIRST = ((rf"^{_NAME}[-/. ](\d{{1,2}})[-/. ,]+(\d{{4}}){_REST}", "$2-@-$1 $3"), (rf"^{_NAME}[-/. ,]+(\d{{4}})$", "$1-@-01"))


def _arranged(low: Column, notations: tuple) -> Column:
    out = F.lit(None).cast("string")
    for pattern, order in reversed(notations):
        text = F.regexp_replace(low, pattern, order)
        if "@" in order:
            name = F.regexp_extract(low, f"({'|'.join(MONTHS)})", 1)
            text = F.replace(text, F.lit("@"), F.array_position(F.array(*[F.lit(m) for m in MONTHS]), name).cast("string"))
        out = F.when(low.rlike(pattern), text).otherwise(out)
    return out


def parse_date_text(c: Column) -> Column:
    """Timestamp of a text cell, NULL when it is no real date. A lambda, so that many such columns don't make one method too long to compile."""
    return F.get(F.transform(F.array(F.lower(F.trim(c.cast("string")))), _read), F.lit(0))


def _read(low: Column) -> Column:
    text = (
        F.when(low.rlike(r"^\d{1,2}[-/. ]"), _arranged(low, DAY_FIRST)).when(low.rlike(r"^\d{4}[-/. ]"), _arranged(low, YEAR_FIRST))
        .when(low.rlike(r"^\d{8}(?!\d)"), _arranged(low, DIGITS)).when(low.rlike("^[a-z]{3,9}[-/. ,]+\\d"), _arranged(low, NAME_FIRST))
    )
    hour = F.regexp_extract(low, r"(\d{1,2}):\d{2}[^a-z]*[ap]m$", 1).try_cast("int")
    late = F.endswith(low, F.lit("pm"))
    shift = F.when(~F.endswith(low, F.lit("m")) | hour.isNull(), 0).when(late & (hour < 12), 12).when(~late & (hour == 12), -12).otherwise(0)
    return F.timestamp_add("HOUR", shift, F.upper(F.regexp_replace(text, " ?[ap]m$", "")).try_cast("timestamp"))
