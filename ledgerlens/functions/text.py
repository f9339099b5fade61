"""Text column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

def _plain_letters() -> dict[str, str]:
    """Precomposed letters of the Latin blocks and the plain lower- or upper-case letter each is made of."""
    found = {}
    for point in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base = unicodedata.normalize("NFD", chr(point))[0]
        if base != chr(point) and base.isascii():
            found[chr(point)] = base
    return found


LETTERS = _plain_letters()


def strip_accents(c: Column) -> Column:
    """Plain letters: combining marks are dropped, precomposed Latin letters lose theirs."""
    return F.regexp_replace(F.translate(c, "".join(LETTERS), "".join(LETTERS.values())), r"\p{Mn}+", "")


def fold(c: Column) -> Column:
    """Lower case, trimmed, without accents."""
    low = F.lower(F.trim(c))
    return F.when(F.octet_length(low) == F.length(low), low).otherwise(strip_accents(low))  # one byte a letter: nothing to strip


def squeeze(c: Column) -> Column:
    """Runs of white space become one blank, ends are trimmed."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def entity_key(c: Column) -> Column:
    """Comparison form of an entity name: squeezed, case-folded, plain letters."""
    return strip_accents(F.replace(F.lower(squeeze(c)), F.lit("ß"), F.lit("ss")))


def header_name(c: Column) -> Column:
    """Column-name form: plain lower-case words joined by underscores."""
    worded = F.replace(fold(c), F.lit("%"), F.lit(" percentual "))
    return F.regexp_replace(F.regexp_replace(worded, r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def fixed2(c: Column) -> Column:
    """Two decimals with a decimal comma, as shown in messages."""
    return F.translate(F.format_string("%.2f", c.cast("double")), ".", ",")


def display_entity(identifier: Column, label: Column) -> Column:
    """``Name (ID x)`` when a label is known, else the identifier."""
    ident = identifier.cast("string")
    usable = label.isNotNull() & (F.trim(label) != "")
    return F.when(usable, F.concat(label, F.lit(" (ID "), ident, F.lit(")"))).otherwise(ident)


def json_text(c: Column) -> Column:
    """A JSON string literal, or ``null``."""
    quoted = F.to_json(F.array(c))
    inner = F.substring(quoted, F.lit(2), F.length(quoted) - 2)
    return F.when(c.isNull(), F.lit("null")).otherwise(inner)


def digest24(payload: Column) -> Column:
    return F.substring(F.sha2(F.encode(payload, "UTF-8"), 256), 1, 24)


def number_text(c: Column) -> Column:
    """A number as shown in messages: at most two decimals, at least one."""
    return F.regexp_replace(F.format_string("%.2f", c.cast("double")), r"(\.\d)0$", "$1")
