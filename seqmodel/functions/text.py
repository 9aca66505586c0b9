"""Text to fields, labels, numbers and symbol lists."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as blank, and the label words.
BLANKS = " \t\n\x0b\f\r"
TRUE_LABELS = ("1", "true", "malware")
FALSE_LABELS = ("0", "false", "benign")
TRUE_LABEL_PART = "malic"
MISSING = ("", "-")
NO_SYMBOL = "symbol=unknown"

# Drawn anew in each process, so that no text holds it.
_CUT = f"\uffff{uuid.uuid4().hex}\uffff"
_NUMBER = r"^\s*([-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?)"


def strip_blanks(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def split_fields(line: Column, delimiter: str) -> Column:
    """Delimited line to trimmed fields; `"` toggles quoting, `""` inside quotes is a quote.

    Cutting the line at every `"` makes the odd pieces the quoted ones. An even piece that is
    empty and lies between two others is the seam of a doubled quote. Delimiters count in even
    pieces only. One linear pass, no character loop.
    """
    def rejoined(pieces: Column) -> Column:
        def piece(p: Column, i: Column) -> Column:
            seam = (p == "") & (i > 0) & (i < F.size(pieces) - 1)
            return (
                F.when(i % 2 == 1, p)
                .when(seam, F.lit('"'))
                .otherwise(F.replace(p, F.lit(delimiter), F.lit(_CUT)))
            )

        return F.array_join(F.transform(pieces, piece), "")

    plain = F.split(line, re.escape(delimiter))
    quoted = F.split(F.transform(F.array(F.split(line, '"')), rejoined)[0], _CUT)
    fields = F.when(line.contains('"'), quoted).otherwise(plain)
    return F.transform(fields, strip_blanks)


def is_positive_label(text: Column) -> Column:
    low = F.lower(text)
    return (
        F.when(low.isin(*TRUE_LABELS), F.lit(True))
        .when(low.isin(*FALSE_LABELS), F.lit(False))
        .otherwise(F.coalesce(low.contains(TRUE_LABEL_PART), F.lit(False)))
    )


def leading_number(text: Column) -> Column:
    """The number a text starts with (`1.5x` is 1.5), 0.0 if there is none or it has no double.

    The regex runs only for texts that are neither missing nor a number as they stand.
    """
    finite = lambda n: F.when(F.abs(n) < float("inf"), n)
    whole = finite(text.try_cast("double"))
    head = finite(F.regexp_extract(text, _NUMBER, 1).try_cast("double"))
    return F.when(text.isNull() | text.isin(*MISSING), 0.0).otherwise(F.coalesce(whole, head, F.lit(0.0)))


def record_symbols(columns: list[tuple[Column, str]], sentinel: bool = True) -> Column:
    """Prefixed symbols of a record in column order; missing values give none.

    With ``sentinel`` a record without any usable value gets one marker symbol.
    """
    parts = [
        F.when(c.isNotNull() & ~c.isin(*MISSING), F.concat(F.lit(prefix), c)) for c, prefix in columns
    ]
    if sentinel:
        parts.append(F.when(F.coalesce(*parts).isNull(), F.lit(NO_SYMBOL)))
    return F.array_compact(F.array(*parts))


def wide_symbols(columns: list[Column]) -> Column:
    """Non-empty cells in column order, no prefix."""
    return F.filter(F.array(*columns), lambda x: x.isNotNull() & (x != ""))


def symbols_from_commas(text: Column) -> Column:
    """`a, b,,c` to symbols: inner empty items stay, one trailing empty item goes."""
    body = F.regexp_replace(text, r",\z", "")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(
        F.transform(F.split(body, ","), strip_blanks)
    )


def symbols_from_blanks(text: Column) -> Column:
    """`a  b c` to symbols: cut at runs of blanks, no empty items."""
    return F.filter(F.split(text, "[ \\t\\n\\x0B\\f\\r]+"), lambda x: x != "")
