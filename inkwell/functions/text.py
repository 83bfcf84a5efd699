"""Text column expressions shared by the operators (all JVM-side)."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkwell.rules.text_values import RESIDUAL_LABELS

WHITESPACE = " \t\n\r\x0b\x0c"
DEVANAGARI_DIGITS = "०१२३४५६७८९"


def rx(pattern: str, ignore_case: bool = False, multiline: bool = False, dotall: bool = False) -> str:
    """Pattern with the flags that make the JVM treat only ``\\n`` as a line end."""
    flags = "d" + ("i" if ignore_case else "") + ("m" if multiline else "") + ("s" if dotall else "")
    return f"(?{flags}){pattern}"


def matched(col: Column, pattern: str, group: int = 1, **flags: bool) -> Column:
    """First match of ``pattern`` (NULL when nothing or an empty text matched)."""
    return F.nullif(F.regexp_extract(col, rx(pattern, **flags), group), F.lit(""))


def found(col: Column, pattern: str, **flags: bool) -> Column:
    return col.rlike(rx(pattern, **flags))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(WHITESPACE))


def blank_to_null(col: Column) -> Column:
    return F.when(strip(col) != "", col)


def ascii_digits(col: Column) -> Column:
    """Devanagari digits written as ASCII digits."""
    return F.translate(col, DEVANAGARI_DIGITS, "0123456789")


def non_empty_lines(col: Column) -> Column:
    return F.filter(F.transform(F.split(col, "\r?\n"), strip), lambda line: line != "")


def squeeze(col: Column, pattern: str = r"\s+") -> Column:
    return F.regexp_replace(col, pattern, " ")


_LABELS = "|".join(re.escape(label) for label in sorted(RESIDUAL_LABELS, key=len, reverse=True))
_LABEL_START = rf"^(?:{_LABELS})(?: |$)"
_LABEL_ANY = rf"(?:{_LABELS})"


def is_residual_label(line: Column) -> Column:
    """The line repeats a known field label instead of carrying a value."""
    return let(
        F.lower(strip(F.regexp_replace(line, r"[:\-_.]", " "))),
        lambda norm: norm.rlike(_LABEL_START)
        | ((F.size(F.split(norm, r"\s+")) <= 3) & norm.rlike(_LABEL_ANY)),
    )


def _cut_labels(value: Column) -> Column:
    lines = non_empty_lines(F.split(value, r"\r?\n\s*\r?\n", 2)[0])
    return let(
        lines,
        lambda ls: let(
            F.array_position(
                F.transform(F.slice(ls, 2, F.greatest(F.size(ls) - 1, F.lit(0))), is_residual_label), True
            ),
            lambda stop: F.array_join(
                F.when(stop == 0, ls).otherwise(F.slice(ls, 1, stop.cast("int"))), " "
            ),
        ),
    )


def clean_value(col: Column) -> Column:
    """Captured value without text that bled in from the next field."""
    value = strip(col)
    one_block = F.when(F.instr(value, "\n") == 0, value).otherwise(_cut_labels(value))
    return strip(F.regexp_replace(one_block, r"[\s,:;\-]+$", ""))


def capitalise(col: Column) -> Column:
    return F.concat(F.upper(F.substring(col, 1, 1)), F.lower(F.substr(col, F.lit(2))))


def token_sorted(col: Column) -> Column:
    """Lower-case words without punctuation, in code-point order."""
    words = F.split(strip(F.regexp_replace(F.lower(col), r"[^\p{L}\p{N}_\s]", "")), r"\s+")
    return F.array_join(F.array_sort(words), " ")
