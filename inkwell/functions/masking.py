"""Masking of account numbers, identifiers, names and addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkwell.functions.text import let, rx, strip


def _digits(col: Column) -> Column:
    return F.regexp_replace(col, r"\D", "")


def mask_account(col: Column) -> Column:
    """Last four digits behind at least six X."""
    d = _digits(col)
    masked = F.when(
        F.length(d) >= 4,
        F.concat(F.repeat(F.lit("X"), F.greatest(F.lit(6), F.length(d) - 4)), F.right(d, F.lit(4))),
    ).otherwise(F.concat(F.lit("XXXXXX"), d))
    return F.when(col != "", masked)


def mask_uid(col: Column) -> Column:
    """Eight X and the last four digits."""
    d = _digits(col)
    return F.when(col != "", F.concat(F.lit("XXXXXXXX"), F.right(d, F.lit(4))))


def mask_person(col: Column) -> Column:
    """First name kept, last name reduced to its initial."""

    def starred(word: Column) -> Column:
        return F.concat(
            F.substring(word, 1, 1), F.repeat(F.lit("*"), F.greatest(F.lit(1), F.length(word) - 1))
        )

    words = F.split(strip(col), r"\s+")
    masked = F.when(F.size(words) == 1, starred(words[0])).otherwise(
        F.concat(words[0], F.lit(" "), starred(F.element_at(words, -1)))
    )
    return F.when(strip(col) != "", masked)


# Words that open the unit or building part of an address.
_BUILDING = r"^(?:bldg|building|wing|tower|block|floor)\b"
_UNIT_PREFIX = (
    r"^(?:(?:flat|plot|house|door|shop|unit|room|bldg|building|no\.?|#)\s*)?[0-9A-Za-z\-\/]+"
    r"(?:\s+(?:road|marg|street|lane|bldg|building|floor))?\s*"
)


def mask_address(col: Column) -> Column:
    """Unit and building hidden, locality onwards kept."""
    clean = F.regexp_replace(strip(col), r"[ \t]+", " ")
    parts = F.filter(F.transform(F.split(clean, ","), strip), lambda p: p != "")

    def from_parts(p: Column) -> Column:
        second_is_building = (F.size(p) > 2) & F.get(p, 1).rlike(rx(_BUILDING, ignore_case=True))
        start = F.when(second_is_building, 3).otherwise(2)
        return F.concat(F.lit("XXXX, "), F.array_join(F.slice(p, start, F.size(p)), ", "))

    plain = let(
        clean,
        lambda c: let(
            F.regexp_replace(c, rx(_UNIT_PREFIX, ignore_case=True), "XXXX "),
            lambda m: strip(
                F.when(m != c, m)
                .when(F.length(c) > 15, F.concat(F.lit("XXXX "), strip(F.substr(c, F.lit(11)))))
                .otherwise(F.lit("XXXX"))
            ),
        ),
    )
    return F.when(strip(col) != "", let(parts, lambda p: F.when(F.size(p) >= 2, from_parts(p)).otherwise(plain)))
