"""Financial years and certificate dates (T4, income certificates)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkwell.functions.text import ascii_digits, let, strip

# Shape of a year range, with room for look-alike letters.
YEAR_RANGE = r"\b([A-Za-z0-9०-९]{4}\s*[-/]\s*[A-Za-z0-9०-९]{2,4})\b"
LOOK_ALIKES = [("oO", "0"), (r"Il\|", "1"), ("sS", "5")]


def valid_financial_year(col: Column) -> Column:
    """``YYYY-YYYY`` when the end year follows the start year, else NULL."""
    s = strip(ascii_digits(col))
    for letters, digit in LOOK_ALIKES:
        s = F.regexp_replace(s, rf"(?<=[0-9\-/])[{letters}](?=[0-9\-/]|$)", digit)
    for letters, digit in LOOK_ALIKES:
        s = F.regexp_replace(s, rf"^[{letters}](?=\d)", digit)
    shape = r"\b(\d{4})\s*[-/]\s*(\d{2,4})\b"

    def check(t: Column) -> Column:
        start = F.regexp_extract(t, shape, 1).try_cast("int")
        tail = F.regexp_extract(t, shape, 2)
        follows = F.when(F.length(tail) == 4, tail.try_cast("int") == start + 1).when(
            F.length(tail) == 2, tail.try_cast("int") == (start + 1) % 100
        )
        return F.when(
            start.between(1900, 2100) & follows,
            F.concat_ws("-", start.cast("string"), (start + 1).cast("string")),
        )

    return let(s, check)


def financial_years(text: Column) -> Column:
    """All valid years of a text, ascending and distinct."""
    found = F.regexp_extract_all(text, F.lit(YEAR_RANGE), F.lit(1))
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(found, valid_financial_year))))


def years_before(issued: Column, count: int = 3) -> Column:
    """Completed financial years (April start) before an issue date."""
    iso = r"\b(19\d{2}|20\d{2})[-/.](\d{1,2})[-/.]\d{1,2}\b"
    dmy = r"\b\d{1,2}[-/.](\d{1,2})[-/.](19\d{2}|20\d{2})\b"

    def year_month(d: Column) -> Column:
        def read(pattern: str, y: int, m: int) -> Column:
            return F.when(
                d.rlike(pattern),
                F.struct(
                    F.regexp_extract(d, pattern, y).cast("int").alias("y"), F.regexp_extract(d, pattern, m).cast("int").alias("m")
                ),
            )

        return F.coalesce(read(iso, 1, 2), read(dmy, 2, 1))

    def span(ym: Column) -> Column:
        end = ym["y"] - F.when(ym["m"] >= 4, 0).otherwise(1)
        return F.transform(
            F.sequence(end - (count - 1), end),
            lambda year: F.concat_ws("-", (year - 1).cast("string"), year.cast("string")),
        )

    return let(issued, lambda d: let(year_month(d), lambda ym: F.when(ym.isNotNull(), span(ym))))


# layout -> (pattern, group of year, separator, month, day)
_LAYOUTS = [
    (r"^(\d{4})([-/.])(\d{1,2})[-/.](\d{1,2})\d?$", 1, 2, 3, 4, False),
    (r"^(\d{1,2})\d?([-/.])(\d{1,2})[-/.](\d{4})$", 4, 2, 3, 1, True),
    (r"^(\d{1,2})([-/.])(\d{1,2})[-/.](\d{4})\d$", 4, 2, 3, 1, True),
    (r"^(\d{4})([-/.])(\d{2})\d[-/.](\d{1,2})$", 1, 2, 3, 4, False),
]


def issue_date(col: Column) -> Column:
    """A calendar-valid date, with one stray trailing digit removed."""

    def read(t: Column, layout: tuple) -> Column:
        pattern, y, sep, m, d, day_first = layout

        def rebuilt(p: Column) -> Column:
            iso = F.concat_ws("-", p["y"], p["m"], p["d"])
            ok = p["y"].between("1900", "2100") & F.try_to_date(iso, "yyyy-M-d").isNotNull()
            order = ["d", "m", "y"] if day_first else ["y", "m", "d"]
            return F.when(ok, F.concat(p[order[0]], p["s"], p[order[1]], p["s"], p[order[2]]))

        parts = F.struct(*[F.regexp_extract(t, pattern, g).alias(n) for n, g in (("y", y), ("s", sep), ("m", m), ("d", d))])
        return F.when(t.rlike(pattern), let(parts, rebuilt))

    return let(strip(col), lambda t: F.coalesce(*[read(t, layout) for layout in _LAYOUTS]))
