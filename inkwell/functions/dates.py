"""Date and period expressions for dirty text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkwell.functions.text import let, matched, strip

# Month names as they are written out.
MONTHS = [
    "January", "February", "March", "April", "May", "June",
    "July", "August", "September", "October", "November", "December",
]


def _try_date(text: Column, fmt: str, shape: str) -> Column:
    return F.when(text.rlike(shape), F.try_to_date(text, fmt))


def normalise_date(col: Column) -> Column:
    """ISO text of a date in one of the accepted layouts, else NULL."""

    def parse(t: Column) -> Column:
        dmy = r"^(\d{1,2}[/-]\d{1,2}[/-])(\d{2})$"
        two = F.regexp_extract(t, dmy, 2)
        century = F.when(two.try_cast("int") >= 69, "19").otherwise("20")
        short = F.when(t.rlike(dmy), F.concat(F.regexp_extract(t, dmy, 1), century, two))
        return F.date_format(
            F.coalesce(
                _try_date(t, "d/M/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$"),
                _try_date(t, "d-M-yyyy", r"^\d{1,2}-\d{1,2}-\d{4}$"),
                _try_date(t, "yyyy-M-d", r"^\d{4}-\d{1,2}-\d{1,2}$"),
                _try_date(t, "yyyy/M/d", r"^\d{4}/\d{1,2}/\d{1,2}$"),
                _try_date(short, "d/M/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$"),
                _try_date(short, "d-M-yyyy", r"^\d{1,2}-\d{1,2}-\d{4}$"),
            ),
            "yyyy-MM-dd",
        )

    return let(F.regexp_replace(strip(col), r"[\s.,]+", "/"), parse)


def parse_date(col: Column) -> Column:
    """DATE from year-first (after 1900) or day-first text, else NULL."""

    def parse(t: Column) -> Column:
        dashed = F.translate(t, "/.", "--")
        year_first = F.when(
            dashed.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$") & (F.substring(dashed, 1, 4) > "1900"),
            F.try_to_date(dashed, "yyyy-M-d"),
        )
        return F.coalesce(year_first, _try_date(dashed, "d-M-yyyy", r"^\d{1,2}-\d{1,2}-\d{4}$"))

    return let(strip(col), parse)


def human_date(col: Column) -> Column:
    """``22/06/2007`` as ``22 June 2007``; other text unchanged."""
    names = F.array(*[F.lit(m) for m in MONTHS])

    def render(t: Column) -> Column:
        dmy = r"^(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{4})$"
        ymd = r"^(\d{4})[/\-.](\d{1,2})[/\-.](\d{1,2})$"

        def written(pattern: str, d: int, m: int, y: int) -> Column:
            day = F.regexp_extract(t, pattern, d).try_cast("int")
            month = F.regexp_extract(t, pattern, m).try_cast("int")
            year = F.regexp_extract(t, pattern, y).try_cast("int")
            return F.when(
                t.rlike(pattern) & month.between(1, 12) & day.between(1, 31),
                F.concat_ws(" ", F.lpad(day.cast("string"), 2, "0"), F.get(names, month - 1), year.cast("string")),
            )

        return F.coalesce(written(dmy, 1, 2, 3), written(ymd, 3, 2, 1), t)

    return F.coalesce(let(strip(col), render), F.lit(""))


def human_period(col: Column) -> Column:
    """A period given as JSON-like text or a range, written out."""
    day_first = r"[0-9]{1,2}[/\-.][0-9]{1,2}[/\-.][0-9]{4}"
    year_first = r"[0-9]{4}[/\-.][0-9]{1,2}[/\-.][0-9]{1,2}"
    glue = r"\s*(?:to|–|-|till|through)\s*:?\s*"

    def key(name: str) -> Column:
        return matched(col, rf"['\"](?:{name}_date|{name})['\"]\s*:\s*['\"]([^'\"]+)['\"]")

    def span(group: int) -> Column:
        return F.coalesce(
            matched(col, rf"(?:from\s*:?\s*)?({day_first}){glue}({day_first})", group, ignore_case=True),
            matched(col, rf"(?:from\s*:?\s*)?({year_first}){glue}({year_first})", group, ignore_case=True),
        )

    def render(pair: Column) -> Column:
        start, end = pair["f"], pair["t"]
        no_key = start.isNull() & end.isNull()
        start = F.when(no_key, span(1)).otherwise(start)
        end = F.when(no_key, span(2)).otherwise(end)
        return (
            F.when(start.isNotNull() & end.isNotNull(), F.concat(human_date(start), F.lit(" – "), human_date(end)))
            .when(start.isNotNull(), F.concat(F.lit("From "), human_date(start)))
            .when(end.isNotNull(), F.concat(F.lit("Up to "), human_date(end)))
            .otherwise(F.coalesce(col, F.lit("")))
        )

    return let(F.struct(key("from").alias("f"), key("to").alias("t")), render)


def parse_amount(col: Column) -> Column:
    """DOUBLE from a currency text; brackets mean negative."""
    clean = F.regexp_replace(strip(col), r"[₹$,\s]", "")
    bracketed = clean.rlike(r"^\(.*\)$")
    signed = F.when(bracketed, F.concat(F.lit("-"), F.regexp_replace(clean, r"^\(|\)$", ""))).otherwise(clean)
    return signed.try_cast("double")
