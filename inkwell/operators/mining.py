"""Row-local mining of texts: T1 dates, T2 amounts, T3 line search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions.text import let, rx, strip

# Date and amount shapes, context words in order of preference.
DATE_SHAPE = (
    r"\b(?:\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{1,2}\s+(?:January|February|March|April|May|June|July|August|September|"
    r"October|November|December|Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{2,4})\b"
)
AMOUNT_SHAPE = (
    r"(?:[$₹€£]\s*[0-9]+(?:,[0-9]{3})*(?:\.[0-9]{2})?|[0-9]+(?:,[0-9]{3})*(?:\.[0-9]{2})?\s*"
    r"(?:usd|inr|rs\.?|per annum|per month))"
)
DATE_CONTEXT: list[tuple[list[str], str]] = [
    (["dob", "birth"], "Date of Birth"),
    (["registration", "liability"], "Registration / Effective Date"),
    (["notice"], "Notice Date"),
    (["deadline", "submit"], "Deadline"),
    (["effective", "joining"], "Effective / Joining Date"),
]


def _mine(docs: DataFrame, text: str, shape: str) -> DataFrame:
    """Distinct matches in first-seen order, each with the line it stands on."""
    found = F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(rx(shape, ignore_case=True)), F.lit(0)))
    hits = docs.withColumn("_hits", found).filter("size(_hits) > 0")

    def with_line(hit: Column) -> Column:
        lines = F.split(F.col(text), "\n")
        holds = F.filter(lines, lambda line: F.contains(line, hit) & (F.length(strip(line)) > F.length(hit)))
        return F.struct(hit.alias("hit"), F.coalesce(strip(F.get(holds, F.lit(0))), F.lit("")).alias("line"))

    return hits.select("doc_id", F.posexplode(F.transform("_hits", with_line)).alias("position", "_h")).select(
        "doc_id", "position", "_h.*"
    )


def mine_dates(docs: DataFrame, text: str = "full_text") -> DataFrame:
    """T1."""
    rows = _mine(docs, text, DATE_SHAPE)
    low = F.lower("line")
    label = F.lit(None).cast("string")
    for words, name in reversed(DATE_CONTEXT):
        cond = low.contains(words[0])
        for w in words[1:]:
            cond = cond | low.contains(w)
        label = F.when(cond, name).otherwise(label)
    return rows.select("doc_id", "position", F.col("hit").alias("date_text"), label.alias("context"), "line")


def mine_amounts(docs: DataFrame, text: str = "full_text") -> DataFrame:
    """T2."""
    return _mine(docs, text, AMOUNT_SHAPE).select("doc_id", "position", F.col("hit").alias("amount_text"), "line")


def line_search(docs: DataFrame, query: str | Column, k: int = 3, text: str = "full_text") -> DataFrame:
    """First ``k`` lines that contain a query word longer than 3 letters.

    ``query`` is a literal for all documents, or a column (join questions to
    documents first); either way lines never leave their row.
    """
    q = F.lit(query) if isinstance(query, str) else query
    words = F.filter(F.split(F.lower(strip(q)), r"\s+"), lambda w: F.length(w) > 3)
    lines = F.filter(F.transform(F.split(F.col(text), "\n"), strip), lambda line: line != "")

    def hits(ws: Column) -> Column:
        return F.slice(F.filter(lines, lambda line: F.exists(ws, lambda w: F.contains(F.lower(line), w))), 1, k)

    return docs.select("doc_id", F.posexplode(let(words, hits)).alias("position", "line"))
