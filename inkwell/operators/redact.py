"""P8 normalisation, P9 free-text redaction, P10 structured redaction."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.functions.redaction import REDACTION_RULES, redact, redact_entry, redaction_counts
from inkwell.functions.patterns import contains_any, required_literals
from inkwell.functions.text import ascii_digits
from inkwell.rules.text_values import MERGED_WORDS


def redact_text(df: DataFrame, cols: list[str], secrets: list[str] | None = None) -> DataFrame:
    """Redact ``cols`` in place and add ``<col>_<rule>_hits`` per rule."""
    originals = {c: F.col(c) for c in cols}
    staged = df.withColumns({f"_red_{c}": redact(originals[c], secrets) for c in cols})
    hits = {}
    for c in cols:
        for rule, count in redaction_counts(F.col(f"_red_{c}"), originals[c]).items():
            hits[f"{c}_{rule}_hits"] = count
    out = staged.withColumns(hits)
    for c in cols:
        out = out.withColumn(c, F.col(f"_red_{c}")).drop(f"_red_{c}")
    return out


def redaction_summary(df: DataFrame, text: str, by: list[str]) -> DataFrame:
    """Rows, affected rows and replacements per rule for each group."""
    names = [r[0] for r in REDACTION_RULES]
    hits = redact_text(df.select(*by, text), [text])
    total = sum((F.col(f"{text}_{n}_hits") for n in names), F.lit(0))
    return hits.groupBy(*by).agg(
        F.count("*").alias("rows"),
        F.count_if(total > 0).alias("redacted_rows"),
        *[F.coalesce(F.sum(f"{text}_{n}_hits"), F.lit(0)).alias(f"{n}_hits") for n in names],
    )


def redact_map(df: DataFrame, col: str) -> DataFrame:
    """Redact a ``MAP<STRING,STRING>`` by key name and by value."""
    return df.withColumn(col, F.transform_values(F.col(col), redact_entry))


def redact_nested_map(df: DataFrame, col: str) -> DataFrame:
    """As :func:`redact_map` for ``MAP<STRING,MAP<STRING,STRING>>``."""

    def entry(key: Column, value: Column) -> Column:
        # a secret outer key hides every inner value
        outer = redact_entry(key, F.lit(None).cast("string"))
        return F.transform_values(value, lambda k, v: F.coalesce(outer, redact_entry(k, v)))

    return df.withColumn(col, F.transform_values(F.col(col), entry))


# Characters that NFKC leaves alone beside any other of this class: ASCII, Latin letters, quotes and dashes, Cyrillic,
# Devanagari without the nukta and what it makes, kana without sound marks, CJK ideographs.
NFKC_STABLE = (
    r"\x00-\x7F\u00A1\u00A3\u00A7\u00AB\u00B0\u00BB\u00BF-\u0131\u0134-\u013E\u0141-\u0148\u014A-\u017E"
    r"\u0400-\u0481\u048A-\u04FF\u0904-\u0939\u093D-\u0950\u0966-\u097F\u2013\u2014\u2018\u2019\u201C\u201D\u20AC\u20B9"
    r"\u3041-\u3096\u30A1-\u30FE\u4E00-\u9FFF"
)


@F.pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def _merged_word_guards() -> list[str]:
    """Plain words of which one is present whenever a repair applies."""
    guards = []
    for pattern, _ in MERGED_WORDS:
        words = required_literals(pattern)
        guards += words if words else []
    return sorted(set(guards))


def _repair_merged(col: Column) -> Column:
    for pattern, repair in MERGED_WORDS:
        col = F.regexp_replace(col, "(?i)" + pattern, repair)
    return col


def _fold(col: Column) -> Column:
    """Everything of the normalisation that follows NFKC."""
    col = F.translate(col, "\u200b\ufeff", "")
    col = F.translate(col, "“”‘’", "\"\"''")
    col = F.regexp_replace(col, "[—–]", " - ")
    col = ascii_digits(col)
    col = F.regexp_replace(col, r"([A-Za-z])\.(?=[A-Za-z]{2,})", "$1. ")
    return F.regexp_replace(col, r"([A-Za-z]):(?=[A-Za-z0-9])", "$1: ")


def normalise_text(docs: DataFrame, text: str = "full_text", out: str = "norm_text") -> DataFrame:
    """P8.  Only texts with a character that NFKC may change reach Python workers."""
    t = F.col(text)
    staged = docs.withColumn("_nfkc", _nfkc(F.when(t.rlike(f"[^{NFKC_STABLE}]"), t)))
    staged = staged.withColumn("_fold", _fold(F.coalesce("_nfkc", t, F.lit("")))).withColumn("_up", F.upper("_fold"))
    merged = contains_any(F.col("_up"), _merged_word_guards())
    return staged.withColumn(out, F.when(merged, _repair_merged(F.col("_fold"))).otherwise(F.col("_fold"))).drop(
        "_nfkc", "_fold", "_up"
    )
