"""Token-sorted similarity of text pairs."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.functions.text import token_sorted


@F.pandas_udf(T.DoubleType())
def _ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    known: dict[tuple[str, str], float] = {}  # pairs of one Arrow batch

    def ratio(a: str | None, b: str | None) -> float | None:
        if not (isinstance(a, str) and isinstance(b, str)):
            return None
        if (a, b) not in known:
            known[a, b] = SequenceMatcher(None, a, b).ratio()
        return known[a, b]

    return pd.Series([ratio(a, b) for a, b in zip(left, right)], dtype="float64")


def similarity(left: Column, right: Column) -> Column:
    """Ratio of the token-sorted texts."""
    return _ratio(token_sorted(left), token_sorted(right))


#: From this length of the second text on, the ratio leaves out frequent letters, and containment does not settle it.
LONG = 200


def letter_bound(left: Column, right: Column) -> Column:
    """Upper bound of the ratio of two texts: their letters in common, whatever the order, over all letters."""
    letters = F.array_distinct(F.regexp_extract_all(left, F.lit("(?s)(.)")))

    def held(text: Column, letter: Column) -> Column:
        return F.length(text) - F.length(F.replace(text, letter, F.lit("")))

    shared = F.aggregate(letters, F.lit(0), lambda n, letter: n + F.least(held(left, letter), held(right, letter)))
    return 2.0 * shared / (F.length(left) + F.length(right))


def length_bound(left: Column, right: Column) -> Column:
    """Upper bound of the ratio of two texts by their lengths alone."""
    return 2.0 * F.least(F.length(left), F.length(right)) / (F.length(left) + F.length(right))


def stage(left: Column, right: Column, at_least: float) -> Column:
    """How a pair of token-sorted texts is settled, the cheapest way first.

    ``equal`` and ``contained`` pairs have a known ratio, pairs of ``length`` and ``letters`` cannot reach ``at_least``, and only
    ``compared`` ones need the ratio itself.  Null where a text is null.
    """
    contained = (F.length(right) < LONG) & (F.contains(left, right) | F.contains(right, left))
    return (
        F.when(left.isNull() | right.isNull(), F.lit(None)).when(left == right, "equal").when(contained, "contained")
        .when(length_bound(left, right) < at_least, "length").when(letter_bound(left, right) < at_least, "letters").otherwise("compared")
    )


def with_similarity(df: DataFrame, left: str, right: str, out: str = "score", at_least: float | None = None) -> DataFrame:
    """Add the ratio of two columns, row by row and without a shuffle.

    Equal pairs, pairs with a NULL and, where ``at_least`` is given, pairs that bounds settle are done in the JVM and
    reach Python as NULLs; a popular pair is compared once per Arrow batch.  With ``at_least`` a pair that cannot reach
    it gets an upper bound below it, so that verdicts are right, but not the ratio itself.
    """
    keyed = df.withColumn("_l", token_sorted(F.col(left))).withColumn("_r", token_sorted(F.col(right)))
    one, two = F.col("_l"), F.col("_r")
    if at_least is None:
        by = F.when(one == two, "equal").when(one != two, "compared")
        known = F.when(F.col("_by") == "equal", F.lit(1.0))
    else:
        by = stage(one, two, at_least)
        known = (
            F.when(F.col("_by") == "equal", F.lit(1.0)).when(F.col("_by").isin("contained", "length"), length_bound(one, two))
            .when(F.col("_by") == "letters", letter_bound(one, two))
        )
    asked = F.col("_by") == "compared"
    keyed = keyed.withColumn("_by", by).withColumn("_ratio", _ratio(F.when(asked, one), F.when(asked, two)))
    return keyed.withColumn(out, F.when(asked, F.col("_ratio")).otherwise(known)).drop("_l", "_r", "_ratio", "_by")
