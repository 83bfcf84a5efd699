"""Many user rules over many pages: one pass finds the rules that a page can match, and only these are tried.

Most patterns have texts of which every match contains one.  An automaton over these texts reads a page once, whatever
the number of rules; patterns without such texts are tried on every page.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.functions.patterns import required_literals

#: Letters of all patterns up to which the rules are sent to every task.
MOST_LETTERS = 16 << 20

_RULE = "array<struct<doc_type string, tier string, pattern string>>"


def needed_texts(pattern: str) -> list[str] | None:
    """Texts of which a match of a Java pattern contains at least one; null where that is not plain to see."""
    if re.search(r"\(\?-?[a-zA-Z]|\\[QEpPXRGhHvV]", pattern):
        return None  # flags, quotations and what Python reads in another way
    try:
        return required_literals(pattern)
    except (re.error, OverflowError):
        return None


def possible_rules(pages: DataFrame, rules: DataFrame, text: str, out: str) -> DataFrame | None:
    """Add ``out``, the rules (``doc_type``, ``tier``, ``pattern``) that a page's text may match; null if the rules are too many
    to send to every task."""
    size = rules.agg(F.sum(F.length("pattern") + F.length("doc_type") + F.length("tier"))).first()[0] or 0
    if size > MOST_LETTERS:
        return None
    kept = [tuple(r) for r in rules.select("doc_type", "tier", "pattern").where("pattern IS NOT NULL").collect()]
    by_text: dict[str, list[int]] = {}
    always = []
    for i, (_, _, pattern) in enumerate(kept):
        texts = needed_texts(pattern)
        if texts is None:
            always.append(i)
        for text_needed in texts or []:
            by_text.setdefault(text_needed, []).append(i)
    shared = pages.sparkSession.sparkContext.broadcast((kept, by_text, always))

    def found(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        kept, by_text, always = shared.value
        automaton = ahocorasick.Automaton()
        for need, ids in by_text.items():
            automaton.add_word(need, ids)
        if by_text:
            automaton.make_automaton()
        for part in texts:
            hits = []
            for page in part:
                ids = set(always)
                if by_text and isinstance(page, str):
                    ids.update(i for _, some in automaton.iter(page) for i in some)
                hits.append([dict(zip(("doc_type", "tier", "pattern"), kept[i], strict=True)) for i in sorted(ids)])
            yield pd.Series(hits)

    return pages.withColumn(out, F.pandas_udf(found, _RULE)(F.col(text)))
