"""Cheap substring guards in front of constant regular expressions.

A JVM pattern that starts with an alternation is tried at every position of the
text.  Most rule patterns need some plain word to be present, so a byte-level
``contains`` on that word decides most rows without running the pattern.
"""

from __future__ import annotations

from functools import reduce
from re import _parser as pattern_parser  # literal runs of a pattern, nothing is executed

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkwell.functions.text import rx


def _longest_literal(items) -> str:
    best = run = ""
    for op, arg in items:
        if str(op) == "LITERAL":
            run += chr(arg)
            best = max(best, run, key=len)
        else:
            run = ""
    return best


def _flatten(items):
    """Groups without repetition count as part of the enclosing sequence."""
    for op, arg in items:
        if str(op) == "SUBPATTERN" and not any(str(o) == "BRANCH" for o, _ in arg[3]):
            yield from _flatten(arg[3])
        else:
            yield op, arg


def required_literals(pattern: str, shortest: int = 3) -> list[str] | None:
    """Words of which at least one must occur for ``pattern`` to match."""
    items = list(_flatten(pattern_parser.parse(pattern)))
    if len(items) == 1 and str(items[0][0]) == "BRANCH":
        # a common prefix of the alternatives was factored out by the parser
        literals = [_longest_literal(_flatten(alt)) for alt in items[0][1][1]]
    else:
        literals = [_longest_literal(items)]
        branches = [arg[1] for op, arg in items if str(op) == "BRANCH"]
        if len(literals[0]) < shortest and branches:
            literals = [_longest_literal(_flatten(alt)) for alt in branches[0]]
    return literals if all(len(x) >= shortest for x in literals) else None


def quote(text: str) -> str:
    """SQL string literal."""
    escaped = text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\r", "\\r")
    return "'" + escaped.replace("\t", "\\t") + "'"


def contains_any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


# Rule tables expand to hundreds of expressions; those are generated as SQL
# text, which reaches the JVM in one call instead of one call per node.


def common_stems(literals: list[str], length: int = 4) -> dict[str, str]:
    """Each literal's stem: a short piece, shared by as many literals as possible.

    A text without the stem cannot hold the literal, so one scan per stem
    rules out all literals that share it.
    """
    open_literals, stem_of = set(literals), {}
    pieces: dict[str, set[str]] = {}
    for literal in open_literals:
        for i in range(max(1, len(literal) - length + 1)):
            pieces.setdefault(literal[i:i + length], set()).add(literal)
    while open_literals:
        stem = max(sorted(pieces), key=lambda p: len(pieces[p] & open_literals))
        for literal in pieces[stem] & open_literals:
            stem_of[literal] = stem
        open_literals -= pieces[stem]
    return stem_of


def contains_sql(text: str, words: list[str], stems: dict[str, str] | None = None) -> str:
    """Any of the words; ``stems`` maps a word to a cheaper necessary test."""
    tests = [
        f"({stems[w]} AND contains({text}, {quote(w)}))" if stems and w in stems else f"contains({text}, {quote(w)})" for w in words
    ]
    return "(" + " OR ".join(tests) + ")"


def match_sql(text: str, pattern: str, group: int = 0, stems: dict[str, str] | None = None, **flags: bool) -> str:
    """Trimmed match of ``pattern`` or NULL; guards first, pattern second."""
    hit = f"nullif(btrim(regexp_extract({text}, {quote(rx(pattern, **flags))}, {group}), ' \\t\\n\\r\\u000b\\f'), '')"
    if flags.get("ignore_case"):
        return hit
    words = required_literals(pattern)
    if words:
        return f"CASE WHEN {contains_sql(text, words, stems)} THEN {hit} END"
    if r"\b" in pattern:
        # word boundaries are costly at every position; the pattern without
        # them matches wherever the full one does, and fails faster
        loose = rx(pattern.replace(r"\b", ""), **flags)
        return f"CASE WHEN rlike({text}, {quote(loose)}) THEN {hit} END"
    return hit


def rlike_sql(text: str, pattern: str) -> str:
    words = required_literals(pattern)
    test = f"rlike({text}, {quote(rx(pattern))})"
    return f"({contains_sql(text, words)} AND {test})" if words else test
