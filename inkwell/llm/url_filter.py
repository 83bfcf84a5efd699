"""URL filters by a cascade of Bloom filters, in DataFrame and SQL functions only.

A rule has a host and a path; it fits a URL whose host is the rule's or below it and whose path starts with the
rule's.  So every URL has a few candidate keys (host suffix + path prefix), and a rule fits if and only if its
key is one of them.  The universe is the set of all candidate keys of the corpus.  Level 1 of the cascade holds
the listed keys; level 2 the keys of the universe that level 1 takes for listed but are not; level 3 the listed
keys that level 2 takes; and so on until no key is mistaken.  A key of the universe is then listed if and only
if the first level that does not hold it is an even one: membership is exact, and looking it up needs no join.
"""

from __future__ import annotations

from functools import reduce
from math import ceil, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import free_name, written

#: Bits of a level for each key and probe (the best use of the bits).
BITS = 1.45
#: Bits of a level at most: it goes to every task as a constant.  A longer list is an error, not a cut.
MAX_BITS = 1 << 26
#: Different lengths of the rules' paths at most (each makes a candidate key); more are an error, not a cut.
MAX_LENGTHS = 256
#: Levels of a cascade at most; each is a small part of the one before it.
MAX_LEVELS = 64


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; none: empty."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; none: empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def candidate_keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """Keys of all rules that could fit: host suffixes at dots with path prefixes of the rules' path lengths.

    Longest host first, and of one host the longest path first.
    """
    labels = F.split(host, r"\.", -1)
    places = F.sequence(F.lit(1), F.size(labels))
    suffixes = F.transform(places, lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    longest = sorted({0, *lengths}, reverse=True)
    prefixes = F.filter(
        F.array(*(F.when(F.char_length(path) >= n, F.substring(path, 1, n)) for n in longest)), lambda p: p.isNotNull()
    )
    return F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))


def _probe(key: Column, level: int, probe: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(level), F.lit(probe)), F.lit(bits).cast("long"))


class Cascade:
    """The levels: each a number of bits, a number of probes, and its bit words as one text (comma-joined longs)."""

    def __init__(self, levels: list[tuple[int, int, str]]):
        self.levels = levels

    def holds(self, key: Column, number: int) -> Column:
        """Whether one level has all probes of the key set."""
        bits, probes, words = self.levels[number]
        array = F.split(F.lit(words), ",").cast("array<long>")  # folded to a constant by the optimizer

        def bit(i: int) -> Column:
            at = _probe(key, number, i, bits)
            word = F.element_at(array, (F.shiftright(at, 6) + 1).cast("int"))
            return F.getbit(word, F.pmod(at, F.lit(64)).cast("int")) == 1

        return reduce(lambda a, b: a & b, (bit(i) for i in range(probes)))

    def contains(self, key: Column) -> Column:
        """Whether a key of the universe is listed."""
        found = F.lit(len(self.levels) % 2 == 1)
        for number in reversed(range(len(self.levels))):
            found = F.when(~self.holds(key, number), F.lit(number % 2 == 1)).otherwise(found)
        return found


def _level(keys: DataFrame, number: int, size: int, probes: int) -> tuple[int, int, str]:
    bits = max(64, ceil(size * probes * BITS / 64) * 64)
    if bits > MAX_BITS:
        raise ValueError(f"a level of {bits} bits is too large to go to every task; split the list")
    places = keys.select(F.explode(F.array(*(_probe(F.col("key"), number, i, bits) for i in range(probes)))).alias("at"))
    one = F.expr("shiftleft(1L, cast(pmod(at, 64) AS int))")
    words = places.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(one).alias("bits"))
    found = {r["word"]: r["bits"] for r in words.collect()}  # at most MAX_BITS / 64 words
    return bits, probes, ",".join(str(found.get(i, 0)) for i in range(bits // 64))


def build(listed: DataFrame, universe: DataFrame) -> Cascade:
    """Cascade for the keys of ``listed`` (column ``key``), exact for all keys of ``universe`` (column ``key``).

    Listed keys that the universe lacks need no place in it and are left out.  The first level has as many probes
    as it takes to mistake fewer keys of the universe than are listed, so the levels' size follows the list and
    only the logarithm of the universe.
    """
    every = universe.select("key").where("key IS NOT NULL").distinct()
    inside = written(every.join(listed.select("key").distinct(), "key", "left_semi"), "listed")
    outside = every.join(inside, "key", "left_anti")
    cascade, held, others = Cascade([]), inside, written(outside, "others")
    while True:
        number = len(cascade.levels)
        size = held.count()
        if not size:
            return cascade
        if number == MAX_LEVELS:
            raise RuntimeError(f"keys are still mistaken after {MAX_LEVELS} levels")
        probes = 2 if number else max(2, ceil(log2(max(1, others.count()) / size)) + 1)
        cascade.levels.append(_level(held, number, size, probes))
        mistaken = written(others.where(cascade.holds(F.col("key"), number)), "mistaken")
        held, others = mistaken, held


def judge(pages: DataFrame, rules: DataFrame, otherwise: str = "allow") -> DataFrame:
    """All rows of ``pages`` with ``host``, ``path``, ``rule`` and ``verdict``.

    rules: ``host``, ``path`` (starts with ``/``, or empty), ``verdict`` (allow or block).  Of the rules that fit, the one with the longest host
    wins, then the longest path; without one, the verdict is ``otherwise``.  There is a cascade for the rules of
    each verdict; rules that stand with both verdicts block.

    Defined cases: null urls and urls without ``://`` have an empty host and path and the verdict ``otherwise``;
    no rules: ``otherwise`` everywhere; very long urls are read whole; repeated rows stay repeated; an empty
    table gives an empty table; columns of ``pages`` that have one of the new names keep it, and the new one
    gets underscores appended.
    """
    names = {n: free_name(pages, n) for n in ("host", "path", "rule", "verdict", "inkwell_keys")}
    rules = rules.select("host", "path", "verdict").distinct()
    lengths = [r["n"] for r in rules.select(F.char_length("path").alias("n")).distinct().limit(MAX_LENGTHS + 1).collect()]
    if len(lengths) > MAX_LENGTHS:
        raise ValueError(f"the rules' paths have more than {MAX_LENGTHS} lengths")
    split = pages.withColumns({names["host"]: host_of(F.col("url")), names["path"]: path_of(F.col("url"))})
    keys = candidate_keys(F.col(names["host"]), F.col(names["path"]), lengths)
    universe = split.select(F.explode(keys).alias("key"))
    key = F.concat("host", "path").alias("key")
    universe = written(universe.distinct(), "universe")
    blocked = build(rules.where("verdict = 'block'").select(key), universe)
    allowed = build(rules.where("verdict = 'allow'").select(key), universe)
    fitting = F.filter(keys, lambda k: blocked.contains(k) | allowed.contains(k))
    marked = split.withColumn(names["rule"], F.get(fitting, F.lit(0)))
    rule = F.col(names["rule"])
    verdict = F.when(rule.isNull(), F.lit(otherwise)).when(blocked.contains(rule), "block").otherwise("allow")
    return marked.withColumn(names["verdict"], verdict)
