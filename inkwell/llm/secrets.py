"""Secret scans with an incremental ledger of blobs, in DataFrame and SQL functions only.

Every historical version of a path is content-addressed by the SHA-256 of its bytes.  The ledger has one row
per (blob, rule version) that was ever scanned, with the blob's findings; a scan runs only over pairs that the
ledger lacks, each blob once however many paths hold it, and findings are joined back to all paths.

The position of a match is the total length of all text before it: splitting a text at a pattern gives the
gaps, extracting the pattern gives the matches, and both are summed up from the left.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import free_name, written


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its pattern, the group whose length counts (0: the match), and the least length.

    ``hint`` is a pattern that every text with a match contains; it is cheap to look for.
    """

    kind: str
    pattern: str
    group: int
    least: int
    hint: str


#: The base rules, in the order of their kinds.
BASE_RULES = (
    Rule(
        "assign",
        r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
        r"[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{6}",
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, r"AKIA[A-Z0-9]{16}"),
    Rule("hex", r"[0-9a-f]+", 0, 24, r"[0-9a-f]{24}"),
)
#: Names the rule set in the ledger; change it whenever the rules change.
BASE_VERSION = "base-1"

_SPAN = "array<struct<start:int,rank:int,end:int>>"


def _spans(text: Column, rule: Rule, rank: int) -> Column:
    """Spans of the matches of one rule: ``start``, ``rank`` and ``end`` (exclusive), in code points."""
    pattern = F.lit(rule.pattern)
    pairs = F.arrays_zip(
        F.split(text, rule.pattern, -1).alias("gap"),
        F.regexp_extract_all(text, pattern, F.lit(0)).alias("whole"),
        F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("counted"),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("found"))

    def step(done: Column, pair: Column) -> Column:
        begin = done["at"] + F.char_length(pair["gap"])
        end = begin + F.coalesce(F.char_length(pair["whole"]), F.lit(0))
        span = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), end.alias("end"))
        good = F.coalesce(F.char_length(pair["counted"]) >= rule.least, F.lit(False))
        found = F.when(good, F.concat(done["found"], F.array(span))).otherwise(done["found"])
        return F.struct(end.alias("at"), found.alias("found"))

    matched = F.aggregate(pairs, start, step, lambda done: done["found"])
    return F.when(text.rlike(rule.hint), matched).otherwise(F.array().cast(_SPAN))


def findings(text: Column, rules: tuple[Rule, ...] = BASE_RULES) -> Column:
    """All spans of a text by start, then in the order of the rules: array of ``start``, ``rank``, ``end``."""
    return F.array_sort(F.flatten(F.array(*(_spans(text, rule, i) for i, rule in enumerate(rules)))))


def listed(spans: Column, rules: tuple[Rule, ...] = BASE_RULES) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    kinds = F.array(*(F.lit(rule.kind) for rule in rules))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["rank"] + 1), s["start"], s["end"])), ","
    )


def blob_id(text: Column) -> Column:
    """Content address; null counts as the empty text."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def empty_ledger(like: DataFrame) -> DataFrame:
    """A ledger of no scans, in the session of ``like``."""
    none = like.sparkSession.range(0)
    return none.select(F.lit("").alias("blob"), F.lit("").alias("rules"), F.array().cast(_SPAN).alias("spans"))


def scan_unseen(
    versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = BASE_RULES, version: str = BASE_VERSION
) -> DataFrame:
    """Ledger rows (``blob``, ``rules``, ``spans``) of the blobs in ``text`` that ``ledger`` has no row of ``version`` for.

    Each such blob is scanned once.  Append the result to the ledger to make the next scan incremental.
    """
    blobs = versions.select(blob_id(F.col("text")).alias("blob"), F.coalesce("text", F.lit("")).alias("text"))
    seen = ledger.where(F.col("rules") == version).select("blob").distinct()
    unseen = blobs.join(seen, "blob", "left_anti")
    once = unseen.groupBy("blob").agg(F.first("text").alias("text"))
    return once.select("blob", F.lit(version).alias("rules"), findings(F.col("text"), rules).alias("spans"))


def all_paths(versions: DataFrame, ledger: DataFrame, version: str = BASE_VERSION) -> DataFrame:
    """Every row of ``versions`` with its blob's findings: all columns, and ``blob`` and ``spans``.

    Only blobs that have findings are joined; the text takes no part in the join.
    """
    blob, spans = free_name(versions, "blob"), free_name(versions, "spans")
    found = ledger.where((F.col("rules") == version) & (F.size("spans") > 0)).select(
        F.col("blob").alias(blob), F.col("spans").alias(spans)
    )
    joined = versions.withColumn(blob, blob_id(F.col("text"))).join(found, blob, "left")
    return joined.select(*versions.columns, blob, F.coalesce(F.col(spans), F.array().cast(_SPAN)).alias(spans))


def secrets(docs: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """Secrets in every document: ``doc_id``, ``n_assign``, ``n_access``, ``n_hex``, ``base_sha256``, ``spans``.

    ledger: blobs scanned before (none: an empty ledger).  Defined cases: null and empty texts have no findings;
    repeated rows stay repeated and are scanned once; an empty table gives an empty table; other columns
    are not read.
    """
    plain = docs.select(F.col("doc_id").cast("long"), "text")
    known = empty_ledger(docs) if ledger is None else ledger
    new = written(scan_unseen(plain, known), "ledger")
    rows = all_paths(plain.select("doc_id", "text"), known.unionByName(new)).select("doc_id", "spans")

    def count(rank: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["rank"] == rank)).cast("long")

    text = listed(F.col("spans"))
    return rows.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(text.cast("binary"), 256).alias("base_sha256"), text.alias("spans"),
    )
