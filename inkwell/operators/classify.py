"""J7 signature match, A5 classification, J8 type mismatch, A14 detection sweep.

Classification is row-local: a document and its pages live in one row, so no
shuffle is needed to score all types and pick the best.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions.identifiers import pan_reason, verhoeff_ok
from inkwell.functions.patterns import common_stems, contains_any, match_sql, quote, required_literals, rlike_sql
from inkwell.functions.text import rx, strip
from inkwell.operators.redact import normalise_text
from inkwell.operators.rule_match import possible_rules
from inkwell.rules.signatures import PRIMARY_ANCHORS, SIGNATURES, TYPE_METADATA

# Page marker, weights and confidence steps, exclusion words.
PAGE_MARKER = r"(?:---|===)\s*Page\s*(\d+)\s*(?:---|===)"
PRIMARY_WEIGHT, SECONDARY_WEIGHT = 3, 1
PASSBOOK_WORDS = ["PASSBOOK", "PASS BOOK", "पासबुक"]
PAYSLIP_WORDS = ["SALARY SLIP", "PAYSLIP", "PAY SLIP", "वेतन पावती"]
UID_NUMBER = r"\b([2-9][0-9]{3}\s+[0-9]{4}\s+[0-9]{4})\b"
UID_MARKS = [r"\b[2-9][0-9]{3}\s+[0-9]{4}\s+[0-9]{4}\b", r"\bXXXX\s+XXXX\s+[0-9]{4}\b", r"\bVID\s*:\s*\d{4}"]
UID_WORDS = ["MALE", "FEMALE", "DOB", "YEAR OF BIRTH", "GOVERNMENT OF INDIA", "ENROLMENT"]
PAN_NUMBER = r"\b([A-Z]{5}[0-9]{4}[A-Z])\b"
PAN_WORDS = ["GOVT", "INDIA", "FATHER", "INCOME"]
GSTIN_NUMBER = r"\b([0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][1-9A-Z]Z[0-9A-Z])\b"
NO_EVIDENCE = "Insufficient legible text or standardized institutional markers detected"
TYPES = list(PRIMARY_ANCHORS)


def secondary_patterns(doc_type: str) -> list[str]:
    return [p for p in SIGNATURES.get(doc_type, []) if p not in PRIMARY_ANCHORS[doc_type]]


def _stem_tests() -> tuple[list[str], dict[str, str]]:
    """Stems of the anchors' words, and the column entry that tests each word's."""
    words = [w for patterns in PRIMARY_ANCHORS.values() for p in patterns for w in (required_literals(p) or [])]
    stem_of = common_stems(words)
    stems = sorted(set(stem_of.values()))
    return stems, {w: f"_stems[{stems.index(s)}]" for w, s in stem_of.items()}


_STEMS, _STEM_OF = _stem_tests()


def page_array(text: Column) -> Column:
    """``ARRAY<STRUCT<num, text>>``; text before the first marker is page 1."""
    marker = rx(PAGE_MARKER, ignore_case=True)
    parts = F.split(text, marker)
    numbers = F.regexp_extract_all(text, F.lit(marker), F.lit(1))

    def page(num: Column, body: Column) -> Column:
        return F.struct(num.cast("int").alias("num"), body.alias("text"))

    marked = F.transform(numbers, lambda n, i: page(n, F.get(parts, i + 1)))
    first = F.when(strip(parts[0]) != "", F.array(page(F.lit(1), parts[0]))).otherwise(
        F.array().cast("array<struct<num:int,text:string>>")
    )
    return F.when(F.size(numbers) == 0, F.array(page(F.lit(1), text))).otherwise(F.concat(first, marked))


def split_pages(docs: DataFrame, text: str = "full_text") -> DataFrame:
    """One row per page of each document."""
    kept = [c for c in docs.columns if c != text]
    pages = docs.select(*kept, F.posexplode(page_array(F.col(text))).alias("page_ord", "_p"), F.col(text).alias("_t"))
    return pages.select(*kept, "page_ord", F.col("_p.num").alias("page_num"), F.col("_p.text").alias("page_text"))


def match_signatures(pages: DataFrame, signatures: DataFrame | None = None, text: str = "page_text") -> DataFrame:
    """Every page x every signature that occurs, with the matched text.

    The built-in patterns are constants of one projection (compiled once per
    task).  Of rules given as a table an automaton picks those that a page may
    match, and only these are tried (see ``rule_match``); a table beyond its
    size bound is joined.
    """
    upper = pages.withColumn("_u", F.upper(text))
    if signatures is not None:
        evidence = r"btrim(regexp_extract(_u, concat('(?d)', _r.pattern), 0), ' \t\n\r')"
        kept = [c for c in pages.columns if c != text]
        narrowed = possible_rules(upper, signatures, "_u", "_rules")
        if narrowed is not None:
            tried = narrowed.withColumn("_r", F.explode("_rules")).where("rlike(_u, concat('(?d)', _r.pattern))")
        else:  # more rules than every task should hold: each page against each rule
            tried = upper.join(signatures.select(F.struct("doc_type", "tier", "pattern").alias("_r")), F.expr("rlike(_u, concat('(?d)', _r.pattern))"))
        return tried.select(*kept, "_r.doc_type", "_r.tier", F.expr(evidence).alias("evidence"))
    hits = [
        f"named_struct('doc_type', '{t}', 'tier', '{tier}', 'evidence', {match_sql('_u', p)})"
        for t in TYPES
        for tier, patterns in (("primary", PRIMARY_ANCHORS[t]), ("secondary", secondary_patterns(t)))
        for p in patterns
    ]
    kept = [c for c in pages.columns if c != text]
    found = F.expr(f"filter(array({', '.join(hits)}), h -> h.evidence IS NOT NULL)")
    return upper.select(*kept, F.explode(found).alias("_h")).select(*kept, "_h.*")


def _evidence(patterns: list[str]) -> str:
    """Distinct evidence in pattern-then-page order, page tagged if several."""
    if not patterns:
        return "CAST(array() AS ARRAY<STRING>)"
    tag = "IF(_multi, concat('[Page ', p.num, '] '), '')"
    per_page = ", ".join(f"transform(_pages, p -> concat({tag}, {match_sql('p.text', x, stems=_STEM_OF)}))" for x in patterns)
    return f"array_distinct(array_compact(flatten(array({per_page}))))"


def _whole_text_evidence(patterns: list[str]) -> str:
    return f"array_distinct(array_compact(array({', '.join(match_sql('_upper', x, stems=_STEM_OF) for x in patterns)})))"


def _own_hits(upper: str, patterns: list[str]) -> str:
    return " + ".join(f"CAST({rlike_sql(upper, p)} AS INT)" for p in patterns)


def with_classification(docs: DataFrame, min_margin: int = 0, text: str = "full_text",
                        normalised: bool = False) -> DataFrame:
    """A5: add type, title, confidence, level, evidence and issuer to ``docs``.

    ``normalised`` says that column ``norm_text`` is already there.
    """
    base = docs if normalised else normalise_text(docs, text)
    base = base.withColumn("_upper", F.upper("norm_text")).withColumn(
        "_pages",
        F.transform(page_array(F.col("norm_text")), lambda p: F.struct(p["num"].alias("num"), F.upper(p["text"]).alias("text"))),
    )
    stems = ", ".join(f"contains(_upper, {quote(stem)})" for stem in _STEMS)
    base = base.withColumns({"_multi": F.size("_pages") > 1, "_stems": F.expr(f"array({stems})")})
    upper = F.col("_upper")

    # stage 1: primary anchors of all types
    base = base.withColumns({f"_p_{t}": F.expr(_evidence(PRIMARY_ANCHORS[t])) for t in TYPES})
    fallback = {
        f"_p_{t}": F.expr(
            f"IF(_multi AND size(_p_{t}) = 0, {_whole_text_evidence(PRIMARY_ANCHORS[t])}, _p_{t})"
        )
        for t in TYPES
    }
    uid = F.expr(" OR ".join(f"rlike(_upper, {quote(rx(mark))})" for mark in UID_MARKS))
    base = base.withColumns(fallback).withColumn(
        "_uid_present", (F.size("_p_aadhaar") > 0) | (contains_any(upper, UID_WORDS) & uid)
    )
    pan_text = F.nullif(F.regexp_extract(upper, rx(PAN_NUMBER), 1), F.lit(""))
    base = base.withColumn(
        "_pan_alone",
        F.when((F.size("_p_pan") == 0) & ~F.col("_uid_present") & contains_any(upper, PAN_WORDS),
               F.when(pan_reason(pan_text).isNull(), pan_text)),
    )

    # stage 2: secondary evidence only for types that have an anchor
    barred = {
        "pan": F.col("_uid_present"),
        "bank_statement": contains_any(upper, PASSBOOK_WORDS),
        "cancelled_cheque": contains_any(upper, PASSBOOK_WORDS),
        "employment_contract": contains_any(upper, PAYSLIP_WORDS),
    }
    base = base.withColumns({f"_barred_{t}": rule for t, rule in barred.items()})
    candidates = []
    for order, t in enumerate(TYPES):
        primary = f"_p_{t}"
        second = f"array_except({_evidence(secondary_patterns(t))}, {primary})"
        if t == "pan":
            primary = "IF(_pan_alone IS NULL, _p_pan, array(concat('PAN: ', _pan_alone)))"
        allowed = f"size({primary}) > 0" + (f" AND NOT _barred_{t}" if t in barred else "")
        entry = f"named_struct('t', '{t}', 'o', {order}, 'p', {primary}, 's', {second})"
        candidates.append(f"CASE WHEN {allowed} THEN {entry} END")
    # negative score first so that an ascending sort puts the best first
    ranked = f"""
        array_sort(transform(array_compact(array({', '.join(candidates)})), c -> named_struct(
          'neg', -(size(c.p) * {PRIMARY_WEIGHT} + size(c.s) * {SECONDARY_WEIGHT}), 'o', c.o, 't', c.t,
          'np', size(c.p), 'ns', size(c.s), 'ev', concat(c.p, c.s))))"""
    base = base.withColumn("_ranked", F.expr(ranked))
    first, second = F.get("_ranked", F.lit(0)), F.get("_ranked", F.lit(1))
    close = second["neg"] - first["neg"] < min_margin
    base = base.withColumn(
        "_best",
        F.when(F.length(strip(F.coalesce(F.col(text), F.lit("")))) < 10, F.lit(None))
        .when(F.coalesce(close & (first["np"] < second["np"]), F.lit(False)), second)
        .otherwise(first),
    ).withColumn(
        "_tied",
        F.coalesce(close & (first["np"] == second["np"]), F.lit(False)) if min_margin > 0 else F.lit(False),
    )
    best = F.col("_best")
    dt, ns, np_, ev = best["t"], best["ns"], best["np"], best["ev"]
    uid_value = F.regexp_extract(upper, rx(UID_NUMBER), 1)
    gst_value = F.regexp_extract(upper, rx(GSTIN_NUMBER), 1)
    bonus = (
        F.when((dt == "aadhaar") & (uid_value != "") & verhoeff_ok(uid_value), 0.04)
        .when((dt == "aadhaar") & F.exists(ev, lambda e: e.contains("XXXX")), 0.03)
        .when((dt == "pan") & pan_text.isNotNull() & pan_reason(pan_text).isNull(), 0.04)
        .when((dt == "gst_certificate") & (gst_value != ""), 0.04)
        .when(
            (dt == "cancelled_cheque")
            & (upper.contains("IFSC") | F.exists(ev, lambda e: e.rlike(r"\b[A-Z]{4}0[A-Z0-9]{6}\b"))), 0.04
        )
        .when(dt.isin("bank_statement", "salary_slip", "utility_bill", "udyam", "fssai") & (ns >= 2), 0.04)
        .otherwise(0.0)
    )
    confidence = F.least(
        F.lit(0.98),
        F.round(
            F.lit(0.72) + F.least(F.lit(0.16), (np_ - 1) * F.lit(0.08)) + F.least(F.lit(0.06), ns * F.lit(0.03)) + bonus, 4
        ),
    )
    known = dt.isNotNull() & ~F.col("_tied")
    titles = F.create_map(*[F.lit(x) for t, (name, _) in TYPE_METADATA.items() for x in (t, name)])
    issuers = F.create_map(*[F.lit(x) for t, (_, issuer) in TYPE_METADATA.items() for x in (t, issuer)])
    too_short = F.length(strip(F.coalesce(F.col(text), F.lit("")))) < 10
    empty = F.array().cast("array<string>")
    out = base.withColumn("confidence", F.when(known, confidence)).withColumns({
        "doc_type": F.when(known, dt).otherwise("unknown"),
        "document_type": F.when(known, titles[dt]).otherwise("Unknown Document"),
        "confidence_level": F.when(~known, "low").when(F.col("confidence") >= 0.85, "high")
        .when(F.col("confidence") >= 0.60, "medium").otherwise("low"),
        "evidence": F.when(dt.isNotNull(), ev).when(too_short, empty).otherwise(F.array(F.lit(NO_EVIDENCE))),
        "issuer": F.when(known, issuers[dt]),
        "n_primary": F.when(known, np_),
        "n_secondary": F.when(known, ns),
    })
    scratch = [f"_p_{t}" for t in TYPES] + [
        "_upper", "_pages", "_multi", "_stems", "_uid_present", "_pan_alone", "_ranked", "_best", "_tied"
    ] + [f"_barred_{t}" for t in barred]
    return out.drop(*scratch, *([] if normalised else ["norm_text"]))


def classify(docs: DataFrame, min_margin: int = 0, text: str = "full_text") -> DataFrame:
    return with_classification(docs.select("doc_id", text), min_margin, text).drop(text)


def own_score(requested: str, upper: str) -> Column:
    """Number of the requested type's own patterns that occur in the text."""
    branches = " ".join(f"WHEN '{t}' THEN {_own_hits(upper, patterns)}" for t, patterns in SIGNATURES.items())
    return F.expr(f"CASE {requested} {branches} ELSE 0 END")


def with_mismatch(requests: DataFrame, text: str = "full_text", min_score: int = 2, min_margin: int = 1) -> DataFrame:
    """Add ``is_mismatch`` and ``detected_type`` to rows with a requested_type."""
    kept = requests.columns
    found = with_classification(requests, min_margin, text).withColumn("_u", F.upper(text))
    other = (F.col("doc_type") != "unknown") & (F.col("doc_type") != F.col("requested_type"))
    verdict = F.when(other, own_score("requested_type", "_u") < min_score).otherwise(False)
    out = found.withColumn("is_mismatch", verdict)
    return out.select(*kept, F.when(F.col("is_mismatch"), F.col("doc_type")).alias("detected_type"), "is_mismatch")


def type_mismatch(requests: DataFrame, text: str = "full_text", min_score: int = 2, min_margin: int = 1) -> DataFrame:
    """Rows (doc_id, requested_type, text) with detected type and verdict."""
    return with_mismatch(requests.select("doc_id", "requested_type", text), text, min_score, min_margin).drop(text)


def detection_matrix(samples: DataFrame, text: str = "full_text", min_score: int = 2) -> DataFrame:
    """One row per actual type, one column of mismatch counts per claim, and the number of wrong verdicts.

    Each text is classified once; its verdicts for all claims are one array, and a single aggregate counts them.
    """
    found = with_classification(samples, 1, text).withColumn("_u", F.upper(text))
    scores = ", ".join(_own_hits("_u", patterns) for patterns in SIGNATURES.values())
    scored = found.select("expected_type", "doc_type", F.expr(f"array({scores})").alias("_s"))
    verdicts = F.array(*[
        (F.col("doc_type") != "unknown") & (F.col("doc_type") != t) & (F.get("_s", F.lit(i)) < min_score) for i, t in enumerate(SIGNATURES)
    ])
    judged = scored.select("expected_type", "doc_type", verdicts.alias("_m"))
    wrong = F.lit(0)
    for i, t in enumerate(SIGNATURES):
        mismatch = F.get("_m", F.lit(i))
        failure = F.when(F.col("expected_type") == t, mismatch).otherwise(~(mismatch & (F.col("doc_type") == F.col("expected_type"))))
        wrong = wrong + failure.cast("int")
    return judged.groupBy("expected_type").agg(
        *[F.count_if(F.get("_m", F.lit(i))).alias(t) for i, t in enumerate(SIGNATURES)], F.sum(wrong).alias("failures")
    )


def self_detection(samples: DataFrame, text: str = "full_text") -> DataFrame:
    """Samples per expected and detected type with pass/fail."""
    found = with_classification(samples, 1, text)
    counts = found.groupBy("expected_type", F.col("doc_type").alias("detected_type")).agg(F.count("*").alias("samples"))
    return counts.withColumn("passed", F.col("expected_type") == F.col("detected_type"))
