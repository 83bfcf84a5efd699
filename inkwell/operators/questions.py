"""Question tables: Q1 intents, Q2 look-ups, Q3 summaries, Q4 key fields."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions.dates import human_date, human_period
from inkwell.functions.patterns import match_sql, quote
from inkwell.functions.text import let, rx, squeeze, strip
from inkwell.rules.intents import FIELD_LABELS, IFSC_NEVER, INTENTS, KEY_ORDER, PRIORITY, Intent
from inkwell.rules.signatures import TYPE_METADATA


def _intent_sql(intents: list[Intent], q: str) -> str:
    """Ordered CASE: priority words, then each intent's keywords and patterns."""
    whens, outer, q = [], q, "r.q"
    for key, words in PRIORITY:
        whens.append("WHEN " + " OR ".join(f"contains({q}, {quote(w)})" for w in words) + f" THEN '{key}'")
    for intent in intents:
        words = "|".join(re.escape(k) for k in intent.keywords)
        tests = [f"rlike({q}, {quote(rx(rf'\b(?:{words})\b'))})"]
        tests += [f"rlike({q}, {quote(rx(r))})" for r in intent.regexes]
        whens.append(f"WHEN {' OR '.join(tests)} THEN '{intent.key}'")
    whens.append(f"WHEN contains({q}, 'name') AND contains(lower(coalesce(r.doc_type, '')), 'pan') THEN 'account_holder'")
    # a lambda keeps the long CASE out of the generated stage code
    case = f"CASE {' '.join(whens)} END"
    return f"element_at(transform(array(named_struct('q', {outer}, 'doc_type', doc_type)), r -> {case}), 1)"


def detect_intents(questions: DataFrame, docs: DataFrame | None = None, intents: list[Intent] | None = None) -> DataFrame:
    """Q1: add ``intent`` (NULL when no field is asked for)."""
    rows = questions
    if "doc_type" not in rows.columns:
        rows = rows.join(docs.select("doc_id", "doc_type"), "doc_id", "left") if docs is not None else rows.withColumn(
            "doc_type", F.lit("")
        )
    norm = strip(squeeze(F.regexp_replace(F.lower(strip(F.col("question"))), r"[?!.,]", " ")))
    return rows.withColumn("_q", norm).withColumn("intent", F.expr(_intent_sql(intents or INTENTS, "_q"))).drop("_q")


def _pattern_value(intent: Intent) -> str:
    """First text match that the intent's validator accepts."""
    options = []
    for pattern in intent.patterns:
        value = match_sql("full_text", pattern, 1, ignore_case=True)
        subject = f"regexp_replace(v, '\\\\s+', '')" if intent.unspaced else "v"
        tests = [f"length(v) >= {intent.min_length}"]
        if intent.accept:
            tests.append(f"rlike({subject}, {quote(rx(intent.accept, ignore_case=True))})")
        if intent.refuse:
            tests.append(f"NOT rlike(v, {quote(rx(intent.refuse, ignore_case=True))})")
        options.append(f"element_at(transform(array({value}), v -> CASE WHEN {' AND '.join(tests)} THEN v END), 1)")
    return f"coalesce({', '.join(options)}, NULL)" if options else "CAST(NULL AS STRING)"


# A GSTIN on a line once its blanks are gone.
_GSTIN_LINE = r"([0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][1-9A-Z]Z[0-9A-Z])"


def _formatted(form: Column, value: Column) -> Column:
    v = strip(value)
    hidden = F.concat(F.repeat(F.lit("X"), F.length(v) - 4), F.right(v, F.lit(4)))
    return (
        F.when(form == "upper", F.upper(v))
        .when(form == "upper_unspaced", F.upper(F.regexp_replace(v, r"\s+", "")))
        .when(form == "squeeze", strip(squeeze(v)))
        .when(form == "account", F.when((F.length(v) > 6) & ~v.startswith("X"), hidden).otherwise(v))
        .when(form == "date", human_date(v))
        .when(form == "period", human_period(v))
        .otherwise(v)
    )


def lookup_fields(questions: DataFrame, fields: DataFrame, docs: DataFrame, totals: DataFrame | None = None,
                  intents: list[Intent] | None = None) -> DataFrame:
    """Q2: value and source per (document, intent).

    ``questions``: doc_id, intent.  Extracted fields first, by preference of
    the intent's names; else the text; then guards; then formatting.
    ``totals`` are transaction totals for the total question.
    """
    table = intents or INTENTS
    by_key = {i.key: i for i in table}
    names = F.create_map(*[x for i in table for x in (F.lit(i.key), F.array(*[F.lit(n) for n in i.fields]))])
    asked = questions.filter("intent IS NOT NULL").select("doc_id", "intent").distinct()
    wanted = asked.select("doc_id", "intent", F.posexplode(names[F.col("intent")]).alias("_rank", "field"))
    usable = (strip(F.col("value")) != "") & (F.lower(strip(F.col("value"))) != "none")
    best = wanted.join(fields.select("doc_id", "field", "value").filter(usable), ["doc_id", "field"]).groupBy("doc_id", "intent").agg(
        F.min_by("value", "_rank").alias("_extracted")
    )
    rows = asked.join(best, ["doc_id", "intent"], "left").join(docs.select("doc_id", "full_text"), "doc_id", "left")
    account = fields.filter("field = 'account_number'").groupBy("doc_id").agg(F.max("value").alias("_account"))
    rows = rows.join(account, "doc_id", "left")
    whens = " ".join(f"WHEN '{k}' THEN {_pattern_value(i)}" for k, i in by_key.items())
    # inside a lambda the long CASE stays out of the generated stage code
    by_intent = f"element_at(transform(array(intent), i -> CASE i {whens} END), 1)"
    rows = rows.withColumn("_ocr", F.when(F.col("_extracted").isNull(), F.expr(by_intent)))
    if "gstin" in by_key:
        unspaced = F.regexp_replace("full_text", r"[ \t]+", "")
        spaced = F.nullif(F.regexp_extract(unspaced, _GSTIN_LINE, 1), F.lit(""))
        use = (F.col("intent") == "gstin") & F.col("_extracted").isNull()
        rows = rows.withColumn("_ocr", F.when(use, F.coalesce(spaced, F.col("_ocr"))).otherwise(F.col("_ocr")))
    raw = F.coalesce("_extracted", "_ocr")
    text = strip(raw)
    guard = (
        F.when(
            F.col("intent") == "ifsc",
            ~F.upper(text).rlike(r"^[A-Z]{4}0[A-Z0-9]{6}$") | F.upper(text).rlike("|".join(IFSC_NEVER)),
        )
        .when(F.col("intent") == "customer_number", F.coalesce(text == strip(F.col("_account")), F.lit(False)))
        .when(F.col("intent") == "pan_number", F.length(text) != 10)
        .when(F.col("intent") == "date_of_birth", F.lower(text).contains("to") | text.contains("–"))
        .otherwise(False)
    )
    forms = F.create_map(*[F.lit(x) for i in table for x in (i.key, i.form)])
    rows = rows.withColumns({"_raw": raw, "_bad": F.coalesce(guard, F.lit(False))})
    source = (
        F.when(F.col("_raw").isNull(), "not_found").when(F.col("_bad"), "prohibited")
        .when(F.col("_extracted").isNotNull(), "extracted").otherwise("ocr")
    )
    value = F.when(F.col("_raw").isNotNull() & ~F.col("_bad"), _formatted(forms[F.col("intent")], F.col("_raw")))
    out = rows.withColumns({"value": value, "source": source})
    if totals is not None:
        out = out.join(totals, "doc_id", "left")

        def money(c: str) -> Column:
            return F.format_number(F.col(c).cast("decimal(28,2)"), 2)

        said = F.concat(
            F.lit("I found a total transaction amount of ₹"), money("total_amount"), F.lit(" across the "),
            F.col("n_transactions").cast("string"), F.lit(" transactions visible in this statement.\n\n• Credits / Deposits: ₹"),
            money("credit_amount"), F.lit(" ("), F.col("credit_count").cast("string"),
            F.lit(" transactions)\n• Debits / Withdrawals: ₹"), money("debit_amount"), F.lit(" ("),
            F.col("debit_count").cast("string"), F.lit(" transactions)"),
        )
        use = (F.col("intent") == "total_transactions") & F.col("n_transactions").isNotNull()
        out = out.withColumns({
            "value": F.when(use, said).otherwise(F.col("value")), "source": F.when(use, "extracted").otherwise(F.col("source")),
        })
    return out.select("doc_id", "intent", "value", "source")


# Fields a summary line reads.
_SUMMARY_FIELDS = [
    "gstin", "legal_name", "constitution_of_business", "name", "pan_number", "account_number", "account_holder",
    "bank_name", "employee_name", "employer", "position", "assessment_year", "section", "invoice_number", "total_amount",
]


def summaries(docs: DataFrame, fields: DataFrame) -> DataFrame:
    """Q3: one factual sentence per classified document."""
    wide = fields.filter(F.col("field").isin(_SUMMARY_FIELDS)).groupBy("doc_id").agg(
        *[F.max(F.when(F.col("field") == n, F.col("value"))).alias(n) for n in _SUMMARY_FIELDS]
    )
    rows = docs.select("doc_id", "doc_type").join(wide, "doc_id", "left")

    def has(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit("")) != ""

    def opt(cond: Column, *parts) -> Column:
        return F.when(cond, F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])).otherwise("")

    def say(*parts) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    c = lambda n: F.coalesce(F.col(n), F.lit(""))
    titles = F.create_map(*[F.lit(x) for t, (n, _) in TYPE_METADATA.items() for x in (t, n)])
    issuers = F.create_map(*[F.lit(x) for t, (_, i) in TYPE_METADATA.items() for x in (t, i)])
    dt = F.col("doc_type")
    text = (
        F.when(dt == "unknown", "This document could not be reliably classified into a recognized document type based on its visible content.")
        .when(
            dt == "gst_certificate",
            say("This document is a GST Registration Certificate (Registration Number: ", c("gstin"), ") issued by Government of India - GST",
                opt(has("legal_name"), " to ", c("legal_name")),
                opt(has("constitution_of_business"), " for business operating as a ", c("constitution_of_business")), "."),
        )
        .when(
            dt == "pan",
            say("This document is a Permanent Account Number (PAN) Card issued by the Income Tax Department, Government of India",
                opt(has("name"), " for ", c("name")), opt(has("pan_number"), " (PAN: ", c("pan_number"), ")"), "."),
        )
        .when(
            dt == "aadhaar",
            "This document is an Aadhaar Card issued by the Unique Identification Authority of India (UIDAI), serving as official identity and residence verification.",
        )
        .when(
            dt == "bank_statement",
            say("This document is a Bank Statement for account held by ", F.coalesce(F.nullif(c("account_holder"), F.lit("")), F.lit("the account holder")),
                " at ", F.coalesce(F.col("bank_name"), F.lit("the bank")), opt(has("account_number"), " (Account No: ", c("account_number"), ")"), "."),
        )
        .when(
            dt == "employment_contract",
            say("This document is an Employment Agreement",
                opt(has("employer") & has("employee_name"), " between ", c("employer"), " and ", c("employee_name")),
                opt(has("position"), " for the position of ", c("position")), "."),
        )
        .when(
            dt == "income_tax_notice",
            say("This document is an official Income Tax Department notice issued under the Income Tax Act",
                opt(has("section"), " (Section ", c("section"), ")"), opt(has("assessment_year"), " for Assessment Year ", c("assessment_year")), "."),
        )
        .when(
            dt == "commercial_invoice",
            say("This document is a Commercial Invoice", opt(has("invoice_number"), " #", c("invoice_number")),
                opt(has("total_amount"), " for total amount ", c("total_amount")), "."),
        )
        .otherwise(
            say("This document was analyzed and identified as a ", F.coalesce(F.try_element_at(titles, dt), dt), " issued by ",
                F.coalesce(F.try_element_at(issuers, dt), F.lit("the authorized authority")), ".")
        )
    )
    return rows.select("doc_id", "doc_type", text.alias("summary"))


def key_fields(fields: DataFrame, docs: DataFrame) -> DataFrame:
    """Q4: fields in the type's preferred order, then the rest by name.

    The position is (preferred rank, name), so no per-document sort is needed
    to state the order.
    """
    title = F.create_map(*[F.lit(x) for t, (n, _) in TYPE_METADATA.items() for x in (t, n)])
    rows = fields.drop("doc_type").join(docs.select("doc_id", "doc_type"), "doc_id") if "doc_type" in docs.columns else fields
    usable = (strip(F.col("value")) != "") & (F.lower(strip(F.col("value"))) != "none")
    rows = rows.filter(usable).withColumn(
        "_kind", F.lower(F.coalesce(F.try_element_at(title, F.col("doc_type")), F.col("doc_type"), F.lit("")))
    )
    order = F.lit(None).cast("array<string>")
    for word, names in reversed(KEY_ORDER):
        order = F.when(F.col("_kind").contains(word), F.array(*[F.lit(n) for n in names])).otherwise(order)
    at = F.coalesce(F.array_position(order, F.col("field")), F.lit(0))
    labels = F.create_map(*[F.lit(x) for pair in FIELD_LABELS.items() for x in pair])
    label = F.coalesce(F.try_element_at(labels, F.col("field")), F.initcap(F.replace("field", F.lit("_"), F.lit(" "))))
    shown = F.when(F.col("field") == "statement_period", human_period(F.col("value"))).otherwise(F.col("value"))
    return rows.select(
        "doc_id", "doc_type", "field", label.alias("label"), shown.alias("value"),
        F.when(at > 0, at).otherwise(1000).cast("int").alias("rank"),
    )
