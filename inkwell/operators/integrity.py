"""Integrity findings and risk: A6-A10, J5, J9, U1."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell.functions.dates import parse_amount, parse_date
from inkwell.functions.identifiers import gstin_reason, pan_reason, verhoeff_ok
from inkwell.functions.patterns import quote
from inkwell.functions.text import let, matched, rx, strip

# Weight per signal, in look-up order.
SIGNAL_WEIGHTS: dict[str, int] = {
    "qr_mismatch": 40, "qr_data_mismatch": 40, "invalid_checksum": 30, "pan_format_invalid": 30,
    "aadhaar_checksum_invalid": 30, "gstin_checksum_invalid": 30, "math_inconsistency": 30,
    "balance_inconsistency": 30, "duplicate_field": 20, "duplicate_field_label": 20,
    "pasted_white_patch": 20, "white_patch": 20, "cloned_stamp": 25, "duplicated_stamp": 25,
    "cloned_signature": 25, "overwritten_text": 20, "overlap": 15, "overlapping_text_regions": 15,
    "font_mismatch": 15, "font_size_inconsistency": 15, "inconsistent_font_weight": 15,
    "alignment_issue": 10, "abnormal_alignment": 10, "uneven_text_baseline": 10, "shifted_numbers": 10,
    "misaligned_fields": 10, "compression_issue": 10, "compression_artifact": 10,
    "blurred_edited_region": 10, "cut_and_paste_edges": 10, "background_texture_anomaly": 10, "cropped_borders": 10,
}
DEFAULT_WEIGHT = 10

# Label pattern, display name, words that exclude a line.
LABELS: list[tuple[str, str, list[str]]] = [
    (r"\bname\b", "Name", ["father", "mother", "husband", "spouse", "company", "employer", "trade", "firm"]),
    (r"\bfather'?s?\s*name\b", "Father's Name", []),
    (r"\bdate\s*of\s*birth\b|\bdob\b", "Date of Birth", []),
    (r"\bpan\s*(?:no|number)?\b", "PAN", []),
    (r"\baadhaar\s*(?:no|number)?\b", "Aadhaar", []),
    (r"\bgross\s*(?:pay|salary|wages)\b", "Gross Pay", []),
    (r"\bnet\s*(?:pay|salary|amount)\b", "Net Pay", []),
    (r"\btax\s*invoice\b", "Tax Invoice", []),
]
TABULAR_TYPES = ["bank_statement", "commercial_invoice", "invoice", "statement"]

# Thresholds of the layout rules.
MIN_IOU, MIN_CONTAINMENT = 0.15, 0.45
CELL = 64.0


def finding(signal: str, category: str, score: int, description: Column | str) -> Column:
    text = F.lit(description) if isinstance(description, str) else description
    return F.struct(
        F.lit(signal).alias("signal"), F.lit(category).alias("category"), F.lit(score).alias("score"), text.alias("description")
    )


def _one_per_doc(docs: DataFrame, entry: Column) -> DataFrame:
    return docs.select("doc_id", F.lit(0).alias("ordinal"), entry.alias("_f")).select("doc_id", "ordinal", "_f.*")


def _overlap_ratios(a: str, b: str) -> tuple[Column, Column]:
    def c(side: str, name: str) -> Column:
        return F.col(f"{side}_{name}")

    width = F.least(c(a, "x1"), c(b, "x1")) - F.greatest(c(a, "x0"), c(b, "x0"))
    height = F.least(c(a, "y1"), c(b, "y1")) - F.greatest(c(a, "y0"), c(b, "y0"))
    inter = F.when((width > 0) & (height > 0), width * height).otherwise(0.0)
    area = {s: (c(s, "x1") - c(s, "x0")) * (c(s, "y1") - c(s, "y0")) for s in (a, b)}
    valid = (area[a] > 0) & (area[b] > 0)
    iou = F.when(valid, inter / (area[a] + area[b] - inter)).otherwise(0.0)
    contained = F.when(valid, inter / F.least(area[a], area[b])).otherwise(0.0)
    return iou, contained


def overlapping_documents(lines: DataFrame) -> DataFrame:
    """Documents with two boxes that overlap too much.

    Only existence matters, so pairs are never listed per document.  First a
    linear pass settles crowded documents: equal boxes, and neighbours in a
    grid cell.  Documents it does not settle hold few overlapping boxes per
    cell, and only those go through the exact cell join.
    """
    boxes = (
        lines.filter(F.length(strip(F.col("text"))) > 1)
        .groupBy("doc_id", "page_num", "x0", "y0", "x1", "y1").agg(F.count("*").alias("_n"))
        .filter("(x1 - x0) > 0 AND (y1 - y0) > 0")
    )
    equal = boxes.filter("_n > 1").select("doc_id")
    side = ["x0", "y0", "x1", "y1"]
    # neighbours by position inside a cell; a hot page spreads over its cells
    cell = [F.floor(F.col("y0") / CELL).alias("_cy"), F.floor(F.col("x0") / (8 * CELL)).alias("_cx")]
    placed = boxes.select("doc_id", "page_num", *cell, *side)
    near = Window.partitionBy("doc_id", "page_num", "_cy", "_cx").orderBy(*side)
    pairs = placed.select(
        "doc_id", *[F.col(s).alias(f"a_{s}") for s in side], *[F.lag(s).over(near).alias(f"b_{s}") for s in side]
    )
    iou, contained = _overlap_ratios("a", "b")
    hit = (iou >= MIN_IOU) | (contained >= MIN_CONTAINMENT)
    settled = equal.unionByName(pairs.filter("b_x0 IS NOT NULL").filter(hit).select("doc_id")).distinct()

    open_boxes = boxes.join(settled, "doc_id", "left_anti").withColumn("_id", F.struct(*side))
    wide = 8 * CELL

    def cells(low: str, high: str, size: float) -> Column:
        return F.explode(F.sequence(F.floor(F.col(low) / size), F.floor(F.col(high) / size)))

    spread = open_boxes.withColumn("_cy", cells("y0", "y1", CELL)).withColumn("_cx", cells("x0", "x1", wide))
    keys = ["doc_id", "page_num", "_cy", "_cx"]
    left = spread.select(*keys, F.col("_id").alias("a_id"), *[F.col(s).alias(f"a_{s}") for s in side])
    right = spread.select(*keys, F.col("_id").alias("b_id"), *[F.col(s).alias(f"b_{s}") for s in side])
    # a pair is compared once: in the cell of the corner where its intersection starts
    corner = (F.floor(F.greatest("a_y0", "b_y0") / CELL) == F.col("_cy")) & (F.floor(F.greatest("a_x0", "b_x0") / wide) == F.col("_cx"))
    met = left.join(right, keys).filter(corner & (F.col("a_id") < F.col("b_id"))).filter(hit)
    return settled.unionByName(met.select("doc_id").distinct())


def overlap_findings(lines: DataFrame) -> DataFrame:
    """J9."""
    entry = finding("overlapping_text_regions", "layout", 15, "Overlapping text regions detected.")
    return _one_per_doc(overlapping_documents(lines), entry)


def _pages(lines: DataFrame, first_page_only: bool) -> DataFrame:
    return lines.filter("page_num = 1") if first_page_only else lines


def label_findings(lines: DataFrame, docs: DataFrame, first_page_only: bool = False) -> DataFrame:
    """A primary label on two or more lines of a page of a non-tabular document."""
    lines = _pages(lines, first_page_only)
    counts = []
    for i, (pattern, _, excluded) in enumerate(LABELS):
        t = F.lower(strip(F.col("text")))
        hit = t.rlike(rx(pattern, ignore_case=True))
        for word in excluded:
            hit = hit & ~t.contains(word)
        counts.append(F.count_if(hit).alias(f"_c{i}"))
    per_page = lines.groupBy("doc_id", "page_num").agg(*counts)
    per_doc = per_page.groupBy("doc_id").agg(*[F.max(f"_c{i}").alias(f"_c{i}") for i in range(len(LABELS))])
    kind = F.lower(F.trim(F.coalesce("doc_type", F.lit(""))))
    tabular = kind.isin(TABULAR_TYPES) | kind.contains("statement") | kind.contains("invoice")
    rows = per_doc.join(docs.filter(~tabular).select("doc_id"), "doc_id", "left_semi")
    entries = []
    for i, (_, name, _) in enumerate(LABELS):
        double = F.col(f"_c{i}") >= 2
        entries += [
            F.when(double, finding("duplicate_field_label", "layout", 20, f"Duplicate {name} field detected.")),
            F.when(double, finding("abnormal_alignment", "layout", 10, f"Unexpected field position detected for {name}.")),
        ]
    return rows.select("doc_id", F.posexplode(F.array_compact(F.array(*entries))).alias("ordinal", "_f")).select(
        "doc_id", "ordinal", "_f.*"
    )


def _upper_median(counts: DataFrame, value: str) -> DataFrame:
    """Element at floor(n/2) per page, from (doc_id, page_num, value, _n) counts.

    Values are counted first, so the window sees distinct coordinates only.
    """
    running = Window.partitionBy("doc_id", "page_num").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("doc_id", "page_num")
    ranked = counts.withColumns({"_cum": F.sum("_n").over(running), "_all": F.sum("_n").over(whole)})
    picked = F.when(F.col("_cum") > F.floor(F.col("_all") / 2), F.col(value))
    return ranked.withColumn("_median", F.min(picked).over(whole)).drop("_cum")


def alignment_findings(lines: DataFrame, first_page_only: bool = False) -> DataFrame:
    """Three or more left edges of a page slightly off its upper median; one finding per document."""
    lines = _pages(lines, first_page_only)
    counts = lines.groupBy("doc_id", "page_num", F.col("x0").alias("v")).agg(F.count("*").alias("_n"))
    shift = F.abs(F.col("v") - F.col("_median"))
    off = F.sum(F.when((shift > 5) & (shift < 25), F.col("_n")).otherwise(0))
    pages = _upper_median(counts, "v").filter("_all >= 6").groupBy("doc_id", "page_num").agg(off.alias("_off"))
    return _one_per_doc(
        pages.filter("_off >= 3").select("doc_id").distinct(), finding("abnormal_alignment", "layout", 10, "Unexpected field placement or abnormal text alignment detected.")
    )


def font_findings(lines: DataFrame, first_page_only: bool = False) -> DataFrame:
    """A10: two or more heights of a page far from its upper median; one finding per document."""
    heights = _pages(lines, first_page_only).withColumn("v", F.col("y1") - F.col("y0")).filter("v > 5")
    counts = heights.groupBy("doc_id", "page_num", "v").agg(F.count("*").alias("_n"))
    far = (F.col("v") > F.col("_median") * 2.5) | (F.col("v") < F.col("_median") * 0.4)
    pages = (
        _upper_median(counts, "v").filter("_all >= 5 AND _median > 10")
        .groupBy("doc_id", "page_num").agg(F.sum(F.when(far, F.col("_n")).otherwise(0)).alias("_far")).filter("_far >= 2")
    )
    return _one_per_doc(
        pages.select("doc_id").distinct(), finding("font_size_inconsistency", "visual", 15, "Font size inconsistency detected across text fields.")
    )


# Field names each rule reads, in order of preference.
_FIELD_GROUPS: dict[str, list[str]] = {
    "gross": ["gross_salary", "gross_earnings", "total_earnings"],
    "deductions": ["total_deductions", "deductions"],
    "net": ["net_salary", "net_pay", "take_home"],
    "opening": ["opening_balance"],
    "closing": ["closing_balance"],
    "deposits": ["total_deposits", "total_credits"],
    "withdrawals": ["total_withdrawals", "total_debits"],
    "holder": ["name", "cardholder_name", "applicant_name"],
    "father": ["father_name", "father"],
    "birth": ["dob", "date_of_birth"],
    "fssai": ["fssai_licence_number", "license_number"],
    "udyam": ["udyam_registration_number"],
    "licence": ["driving_license_number", "dl_number", "license_number"],
    "uid": ["raw_aadhaar", "aadhaar_number"],
}
_ID_FIELDS = ["pan_number", "aadhaar_number", "gstin", "passport_number", "driving_license_number"]
_TEXT_AMOUNTS = {
    "gross": r"(?:Gross\s*(?:Salary|Earnings|Pay)?)[\s:：.]+(?:Rs\.?|INR|₹)?\s*([\d,]+\.?\d*)",
    "deductions": r"(?:Total\s*Deductions?|Deductions?)[\s:：.]+(?:Rs\.?|INR|₹)?\s*([\d,]+\.?\d*)",
    "net": r"(?:Net\s*(?:Salary|Pay)?)[\s:：.]+(?:Rs\.?|INR|₹)?\s*([\d,]+\.?\d*)",
}
MRZ_LINE = r"^[A-Z0-9<]{44}$"


def pivot_fields(fields: DataFrame) -> DataFrame:
    """One row per document with the fields the rules read."""
    names = sorted({n for group in _FIELD_GROUPS.values() for n in group} | set(_ID_FIELDS))
    wanted = fields.filter(F.col("field").isin(names))
    return wanted.groupBy("doc_id").agg(*[F.max(F.when(F.col("field") == n, F.col("value"))).alias(n) for n in names])


def field_findings(fields: DataFrame, docs: DataFrame, totals: DataFrame | None = None, text: str = "full_text",
                   today: datetime.date | None = None, strict_reference: bool = False) -> DataFrame:
    """Identifier, arithmetic, name and date rules over a document's fields.

    Outside ``strict_reference`` the licence rule also reads
    ``licence_number``, and statement totals absent from the fields are taken
    from ``totals`` (the output of the transaction totals).
    """
    wide = docs.select("doc_id", F.lower(F.trim("doc_type")).alias("doc_type"), *([F.col(text).alias("_t")] if text in docs.columns else []))
    if "_t" not in wide.columns:
        wide = wide.withColumn("_t", F.lit(""))
    fields_used = fields
    if not strict_reference:
        renamed = F.when(F.col("field") == "licence_number", "driving_license_number").otherwise(F.col("field"))
        fields_used = fields.withColumn("field", renamed)
    wide = wide.join(pivot_fields(fields_used), "doc_id", "left")
    if totals is not None and not strict_reference:
        sums = totals.select(
            "doc_id", F.col("credit_amount").cast("string").alias("_cr"), F.col("debit_amount").cast("string").alias("_dr")
        )
        wide = wide.join(sums, "doc_id", "left")
        wide = wide.withColumns({
            "total_deposits": F.coalesce("total_deposits", "total_credits", "_cr"),
            "total_withdrawals": F.coalesce("total_withdrawals", "total_debits", "_dr"),
        })

    def first(group: str) -> Column:
        return F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in _FIELD_GROUPS[group]])

    t, kind = F.col("_t"), F.col("doc_type")

    def amount(group: str) -> Column:
        value = parse_amount(first(group))
        if group in _TEXT_AMOUNTS:
            value = F.coalesce(value, parse_amount(matched(t, _TEXT_AMOUNTS[group], ignore_case=True)))
        return value

    salary, statement = kind.isin("salary_slip", "payslip"), kind.isin("bank_statement", "account_statement")
    wide = wide.withColumns({
        **{f"_{g}": F.when(salary, amount(g)) for g in ("gross", "deductions", "net")},
        **{f"_{g}": F.when(statement, amount(g)) for g in ("opening", "closing", "deposits", "withdrawals")},
        "_pan_why": F.when(kind == "pan", pan_reason(F.col("pan_number"))),
        "_gst_why": F.when(kind.isin("gst_certificate", "gst"), gstin_reason(F.col("gstin"))),
        "_born": parse_date(first("birth")),
        "_mrz": F.when(
            kind == "passport",
            F.filter(
                F.transform(F.split(t, "\n"), lambda line: F.replace(strip(line), F.lit(" "), F.lit(""))),
                lambda line: line.rlike(MRZ_LINE),
            ),
        ),
    })
    wide = wide.withColumns({
        "_net_due": F.round(F.col("_gross") - F.col("_deductions"), 2),
        "_close_due": F.round(F.col("_opening") + F.col("_deposits") - F.col("_withdrawals"), 2),
    })

    def text_of(name: str) -> Column:
        return F.col(name).cast("string")

    def bad(cond: Column, description: Column | str) -> Column:
        return F.when(cond, finding("invalid_checksum", "consistency", 30, description))

    uid, fssai = F.regexp_replace(first("uid"), r"\D", ""), F.regexp_replace(first("fssai"), r"\D", "")
    licence = first("licence")
    plain_licence = F.upper(F.regexp_replace(licence, r"[\s\-_/]", ""))
    now = F.lit(today) if today else F.current_date()
    entries = [
        bad(F.col("_pan_why").isNotNull(), F.concat(F.lit("PAN format validation failed: "), F.col("_pan_why"), F.lit("."))),
        bad((kind == "aadhaar") & (F.length(uid) == 12) & ~verhoeff_ok(uid), "Aadhaar Verhoeff checksum validation failed."),
        bad(
            F.col("_gst_why").isNotNull(),
            F.concat(F.lit("GSTIN checksum or format validation failed: "), F.col("_gst_why"), F.lit(".")),
        ),
        F.when(
            F.abs(F.col("_net_due") - F.col("_net")) > 2.0,
            finding(
                "math_inconsistency", "consistency", 30,
                F.concat(
                    F.lit("Salary arithmetic mismatch: Gross ("), text_of("_gross"), F.lit(") minus Deductions ("),
                    text_of("_deductions"), F.lit(") equals "), text_of("_net_due"), F.lit(", but Net Pay is stated as "),
                    text_of("_net"), F.lit("."),
                ),
            ),
        ),
        F.when(
            F.abs(F.col("_close_due") - F.col("_closing")) > 5.0,
            finding(
                "balance_inconsistency", "consistency", 30,
                F.concat(
                    F.lit("Running balance arithmetic mismatch: Opening ("), text_of("_opening"), F.lit(") + Credits ("),
                    text_of("_deposits"), F.lit(") - Debits ("), text_of("_withdrawals"), F.lit(") equals "),
                    text_of("_close_due"), F.lit(", but Closing Balance is "), text_of("_closing"), F.lit("."),
                ),
            ),
        ),
        bad(
            (F.size("_mrz") >= 2) & ~F.get("_mrz", F.lit(0)).startswith("P"),
            "Passport MRZ Line 1 does not conform to ICAO Doc 9303 standards.",
        ),
        bad(
            (kind == "passport") & (F.size("_mrz") < 2) & F.col("passport_number").isNotNull()
            & (t.contains("<<") | t.contains("P<")),
            "Passport Machine Readable Zone (MRZ) contains corrupted or incomplete lines.",
        ),
        bad(
            kind.isin("driving_licence", "driving_license") & ~plain_licence.rlike(r"^[A-Z]{2}[0-9]{2}[0-9A-Z]{11,12}$")
            & ~strip(licence).rlike(r"^[A-Z]{2}-[0-9]{13,15}$"),
            F.concat(F.lit("Driving Licence number '"), licence, F.lit("' does not match standardized state issuing format.")),
        ),
        bad(
            kind.isin("fssai", "fssai_license") & (F.length(fssai) != 14),
            F.concat(F.lit("FSSAI license must be exactly 14 digits, found "), F.length(fssai).cast("string"), F.lit(" digits.")),
        ),
        bad(
            (kind == "udyam") & ~F.upper(strip(first("udyam"))).rlike(r"^UDYAM-[A-Z]{2}-[0-9]{2}-[0-9]{7}$"),
            "Udyam registration number does not match standardized format UDYAM-XX-00-0000000.",
        ),
        F.when(
            (F.length(strip(first("holder"))) > 3) & (F.upper(strip(first("holder"))) == F.upper(strip(first("father")))),
            finding("duplicate_field_label", "consistency", 20, "Applicant Name and Father's Name are identical."),
        ),
        bad(F.col("_born") > now, F.concat(F.lit("Date of birth ("), text_of("_born"), F.lit(") is set in the future."))),
        bad(
            (F.col("_born") <= now) & (F.year("_born") < 1910),
            F.concat(F.lit("Date of birth year ("), F.year("_born").cast("string"), F.lit(") is outside plausible historical range.")),
        ),
    ]
    ids = F.array_compact(F.array(*[
        F.when(
            F.length(F.regexp_replace(n, r"[\s\-_]", "")) >= 8,
            F.struct(F.lit(n).alias("k"), F.upper(F.regexp_replace(n, r"[\s\-_]", "")).alias("v")),
        )
        for n in _ID_FIELDS
    ]))

    def shared(xs: Column) -> Column:
        def entry(x: Column, i: Column) -> Column:
            at = F.array_position(F.transform(xs, lambda y: y["v"]), x["v"])
            return F.when(
                at <= i,
                finding(
                    "duplicate_field_label", "consistency", 20,
                    F.concat(
                        F.lit("Identical identifier value shared across "), F.get(xs, (at - 1).cast("int"))["k"], F.lit(" and "), x["k"], F.lit("."),
                    ),
                ),
            )

        return F.array_compact(F.transform(xs, entry))

    found = F.concat(F.array_compact(F.array(*entries)), let(ids, shared))
    return wide.select("doc_id", F.posexplode(found).alias("ordinal", "_f")).select("doc_id", "ordinal", "_f.*")


# Fields compared between text and code payload, by group.
QR_GROUPS: list[tuple[str, list[str]]] = [
    ("name", ["name", "cardholder_name", "applicant_name", "employee_name"]),
    ("dob", ["dob", "date_of_birth"]),
    ("doc_number", ["pan_number", "aadhaar_number", "raw_aadhaar", "udyam_registration_number", "fssai_licence_number"]),
]


def _group_values(fields: DataFrame, out: str, with_key: bool) -> DataFrame:
    """First non-null field of each comparison group per document."""
    entries = []
    for rank, (key, names) in enumerate(QR_GROUPS):
        order = ([key] if with_key and key not in names else []) + names
        entries += [(name, key, rank, i) for i, name in enumerate(order)]
    table = F.create_map(*[x for n, k, r, i in entries for x in (F.lit(n), F.struct(F.lit(k).alias("k"), F.lit(r).alias("r"), F.lit(i).alias("i")))])
    tagged = fields.filter("value IS NOT NULL").withColumn("_g", F.try_element_at(table, F.col("field"))).filter("_g IS NOT NULL")
    return tagged.groupBy("doc_id", F.col("_g.k").alias("qr_key"), F.col("_g.r").alias("rank")).agg(
        F.min_by("value", "_g.i").alias(out)
    )


def qr_findings(ocr_fields: DataFrame, qr_fields: DataFrame) -> DataFrame:
    """Groups whose values differ beyond case, space, dash and slash."""
    both = _group_values(ocr_fields, "ocr_value", False).join(
        _group_values(qr_fields, "qr_value", True).drop("rank"), ["doc_id", "qr_key"]
    )

    def norm(c: str) -> Column:
        return F.regexp_replace(F.upper(strip(F.col(c))), r"[\s\-_/]", "")

    text = F.concat(
        F.lit("QR code payload mismatch for "), F.col("qr_key"), F.lit(": OCR read '"), F.col("ocr_value"),
        F.lit("', while digital QR decoded '"), F.col("qr_value"), F.lit("'."),
    )
    return both.filter(norm("ocr_value") != norm("qr_value")).select(
        "doc_id", F.col("rank").alias("ordinal"), F.lit("qr_data_mismatch").alias("signal"),
        F.lit("security_feature").alias("category"), F.lit(40).alias("score"), text.alias("description"),
        "qr_key", "ocr_value", "qr_value",
    )


def external_findings(signals: DataFrame) -> DataFrame:
    """Signals of an external model (doc_id, ordinal, description), 15 each."""
    return signals.select(
        "doc_id", "ordinal", F.lit("ai_detected_anomaly").alias("signal"), F.lit("ai_reasoning").alias("category"),
        F.lit(15).alias("score"), "description",
    )


def all_findings(*sources: DataFrame) -> DataFrame:
    """Union in the given source order; ``ordinal`` (source, place) keeps that order."""
    out = None
    for rank, df in enumerate(sources):
        part = df.select(
            "doc_id", F.struct(F.lit(rank).alias("source"), F.col("ordinal").cast("bigint").alias("place")).alias("ordinal"),
            "signal", "category", F.col("score").cast("int").alias("score"), "description",
        )
        out = part if out is None else out.unionByName(part)
    return out


def signal_weight(signal: Column, score: Column) -> Column:
    """The finding's own score, else the weight of its signal."""
    name = F.lower(F.trim(signal))
    entries = ", ".join(f"named_struct('k', {quote(k)}, 'w', {w})" for k, w in SIGNAL_WEIGHTS.items())
    table = F.expr(f"array({entries})")
    exact = F.get(F.filter(table, lambda e: e["k"] == name), F.lit(0))["w"]
    partial = F.get(F.filter(table, lambda e: name.contains(e["k"]) | F.contains(e["k"], name)), F.lit(0))["w"]
    return F.coalesce(F.when(score != 0, score), exact, partial, F.lit(DEFAULT_WEIGHT))


def risk_score(findings: DataFrame, docs: DataFrame) -> DataFrame:
    """Full weight for the first finding of a signal, half for repeats."""
    weighted = findings.withColumn("_w", signal_weight(F.col("signal"), F.col("score")))
    half = F.floor(F.col("_w") * 0.5).cast("bigint")
    per_signal = weighted.groupBy("doc_id", "signal").agg(
        F.min_by("_w", "ordinal").alias("_first"), F.sum(half).alias("_halves")
    )
    scores = per_signal.groupBy("doc_id").agg(
        F.sum(F.col("_first") + F.col("_halves") - F.floor(F.col("_first") * 0.5)).alias("_risk")
    )
    # distinct descriptions of a document, in first-seen order
    texts = findings.groupBy("doc_id", "description").agg(F.min("ordinal").alias("_o"))
    texts = texts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("_o", "description"))).alias("_d"))
    out = docs.select("doc_id", "doc_type").join(scores, "doc_id", "left").join(texts, "doc_id", "left")
    supported = F.col("doc_type") != "unknown"
    out = out.withColumn(
        "risk_score", F.when(supported, F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce("_risk", F.lit(0))))).otherwise(0).cast("int")
    )
    risk = F.col("risk_score")
    review = supported & (risk >= 30)
    return out.select(
        "doc_id", "doc_type", "risk_score",
        F.when(~supported, "unsupported").when(review, "review_required").otherwise("verified").alias("verification_status"),
        review.alias("review_required"),
        F.when(review & (risk >= 60), "high").when(review, "normal").otherwise("low").alias("priority"),
        F.when(~supported, "Unsupported document type.")
        .when(review & (risk >= 60), "Visible inconsistencies detected (High Priority).")
        .when(review, "Visible inconsistencies detected.").alias("human_review_reason"),
        F.when(supported, F.coalesce(F.transform("_d", lambda d: d["description"]), F.array().cast("array<string>")))
        .otherwise(F.array().cast("array<string>")).alias("suspicious_signals"),
    )
