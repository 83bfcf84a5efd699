"""The vault flow as one pass over the text, and the verify-as-claimed flow.

Each flow reads and matches a text once.  What is kept of it (types, fields,
checks) is small; it is written to the shared folder, so later joins
neither repeat the matching nor drag its plan along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.functions.text import strip
from inkwell.operators.audit import audit_rows
from inkwell.operators.classify import split_pages, with_classification, with_mismatch
from inkwell.operators.crosscheck import cross_check
from inkwell.operators.extract import long_fields, minimise_pii, with_fields
from inkwell.operators.integrity import (
    alignment_findings, all_findings, external_findings, field_findings, font_findings, label_findings, overlap_findings, qr_findings,
    risk_score,
)
from inkwell.operators.reconcile import parse_qr, reconcile_micr, reconcile_qr
from inkwell.operators.statements import closing_balance, statement_rows, transaction_totals
from inkwell.operators.validate import validate_documents
from inkwell.operators.vault import ocr_gate, with_doc_status
from inkwell.session import cut_lineage

# Types whose rules read the text again, whose issuer is a field, and that carry a code to scan.
_TEXT_RULES = ["salary_slip", "payslip", "passport"]
_ISSUER_FIELDS = {
    "bank_statement": "bank_name", "salary_slip": "employer_name", "utility_bill": "utility_provider",
    "income_certificate": "issuing_authority",
}
_QR_TYPES = ["aadhaar", "udyam", "fssai"]
_MICR_FIELDS = ["micr_line", "micr_confidence", "micr_code", "micr_account_number_masked", "tran_code", "micr_match"]


def _more_fields(fields: DataFrame, extra: DataFrame) -> DataFrame:
    """``extra`` (doc_id, doc_type, field, value) added where a document lacks the field."""
    new = extra.filter("value IS NOT NULL").join(fields.select("doc_id", "field"), ["doc_id", "field"], "left_anti")
    return fields.unionByName(new.select("doc_id", "doc_type", "field", "value"), allowMissingColumns=True)


def _statement_fields(statements: DataFrame, fields: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fields with the closing balance of the running column, and the totals of the transactions."""
    pages = split_pages(statements.select("doc_id", "full_text"))
    rows = cut_lineage(statement_rows(pages.select("doc_id", "page_num", F.col("page_text").alias("full_text")), statements))
    closing = closing_balance(statements, rows).select(
        "doc_id", F.lit("bank_statement").alias("doc_type"), F.lit("closing_balance").alias("field"), F.col("closing_balance").alias("value")
    )
    return _more_fields(fields, closing), transaction_totals(rows)


def vault_flow(docs: DataFrame, qr_fields: DataFrame | None = None, today=None, lines: DataFrame | None = None,
               signals: DataFrame | None = None, first_page_only: bool = False) -> dict[str, DataFrame]:
    """classify -> extract -> statements -> validate -> layout, field, QR and outside findings -> risk -> status.

    ``docs``: doc_id, full_text, average_confidence.  ``lines``: recognised
    lines with boxes, for the layout findings.  ``signals``: doc_id, ordinal,
    description from outside.  Validation and findings read the raw fields;
    minimisation comes last.
    """
    wide = with_fields(with_classification(docs.select("doc_id", "full_text", "average_confidence")))
    kept = F.col("doc_type").isin([*_TEXT_RULES, "bank_statement"])
    wide = cut_lineage(wide.withColumn("full_text", F.when(kept, F.col("full_text"))))
    fields, totals = _statement_fields(wide.filter("doc_type = 'bank_statement'"), long_fields(wide))
    checks = validate_documents(fields).select("doc_id", "checksum_valid", "checksum_reason")
    typed = wide.select("doc_id", "doc_type", "full_text")
    sources = []
    if lines is not None:
        page = lines.filter("page_num = 1") if first_page_only else lines
        sources += [overlap_findings(page), label_findings(page, typed), alignment_findings(page), font_findings(page)]
    sources.append(field_findings(fields, typed, totals, today=today))
    if qr_fields is not None:
        sources.append(qr_findings(fields, qr_fields))
    if signals is not None:
        sources.append(external_findings(signals))
    risk = risk_score(all_findings(*sources), wide.select("doc_id", "doc_type")).drop("doc_type")
    issuer_field = F.create_map(*[F.lit(x) for pair in _ISSUER_FIELDS.items() for x in pair])
    own = F.get(
        F.filter("fields", lambda f: f["field"] == F.try_element_at(issuer_field, F.col("doc_type"))), F.lit(0)
    )["value"]
    summary = (
        wide.select(
            "doc_id", "doc_type", "document_type", F.coalesce(own, F.col("issuer")).alias("issuer"), "confidence", "average_confidence"
        )
        .join(risk, "doc_id").join(checks, "doc_id", "left")
    )
    return {"documents": with_doc_status(summary), "fields": minimise_pii(fields), "raw_fields": fields}


def _with_payloads(fields: DataFrame, wide: DataFrame, payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fields in which a scanned code's values win, and the disagreements; of several values the greatest counts."""
    coded = wide.filter(F.col("doc_type").isin(_QR_TYPES)).select("doc_id", "doc_type")
    parsed = parse_qr(payloads.select("doc_id", "payload").join(coded, "doc_id"))
    parsed = parsed.filter("field <> 'raw_qr'").groupBy("doc_id", "doc_type", "field").agg(F.max("value").alias("value"))
    _merged, disagreements = reconcile_qr(fields, parsed)
    winners = parsed.select("doc_id", "field", F.col("value").alias("_qr"))
    won = F.coalesce(F.upper(strip(F.col("value"))) != F.upper(strip(F.col("_qr"))), F.lit(False))
    over = fields.join(winners, ["doc_id", "field"], "left").withColumn("value", F.when(won, F.col("_qr")).otherwise(F.col("value")))
    return _more_fields(over.drop("_qr"), parsed), disagreements


def _with_magnetic_line(fields: DataFrame, wide: DataFrame) -> DataFrame:
    """Fields of cancelled cheques with what their magnetic line says."""
    cheques = wide.filter("doc_type = 'cancelled_cheque'").select("doc_id", F.col("full_text").alias("text"))
    read = reconcile_micr(cheques, fields).withColumnRenamed("account_number_masked", "micr_account_number_masked")
    entries = F.array(*[
        F.struct(F.lit(n).alias("field"), F.col(n).cast("string").alias("value")) for n in [*_MICR_FIELDS, "cheque_number"]
    ])
    found = read.select("doc_id", F.lit("cancelled_cheque").alias("doc_type"), F.explode(entries).alias("_m"))
    return _more_fields(fields, found.select("doc_id", "doc_type", "_m.*"))


def verify_flow(requests: DataFrame, lines: DataFrame | None = None, payloads: DataFrame | None = None,
                expected: DataFrame | None = None) -> dict[str, DataFrame]:
    """gate -> mismatch -> extract -> scanned code -> magnetic line -> validate, cross-check -> minimise -> audit row.

    ``requests``: doc_id, requested_type, full_text and, if known,
    average_confidence, engine_error, job_id, customer_id, duration_ms.
    ``lines`` are counted by the gate; without them a text that is not blank
    passes.  ``payloads``: doc_id, payload.  ``expected``: doc_id, key, value.
    A mismatch or an unusable document gets no rules, so nothing is extracted
    from it.

    Gives ``documents``, ``fields``, ``disagreements`` and ``cross_check``
    (None without their input) and ``audit``.
    """
    if lines is not None:
        if "average_confidence" not in requests.columns:
            requests = requests.withColumn("average_confidence", F.lit(1.0))
        gated = ocr_gate(requests, lines)
    else:
        gated = requests.withColumn("usable", F.coalesce(F.regexp_like("full_text", F.lit(r"\S")), F.lit(False)))
    gated = gated.withColumn("full_text", F.when(F.col("usable"), F.col("full_text")))
    verdict = with_mismatch(gated)
    claimed = verdict.withColumn("doc_type", F.when(F.col("usable") & ~F.col("is_mismatch"), F.col("requested_type")))
    found = with_fields(claimed)
    wide = cut_lineage(found.withColumn("full_text", F.when(F.col("doc_type") == "cancelled_cheque", F.col("full_text"))))

    fields, disagreements = long_fields(wide), None
    if payloads is not None:
        fields, disagreements = _with_payloads(fields, wide, payloads)
    # read by the checks, the cross-check and the output
    fields = cut_lineage(_with_magnetic_line(fields, wide))
    checks = validate_documents(fields).select("doc_id", "checksum_valid", "checksum_reason")
    clean = minimise_pii(fields)
    sure = fields.groupBy("doc_id").agg(F.avg("confidence").alias("_raw")).join(
        clean.groupBy("doc_id").agg(F.avg("confidence").alias("_clean")), "doc_id", "left"
    )
    out = wide.drop("fields", "full_text").join(checks, "doc_id", "left").join(sure, "doc_id", "left")
    average = [F.col("average_confidence")] if "average_confidence" in out.columns else []
    failed = ~F.col("usable") | F.col("is_mismatch")
    out = out.withColumns({
        "status": F.when(failed, "error").when(~F.coalesce("checksum_valid", F.lit(True)), "low_confidence").otherwise("success"),
        "reason": F.when(~F.col("usable"), "ocr_engine_returned_no_text").when(F.col("is_mismatch"), "doc_type_mismatch")
        .otherwise(F.col("checksum_reason")),
        "confidence": F.when(failed, 0.0).otherwise(F.round(F.coalesce("_clean", "_raw", *average, F.lit(0.0)), 4)),
    })
    coded = F.col("requested_type").isin(_QR_TYPES) & ~failed
    cheque = (F.col("requested_type") == "cancelled_cheque") & ~failed
    meta = F.create_map(
        F.lit("qr_detected"), coded.cast("string"), F.lit("micr_detected"), cheque.cast("string"),
    )
    events = out.withColumn("doc_type", F.col("requested_type")).withColumn("extra_meta", meta)
    return {
        "documents": out.select("doc_id", "requested_type", "detected_type", "status", "reason", "confidence"),
        "fields": clean, "disagreements": disagreements,
        "cross_check": cross_check(fields, expected) if expected is not None else None,
        "audit": audit_rows(events),
    }
