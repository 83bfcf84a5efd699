"""The whole flows on literal documents."""

import datetime

from pyspark.sql import functions as F

from inkwell.plans.flows import vault_flow, verify_flow
from inkwell.plans.fixtures import Tables

STATEMENT = (
    "ACCOUNT STATEMENT\nAccount Number: 123456789012\nOpening Balance: 100.00\n"
    "DATE TRAN ID PARTICULARS AMOUNT BALANCE\n01-04-2026 S1 UPI 50.00 150.00\n02-04-2026 S2 UPI 30.00 120.00\nEND OF REPORT"
)


def test_vault_flow_reads_statements_and_layout(spark):
    docs = spark.createDataFrame([
        (1, STATEMENT, 0.9), (2, "INCOME TAX DEPARTMENT\nPermanent Account Number Card\nABCPE1234F\nName: JOHN DOE", 0.9),
    ], "doc_id long, full_text string, average_confidence double")
    lines = spark.createDataFrame([
        (2, 1, 1, "Name: JOHN DOE", 0.9, 50.0, 30.0, 150.0, 50.0), (2, 1, 2, "Name: JOHN ROE", 0.9, 50.0, 90.0, 150.0, 110.0),
    ], "doc_id long, page_num int, line_no int, text string, confidence double, x0 double, y0 double, x1 double, y1 double")
    signals = spark.createDataFrame([(2, 0, "odd seal")], "doc_id long, ordinal int, description string")
    out = vault_flow(docs, today=datetime.date(2026, 1, 1), lines=lines, signals=signals)
    fields = {(r.doc_id, r.field): r.value for r in out["raw_fields"].collect()}
    assert fields[1, "closing_balance"] == "120.00" and fields[1, "opening_balance"] == "100.00"
    got = {r.doc_id: r for r in out["documents"].collect()}
    assert got[1].doc_type == "bank_statement" and got[1].risk_score == 0
    assert got[2].suspicious_signals == ["Duplicate Name field detected.", "Unexpected field position detected for Name.", "odd seal"]
    assert (got[2].risk_score, got[2].verification_status) == (20 + 10 + 15, "review_required")


def test_verify_flow_runs_every_stage(spark):
    cheque = (
        "Branch: PUNE MAIN BRANCH\nIFS Code: SBIN0001234\nA/C No. 123456789012\nCheque Number: 000123\nAccount Holder: DEMO CUSTOMER\n"
        "CANCELLED\n⑆000123⑆ 400002001⑈ 123456789012⑇ 10"
    )
    udyam = "UDYAM REGISTRATION CERTIFICATE\nEnterprise Name: NOVA\nNo: UDYAM-MH-01-0012345\nType of Enterprise: Micro"
    requests = spark.createDataFrame([
        (1, "cancelled_cheque", cheque), (2, "udyam", udyam), (3, "pan", "ACCOUNT STATEMENT\nOPENING BALANCE 10\nCLOSING BALANCE 20"),
        (4, "pan", "  "), (5, "pan", None),
    ], "doc_id long, requested_type string, full_text string")
    payloads = spark.createDataFrame([(2, "https://example.org/?urn=UDYAM-MH-01-7777777")], "doc_id long, payload string")
    expected = spark.createDataFrame([(2, "identifier", "UDYAM-MH-01-7777777"), (3, "name", "X")], "doc_id long, key string, value string")
    out = verify_flow(requests, payloads=payloads, expected=expected)
    got = {r.doc_id: (r.status, r.reason, r.detected_type) for r in out["documents"].collect()}
    assert got[2][0] == "success" and got[3] == ("error", "doc_type_mismatch", "bank_statement")
    assert got[4] == got[5] == ("error", "ocr_engine_returned_no_text", None)
    fields = {(r.doc_id, r.field): r.value for r in out["fields"].collect()}
    assert fields[2, "udyam_registration_number"] == "UDYAM-MH-01-7777777"
    assert {d for d, _ in fields} == {1, 2}
    assert [(r.doc_id, r.resolution) for r in out["disagreements"].collect()] == [(2, "qr_preferred")]
    checks = {(r.doc_id, r.key): (r.matched, r.reason) for r in out["cross_check"].collect()}
    assert checks == {(2, "identifier"): (True, None), (3, "name"): (False, "field_not_found_in_document")}
    audit = {(r.doc_type, r.status): r.extra_meta for r in out["audit"].collect()}
    assert audit["udyam", "success"]["qr_detected"] == "true"
    assert out["audit"].count() == 5
    assert out["fields"].filter(F.col("field").startswith("raw_")).count() == 0


def test_tables_of_two_folders_do_not_mix(spark):
    small, large = Tables(spark, "/root/testdata/sf0.001").kyc, Tables(spark, "/root/testdata/sf0.01").kyc
    assert small.count() < large.count()
