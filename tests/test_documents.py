"""Classification, extraction, statements and reconciliation on literal texts."""

from pyspark.sql import functions as F

from inkwell.operators.classify import classify, type_mismatch
from inkwell.operators.crosscheck import cross_check
from inkwell.operators.extract import extract_fields, minimise_pii
from inkwell.operators.model_outputs import normalise_model_outputs
from inkwell.operators.reconcile import reconcile_micr
from inkwell.operators.statements import closing_balance, statement_rows
from inkwell.rules.extraction import Rule

SAMPLES = {
    "pan": ("INCOME TAX DEPARTMENT\nGOVT. OF INDIA\nABCPE1234F\nName: JOHN DOE\nFather's Name: RICHARD ROE\nDate of Birth: 15-08-1990",
            {"pan_number": "ABCPE1234F", "name": "JOHN DOE", "father_name": "RICHARD ROE", "dob": "15/08/1990"}),
    "aadhaar": ("UNIQUE IDENTIFICATION AUTHORITY OF INDIA\nName: JANE DOE\nDOB: 01/01/1995\nGender: Female\nAadhaar Number: 5432 1098 7654",
                {"aadhaar_number": "XXXXXXXX7654", "name": "JANE DOE", "gender": "Female"}),
    "cancelled_cheque": ("Branch: PUNE MAIN BRANCH\nIFS Code: SBIN0001234\nA/C No. 123456789012\nCheque Number: 000123\nAccount Holder: DEMO CUSTOMER\nCANCELLED",
                         {"marking": "CANCELLED", "account_number_masked": "XXXXXXXX9012", "ifsc": "SBIN0001234", "cheque_number": "000123",
                          "account_holder": "DEMO CUSTOMER"}),
    "udyam": ("UDYAM REGISTRATION CERTIFICATE\nEnterprise Name: TECH VENTURES\nNo: UDYAM-MH-01-0012345\nType of Enterprise: Micro\nMajor Activity: Services",
              {"udyam_registration_number": "UDYAM-MH-01-0012345", "enterprise_type": "Micro", "major_activity": "Services"}),
    "fssai": ("FOOD SAFETY AND STANDARDS AUTHORITY OF INDIA\nBusiness Name: FRESH BAKES & FOODS\nFSSAI Licence Number: 10022022000123\nValid Till: 31/12/2028",
              {"fssai_licence_number": "10022022000123", "business_name": "FRESH BAKES & FOODS", "valid_till": "31/12/2028"}),
    "shop_establishment": ("SHOPS AND ESTABLISHMENTS Government of Maharashtra\nName of the establishment: METRO RETAILERS\nRegistration Number: MH-2026-999",
                           {"state": "MH", "template_verified": "true", "registration_number": "MH-2026-999", "establishment_name": "METRO RETAILERS"}),
    "salary_slip": ("PAYSLIP\nCompany Name: ACME PRIVATE LIMITED\nEmployee Name: RAVI SHAH\nGross Salary: Rs. 50,000\nTotal Deductions: 5,000\nNet Pay: 45,000\nMonth: April 2025",
                    {"employer_name": "ACME PRIVATE LIMITED", "employee_name_masked": "RAVI S***", "net_pay": "45000", "pay_period": "April 2025"}),
    "utility_bill": ("MSEDCL ELECTRICITY BILL\nग्राहक क्रमांक: १७७४५३१३२८\nBill Date: 01-10-2024\nDue Date: 28.10.2024\nBill Amount: Rs. 1,200.00",
                     {"utility_provider": "Mahavitaran (MSEDCL)", "consumer_number": "1774531328", "due_date": "28/10/2024", "bill_amount": "1200.00"}),
    "passport": ("REPUBLIC OF INDIA PASSPORT\nSurname: SHARMA\nGiven Name: ROHIT\nNationality: INDIAN\nPassport Number: Z1234567\nDate of Expiry: 23/04/2037",
                 {"passport_number": "Z1234567", "name": "ROHIT SHARMA", "expiry_date": "23/04/2037"}),
    "voter_id": ("ELECTION COMMISSION OF INDIA\nEPIC No: WXY1234567\nName: VIKRAM PATIL\nFather's Name: SURESH PATIL\nAge: 31",
                 {"epic_number": "WXY1234567", "relative_name": "SURESH PATIL", "age": "31"}),
    "driving_licence": ("UNION OF INDIA DRIVING LICENCE\nLicence Number: MH12 20260000001\nName: AMIT VERMA\nVehicle Class: LMV",
                        {"licence_number": "MH12 20260000001", "name": "AMIT VERMA", "vehicle_class": "LMV"}),
    "itr": ("INDIAN INCOME TAX RETURN ACKNOWLEDGEMENT\nName of Deductor: BIG BANK\nName: PRIYA NAIR\nAcknowledgement Number: 123456789012345\nTotal Income: Rs. 12,50,000",
            {"name": "PRIYA NAIR", "acknowledgement_number": "123456789012345", "total_income": "1250000"}),
    "gst_certificate": ("FORM GST REG-06\nRegistration Number: 27 ABCPE 1234F1Z5\nLegal Name: NOVA TRADERS\nTrade Name, if any: NOVA\nConstitution of Business: Proprietorship",
                        {"gstin": "27ABCPE1234F1Z5", "legal_name": "NOVA TRADERS", "trade_name": "NOVA", "constitution_of_business": "Proprietorship"}),
    "certificate_of_incorporation": ("CERTIFICATE OF INCORPORATION\nCIN: U12345MH2001PTC123456\nName of the Company: NOVA PRIVATE LIMITED\nDate of Incorporation: 01/02/2001",
                                     {"cin": "U12345MH2001PTC123456", "company_name": "NOVA PRIVATE LIMITED", "date_of_incorporation": "01/02/2001"}),
    "partnership_deed": ("PARTNERSHIP DEED\nFirm Name: EXCELSIOR\n1. VIKRAM MALHOTRA\n2. ROHAN DESHMUKH\nProfit sharing ratio: 50:50",
                         {"firm_name": "EXCELSIOR", "partner_names_masked": "VIKRAM M*******, ROHAN D*******", "profit_sharing_ratio": "50:50"}),
    "rent_agreement": ("RENT AGREEMENT\nLESSOR: ASHA RAO\nLESSEE: NEEL RAJ\nProperty Address: Flat 4, Baner, Pune\nMonthly Rent: Rs. 15,000",
                       {"lessor_name_masked": "ASHA R**", "property_address_masked": "XXXX, Baner, Pune", "monthly_rent": "15000"}),
    "form_16": ("FORM NO. 16\nPAN of the Employee: ABCPE1234F\nTAN of the Deductor: PNEA12345B\nAssessment Year: 2024 - 25\nGross Salary: 900,000.00",
                {"pan_number": "ABCPE1234F", "tan_number": "PNEA12345B", "assessment_year": "2024-25", "gross_salary": "900000.00"}),
    "bank_passbook": ("बँक ऑफ महाराष्ट्र\nपासबुक\nBank Name: SHREE BANK\nAccount Holder Name: RAVI SHAH\nखाते क्रमांक: १२३४५६७८९०१\nIFSC: MAHB0001234",
                      {"account_number_masked": "XXXXXXX8901", "account_holder_name_masked": "RAVI S***", "ifsc": "MAHB0001234"}),
    "property_tax_receipt": ("PROPERTY TAX RECEIPT\nProperty ID: P/12/३४५\nOwner Name: ASHA RAO\nTax Amount Paid: Rs. 4,500\nPayment Date: 01/04/2024",
                             {"property_id": "P/12/345", "owner_name_masked": "ASHA R**", "tax_amount_paid": "4500", "payment_date": "01/04/2024"}),
    "iec_certificate": ("DIRECTORATE GENERAL OF FOREIGN TRADE\nIEC Number: ABCPE1234F\nName of the Firm: NOVA EXPORTS\nDate of Issue: 01/04/2020",
                        {"iec_number": "ABCPE1234F", "entity_name": "NOVA EXPORTS", "issue_date": "01/04/2020"}),
    "income_certificate": ("INCOME CERTIFICATE\nCertificate No: 12345678901234567\nApplicant Name: RAM PATIL\nDistrict: Pune\n2023-2024 85,000 Only\nDate: 2024-06-100",
                           {"certificate_number": "12345678901234567", "applicant_name": "RAM PATIL", "annual_income": "85000",
                            "financial_year": "2023-2024", "issue_date": "2024-06-10", "needs_manual_review": "false"}),
    "employment_contract": ("EMPLOYMENT AGREEMENT between Nova Corp and Asha Rao\nPosition: Analyst\nSalary: 50,000 per month",
                            {"employee_name": "Asha Rao", "employer": "Nova Corp", "position": "Analyst"}),
    "income_tax_notice": ("INCOME TAX DEPARTMENT NOTICE UNDER SECTION 143(2)\nAssessment Year: 2023-24\nDIN: ITBA/AST/1",
                          {"assessment_year": "2023-24", "section": "143(2)", "din": "ITBA/AST/1"}),
    "commercial_invoice": ("TAX INVOICE NO: INV-77\nTotal: 1,500", {"invoice_number": "INV-77", "total_amount": "1,500"}),
}


def sample_frame(spark):
    return spark.createDataFrame([(i, t, text) for i, (t, (text, _)) in enumerate(SAMPLES.items())], "doc_id long, doc_type string, full_text string")


def test_extraction_per_type(spark):
    got = {}
    for r in extract_fields(sample_frame(spark)).collect():
        got.setdefault(r.doc_type, {})[r.field] = r.value
    missing = {(t, f): (got.get(t, {}).get(f), v) for t, (_, want) in SAMPLES.items() for f, v in want.items() if got.get(t, {}).get(f) != v}
    assert missing == {}


def test_minimised_output_has_no_raw_fields(spark):
    kept = minimise_pii(extract_fields(sample_frame(spark)))
    assert kept.filter(F.col("field").startswith("raw_") | (F.col("field") == "partner_names")).count() == 0
    salary = {r.field for r in kept.filter("doc_type = 'salary_slip'").collect()}
    assert salary == {"employer_name", "employee_name_masked", "net_pay", "pay_period"}


def test_own_rules_and_line_confidence(spark):
    docs = spark.createDataFrame([(1, "letter", "Ref: AB-12\nbody")], "doc_id long, doc_type string, full_text string")
    lines = spark.createDataFrame([(1, 1, 0, "Ref: AB-12", 0.71), (1, 1, 1, "body", 0.9)], "doc_id long, page_num int, line_no int, text string, confidence double")
    rows = extract_fields(docs, lines, extra_rules={"letter": [Rule("reference", r"Ref:\s*([A-Z0-9-]+)")]}).collect()
    assert [(r.field, r.value, r.confidence) for r in rows] == [("reference", "AB-12", 0.71)]


def test_positional_card(spark):
    docs = spark.createDataFrame([(1, "pan", "INCOME TAX DEPARTMENT\nRAVI KUMAR\nSURESH KUMAR\n15/08/1990\nABCPE1234F")],
                                 "doc_id long, doc_type string, full_text string")
    got = {r.field: r.value for r in extract_fields(docs).collect()}
    assert (got["name"], got["father_name"]) == ("RAVI KUMAR", "SURESH KUMAR")


def test_classification(spark):
    texts = {t: text for t, (text, _) in SAMPLES.items()}
    texts["none"] = "an ordinary letter about nothing"
    texts["short"] = "x"
    texts["uid_with_father"] = "GOVERNMENT OF INDIA UIDAI FATHER: X ABCPE1234F INCOME TAX DEPARTMENT 2345 6789 0123"
    texts["pages"] = "--- Page 1 ---\nACCOUNT STATEMENT\n--- Page 2 ---\nACCOUNT STATEMENT\nOPENING BALANCE"
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts.values())], "doc_id long, full_text string")
    got = dict(zip(texts, [r for r in classify(docs).orderBy("doc_id").collect()]))
    wrong = {t: got[t].doc_type for t in SAMPLES if got[t].doc_type != t}
    assert wrong == {}
    assert got["none"].doc_type == "unknown" and got["short"].evidence == []
    assert got["uid_with_father"].doc_type == "aadhaar"
    assert got["pages"].doc_type == "bank_statement"
    assert got["pages"].evidence == ["[Page 1] ACCOUNT STATEMENT", "[Page 2] ACCOUNT STATEMENT", "[Page 2] OPENING BALANCE"]
    assert got["pages"].confidence == 0.83


def test_mismatch(spark):
    rows = [
        (0, "cancelled_cheque", "ACCOUNT STATEMENT\nOPENING BALANCE 10\nCLOSING BALANCE 20"), (1, "bank_statement", "ACCOUNT STATEMENT\nOPENING BALANCE 10"),
        (2, "udyam", "GOODS AND SERVICES TAX FORM GST REG-06"), (3, "pan", "just a letter with nothing inside"),
    ]
    got = type_mismatch(spark.createDataFrame(rows, "doc_id long, requested_type string, full_text string")).orderBy("doc_id").collect()
    assert [(r.is_mismatch, r.detected_type) for r in got] == [(True, "bank_statement"), (False, None), (True, "gst_certificate"), (False, None)]


STATEMENTS = {
    1: ["India Post Payments Bank\nAccount Number 034210312697\nOpening Balance : 5.63 Cr.\nDATE TRAN ID TRANSACTION PARTICULARS BALANCE\n"
        "30-03-2026 S521 UPI~7391~CR~SANKET 50.00 55.63 Cr.\nnote line\n02-04-2026 S626 UPI~6092~DR~VIGHNESH 20.00 35.63 Cr.\nClosing Balance: 35.63"],
    2: ["HDFC BANK\n01/01/2026 SALARY CREDIT 50000 CR 50000\n05/01/2026 ATM WITHDRAWAL 2000 DR 48000"],
    3: ["Opening Balance : 100.00 Cr.\n30-03-2026 S1 UPI 50.00 150.00 Cr.", "02-04-2026 S2 UPI 30.00 120.00 Cr.", "05-04-2026 S3 UPI 20.00 100.00 Cr.\nClosing Balance: 100.00"],
    4: ["ACCOUNT SUMMARY\nOPENING BALANCE TOTAL WITHDRAWALS TOTAL DEPOSITS CLOSING BALANCE No. of Transactions\n5.63 8,781.2 8,906 130.43 100\nDISCLAIMER : x\nPage 5 of 5"],
    5: ["S.No\n\n1 01/02/2026\nUPI/PAYMENT TO SHOP\n1,200.00 DR 8,800.00\n\n2 02/02/2026\nSALARY\n5,000.00 CR 13,800.00"],
}


def test_statements(spark):
    pages = spark.createDataFrame([(d, i + 1, t) for d, ts in STATEMENTS.items() for i, t in enumerate(ts)], "doc_id long, page_num int, full_text string")
    docs = spark.createDataFrame([(d, "\n".join(ts)) for d, ts in STATEMENTS.items()], "doc_id long, full_text string")
    rows = statement_rows(pages, docs)
    got = {}
    for r in rows.orderBy("doc_id", "page_num", "seq").collect():
        got.setdefault(r.doc_id, []).append((r.date, r.amount, r.type, r.balance))
    assert got[1] == [("30-03-2026", "50.00", "CR", "55.63"), ("02-04-2026", "20.00", "DR", "35.63")]
    assert got[2] == [("01/01/2026", "50000", "CR", "50000"), ("05/01/2026", "2000", "DR", "48000")]
    assert [r[2] for r in got[3]] == ["CR", "DR", "DR"]
    assert 4 not in got
    assert got[5] == [("01/02/2026", "1200.00", "DR", "8800.00"), ("02/02/2026", "5000.00", "CR", "13800.00")]
    text = {r.description for r in rows.filter("doc_id = 1").collect()}
    assert "S521 UPI~7391~CR~SANKET note line" in text
    close = {r.doc_id: (r.opening_balance, r.closing_balance) for r in closing_balance(docs, rows).collect()}
    assert close == {1: ("5.63", "35.63"), 2: (None, "48000"), 3: ("100.00", "100.00"), 4: ("5.63", "130.43"), 5: (None, "13800.00")}


def test_micr(spark):
    texts = spark.createDataFrame([
        (1, "⑆000123⑆ 400002001⑈ 123456789012⑇ 10"), (2, "⑆00123⑆ 40000201⑈ ??"), (3, "⑆000123⑆ 400002001⑈ 123456789012⑇ 10"),
    ], "doc_id long, text string")
    fields = spark.createDataFrame([
        (1, "cheque_number", "000123"), (1, "account_number_masked", "XXXXXX9012"), (3, "cheque_number", "999999"), (3, "account_number_masked", "XXXXXX4321"),
    ], "doc_id long, field string, value string")
    got = {r.doc_id: r for r in reconcile_micr(texts, fields).collect()}
    assert (got[1].cheque_number, got[1].micr_code, got[1].account_number, got[1].tran_code) == ("000123", "400002001", "123456789012", "10")
    assert got[1].micr_confidence == "high" and got[1].micr_match and got[1].account_number_masked == "XXXXXXXX9012"
    assert got[2].micr_confidence == "low" and got[2].cheque_number is None
    assert not got[3].micr_match and len(got[3].micr_disagreements) == 2


def test_cross_check(spark):
    fields = spark.createDataFrame([
        (1, "name", "ROHIT SHARMA", None), (1, "dob", "24/04/1987", None), (1, "pan_number", "ABCDE1234F", None),
        (2, "raw_partner_names", None, ["VIKRAM MALHOTRA", "ROHAN DESHMUKH"]), (3, "partner_names", None, []),
    ], "doc_id long, field string, value string, values array<string>")
    exp = spark.createDataFrame([
        (1, "name", "Sharma Rohit", None), (1, "dob", "1987-04-24", None), (1, "identifier", "ABCDE1234F", None), (1, "city", "Pune", None),
        (2, "name", "VIKRAM MALHOTRA", None), (2, "applicant_name", "SURESH RAINA", None), (2, "partner_names", None, ["DESHMUKH ROHAN", "VIKRAM MALHOTRA"]),
        (3, "partner_names", "X", None),
    ], "doc_id long, key string, value string, values array<string>")
    got = {(r.doc_id, r.key): r for r in cross_check(fields, exp).collect()}
    assert all(got[1, k].matched and got[1, k].score == 1.0 for k in ("name", "dob", "identifier"))
    assert got[1, "city"].reason == "field_not_found_in_document"
    assert got[2, "name"].matched and got[2, "name"].extracted == "VIKRAM MALHOTRA"
    assert not got[2, "applicant_name"].matched and got[2, "applicant_name"].score < 0.5
    assert got[2, "partner_names"].matched and got[2, "partner_names"].score == 1.0
    assert got[3, "partner_names"].reason == "empty_list_in_field"


def test_model_outputs(spark):
    raw = spark.createDataFrame([
        (1, 'Sure ```json\n{"document_type": "Letter", "confidence": 0.9, "extracted_fields": {"name": "MODEL", "city": "Pune"}}\n```'),
        (2, 'x {"confidence": "high", "extracted_fields": {"field_name_1": "colour", "field_value_1": "red"}} y'), (3, "no json"),
    ], "doc_id long, raw string")
    docs = spark.createDataFrame([(1, "plain text"), (2, "INCOME TAX DEPARTMENT PERMANENT ACCOUNT NUMBER"), (3, "")], "doc_id long, full_text string")
    rules = spark.createDataFrame([(1, "name", "RULE")], "doc_id long, field string, value string")
    got = {r.doc_id: r for r in normalise_model_outputs(raw, docs, rules).collect()}
    assert (got[1].document_type, got[1].confidence, got[1].extracted_fields) == ("Letter", "high", {"name": "RULE", "city": "Pune"})
    assert (got[2].document_type, got[2].extracted_fields) == ("PAN Card", {"colour": "red"})
    assert (got[3].document_type, got[3].confidence, len(got[3].evidence)) == ("Unknown Document", "low", 2)
