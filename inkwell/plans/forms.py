"""Derived documents of the form types, with the facts a reader would take from them.

A template is printed from ``kyc`` (one type per customer) and its facts are SQL of their own: they
share no rule table with the library, so a wrong pattern shows as a difference.
"""

from __future__ import annotations

_DAY = "lpad(CAST(1 + doc_id % 28 AS STRING), 2, '0')"
_MONTH = "lpad(CAST(1 + doc_id % 12 AS STRING), 2, '0')"
_YEAR = "CAST(2018 + doc_id % 6 AS STRING)"
_DATE = f"{_DAY} || '/' || {_MONTH} || '/' || {_YEAR}"
_DASHED = f"{_DAY} || '-' || {_MONTH} || '-' || {_YEAR}"
_THOUSANDS = "CAST(10 + doc_id % 90 AS STRING)"
_PRINTED = f"{_THOUSANDS} || ',' || lpad(CAST(doc_id % 1000 AS STRING), 3, '0')"
_AMOUNT = f"{_THOUSANDS} || lpad(CAST(doc_id % 1000 AS STRING), 3, '0')"
_SEVEN = "lpad(CAST(doc_id AS STRING), 7, '0')"
_GSTIN = "'27' || pan_number || '1Z5'"
_PERSON = "split_part({n}, ' ', 1) || ' ' || substr(split_part({n}, ' ', 2), 1, 1) || repeat('*', CAST(length(split_part({n}, ' ', 2)) - 1 AS INT))"
_MASKED = _PERSON.format(n="name")
_ACCOUNT = "repeat('X', 8) || right(account_number, 4)"



# type -> (lines as SQL, facts as SQL)
FORMS: dict[str, tuple[list[str], dict[str, str]]] = {
    "salary_slip": (
        ["'PAYSLIP'", "'Company Name: ACME PRIVATE LIMITED'", "'Employee Name: ' || name", f"'Gross Salary: Rs. ' || {_PRINTED}",
         "'Total Deductions: 500'", "'Net Pay: ' || CAST(9000 + doc_id % 1000 AS STRING)", "'Month: April 2025'"],
        {"employer_name": "'ACME PRIVATE LIMITED'", "raw_employee_name": "name", "employee_name": "name", "employee_name_masked": _MASKED,
         "gross_salary": _AMOUNT, "total_deductions": "'500'", "net_pay": "CAST(9000 + doc_id % 1000 AS STRING)", "pay_period": "'April 2025'"},
    ),
    "cancelled_cheque": (
        ["'Branch: PUNE MAIN BRANCH'", "'IFS Code: SBIN0' || lpad(CAST(doc_id AS STRING), 6, '0')", "'A/C No. ' || account_number",
         "'Cheque Number: ' || lpad(CAST(doc_id AS STRING), 6, '0')", "'Account Holder: ' || name", "'CANCELLED'"],
        {"marking": "'CANCELLED'", "account_number_masked": _ACCOUNT, "ifsc": "'SBIN0' || lpad(CAST(doc_id AS STRING), 6, '0')",
         "branch": "'PUNE MAIN BRANCH'", "cheque_number": "lpad(CAST(doc_id AS STRING), 6, '0')", "account_holder": "name"},
    ),
    "udyam": (
        ["'UDYAM REGISTRATION CERTIFICATE'", "'Enterprise Name: ' || name", f"'No: UDYAM-MH-01-' || {_SEVEN}",
         "'Type of Enterprise: ' || CASE WHEN doc_id % 3 = 0 THEN 'Micro' ELSE 'Small' END", "'Major Activity: Services'"],
        {"udyam_registration_number": f"'UDYAM-MH-01-' || {_SEVEN}", "enterprise_name": "name",
         "enterprise_type": "CASE WHEN doc_id % 3 = 0 THEN 'Micro' ELSE 'Small' END", "major_activity": "'Services'"},
    ),
    "fssai": (
        ["'FOOD SAFETY AND STANDARDS AUTHORITY OF INDIA'", "'Business Name: FRESH BAKES ' || CAST(doc_id AS STRING)",
         f"'FSSAI Licence Number: 1002202' || {_SEVEN}", "'Kind of Business: Bakery'", f"'Valid Till: ' || {_DATE}"],
        {"fssai_licence_number": f"'1002202' || {_SEVEN}", "business_name": "'FRESH BAKES ' || CAST(doc_id AS STRING)",
         "kind_of_business": "'Bakery'", "valid_till": _DATE},
    ),
    "shop_establishment": (
        ["'SHOPS AND ESTABLISHMENTS Government of Maharashtra'", "'Name of the establishment: METRO RETAILERS'",
         f"'Registration Number: MH-2026-' || {_SEVEN}"],
        {"establishment_name": "'METRO RETAILERS'", "registration_number": f"'MH-2026-' || {_SEVEN}", "state": "'MH'", "state_name": "'Maharashtra'",
         "issuing_authority": "'Government of Maharashtra'", "template_matched": "'true'", "template_verified": "'true'"},
    ),
    "utility_bill": (
        ["'MSEDCL ELECTRICITY BILL'", "'ग्राहक क्रमांक: ' || translate(lpad(CAST(doc_id AS STRING), 10, '1'), '0123456789', '०१२३४५६७८९')",
         f"'Bill Date: ' || {_DASHED}", f"'Due Date: ' || {_DAY} || '.' || {_MONTH} || '.' || {_YEAR}",
         f"'Bill Amount: Rs. ' || {_PRINTED} || '.00'"],
        {"utility_provider": "'Mahavitaran (MSEDCL)'", "consumer_number": "lpad(CAST(doc_id AS STRING), 10, '1')", "bill_date": _DATE,
         "due_date": _DATE, "bill_amount": f"{_AMOUNT} || '.00'"},
    ),
    "voter_id": (
        ["'ELECTION COMMISSION OF INDIA'", f"'EPIC No: WXY' || {_SEVEN}", "'Name: ' || name", "'Father''s Name: SURESH PATIL'",
         "'Age: ' || CAST(20 + doc_id % 70 AS STRING)", "'Gender: ' || CASE WHEN doc_id % 3 = 0 THEN 'Female' ELSE 'Male' END"],
        {"epic_number": f"'WXY' || {_SEVEN}", "name": "name", "relative_name": "'SURESH PATIL'", "age": "CAST(20 + doc_id % 70 AS STRING)",
         "gender": "CASE WHEN doc_id % 3 = 0 THEN 'Female' ELSE 'Male' END"},
    ),
    "driving_licence": (
        ["'UNION OF INDIA DRIVING LICENCE'", f"'Licence Number: MH12 2026' || {_SEVEN}", "'Name: ' || name", "'DOB: ' || dob",
         f"'Date of Issue: ' || {_DATE}", "'Vehicle Class: ' || CASE WHEN doc_id % 3 = 0 THEN 'LMV' ELSE 'MCWG' END"],
        {"licence_number": f"'MH12 2026' || {_SEVEN}", "name": "name", "dob": "dob", "issue_date": _DATE,
         "vehicle_class": "CASE WHEN doc_id % 3 = 0 THEN 'LMV' ELSE 'MCWG' END"},
    ),
    "itr": (
        ["'INDIAN INCOME TAX RETURN ACKNOWLEDGEMENT'", "'Name of Deductor: BIG BANK'", "'Name: ' || name",
         "'Acknowledgement Number: ' || lpad(CAST(doc_id AS STRING), 15, '9')", "'Assessment Year: 2024-25'",
         f"'Total Income: Rs. ' || {_PRINTED}"],
        {"name": "name", "acknowledgement_number": "lpad(CAST(doc_id AS STRING), 15, '9')", "assessment_year": "'2024-25'",
         "total_income": _AMOUNT},
    ),
    "gst_certificate": (
        ["'FORM GST REG-06'", "'Registration Number: 27 ' || substr(pan_number, 1, 5) || ' ' || substr(pan_number, 6) || '1Z5'",
         "'Legal Name: ' || name", "'Trade Name, if any: NOVA'", "'Constitution of Business: Proprietorship'"],
        {"gstin": _GSTIN, "legal_name": "name", "trade_name": "'NOVA'", "constitution_of_business": "'Proprietorship'"},
    ),
    "certificate_of_incorporation": (
        ["'CERTIFICATE OF INCORPORATION'", "'CIN: U12345MH2001PTC' || lpad(CAST(doc_id AS STRING), 6, '0')",
         "'Name of the Company: NOVA PRIVATE LIMITED'", f"'Date of Incorporation: ' || {_DATE}"],
        {"cin": "'U12345MH2001PTC' || lpad(CAST(doc_id AS STRING), 6, '0')", "company_name": "'NOVA PRIVATE LIMITED'",
         "date_of_incorporation": _DATE},
    ),
    "partnership_deed": (
        ["'PARTNERSHIP DEED'", "'Firm Name: EXCELSIOR'", "'1. ' || name", "'2. ROHAN DESHMUKH'", "'Profit sharing ratio: 50:50'"],
        {"firm_name": "'EXCELSIOR'", "raw_partner_names": "name || ', ROHAN DESHMUKH'", "partner_names": "name || ', ROHAN DESHMUKH'",
         "partner_names_masked": f"{_MASKED} || ', ROHAN D*******'", "profit_sharing_ratio": "'50:50'"},
    ),
    "rent_agreement": (
        ["'RENT AGREEMENT'", "'LESSOR: ASHA RAO'", "'LESSEE: ' || name", "'Property Address: Flat 4, Baner, Pune'",
         f"'Monthly Rent: Rs. ' || {_PRINTED}"],
        {"raw_lessor_name": "'ASHA RAO'", "lessor_name_masked": "'ASHA R**'", "raw_lessee_name": "name", "lessee_name_masked": _MASKED,
         "raw_property_address": "'Flat 4, Baner, Pune'", "property_address_masked": "'XXXX, Baner, Pune'", "monthly_rent": _AMOUNT},
    ),
    "form_16": (
        ["'FORM NO. 16'", "'PAN of the Employee: ' || pan_number", "'TAN of the Deductor: PNEA' || lpad(CAST(doc_id AS STRING), 5, '0') || 'B'",
         "'Assessment Year: 2024 - 25'", f"'Gross Salary: ' || {_PRINTED} || '.00'"],
        {"pan_number": "pan_number", "tan_number": "'PNEA' || lpad(CAST(doc_id AS STRING), 5, '0') || 'B'",
         "assessment_year": "'2024-25'", "gross_salary": f"{_AMOUNT} || '.00'"},
    ),
    "property_tax_receipt": (
        ["'PROPERTY TAX RECEIPT'", "'Property ID: P/12/' || CAST(100 + doc_id AS STRING)", "'Owner Name: ASHA RAO'",
         f"'Tax Amount Paid: Rs. ' || {_PRINTED}", f"'Payment Date: ' || {_DATE}"],
        {"property_id": "'P/12/' || CAST(100 + doc_id AS STRING)", "raw_owner_name": "'ASHA RAO'", "owner_name_masked": "'ASHA R**'",
         "tax_amount_paid": _AMOUNT, "payment_date": _DATE},
    ),
    "iec_certificate": (
        ["'DIRECTORATE GENERAL OF FOREIGN TRADE'", "'IEC Number: ' || pan_number", "'Name of the Firm: NOVA EXPORTS'",
         f"'Date of Issue: ' || {_DATE}"],
        {"iec_number": "pan_number", "entity_name": "'NOVA EXPORTS'", "issue_date": _DATE},
    ),
    "income_certificate": (
        ["'INCOME CERTIFICATE'", "'Certificate No: ' || lpad(CAST(doc_id AS STRING), 17, '7')", "'Applicant Name: RAM PATIL'",
         "'District: Pune'", f"'2023-2024 ' || {_PRINTED} || ' Forty Thousand Only'", "'Date: 2024-06-10'"],
        {"certificate_number": "lpad(CAST(doc_id AS STRING), 17, '7')", "applicant_name": "'RAM PATIL'", "district": "'Pune'",
         "annual_income": _AMOUNT, "financial_year": "'2023-2024'", "income_amount_words": "'Forty Thousand Only'", "document_type": "'Income Certificate'", "issue_date": "'2024-06-10'", "needs_manual_review": "'false'"},
    ),
    "employment_contract": (
        ["'EMPLOYMENT AGREEMENT between Nova Corp and Asha Rao'", "'Position: Analyst'", f"'Salary: ' || {_PRINTED} || ' per month'"],
        {"employee_name": "'Asha Rao'", "employer": "'Nova Corp'", "position": "'Analyst'", "salary": f"{_PRINTED} || ' per month'"},
    ),
    "income_tax_notice": (
        ["'INCOME TAX DEPARTMENT NOTICE UNDER SECTION 143(2)'", "'Assessment Year: 2023-24'", "'DIN: ITBA/AST/' || CAST(doc_id AS STRING)"],
        {"assessment_year": "'2023-24'", "section": "'143(2)'", "din": "'ITBA/AST/' || CAST(doc_id AS STRING)"},
    ),
    "commercial_invoice": (
        ["'TAX INVOICE NO: INV-' || CAST(doc_id AS STRING)", f"'Total: ' || {_PRINTED}"],
        {"invoice_number": "'INV-' || CAST(doc_id AS STRING)", "total_amount": _PRINTED},
    ),
}

_OWN = "CAST(floor(doc_id / 3) AS BIGINT) % " + str(len(FORMS))

#: View of the documents: doc_id, expected_type, full_text.
FORM_DOCS = (
    "SELECT doc_id, CASE " + _OWN + " " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(FORMS)) + " END AS expected_type,\n"
    "  CASE " + _OWN + "\n" + "\n".join(
        f"    WHEN {i} THEN " + " || chr(10) || ".join(lines) for i, (lines, _) in enumerate(FORMS.values())
    ) + "\n  END AS full_text\nFROM kyc"
)

#: The facts, one row each.
FORM_FACTS = " UNION ALL ".join(
    f"SELECT doc_id, '{t}' AS doc_type, '{field}' AS field, {value} AS value FROM kyc WHERE {_OWN} = {i}"
    for i, (t, (_, facts)) in enumerate(FORMS.items()) for field, value in facts.items()
)
