"""Wording of grounded answers: which messages ask for what, and the sentences.  All values below are fixed values."""

from __future__ import annotations

# Asked-for actions, first match wins: rule -> phrases of which one is in the message.
ACTIONS: list[tuple[str, list[str]]] = [
    ("summary", ["summarize", "summary", "key provisions and scope", "executive overview"]),
    ("authenticity", [
        "is this document genuine", "is this document authentic", "is this authentic", "is it genuine", "is it authentic",
        "is this genuine", "is this fake", "has this been altered", "has this document been altered", "is this document forged",
        "document authenticity", "check authenticity", "is this document valid", "why is this review required",
        "why review required", "why is review required", "why is this marked review required", "what inconsistencies",
        "what are the inconsistencies", "why review", "why is review",
    ]),
    ("key_information", [
        "extract fields", "extract all primary structured fields", "extract all key", "extract key", "key entities",
        "key information", "structured fields", "identification numbers",
    ]),
    ("dates", ["find dates", "list all dates", "all dates", "effective periods, deadlines", "deadlines, and milestones"]),
    ("amounts", [
        "find numbers", "numerical figures", "numerical values", "monetary amounts", "identify all compensation",
        "find financial", "monetary values", "payment milestones", "salary details, payment milestones",
    ]),
]

# Document kinds that never state a joining date or a salary.
NOT_EMPLOYMENT = ["PAN Card", "Aadhaar Card", "Bank Statement", "GST Registration Certificate"]
SALARY_QUESTIONS = ["what is the salary", "what is the compensation", "how much is the salary", "what is salary", "salary?"]

REVIEW = "Verification Status: Review Required. Visible inconsistencies detected: %s. Manual review is recommended."
REVIEW_DEFAULT = "visible layout or format discrepancies"
UNSUPPORTED = (
    "This document is marked Unsupported. Offline authenticity verification is not available for unsupported document types, "
    "but full visual text and structural features have been extracted."
)
VERIFIED = (
    "No significant visible inconsistencies or checksum errors were detected in this document. The document is marked Verified, "
    "though external verification through the official issuer registry is recommended for full legal validation."
)
NO_DATES = "No clear dates were found in the document."
NO_AMOUNTS = "No numerical figures or financial information was found in this document."
NOT_CONFIDENT = "I could not confidently identify that information in this document."
SEARCHED = "I searched the extracted fields, OCR text, and visible document content, but I could not find a %s."

# Sentence of a found value by intent; any other intent: "The <name> is: **<value>**."
FOUND = {
    "pan_number": "The PAN number identified in this document is: **%s**.",
    "gstin": "The GSTIN identified in this document is: **%s**.",
    "account_holder": "The account holder is %s.",
    "account_number": "The account number is %s.",
    "customer_number": "The Customer Number is %s.",
    "ifsc": "The IFSC Code is %s.",
    "branch": "The branch is %s.",
    "bank_name": "The bank name is %s.",
    "statement_period": "The statement period is %s.",
    "date_of_birth": "The date of birth identified in this document is: **%s**.",
    "father_name": "The father's name is: **%s**.",
    "legal_name": "The legal business name is: **%s**.",
    "trade_name": "The trade name is: **%s**.",
    "constitution_of_business": "The constitution of business is: **%s**.",
    "principal_place_of_business": "The principal place of business is: **%s**.",
    "registration_date": "The registration date is: **%s**.",
    "opening_balance": "The opening balance is: **%s**.",
    "closing_balance": "The closing balance is: **%s**.",
    "total_transactions": "%s",
}
# Sentence where nothing was found; any other intent: "I could not find a <name> in this document."
MISSING = {
    "gstin": "I could not find a GSTIN in this document.",
    "pan_number": "I could not find a PAN number in this document.",
    "customer_number": "I could not find a Customer Number in this document.",
    "ifsc": "I could not find an IFSC Code in this document.",
    "branch": "I could not find the branch in this document.",
    "bank_name": "I could not find the bank name in this document.",
    "account_number": "I could not find an account number in this document.",
    "account_holder": "I could not find an account holder in this document.",
    "statement_period": "I could not find a statement period in this document.",
    "date_of_birth": "I could not find a date of birth in this document.",
    "father_name": "I could not find a father's name in this document.",
    "legal_name": "I could not find a legal business name in this document.",
    "trade_name": "I could not find a trade name in this document.",
    "constitution_of_business": "I could not find the constitution of business in this document.",
    "principal_place_of_business": "I could not find the principal place of business in this document.",
    "registration_date": "I could not find a registration date in this document.",
    "opening_balance": "I could not find an opening balance in this document.",
    "closing_balance": "I could not find a closing balance in this document.",
    "total_transactions": "No transaction records were identified in this document.",
}
