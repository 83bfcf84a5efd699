"""Field intents: how a question names a field and where its value is.

All keywords, patterns and orders below are fixed values.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Intent:
    key: str
    display: str
    keywords: list[str]
    regexes: list[str]
    fields: list[str]                 # extracted field names, best first
    patterns: list[str] = field(default_factory=list)
    accept: str = ""                  # value must match (ignoring case)
    refuse: str = ""                  # value must not match (ignoring case)
    min_length: int = 1
    unspaced: bool = False            # validate without white space
    form: str = "plain"               # plain | upper | upper_unspaced | squeeze | account | date | period


_CONFIGURED = r"\d{1,2}[/\-\.]\d{1,2}[/\-\.]\d{4}"
_NAME_END = r"(?=[ \t]*(?:\r?\n|$|Account\s*No|A/C|Address|Joint|Customer\s*ID|CIF|Nominee|IFSC|Branch))"

INTENTS: list[Intent] = [
    Intent(
        "pan_number", "PAN Number",
        ["pan", "pan number", "pan no", "pan card number", "permanent account number", "panno", "pan_num"],
        [r"\bpan\b", r"\bpan\s*(?:no\.?|num(?:ber)?|card)\b", r"\bpermanent\s*account\s*number\b"],
        ["pan_number", "pan", "pan_card_number"],
        [r"\b([A-Z]{5}[0-9]{4}[A-Z])\b"], accept=r"^[A-Z]{5}[0-9]{4}[A-Z]$", form="upper",
    ),
    Intent(
        "gstin", "GSTIN",
        ["gstin", "gst number", "gst no", "gst registration", "gstin number", "goods and services tax number", "gst code"],
        [r"\bgstin\b", r"\bgst\s*(?:no\.?|num(?:ber)?|code)\b", r"\bgst\s*registration\s*number\b"],
        ["gstin", "gst_number", "gst_no"],
        [r"\b([0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][1-9A-Z]Z[0-9A-Z])\b"],
        accept=r"^[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][1-9A-Z]Z[0-9A-Z]$", unspaced=True, form="upper_unspaced",
    ),
    Intent(
        "ifsc", "IFSC Code",
        ["ifsc", "ifsc code", "ifs code", "rtgs code", "neft code", "rtgs/neft", "neft/ifsc", "ifsc no"],
        [r"\bifsc\b", r"\bifs\s*code\b", r"\brtgs\b", r"\bneft\b"],
        ["ifsc", "ifsc_code", "ifs_code"],
        [r"\b([A-Z]{4}0[A-Z0-9]{6})\b"], accept=r"^[A-Z]{4}0[A-Z0-9]{6}$", form="upper",
    ),
    Intent(
        "branch", "Branch",
        ["branch", "branch name", "sol branch", "branch office", "which branch", "bank branch", "sol name"],
        [r"\bbranch\b", r"\bsol\s*branch\b", r"\bbranch\s*(?:name|office)?\b"],
        ["branch", "branch_name", "branch_office"],
        [
            r"(?:Branch\s*(?:Office|Name)?\s*[:\-]\s*)([A-Za-z0-9\s,\[\]\(\)\.\/-]+?)(?=[ \t]*(?:\r?\n\r?\n|\r?\n[A-Z0-9\s]+:|$|Account|IFSC|MICR|Tel|Scheme|Opening|Joint|\bS\.NO\b))"
        ],
        refuse=r"^(?:Statement|Account|Balance|Customer|Period|Number|Name\(SOL\))$", min_length=3, form="squeeze",
    ),
    Intent(
        "customer_number", "Customer Number",
        [
            "customer no", "customer number", "customer id", "cust id", "cust no", "cif number", "cif no", "cif",
            "customer identification", "customer code",
        ],
        [r"\bcustomer\s*(?:no\.?|num(?:ber)?|id|code)\b", r"\bcust\s*(?:no\.?|id)\b", r"\bcif\s*(?:no\.?|num(?:ber)?)?\b"],
        ["customer_number", "customer_id", "cust_id", "cif", "cif_no", "cif_number"],
        [r"(?:Customer\s*(?:No\.?|Number|ID)|Cust\s*ID|CIF\s*(?:No\.?|Number)?)[\s:]*([A-Za-z0-9]+)"],
        accept=r"^[\p{L}\p{N}]+$", min_length=4,
    ),
    Intent(
        "account_holder", "Account Holder",
        [
            "account holder", "acc holder", "account held by", "who holds the account", "name of the account holder",
            "name of account holder", "account name", "who is the account holder", "account holder name", "account owner",
            "holder name",
        ],
        [r"\baccount\s*holder(?:\s*name)?\b", r"\baccount\s*held\s*by\b", r"\bwho\s*holds\b", r"\bholder\s*name\b"],
        ["account_holder", "account_holder_name", "cardholder_name", "name"],
        [
            r"(?:Account\s*Holder(?:\s*Name)?|Customer\s*Name|खातेदाराचे\s*नाव|खाताधारक\s*का\s*नाम)[\s:]*([A-Za-z][A-Za-z\s.'-]{2,40}?)" + _NAME_END,
            r"(?:(?:Mr\.|Mrs\.|Ms\.|Shri|Smt\.)\s+([A-Za-z][A-Za-z\s.'-]{2,40}?))(?=[ \t]*(?:\r?\n|$|Account|A/C|Address|Branch|IFSC))",
        ],
        refuse=r"\b(?:Statement|Account|Balance|Branch|Bank|Customer|Number|IFSC)\b", min_length=3, form="squeeze",
    ),
    Intent(
        "account_number", "Account Number",
        ["account number", "account no", "a/c no", "a/c number", "acc no", "acc number", "bank account number"],
        [r"\baccount\s*(?:no\.?|num(?:ber)?)\b", r"\ba/c\s*(?:no\.?|num(?:ber)?)\b", r"\bacc\s*(?:no\.?|num(?:ber)?)\b"],
        ["account_number", "account_number_masked", "account_num"],
        [r"(?:Account\s*(?:Number|No\.?)|A/C\s*(?:Number|No\.?))[\s:]*([X\d]{6,18})"],
        accept=r"[X\d]{6,18}", form="account",
    ),
    Intent(
        "statement_period", "Statement Period",
        [
            "statement period", "statement duration", "period of statement", "duration of statement",
            "period of the statement", "statement date range", "transaction period",
        ],
        [r"\bstatement\s*(?:period|duration|dates?)\b", r"\bperiod\s*of\s*(?:the\s*)?statement\b", r"\btransaction\s*period\b"],
        ["statement_period", "transaction_period", "period"],
        [
            r"(?:Transaction\s*Period|Statement\s*Period|Period)[\s:]*(?:\(\s*)?(?:From\s*[:]\s*)?([A-Za-z0-9\/\-\.]+)\s*(?:to|-|To\s*[:])\s*([A-Za-z0-9\/\-\.]+)"
        ],
        form="period",
    ),
    Intent(
        "date_of_birth", "Date of Birth",
        ["date of birth", "dob", "birth date", "birthdate", "when born", "born on"],
        [r"\bdate\s*of\s*birth\b", r"\bdob\b", r"\bbirth\s*date\b", r"\bborn\b"],
        ["date_of_birth", "dob", "birth_date"],
        [
            r"(?:Date\s*of\s*Birth|DOB|जन्म\s*तारीख|जन्म\s*दिनांक)[\s:]*([0-9]{1,2}[/\-\.][0-9]{1,2}[/\-\.][0-9]{4})",
            r"\b(\d{2}[/-]\d{2}[/-]\d{4})\b",
        ],
        accept=_CONFIGURED, form="date",
    ),
    Intent(
        "father_name", "Father's Name",
        ["father's name", "father name", "father", "fathers name", "parent name"],
        [r"\bfather['’]?s?\s*name\b", r"\bfather\b"],
        ["father_name", "fathers_name", "father"],
        [
            r"(?:Father(?:'s)?\s*Name|वडिलांचे\s*नाव|पिता\s*का\s*नाम)[\s:]*([A-Za-z][A-Za-z\s.'-]{2,40}?)(?=[ \t]*(?:\r?\n|$|Date|DOB|Permanent|PAN))"
        ],
        refuse=r"\b(?:Income|Department|Govt|India|Permanent)\b", min_length=3, form="squeeze",
    ),
    Intent(
        "bank_name", "Bank Name",
        ["bank name", "name of the bank", "which bank", "name of bank", "banking institution"],
        [r"\bbank\s*name\b", r"\bwhich\s*bank\b", r"\bname\s*of\s*(?:the\s*)?bank\b"],
        ["bank_name", "bank", "institution_name"],
        [
            r"(?:Bank\s*Name|Name\s*of\s*Bank)[\s:]*([A-Za-z\s&]+?)(?=[ \t]*(?:\r?\n|$|Branch|IFSC|A/C))",
            r"\b(AXIS\s*BANK|STATE\s*BANK\s*OF\s*INDIA|HDFC\s*BANK|ICICI\s*BANK|PUNJAB\s*NATIONAL\s*BANK|BANK\s*OF\s*BARODA|CANARA\s*BANK|UNION\s*BANK|KOTAK\s*MAHINDRA|INDUSIND\s*BANK|YES\s*BANK|IDBI\s*BANK)\b",
        ],
        min_length=3, form="squeeze",
    ),
    Intent(
        "opening_balance", "Opening Balance",
        ["opening balance", "start balance", "initial balance", "starting balance"],
        [r"\bopening\s*balance\b", r"\bstart(?:ing)?\s*balance\b"],
        ["opening_balance", "open_balance", "start_balance"],
        [r"(?:Opening\s*Balance|Start\s*Balance)[\s:]*(?:INR|Rs\.?|₹)?\s*([\d,]+\.?\d*)"],
    ),
    Intent(
        "closing_balance", "Closing Balance",
        ["closing balance", "end balance", "ending balance", "final balance"],
        [r"\bclosing\s*balance\b", r"\bend(?:ing)?\s*balance\b"],
        ["closing_balance", "close_balance", "end_balance"],
        [r"(?:Closing\s*Balance|End\s*Balance)[\s:]*(?:INR|Rs\.?|₹)?\s*([\d,]+\.?\d*)"],
    ),
    Intent(
        "total_transactions", "Total Transactions",
        [
            "total transaction", "total transactions", "transaction count", "how many transactions", "sum of transactions",
            "transaction volume",
        ],
        [r"\btotal\s*transactions?\b", r"\bhow\s*many\s*transactions\b", r"\btransaction\s*(?:count|volume)\b"],
        ["transactions", "total_transactions"],
    ),
    Intent(
        "legal_name", "Legal Name",
        ["legal name", "legal business name", "registered legal name", "company legal name"],
        [r"\blegal\s*name\b", r"\blegal\s*business\s*name\b"],
        ["legal_name", "business_name", "company_name"],
        [
            r"(?:Legal\s*Name(?:[\s/]*(?:of\s+Taxpayer)?)?)[\s:]*([A-Za-z0-9][A-Za-z0-9 \t,\.\-&_]{1,70}?)(?=[ \t]*(?:\r?\n|$|Trade\s*Name|GSTIN|Constitution|Date|Address))"
        ],
        min_length=3, form="squeeze",
    ),
    Intent(
        "trade_name", "Trade Name",
        ["trade name", "doing business as", "dba"],
        [r"\btrade\s*name\b", r"\bd/b/a\b"],
        ["trade_name"],
        [
            r"(?<!Additional\s)\bTrade\s*Name(?:\s*,\s*if\s*any)?[\s:]+([A-Za-z0-9][A-Za-z0-9 \t,\.\-&]{1,70}?)(?=[ \t]*(?:\r?\n|$|Constitution|Legal\s*Name|GSTIN|Date|Address))"
        ],
        min_length=3, form="squeeze",
    ),
    Intent(
        "registration_date", "Registration Date",
        ["registration date", "date of registration", "date of liability", "effective date of registration"],
        [r"\bregistration\s*date\b", r"\bdate\s*of\s*registration\b", r"\bdate\s*of\s*liability\b"],
        ["registration_date", "date_of_registration", "date_of_liability"],
        [
            r"(?:Date\s*of\s*(?:Registration|Liability)|Registration\s*Date)[\s:]*([0-9]{1,2}[/\-\.][0-9]{1,2}[/\-\.][0-9]{4})"
        ],
        accept=_CONFIGURED, form="date",
    ),
    Intent(
        "constitution_of_business", "Constitution of Business",
        ["constitution", "constitution of business", "business constitution", "entity type"],
        [r"\bconstitution(?:\s*of\s*business)?\b", r"\btype\s*of\s*constitution\b"],
        ["constitution_of_business", "constitution"],
        [r"(?:Constitution\s*of\s*Business)[\s:]*([A-Za-z\s]+?)(?=[ \t]*(?:\r?\n|$|Address|Date|Period))"],
        min_length=3, form="squeeze",
    ),
    Intent(
        "principal_place_of_business", "Principal Place of Business",
        ["principal place of business", "place of business", "registered office address", "business address"],
        [r"\bprincipal\s*place(?:\s*of\s*business)?\b", r"\bplace\s*of\s*business\b", r"\bregistered\s*office\b"],
        ["principal_place_of_business", "address", "registered_office"],
        [
            r"(?:Principal\s*Place\s*of\s*Business|Address)[\s:]*([A-Za-z0-9\s,\[\]\(\)\.\/-]+?)(?=[ \t]*(?:\r?\n\r?\n|$|Details|State|Date))"
        ],
        min_length=5, form="squeeze",
    ),
]

# Words that decide the intent before the table is consulted.
PRIORITY: list[tuple[str, list[str]]] = [
    ("ifsc", ["ifsc", "rtgs", "neft"]),
    ("customer_number", ["customer", "cif", "cust id", "cust no"]),
    ("statement_period", ["period", "duration"]),
    ("account_holder", [
        "account holder", "acc holder", "account held by", "who holds the account", "account name", "holder name",
    ]),
    ("father_name", ["father"]),
]
IFSC_NEVER = ["STATE BANK", "AXIS", "HDFC", "ICICI", "BANK"]

# Field order of the key-information list, by word in the type.
KEY_ORDER: list[tuple[str, list[str]]] = [
    ("gst", ["gstin", "legal_name", "trade_name", "constitution_of_business", "principal_place_of_business"]),
    ("pan", ["pan_number", "cardholder_name", "name", "father_name", "date_of_birth"]),
    ("bank", [
        "bank_name", "account_holder", "account_number", "customer_number", "branch", "ifsc", "statement_period",
        "opening_balance", "closing_balance",
    ]),
    ("employment", ["employer", "employee_name", "position", "salary", "joining_date"]),
]
FIELD_LABELS: dict[str, str] = {
    "gstin": "GSTIN", "legal_name": "Legal Business Name", "trade_name": "Trade Name",
    "constitution_of_business": "Constitution of Business", "principal_place_of_business": "Principal Place of Business",
    "pan_number": "PAN Number", "name": "Cardholder Name", "cardholder_name": "Cardholder Name",
    "father_name": "Father's Name", "date_of_birth": "Date of Birth", "dob": "Date of Birth",
    "aadhaar_number": "Aadhaar Number", "gender": "Gender", "address": "Address", "account_number": "Account Number",
    "account_holder": "Account Holder", "customer_number": "Customer Number", "customer_id": "Customer ID",
    "branch": "Branch", "bank_name": "Bank Name", "ifsc": "IFSC Code", "ifsc_code": "IFSC Code",
    "statement_period": "Statement Period", "opening_balance": "Opening Balance", "closing_balance": "Closing Balance",
    "employee_name": "Employee Name", "employer": "Employer", "position": "Position / Role",
    "salary": "Salary / Compensation", "joining_date": "Joining Date", "invoice_number": "Invoice Number",
    "total_amount": "Total Amount", "assessment_year": "Assessment Year", "section": "Section", "din": "DIN",
}
