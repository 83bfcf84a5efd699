"""Extraction rules as data.

A rule names a field, where to look and what to do with the match.  Rules of
one field are tried in order; the first whose value passes its guard wins.
All patterns, word lists and maps below are fixed values.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    field: str
    pattern: str
    groups: tuple[int, ...] = (1,)      # first non-empty group is taken
    flags: str = "i"                    # i ignore case, m line anchors, s dot matches line ends
    source: str = "text"                # text | digits (Devanagari digits as ASCII) | upper
    op: str = "clean"                   # see operators.extract
    guard: str = ""
    confidence: float | str | None = "line"
    copies: tuple[str, ...] = ()        # further field names for the same value
    masked: tuple[str, str] | None = None  # (field, masking)
    drop: bool = False                  # keep only the copies and the masked form
    constant: str = ""                  # value when the pattern is merely present
    line_pattern: str = ""              # finds the line whose confidence counts


DATE = r"\d{2}[/\-\.]\d{2}[/\-\.]\d{4}"
END = r"(?=[ \t]*(?:\r?\n|$|(?:\b|(?<=[a-z0-9A-Z]))(?:{})\b))"
END_DEV = r"(?=[ \t]*(?:\r?\n|$|(?:\b|(?<=[a-z0-9A-Z\u0900-\u097F]))(?:{})\b))"
END_FREE = r"(?=[ \t]*(?:\r?\n|$|{}))"

ENTERPRISE_TYPES = {
    "सूक्ष्म": "Micro", "लघु": "Small", "मध्यम": "Medium",
    "micro": "Micro", "small": "Small", "medium": "Medium",
}
ACTIVITIES = {
    "trading": "Trading", "services": "Services", "manufacturing": "Manufacturing",
    "व्यापार": "Trading", "ट्रेडिंग": "Trading", "सेवा": "Services", "सेवाएं": "Services",
    "उत्पादन": "Manufacturing", "विनिर्माण": "Manufacturing",
}
GENDERS = {
    "male": "Male", "female": "Female", "transgender": "Transgender",
    "पुरुष": "Male", "स्त्री": "Female", "महिला": "Female", "तृतीयपंथी": "Transgender",
}
_TYPE_WORDS = r"(Micro|Small|Medium|सूक्ष्म|लघु|मध्यम)"
_TYPE_LABEL = r"(?:Type\s*of\s*Enterprise|Enterprise\s*Type|उद्यमाचा\s*प्रकार|उद्यम\s*का\s*प्रकार)"
_ACT_WORDS = r"(Trading|Services|Manufacturing|व्यापार|ट्रेडिंग|सेवाएं|सेवा|उत्पादन|विनिर्माण)"
_ACT_LABEL = r"(?:MAJOR\s*ACTIVITY|मुख्य\s*(?:कार्यकलाप|गतिविधि|कामकाज))"
_WORD_START = r"(?:\b|(?<=[\s:]))"
_WORD_END = r"(?=\b|[\s\r\n:]|$)"

ACCOUNT_LABEL = r"(?:Account\s*(?:Number|No\.?)|A/C\s*(?:Number|No\.?))"
_BANK_WORDS = r"[A-Za-z][A-Za-z \t.&'-]+?\b(?:BANK(?:\s+OF\s+[A-Za-z]+)?|PAYMENTS\s+BANK)|BANK\s+OF\s+[A-Za-z]+"
COMMON_BANKS = [
    ("STATE BANK OF INDIA", "State Bank of India"), ("HDFC BANK", "HDFC Bank"), ("ICICI BANK", "ICICI Bank"),
    ("AXIS BANK", "Axis Bank"), ("KOTAK MAHINDRA BANK", "Kotak Mahindra Bank"),
    ("PUNJAB NATIONAL BANK", "Punjab National Bank"), ("BANK OF BARODA", "Bank of Baroda"),
    ("CANARA BANK", "Canara Bank"), ("UNION BANK OF INDIA", "Union Bank of India"),
    ("INDIAN BANK", "Indian Bank"), ("IDBI BANK", "IDBI Bank"), ("INDUSIND BANK", "IndusInd Bank"),
    ("YES BANK", "Yes Bank"), ("FEDERAL BANK", "Federal Bank"),
]
UTILITY_PROVIDERS = [
    ("महावितरण|महािवतरण|महाराष्ट्र राज्य विद्युत|MSEDCL|MAHADISCOM|MAHAVITARAN", "Mahavitaran (MSEDCL)"),
    ("टाटा पॉवर|TATA POWER", "Tata Power"),
    ("अदानी|ADANI ELECTRICITY", "Adani Electricity"),
    ("बेस्ट|BEST UNDERTAKING", "BEST Undertaking"),
    ("टॉरेंट पॉवर|TORRENT POWER", "Torrent Power"),
    ("ELECTRICITY|POWER|विद्युत|वीज", "Electricity Distribution Board"),
    ("WATER|पाणी|जल", "Water Supply Department"),
    ("GAS|गॅस", "Natural Gas Corporation"),
]

# State templates: code, name, verified, issuing authority, authority patterns, number patterns.
STATE_TEMPLATES = [
    (
        "MH", "Maharashtra", True, "Government of Maharashtra",
        [
            r"Government\s+of\s+Maharashtra", r"Labour\s+Department[,\s]+Maharashtra", r"Aaple\s*Sarkar",
            r"Municipal\s+Corporation\s+of\s+Greater\s+Mumbai", r"Pune\s+Municipal\s+Corporation",
            r"\bMAHARASHTRA\b", r"महाराष्ट्र\s*शासन", r"कामगार\s*आयुक्त", r"बृहन्मुंबई\s*महानगरपालिका",
            r"पुणे\s*महानगरपालिका", r"आपले\s*सरकार", r"दुकान\s*(?:आणि|व)\s*आस्थापना",
            r"महारा\s+(?:दु\s*क\s*ाने|दुकान|दुकाने)\s*(?:आणि|व)\s*आ\s*थ?स्थापना",
            r"नमु\s*न\s*ा\s*[\"'\u201c\u201d]?[फगFG][\"'\u201c\u201d]?",
            r"Form\s*[-–]\s*[\"'\u2018\u2019]?[फगFG][\"'\u2018\u2019]?",
        ],
        [
            r"(?:नोंदणी\s*(?:क्रमांक|क्र\.?)|Registration\s*Number|Reg\s*No\.?|Certificate\s*No\.?)[\s:]*([A-Za-z0-9\-\/]{5,30})",
            r"(?:पावती\s*(?:क्रमांक|क्र\.?|मांक)|Registration\s*Certificate\s*/\s*Intimation)[\s:]*([A-Za-z0-9\-\/]{5,30})",
            r"\b(SHOP-[A-Z0-9\-]+)\b",
            r"\b(MH[0-9A-Z\-\/]{6,25})\b",
        ],
    ),
    (
        "DL", "Delhi", False, "Government of NCT of Delhi",
        [
            r"Government\s+of\s+NCT\s+of\s+Delhi", r"Labour\s+Department[,\s]+Delhi", r"NCT\s+of\s+Delhi", r"\bDELHI\b",
        ],
        [
            r"(?:Registration\s*Number|Reg\s*No\.?|Certificate\s*No\.?)[\s:]*([A-Za-z0-9\-\/]{5,30})",
            r"\b(DL[0-9A-Z\-\/]{5,25})\b",
            r"\b(D-SE\/[0-9A-Z\-\/]+)\b",
        ],
    ),
    (
        "KA", "Karnataka", False, "Government of Karnataka",
        [
            r"Government\s+of\s+Karnataka", r"Labour\s+Department[,\s]+Karnataka", r"e-Karmika", r"\bKARNATAKA\b",
            r"\bBENGALURU\b", r"\bBANGALORE\b",
        ],
        [
            r"(?:Registration\s*Number|Reg\s*No\.?|Certificate\s*No\.?)[\s:]*([A-Za-z0-9\-\/]{5,30})",
            r"\b(KA[0-9A-Z\-\/]{5,25})\b",
            r"\b(KSC\/[0-9A-Z\-\/]+)\b",
        ],
    ),
]
SHOP_NUMBER = r"(?:नोंदणी\s*(?:क्रमांक|क्र\.?)|Registration\s*Number|Reg\s*No\.?)[\s:]*([A-Za-z0-9\-\/]{5,25})"

PARTNER_PATTERNS = [
    r"(?:Party\s*of\s*(?:the\s*)?(?:First|Second|Third|Fourth|[1-4])\s*Part|Partner\s*[0-9]+|Between\s+(?:Mr\.|Shri|Smt\.)?)[\s,:-]*([A-Za-z][A-Za-z \t.'-]{2,40}?)(?=[ \t]*(?:\r?\n|$|(?:\b|(?<=[a-z0-9A-Z]))(?:hereinafter|son\s+of|daughter\s+of|wife\s+of|residing|party|and)\b))",
    r"(?:(?:^|\n)\s*(?:[0-9]+[\.\)]|Partner\s*[0-9]+[\.:]))\s*([A-Za-z][A-Za-z \t.'-]{2,40}?)(?=[ \t]*(?:\r?\n|$|(?:\b|(?<=[a-z0-9A-Z]))(?:hereinafter|son\s+of|daughter\s+of|wife\s+of|residing|party|and)\b))",
]

_ITR_NAME = (
    r"\bName\b(?!\s*of\s*(?:Deductor|Employer|Bank|Buyer|Collector|Seller|Deductee|Premises|Branch))[\s:]*"
    r"([A-Za-z0-9][A-Za-z0-9 \t.,'\-&_]{1,60}?)"
    + END.format("PAN|Address|Status|Form|Acknowledgement|Ack|Date|Father|Total|Taxes|Current")
)
_ITR_AMOUNT = r"[\s:]+(?:(?:(?:Row\s*)?\d+[A-Za-z]?)\b[\s:]+)?(?:Rs\.?|INR)?\s*([\d,]+(?:\.\d{2})?)"
_RUPEES = r"[\s:：.]+(?:Rs\.?|INR|₹|रु\.?|रुपये)?\s*([\d,]+\.?\d*)"

RULES: dict[str, list[Rule]] = {
    "pan": [
        Rule("pan_number", r"\b([A-Z]{5}\s*[0-9]{4}\s*[A-Z])\b", flags="", op="compact_upper"),
        Rule("dob", rf"(?:(?:Date\s*of\s*Birth|DOB|जन्म\s*(?:की\s*)?तारीख)[\s:]*)?(\b{DATE}\b)", op="date"),
        Rule(
            "father_name",
            r"(?:(?:पिता\s*(?:का\s*नाम)?\s*[\/|\\]?\s*Father['’]?s?\s*Name)|Father['’]?s?\s*Name|पिता\s*का\s*नाम)[\s:\/\u0900-\u097F]*(?:\r?\n\s*)*([A-Za-z][A-Za-z \t.'-]{1,35}?)"
            + END.format("Purpose|DOB|Date|Name|Permanent|PAN|जन्म"),
            guard="pan_father",
        ),
        Rule(
            "name",
            r"(?:(?:नाम\s*[\/|\\]?\s*Name)|Name|NAME|नाम)[\s:\/\u0900-\u097F]*(?:\r?\n\s*)*([A-Za-z][A-Za-z \t.'-]{1,35}?)"
            + END.format("Father|DOB|Date|Permanent|PAN|Purpose|पिता|जन्म"),
            guard="pan_name",
        ),
    ],
    "aadhaar": [
        # the groups stand on one line: a year that ends the line above is not part of the number
        Rule(
            "raw_aadhaar", r"\b(\d{4}[ \t]\d{4}[ \t]\d{4}|\d{12})\b", source="digits", flags="", op="compact",
            masked=("aadhaar_number,aadhaar_number_masked", "uid"),
            line_pattern=r"(\d{4}[ \t]\d{4}[ \t]\d{4}|\d{12})",
        ),
        Rule(
            "aadhaar_number", r"\b([X\d]{4}[ \t][X\d]{4}[ \t]\d{4})\b", source="digits", op="upper", copies=("aadhaar_number_masked",),
        ),
        Rule(
            "name",
            r"(?:Name|नाव|नाम)[\s:]*(?:\r?\n)?[\s:]*([A-Za-z\u0900-\u097F][A-Za-z\u0900-\u097F \t.'-]{1,35}?)"
            + END_DEV.format("Aadhaar|DOB|Date|Gender|Address|Father|Mother|Husband|Year|YOB|आधार|जन्म|लिंग|पत्ता"),
            guard="uid_name",
        ),
        Rule("dob", rf"(?:DOB|Date of Birth|जन्मतारीख|जन्म\s*तारीख|जन्म\s*तिथि)[\s:]+({DATE})", op="date"),
        Rule("dob", r"(?:Year of Birth|YOB|जन्म\s*वर्ष)[\s:]+(\d{4})"),
        Rule("gender", r"\b(MALE|FEMALE|TRANSGENDER)\b|(पुरुष|स्त्री|महिला|तृतीयपंथी)", groups=(1, 2), op="gender"),
    ],
    "cancelled_cheque": [
        Rule("marking", r"\bCANCELLED\b", constant="CANCELLED", confidence=1.0),
        Rule(
            "_account", r"(?:A/C\s*No\.?|Account\s*Number)[\s:]*([X\d]{6,18})", op="raw", drop=True,
            masked=("account_number_masked", "account"),
        ),
        Rule("ifsc", r"\b([A-Z]{4}0[A-Z0-9]{6})\b", flags=""),
        Rule("bank_name", r"(?:Bank\s*Name|Bank)[\s:]*([A-Za-z][A-Za-z \t.&'-]+?BANK)\b", confidence=None),
        Rule(
            "branch",
            r"(?:Branch)[\s:]*([A-Za-z0-9][A-Za-z0-9 \t,.'-]{1,40}?)" + END.format("IFSC|IFS|A/C|Account|Cheque|Chq|Payee"),
            confidence=None,
        ),
        Rule("cheque_number", r"(?:Cheque\s*Number|Chq\s*No)[\s:]*(\d{6})"),
        Rule(
            "account_holder",
            r"(?:Account\s*Holder|Payee|Name)[\s:]*([A-Za-z][A-Za-z \t.'-]{1,35}?)"
            + END.format("Branch|IFSC|IFS|A/C|Account|Cheque|Chq|CANCELLED"),
            guard="cheque_holder",
        ),
    ],
    "udyam": [
        Rule("udyam_registration_number", r"\b(UDYAM-[A-Z]{2}-\d{2}-\d{7})\b", op="upper"),
        Rule(
            "enterprise_name",
            r"(?:उद्यमाचे\s*नाव|उद्यम\s*का\s*नाम|Enterprise\s*Name|Name of Enterprise)[\s:]*([^\r\n:]{1,60}?)"
            + END_DEV.format(
                r"SNo|S\.No|Type of Enterprise|उद्यमाचा\s*प्रकार|Classification|Major Activity|मुख्य\s*कार्यकलाप|Social Category|Date|Official Address"
            ),
        ),
        Rule("enterprise_type", _TYPE_LABEL + r"[\s:]*([^\r\n:]{1,30})", op="enterprise_type", confidence=0.98),
        Rule(
            "enterprise_type", _TYPE_LABEL + r"[\s\S]{0,60}?" + _WORD_START + _TYPE_WORDS + _WORD_END,
            op="enterprise_type", confidence=0.98,
        ),
        Rule(
            "enterprise_type",
            _WORD_START + _TYPE_WORDS + _WORD_END
            + r"[\s\S]{0,50}?(?:Type\s*of\s*Enterprise|Enterprise\s*Type|उद्यमाचा\s*प्रकार)",
            op="enterprise_type", confidence=0.98,
        ),
        Rule("enterprise_type", _WORD_START + _TYPE_WORDS + _WORD_END, op="enterprise_type", confidence=0.98),
        Rule("major_activity", _ACT_LABEL + r"[\s:]*([^\r\n:]{1,40})", op="activity"),
        Rule("major_activity", _WORD_START + _ACT_WORDS + _WORD_END + r"[\s\S]{0,60}?" + _ACT_LABEL, op="activity"),
        Rule("major_activity", _ACT_LABEL + r"[\s\S]{0,100}?" + _WORD_START + _ACT_WORDS + _WORD_END, op="activity"),
    ],
    "fssai": [
        Rule("fssai_licence_number", r"\b(\d{14})\b", flags=""),
        Rule(
            "business_name",
            r"(?:Business\s*Name|Business\s*Operator\s*(?:\(FBO\))?|Name of Food Business Operator)[\s:]+([A-Za-z0-9][A-Za-z0-9 \t,\.\-&]{1,60}?)"
            + END.format(r"FSSAI|Licence|License|Kind of Business|Valid|Period|Address|SR\s*NO"),
        ),
        Rule(
            "kind_of_business",
            r"(?:Kind of Business)[\s:]*([A-Za-z0-9][A-Za-z0-9 \t,\.\-&]{1,50}?)"
            + END.format("Valid|Licence|License|Business Name"),
            confidence=None,
        ),
        Rule("valid_from", rf"(?:Valid\s*From|Issued\s*On)[\s:/]+({DATE})", confidence=None),
        Rule("valid_till", rf"(?:Valid\s*Till|Fee\s*Paid\s*Upto)[\s:/]+.*?({DATE})", confidence=None),
    ],
    "shop_establishment": [
        Rule(
            "establishment_name",
            r"(?:Name\s*of\s*(?:the\s*)?establishment|आ\s*थापनेचे\s*नाव|आस्थापनेचे\s*नाव|दुकानाचे\s*नाव|(?<!&\s)(?<!and\s)(?<!of\s)\bEstablishment\b)[\s:/]+([^\r\n:]{2,70}?)"
            + END_DEV.format(r"Registration|Reg|Employer|नोंदणी|मालक|Nature\s*of\s*Business|व्यवसाय|Address|पत्ता|Previous"),
            op="establishment",
        ),
        Rule(
            "employer_name",
            r"(?:Name\s*of\s*(?:the\s*)?Employer(?:[\s/]*(?:मालकाचे\s*नाव)?)?|मालकाचे\s*नाव|Employer)[\s:]*([^\r\n:]{2,50}?)"
            r"(?=[ \t]{2,}|\r?\n|$|(?:\b|(?<=[a-z0-9A-Z\u0900-\u097F]))(?:Registration|Reg|Establishment|नोंदणी|आस्थापना|Nature\s*of\s*Business|व्यवसाय|Residential|Address|पत्ता)\b)",
            op="employer",
        ),
        Rule(
            "nature_of_business",
            r"(?:व्यवसायाचे\s*स्वरूप|Nature\s*of\s*Business|Category\s*Of\s*Establishment\s*Type(?:[\s/]*(?:आ\s*थापनेचे\s*उपवगवार)?)?)[\s:/]+([^\r\n:]{2,50}?)"
            + END_DEV.format(r"Registration|Reg|Employer|Date|तारीख|दिनांक|Type\s*of"),
        ),
    ],
    "bank_statement": [
        Rule(
            "_account", ACCOUNT_LABEL + r"[\s:]*([X\d]{6,18})", op="raw", drop=True,
            masked=("account_number_masked,account_number", "account"),
        ),
        Rule(
            "bank_name",
            r"(?:Statement\s+(?:of\s+)?|Account\s+Statement\s+(?:of\s+)?|Branch\s*Office\s*:|Bank\s*Name|Bank)[\s:]*("
            + _BANK_WORDS + r")\b|^[\s:]*(" + _BANK_WORDS + r")\b",
            groups=(1, 2), flags="im", op="bank_of_statement",
        ),
        Rule(
            "account_holder",
            r"(?:Account\s*Holder(?:\s*Name)?|Customer\s*Name|Name\s*of\s*(?:the\s*)?Account\s*Holder|खातेदाराचे\s*नाव|खाताधारक\s*का\s*नाम|Account\s*Name)[\s:]*([A-Za-z][A-Za-z\s.'-]{2,40}?)"
            + END_FREE.format(r"Account\s*No|A/C|Address|Joint|Customer\s*ID|CIF|Nominee|IFSC|Branch"),
            guard="statement_holder", copies=("account_holder_name",),
        ),
        Rule(
            "account_holder",
            r"(?:(?:Mr\.|Mrs\.|Ms\.|Shri|Smt\.)\s+([A-Za-z][A-Za-z\s.'-]{2,40}?))"
            + END_FREE.format("Account|A/C|Address|Branch|IFSC"),
            guard="statement_holder", copies=("account_holder_name",),
        ),
        Rule(
            "ifsc", r"(?:IFS\s*Code|IFSC(?:\s*Code)?|RTGS/NEFT/IFSC)[\s:]*([A-Z]{4}0[A-Z0-9]{6})|\b([A-Z]{4}0[A-Z0-9]{6})\b",
            groups=(1, 2), op="upper", copies=("ifsc_code",),
        ),
        Rule(
            "customer_number", r"(?:Customer\s*(?:No\.?|Number|ID)|Cust\s*ID|CIF\s*(?:No\.?|Number)?)[\s:]*([A-Za-z0-9]+)",
            copies=("customer_id",),
        ),
        Rule(
            "branch",
            r"(?:Branch\s*(?:Office|Name)?\s*[:\-]\s*)([A-Za-z0-9\s,\[\]\(\)\.\/-]+?)"
            r"(?=[ \t]*(?:\r?\n\r?\n|\r?\n[A-Z0-9\s]+:|$|Account|IFSC|MICR|Tel|Scheme|Opening|Joint|\bS\.NO\b))",
            op="squeeze", guard="branch", confidence=0.95, copies=("branch_name",),
        ),
        Rule(
            "branch",
            r"(?i:Branch\s*Name(?:\(SOL\))?)[\s\S]*?(?:CR|DR)\s+[\d,.]+\s*(?:\d+)?\s+([A-Z][A-Z\s,\n]+?)(?:\[|\n\d+\s+\d{2}[/\-\.]|\r?\n\r?\n|$)",
            flags="", op="squeeze", confidence=0.95, copies=("branch_name",),
        ),
        Rule(
            "branch", r"BRANCH\s+ADDRESS\s*[-:]\s*([^\n\r~]+(?:~[^\n\r]+)?)", op="tilde", confidence=0.95,
            copies=("branch_name",),
        ),
        Rule("opening_balance", r"Opening\s*Balance[\s:]+(?:Rs\.?|INR)?\s*(-?[\d,]+\.?\d*)", op="amount"),
        Rule(
            "closing_balance", r"(?<!Opening\s)\bClosing\s*Balance[\s:]+(?:Rs\.?|INR)?\s*(-?[\d,]+\.?\d*)", op="amount",
        ),
    ],
    "salary_slip": [
        Rule(
            "employer_name",
            r"(?:Company(?:\s*Name)?|Employer(?:\s*Name)?|कार्यालयाचे\s*नाव|संस्थेचे\s*नाव|विभागाचे\s*नाव|कंपनीचे\s*नाव|नियोक्त्याचे\s*नाव)[\s:：]+([A-Za-z0-9\u0900-\u097F][A-Za-z0-9\u0900-\u097F \t,\.\-&]{2,80}?(?:LIMITED|PRIVATE\s+LIMITED|PVT\.?\s*LTD\.?|LTD\.?|CORP|INC|DEMO|मर्यादित)?)"
            + END_FREE.format(r"(?:Employee|Name|Emp\s*ID|Month|Net|Basic|HRA|कर्मचाऱ्याचे|कर्मचारी|माहे|निव्वळ)[\s:：]"),
            source="digits", guard="employer",
        ),
        Rule(
            "employer_name",
            r"^[ \t]*([A-Za-z0-9\u0900-\u097F][A-Za-z0-9\u0900-\u097F \t,\.\-&]{2,80}(?:LIMITED|PRIVATE\s+LIMITED|PVT\.?\s*LTD\.?|LTD\.?|CORPORATION|SERVICES|ENTERPRISES|TECHNOLOGIES|COMPANY|महाराष्ट्र\s*शासन|जिल्हा\s*परिषद|महानगरपालिका|नगरपरिषद|महामंडळ|मर्यादित))",
            flags="im", source="digits",
        ),
        Rule(
            "employer_name",
            r"^[ \t]*((?:महाराष्ट्र\s*शासन|जिल्हा\s*परिषद|महानगरपालिका|नगरपरिषद|राज्य\s*परिवहन\s*महामंडळ)[^\r\n]{0,60})",
            flags="m", source="digits",
        ),
        Rule(
            "raw_employee_name",
            r"(?:Employee(?:\s*Name)?|कर्मचाऱ्याचे\s*नाव|कर्मचारी\s*नाव|कर्मचारी\s*का\s*नाम|अधिकाऱ्याचे\s*नाव|सेवकाचे\s*नाव|(?<!Employer\s)(?<!Company\s)(?<!कार्यालयाचे\s)(?<!संस्थेचे\s)\bName)[\s:：]*([A-Za-z\u0900-\u097F][A-Za-z\u0900-\u097F \t.'-]{1,40}?)"
            + END_FREE.format(
                r"(?:ID|Emp\s*ID|Designation|Department|Net|Gross|Month|Pay\s*Period|पदनाम|पद|विभाग|वेतन|माहे|रक्कम|भविष्य\s*निर्वाह)[\s:：]"
            ),
            source="digits", copies=("employee_name",), masked=("employee_name_masked", "person"),
        ),
        Rule("gross_salary", r"(?:Gross\s*Salary|Gross\s*Pay|Gross\s*Earnings|एकूण\s*वेतन|एकूण\s*रक्कम|सकल\s*वेतन)" + _RUPEES, source="digits", op="amount"),
        Rule("total_deductions", r"(?:Total\s*Deductions?|Deductions?|एकूण\s*कपाती|एकूण\s*कपात|कुल\s*कटौती)" + _RUPEES, source="digits", op="amount"),
        Rule(
            "net_pay",
            r"(?:Net\s*Salary|Net\s*Pay|Net\s*Amount|निव्वळ\s*वेतन|निव्वळ\s*देय\s*(?:रक्कम)?|निव्वळ\s*रक्कम|हाती\s*येणारे\s*वेतन|शुद्ध\s*वेतन|कुल\s*शुद्ध\s*देय)" + _RUPEES,
            source="digits", op="amount",
        ),
        Rule(
            "pay_period",
            r"(?:Month|Pay\s*Period|वेतन\s*महिना|माहे(?:\s*महिना)?|माहे|कालावधी)[\s:：]+([A-Za-z\u0900-\u097F]+\s*\d{4}|\d{1,2}[\/\-]\d{4})",
            source="digits",
        ),
    ],
    "utility_bill": [
        Rule(
            "utility_provider",
            r"(?:Provider|Company|Board|प्रदाता)[\s]*[:：][\s]*([A-Za-z0-9\u0900-\u097F][A-Za-z0-9\u0900-\u097F \t,\.\-&]{1,50}?)"
            + END_DEV.format(r"Consumer|Bill|Due|Date|Amount|CA\s*No|Connection|ग्राहक|देयक|देय|रक्कम"),
            source="digits", confidence=None,
        ),
        Rule(
            "consumer_number",
            r"(?:ग्राहक\s*(?:क्रमांक|क्र\.?|नंबर|सं\.?)|साहक\s*(?:क्रमांक|कमांक|कमक|कमिक)|उपभोक्ता\s*(?:संख्या|क्रमांक|क्र\.?)|खाता\s*(?:संख्या|क्रमांक)|Consumer\s*(?:No\.?|Number|ID)|CA\s*No\.?|Account\s*No\.?|Connection\s*ID|K\s*No\.?)[\s:：]*([A-Za-z0-9\-]{6,25})",
            source="digits",
        ),
        Rule("consumer_number", r"Beneficiary\s*account\s*no\.?[\s:：]*([A-Za-z0-9]{8,25})", source="digits"),
        Rule(
            "bill_date",
            rf"(?:Bill\s*Date|Date\s*of\s*Bill|Billing\s*Date|Invoice\s*Date|देयक\s*(?:दिनांक|तारीख|तिथि|दि\.?)|बिल\s*(?:दिनांक|तारीख|तिथि)|बिलाचा\s*दिनांक)[\s:：]+({DATE})",
            source="digits", op="date",
        ),
        Rule(
            "due_date",
            rf"(?:Due\s*Date|Payment\s*Due\s*Date|Pay\s*By\s*Date|देय\s*(?:दिनांक|तारीख|तिथि)|अंतिम\s*(?:दिनांक|तारीख|तिथि)|आत[मम]\s*(?:तारीख|तारीस|दिनांक))[\s:：]+({DATE})",
            source="digits", op="date",
        ),
        Rule(
            "due_date", rf"(?:या\s*तारखेपर्यंत\s*भरल्यास|यातारखेपय[ंंत]+[^\n\r]*भरल[याा]स)[\s:：]+({DATE})", source="digits", op="date",
        ),
        Rule(
            "bill_amount",
            r"(?:Total\s*Amount|Amount\s*Due|Bill\s*Amount|Net\s*Amount(?:\s*Payable)?|Total\s*Due|देयक\s*रक्कम|एकूण\s*रक्कम|एकूण\s*देयक|निव्वळ\s*(?:देयक\s*)?रक्कम|देय\s*रक्कम|भरणा\s*रक्कम|बिल\s*रक्कम|कुल\s*(?:देय\s*)?राशि)[\s:：]+(?:Rs\.?|INR|₹|रु\.?|रुपये)?\s*([\d,]+\.?\d*)",
            source="digits", op="amount_dot",
        ),
        Rule(
            "bill_amount",
            r"(?:यातारखेपय[ंंत]+[^\n\r]*भरल[याा]स|या\s*तारखेपर्यंत\s*भरल्यास|आत[मम]\s*(?:तारीख|तारीस)|अंतिम\s*(?:तारीख|दिनांक)|देय\s*दिनांक)[\s\S]{1,80}?(?:Rs\.?|INR|₹|रु\.?|रुपये)\s*([\d,]+\.?\d*)",
            source="digits", op="amount_dot",
        ),
    ],
    "passport": [
        Rule("passport_number", r"\b([A-PR-WYa-pr-wy][0-9]{7}|[A-Z][0-9]{7})\b", flags="", op="upper"),
        Rule(
            "surname", r"(?:Surname)[\s:]*([A-Za-z][A-Za-z \t.'-]{1,30}?)" + END.format(r"Given|Given\s*Name|Nationality|Passport|DOB|Date"),
        ),
        Rule(
            "given_name", r"(?:Given\s*Name)[\s:]*([A-Za-z][A-Za-z \t.'-]{1,30}?)" + END.format("Surname|Nationality|Passport|DOB|Date"),
        ),
        Rule("nationality", r"(?:Nationality)[\s:]+([A-Za-z]+)", confidence=None),
        Rule("dob", rf"(?:Date of Birth|DOB)[\s:]+({DATE})", op="date"),
        Rule("expiry_date", rf"(?:Date of Expiry|Expiry\s*Date)[\s:]+({DATE})", op="date", confidence=None),
    ],
    "voter_id": [
        Rule("epic_number", r"\b([A-Z]{3}[0-9]{7})\b", flags=""),
        Rule(
            "name", r"(?:Name|Elector['’]?s?\s*Name)[\s:]*([A-Za-z][A-Za-z \t.'-]{1,35}?)"
            + END.format("Father|Husband|Relative|DOB|Date|Age|Gender|EPIC"),
        ),
        Rule(
            "relative_name",
            r"(?:Father['’]?s?\s*Name|Husband['’]?s?\s*Name|Relative['’]?s?\s*Name)[\s:]*([A-Za-z][A-Za-z \t.'-]{1,35}?)"
            + END.format("DOB|Date|Age|Gender|EPIC|Address"),
            confidence=None,
        ),
        Rule("dob", rf"(?:DOB|Date of Birth)[\s:]+({DATE})", op="date", confidence=None),
        Rule("age", r"(?:Age)[\s:]+(\d{1,2})", op="integer", guard="no_dob", confidence=None),
        Rule("gender", r"\b(MALE|FEMALE)\b", op="gender", confidence=None),
    ],
    "driving_licence": [
        Rule("licence_number", r"\b([A-Z]{2}[0-9]{2}\s?[0-9]{4}[0-9]{7}|[A-Z]{2}[0-9]{2}\s?[0-9A-Z]{11,15})\b", flags=""),
        Rule("name", r"(?:Name)[\s:]*([A-Za-z][A-Za-z \t.'-]{1,35}?)" + END.format("DOB|Date|Licence|License|Issue|Valid|Vehicle")),
        Rule("dob", rf"(?:DOB|Date of Birth)[\s:]+({DATE})", op="date"),
        Rule("issue_date", rf"(?:Issue Date|Date of Issue)[\s:]+({DATE})", op="date", confidence=None),
        Rule("valid_till", rf"(?:Valid Till|Validity)[\s:]+({DATE})", op="date", confidence=None),
        Rule("vehicle_class", r"\b(LMV|MCWG|MCWOG|TRANS|HGMV|HPMV)\b", flags="", confidence=None),
    ],
    "itr": [
        Rule("acknowledgement_number", r"(?:Acknowledgement\s*Number|Ack\s*No\.?)[\s:]*(\d{15})"),
        Rule("assessment_year", r"(?:Assessment\s*Year|AY)[\s:]*(\d{4}[-\/]\d{2,4})", confidence=None),
        Rule("pan_number", r"\b([A-Z]{5}[0-9]{4}[A-Z])\b", flags=""),
        Rule(
            "name",
            r"(?:Name\s*of\s*Assessee|Assessee\s*Name)[\s:]*([A-Za-z0-9][A-Za-z0-9 \t.,'\-&_]{1,60}?)"
            + END.format(r"PAN|Address|Status|Ward|Assessment|Financial|D\.O\.I|DOI|Return|Date"),
            guard="itr_name",
        ),
        Rule(
            "name",
            r"(?:Assessment\s*Year[^\n]*\n\s*Of|\bReturn\b[^\n]*\n[^\n]*\bOf)[\s:\r\n]+([A-Za-z0-9][A-Za-z0-9 \t.,'\-&_]{1,60}?)"
            + END.format("PAN|Address|Prepared"),
            guard="itr_name",
        ),
        Rule("name", _ITR_NAME, guard="itr_name"),
        Rule(
            "name",
            r"^[ \t]*Name\s*[:\-]?[ \t]*\n\s*(?!(?:PAN|Address|Status|Form|Acknowledgement|Ack|Date|Father|Total|Taxes)\b)([^\n]+)",
            flags="im", guard="itr_name",
        ),
        Rule("total_income", r"(?:Total\s*Income(?:[^\n\d]*?round[^\n]*)?)" + _ITR_AMOUNT, op="amount"),
        Rule("taxes_paid", r"(?:Taxes\s*Paid|Total\s*Tax(?:es)?\s*Paid)" + _ITR_AMOUNT, op="amount", confidence=None),
    ],
    "gst_certificate": [
        Rule("gstin", r"\b([0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][1-9A-Z]Z[0-9A-Z])\b", flags="", op="upper"),
        Rule(
            "gstin", r"([0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][1-9A-Z]Z[0-9A-Z])", flags="", source="unspaced", op="upper",
            confidence=0.90,
        ),
        Rule(
            "legal_name",
            r"(?:Legal\s*Name(?:[\s/]*(?:of\s+Taxpayer)?)?)[\s:]*([A-Za-z0-9][A-Za-z0-9 \t,\.\-&_]{1,70}?)"
            + END.format(r"Trade\s*Name|GSTIN|Constitution|Date|Address|Period"),
        ),
        Rule(
            "trade_name",
            r"(?<!Additional\s)(?<!Additional\s\s)\bTrade\s*Name(?:\s*,\s*if\s*any)?[\s:]+([A-Za-z0-9][A-Za-z0-9 \t,\.\-&]{1,70}?)"
            + END.format(r"Constitution|Legal\s*Name|GSTIN|Date|Address|Period|Additional"),
            guard="trade_name",
        ),
        Rule(
            "trade_name",
            r"(?<!Additional\s)(?<!Additional\s\s)\bTrade\s*Name(?:\s*,\s*if\s*any)?\s*[:\-]?[^\n]*\n\s*(?!(?:\d+[\.\)]\s*)?(?:Additional|Constitution|Legal\s*Name|GSTIN|Date|Address|Period)\b)([^\n]+)",
            guard="trade_name",
        ),
        Rule(
            "registration_date",
            rf"(?:Date\s*of\s*(?:liability|Registration|Validity|issue\s*of\s*Certificate)|From)[\s:]+({DATE})",
        ),
        Rule(
            "constitution_of_business",
            r"(?:Constitution\s*of\s*Business)[\s:]*([A-Za-z][A-Za-z \t,\.\-&]{1,50}?)" + END.format("Type|Date|Address|Particulars|Period"),
        ),
        Rule(
            "principal_place_of_business",
            r"(?:Address\s*of\s*Principal\s*Place\s*of\s*Business)[\s:]*([\s\S]{10,600}?)(?=[ \t]*(?:\r?\n|$|(?:\b|(?<=[a-z0-9A-Z])))(?:(?:6\.|Date\s*of\s*Liability|Period\s*of\s*Validity|Type\s*of\s*Registration)\b))",
            op="address_lines",
        ),
    ],
    "certificate_of_incorporation": [
        Rule("cin", r"\b([UL][0-9]{5}[A-Z]{2}[0-9]{4}[A-Z]{3}[0-9]{6})\b", flags="", op="upper"),
        Rule(
            "company_name",
            r"(?:hereby\s*certifies\s*that\s+|Name\s*of\s*the\s*Company[\s:]*)([A-Za-z0-9][A-Za-z0-9 \t,\.\-&]{2,80}?)"
            + END.format(r"is\s+incorporated|under\s+the|CIN|Corporate|Date|Given\s+under"),
        ),
        Rule(
            "date_of_incorporation",
            rf"(?:incorporated\s*(?:under\s*the\s*Companies\s*Act.*?)?on\s*this|Date\s*of\s*Incorporation[\s:]*|dated\s*this\s+)\s*([A-Za-z0-9 \t]{{3,50}}?\b\d{{4}}|{DATE})",
        ),
        Rule(
            "registrar_office",
            r"(?:Registrar\s*of\s*Companies|ROC)[\s,:-]*([A-Za-z][A-Za-z \t,\.\-]{2,40}?)"
            + END.format(r"Ministry|Government|Companies\s*Act|CIN|Corporate"),
        ),
    ],
    "partnership_deed": [
        Rule(
            "firm_name",
            r"(?:name\s*(?:and|&)\s*style\s*of\s*[:\s]*|firm\s*name[\s:]*|M/S[\s\.]*)([A-Za-z0-9][A-Za-z0-9 \t,\.\-&]{2,60}?)"
            + END.format(r"hereinafter|having|place\s+of\s+business|partners|date|ratio"),
        ),
        Rule(
            "date_of_deed",
            rf"(?:executed\s*on\s*(?:this)?|dated\s*(?:this)?|date\s*of\s*(?:deed|execution)[\s:]*)(\d{{1,2}}(?:st|nd|rd|th)?\s+(?:day\s+of\s+)?[A-Za-z]+\s+\d{{4}}|{DATE})",
        ),
        Rule(
            "profit_sharing_ratio",
            r"(?:Profit\s*(?:and|&)\s*Loss\s*(?:sharing)?\s*ratio|profit\s*sharing\s*ratio)[\s:]*([A-Za-z0-9][A-Za-z0-9 \t%:,\.\-/]{1,50}?)"
            + END.format(r"The\s+parties|Capital|Bank|Accounts|Duration"),
        ),
    ],
    "rent_agreement": [
        Rule(
            "raw_lessor_name",
            r"(?:परवाना\s*देणारा|पट्टा\s*देणारा|घरमालक|LESSOR|LANDLORD|FIRST\s*PARTY)[\s,:-]*([^\r\n:]{2,40}?)"
            + END_DEV.format(
                r"hereinafter|son\s+of|daughter\s+of|wife\s+of|residing|and|lessee|tenant|second\s+party|परवाना\s*घेणारा|पट्टा\s*घेणारा|भाडेकरू"
            ),
            masked=("lessor_name_masked", "person"),
        ),
        Rule(
            "raw_lessee_name",
            r"(?:परवाना\s*घेणारा|पट्टा\s*घेणारा|भाडेकरू|LESSEE|TENANT|SECOND\s*PARTY)[\s,:-]*([^\r\n:]{2,40}?)"
            + END_DEV.format(
                r"hereinafter|son\s+of|daughter\s+of|wife\s+of|residing|and|lessor|premises|rent|परवाना\s*देणारा|भाडे"
            ),
            masked=("lessee_name_masked", "person"),
        ),
        Rule(
            "raw_property_address",
            r"(?:Premises\s*(?:situated\s*at|at)|Demised\s*Premises|Property\s*Address)[\s:]*([A-Za-z0-9][A-Za-z0-9 \t,\.\-\/]{5,100}?)"
            + END.format(r"Monthly\s*Rent|Rent|Period|Term|Security\s*Deposit"),
            masked=("property_address_masked", "address"),
        ),
        Rule("monthly_rent", r"(?:मासिक\s*भाडे|Monthly\s*Rent|Rent\s*per\s*month)[\s:]*(?:Rs\.?|INR|रु\.?)?\s*([0-9,]+(?:\.[0-9]{2})?)", op="amount"),
        Rule(
            "agreement_start_date",
            rf"(?:commencing\s*(?:from|on)?|lease\s*period\s*from|start\s*date)[\s:]*({DATE}|\d{{1,2}}(?:st|nd|rd|th)?\s+[A-Za-z]+\s+\d{{4}})",
        ),
        Rule(
            "agreement_end_date",
            rf"(?:expiring\s*(?:on)?|ending\s*(?:on)?|lease\s*period\s*to|valid\s*(?:till|to)|end\s*date)[\s:]*({DATE}|\d{{1,2}}(?:st|nd|rd|th)?\s+[A-Za-z]+\s+\d{{4}})",
        ),
    ],
    "form_16": [
        Rule("pan_number", r"(?:PAN\s*(?:of\s*(?:the\s*)?Employee)?|Employee\s*PAN)[\s:]*([A-Z]{5}[0-9]{4}[A-Z])", op="upper"),
        Rule("tan_number", r"(?:TAN\s*(?:of\s*(?:the\s*)?Deductor|Employer)?|Deductor\s*TAN)[\s:]*([A-Z]{4}[0-9]{5}[A-Z])", op="upper"),
        Rule(
            "employer_name",
            r"(?:Name\s*and\s*address\s*of\s*the\s*Employer|Name\s*of\s*(?:the\s*)?(?:Employer|Deductor))[\s:]*([A-Za-z0-9][A-Za-z0-9 \t,\.\-&]{2,60}?)"
            + END.format("PAN|TAN|Employee|Address|Assessment|Period"),
        ),
        Rule(
            "raw_employee_name",
            r"(?:Name\s*of\s*(?:the\s*)?Employee)[\s:]*([A-Za-z][A-Za-z \t.'-]{2,40}?)" + END.format("PAN|Designation|Address|Assessment|Period"),
            masked=("employee_name_masked", "person"),
        ),
        Rule("assessment_year", r"(?:Assessment\s*Year|AY)[\s:]*([0-9]{4}\s*-\s*(?:[0-9]{4}|[0-9]{2}))", op="compact"),
        Rule("gross_salary", r"(?:Gross\s*Salary|Total\s*Salary|Gross\s*Total\s*Income)[\s:]*(?:Rs\.?|INR)?\s*([0-9,]+(?:\.[0-9]{2})?)", op="amount"),
        Rule(
            "tax_deducted",
            r"(?:Total\s*Tax\s*Deducted|Tax\s*Deducted\s*at\s*Source|TDS\s*Deducted)[\s:]*(?:Rs\.?|INR)?\s*([0-9,]+(?:\.[0-9]{2})?)",
            op="amount",
        ),
    ],
    "bank_passbook": [
        Rule(
            "bank_name",
            r"(?:(?:^|\r?\n)\s*([A-Za-z0-9\u0900-\u097F \t]{3,50}?(?:\bBANK(?:\s+OF\s+[A-Za-z \t]+)?|सहकारी\s*बँक|ग्रामीण\s*बँक|नागरी\s*सहकारी\s*बँक|विकास\s*बँक|को(?:-|ऑ)परेटीव्ह\s*बँक|बँक\s*मर्यादित|बैंक\s*लिमिटेड))|Bank\s*Name[\s:：]*([A-Za-z][A-Za-z \t,\.\-&]{2,40}?)|(?:बँकेचे\s*नाव|बैंक\s*का\s*नाम|बँक|बैंक)[\s:：]+([A-Za-z0-9\u0900-\u097F][A-Za-z0-9\u0900-\u097F \t,\.\-&]{2,60}?))"
            + END_FREE.format(r"(?:Branch|IFSC|A/C|Account|शाखा|आयएफएससी|खाते|खाता)"),
            groups=(1, 2, 3), source="digits", op="passbook_bank",
        ),
        Rule(
            "bank_name",
            r"^[ \t]*([A-Za-z0-9\u0900-\u097F][A-Za-z0-9\u0900-\u097F \t,\.\-&]{2,60}?(?:बँक|सहकारी\s*बँक|ग्रामीण\s*बँक|BANK))(?=[ \t]*(?:\r?\n|$))",
            flags="im", source="digits", op="passbook_bank",
        ),
        Rule(
            "branch",
            r"(?:Branch\s*(?:Name)?|Branch\s*Code|शाखेचे\s*नाव|शाखा\s*कोड|शाखा)[\s:：]*([A-Za-z0-9\u0900-\u097F][A-Za-z0-9\u0900-\u097F \t,\.\-&]{2,40}?)"
            + END_FREE.format(r"(?:IFSC|Account|A/C|MICR|CIF|Customer|आयएफएससी|खाते|खाता|ग्राहक|सीआयएफ)"),
            source="digits",
        ),
        Rule("ifsc", r"\b([A-Z]{4}0[A-Z0-9]{6})\b", source="digits", op="upper"),
        Rule(
            "raw_account_number",
            r"(?:Account\s*(?:No|Number)|A/C\s*(?:No|Number)?|बचत\s*खाते\s*(?:क्रमांक|क्र|नं)?|खाते\s*(?:क्रमांक|क्र\.?|नं\.?)|खाता\s*(?:संख्या|क्रमांक|क्र\.?|नं\.?))[\s:：]*([0-9]{9,18})",
            source="digits", masked=("account_number_masked", "account"),
        ),
        Rule(
            "raw_account_holder_name",
            r"(?:Account\s*Holder(?:\s*Name)?|Name\s*of\s*Account\s*Holder|Customer\s*Name|खातेदाराचे\s*नाव|खातेदार\s*नाव|ग्राहकाचे\s*नाव|खाताधारक\s*का\s*नाम|खाताधारी\s*का\s*नाम|(?<!Branch\s)(?<!Bank\s)(?<!शाखेचे\s)(?<!बँकेचे\s)(?<!शाखा\s)(?<!बँक\s)\bName)[\s:：]*([A-Za-z\u0900-\u097F][A-Za-z\u0900-\u097F \t.'-]{2,40}?)"
            + END_FREE.format(r"(?:Account|A/C|IFSC|CIF|Customer|Branch|खाते|खाता|आयएफएससी|सीआयएफ|शाखा)"),
            source="digits", masked=("account_holder_name_masked", "person"),
        ),
    ],
    "property_tax_receipt": [
        Rule(
            "property_id",
            r"(?:मालमत्ता\s*(?:क्रमांक|क्र\.?)|इंडेक्स\s*(?:क्रमांक|क्र\.?)|Property\s*(?:ID|No|Number)|Assessment\s*No|Index\s*No|Tax\s*Bill\s*No)[\s:]*([A-Za-z0-9\-\/\u0966-\u096F]{4,25})",
            op="digits",
        ),
        Rule(
            "raw_owner_name",
            r"(?:मालकाचे\s*नाव|करदात्याचे\s*नाव|भोगवटादाराचे\s*नाव|Owner\s*Name|Name\s*of\s*(?:the\s*)?Owner|Tax\s*Payer\s*Name)[\s:]*([^\r\n:]{2,40}?)"
            + END_DEV.format("Property|Ward|Zone|Address|Assessment|Tax|Amount|मालमत्ता|प्रभाग|कर|रक्कम"),
            masked=("owner_name_masked", "person"),
        ),
        Rule(
            "tax_amount_paid",
            r"(?:भरलेली\s*रक्कम|एकूण\s*रक्कम|Tax\s*Amount\s*Paid|Total\s*Amount\s*Paid|Amount\s*Paid)[\s:]*(?:Rs\.?|INR|रु\.?)?\s*([0-9,]+(?:\.[0-9]{2})?)",
            op="amount",
        ),
        Rule("payment_date", rf"(?:पावती\s*(?:दिनांक|तारीख)|दिनांक|Payment\s*Date|Receipt\s*Date|Date\s*of\s*Payment)[\s:]*({DATE})"),
        Rule(
            "assessment_year",
            r"(?:कर\s*आकारणी\s*वर्ष|आकारणी\s*वर्ष|Assessment\s*Year|AY)[\s:]*([0-9]{4}\s*-\s*(?:[0-9]{4}|[0-9]{2}))", op="compact",
        ),
    ],
    "iec_certificate": [
        Rule("iec_number", r"(?:IEC\s*(?:Number|No)?|Import\s*Export\s*Code)[\s:]*([A-Z0-9]{10})", op="upper"),
        Rule(
            "entity_name",
            r"(?:Name\s*of\s*(?:the\s*)?(?:Firm|Entity|Company)|Entity\s*Name)[\s:]*([A-Za-z0-9][A-Za-z0-9 \t,\.\-&]{2,60}?)"
            + END.format("IEC|PAN|Date|Address|Branch|Director"),
        ),
        Rule("issue_date", rf"(?:Date\s*of\s*Issue|Issue\s*Date)[\s:]*({DATE})"),
        Rule("pan_number", r"(?:PAN|Permanent\s*Account\s*Number)[\s:]*([A-Z]{5}[0-9]{4}[A-Z])", op="upper"),
    ],
    "employment_contract": [
        Rule("employee_name", r"employee\s*(?:name)?\s*[:\-]\s*([A-Za-z\s\.\,\'\-]+)", op="first_line"),
        Rule(
            "employee_name", r"between\s+(.*?)(?:\s+and\s+|\s*&\s+|and\s+|\s+to\s+)([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)", groups=(2,),
            op="first_line",
        ),
        Rule(
            "employer", r"between\s+(.*?)(?:\s+and\s+|\s*&\s+|and\s+|\s+to\s+)([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)",
            guard="no_employee_label", op="first_line",
        ),
        Rule(
            "salary", r"(?:salary|compensation|base salary|remuneration)\s*[:\.\-]?\s*([$₹€£]?[0-9\s\,\.]+(?:per annum|per month|usd|inr)?)",
            op="salary_line",
        ),
        Rule(
            "joining_date", r"(?:joining date|effective date|start date|commencement date)\s*[:\-]?\s*([A-Za-z0-9\s\,\.\-]+)",
            op="first_line",
        ),
        Rule("position", r"(?:position|role|designation)\s*[:\-]?\s*([A-Za-z0-9\s\.\-]+)", op="first_line"),
    ],
    "income_tax_notice": [
        Rule("assessment_year", r"assessment\s+year\s*[:\-]?\s*([0-9]{4}[\s\-–][0-9]{2,4})"),
        Rule("section", r"(?:section|u/s)\s*([0-9]{2,3}(?:\([0-9a-zA-Z]+\))?)"),
        Rule("din", r"\bDIN\s*[:\-]?\s*([A-Za-z0-9/\(\)\-]+)"),
    ],
    "commercial_invoice": [
        Rule("invoice_number", r"invoice\s*(?:no|number)?\s*[:\-]?\s*([A-Za-z0-9\-_]+)"),
        Rule("total_amount", r"(?:total|amount due|balance due)\s*[:\-]?\s*([$₹€£]?[0-9\s\,\.]+)"),
    ],
}

# Guards: a value matching the pattern (ignoring case) is refused.
REFUSE: dict[str, str] = {
    "pan_father": r"^(?:name|father|father's name)$|^(?:Purpose|DOB|Date|Name|Permanent|PAN|जन्म)\b",
    "pan_name": r"^(?:name|father)$|^(?:Father|DOB|Date|Permanent|PAN|Purpose|पिता|जन्म)\b",
    "uid_name": r"^(?:Aadhaar|DOB|Gender|Address|Date|Year|YOB|आधार|जन्म|लिंग|पत्ता)\b",
    "cheque_holder": r"^(?:Branch|IFSC|A/C|Account|Cheque|CANCELLED)\b",
    "statement_holder": r"\b(?:Statement|Account|Balance|Branch|Bank|Customer|Number)\b",
    "branch": r"^(?:Statement|Account|Balance|Customer|Period|Number|Name\(SOL\))$",
    "employer": r"^(?:LIMITED|PRIVATE|PVT|LTD|मर्यादित)\b",
}
ITR_LABELS = [
    "of deductor", "of employer", "of collector", "of buyer", "of seller",
    "of deductee", "of bank", "of premises", "of assessee", "of taxpayer",
    "deductor", "employer", "collector", "buyer", "seller", "deductee",
    "assessee", "taxpayer", "bank", "address", "status", "pan", "pan number",
    "acknowledgement", "acknowledgement number", "form", "form number",
    "total income", "taxes paid", "assessment year", "financial year",
]
ITR_PREFIXES = [
    "of ", "name of", "tan of", "pan of", "total amount", "sr no", "date of",
    "form no", "assessment year", "financial year", "details of", "part ",
]
TRADE_LABEL_WORDS = ["trade", "name", "names", "if", "any", "additional", "s"]
TRADE_BLANKS = ["na", "n a", "not applicable", "nil", "none", "null", "blank", "x", "xx", "xxx", "-"]
TRADE_PREFIXES = ["constitution", "legal name", "gstin", "date of", "registration", "type of", "address", "period"]

# Positional names on unlabelled cards.
STATUTORY_COMPACT = [
    "INCOMETAX", "TAXDEPARTMENT", "GOVTOFINDIA", "GOVERNMENTOFINDIA", "PERMANENTACCOUNT", "ACCOUNTNUMBER", "DEPARTMENT",
]
STATUTORY_WORDS = [
    "INCOME", "TAX", "DEPARTMENT", "GOVT", "INDIA", "PERMANENT", "ACCOUNT",
    "NUMBER", "CARD", "SIGNATURE", "FATHER", "FATHER'S", "NAME", "DOB",
    "DATE", "BIRTH", "आयकर", "विभाग", "भारत", "सरकार", "हस्ताक्षर", "नाम", "पिता",
    "FIELD", "VALUE", "TEST", "SAMPLE", "PURPOSE", "WORKFLOW", "TESTING", "DOCUMENT",
]
NOT_A_NAME = r"\b(?:DEPARTMENT|INDIA|INCOME|TAX|CARD|SIGNATURE|VALUE|TEST|SAMPLE|FIELD|PURPOSE)\b"

# PII: allow-listed output fields of the types that are restricted.
PII_ALLOWED: dict[str, list[str]] = {
    "bank_statement": [
        "bank_name", "account_number", "account_number_masked", "account_holder", "account_holder_name",
        "account_holder_masked", "account_holder_name_masked", "customer_number", "customer_id", "branch",
        "branch_name", "ifsc", "ifsc_code", "statement_period", "opening_balance", "closing_balance", "transactions",
    ],
    "salary_slip": ["employer_name", "employee_name_masked", "net_pay", "pay_period"],
    "utility_bill": ["utility_provider", "consumer_number", "bill_date", "due_date", "bill_amount"],
    "rent_agreement": [
        "lessor_name_masked", "lessee_name_masked", "property_address_masked", "monthly_rent",
        "agreement_start_date", "agreement_end_date",
    ],
    "form_16": [
        "employer_name", "employee_name_masked", "pan_number", "tan_number", "assessment_year", "gross_salary", "tax_deducted",
    ],
    "bank_passbook": ["bank_name", "branch", "ifsc", "account_number_masked", "account_holder_name_masked"],
    "property_tax_receipt": ["property_id", "owner_name_masked", "tax_amount_paid", "payment_date", "assessment_year"],
    "partnership_deed": ["firm_name", "partner_names_masked", "date_of_deed", "profit_sharing_ratio"],
}
LANGUAGE_FIELDS = [
    "detected_languages", "partial_language_coverage", "language_review_required", "language_coverage_notes",
]
CORE_FIELDS: dict[str, list[str]] = {
    "shop_establishment": ["registration_number", "establishment_name"],
    "udyam": ["udyam_registration_number", "enterprise_name"],
    "property_tax_receipt": ["property_id", "tax_amount_paid"],
    "rent_agreement": ["monthly_rent", "lessor_name_masked"],
    "aadhaar": ["aadhaar_number", "name"],
    "utility_bill": ["consumer_number", "bill_amount"],
    "salary_slip": ["employer_name", "net_pay"],
    "bank_passbook": ["account_number_masked", "bank_name"],
    "income_certificate": ["certificate_number", "applicant_name", "annual_income"],
}

#: Number groups that may stand on different lines; ``extra_rules={"aadhaar": [UID_ACROSS_LINES]}`` reads them first.
UID_ACROSS_LINES = Rule(
    "raw_aadhaar", r"\b(\d{4}\s\d{4}\s\d{4}|\d{12})\b", source="digits", flags="", op="compact",
    masked=("aadhaar_number,aadhaar_number_masked", "uid"),
)
