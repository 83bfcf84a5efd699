"""Document-type signature tables.

Patterns are matched against upper-cased text.  A type must show at least one
primary anchor; the wider signature list adds secondary evidence and is what a
claimed type is scored against.
"""

from __future__ import annotations

# Primary institutional anchors per type, in tie-break order.
PRIMARY_ANCHORS: dict[str, list[str]] = {
    "pan": [
        r"INCOME TAX DEPARTMENT|आयकर\s*विभाग",
        r"PERMANENT ACCOUNT NUMBER|स्थायी\s*लेखा\s*संख्या",
        r"GOVT\. OF INDIA.*INCOME TAX|INCOME TAX.*GOVT\. OF INDIA",
        r"GOVERNMENT OF INDIA.*INCOME TAX|INCOME TAX.*GOVERNMENT OF INDIA",
        r"\bALL INDIA TAXATION\b|\bINDIAN INCOME TAX\b",
    ],
    "aadhaar": [
        r"UNIQUE IDENTIFICATION AUTHORITY OF INDIA|UIDAI|भारतीय\s*विशिष्ट\s*(?:ओळख|पहचान)\s*प्राधिकरण",
        r"UNIQUE IDENTIFICATION.*GOVERNMENT OF INDIA|GOVERNMENT OF INDIA.*UNIQUE IDENTIFICATION",
        r"AADHAAR\s+CARD|AADHAR\s+CARD|आधार\s*कार्ड|माझे\s*आधार|मेरा\s*आधार|आमचा\s*आधार|आधार\s*क्रमांक",
        r"MERA AADHAAR|MERI PEHCHAN|मेरी पहचान|MERA AADHAR",
        r"HELP@UIDAI\.GOV\.IN|WWW\.UIDAI\.GOV\.IN|WWW\.EAADHAAR\.UIDAI\.GOV\.IN",
        r"\bXXXX\s+XXXX\s+[0-9]{4}\b|\b[2-9][0-9]{3}\s+[0-9]{4}\s+[0-9]{4}\b",
    ],
    "cancelled_cheque": [
        r"\bCANCELLED\b|C\s*A\s*N\s*C\s*E\s*L\s*L\s*E\s*D",
        r"PAY\s+(?:AGAINST\s+CHEQUE|TO\s+ORDER|TO\s+[A-Z]|THE\s+SUM|BEARER)",
        r"IFS\s*CODE|IFSC",
        r"A/C\s*(?:NO|NUM|NUMBER)[\.:]?\s*[0-9Xx]+",
    ],
    "passport": [
        r"REPUBLIC OF INDIA.*PASSPORT|PASSPORT.*REPUBLIC OF INDIA",
        r"PASSPORT\s*(?:NO|NUMBER)",
        r"\bPASSPORT\b",
    ],
    "voter_id": [
        r"ELECTION COMMISSION OF INDIA",
        r"ELECTOR PHOTO IDENTITY CARD",
        r"EPIC\s*(?:NO|NUMBER)",
        r"BHARAT NIRVACHAN AYOG",
    ],
    "driving_licence": [
        r"DRIVING LICEN[CS]E",
        r"TRANSPORT DEPARTMENT|MOTOR VEHICLES ACT|UNION OF INDIA.*DRIVING",
    ],
    "udyam": [
        r"UDYAM REGISTRATION|उद्यम\s*नोंदणी|उद्यम\s*पंजीकरण",
        r"UDYAM-[A-Z]{2}-[0-9]{2}-[0-9]+",
        r"MINISTRY OF MICRO.*SMALL AND MEDIUM|सूक्ष्म,\s*लघु\s*(?:व|आणि|एवं)\s*मध्यम\s*उद्योग",
    ],
    "fssai": [
        r"FOOD SAFETY AND STANDARDS AUTHORITY",
        r"\bFSSAI\b",
        r"LICENSE UNDER FSS ACT|REGISTRATION UNDER FSS ACT",
    ],
    "shop_establishment": [
        r"SHOP\s*&\s*ESTABLISHMENT|SHOPS\s*&\s*ESTABLISHMENTS|SHOPS?\s+AND\s+ESTABLISHMENTS?|दुकान\s*(?:आणि|व|एवं)\s*(?:आस्थापना|स्थापना)|दु\s*क\s*ाने\s*(?:आणि|व)\s*आ\s*(?:थापना|स्थापना)",
        r"MAHARASHTRA SHOPS AND COMMERCIAL|आस्थापना\s*नोंदणी|स्थापना\s*पंजीकरण|Form\s*[-–]\s*[\"'\u2018\u2019]?[फगFG][\"'\u2018\u2019]?",
    ],
    "bank_statement": [
        r"ACCOUNT STATEMENT|STATEMENT OF ACCOUNT|BANK STATEMENT|SAVINGS ACCOUNT STATEMENT|CURRENT ACCOUNT STATEMENT",
    ],
    "salary_slip": [
        r"SALARY SLIP|PAYSLIP|PAY SLIP|वेतन\s*पावती|वेतन\s*प्रमाणपत्र|मासिक\s*वेतन\s*पावती|वेतन\s*पर्ची",
    ],
    "utility_bill": [
        r"ELECTRICITY BILL|WATER BILL|GAS BILL|ENERGY BILL|BILL OF SUPPLY|POWER DISTRIBUTION|MSEDCL|MAHADISCOM|महावितरण|महािवतरण|वीज\s*देयक|विद्युत\s*देयक|पाणी\s*पट्टी|गॅस\s*बिल",
    ],
    "itr": [
        r"INDIAN INCOME TAX RETURN",
        r"ITR-V|ITR-1|ITR-2|ITR-3|ITR-4",
        r"ITR ACKNOWLEDGEMENT|INCOME TAX RETURN ACKNOWLEDGEMENT",
    ],
    "gst_certificate": [
        r"FORM GST REG-06|FORM GST REG-02|FORM GST REG",
        r"REGISTRATION CERTIFICATE.*GST|GST.*REGISTRATION CERTIFICATE",
        r"GOODS AND SERVICES TAX",
    ],
    "certificate_of_incorporation": [
        r"CERTIFICATE OF INCORPORATION",
        r"REGISTRAR OF COMPANIES",
        r"MINISTRY OF CORPORATE AFFAIRS",
    ],
    "partnership_deed": [
        r"PARTNERSHIP DEED|DEED OF PARTNERSHIP",
        r"INDIAN PARTNERSHIP ACT",
    ],
    "rent_agreement": [
        r"RENT AGREEMENT|LEASE AGREEMENT|LEAVE AND LICENSE AGREEMENT|TENANCY AGREEMENT|भाडेकरार|भाडे\s*करार|परवाना\s*करार",
    ],
    "form_16": [
        r"FORM NO\.?\s*16\b",
        r"CERTIFICATE UNDER SECTION 203",
    ],
    "bank_passbook": [
        r"PASS\s*BOOK|PASSBOOK|पास\s*बुक|पासबुक|बचत\s*खाते\s*पासबुक",
    ],
    "property_tax_receipt": [
        r"PROPERTY TAX RECEIPT|PROPERTY TAX PAYMENT|मालमत्ता\s*कर|घरपट्टी",
        r"MUNICIPAL CORPORATION.*PROPERTY TAX|PROPERTY TAX.*MUNICIPAL CORPORATION",
    ],
    "iec_certificate": [
        r"IMPORT EXPORT CODE|IMPORTER EXPORTER CODE",
        r"DIRECTORATE GENERAL OF FOREIGN TRADE|DGFT",
        r"IEC CERTIFICATE|IEC ISSUANCE",
    ],
    "income_certificate": [
        r"INCOME CERTIFICATE|CERTIFICATE OF INCOME|उत्पन्नाचा\s*दाखला|उत्पन्नाचे\s*प्रमाणपत्र|उलपञाचे\s*पमाणपऋ|उतनाचा\s*दाखला|वार्षिक\s*उत्पन्नाचा\s*दाखला|उत्पन्न\s*दाखला|उत्पन्न\s*प्रमाणपत्र",
    ],
    "employment_contract": [
        r"EMPLOYMENT AGREEMENT|EMPLOYMENT CONTRACT|CONTRACT OF EMPLOYMENT",
        r"OFFER OF EMPLOYMENT|TERMS OF EMPLOYMENT|APPOINTMENT LETTER",
    ],
    "income_tax_notice": [
        r"NOTICE UNDER SECTION\s*(?:143|142|148|156)|INTIMATION UNDER SECTION\s*(?:143|142|148)",
        r"INCOME TAX DEPARTMENT.*NOTICE|NOTICE.*INCOME TAX DEPARTMENT",
        r"DEMAND NOTICE|TAX DEMAND",
    ],
    "commercial_invoice": [
        r"TAX INVOICE|COMMERCIAL INVOICE",
    ],
}

# The wider signature list per type.
SIGNATURES: dict[str, list[str]] = {
    "pan": [
        r"INCOME TAX DEPARTMENT",
        r"PERMANENT ACCOUNT NUMBER",
        r"GOVT\. OF INDIA.*INCOME TAX|INCOME TAX.*GOVT\. OF INDIA",
        r"GOVERNMENT OF INDIA.*INCOME TAX|INCOME TAX.*GOVERNMENT OF INDIA",
        r"\bALL INDIA TAXATION\b|\bINDIAN INCOME TAX\b",
        r"\b[A-Z]{5}[0-9]{4}[A-Z]\b",
    ],
    "aadhaar": [
        r"UNIQUE IDENTIFICATION AUTHORITY OF INDIA|UIDAI",
        r"UNIQUE IDENTIFICATION.*GOVERNMENT OF INDIA|GOVERNMENT OF INDIA.*UNIQUE IDENTIFICATION",
        r"AADHAAR\s+CARD|AADHAR\s+CARD|आधार\s*कार्ड",
        r"MERA AADHAAR|MERA AADHAR|मेरा\s*आधार|माझे\s*आधार",
        r"GOVERNMENT OF INDIA.*AADHAAR|GOVT OF INDIA.*AADHAAR|भारतीय\s*विशिष्ट\s*(?:ओळख|पहचान)\s*प्राधिकरण",
        r"\bXXXX\s+XXXX\s+[0-9]{4}\b|\b[2-9][0-9]{3}\s+[0-9]{4}\s+[0-9]{4}\b",
    ],
    "cancelled_cheque": [
        r"CANCELLED",
        r"PAY\s+(?:AGAINST\s+CHEQUE|TO\s+ORDER|TO\s+[A-Z]|THE\s+SUM|BEARER)",
        r"A/C\s*(?:NO|NUM|NUMBER)[\.:]?\s*[0-9Xx]+",
        r"IFS\s*CODE|IFSC",
        r"[0-9]{6}\s+[0-9]{9}\s+[0-9]{6}",
        r"OR\s+BEARER",
    ],
    "passport": [
        r"PASSPORT",
        r"REPUBLIC OF INDIA.*PASSPORT|PASSPORT.*REPUBLIC OF INDIA",
        r"SURNAME.*GIVEN NAME|GIVEN NAME.*SURNAME",
        r"NATIONALITY\s*:\s*INDIAN",
        r"PASSPORT\s*(?:NO|NUMBER)",
    ],
    "voter_id": [
        r"ELECTION COMMISSION OF INDIA",
        r"ELECTOR PHOTO IDENTITY CARD",
        r"EPIC\s*(?:NO|NUMBER)",
        r"BHARAT NIRVACHAN AYOG",
    ],
    "driving_licence": [
        r"DRIVING LICEN[CS]E",
        r"LICEN[CS]E\s*(?:NO|NUMBER)",
        r"VEHICLE CLASS",
        r"TRANSPORT DEPARTMENT|MOTOR VEHICLES ACT|UNION OF INDIA.*DRIVING",
    ],
    "udyam": [
        r"UDYAM REGISTRATION|उद्यम\s*नोंदणी|उद्यम\s*पंजीकरण",
        r"UDYAM-[A-Z]{2}-[0-9]{2}-[0-9]+",
        r"ENTERPRISE NAME|NAME OF ENTERPRISE|उद्यमाचे\s*नाव|उद्यम\s*का\s*नाम",
        r"TYPE OF ENTERPRISE|ENTERPRISE TYPE|उद्यमाचा\s*प्रकार",
        r"MINISTRY OF MICRO.*SMALL AND MEDIUM|सूक्ष्म,\s*लघु\s*(?:व|आणि|एवं)\s*मध्यम\s*उद्योग",
    ],
    "fssai": [
        r"FOOD SAFETY AND STANDARDS AUTHORITY",
        r"FSSAI",
        r"LICENSE UNDER FSS ACT|REGISTRATION UNDER FSS ACT",
        r"KIND OF BUSINESS",
    ],
    "shop_establishment": [
        r"SHOP & ESTABLISHMENT|SHOPS & ESTABLISHMENTS|SHOPS AND ESTABLISHMENTS|दुकान\s*(?:आणि|व|एवं)\s*(?:आस्थापना|स्थापना)|दु\s*क\s*ाने\s*(?:आणि|व)\s*आ\s*(?:थापना|स्थापना)",
        r"SHOPS AND COMMERCIAL|आस्थापना\s*नोंदणी|स्थापना\s*पंजीकरण|नमु\s*न\s*ा\s*[\"'\u201c\u201d]?[फगFG][\"'\u201c\u201d]?|Form\s*[-–]\s*[\"'\u2018\u2019]?[फगFG][\"'\u2018\u2019]?",
        r"ESTABLISHMENT REGISTRATION|महाराष्ट्र\s*शासन|कामगार\s*आयुक्त|Registration\s*Certificate\s*/\s*Intimation|पावती\s*(?:क्रमांक|मांक)",
        r"NATURE OF BUSINESS|व्यवसायाचे\s*स्वरूप|Category\s*Of\s*Establishment",
    ],
    "bank_statement": [
        r"ACCOUNT STATEMENT",
        r"STATEMENT OF ACCOUNT",
        r"CLOSING BALANCE",
        r"OPENING BALANCE",
        r"ACCOUNT NUMBER",
        r"TRANSACTION DETAILS|TRANSACTION DATE",
        r"WITHDRAWAL.*DEPOSIT.*BALANCE",
    ],
    "salary_slip": [
        r"SALARY SLIP|PAYSLIP|वेतन\s*पावती|वेतन\s*प्रमाणपत्र|मासिक\s*वेतन\s*पावती|वेतन\s*पर्ची",
        r"EARNINGS.*DEDUCTIONS|DEDUCTIONS.*EARNINGS|मिळकत.*कपात|कपात.*मिळकत|एकूण\s*मिळकत|एकूण\s*कपात|उपार्जन.*कटौती",
        r"NET SALARY|NET PAY|निव्वळ\s*वेतन|निव्वळ\s*देय|शुद्ध\s*वेतन|हाती\s*येणारे\s*वेतन",
        r"BASIC SALARY|BASIC PAY|मूळ\s*वेतन|मूल\s*वेतन",
        r"PAY PERIOD|PAY SLIP FOR THE MONTH|वेतन\s*महिना|माहे\s*:\s*[A-Za-z\u0900-\u097F]+|माह\s*:\s*[A-Za-z\u0900-\u097F]+",
    ],
    "utility_bill": [
        r"ELECTRICITY BILL|WATER BILL|GAS BILL|ENERGY BILL|BILL OF SUPPLY|POWER DISTRIBUTION|MSEDCL|MAHADISCOM|महावितरण|महािवतरण|वीज\s*देयक|विद्युत\s*देयक|पाणी\s*पट्टी|गॅस\s*बिल",
        r"CONSUMER\s*(?:NO|NUMBER|ID|PORTAL)|ग्राहक\s*(?:क्रमांक|क्र\.?|नंबर)|साहक\s*(?:क्रमांक|कमांक|कमक)|उपभोक्ता\s*(?:संख्या|क्रमांक)",
        r"BILL\s*AMOUNT|TOTAL AMOUNT DUE|देयक\s*रक्कम|एकूण\s*रक्कम|भरणा\s*रक्कम|देय\s*रक्कम|आतमतारीख",
        r"DUE DATE|देय\s*दिनांक|अंतिम\s*(?:तारीख|दिनांक)|या\s*तारखेपर्यंत\s*भरल्यास",
    ],
    "itr": [
        r"INDIAN INCOME TAX RETURN",
        r"ITR-V|ITR-1|ITR-2|ITR-4",
        r"ACKNOWLEDGEMENT NUMBER",
        r"ASSESSMENT YEAR",
    ],
    "gst_certificate": [
        r"GOODS AND SERVICES TAX",
        r"FORM GST REG-06|FORM GST REG-02|FORM GST REG",
        r"REGISTRATION CERTIFICATE.*GST|GST.*REGISTRATION CERTIFICATE|REGISTRATION CERTIFICATE",
        r"GOVERNMENT OF INDIA.*GOODS AND SERVICES|GOODS AND SERVICES.*GOVERNMENT OF INDIA",
        r"\b[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][1-9A-Z]Z[0-9A-Z]\b",
        r"CONSTITUTION OF BUSINESS",
    ],
    "certificate_of_incorporation": [
        r"CERTIFICATE OF INCORPORATION",
        r"CORPORATE IDENTITY NUMBER|CORPORATE IDENTIFICATION NUMBER",
        r"REGISTRAR OF COMPANIES",
        r"COMPANIES ACT,\s*(?:1956|2013)|THE COMPANIES ACT",
        r"MINISTRY OF CORPORATE AFFAIRS",
    ],
    "partnership_deed": [
        r"PARTNERSHIP DEED|DEED OF PARTNERSHIP",
        r"PARTNERS OF THE FIRM|PARTNERS OF FIRST PART|PARTY OF THE FIRST PART",
        r"PROFIT SHARING RATIO|PROFIT AND LOSS.*SHARING",
        r"INDIAN PARTNERSHIP ACT",
    ],
    "rent_agreement": [
        r"RENT AGREEMENT|LEASE AGREEMENT|TENANCY AGREEMENT|भाडेकरार|भाडे\s*करार|परवाना\s*करार",
        r"LESSOR AND LESSEE|LANDLORD AND TENANT|परवाना\s*देणारा|घरमालक",
        r"MONTHLY RENT|PREMISES ON LEASE|मासिक\s*भाडे",
        r"SECURITY DEPOSIT.*RENT|RENT.*SECURITY DEPOSIT|REFUNDABLE SECURITY DEPOSIT|डिपॉझिट",
    ],
    "form_16": [
        r"FORM NO\.?\s*16\b",
        r"CERTIFICATE UNDER SECTION 203",
        r"TAX DEDUCTED AT SOURCE",
        r"CENTRAL BOARD OF DIRECT TAXES",
    ],
    "bank_passbook": [
        r"PASS\s*BOOK|PASSBOOK|पास\s*बुक|पासबुक|बचत\s*खाते\s*पासबुक",
        r"ACCOUNT HOLDER NAME|NAME OF ACCOUNT HOLDER|खातेदाराचे\s*नाव|खाताधारक\s*का\s*नाम",
        r"ACCOUNT NUMBER.*IFSC|IFSC.*ACCOUNT NUMBER|खाते\s*(?:क्रमांक|क्र\.?).*(?:आयएफएससी|शाखा)|शाखा.*खाते\s*(?:क्रमांक|क्र\.?)",
        r"CUSTOMER ID|CIF NO|CUSTOMER NO|ग्राहक\s*(?:क्रमांक|क्र\.?|आयडी)|सीआयएफ",
    ],
    "property_tax_receipt": [
        r"PROPERTY TAX RECEIPT|PROPERTY TAX PAYMENT|मालमत्ता\s*कर|घरपट्टी",
        r"MUNICIPAL CORPORATION|NAGAR NIGAM|MUNICIPAL COUNCIL|महानगरपालिका|नगरपरिषद|नगर\s*पंचायत",
        r"PROPERTY TAX PAID|PROPERTY TAX ASSESSMENT|मालमत्ता\s*कर\s*पावती|कर\s*पावती",
        r"PROPERTY ID|ASSESSMENT NO|INDEX NO|TAX BILL NO|मालमत्ता\s*(?:क्रमांक|क्र\.?)|पावती\s*(?:क्रमांक|क्र\.?)",
    ],
    "iec_certificate": [
        r"IMPORT EXPORT CODE|IMPORTER EXPORTER CODE",
        r"DIRECTORATE GENERAL OF FOREIGN TRADE|DGFT",
        r"GOVERNMENT OF INDIA.*MINISTRY OF COMMERCE|MINISTRY OF COMMERCE.*DIRECTORATE GENERAL",
        r"IEC CERTIFICATE|IEC ISSUANCE",
    ],
    "income_certificate": [
        r"INCOME CERTIFICATE|CERTIFICATE OF INCOME|उत्पन्नाचा\s*दाखला|उत्पन्नाचे\s*प्रमाणपत्र|उलपञाचे\s*पमाणपऋ|उतनाचा\s*दाखला|वार्षिक\s*उत्पन्नाचा\s*दाखला|उत्पन्न\s*दाखला|उत्पन्न\s*प्रमाणपत्र",
        r"TAHSILDAR|REVENUE DEPARTMENT|तहसीलदार|तहसील\s*कार्यालय|उपविभागीय\s*अधिकारी|प्रांत\s*अधिकारी|नायब\s*तहसीलदार",
        r"ANNUAL INCOME|TOTAL INCOME.*CERTIFIED|मिळालेले\s*वार्षिक\s*उत्पन्न|वार्षिक\s*उत्पन्न|एकूण\s*वार्षिक\s*उत्पन्न|उत्पन्न\s*खालीलप्रमाणे|जलनखालीलपमाणे",
        r"THIS IS TO CERTIFY THAT|CERTIFIED THAT|प्रमाणित\s*करण्यात\s*येते\s*की|अमाणतकरणयात|अमािणतकरण|सदरचा\s*दाखला",
    ],
    "employment_contract": [
        r"EMPLOYMENT AGREEMENT|EMPLOYMENT CONTRACT|CONTRACT OF EMPLOYMENT",
        r"OFFER OF EMPLOYMENT|TERMS OF EMPLOYMENT|APPOINTMENT LETTER",
        r"EMPLOYER.*EMPLOYEE|EMPLOYEE.*EMPLOYER",
        r"BASE SALARY|COMPENSATION|REMUNERATION",
        r"JOINING DATE|COMMENCEMENT DATE|EFFECTIVE DATE",
    ],
    "income_tax_notice": [
        r"NOTICE UNDER SECTION\s*(?:143|142|148|156)|INTIMATION UNDER SECTION\s*(?:143|142|148)",
        r"INCOME TAX DEPARTMENT.*NOTICE|NOTICE.*INCOME TAX DEPARTMENT",
        r"ASSESSMENT YEAR\s*[:\-]?\s*[0-9]{4}[\s\-–][0-9]{2,4}",
        r"DOCUMENT IDENTIFICATION NUMBER|DIN\s*[:\-]",
        r"DEMAND NOTICE|TAX DEMAND",
    ],
    "commercial_invoice": [
        r"TAX INVOICE|COMMERCIAL INVOICE|INVOICE",
        r"BILL TO|SHIP TO|INVOICE TO",
        r"INVOICE NO|INVOICE NUMBER|INVOICE DATE",
        r"TOTAL AMOUNT|TOTAL AMOUNT DUE|NET PAYABLE|GRAND TOTAL",
        r"SUBTOTAL.*TOTAL|CGST.*SGST|GSTIN.*INVOICE",
    ],
}

# Display title and issuing authority per type.
TYPE_METADATA: dict[str, tuple[str, str]] = {
    "pan": ("PAN Card", "Income Tax Department"),
    "aadhaar": ("Aadhaar Card", "UIDAI"),
    "cancelled_cheque": ("Cancelled Cheque", "Bank"),
    "bank_statement": ("Bank Statement", "Bank"),
    "salary_slip": ("Salary Slip", "Employer"),
    "utility_bill": ("Utility Bill", "Utility Provider"),
    "udyam": ("Udyam Certificate", "Ministry of MSME"),
    "fssai": ("FSSAI License", "Food Safety and Standards Authority of India"),
    "shop_establishment": ("Shop & Establishment", "Labour Department"),
    "passport": ("Passport", "Republic of India"),
    "voter_id": ("Voter ID", "Election Commission of India"),
    "driving_licence": ("Driving Licence", "Transport Department"),
    "itr": ("ITR Ack", "Income Tax Department"),
    "gst_certificate": ("GST Registration Certificate", "Government of India - GST"),
    "certificate_of_incorporation": ("Certificate of Incorporation", "Ministry of Corporate Affairs"),
    "partnership_deed": ("Partnership Deed", "Registrar of Firms"),
    "rent_agreement": ("Rent Agreement", "Landlord / Lessor"),
    "form_16": ("Form 16", "Income Tax Department"),
    "bank_passbook": ("Bank Passbook", "Bank"),
    "property_tax_receipt": ("Property Tax Receipt", "Municipal Corporation"),
    "iec_certificate": ("IEC Certificate", "Directorate General of Foreign Trade"),
    "income_certificate": ("Income Certificate", "Revenue Department / Tahsildar"),
    "employment_contract": ("Employment Contract", "Employer"),
    "income_tax_notice": ("Income Tax Notice", "Income Tax Department"),
    "commercial_invoice": ("Commercial Invoice", "Vendor / Supplier"),
}
