"""Text repair values: merged words, residual labels, place names."""

from __future__ import annotations

# Words that recognition glues together, with their repair.
MERGED_WORDS: list[tuple[str, str]] = [
    (r"\bINCOMETAXDEPARTMENT\b", "INCOME TAX DEPARTMENT"),
    (r"\bINCOMETAX\b", "INCOME TAX"),
    (r"\bGOVT\.?OFINDIA\b", "GOVT. OF INDIA"),
    (r"\bGOVTOFINDIA\b", "GOVT. OF INDIA"),
    (r"\bPERMANENTACCOUNTNUMBER\b", "PERMANENT ACCOUNT NUMBER"),
    (r"\bUNIQUEIDENTIFICATIONAUTHORITYOFINDIA\b", "UNIQUE IDENTIFICATION AUTHORITY OF INDIA"),
    (r"\bELECTIONCOMMISSIONOFINDIA\b", "ELECTION COMMISSION OF INDIA"),
    (r"\bACCOUNTSTATEMENT\b", "ACCOUNT STATEMENT"),
    (r"\bSTATEMENTOFACCOUNT\b", "STATEMENT OF ACCOUNT"),
    (r"\bCLOSINGBALANCE\b", "CLOSING BALANCE"),
    (r"\bOPENINGBALANCE\b", "OPENING BALANCE"),
    (r"\bTRANSACTIONDETAILS\b", "TRANSACTION DETAILS"),
    (r"\bSALARYSLIP\b", "SALARY SLIP"),
    (r"\bUTILITYBILL\b", "UTILITY BILL"),
    (r"\bELECTRICITYBILL\b", "ELECTRICITY BILL"),
    (r"\bWATERBILL\b", "WATER BILL"),
    (r"\bGOODSANDSERVICESTAX\b", "GOODS AND SERVICES TAX"),
    (r"\bCERTIFICATEOFINCORPORATION\b", "CERTIFICATE OF INCORPORATION"),
    (r"\bPARTNERSHIPDEED\b", "PARTNERSHIP DEED"),
    (r"\bRENTAGREEMENT\b", "RENT AGREEMENT"),
    (r"\bBANKPASSBOOK\b", "BANK PASSBOOK"),
    (r"\bPROPERTYTAXRECEIPT\b", "PROPERTY TAX RECEIPT"),
    (r"\bIMPORTEXPORTCODE\b", "IMPORT EXPORT CODE"),
    (r"\bINCOMECERTIFICATE\b", "INCOME CERTIFICATE"),
    (r"\bFOODSAFETYANDSTANDARDS\b", "FOOD SAFETY AND STANDARDS"),
    (r"\bFATHER['’]?SNAME\b", "FATHER'S NAME"),
    (r"\bDATEOFBIRTH\b", "DATE OF BIRTH"),
    (r"\bACCOUNTHOLDER\b", "ACCOUNT HOLDER"),
    (r"\bACCOUNTNUMBER\b", "ACCOUNT NUMBER"),
    (r"\bIFSCODE\b", "IFSC CODE"),
    (r"\bREPUBLICOFINDIA\b", "REPUBLIC OF INDIA"),
    # Regional common OCR artifacts
    (r"महािवतरण", "महावितरण"),
    (r"उलपञाचे\s*पमाणपऋ", "उत्पन्नाचे प्रमाणपत्र"),
    (r"अमािणतकरणयात|अमाणतकरणयात", "प्रमाणित करण्यात येते"),
    (r"आ\s*थापनेचे", "आस्थापनेचे"),
]

# Label lines that can trail a captured value.
RESIDUAL_LABELS: list[str] = [
    "purpose", "sno", "sno.", "s.no", "s.no.", "sr no", "sr. no", "sr.no",
    "classification year", "enterprise type", "type of enterprise", "major activity",
    "social category", "date of incorporation", "date of commencement",
    "permanent account number", "pan", "date of birth", "dob", "father's name", "father name",
    "mother's name", "husband's name", "address", "status", "form number",
    "acknowledgement number", "assessment year", "ay", "total income", "taxes paid",
    "gender", "sex", "nationality", "expiry date", "date of expiry", "issue date", "date of issue",
    "valid till", "valid from", "kind of business", "nature of business", "registration number",
    "reg no", "licence number", "license number", "fssai licence number",
    "ifsc", "ifsc code", "branch", "bank name", "account number", "account holder",
    "consumer number", "bill date", "due date", "bill amount", "total amount",
    "current year business loss", "book profit", "net tax payable",
    "gstin", "trade name", "legal name", "constitution of business", "date of registration",
    "additional trade names", "additional trade name", "trade names", "trade name if any", "trade name, if any", "if any",
    "name of deductor", "tan of deductor", "name of employer", "name of buyer", "name of collector", "name of deductee", "name of seller",
    "corporate identity number", "cin", "registrar of companies", "company name",
    "partnership deed", "firm name", "partner", "partner name", "profit sharing ratio",
    "lessor", "lessee", "landlord", "tenant", "monthly rent", "security deposit", "lease period",
    "gross salary", "tax deducted", "tan", "tan number", "employer name", "employee name",
    "passbook", "account holder name", "cif no", "customer id",
    "property id", "property tax", "tax paid", "assessment no", "tax amount",
    "iec", "iec number", "importer exporter code", "dgft", "entity name",
    "नोंदणी क्रमांक", "नोंदणी क्र", "आस्थापनेचे नाव", "दुकानाचे नाव", "मालकाचे नाव",
    "मालकाचा तपशील", "व्यवसायाचे स्वरूप", "उद्यमाचे नाव", "उद्यम नोंदणी क्रमांक",
    "उद्यमाचा प्रकार", "मुख्य कार्यकलाप", "मालमत्ता क्रमांक", "मालमत्ता कर",
    "कर आकारणी", "भरलेली रक्कम", "पावती क्रमांक", "परवाना देणारा", "परवाना घेणारा",
    "भाडेकरार", "मासिक भाडे", "डिपॉझिट", "जन्मतारीख", "जन्म तारीख", "लिंग", "पत्ता", "आधार क्रमांक",
    "कार्यालयाचे नाव", "संस्थेचे नाव", "विभागाचे नाव", "कंपनीचे नाव", "नियोक्त्याचे नाव",
    "कर्मचाऱ्याचे नाव", "कर्मचारी नाव", "कर्मचारी का नाम", "अधिकाऱ्याचे नाव", "सेवकाचे नाव",
    "निव्वळ वेतन", "निव्वळ देय रक्कम", "निव्वळ देय", "हाती येणारे वेतन", "शुद्ध वेतन", "कुल शुद्ध देय",
    "वेतन महिना", "माहे", "कालावधी",
    "बँकेचे नाव", "बैंक का नाम", "शाखेचे नाव", "शाखा कोड", "शाखा",
    "खाते क्रमांक", "खाते क्र", "खाते नं", "बचत खाते क्रमांक", "खाता संख्या", "खाता क्रमांक",
    "खातेदाराचे नाव", "खातेदार नाव", "ग्राहकाचे नाव", "खाताधारक का नाम", "खाताधारी का नाम",
    "पासबुक", "बचत खाते पासबुक",
    "income certificate", "certificate number", "applicant name", "annual income", "financial year", "issuing authority",
    "उत्पन्नाचे प्रमाणपत्र", "उत्पन्नाचा दाखला", "दाखला क्रमांक", "प्रमाणपत्र क्रमांक", "वार्षिक उत्पन्न", "अर्जदाराचे नाव",
]

# Taluka and district spellings.
PLACE_SPELLINGS: dict[str, str] = {
    "जुनर": "जुन्नर",
    "जुनर्": "जुन्नर",
    "जुन्नर": "जुन्नर",
    "हवेली": "हवेली",
    "खेड": "खेड",
    "आंबेगाव": "आंबेगाव",
    "शिरूर": "शिरूर",
    "शिरुर": "शिरूर",
    "बारामती": "बारामती",
    "इंदापूर": "इंदापूर",
    "इंदापुर": "इंदापूर",
    "दौंड": "दौंड",
    "भोर": "भोर",
    "वेल्हे": "वेल्हे",
    "मुळशी": "मुळशी",
    "मावळ": "मावळ",
    "पुरंदर": "पुरंदर",
    "पुण": "पुणे",
    "पुणे": "पुणे",
    "मुंबई": "मुंबई",
    "ठाणे": "ठाणे",
    "ठाण": "ठाणे",
    "नाशिक": "नाशिक",
    "नासिक": "नाशिक",
    "नागपूर": "नागपूर",
    "नागपुर": "नागपूर",
    "छत्रपती संभाजीनगर": "छत्रपती संभाजीनगर",
    "औरंगाबाद": "छत्रपती संभाजीनगर",
    "सातारा": "सातारा",
    "सांगली": "सांगली",
    "कोल्हापूर": "कोल्हापूर",
    "कोल्हापुर": "कोल्हापूर",
    "सोलापूर": "सोलापूर",
    "सोलापुर": "सोलापूर",
    "अहमदनगर": "अहमदनगर",
    "अहिल्यानगर": "अहिल्यानगर",
}
