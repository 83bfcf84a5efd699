"""Identifiers, masking, dates, redaction, intents: literal cases."""

import datetime
import re
import unicodedata

from pyspark.sql import functions as F

from inkwell.functions.dates import human_date, human_period, normalise_date, parse_amount, parse_date
from inkwell.functions.identifiers import gstin_digit, verhoeff_digit
from inkwell.functions.masking import mask_account, mask_address, mask_person, mask_uid
from inkwell.functions.periods import financial_years, issue_date, years_before
from inkwell.functions.redaction import redact
from inkwell.functions.similarity import with_similarity
from inkwell.functions.text import clean_value
from inkwell.operators.questions import detect_intents, lookup_fields
from inkwell.operators.redact import NFKC_STABLE, normalise_text, redact_map, redact_nested_map
from inkwell.operators.validate import load_bank_codes, validate_identifiers


def values(spark, texts, expr):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.v for r in rows.select("i", expr(F.col("t")).alias("v")).orderBy("i").collect()]


def test_identifiers(spark):
    good = "23412341234"
    digit = values(spark, [good], verhoeff_digit)[0]
    wrong = str((int(digit) + 1) % 10)
    gst14 = "27ABCPE1234F1Z"
    check = values(spark, [gst14], gstin_digit)[0]
    cases = [
        ("aadhaar", good + digit, None), ("aadhaar", good + wrong, "invalid_aadhaar_checksum"),
        ("aadhaar", "012345678901", "invalid_aadhaar_checksum"),
        ("pan", "ABCPE1234F", None), ("pan", " abcpe1234f ", None), ("pan", "ABCDE1234F", "invalid_pan_entity_type_D"),
        ("pan", "ABC1234", "invalid_pan_pattern"),
        ("ifsc", "SBIN0001234", None), ("ifsc", "ZZZZ0001234", "ifsc_needs_review"), ("ifsc", "SBIN1001234", "invalid_ifsc_format"),
        ("gstin", gst14 + check, None), ("gstin", gst14 + ("0" if check != "0" else "1"), "invalid_gstin_checksum"),
        ("gstin", "27ABCDE1234F1Z5", "gstin_invalid_pan_entity_type_D"), ("gstin", "27", "invalid_gstin_format"),
        ("cin", "U12345MH2001PTC123456", None), ("cin", "X12345MH2001PTC123456", "invalid_cin_format"),
    ]
    rows = spark.createDataFrame([(i, k, v) for i, (k, v, _) in enumerate(cases)], "i int, kind string, value string")
    got = [(r.reason, r.valid) for r in validate_identifiers(rows).orderBy("i").collect()]
    assert got == [(why, why is None) for _, _, why in cases]


def test_bank_code_registry(spark, tmp_path):
    (tmp_path / "codes.json").write_text('["ZZZZ"]')
    codes = load_bank_codes(spark, str(tmp_path / "codes.json"))
    rows = spark.createDataFrame([("ifsc", "ZZZZ0001234"), ("ifsc", "SBIN0001234")], "kind string, value string")
    got = {r.value: r.reason for r in validate_identifiers(rows, codes).collect()}
    assert got == {"ZZZZ0001234": None, "SBIN0001234": "ifsc_needs_review"}


def test_masking(spark):
    assert values(spark, ["123456789012", "123", ""], mask_account) == ["XXXXXXXX9012", "XXXXXX123", None]
    assert values(spark, ["5432 1098 7654"], mask_uid) == ["XXXXXXXX7654"]
    assert values(spark, ["RAVI KUMAR SHAH", "RAVI"], mask_person) == ["RAVI S***", "R***"]
    got = values(spark, ["Flat 4, Tower B, Baner, Pune 411045", "12 Hill Road Pune"], mask_address)
    assert got == ["XXXX, Baner, Pune 411045", "XXXX Hill Road Pune"]


def test_dates(spark):
    assert values(spark, ["24/04/1987", "1987-04-24", "24.4.87", "1 Jan 2020", "31/02/2020"], normalise_date) == [
        "1987-04-24", "1987-04-24", "1987-04-24", None, None]
    assert values(spark, ["1987.04.24", "24-04-1987", "1850-01-05", "x"], parse_date) == [
        datetime.date(1987, 4, 24), datetime.date(1987, 4, 24), None, None]
    assert values(spark, ["22/06/2007", "2007-6-2", "soon"], human_date) == ["22 June 2007", "02 June 2007", "soon"]
    assert values(spark, ["{'from_date':'30/07/2025','to_date':'30/07/2026'}", "01/01/2024 to 02/01/2024", "n/a"], human_period) == [
        "30 July 2025 – 30 July 2026", "01 January 2024 – 02 January 2024", "n/a"]
    assert values(spark, ["₹ 1,200.50", "(100.00)", "abc"], parse_amount) == [1200.5, -100.0, None]


def test_financial_years(spark):
    texts = ["2023-2024 and 2021-22", "२०२३-२०२४", "2O24-2025 2028-2034", "barcode 12345-6789"]
    assert values(spark, texts, financial_years) == [["2021-2022", "2023-2024"], ["2023-2024"], ["2024-2025"], []]
    assert values(spark, ["2024-06-10", "10/02/2024", "x"], years_before) == [
        ["2021-2022", "2022-2023", "2023-2024"], ["2020-2021", "2021-2022", "2022-2023"], None]
    assert values(spark, ["2025-06-266", "26/06/20255", "99/99/2025", "2025-02-30", "266/06/2025"], issue_date) == [
        "2025-06-26", "26/06/2025", None, None, "26/06/2025"]


def test_clean_value(spark):
    texts = ["JOHN DOE\nDate of Birth", "ACME -", "A\n\nB", "FIRST\nSECOND LINE OF FOUR WORDS", "  x : "]
    assert values(spark, texts, clean_value) == ["JOHN DOE", "ACME", "A", "FIRST SECOND LINE OF FOUR WORDS", "x"]


def test_redaction(spark):
    texts = [
        "GST 27ABCPE1234F1Z5 pan ABCPE1234F", "uid 1234 5678 9012 and 123456789012", "Bearer abcdefghijklmnop tail",
        "key sk-abcdefghijklmnopqr", "acct 123456789 ifsc SBIN0001234", "f" * 64,
    ]
    assert values(spark, texts, redact) == [
        "GST [REDACTED_GSTIN] pan [REDACTED_PAN]", "uid [REDACTED_AADHAAR] and [REDACTED_AADHAAR]", "Bearer [REDACTED_TOKEN] tail",
        "key [REDACTED_API_KEY]", "acct [REDACTED_ACCOUNT] ifsc [REDACTED_IFSC]", "[REDACTED_KEY]",
    ]
    rows = spark.createDataFrame([({"User_Password": "x", "full_text": "y", "note": "ABCPE1234F"},)], "m map<string,string>")
    assert redact_map(rows, "m").first().m == {
        "User_Password": "[REDACTED_SECRET]", "full_text": "[REDACTED_LARGE_PAYLOAD]", "note": "[REDACTED_PAN]"}
    nested = spark.createDataFrame([({"token": {"a": "1"}, "x": {"prompt": "p", "n": "SBIN0001234"}},)], "m map<string,map<string,string>>")
    assert redact_nested_map(nested, "m").first().m == {
        "token": {"a": "[REDACTED_SECRET]"}, "x": {"prompt": "[REDACTED_LARGE_PAYLOAD]", "n": "[REDACTED_IFSC]"}}


def test_normalise_text(spark):
    rows = spark.createDataFrame([
        (0, "INCOMETAXDEPARTMENT Name:RAVI"), (1, "“ｆｕｌｌ” – १२३"), (2, None), (3, "a.bc d.e"), (4, "FATHER'SNAME"),
    ], "doc_id int, full_text string")
    got = {r.doc_id: r.norm_text for r in normalise_text(rows).collect()}
    assert got == {0: "INCOME TAX DEPARTMENT Name: RAVI", 1: '"full"  -  123', 2: "", 3: "a. bc d.e", 4: "FATHER'S NAME"}


def test_similarity_matches_difflib(spark):
    from difflib import SequenceMatcher

    pairs = [("RAVI SHARMA", "Sharma, Ravi"), ("JOHN DOE", "ALICE"), ("x", "x"), ("", "abc")]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    got = [r.score for r in with_similarity(rows, "a", "b").orderBy("i").collect()]

    def norm(s):
        return " ".join(sorted("".join(c for c in s.lower() if c.isalnum() or c in "_ ").split()))

    assert got == [SequenceMatcher(None, norm(a), norm(b)).ratio() for a, b in pairs]


def test_intents_and_lookup(spark):
    asked = [
        (0, "What is the IFSC code?", "ifsc"), (1, "cust id please", "customer_number"), (2, "statement period?", "statement_period"),
        (3, "who is the account holder", "account_holder"), (4, "father's name", "father_name"), (5, "company overview", None),
        (6, "closing balance", "closing_balance"), (7, "GST number", "gstin"), (8, "name on card", "account_holder"),
    ]
    kinds = {8: "PAN Card"}
    q = spark.createDataFrame([(i, t, kinds.get(i, "")) for i, t, _ in asked], "doc_id long, question string, doc_type string")
    got = [r.intent for r in detect_intents(q).orderBy("doc_id").collect()]
    assert got == [w for _, _, w in asked]
    wanted = spark.createDataFrame([(0, "ifsc"), (1, "customer_number"), (2, "gstin"), (3, "date_of_birth"), (4, "account_number")],
                                   "doc_id long, intent string")
    fields = spark.createDataFrame([
        (0, "ifsc", "STATE BANK"), (1, "customer_number", "12345"), (1, "account_number", "12345"), (3, "dob", "22/06/2007"),
        (4, "account_number", "123456789"),
    ], "doc_id long, field string, value string")
    docs = spark.createDataFrame([(i, "GSTIN 27 ABCPE 1234F1Z5" if i == 2 else "") for i in range(5)], "doc_id long, full_text string")
    found = {r.doc_id: (r.value, r.source) for r in lookup_fields(wanted, fields, docs).collect()}
    assert found == {
        0: (None, "prohibited"), 1: (None, "prohibited"), 2: ("27ABCPE1234F1Z5", "ocr"), 3: ("22 June 2007", "extracted"),
        4: ("XXXXX6789", "extracted")}


def test_nfkc_leaves_its_stable_class_alone():
    stable = re.compile(f"[{NFKC_STABLE}]")
    chars = [chr(c) for c in range(0x10000) if stable.fullmatch(chr(c))]
    assert [c for c in chars if unicodedata.normalize("NFKC", c) != c] == []
    # the only mark among them keeps its place, and no two of them make one
    assert [c for c in chars if unicodedata.combining(c)] == ["्"]
    composed = {tuple(unicodedata.normalize("NFD", chr(c)))[-1] for c in range(0x110000)
                if len(unicodedata.normalize("NFD", chr(c))) > 1 and unicodedata.normalize("NFC", unicodedata.normalize("NFD", chr(c))) == chr(c)
                and not 0xAC00 <= c <= 0xD7A3}
    assert [c for c in chars if c in composed] == []
