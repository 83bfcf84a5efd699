"""Pages of a document apart from each other, repeated keys in model answers, signed balances, whole windows."""

from inkwell.operators.answers import answers
from inkwell.operators.integrity import alignment_findings, all_findings, font_findings, label_findings
from inkwell.operators.model_outputs import normalise_model_outputs
from inkwell.operators.statements import page_rows

LINE = "doc_id long, page_num int, line_no int, text string, x0 double, y0 double, x1 double, y1 double"


def lines(spark, rows):
    return spark.createDataFrame([(d, p, i, t, x, y, x + 50, y + h) for i, (d, p, t, x, y, h) in enumerate(rows)], LINE)


def test_a_label_once_per_page_is_no_finding(spark):
    docs = spark.createDataFrame([(1, "rent_agreement"), (2, "rent_agreement")], "doc_id long, doc_type string")
    once = [(1, p, "Name: A", 10.0, 10.0, 12.0) for p in (1, 2, 3)]
    twice = [(2, p, "Name: A", 10.0, 10.0, 12.0) for p in (1, 2, 2)]
    table = lines(spark, once + twice)
    assert {r.doc_id for r in label_findings(table, docs).collect()} == {2}
    assert label_findings(table, docs, first_page_only=True).count() == 0


def test_each_page_has_its_own_median(spark):
    straight = [(1, p, "x", 100.0 * p, 20.0 * i, 12.0) for p in (1, 2) for i in range(6)]
    off = [(2, 2, "x", 100.0 + (10 if i < 3 else 0), 20.0 * i, 12.0 + (60 if i > 3 else 0)) for i in range(7)]
    table = lines(spark, straight + off)
    assert {r.doc_id for r in alignment_findings(table).collect()} == {2}
    assert {r.doc_id for r in font_findings(table).collect()} == {2}
    assert alignment_findings(table, first_page_only=True).count() == 0


def test_order_of_findings_has_no_limit(spark):
    shape = "doc_id long, ordinal long, signal string, category string, score int, description string"
    one = spark.createDataFrame([(1, 5_000_000, "a", "c", 1, "first source")], shape)
    two = spark.createDataFrame([(1, 0, "b", "c", 1, "second source")], shape)
    rows = all_findings(one, two).orderBy("ordinal").collect()
    assert [r.description for r in rows] == ["first source", "second source"]


def test_repeated_keys_in_model_answers(spark):
    raw = spark.createDataFrame(
        [(1, '{"extracted_fields": {"a": "1", " a": "2"}}'), (2, '{"summary": "x", "extracted_fields": {"b": "1", "b": "2"}}'),
         (3, '{"extracted_fields": {"c": "model"}}')],
        "doc_id long, raw string",
    )
    docs = spark.createDataFrame([(i, "") for i in (1, 2, 3)], "doc_id long, full_text string")
    rules = spark.createDataFrame([(3, "c", "one"), (3, "c", "two")], "doc_id long, field string, value string")
    rows = normalise_model_outputs(raw, docs, rules).collect()
    assert {r.doc_id: r.extracted_fields for r in rows} == {1: {"a": "2"}, 2: {"b": "2"}, 3: {"c": "two"}}


def test_signed_amounts_are_read(spark):
    text = "01-02-2024 S1 TRANSFER 100.00 -500.00\n02-02-2024 S2 NEFT-9 50.00 -450.00"
    pages = spark.createDataFrame([(1, 1, text), (1, 2, "03-02-2024 S3 FEE 20.00 DR -470.00")], "doc_id long, page_num int, full_text string")
    rows = page_rows(pages).orderBy("page_num", "seq").collect()
    assert [(r.description, r.amount, r.balance) for r in rows] == [
        ("S1 TRANSFER", "100.00", "-500.00"), ("S2 NEFT-9", "50.00", "-450.00"), ("03-02-2024 S3 FEE", "20.00", "-470.00"),  # blocks keep the date
    ]


def test_first_rule_that_applies_answers(spark):
    docs = spark.createDataFrame(
        [(1, "pan", "a.pdf", "Name: A B"), (2, "employment_contract", "b.pdf", "Salary: 5 lakh"), (3, None, None, None)],
        "doc_id long, doc_type string, filename string, full_text string",
    ).selectExpr("*", "'verified' AS verification_status", "45 AS risk_score", "'seal' AS signals")
    fields = spark.createDataFrame(
        [(2, "employee_name", "A 50%s"), (2, "joining_date", "1 May 2020"), (2, "salary", "5 lakh")], "doc_id long, field string, value string"
    )
    asked = [
        (1, "employee name?", "employee_name", "I could not find an employee name in this document."),
        (2, "employee name?", "employee_name", "According to b.pdf, the employee named is: **A 50%s**."),
        (1, "the joining date", "joining_date", "I could not find a joining date in this document."),
        (2, "the joining date", "joining_date", "According to b.pdf, the effective/joining date is: **1 May 2020**."),
        (1, "what is the salary", "salary", "I could not find salary information in this document."),
        (2, "what is the salary", "salary", "According to b.pdf, the stated compensation is: **5 lakh**."),
        (2, "is it genuine, summary", "summary", None),
        (2, "is it genuine", "authenticity", "Verification Status: Review Required. Visible inconsistencies detected: seal. Manual review is recommended."),
        (3, "find dates", "dates", "No clear dates were found in the document."),
        (3, None, "search", "I could not find information regarding your query in the document."),
        (4, "zebra", "search", "I could not find information regarding your query in the document."),
    ]
    messages = spark.createDataFrame(
        [(0, d, 2 * i, "user", m) for i, (d, m, _, _) in enumerate(asked)], "user_id int, document_id long, turn int, role string, content string"
    )
    got = {r.turn // 2: r for r in answers(messages, docs, fields).collect()}
    assert [got[i].rule for i in range(len(asked))] == [rule for _, _, rule, _ in asked]
    assert [got[i].answer for i, a in enumerate(asked) if a[3]] == [a[3] for a in asked if a[3]]
