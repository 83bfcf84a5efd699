"""Derived views: driver tables turned into document-intelligence inputs.

The same SQL text runs on Spark and on the checking database.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from inkwell.plans.forms import FORM_DOCS

DRIVER_TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

# View name -> SQL, in build order.
VIEWS: dict[str, str] = {
    "kyc": r"""
SELECT c_custkey AS doc_id,
  chr(CAST(65 + c_custkey % 26 AS INT)) || chr(CAST(65 + (c_custkey * 3) % 26 AS INT)) || chr(CAST(65 + (c_custkey * 7) % 26 AS INT))
    || substr('PCHZQ', CAST(1 + c_custkey % 5 AS INT), 1) || chr(CAST(65 + (c_custkey * 11) % 26 AS INT))
    || lpad(CAST(c_custkey % 10000 AS STRING), 4, '0') || chr(CAST(65 + (c_custkey * 5) % 26 AS INT)) AS pan_number,
  substr('SBINHDFCICICZZZZUTIB', CAST(1 + 4 * (c_custkey % 5) AS INT), 4) || CASE WHEN c_custkey % 11 = 0 THEN '1' ELSE '0' END
    || lpad(CAST(c_custkey % 1000000 AS STRING), 6, '0') AS ifsc,
  CAST(2 + c_custkey % 8 AS STRING) || lpad(CAST((c_custkey * 7919) % 100000000000 AS STRING), 11, '0') AS raw_aadhaar,
  lpad(CAST(c_custkey * 97531 AS STRING), 12, '4') AS account_number,
  translate(upper(c_name), '#0123456789', ' ABCDEFGHIJ') AS name,
  CASE WHEN c_custkey % 9 = 0 THEN '' ELSE 'SENIOR ' END || translate(upper(c_name), '#0123456789', ' ABCDEFGHIJ') AS father_name,
  lpad(CAST(1 + c_custkey % 28 AS STRING), 2, '0') || '/' || lpad(CAST(1 + c_custkey % 12 AS STRING), 2, '0') || '/' || CAST(1900 + c_custkey % 140 AS STRING) AS dob,
  CAST(c_acctbal AS DECIMAL(18,2)) AS acctbal
FROM customer
""",
    "type_docs": r"""
SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'pan' WHEN 1 THEN 'aadhaar' WHEN 2 THEN 'bank_statement' WHEN 3 THEN 'bank_passbook' WHEN 4 THEN 'passport' ELSE 'unknown' END AS expected_type,
  CASE WHEN doc_id % 4 = 0 THEN '--- Page 1 ---' || chr(10) ELSE '' END || CASE doc_id % 6
    WHEN 0 THEN 'INCOME TAX DEPARTMENT' || chr(10) || 'Permanent Account Number Card' || chr(10) || pan_number || chr(10) || 'Name: ' || name || chr(10) || 'DOB: ' || dob
    WHEN 1 THEN 'UNIQUE IDENTIFICATION AUTHORITY OF INDIA' || chr(10) || 'Name: ' || name || chr(10) || 'DOB: ' || dob || chr(10) || substr(raw_aadhaar,1,4) || ' ' || substr(raw_aadhaar,5,4) || ' ' || substr(raw_aadhaar,9,4)
    WHEN 2 THEN 'ACCOUNT STATEMENT' || chr(10) || 'Account Number: ' || account_number || chr(10) || 'IFSC: ' || ifsc || chr(10) || 'Opening Balance: ' || CAST(acctbal AS STRING) || chr(10) || 'Fee: ' || CAST(doc_id % 500 AS STRING) || '.50 INR'
    WHEN 3 THEN 'SAVINGS BANK PASSBOOK' || chr(10) || 'Account Holder Name: ' || name || chr(10) || 'Account Number: ' || account_number || chr(10) || 'IFSC: ' || ifsc
    WHEN 4 THEN 'REPUBLIC OF INDIA' || chr(10) || 'PASSPORT' || chr(10) || 'Passport No: K' || lpad(CAST(doc_id AS STRING), 7, '0')
    ELSE 'Plain letter about nothing in particular, number ' || CAST(doc_id AS STRING) END
    || CASE WHEN doc_id % 4 = 0 THEN chr(10) || '--- Page 2 ---' || chr(10) || 'END OF DOCUMENT' ELSE '' END AS full_text
FROM kyc
""",
    "form_docs": FORM_DOCS,
    "statement_lines": r"""
SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS seq, o_orderdate AS txn_ts,
  CASE WHEN o_orderstatus = 'O' THEN 'CR' ELSE 'DR' END AS type, CAST(o_totalprice AS DECIMAL(18,2)) AS amount,
  sum(CASE WHEN o_orderstatus = 'O' THEN CAST(o_totalprice AS DECIMAL(18,2)) ELSE -CAST(o_totalprice AS DECIMAL(18,2)) END)
    OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS balance
FROM orders
""",
    "ocr_lines": r"""
SELECT l_orderkey AS doc_id, CASE WHEN l_orderkey % 4 = 0 AND line_no > 3 THEN 2 ELSE 1 END AS page_num, line_no,
  CASE l_partkey % 5 WHEN 0 THEN 'Name' WHEN 1 THEN 'Date of Birth' WHEN 2 THEN 'Father''s Name' WHEN 3 THEN 'PAN No' ELSE 'line ' || CAST(l_partkey AS STRING) END AS text,
  1.0E0 - l_discount AS confidence,
  CAST(50 + (l_partkey % 4) * 6 AS DOUBLE) AS x0, CAST(line_no * 30 - (l_suppkey % 3) * 12 AS DOUBLE) AS y0,
  CAST(90 + (l_partkey % 4) * 6 + l_quantity * 4 AS DOUBLE) AS x1,
  CAST(line_no * 30 - (l_suppkey % 3) * 12 + CASE WHEN l_partkey % 13 = 0 THEN 60 ELSE 20 END AS DOUBLE) AS y1
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_shipdate) AS line_no FROM lineitem) n
""",
    "vault": r"""
SELECT d.doc_id AS document_id, d.doc_id % 7 AS user_id, 'doc_' || CAST(d.doc_id AS STRING) || CASE WHEN d.doc_id % 3 = 0 THEN '.pdf' ELSE '.png' END AS filename,
  CASE WHEN d.doc_id % 10 = 9 THEN 'unknown' WHEN d.doc_id % 10 < 4 THEN 'pan' WHEN d.doc_id % 10 < 7 THEN 'bank_statement' ELSE 'ai_analyzed' END AS doc_type,
  CASE WHEN d.doc_id % 10 IN (7, 8) THEN 'ai' WHEN d.doc_id % 10 = 3 THEN NULL ELSE 'offline' END AS mode,
  CASE WHEN d.doc_id % 17 = 0 THEN 'failed' WHEN d.doc_id % 13 = 0 THEN 'warning' WHEN d.doc_id % 10 = 9 THEN 'low_confidence' ELSE 'completed' END AS status,
  CASE WHEN d.doc_id % 10 = 9 THEN 'unsupported' WHEN l.toxic = 1 THEN 'review_required' ELSE 'verified' END AS verification_status,
  CAST(coalesce(l.toxic, 0) * 45 + d.doc_id % 29 AS INT) AS risk_score, CASE WHEN d.doc_id % 10 = 9 THEN NULL ELSE d.doc_id % 19 <> 0 END AS checksum_valid,
  d.doc_id % 2 = 0 AS ocr_required, d.n_chars AS file_size, d.text AS extracted_text, d.lang, d.source
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
""",
    "requests": r"""
SELECT event_id, ts, user_id AS client, CASE event_type WHEN 'purchase' THEN 'upload' WHEN 'click' THEN 'ai_chat' WHEN 'view' THEN 'ai_chat' ELSE 'cleanup' END AS bucket FROM events
""",
    "audit": r"""
SELECT event_id AS job_id, ts, user_id AS customer_id, CASE event_type WHEN 'purchase' THEN 'pan' WHEN 'click' THEN 'aadhaar' WHEN 'view' THEN 'bank_statement' ELSE 'unknown' END AS doc_type,
  CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'low_confidence' ELSE 'success' END AS status, value AS duration_ms, props FROM events
""",
    "chat_messages": r"""
SELECT conv_id AS document_id, conv_id % 7 AS user_id, turn, role, text AS content FROM conversations
""",
    "expected": r"""
SELECT doc_id, 'name' AS field, CASE WHEN doc_id % 4 = 0 THEN 'SOMEBODY ELSE' ELSE name END AS value FROM kyc
UNION ALL SELECT doc_id, 'dob', CASE WHEN doc_id % 5 = 0 THEN '1970-01-01' ELSE substr(dob,7,4) || '-' || substr(dob,4,2) || '-' || substr(dob,1,2) END FROM kyc
UNION ALL SELECT doc_id, 'identifier', pan_number FROM kyc WHERE doc_id % 3 <> 0
UNION ALL SELECT doc_id, 'passport_number', 'K0000000' FROM kyc WHERE doc_id % 10 = 0
""",
    "qr_fields": r"""
SELECT doc_id, 'pan_number' AS field, CASE WHEN doc_id % 6 = 0 THEN 'XYZAB9876C' ELSE lower(pan_number) END AS value FROM kyc WHERE doc_id % 2 = 0
UNION ALL SELECT doc_id, 'dob', replace(dob, '/', '-') FROM kyc WHERE doc_id % 3 = 0
UNION ALL SELECT doc_id, 'gender', CASE WHEN doc_id % 2 = 0 THEN 'Male' ELSE 'Female' END FROM kyc
""",
    "questions": r"""
SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'What is the PAN number?' WHEN 1 THEN 'date of birth please' WHEN 2 THEN 'What is the IFSC code?' WHEN 3 THEN 'who is the account holder?' WHEN 4 THEN 'what is the gstin' ELSE 'tell me a story' END AS question FROM type_docs
""",
    "dialogues": r"""
SELECT doc_id AS document_id, doc_id % 7 AS user_id, 0 AS turn, 'user' AS role, CASE CAST(floor(doc_id / 6) AS INT) % 8 WHEN 0 THEN 'Please summarize this' WHEN 1 THEN 'Is this document genuine?'
  WHEN 2 THEN 'Extract key information' WHEN 3 THEN 'List all dates' WHEN 4 THEN 'find numbers' WHEN 5 THEN 'what is the employee name' WHEN 6 THEN 'What is the IFSC code?' ELSE 'tell me nothing in particular' END AS content FROM type_docs
UNION ALL SELECT doc_id, doc_id % 7, 1, 'assistant', 'I could not find that in this document.' FROM type_docs
UNION ALL SELECT doc_id, doc_id % 7, 2, 'user', 'Why?' FROM type_docs WHERE CAST(floor(doc_id / 6) AS INT) % 8 >= 6
""",
    "retention_index": r"""
SELECT o_orderkey AS document_id, o_custkey AS user_id, o_orderdate AS uploaded_at FROM orders
""",
    "retention_files": r"""
SELECT DISTINCT l_orderkey AS file_doc_id FROM lineitem WHERE l_orderkey % 9 <> 0
UNION ALL SELECT DISTINCT l_orderkey + 100000000 FROM lineitem WHERE l_orderkey % 50 = 0
""",
}

# Views each view builds on.
DEPENDS: dict[str, list[str]] = {
    "type_docs": ["kyc"],
    "form_docs": ["kyc"],
    "expected": ["kyc"],
    "qr_fields": ["kyc"],
    "questions": ["type_docs"],
    "dialogues": ["type_docs"],
}


def _closure(names: tuple[str, ...]) -> list[str]:
    wanted: list[str] = []
    for name in names:
        for needed in _closure(tuple(DEPENDS.get(name, []))) + [name]:
            if needed not in wanted:
                wanted.append(needed)
    return wanted


def with_views(*names: str) -> str:
    """``WITH`` prefix that defines the named views and what they build on."""
    return "WITH " + ",\n".join(f"{n} AS (\n{VIEWS[n].strip()}\n)" for n in _closure(names)) + "\n"


class Tables:
    """Driver tables and derived views of one data folder, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def driver(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name == "events":
            # stored without a zone; the session zone is not applied twice
            df = df.withColumn("ts", df["ts"].cast("timestamp"))
        return df

    def __getattr__(self, name: str) -> DataFrame:
        if name in DRIVER_TABLES:
            return self.driver(name)
        if name not in VIEWS:
            raise AttributeError(name)
        # tables are handed to the statement itself, so folders read side by side do not meet in the session's catalogue
        words = set(re.findall(r"\w+", "".join(VIEWS[n] for n in _closure((name,)))))
        tables = {f"src_{table}": self.driver(table) for table in DRIVER_TABLES if table in words}
        named = ",\n".join(f"{source.removeprefix('src_')} AS (SELECT * FROM {{{source}}})" for source in tables)
        return self.spark.sql(f"WITH {named},\n" + with_views(name).removeprefix("WITH ") + f"SELECT * FROM {name}", **tables)
