"""Derived documents for the arithmetic, travel document, licence and registration rules, and what the rules must find."""

from __future__ import annotations

CHECKED = """
, checked AS (
  SELECT doc_id, CASE CAST(floor(doc_id / 4) AS INT) % 6 WHEN 0 THEN 'salary_slip' WHEN 1 THEN 'bank_statement' WHEN 2 THEN 'passport' WHEN 3 THEN 'driving_licence'
      WHEN 4 THEN 'fssai' ELSE 'udyam' END AS doc_type,
    CAST(20000 + doc_id AS STRING) AS gross_salary, '500' AS total_deductions, CAST(19500 + doc_id - doc_id % 4 AS STRING) AS net_pay,
    '1000' AS opening_balance, CAST(doc_id % 1000 AS STRING) AS total_deposits, '100' AS total_withdrawals,
    CAST(900 + doc_id % 1000 + 2 * (doc_id % 4) AS STRING) AS closing_balance,
    'K' || lpad(CAST(doc_id AS STRING), 7, '0') AS passport_number,
    CASE doc_id % 4 WHEN 0 THEN rpad('P<INDSHARMA', 44, '<') || chr(10) || rpad('K1234567<8IND', 44, '<')
      WHEN 1 THEN rpad('X<INDSHARMA', 44, '<') || chr(10) || rpad('K1234567<8IND', 44, '<') WHEN 2 THEN 'P<INDSHARMA<<ROHIT' ELSE 'no zone' END AS full_text,
    CASE WHEN doc_id % 2 = 0 THEN 'MH12 2026' ELSE 'MH1-' END || lpad(CAST(doc_id AS STRING), 7, '0') AS licence_number,
    lpad(CAST(doc_id AS STRING), CAST(13 + doc_id % 2 AS INT), '1') AS fssai_licence_number,
    CASE WHEN doc_id % 2 = 0 THEN 'UDYAM-MH-01-' ELSE 'UDYAM-MH-1-' END || lpad(CAST(doc_id AS STRING), 7, '0') AS udyam_registration_number
  FROM kyc)
"""

CHECKED_FIELDS = {
    "salary_slip": ["gross_salary", "total_deductions", "net_pay"],
    "bank_statement": ["opening_balance", "total_deposits", "total_withdrawals", "closing_balance"],
    "passport": ["passport_number"], "driving_licence": ["licence_number"], "fssai": ["fssai_licence_number"],
    "udyam": ["udyam_registration_number"],
}

RULE_FINDINGS = CHECKED + """
SELECT doc_id, 'math_inconsistency' AS signal, 30 AS score, 'Salary arithmetic mismatch: Gross (' || gross_salary || '.0) minus Deductions (500.0) equals '
  || (19500 + doc_id) || '.0, but Net Pay is stated as ' || net_pay || '.0.' AS description FROM checked WHERE doc_type = 'salary_slip' AND doc_id % 4 = 3
UNION ALL SELECT doc_id, 'balance_inconsistency', 30, 'Running balance arithmetic mismatch: Opening (1000.0) + Credits (' || total_deposits || '.0) - Debits (100.0) equals '
  || (900 + doc_id % 1000) || '.0, but Closing Balance is ' || closing_balance || '.0.' FROM checked WHERE doc_type = 'bank_statement' AND doc_id % 4 = 3
UNION ALL SELECT doc_id, 'invalid_checksum', 30, 'Passport MRZ Line 1 does not conform to ICAO Doc 9303 standards.' FROM checked WHERE doc_type = 'passport' AND doc_id % 4 = 1
UNION ALL SELECT doc_id, 'invalid_checksum', 30, 'Passport Machine Readable Zone (MRZ) contains corrupted or incomplete lines.' FROM checked WHERE doc_type = 'passport' AND doc_id % 4 = 2
UNION ALL SELECT doc_id, 'invalid_checksum', 30, 'Driving Licence number ''' || licence_number || ''' does not match standardized state issuing format.'
  FROM checked WHERE doc_type = 'driving_licence' AND doc_id % 2 = 1
UNION ALL SELECT doc_id, 'invalid_checksum', 30, 'FSSAI license must be exactly 14 digits, found 13 digits.' FROM checked WHERE doc_type = 'fssai' AND doc_id % 2 = 0
UNION ALL SELECT doc_id, 'invalid_checksum', 30, 'Udyam registration number does not match standardized format UDYAM-XX-00-0000000.'
  FROM checked WHERE doc_type = 'udyam' AND doc_id % 2 = 1
"""
