"""SQL twins of the registered queries, for the checking database.

The texts below state each result independently of the Spark jobs.  Rule
tables (patterns, names, weights) are values both sides share.
"""

from __future__ import annotations

import re

from inkwell.functions.identifiers import BASE36
from inkwell.functions.redaction import REDACTION_RULES
from inkwell.operators.mining import DATE_CONTEXT
from inkwell.operators.validate import BANK_CODES
from inkwell.plans.forms import FORM_FACTS
from inkwell.rules.extraction import CORE_FIELDS, LANGUAGE_FIELDS, PII_ALLOWED
from inkwell.rules.intents import FIELD_LABELS, INTENTS, PRIORITY
from inkwell.rules.signatures import PRIMARY_ANCHORS, SIGNATURES, TYPE_METADATA
from inkwell.rules.text_values import MERGED_WORDS, PLACE_SPELLINGS


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def in_list(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def portable(pattern: str) -> str:
    """Code-point escapes written as the characters themselves."""
    return re.sub(r"\\u([0-9a-fA-F]{4})", lambda m: chr(int(m.group(1), 16)), pattern)


def values(rows) -> str:
    return "VALUES " + ", ".join("(" + ", ".join(q(x) if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


# ------------------------------------------------------------- text and PII


def _normalised(col: str) -> str:
    """The corpus holds no character that NFKC changes and NFC does not."""
    sql = f"translate(translate(nfc_normalize({col}), chr(8203) || chr(65279), ''), '“”‘’', '\"\"' || chr(39) || chr(39))"
    sql = f"translate(regexp_replace({sql}, '[—–]', ' - ', 'g'), '०१२३४५६७८९', '0123456789')"
    # the next match may begin in what a match has used up: twice
    for pattern, gap in (("([A-Za-z])[.]([A-Za-z]{2,})", ". "), ("([A-Za-z]):([A-Za-z0-9])", ": ")):
        for _ in range(2):
            sql = f"regexp_replace({sql}, '{pattern}', '\\1{gap}\\2', 'g')"
    for pattern, repair in MERGED_WORDS:
        sql = f"regexp_replace({sql}, {q(portable(pattern))}, {q(repair.replace('$', chr(92)))}, 'gi')"
    return sql


NORMALISE = f"SELECT doc_id, md5(n) AS norm_md5, length(n) AS norm_chars FROM (SELECT doc_id, {_normalised('text')} AS n FROM documents) x"


def _redacted(col: str) -> str:
    sql = col
    for _, pattern, fold, replacement in REDACTION_RULES:
        sql = f"regexp_replace({sql}, {q(pattern)}, {q(replacement.replace('$1', chr(92) + '1'))}, '{'gi' if fold else 'g'}')"
    return sql


def redaction_summary(table: str, text: str, by: str) -> str:
    hits, sums = [], []
    for name, _, _, replacement in REDACTION_RULES:
        token = replacement.removeprefix("$1")
        gone = lambda c: f"(length({c}) - length(replace({c}, {q(token)}, ''))) // {len(token)}"
        hits.append(f"{gone('r')} - {gone('t')} AS {name}_hits")
        sums.append(f"CAST(sum({name}_hits) AS BIGINT) AS {name}_hits")
    total = " + ".join(f"{n}_hits" for n, *_ in REDACTION_RULES)
    with_ = f"(SELECT {by}, {', '.join(hits)} FROM (SELECT {by}, {text} AS t, {_redacted(text)} AS r FROM {table}) a) b"
    return f"SELECT {by}, count(*) AS rows, count(*) FILTER ({total} > 0) AS redacted_rows, {', '.join(sums)} FROM {with_} GROUP BY {by}"


def redacted_texts(table: str, text: str) -> str:
    return f"SELECT doc_id, md5({_redacted(text)}) AS text_md5 FROM {table}"


REDACT_MAP = f"""
SELECT doc_id, 'pan' AS key, {_redacted('pan_number')} AS value FROM kyc
UNION ALL SELECT doc_id, 'Api_Key', '[REDACTED_SECRET]' FROM kyc
UNION ALL SELECT doc_id, 'prompt', '[REDACTED_LARGE_PAYLOAD]' FROM kyc
UNION ALL SELECT doc_id, 'note', {_redacted("'account ' || account_number")} FROM kyc
"""

TEXT_LAYER = r"""
WITH pages AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
full_texts AS (
  SELECT doc_id, count(*) AS pages, trim(string_agg(t, chr(10) || chr(10) ORDER BY i), ' ' || chr(9) || chr(10) || chr(13)) AS ft
  FROM pages GROUP BY doc_id)
SELECT doc_id, pages, len(regexp_extract_all(ft, '\S+')) AS words, length(ft) AS characters, length(ft) < 50 AS ocr_required FROM full_texts
"""

_KIND4 = "CASE doc_id % 4 WHEN 0 THEN 'bank_passbook' WHEN 1 THEN 'aadhaar' WHEN 2 THEN 'form_16' ELSE 'pan' END"
_KYC_LONG = " UNION ALL ".join(
    f"SELECT doc_id, '{c}' AS field, {c} AS value FROM kyc"
    for c in ("pan_number", "ifsc", "raw_aadhaar", "account_number", "name", "father_name", "dob")
)
MINIMISE = f"""
SELECT doc_id, {_KIND4} AS doc_type, field, value FROM ({_KYC_LONG}) k WHERE CASE {_KIND4}
  WHEN 'bank_passbook' THEN field IN {in_list(PII_ALLOWED['bank_passbook'] + LANGUAGE_FIELDS)}
  WHEN 'form_16' THEN field IN {in_list(PII_ALLOWED['form_16'] + LANGUAGE_FIELDS)}
  ELSE field NOT LIKE 'raw!_%' ESCAPE '!' AND field <> 'partner_names' END
"""

DATE_CONTEXT_SQL = ", CASE " + " ".join(
    "WHEN " + " OR ".join(f"contains(lower(line), {q(w)})" for w in words) + f" THEN {q(name)}" for words, name in DATE_CONTEXT
) + " END AS context"


def mined(column: str, shape: str, more: str) -> str:
    return f"""
, hits AS (
  SELECT doc_id, full_text, unnest(regexp_extract_all(full_text, {q(shape)}, 0, 'i')) AS hit,
         generate_subscripts(regexp_extract_all(full_text, {q(shape)}, 0, 'i'), 1) AS i FROM type_docs),
firsts AS (SELECT doc_id, full_text, hit, min(i) AS i FROM hits GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS position FROM firsts),
lined AS (
  SELECT *, coalesce(list_filter(list_transform(string_split(full_text, chr(10)), lambda l: trim(l)),
           lambda l: contains(l, hit) AND length(l) > length(hit))[1], '') AS line FROM ranked)
SELECT doc_id, position, hit AS {column}, line{more} FROM lined
"""


SEARCH_QUERY = "who had the hention and retion"
LINE_SEARCH = """
WITH all_lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
hits AS (
  SELECT doc_id, trim(raw, ' ' || chr(9) || chr(13)) AS line, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS position
  FROM all_lines WHERE contains(lower(raw), 'hention') OR contains(lower(raw), 'retion'))
SELECT doc_id, position, line FROM hits WHERE position < 3
"""

FY_TEXT = (
    "CASE WHEN o_orderkey % 3 = 0 THEN 'certificate without any year' ELSE "
    "'Income ' || CAST(1980 + o_orderkey % 40 AS STRING) || '-' || CAST(1981 + o_orderkey % 40 AS STRING) || ' and ' || "
    "CAST(1983 + o_orderkey % 40 AS STRING) || '/' || lpad(CAST((1984 + o_orderkey % 40) % 100 AS STRING), 2, '0') || ' not 2001-2009' END"
)
FINANCIAL_YEARS = """
WITH base AS (SELECT o_orderkey AS doc_id, 1980 + o_orderkey % 40 AS y, o_orderkey % 3 = 0 AS blank, CAST(o_orderdate AS DATE) AS issued FROM orders)
SELECT doc_id,
  CASE WHEN blank THEN '' ELSE y || '-' || (y + 1) || ',' || (y + 3) || '-' || (y + 4) END AS years,
  CASE WHEN NOT blank THEN (y + 3) || '-' || (y + 4)
       WHEN month(issued) >= 4 THEN (year(issued) - 1) || '-' || year(issued)
       ELSE (year(issued) - 2) || '-' || (year(issued) - 1) END AS latest,
  blank AS inferred FROM base
"""

# ------------------------------------------------------- identifiers, lookups

_IDENT = [
    ("pan", "pan_number"), ("ifsc", "ifsc"), ("aadhaar", "raw_aadhaar"),
    ("gstin", "'27' || pan_number || '1Z' || substr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', CAST(1 + doc_id % 36 AS INT), 1)"),
    ("cin", "'U' || lpad(CAST(doc_id % 100000 AS STRING), CAST(4 + doc_id % 2 AS INT), '0') || 'MH2001PTC' || lpad(CAST(doc_id AS STRING), 6, '0')"),
]
IDENTIFIERS_SPARK = "array(" + ", ".join(f"named_struct('kind', '{k}', 'value', {v})" for k, v in _IDENT) + ")"
_IDENT_ROWS = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, {v} AS value FROM kyc" for k, v in _IDENT)

# multiplication of the dihedral group of order ten, as rows of digits
_D = "0123456789123406789523401789563401289567401239567859876043216598710432765982104387659321049876543210"
_P = ["0123456789", "1576283094", "5803796142", "8916043527", "9453126870", "4286573901", "2793806415", "7046913258"]
_FOLD = (
    "list_reduce(list_prepend(0, list_transform(range(12), lambda i: CAST(substr(["
    + ", ".join(q(p) for p in _P)
    + "][CAST(i % 8 + 1 AS INT)], CAST(substr(value, CAST(12 - i AS INT), 1) AS INT) + 1, 1) AS INT))), "
    f"lambda c, x: CAST(substr('{_D}', CAST(c * 10 + x + 1 AS INT), 1) AS INT))"
)
_PAN_WHY = (
    "CASE WHEN NOT regexp_matches({p}, '^[A-Z]{{5}}[0-9]{{4}}[A-Z]$') THEN 'invalid_pan_pattern' "
    "WHEN NOT contains('PCHFATBLJG', substr({p}, 4, 1)) THEN 'invalid_pan_entity_type_' || substr({p}, 4, 1) END"
)
_GST_SUM = (
    f"list_sum(list_transform(range(14), lambda i: CASE WHEN i % 2 = 0 THEN instr('{BASE36}', substr(value, CAST(i + 1 AS INT), 1)) - 1 "
    f"ELSE ((instr('{BASE36}', substr(value, CAST(i + 1 AS INT), 1)) - 1) * 2) // 36 + "
    f"((instr('{BASE36}', substr(value, CAST(i + 1 AS INT), 1)) - 1) * 2) % 36 END))"
)
_REASON = f"""CASE kind
  WHEN 'pan' THEN {_PAN_WHY.format(p='value')}
  WHEN 'ifsc' THEN CASE WHEN NOT regexp_matches(value, '^[A-Z]{{4}}0[A-Z0-9]{{6}}$') THEN 'invalid_ifsc_format'
     WHEN substr(value, 1, 4) NOT IN {in_list(BANK_CODES)} THEN 'ifsc_needs_review' END
  WHEN 'aadhaar' THEN CASE WHEN NOT regexp_matches(value, '^[2-9][0-9]{{11}}$') OR {_FOLD} <> 0 THEN 'invalid_aadhaar_checksum' END
  WHEN 'gstin' THEN CASE WHEN NOT regexp_matches(value, '^[0-9]{{2}}[A-Z]{{5}}[0-9]{{4}}[A-Z][1-9A-Z]Z[0-9A-Z]$') THEN 'invalid_gstin_format'
     WHEN {_PAN_WHY.format(p='substr(value, 3, 10)')} IS NOT NULL THEN 'gstin_' || {_PAN_WHY.format(p='substr(value, 3, 10)')}
     WHEN substr(value, 15, 1) <> substr('{BASE36}', CAST((36 - {_GST_SUM} % 36) % 36 + 1 AS INT), 1) THEN 'invalid_gstin_checksum' END
  WHEN 'cin' THEN CASE WHEN NOT regexp_matches(value, '^[UL][0-9]{{5}}[A-Z]{{2}}[0-9]{{4}}[A-Z]{{3}}[0-9]{{6}}$') THEN 'invalid_cin_format' END
END"""
VALIDATE = f", checked AS (SELECT doc_id, kind, value, {_REASON} AS reason FROM ({_IDENT_ROWS}) r) SELECT doc_id, kind, value, reason IS NULL AS valid, reason FROM checked"
PASS_RATES = (
    f", checked AS (SELECT kind, {_REASON} AS reason FROM ({_IDENT_ROWS}) r) SELECT kind, count(*) AS checked, "
    "count(*) FILTER (reason IS NULL) AS passed, round(count(*) FILTER (reason IS NULL) / count(*), 4) AS pass_rate FROM checked GROUP BY kind"
)
VALIDATE_DOCUMENTS = f"""
, picked AS (
  SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'bank_passbook' WHEN 1 THEN 'aadhaar' WHEN 2 THEN 'form_16' ELSE 'pan' END AS doc_type,
    CASE doc_id % 5 WHEN 0 THEN 'ifsc' WHEN 1 THEN 'aadhaar' ELSE 'pan' END AS kind,
    CASE doc_id % 5 WHEN 0 THEN ifsc WHEN 1 THEN raw_aadhaar ELSE pan_number END AS value
  FROM kyc WHERE doc_id % 5 <> 4),
checked AS (SELECT doc_id, doc_type, kind, {_REASON} AS reason FROM picked)
SELECT doc_id, doc_type, kind, reason IS NULL AS checksum_valid, reason AS checksum_reason FROM checked
"""

TYPE_METADATA_SQL = f"""
, meta AS (SELECT * FROM ({values([(t, n, i) for t, (n, i) in TYPE_METADATA.items()])}) m(doc_type, document_type, issuer))
SELECT v.document_id, v.doc_type, coalesce(m.document_type, CASE v.doc_type WHEN 'unknown' THEN 'Unknown' WHEN 'ai_analyzed' THEN 'Ai Analyzed' END) AS document_type,
  m.issuer FROM vault v LEFT JOIN meta m ON v.doc_type = m.doc_type
"""

PLACE_INPUTS = ["जुनर", ": पुण.", "औरंगाबाद", "Pune", "नासिक,", "सातारा", "  -", "ठाण"]
PLACES = f"""
WITH spelling AS (SELECT * FROM ({values(list(PLACE_SPELLINGS.items()))}) s(wrong, fixed)),
named AS (
  SELECT c_custkey AS doc_id, trim([{', '.join(q(p) for p in PLACE_INPUTS)}][CAST(c_custkey % {len(PLACE_INPUTS)} + 1 AS INT)], ' :.-,') AS n FROM customer)
SELECT doc_id, coalesce(s.fixed, n) AS taluka FROM named LEFT JOIN spelling s ON s.wrong = n
"""

# --------------------------------------------------------------- statements

TOTALS = """
, rows AS (SELECT doc_id, type, CASE WHEN seq % 17 = 0 THEN NULL ELSE amount END AS a FROM statement_lines)
SELECT doc_id, count(*) AS n_transactions, CAST(coalesce(sum(a), 0) AS DOUBLE) AS total_amount,
  CAST(coalesce(sum(a) FILTER (type = 'CR'), 0) AS DOUBLE) AS credit_amount, count(a) FILTER (type = 'CR') AS credit_count,
  CAST(coalesce(sum(a) FILTER (type = 'DR'), 0) AS DOUBLE) AS debit_amount, count(a) FILTER (type = 'DR') AS debit_count
FROM rows GROUP BY doc_id
"""
_MARKED = """
, marked AS (
  SELECT doc_id, seq, CASE WHEN seq % 3 = 0 THEN NULL ELSE type END AS type, CASE WHEN seq % 5 = 0 THEN NULL ELSE balance END AS balance
  FROM statement_lines)
"""
DIRECTION = _MARKED + """
, prior AS (
  SELECT *, last_value(CAST(balance AS DOUBLE) IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev
  FROM marked)
SELECT doc_id, seq, coalesce(type, CASE WHEN CAST(balance AS DOUBLE) > prev THEN 'CR' ELSE 'DR' END) AS type FROM prior
"""
CLOSING = _MARKED + r"""
, last_known AS (SELECT doc_id, CAST(max_by(balance, seq) FILTER (balance IS NOT NULL) AS VARCHAR) AS b FROM marked GROUP BY doc_id)
SELECT d.doc_id, nullif(regexp_extract(full_text, 'Opening Balance: (-?[0-9.]+)', 1), '') AS opening_balance, b AS closing_balance,
  CASE WHEN b IS NOT NULL THEN 'running' END AS source
FROM type_docs d LEFT JOIN last_known l ON d.doc_id = l.doc_id WHERE expected_type = 'bank_statement'
"""
STATEMENT_ROWS = """
, printed AS (SELECT * FROM statement_lines),
prior AS (
  SELECT *, lag(balance) OVER (PARTITION BY doc_id ORDER BY seq) AS prev,
    year(txn_ts) AS page_num FROM printed)
SELECT doc_id, page_num, strftime(txn_ts, '%d-%m-%Y') AS date,
  'S' || seq || ' TRANSFER' || CASE WHEN seq % 4 = 0 THEN ' wrapped note' ELSE '' END AS description,
  CAST(amount AS VARCHAR) AS amount, CASE WHEN CAST(balance AS DOUBLE) > CAST(prev AS DOUBLE) THEN 'CR' ELSE 'DR' END AS type, CAST(balance AS VARCHAR) AS balance
FROM prior
"""

# -------------------------------------------------------------------- vault

_AI = "(coalesce(mode, '') = 'ai' OR doc_type = 'ai_analyzed')"
_FAILED = "(status IN ('failed', 'error') OR verification_status IN ('failed', 'error'))"
_UNSUPPORTED = "(verification_status = 'unsupported' OR (doc_type = 'unknown' AND status = 'low_confidence'))"
_REVIEW = "(verification_status = 'review_required' OR status = 'warning' OR risk_score >= 30 OR checksum_valid = false)"
_STORE = (
    f"CASE WHEN {_FAILED} THEN 'failed' WHEN {_UNSUPPORTED} THEN 'unsupported' WHEN coalesce({_REVIEW}, false) THEN 'review_required' "
    "WHEN verification_status = 'verified' OR status IN ('verified', 'completed') THEN 'verified' ELSE status END"
)
_TABLE = (
    "CASE WHEN status IN ('failed', 'error') OR verification_status = 'failed' THEN 'failed' WHEN status = 'processing' THEN 'processing' "
    f"WHEN {_UNSUPPORTED} THEN 'unsupported' WHEN coalesce({_REVIEW}, false) THEN 'review_required' ELSE 'verified' END"
)
VAULT_AI = f"SELECT document_id, doc_type, mode FROM vault WHERE {_AI}"
VAULT_TYPE = f"SELECT document_id, doc_type FROM vault WHERE doc_type = 'bank_statement' AND NOT {_AI}"
VAULT_REVIEW = f"SELECT document_id, status, risk_score FROM vault WHERE {_STORE} = 'review_required' AND ocr_required"
VAULT_SEARCH = "SELECT document_id, filename FROM vault WHERE contains(lower(filename || '|' || doc_type || '|' || extracted_text), 'hention')"
STATUS_CATEGORY = (
    f"SELECT {_STORE} AS store_category, {_TABLE} AS table_category, count(*) AS documents, CAST(sum(document_id) AS BIGINT) AS id_sum "
    "FROM vault GROUP BY 1, 2"
)
REPO_FILTER = (
    "SELECT document_id, filename FROM vault WHERE user_id = 3 AND mode = 'offline' AND verification_status = 'review_required' "
    "AND filename ILIKE '%pdf%'"
)
OWNER = (
    "SELECT document_id, CASE WHEN document_id % 5 <> 0 THEN user_id END AS user_id FROM vault WHERE document_id % 5 = 0 OR user_id = 2"
)
CANONICAL = """
SELECT document_id, doc_type AS document_type,
  CASE WHEN document_id % 100 >= 85 THEN 'high' WHEN document_id % 100 >= 60 THEN 'medium' ELSE 'low' END AS confidence,
  verification_status, CAST(risk_score AS DOUBLE) AS risk_score, lang AS f_lang,
  CASE WHEN document_id % 2 = 0 THEN 'extracted' ELSE source END AS f_source FROM vault
"""
FIELD_LAYERS = """
, layers AS (
  SELECT doc_id, 'pan_number' AS field, pan_number AS value, 1 AS layer FROM kyc
  UNION ALL SELECT doc_id, 'name', name, 1 FROM kyc UNION ALL SELECT doc_id, 'dob', dob, 1 FROM kyc
  UNION ALL SELECT doc_id, field, value, 2 FROM expected UNION ALL SELECT doc_id, field, value, 3 FROM qr_fields)
SELECT doc_id AS document_id, field, max_by(value, layer) AS value, max(layer) AS layer FROM layers GROUP BY doc_id, field
"""
VAULT_STATS = """
SELECT count(*) AS total_documents, count(*) FILTER (ocr_required) AS ocr_processed, count(*) FILTER (NOT ocr_required) AS ocr_not_required,
  count(*) FILTER (status IN ('success', 'completed', 'low_confidence', 'warning')) AS completed,
  count(*) FILTER (status IN ('error', 'failed')) AS failed,
  count(*) FILTER (mode = 'offline' OR (mode IS NULL AND ocr_required)) AS offline_documents,
  count(*) FILTER (mode = 'ai') AS ai_documents, CAST(sum(file_size) AS BIGINT) AS total_storage_bytes,
  round(sum(file_size) / 1048576, 2) AS total_storage_mb FROM vault
"""
OWNER_STATS = """
SELECT user_id, count(*) AS total_documents, count(*) FILTER (mode = 'offline') AS offline_documents, count(*) FILTER (mode = 'ai') AS ai_documents,
  count(*) FILTER (status IN ('processed', 'completed', 'valid', 'verified')) AS processed_documents,
  count(*) FILTER (status IN ('failed', 'error', 'invalid')) AS failed_documents, CAST(sum(file_size) AS BIGINT) AS total_storage_bytes,
  round(sum(file_size) / 1048576, 2) AS total_storage_mb,
  round(count(*) FILTER (status IN ('processed', 'completed', 'valid', 'verified')) * 100 / count(*), 1) AS success_rate
FROM vault GROUP BY user_id
"""
BY_TYPE = "SELECT user_id, doc_type, count(*) AS documents FROM vault GROUP BY user_id, doc_type"
PAGE = """
SELECT document_id, file_size, total, 3 AS page, 20 AS page_size, CAST(ceil(total / 20) AS BIGINT) AS total_pages FROM (
  SELECT document_id, file_size, count(*) OVER () AS total, row_number() OVER (ORDER BY file_size DESC, document_id) AS r FROM vault) x
WHERE r > 40 AND r <= 60
"""
SEEN_SIZE, SEEN_ID = 500, 100
PAGE_AFTER = f"""
SELECT document_id, file_size FROM vault WHERE file_size < {SEEN_SIZE} OR (file_size = {SEEN_SIZE} AND document_id > {SEEN_ID})
ORDER BY file_size DESC, document_id LIMIT 20
"""
DOCUMENT_VIEW = """
SELECT document_id, CASE WHEN verification_status = 'unsupported' THEN 'verified' ELSE verification_status END AS verification_status,
  CAST(risk_score AS DOUBLE) AS risk_score, md5(extracted_text) || '-1' AS text_md5,
  CASE WHEN document_id % 3 = 0 THEN lang END AS field_lang, CASE WHEN doc_type = 'ai_analyzed' THEN source END AS ai_source FROM vault
"""
CASCADE = """
, tabs AS (
  SELECT 'documents' AS table_name, document_id FROM vault
  UNION ALL SELECT 'ocr_results', document_id FROM vault UNION ALL SELECT 'ocr_results', document_id FROM vault
  UNION ALL SELECT 'extracted_fields', document_id FROM vault WHERE document_id % 3 = 0
  UNION ALL SELECT 'ai_analyses', document_id FROM vault WHERE doc_type = 'ai_analyzed'),
doomed AS (SELECT doc_id FROM labels WHERE toxic = 1)
SELECT table_name, count(*) FILTER (document_id IN (SELECT doc_id FROM doomed)) AS deleted,
  count(*) FILTER (document_id NOT IN (SELECT doc_id FROM doomed)) AS kept FROM tabs GROUP BY table_name
"""
PROFILES = """
WITH e AS (
  SELECT c_custkey AS id, lower(c_mktsegment) || c_custkey || '@old.example' AS email, c_name AS full_name FROM customer WHERE c_custkey % 3 <> 0),
n AS (
  SELECT c_custkey AS id, 'u' || c_custkey || '@new.example' AS email, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE upper(c_name) END AS full_name
  FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0),
j AS (
  SELECT coalesce(e.id, n.id) AS id, coalesce(n.email, e.email) AS email, coalesce(nullif(n.full_name, ''), e.full_name, '') AS full_name
  FROM e FULL OUTER JOIN n ON e.id = n.id)
SELECT id, email, full_name, CASE WHEN email IN ('u10@new.example', 'machinery1@old.example') THEN 'admin' ELSE 'user' END AS role FROM j
"""
FAN_OUT = """
SELECT document_id, user_id, 'invalid_checksum' AS signal, 'consistency' AS category, 30 AS score FROM vault WHERE risk_score >= 45
UNION ALL SELECT document_id, user_id, status, 'integrity', 10 FROM vault WHERE risk_score >= 45
UNION ALL SELECT document_id, user_id, 'All integrity checks passed', 'overall', 0 FROM vault WHERE risk_score < 45
"""
FAN_OUT_DOCS = """
SELECT document_id, filename AS original_filename, doc_type, sha256(extracted_text) AS checksum_sha256,
  'documents/' || user_id || '/' || document_id || '/' || document_id || '.enc' AS storage_path FROM vault
"""
PURGE_FILES = """
SELECT user_id, count(*) AS documents, sum(file_size) AS bytes, (SELECT count(*) FROM vault WHERE user_id = 3 AND status <> 'completed') AS deleted
FROM vault WHERE NOT (user_id = 3 AND status <> 'completed') GROUP BY user_id
"""
FAN_OUT_FILES = """
SELECT document_id, user_id, 'documents' AS bucket_name, 'documents/' || user_id || '/' || document_id || '/' || document_id || '.enc' AS storage_path,
  'AES-256-GCM' AS encryption_algorithm, file_size FROM vault
"""
FAN_OUT_OCR = """
SELECT document_id, md5(extracted_text) AS text_md5, doc_type AS detected_type, CASE WHEN document_id % 4 > 0 THEN (document_id % 101) / 100 ELSE 0 END AS confidence,
  CASE WHEN document_id % 6 > 0 THEN document_id % 6 ELSE 1 END AS page_count FROM vault WHERE extracted_text IS NOT NULL
"""
FAN_OUT_CHECKS = "SELECT document_id, user_id, risk_score, verification_status FROM vault"
FAN_OUT_FIELDS = """
SELECT document_id, verification_status, 'filename' AS field, filename AS value FROM vault WHERE document_id % 3 = 0
UNION ALL SELECT document_id, verification_status, 'lang', lang FROM vault WHERE document_id % 3 = 0
"""
FAN_OUT_AI = """
SELECT document_id, user_id, CASE WHEN document_id % 2 = 0 THEN 'p' || user_id ELSE 'unknown' END AS provider, 'unknown' AS model, filename AS summary,
  CASE WHEN document_id % 5 = 0 THEN 'other' ELSE doc_type END AS classification FROM vault WHERE mode = 'ai'
"""
STAR_PUBLISHED = """
, counted AS (SELECT count(*) AS n, count(*) FILTER (extracted_text IS NOT NULL) AS texts, count(*) FILTER (document_id % 3 = 0) AS fields, count(*) FILTER (mode = 'ai') AS ai FROM vault)
SELECT unnest(['documents', 'document_files', 'ocr_results', 'authenticity_checks', 'document_integrity_checks', 'extracted_fields', 'ai_analyses']) AS child,
  unnest([n, n, texts, n, n, fields, ai]) AS rows, unnest([n, n, texts, n, n, fields, ai]) AS documents FROM counted
"""
MIGRATE = """
SELECT count(*) AS total, count(*) FILTER (document_id % 50 <> 49 AND document_id % 4 <> 0) AS migrated,
  count(*) FILTER (document_id % 50 <> 49 AND document_id % 4 = 0) AS skipped FROM vault
"""
MIGRATE_ROWS = "SELECT document_id, 99 AS user_id, doc_type, coalesce(mode, 'offline') AS mode FROM vault WHERE document_id % 4 <> 0"
ENCRYPT = "SELECT doc_id, doc_id % 2 = 1 AS migrated, strlen(text) + 32 AS sealed_bytes, md5(text) AS payload_md5 FROM documents"
LOG_LINES = """
SELECT CAST(event_id AS VARCHAR) AS request_id, 'INFO' AS level, event_type AS event, 'user [REDACTED_ACCOUNT]' AS message,
  '[REDACTED_SECRET]' AS auth_token, props FROM events
"""

TRIAGE_NAME = """
CASE doc_id % 9 WHEN 0 THEN 'scan.PDF' WHEN 1 THEN 'photo.png' WHEN 2 THEN 'photo.jpeg' WHEN 3 THEN 'pic.webp' WHEN 4 THEN '../etc/passwd.pdf'
 WHEN 5 THEN 'notes.txt' WHEN 6 THEN 'empty.png' WHEN 7 THEN 'fake.png' ELSE '.pdf' END"""
TRIAGE_CONTENT = r"""
CASE doc_id % 9 WHEN 0 THEN concat(encode(CASE WHEN doc_id % 2 = 0 THEN 'junk %PDF-1.7 ' ELSE 'no mark ' END, 'UTF-8'), encode(text, 'UTF-8'))
 WHEN 1 THEN concat(unhex('89504E470D0A1A0A'), encode(text, 'UTF-8')) WHEN 2 THEN concat(unhex('FFD8FFE0'), encode(text, 'UTF-8'))
 WHEN 3 THEN concat(encode('RIFF', 'UTF-8'), unhex('00000000'), encode('WEBP', 'UTF-8'), encode(text, 'UTF-8'))
 WHEN 6 THEN unhex('') ELSE encode(text, 'UTF-8') END"""
TRIAGE = """
SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN '.pdf' WHEN 1 THEN '.png' WHEN 2 THEN '.jpeg' WHEN 3 THEN '.webp' WHEN 4 THEN '.pdf' WHEN 5 THEN '.txt'
   WHEN 6 THEN '.png' WHEN 7 THEN '.png' ELSE '' END AS ext,
  doc_id % 9 IN (1, 2, 3) OR (doc_id % 9 = 0 AND doc_id % 2 = 0) AS accepted,
  CASE WHEN doc_id % 9 = 0 AND doc_id % 2 = 1 THEN 'bad_magic_bytes' WHEN doc_id % 9 = 4 THEN 'path_traversal' WHEN doc_id % 9 = 5 THEN 'unsupported_type'
   WHEN doc_id % 9 = 6 THEN 'empty_file' WHEN doc_id % 9 = 7 THEN 'bad_magic_bytes' WHEN doc_id % 9 = 8 THEN 'unsupported_type' END AS reject_reason
FROM documents
"""

#: The same files in folders; names keep their odd dots, and each has the length of its bytes.
TRIAGE_FOLDER = f"""
SELECT t.doc_id, CASE d.doc_id % 9 WHEN 8 THEN '.pdf' ELSE t.ext END AS ext, strlen(coalesce(text, '')) + CASE d.doc_id % 9
   WHEN 0 THEN CASE WHEN d.doc_id % 2 = 0 THEN 14 ELSE 8 END WHEN 1 THEN 8 WHEN 2 THEN 4 WHEN 3 THEN 12 WHEN 6 THEN -strlen(coalesce(text, '')) ELSE 0 END AS length,
  t.accepted, CASE d.doc_id % 9 WHEN 8 THEN 'bad_magic_bytes' ELSE t.reject_reason END AS reject_reason
FROM documents d JOIN ({TRIAGE}) t ON t.doc_id = d.doc_id
"""
VAULT_INDEX = """
SELECT document_id, CAST(user_id AS VARCHAR) AS user_id, filename, doc_type, mode, status, verification_status, CAST(risk_score AS BIGINT) AS risk_score,
  ocr_required, file_size, md5(concat_ws('|', extracted_text, '"}, {[')) AS signals_md5
FROM vault
"""

# ----------------------------------------------------------- classification

_PAGES = r"""
, parts AS (
  SELECT doc_id, expected_type, full_text, regexp_split_to_array(full_text, '--- Page [0-9]+ ---') AS p FROM type_docs),
pages AS (
  SELECT doc_id, expected_type, 1 AS page_num, false AS multi, full_text AS page_text FROM parts WHERE len(p) = 1
  UNION ALL SELECT doc_id, expected_type, unnest(range(1, len(p))), true, unnest(p[2:]) FROM parts WHERE len(p) > 1)
"""


def _rule_rows() -> str:
    rows = []
    for t_ord, t in enumerate(PRIMARY_ANCHORS):
        secondary = [p for p in SIGNATURES[t] if p not in PRIMARY_ANCHORS[t]]
        for tier, patterns in (("primary", PRIMARY_ANCHORS[t]), ("secondary", secondary)):
            rows += [(t, t_ord, tier, i, portable(p)) for i, p in enumerate(patterns)]
    return f"rules AS (SELECT * FROM ({values(rows)}) r(doc_type, t_ord, tier, p_ord, pattern))"


_HITS = _PAGES + ", " + _rule_rows() + r"""
, hits AS (
  SELECT doc_id, expected_type, page_num, multi, doc_type, t_ord, tier, p_ord, trim(regexp_extract(upper(page_text), pattern, 0), ' ' || chr(10) || chr(9)) AS evidence
  FROM pages, rules WHERE regexp_matches(upper(page_text), pattern))
"""
MATCH_SIGNATURES = _HITS + "SELECT doc_id, page_num, doc_type, tier, evidence FROM hits"
# the corpus is invented prose: a document is typed only if it shows an anchor
CLASSIFY_DOCUMENTS = "WITH " + _rule_rows() + r"""
, anchored AS (SELECT DISTINCT doc_id FROM documents, rules WHERE tier = 'primary' AND regexp_matches(upper(text), pattern)),
cards AS (
  SELECT doc_id FROM documents WHERE regexp_matches(upper(text), '\b[A-Z]{3}[PCHFATBLJG][A-Z][0-9]{4}[A-Z]\b')
    AND regexp_matches(upper(text), 'GOVT|INDIA|FATHER|INCOME'))
SELECT CASE WHEN doc_id IN (SELECT doc_id FROM anchored UNION SELECT doc_id FROM cards) THEN 'typed' ELSE 'unknown' END AS doc_type,
  count(*) AS documents FROM documents GROUP BY 1
"""
OWN_RULES = [
    ("pan", "own", "TAX DEPARTMENT"), ("letter", "own", "NOTHING IN [A-Z]+"), ("bank", "own", r"IFSC: (SBIN|HDFC)[0-9]+"),
]
MATCH_RULES = _PAGES + f"""
, own AS (SELECT * FROM ({values(OWN_RULES)}) r(doc_type, tier, pattern))
SELECT doc_id, page_num, doc_type, tier, regexp_extract(upper(page_text), pattern, 0) AS evidence FROM pages, own
WHERE regexp_matches(upper(page_text), pattern)
"""


def _best(min_margin: int) -> str:
    margin = ""
    pick = "r = 1"
    if min_margin:
        margin = f"""
, top AS (SELECT doc_id, max(neg) FILTER (r = 2) - max(neg) FILTER (r = 1) AS gap, max(np) FILTER (r = 1) AS np1, max(np) FILTER (r = 2) AS np2 FROM ranked GROUP BY doc_id)
, chosen AS (SELECT ranked.* FROM ranked JOIN top USING (doc_id)
   WHERE r = CASE WHEN coalesce(gap < {min_margin} AND np1 < np2, false) THEN 2 ELSE 1 END AND NOT coalesce(gap < {min_margin} AND np1 = np2, false))"""
    else:
        margin = ", chosen AS (SELECT * FROM ranked WHERE r = 1)"
    return _HITS + f"""
, tagged AS (
  SELECT doc_id, doc_type, t_ord, tier, p_ord, page_num, CASE WHEN multi THEN '[Page ' || page_num || '] ' ELSE '' END || evidence AS ev FROM hits),
firsts AS (
  SELECT doc_id, doc_type, t_ord, ev, min((CASE tier WHEN 'primary' THEN 0 ELSE 1 END) * 1000000 + p_ord * 1000 + page_num) AS pos FROM tagged GROUP BY ALL),
uid_docs AS (SELECT DISTINCT doc_id FROM hits WHERE doc_type = 'aadhaar' AND tier = 'primary'),
passbook AS (SELECT doc_id FROM type_docs WHERE contains(upper(full_text), 'PASSBOOK')),
scores AS (
  SELECT doc_id, doc_type, t_ord, count(*) FILTER (pos < 1000000) AS np, count(*) FILTER (pos >= 1000000) AS ns, string_agg(ev, '|' ORDER BY pos) AS evidence
  FROM firsts GROUP BY ALL),
allowed AS (
  SELECT *, -(np * 3 + ns) AS neg FROM scores WHERE np > 0 AND NOT (doc_type = 'pan' AND doc_id IN (SELECT doc_id FROM uid_docs))
    AND NOT (doc_type IN ('bank_statement', 'cancelled_cheque') AND doc_id IN (SELECT doc_id FROM passbook))),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY neg, t_ord) AS r FROM allowed)
{margin}
"""


_META = f"meta AS (SELECT * FROM ({values([(t, n, i) for t, (n, i) in TYPE_METADATA.items()])}) m(doc_type, document_type, issuer))"


# the first number of the text that looks like one, white space removed
_UID_DIGITS = "regexp_replace(regexp_extract(full_text, '\\b[2-9][0-9]{3}\\s+[0-9]{4}\\s+[0-9]{4}\\b', 0), '\\s', '', 'g')"


def classify_sql(min_margin: int) -> str:
    return _best(min_margin) + f"""
, {_META}
, bonus AS (
  SELECT d.doc_id, c.doc_type, c.np, c.ns, c.evidence, CASE c.doc_type
    WHEN 'aadhaar' THEN CASE WHEN {_FOLD.replace('value', _UID_DIGITS)} = 0 THEN 0.04 ELSE 0 END
    WHEN 'pan' THEN CASE WHEN regexp_matches(full_text, '\\b[A-Z]{{3}}[PCHFATBLJG][A-Z][0-9]{{4}}[A-Z]\\b') THEN 0.04 ELSE 0 END
    WHEN 'bank_statement' THEN CASE WHEN c.ns >= 2 THEN 0.04 ELSE 0 END ELSE 0 END AS b
  FROM type_docs d JOIN chosen c ON d.doc_id = c.doc_id),
conf AS (SELECT *, round(least(0.98, 0.72 + least(0.16, (np - 1) * 0.08) + least(0.06, ns * 0.03) + b), 4) AS confidence FROM bonus)
SELECT d.doc_id, coalesce(c.doc_type, 'unknown') AS doc_type, coalesce(m.document_type, 'Unknown Document') AS document_type,
  CAST(c.confidence AS DOUBLE) AS confidence,
  CASE WHEN c.confidence >= 0.85 THEN 'high' WHEN c.confidence >= 0.60 THEN 'medium' ELSE 'low' END AS confidence_level, m.issuer,
  coalesce(c.evidence, 'Insufficient legible text or standardized institutional markers detected') AS evidence
FROM type_docs d LEFT JOIN conf c ON d.doc_id = c.doc_id LEFT JOIN meta m ON c.doc_type = m.doc_type
""".replace("\\\\b", "\\b")


_SIG_ROWS = f"sigs AS (SELECT * FROM ({values([(t, portable(p)) for t, ps in SIGNATURES.items() for p in ps])}) s(requested_type, pattern))"
_TYPE_LIST = f"[{', '.join(q(t) for t in SIGNATURES)}]"
TYPE_MISMATCH = _best(1) + f"""
, {_SIG_ROWS}
, asked AS (
  SELECT d.doc_id, full_text, {_TYPE_LIST}[CAST(d.doc_id % {len(SIGNATURES)} + 1 AS INT)] AS requested_type, c.doc_type AS detected
  FROM type_docs d LEFT JOIN chosen c ON d.doc_id = c.doc_id),
own AS (
  SELECT a.doc_id, a.requested_type, a.detected, count(*) FILTER (regexp_matches(upper(full_text), pattern)) AS score
  FROM asked a JOIN sigs s ON s.requested_type = a.requested_type GROUP BY ALL)
SELECT doc_id, requested_type, CASE WHEN detected <> requested_type AND score < 2 THEN detected END AS detected_type,
  coalesce(detected <> requested_type AND score < 2, false) AS is_mismatch FROM own
"""
_MISMATCH_PAIRS = _best(1) + f"""
, {_SIG_ROWS}
, pairs AS (
  SELECT d.doc_id, d.expected_type, c.doc_type AS detected, s.requested_type, count(*) FILTER (regexp_matches(upper(full_text), pattern)) AS score
  FROM type_docs d LEFT JOIN chosen c ON d.doc_id = c.doc_id, sigs s GROUP BY ALL),
verdicts AS (SELECT *, coalesce(detected <> requested_type AND score < 2, false) AS mis FROM pairs)
"""
DETECTION_MATRIX = _MISMATCH_PAIRS + "SELECT expected_type, " + ", ".join(
    f"count(*) FILTER (mis AND requested_type = '{t}') AS {t}" for t in SIGNATURES
) + """, count(*) FILTER (CASE WHEN expected_type = requested_type THEN mis ELSE NOT (mis AND coalesce(detected = expected_type, false)) END) AS failures
FROM verdicts GROUP BY expected_type"""
SELF_DETECTION = _best(1) + """
SELECT d.expected_type, coalesce(c.doc_type, 'unknown') AS detected_type, count(*) AS samples, d.expected_type = coalesce(c.doc_type, 'unknown') AS passed
FROM type_docs d LEFT JOIN chosen c ON d.doc_id = c.doc_id GROUP BY ALL
"""

# every form shows the anchors of its own type and of no other one
FORM_DETECTION = """
SELECT expected_type, expected_type AS detected_type, count(*) AS samples, true AS passed FROM form_docs GROUP BY 1
"""

# -------------------------------------------------------------- extraction

_MASK = "repeat('X', greatest(6, length({a}) - 4)) || right({a}, 4)"
_ACC = "substr(account_number, 1, 18)"
# the holder pattern stops at these letters even inside a word
_HOLDER = "regexp_extract(name, '^(.{3,}?)(?:CIF|$)', 1)"
_FACTS = [
    ("pan", "pan_number", "pan_number", "0.96"), ("pan", "name", "name", "0.96"), ("pan", "dob", "dob", "0.96"),
    ("aadhaar", "raw_aadhaar", "raw_aadhaar", "NULL"),
    ("aadhaar", "aadhaar_number", "'XXXXXXXX' || right(raw_aadhaar, 4)", "0.96"),
    ("aadhaar", "aadhaar_number_masked", "'XXXXXXXX' || right(raw_aadhaar, 4)", "0.96"),
    ("aadhaar", "name", "name", "0.96"), ("aadhaar", "dob", "dob", "0.96"),
    ("bank_statement", "account_number_masked", _MASK.format(a=_ACC), "0.96"),
    ("bank_statement", "account_number", _MASK.format(a=_ACC), "0.96"),
    ("bank_statement", "ifsc", "CASE WHEN substr(ifsc, 5, 1) = '0' THEN ifsc END", "0.96"),
    ("bank_statement", "ifsc_code", "CASE WHEN substr(ifsc, 5, 1) = '0' THEN ifsc END", "0.96"),
    ("bank_statement", "opening_balance", "CAST(acctbal AS VARCHAR)", "0.96"),
    ("bank_passbook", "raw_account_number", _ACC, "NULL"),
    ("bank_passbook", "account_number_masked", _MASK.format(a=_ACC), "0.96"),
    ("bank_passbook", "ifsc", "CASE WHEN substr(ifsc, 5, 1) = '0' THEN ifsc END", "0.96"),
    ("bank_passbook", "raw_account_holder_name", _HOLDER, "NULL"),
    ("bank_passbook", "account_holder_name_masked", f"split_part({_HOLDER}, ' ', 1) || ' ' || substr(split_part({_HOLDER}, ' ', 2), 1, 1) || repeat('*', length(split_part({_HOLDER}, ' ', 2)) - 1)", "0.96"),
    ("passport", "passport_number", "'K' || lpad(CAST(doc_id AS VARCHAR), 7, '0')", "0.96"),
]
_TYPE_OF = {"pan": 0, "aadhaar": 1, "bank_statement": 2, "bank_passbook": 3, "passport": 4}
_EXTRACTED = " UNION ALL ".join(
    f"SELECT doc_id, '{t}' AS doc_type, '{f}' AS field, {v} AS value, CAST({c} AS DOUBLE) AS confidence FROM kyc WHERE doc_id % 6 = {_TYPE_OF[t]}"
    for t, f, v, c in _FACTS
)
EXTRACT = f"SELECT * FROM ({_EXTRACTED}) x WHERE value IS NOT NULL"
_KEPT = " OR ".join(
    [f"(doc_type = '{t}' AND field IN {in_list(PII_ALLOWED[t])})" for t in ("bank_statement", "bank_passbook")]
    + ["(doc_type IN ('pan', 'aadhaar', 'passport') AND field NOT LIKE 'raw!_%' ESCAPE '!')"]
)
EXTRACT_MINIMISED = f"SELECT doc_id, doc_type, field, value FROM ({_EXTRACTED}) x WHERE value IS NOT NULL AND ({_KEPT})"
FILL_RATES = f"""
, n AS (SELECT expected_type AS doc_type, count(*) AS docs FROM type_docs GROUP BY 1),
f AS (SELECT doc_type, field, count(*) AS filled FROM ({_EXTRACTED}) x WHERE value IS NOT NULL GROUP BY 1, 2)
SELECT f.doc_type, field, filled, docs, round(filled / docs, 4) AS fill_rate FROM f JOIN n ON f.doc_type = n.doc_type
"""

LANG_TYPE = "CASE doc_id % 4 WHEN 0 THEN 'aadhaar' WHEN 1 THEN 'rent_agreement' WHEN 2 THEN 'pan' ELSE 'udyam' END"
LANG_TEXT = "name || ' ' || repeat('आधार ', CAST(doc_id % 5 AS INT))"
_LANG = [
    ("name", "CASE WHEN doc_id % 3 = 0 THEN '' ELSE name END"), ("aadhaar_number", "raw_aadhaar"), ("monthly_rent", "'5000'"),
    ("raw_lessor_name", "CASE WHEN doc_id % 7 = 0 THEN '' ELSE name END"),
]
LANG_FIELDS_SPARK = "array(" + ", ".join(f"named_struct('field', '{f}', 'value', {v})" for f, v in _LANG) + ")"
LANGUAGE = f"""
, base AS (
  SELECT doc_id, {LANG_TYPE} AS doc_type, (doc_id % 5) * 4 AS n, CASE doc_id % 4
    WHEN 0 THEN CASE WHEN doc_id % 3 = 0 THEN 'name' ELSE '' END
    WHEN 1 THEN CASE WHEN doc_id % 7 = 0 THEN 'lessor_name_masked' ELSE '' END
    WHEN 3 THEN 'enterprise_name, udyam_registration_number' END AS missing FROM kyc),
gaps AS (SELECT *, n >= 10 AND coalesce(missing, '') <> '' AS gap FROM base)
SELECT doc_id, doc_type, n AS devanagari_chars, CASE WHEN n >= 10 THEN 'en,devanagari' ELSE 'en' END AS detected_languages,
  gap AS partial_language_coverage, gap AS language_review_required,
  CASE WHEN gap THEN 'Document contains Devanagari script text (' || n || ' characters), but core field(s) could not be extracted: ' || missing || '. Manual review recommended.'
    WHEN n >= 10 AND missing = '' THEN 'Devanagari script text detected (' || n || ' characters); all core fields extracted successfully.' END AS language_coverage_notes
FROM gaps
"""
CARD_LINES = "array('INCOME TAX DEPARTMENT', 'GOVT OF INDIA', name, father_name, dob, pan_number, 'Signature')"
POSITIONAL = """
, names AS (SELECT doc_id, name AS value, 1 AS i FROM kyc UNION ALL SELECT doc_id, father_name, 2 FROM kyc WHERE father_name <> '')
SELECT doc_id, i AS position, CASE i WHEN 1 THEN 'name' ELSE 'father_name' END AS field, value FROM names
"""

# -------------------------------------------------------- cross-source checks

CROSS_CHECK = """
, verdicts AS (
  SELECT field AS key, CASE WHEN field = 'passport_number' THEN 'field_not_found_in_document' END AS reason, CASE field
    WHEN 'name' THEN doc_id % 4 <> 0 WHEN 'dob' THEN doc_id % 5 <> 0 OR value = (SELECT substr(dob,7,4) || '-' || substr(dob,4,2) || '-' || substr(dob,1,2) FROM kyc k WHERE k.doc_id = e.doc_id)
    WHEN 'identifier' THEN true ELSE false END AS exact
  FROM expected e)
SELECT key, reason, count(*) AS checks, count(*) FILTER (exact) AS exact FROM verdicts GROUP BY key, reason
"""
#: Two partners of a document and what is expected of them: turned round, turned within, a letter more, a letter changed,
#: somebody else beside one of them, one of them alone, and nothing where there are none.
PARTNERS = "CASE WHEN doc_id % 8 = 7 THEN array() ELSE array(name, concat('PARTNER ', father_name)) END"
EXPECTED_PARTNERS = """CASE doc_id % 8
  WHEN 0 THEN array(concat('partner ', father_name), name) WHEN 1 THEN array(concat(substring_index(name, ' ', -1), ', ', substring_index(name, ' ', 1)))
  WHEN 2 THEN array(concat(name, 'X'), name) WHEN 3 THEN array(concat(left(name, 4), '7', substr(name, 6)))
  WHEN 4 THEN array(name, '0123456789 55') WHEN 5 THEN array('Q') WHEN 6 THEN array(name, concat('PARTNER ', father_name)) ELSE array(name) END"""
CROSS_CHECK_LISTS = """
SELECT doc_id, CASE WHEN doc_id % 8 = 7 THEN 'partner_names' ELSE 'partners' END AS key, doc_id % 8 NOT IN (4, 5, 7) AS matched, CASE WHEN doc_id % 8 = 7 THEN 'empty_list_in_field' END AS reason FROM kyc
"""
#: A name beside another: itself turned round, a longer one, a short one, its letters backwards, and digits.
OTHER_NAME = """CASE doc_id % 6 WHEN 0 THEN lower(name) WHEN 1 THEN concat(name, ' X') WHEN 2 THEN left(name, 5) WHEN 3 THEN 'MOTSUCER'
  WHEN 4 THEN reverse(name) ELSE '1122334455667788' END"""
_SORTED = "array_to_string(list_sort(string_split_regex(trim(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g')), '\\s+')), ' ')"
SIMILARITY_STAGES = f"""
, pairs AS (SELECT {_SORTED.format('name')} AS one, {_SORTED.format(OTHER_NAME)} AS two FROM kyc),
lettered AS (
  SELECT one, two, length(one) + length(two) AS total,
    list_sum([least(length(one) - length(replace(one, c, '')), length(two) - length(replace(two, c, ''))) FOR c IN list_distinct(string_split(one, ''))]) AS shared
  FROM pairs)
SELECT CASE WHEN one = two THEN 'equal' WHEN contains(one, two) OR contains(two, one) THEN 'contained'
    WHEN 2.0 * least(length(one), length(two)) / total < 0.82 THEN 'length' WHEN 2.0 * shared / total < 0.82 THEN 'letters' ELSE 'compared' END AS stage,
  count(*) AS pairs
FROM lettered GROUP BY 1
"""
_OCR3 = "SELECT doc_id, 'pan_number' AS field, pan_number AS value FROM kyc UNION ALL SELECT doc_id, 'name', name FROM kyc UNION ALL SELECT doc_id, 'dob', dob FROM kyc"
RECONCILE_QR = f"""
, ocr AS ({_OCR3})
SELECT coalesce(o.doc_id, r.doc_id) AS doc_id, coalesce(o.field, r.field) AS field,
  CASE WHEN o.value IS NULL OR coalesce(upper(trim(o.value)) <> upper(trim(r.value)), false) THEN r.value ELSE o.value END AS value,
  CASE WHEN o.value IS NULL THEN 'qr_only' WHEN r.value IS NULL THEN 'ocr_only' WHEN upper(trim(o.value)) <> upper(trim(r.value)) THEN 'qr_preferred' ELSE 'agree' END AS resolution
FROM ocr o FULL OUTER JOIN qr_fields r ON o.doc_id = r.doc_id AND o.field = r.field
"""
QR_DISAGREE = f"""
, ocr AS ({_OCR3})
SELECT o.doc_id, o.field, o.value AS ocr_value, r.value AS qr_value, 'qr_preferred' AS resolution
FROM ocr o JOIN qr_fields r ON o.doc_id = r.doc_id AND o.field = r.field WHERE upper(trim(o.value)) <> upper(trim(r.value))
"""
QR_TYPE = "CASE doc_id % 3 WHEN 0 THEN 'aadhaar' WHEN 1 THEN 'udyam' ELSE 'fssai' END"
QR_PAYLOAD = (
    "CASE doc_id % 3 WHEN 0 THEN '<PrintLetterBarcodeData uid=\"' || raw_aadhaar || '\" name=\"' || name || '\" gender=\"' || "
    "CASE WHEN doc_id % 2 = 0 THEN 'F' ELSE 'm' END || '\" dob=\"' || dob || '\" />' "
    "WHEN 1 THEN 'https://example.org/verify?urn=udyam-mh-01-' || lpad(CAST(doc_id AS STRING), 7, '0') "
    "ELSE 'licence ' || lpad(CAST(doc_id AS STRING), CAST(13 + doc_id % 2 AS INT), '1') || ' valid' END"
)
PARSE_QR = f"""
SELECT doc_id, 'aadhaar' AS doc_type, 'aadhaar_number' AS field, raw_aadhaar AS value FROM kyc WHERE doc_id % 3 = 0
UNION ALL SELECT doc_id, 'aadhaar', 'name', name FROM kyc WHERE doc_id % 3 = 0
UNION ALL SELECT doc_id, 'aadhaar', 'dob', dob FROM kyc WHERE doc_id % 3 = 0
UNION ALL SELECT doc_id, 'aadhaar', 'gender', CASE WHEN doc_id % 2 = 0 THEN 'Female' ELSE 'Male' END FROM kyc WHERE doc_id % 3 = 0
UNION ALL SELECT doc_id, 'udyam', 'udyam_registration_number', 'UDYAM-MH-01-' || lpad(CAST(doc_id AS VARCHAR), 7, '0') FROM kyc WHERE doc_id % 3 = 1
UNION ALL SELECT doc_id, 'fssai', 'fssai_licence_number', lpad(CAST(doc_id AS VARCHAR), 14, '1') FROM kyc WHERE doc_id % 3 = 2 AND doc_id % 2 = 1
UNION ALL SELECT doc_id, {QR_TYPE}, 'raw_qr', {QR_PAYLOAD} FROM kyc
"""
QR_FINDINGS = """
, pairs AS (
  SELECT k.doc_id, CASE r.field WHEN 'dob' THEN 'dob' ELSE 'doc_number' END AS qr_key, CASE r.field WHEN 'dob' THEN k.dob ELSE k.pan_number END AS a, r.value AS b
  FROM kyc k JOIN qr_fields r ON k.doc_id = r.doc_id WHERE r.field IN ('dob', 'pan_number'))
SELECT doc_id, qr_key, 'qr_data_mismatch' AS signal, 40 AS score,
  'QR code payload mismatch for ' || qr_key || ': OCR read ''' || a || ''', while digital QR decoded ''' || b || '''.' AS description
FROM pairs WHERE regexp_replace(upper(a), '[ \\-_/]', '', 'g') <> regexp_replace(upper(b), '[ \\-_/]', '', 'g')
"""
MICR_LINE = (
    "'⑆' || lpad(CAST(doc_id AS STRING), CAST(6 - doc_id % 2 AS INT), '0') || '⑆ ' || lpad(CAST(doc_id * 7 AS STRING), 9, '4') || '⑈ ' || account_number || '⑇ 10'"
)
_MICR = [
    ("cheque_number", "lpad(CAST(doc_id + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS STRING), 6, '0')"),
    ("account_number_masked", "'XXXXXX' || CASE WHEN doc_id % 7 = 0 THEN '0000' ELSE right(account_number, 4) END"),
]
MICR_FIELDS_SPARK = "array(" + ", ".join(f"named_struct('field', '{f}', 'value', {v})" for f, v in _MICR) + ")"
MICR = """
, parsed AS (
  SELECT doc_id, account_number AS acc, CASE WHEN doc_id % 2 = 0 THEN lpad(CAST(doc_id AS VARCHAR), 6, '0') END AS chq FROM kyc),
d AS (
  SELECT *, CASE WHEN chq IS NOT NULL AND doc_id % 5 = 0 THEN 1 ELSE 0 END + CASE WHEN doc_id % 7 = 0 AND right(acc, 4) <> '0000' THEN 1 ELSE 0 END AS n FROM parsed)
SELECT doc_id, chq AS cheque_number, lpad(CAST(doc_id * 7 AS VARCHAR), 9, '4') AS micr_code, acc AS account_number, '10' AS tran_code,
  CASE WHEN chq IS NULL THEN 'low' ELSE 'high' END AS micr_confidence, n = 0 AS micr_match, n AS n_disagreements FROM d
"""

# ---------------------------------------------------------------- integrity

OVERLAP = """
, boxes AS (SELECT * FROM ocr_lines WHERE length(trim(text)) > 1),
pairs AS (
  SELECT a.doc_id, greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS i,
    (a.x1 - a.x0) * (a.y1 - a.y0) AS ar, (b.x1 - b.x0) * (b.y1 - b.y0) AS br
  FROM boxes a JOIN boxes b ON a.doc_id = b.doc_id AND a.page_num = b.page_num AND a.line_no < b.line_no)
SELECT DISTINCT doc_id, 'overlapping_text_regions' AS signal, 15 AS score FROM pairs
WHERE i > 0 AND ar > 0 AND br > 0 AND (i / (ar + br - i) >= 0.15 OR i / least(ar, br) >= 0.45)
"""
ORDER_TYPE = "CASE o_orderkey % 5 WHEN 0 THEN 'bank_statement' WHEN 1 THEN 'unknown' WHEN 2 THEN 'tax_invoice' WHEN 3 THEN 'pan' ELSE 'salary_slip' END"
LABEL_FINDINGS = f"""
, paged AS (
  SELECT doc_id, page_num, count(*) FILTER (text = 'Name') AS name_n, count(*) FILTER (text = 'Father''s Name') AS father_n,
    count(*) FILTER (text = 'Date of Birth') AS dob_n, count(*) FILTER (text = 'PAN No') AS pan_n FROM ocr_lines GROUP BY doc_id, page_num),
counted AS (SELECT doc_id, max(name_n) AS name_n, max(father_n) AS father_n, max(dob_n) AS dob_n, max(pan_n) AS pan_n FROM paged GROUP BY doc_id),
labels4 AS (
  SELECT doc_id, 'Name' AS l, name_n AS n FROM counted UNION ALL SELECT doc_id, 'Father''s Name', father_n FROM counted
  UNION ALL SELECT doc_id, 'Date of Birth', dob_n FROM counted UNION ALL SELECT doc_id, 'PAN', pan_n FROM counted),
hit AS (SELECT l.* FROM labels4 l JOIN orders o ON o.o_orderkey = l.doc_id WHERE n >= 2 AND {ORDER_TYPE} NOT IN ('bank_statement', 'tax_invoice'))
SELECT doc_id, 'duplicate_field_label' AS signal, 20 AS score, 'Duplicate ' || l || ' field detected.' AS description FROM hit
UNION ALL SELECT doc_id, 'abnormal_alignment', 10, 'Unexpected field position detected for ' || l || '.' FROM hit
"""
_ALIGN = """
SELECT DISTINCT doc_id FROM (
  SELECT l.doc_id, l.page_num, x0, m FROM ocr_lines l JOIN (
    SELECT doc_id, page_num, list_sort(list(x0))[CAST(count(*) // 2 + 1 AS INT)] AS m, count(*) AS n FROM ocr_lines GROUP BY doc_id, page_num) s
  ON l.doc_id = s.doc_id AND l.page_num = s.page_num WHERE n >= 6) t
GROUP BY doc_id, page_num HAVING count(*) FILTER (abs(x0 - m) > 5 AND abs(x0 - m) < 25) >= 3
"""
_FONTS = """
SELECT DISTINCT doc_id FROM (
  SELECT l.doc_id, l.page_num, y1 - y0 AS h, m FROM ocr_lines l JOIN (
    SELECT doc_id, page_num, list_sort(list(y1 - y0))[CAST(count(*) // 2 + 1 AS INT)] AS m, count(*) AS n FROM ocr_lines WHERE y1 - y0 > 5 GROUP BY doc_id, page_num) s
  ON l.doc_id = s.doc_id AND l.page_num = s.page_num WHERE n >= 5 AND m > 10 AND y1 - y0 > 5) t
GROUP BY doc_id, page_num HAVING count(*) FILTER (h > m * 2.5 OR h < m * 0.4) >= 2
"""
ALIGNMENT = f"SELECT doc_id, 'abnormal_alignment' AS signal, 10 AS score FROM ({_ALIGN}) a"
FONT = f"SELECT doc_id, 'font_size_inconsistency' AS signal, 15 AS score FROM ({_FONTS}) a"
ALL_FINDINGS = f"""
SELECT doc_id, 0 AS ordinal, 'abnormal_alignment' AS signal, 'layout' AS category, 10 AS score,
  'Unexpected field placement or abnormal text alignment detected.' AS description FROM ({_ALIGN}) a
UNION ALL SELECT doc_id, 1000000, 'font_size_inconsistency', 'visual', 15, 'Font size inconsistency detected across text fields.' FROM ({_FONTS}) b
"""
FIELD_TYPE = "CASE doc_id % 3 WHEN 0 THEN 'pan' WHEN 1 THEN 'aadhaar' ELSE 'bank_passbook' END"
FIELD_FINDINGS = f"""
, born AS (SELECT *, try_strptime(dob, '%d/%m/%Y') AS b FROM kyc),
found AS (
  SELECT doc_id, 'invalid_checksum' AS signal, 30 AS score, 'PAN format validation failed: ' || {_PAN_WHY.format(p='pan_number')} || '.' AS description
  FROM kyc WHERE doc_id % 3 = 0 AND {_PAN_WHY.format(p='pan_number')} IS NOT NULL
  UNION ALL SELECT doc_id, 'invalid_checksum', 30, 'Aadhaar Verhoeff checksum validation failed.' FROM kyc
    WHERE doc_id % 3 = 1 AND (NOT regexp_matches(raw_aadhaar, '^[2-9][0-9]{{11}}$') OR {_FOLD.replace('value', 'raw_aadhaar')} <> 0)
  UNION ALL SELECT doc_id, 'duplicate_field_label', 20, 'Applicant Name and Father''s Name are identical.' FROM kyc WHERE name = father_name
  UNION ALL SELECT doc_id, 'invalid_checksum', 30, 'Date of birth (' || strftime(b, '%Y-%m-%d') || ') is set in the future.' FROM born WHERE b > DATE '2026-01-01'
  UNION ALL SELECT doc_id, 'invalid_checksum', 30, 'Date of birth year (' || year(b) || ') is outside plausible historical range.' FROM born WHERE year(b) < 1910)
SELECT * FROM found
"""
RISK_SIGNAL = "CASE CAST(x0 AS INT) % 4 WHEN 2 THEN 'qr_mismatch' WHEN 0 THEN 'overlap_area' ELSE 'odd thing' END"
RISK_SCORE = "CASE WHEN line_no % 3 = 0 THEN 15 WHEN line_no % 3 = 1 THEN 0 END"
RISK = f"""
, f AS (
  SELECT doc_id, line_no AS ordinal, text AS description, {RISK_SIGNAL} AS signal,
    CASE WHEN line_no % 3 = 0 THEN 15 ELSE CASE CAST(x0 AS INT) % 4 WHEN 2 THEN 40 WHEN 0 THEN 15 ELSE 10 END END AS w FROM ocr_lines),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, signal ORDER BY ordinal) AS r FROM f),
s AS (SELECT doc_id, sum(CASE WHEN r = 1 THEN w ELSE w // 2 END) AS risk FROM n GROUP BY doc_id),
t AS (SELECT doc_id, string_agg(description, '|' ORDER BY o) AS texts FROM (SELECT doc_id, description, min(ordinal) AS o FROM f GROUP BY ALL) z GROUP BY doc_id),
d AS (
  SELECT o_orderkey AS doc_id, {ORDER_TYPE} AS doc_type, CASE WHEN {ORDER_TYPE} = 'unknown' THEN 0 ELSE least(100, coalesce(risk, 0)) END AS risk_score, texts
  FROM orders LEFT JOIN s ON s.doc_id = o_orderkey LEFT JOIN t ON t.doc_id = o_orderkey)
SELECT doc_id, doc_type, CAST(risk_score AS INT) AS risk_score,
  CASE WHEN doc_type = 'unknown' THEN 'unsupported' WHEN risk_score >= 30 THEN 'review_required' ELSE 'verified' END AS verification_status,
  risk_score >= 30 AS review_required, CASE WHEN risk_score >= 60 THEN 'high' WHEN risk_score >= 30 THEN 'normal' ELSE 'low' END AS priority,
  CASE WHEN doc_type = 'unknown' THEN 'Unsupported document type.' WHEN risk_score >= 60 THEN 'Visible inconsistencies detected (High Priority).'
    WHEN risk_score >= 30 THEN 'Visible inconsistencies detected.' END AS human_review_reason,
  CASE WHEN doc_type = 'unknown' THEN '' ELSE coalesce(texts, '') END AS suspicious_signals FROM d
"""
# mean of hundredths, rounded half up at four places in whole numbers
_MEAN4 = "(CAST(sum({v}) AS BIGINT) * 2 * {up} + count(*)) // (2 * count(*))"
_PAGE_MEANS = (
    "SELECT doc_id, page_num, count(*) AS n_lines, "
    + _MEAN4.format(v="CAST(round(confidence * 100) AS BIGINT)", up=100)
    + " AS m FROM ocr_lines GROUP BY doc_id, page_num"
)
CONF_PAGES = f"SELECT doc_id, page_num, n_lines, m / 10000 AS average_confidence FROM ({_PAGE_MEANS}) p"
_DOC_MEANS = f"SELECT doc_id, count(*) AS n_pages, {_MEAN4.format(v='m', up=1)} AS m FROM ({_PAGE_MEANS}) p GROUP BY doc_id"
CONF_DOCS = f"SELECT doc_id, n_pages, m / 10000 AS average_confidence FROM ({_DOC_MEANS}) d"
_CONF = [("holder", "'Name'"), ("birth", "CASE WHEN o_orderkey % 3 = 0 THEN 'of Birth' ELSE 'nowhere' END"), ("line", "'line ' || CAST(o_custkey AS STRING)")]
CONF_FIELDS_SPARK = "array(" + ", ".join(f"named_struct('field', '{f}', 'value', {v})" for f, v in _CONF) + ")"
FIELD_CONF = f"""
, fields AS ({' UNION ALL '.join(f"SELECT o_orderkey AS doc_id, '{f}' AS field, {v} AS value FROM orders" for f, v in _CONF)}),
hit AS (
  SELECT f.doc_id, f.field, arg_min(l.confidence, l.line_no) AS c FROM fields f JOIN ocr_lines l ON l.doc_id = f.doc_id AND contains(lower(l.text), lower(f.value)) GROUP BY ALL),
scored AS (SELECT f.doc_id, f.field, coalesce(CAST(round(c * 100) AS BIGINT), 95) AS c FROM fields f LEFT JOIN hit h ON h.doc_id = f.doc_id AND h.field = f.field),
docs AS (SELECT DISTINCT doc_id FROM ocr_lines)
SELECT d.doc_id, max(c) FILTER (field = 'birth') / 100 AS confidence FROM docs d JOIN scored s ON s.doc_id = d.doc_id GROUP BY d.doc_id
"""
DOC_STATUS = f"""
, d AS (SELECT doc_id, m / 10000 AS c, doc_id % 19 <> 0 AS ok FROM ({_DOC_MEANS}) x)
SELECT doc_id, CASE WHEN NOT ok THEN 'warning' WHEN c >= 0.70 THEN 'completed' ELSE 'low_confidence' END AS vault_status,
  CASE WHEN NOT ok THEN 'low_confidence' WHEN c >= 0.95 THEN 'success' ELSE 'low_confidence' END AS api_status FROM d
"""
GATE = """
, has AS (SELECT DISTINCT doc_id FROM ocr_lines),
d AS (
  SELECT o_orderkey AS doc_id, o_orderkey % 23 = 0 OR o_orderkey % 29 = 0 OR o_orderkey % 31 = 0 OR h.doc_id IS NULL AS bad, o_orderkey % 31 = 0 AS crash
  FROM orders LEFT JOIN has h ON h.doc_id = o_orderkey)
SELECT doc_id, NOT bad AS usable, CASE WHEN bad THEN 'ocr_engine_returned_no_text' END AS reason,
  CASE WHEN crash THEN 'engine crashed' WHEN bad THEN 'OCR engine returned no text or zero confidence' END AS message FROM d
"""
READING_ORDER = """
SELECT doc_id, line_no, row_number() OVER (PARTITION BY doc_id, page_num ORDER BY round_even(y0 / 15, 0), x0, line_no) AS reading_pos FROM ocr_lines
"""

_MERGE_BOXES = "doc_id, page_num, line_no, text, confidence, x0, y0, x1, y1"
# pairs of a page one after the other: a pair is taken if neither of its lines is
MERGE_PASSES = f"""
, en AS (SELECT {_MERGE_BOXES} FROM ocr_lines),
dev AS (
  SELECT doc_id, page_num, line_no, CASE WHEN line_no % 2 = 0 THEN 'नाव ' || text ELSE text END AS text, confidence - 0.01 AS confidence,
    x0 + 1 AS x0, y0 + CASE WHEN line_no % 3 = 0 THEN 400 ELSE 2 END AS y0, x1 + 1 AS x1, y1 + CASE WHEN line_no % 3 = 0 THEN 400 ELSE 2 END AS y1
  FROM ocr_lines),
met AS (
  SELECT a.doc_id, a.page_num, a.line_no AS an, b.line_no AS bn, (a.x1 - a.x0) * (a.y1 - a.y0) AS sa, (b.x1 - b.x0) * (b.y1 - b.y0) AS sb,
    greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS i
  FROM en a JOIN dev b ON a.doc_id = b.doc_id AND a.page_num = b.page_num),
numbered AS (
  SELECT doc_id, page_num, an, bn, row_number() OVER (PARTITION BY doc_id, page_num ORDER BY an, i / least(sa, sb) DESC, bn) AS n FROM met
  WHERE i > 0 AND sa > 0 AND sb > 0 AND (i / (sa + sb - i) >= 0.35 OR i / least(sa, sb) >= 0.5)),
steps AS (
  SELECT n, doc_id, page_num, an, bn, true AS took, [an] AS ta, [bn] AS tb FROM numbered WHERE n = 1
  UNION ALL
  SELECT r.n, r.doc_id, r.page_num, r.an, r.bn, NOT list_contains(s.ta, r.an) AND NOT list_contains(s.tb, r.bn),
    CASE WHEN list_contains(s.ta, r.an) OR list_contains(s.tb, r.bn) THEN s.ta ELSE list_append(s.ta, r.an) END,
    CASE WHEN list_contains(s.ta, r.an) OR list_contains(s.tb, r.bn) THEN s.tb ELSE list_append(s.tb, r.bn) END
  FROM steps s JOIN numbered r ON r.doc_id = s.doc_id AND r.page_num = s.page_num AND r.n = s.n + 1),
pairs AS (SELECT doc_id, page_num, an, bn FROM steps WHERE took),
won AS (
  SELECT p.*, CASE WHEN b.line_no % 2 = 0 THEN b.confidence >= 0.5 OR b.confidence >= a.confidence - 0.2 ELSE b.confidence > a.confidence END AS dev_wins
  FROM pairs p JOIN en a ON a.doc_id = p.doc_id AND a.page_num = p.page_num AND a.line_no = p.an
  JOIN dev b ON b.doc_id = p.doc_id AND b.page_num = p.page_num AND b.line_no = p.bn),
merged AS (
  SELECT en.*, 'en' AS source_pass FROM en LEFT JOIN won w ON w.doc_id = en.doc_id AND w.page_num = en.page_num AND w.an = en.line_no
  WHERE coalesce(NOT dev_wins, true)
  UNION ALL
  SELECT dev.*, 'dev' FROM dev LEFT JOIN won w ON w.doc_id = dev.doc_id AND w.page_num = dev.page_num AND w.bn = dev.line_no
  WHERE coalesce(dev_wins, true))
SELECT {_MERGE_BOXES}, source_pass,
  row_number() OVER (PARTITION BY doc_id, page_num ORDER BY round_even(y0 / 15, 0), x0, line_no) AS reading_pos FROM merged
"""

# ------------------------------------------------ governance, chat, questions

_RETAIN = """
, rows AS (SELECT document_id, bool_or(uploaded_at < TIMESTAMP '1999-01-01 00:00:00') AS old FROM retention_index GROUP BY document_id),
stored AS (SELECT file_doc_id AS document_id, count(*) AS files FROM retention_files GROUP BY 1),
plan AS (
  SELECT coalesce(r.document_id, s.document_id) AS document_id, coalesce(files, 0) AS files,
    CASE WHEN old THEN 'expired' WHEN r.document_id IS NOT NULL AND s.document_id IS NULL THEN 'broken_reference' WHEN r.document_id IS NULL THEN 'orphan_file' END AS action
  FROM rows r FULL OUTER JOIN stored s ON r.document_id = s.document_id)
"""
RETENTION = _RETAIN + "SELECT document_id, action, files FROM plan WHERE action IS NOT NULL"
RETENTION_SUMMARY = _RETAIN + """
SELECT count(*) FILTER (action IN ('expired', 'broken_reference')) AS deleted_count, count(*) FILTER (action = 'expired') AS expired_count,
  count(*) FILTER (action = 'broken_reference') AS broken_refs_count, CAST(coalesce(sum(files) FILTER (action = 'orphan_file'), 0) AS BIGINT) AS orphans_cleaned FROM plan
"""
REMOVAL = """
SELECT DISTINCT document_id, 'removed' AS state FROM retention_index WHERE document_id % 3 = 0 OR document_id % 5 = 0
UNION ALL SELECT document_id, 'kept' FROM retention_index WHERE NOT (document_id % 3 = 0 OR document_id % 5 = 0)
"""
AUDIT_ROWS = """
SELECT 'ocr_audit' AS event, doc_type, status, CAST(job_id AS VARCHAR) AS job_id, CAST(customer_id AS VARCHAR) AS customer_id,
  round(duration_ms, 2) AS duration_ms, 2 AS n_extra, doc_type AS source FROM audit
"""
AUDIT_ROLLUP = """
, h AS (SELECT doc_type, status, CAST(round(duration_ms * 100) AS BIGINT) AS c FROM audit)
SELECT doc_type, status, CAST(NULL AS VARCHAR) AS reason, count(*) AS rows,
  ((CAST(sum(c) AS BIGINT) * 200 + count(*)) // (2 * count(*))) / 10000 AS mean_duration_ms, CAST(NULL AS DOUBLE) AS mean_confidence FROM h GROUP BY doc_type, status
"""
SESSIONS = """
, known AS (
  SELECT user_id, document_id, arg_max('s' || document_id || '_' || turn, turn) AS session_id FROM chat_messages WHERE document_id % 2 = 0 AND turn < 2 GROUP BY ALL)
SELECT user_id, document_id, session_id, false AS created FROM known
UNION ALL SELECT DISTINCT user_id, document_id, 'session_' || user_id || '_' || document_id, true FROM chat_messages m
WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.user_id = m.user_id AND k.document_id = m.document_id)
"""
HISTORY = """
SELECT document_id, user_id, role, position, content_md5 FROM (
  SELECT document_id, user_id, role, row_number() OVER (PARTITION BY user_id, document_id ORDER BY turn) AS position, md5(content) AS content_md5 FROM chat_messages) x
WHERE position <= 4
"""
FOLLOWUP_CONTENT = "CASE WHEN role = 'user' AND turn % 4 = 2 THEN 'Why?' WHEN role = 'user' AND turn % 4 = 0 AND turn > 0 THEN 'why is it so' ELSE content END"
FOLLOWUP = f"""
, said AS (SELECT document_id, user_id, turn, role, trim({FOLLOWUP_CONTENT}) AS c FROM chat_messages),
ctx AS (
  SELECT *, last_value(CASE WHEN role = 'assistant' THEN c END IGNORE NULLS) OVER w AS a,
    last_value(CASE WHEN role = 'user' AND lower(c) NOT IN ('why', 'why?', 'why not', 'why not?', 'how?', 'how come?', 'can you explain?', 'can you explain') THEN c END IGNORE NULLS) OVER w AS u
  FROM said WINDOW w AS (PARTITION BY user_id, document_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT document_id, turn, lower(c) IN ('why', 'why?', 'why not', 'why not?', 'how?', 'how come?', 'can you explain?', 'can you explain', 'reason?', 'why is that?', 'why so?') OR lower(c) LIKE 'why %' AS is_followup,
  md5(a) AS answer_md5, md5(u) AS question_md5 FROM ctx WHERE role = 'user'
"""


def _intent_case(norm: str) -> str:
    whens = []
    for key, words in PRIORITY:
        whens.append("WHEN " + " OR ".join(f"contains({norm}, {q(w)})" for w in words) + f" THEN '{key}'")
    for i in INTENTS:
        tests = [f"regexp_matches(' ' || {norm} || ' ', {q(chr(92) + 'b' + k.replace('/', chr(92) + '/') + chr(92) + 'b')})" for k in i.keywords]
        tests += [f"regexp_matches({norm}, {q(r)})" for r in i.regexes]
        whens.append(f"WHEN {' OR '.join(tests)} THEN '{i.key}'")
    whens.append(f"WHEN contains({norm}, 'name') AND contains(doc_type, 'pan') THEN 'account_holder'")
    return f"CASE {' '.join(whens)} END"


_NORMQ = "trim(regexp_replace(regexp_replace(lower(question), '[?!.,]', ' ', 'g'), ' +', ' ', 'g'))"
INTENTS_SQL = f"""
, asked AS (SELECT q.doc_id, q.question, {_NORMQ} AS n, t.expected_type AS doc_type FROM questions q JOIN type_docs t ON t.doc_id = q.doc_id)
SELECT doc_id, question, {_intent_case('n')} AS intent FROM asked
"""
LOOKUP = """
, facts AS (
  SELECT k.*, CASE doc_id % 6 WHEN 0 THEN 'pan_number' WHEN 1 THEN 'date_of_birth' WHEN 2 THEN 'ifsc' WHEN 3 THEN 'account_holder' WHEN 4 THEN 'gstin' END AS intent FROM kyc k),
months AS (SELECT ['January','February','March','April','May','June','July','August','September','October','November','December'] AS m),
found AS (
  SELECT doc_id, intent, CASE intent WHEN 'pan_number' THEN pan_number
      WHEN 'date_of_birth' THEN substr(dob, 1, 2) || ' ' || m[CAST(substr(dob, 4, 2) AS INT)] || ' ' || substr(dob, 7, 4)
      WHEN 'ifsc' THEN CASE WHEN substr(ifsc, 5, 1) = '0' THEN ifsc END WHEN 'account_holder' THEN name END AS v FROM facts, months WHERE intent IS NOT NULL)
SELECT doc_id, intent, CASE WHEN intent = 'ifsc' AND (contains(v, 'HDFC') OR contains(v, 'ICICI')) THEN NULL ELSE v END AS value,
  CASE WHEN v IS NULL THEN 'not_found' WHEN intent = 'ifsc' AND (contains(v, 'HDFC') OR contains(v, 'ICICI')) THEN 'prohibited'
    WHEN intent = 'account_holder' THEN 'extracted' ELSE 'ocr' END AS source FROM found
"""
SUMMARIES = """
SELECT doc_id, expected_type AS doc_type, CASE expected_type
  WHEN 'pan' THEN 'This document is a Permanent Account Number (PAN) Card issued by the Income Tax Department, Government of India for ' || name || ' (PAN: ' || pan_number || ').'
  WHEN 'aadhaar' THEN 'This document is an Aadhaar Card issued by the Unique Identification Authority of India (UIDAI), serving as official identity and residence verification.'
  WHEN 'bank_statement' THEN 'This document is a Bank Statement for account held by the account holder at the bank.'
  WHEN 'bank_passbook' THEN 'This document was analyzed and identified as a Bank Passbook issued by Bank.'
  WHEN 'passport' THEN 'This document was analyzed and identified as a Passport issued by Republic of India.'
  ELSE 'This document could not be reliably classified into a recognized document type based on its visible content.' END AS summary
FROM type_docs JOIN kyc USING (doc_id)
"""
_KIND = "CASE expected_type " + " ".join(f"WHEN {q(t)} THEN {q(n)}" for t, (n, _) in TYPE_METADATA.items()) + " ELSE expected_type END"
ANSWERS = f"""
, sums AS ({SUMMARIES}),
d AS (SELECT t.*, k.name, k.pan_number, k.ifsc, k.dob, s.summary, CAST(floor(t.doc_id / 6) AS INT) % 8 AS k, {_KIND} AS kind,
    regexp_extract(t.full_text, '[0-9]+\\.50 INR') AS fee, substr(k.ifsc, 5, 1) = '0' AND t.expected_type IN ('bank_statement', 'bank_passbook') AS has_ifsc
  FROM type_docs t JOIN kyc k USING (doc_id) JOIN sums s USING (doc_id))
SELECT doc_id AS document_id, 0 AS turn, CASE k WHEN 0 THEN 'summary' WHEN 1 THEN 'authenticity' WHEN 2 THEN 'key_information' WHEN 3 THEN 'dates' WHEN 4 THEN 'amounts'
    WHEN 5 THEN 'employee_name' WHEN 6 THEN 'field' ELSE 'search' END AS rule,
  CASE k WHEN 0 THEN summary || ' [Page 1]'
    WHEN 1 THEN CASE doc_id % 5 WHEN 0 THEN 'Verification Status: Review Required. Visible inconsistencies detected: visible layout or format discrepancies. Manual review is recommended.'
      WHEN 1 THEN 'This document is marked Unsupported. Offline authenticity verification is not available for unsupported document types, but full visual text and structural features have been extracted.'
      ELSE 'No significant visible inconsistencies or checksum errors were detected in this document. The document is marked Verified, though external verification through the official issuer registry is recommended for full legal validation.' END
    WHEN 2 THEN 'Key Information Extracted from Document:' || chr(10) || '**Document Type**: ' || kind || ' [Page 1]' || chr(10) || CASE WHEN expected_type = 'pan'
      THEN '• **PAN Number**: ' || pan_number || ' [Page 1]' || chr(10) || '• **Cardholder Name**: ' || name || ' [Page 1]'
      ELSE '• **Cardholder Name**: ' || name || ' [Page 1]' || chr(10) || '• **PAN Number**: ' || pan_number || ' [Page 1]' END
    WHEN 3 THEN CASE WHEN expected_type IN ('pan', 'aadhaar') THEN 'Dates found in document:' || chr(10) || '• Date of Birth — **' || dob || '** [Page 1]' ELSE 'No clear dates were found in the document.' END
    WHEN 4 THEN CASE WHEN expected_type = 'bank_statement' THEN 'Numbers and financial figures found in document:' || chr(10) || '• **' || fee || '** (Fee: ' || fee || ') [Page 1]'
      ELSE 'No numerical figures or financial information was found in this document.' END
    WHEN 5 THEN 'I could not find an employee name in this document.'
    WHEN 6 THEN CASE WHEN NOT has_ifsc THEN 'I could not find an IFSC Code in this document.'
      WHEN contains(ifsc, 'HDFC') OR contains(ifsc, 'ICICI') THEN 'I could not confidently identify that information in this document.' ELSE 'The IFSC Code is ' || ifsc || '.' END
    ELSE CASE WHEN expected_type = 'unknown' THEN 'Based on doc_' || CAST(doc_id AS VARCHAR) || '.pdf:' || chr(10) || '- Plain letter about nothing in particular, number ' || CAST(doc_id AS VARCHAR)
      ELSE 'I could not find information regarding your query in doc_' || CAST(doc_id AS VARCHAR) || '.pdf.' END END AS answer
FROM d
UNION ALL SELECT doc_id, 2, 'follow_up', 'I searched the extracted fields, OCR text, and visible document content, but I could not find a ' || CASE k WHEN 6 THEN 'IFSC Code' ELSE 'that' END || '.'
FROM d WHERE k >= 6
"""
_KEYS = [("name", "Cardholder Name"), ("pan_number", "PAN Number"), ("ifsc", "IFSC Code")]
KEY_FIELDS = " , k AS (" + " UNION ALL ".join(
    f"SELECT doc_id, '{f}' AS field, '{label}' AS label, {f} AS value FROM kyc" for f, label in _KEYS
) + """)
SELECT k.doc_id, expected_type AS doc_type, field, label, value,
  CASE WHEN expected_type = 'pan' AND field = 'pan_number' THEN 1 WHEN expected_type = 'pan' AND field = 'name' THEN 3
       WHEN expected_type IN ('bank_statement', 'bank_passbook') AND field = 'ifsc' THEN 6 ELSE 1000 END AS rank
FROM k JOIN type_docs t ON t.doc_id = k.doc_id
"""
MODEL_ANSWER = (
    "CASE doc_id % 4 WHEN 0 THEN 'Sure! ```json\\n{\"document_type\": \"Letter\", \"confidence\": 0.9, \"summary\": \"A plain letter text.\", "
    "\"extracted_fields\": {\"name\": \"MODEL\", \"city\": \"Pune\"}}\\n```' "
    "WHEN 1 THEN 'Answer: {\"document_type\": \"PAN Card\", \"confidence\": \"high\", \"extracted_fields\": "
    "{\"field_name_1\": \"colour\", \"field_value_1\": \"red\", \"field_name_2\": \"size\", \"field_value_2\": \"none\"}} done' "
    "WHEN 2 THEN '{\"document_type\": \"something unknown\", \"evidence\": [\"a\", \"b\"]}' ELSE 'no json at all' END"
)
_JSON_ENTRIES = """CASE doc_id % 4 WHEN 0 THEN '"city":"Pune",' WHEN 1 THEN '"colour":"red",' ELSE '' END"""
MODEL_OUTPUTS = ", typed AS (WITH " + classify_sql(0).strip().removeprefix(",") + """)
, stated AS (
  SELECT doc_id, doc_type <> 'unknown' AS known, confidence_level, typed.confidence AS score, evidence,
    CASE WHEN doc_type <> 'unknown' THEN document_type WHEN doc_id % 4 = 0 THEN 'Letter' WHEN doc_id % 4 = 1 THEN 'Pan Card' ELSE 'Unknown Document' END AS document_type
  FROM typed)
SELECT s.doc_id, document_type,
  CASE WHEN s.doc_id % 4 = 1 THEN 'high' WHEN known THEN confidence_level WHEN s.doc_id % 4 = 0 THEN 'high' ELSE 'low' END AS confidence,
  CASE WHEN known THEN score WHEN s.doc_id % 4 = 0 THEN 0.9 WHEN s.doc_id % 4 = 1 THEN 0.95 END AS confidence_score,
  CASE WHEN s.doc_id % 4 = 0 THEN 'A plain letter text.' WHEN document_type <> 'Unknown Document' THEN 'This document was analyzed and identified as a ' || document_type || '.'
    ELSE 'This document could not be reliably classified into a recognized document type based on its visible content.' END AS summary,
  CASE WHEN known THEN evidence
    WHEN document_type <> 'Unknown Document' THEN 'Document structure matches ' || document_type || '|Contains verified text tokens and layout features'
    WHEN s.doc_id % 4 = 2 THEN 'a|b'
    ELSE 'No standard institutional headings or classification markers recognized|Visible text lacks defining structural fields of supported document classes' END AS evidence,
  '{' || """ + _JSON_ENTRIES.replace("doc_id", "s.doc_id") + """ || '"name":"' || name || '","pan_number":"' || pan_number || '"}' AS extracted_fields
FROM stated s JOIN kyc k ON k.doc_id = s.doc_id
"""
VERIFY = _best(1) + f"""
, {_SIG_ROWS}
, asked AS (
  SELECT d.doc_id, full_text, CASE WHEN d.doc_id % 4 = 0 THEN 'gst_certificate' ELSE expected_type END AS requested_type, c.doc_type AS detected
  FROM type_docs d LEFT JOIN chosen c ON d.doc_id = c.doc_id),
own AS (
  SELECT a.doc_id, a.requested_type, a.detected, count(*) FILTER (regexp_matches(upper(full_text), pattern)) AS score
  FROM asked a LEFT JOIN sigs s ON s.requested_type = a.requested_type GROUP BY ALL),
v AS (SELECT *, coalesce(detected <> requested_type AND score < 2, false) AS mis FROM own),
why AS (
  SELECT v.*, CASE requested_type
    WHEN 'pan' THEN {_PAN_WHY.format(p='k.pan_number')}
    WHEN 'aadhaar' THEN CASE WHEN NOT regexp_matches(raw_aadhaar, '^[2-9][0-9]{{11}}$') OR {_FOLD.replace('value', 'raw_aadhaar')} <> 0 THEN 'invalid_aadhaar_checksum' END
    WHEN 'bank_statement' THEN CASE WHEN substr(ifsc, 5, 1) = '0' AND substr(ifsc, 1, 4) NOT IN {in_list(BANK_CODES)} THEN 'ifsc_needs_review' END
    WHEN 'bank_passbook' THEN CASE WHEN substr(ifsc, 5, 1) = '0' AND substr(ifsc, 1, 4) NOT IN {in_list(BANK_CODES)} THEN 'ifsc_needs_review' END END AS reason
  FROM v JOIN kyc k ON k.doc_id = v.doc_id)
SELECT doc_id, requested_type, CASE WHEN mis THEN detected END AS detected_type,
  CASE WHEN mis THEN 'error' WHEN reason IS NOT NULL THEN 'low_confidence' ELSE 'success' END AS status,
  CASE WHEN mis THEN 'doc_type_mismatch' ELSE reason END AS reason FROM why
"""

# Every stage of the flow: documents that the gate refuses, scanned codes whose name wins, the cross-check and the audit row.
_REFUSED = "(doc_id % 11 = 0 OR doc_id % 9 = 5)"
VERIFY_WHOLE = VERIFY[:VERIFY.index("SELECT doc_id, requested_type, CASE WHEN mis")] + f"""
SELECT doc_id, requested_type, CASE WHEN mis AND NOT {_REFUSED} THEN detected END AS detected_type,
  CASE WHEN {_REFUSED} OR mis THEN 'error' WHEN reason IS NOT NULL THEN 'low_confidence' ELSE 'success' END AS status,
  CASE WHEN {_REFUSED} THEN 'ocr_engine_returned_no_text' WHEN mis THEN 'doc_type_mismatch' ELSE reason END AS reason,
  CAST(doc_id % 97 AS VARCHAR) AS customer_id, CAST(doc_id % 50 AS DOUBLE) AS duration_ms,
  CASE WHEN requested_type = 'aadhaar' AND NOT mis AND NOT {_REFUSED} THEN 'true' ELSE 'false' END AS qr_detected,
  CASE WHEN doc_id % 6 = 1 THEN requested_type = 'aadhaar' AND NOT mis AND NOT {_REFUSED} END AS name_matched
FROM why
"""

PAGE_DEEP = """
, ranked AS (SELECT document_id, risk_score, row_number() OVER (ORDER BY risk_score DESC, document_id) AS rn, count(*) OVER () AS total FROM vault)
SELECT document_id, risk_score, total, total // 2 // 20 + 1 AS page, 20 AS page_size, CAST(ceil(total / 20.0) AS BIGINT) AS total_pages
FROM ranked WHERE rn > total // 2 // 20 * 20 AND rn <= total // 2 // 20 * 20 + 20
"""

# The limiter one request after the other: step n holds the n-th request of every key and the key's accepted times.
REPLAY_STEPS = """
, numbered AS (
  SELECT event_id, client, bucket, epoch_us(ts) AS us, row_number() OVER (PARTITION BY bucket, client ORDER BY ts, event_id) AS n FROM requests),
steps AS (
  SELECT n, event_id, client, bucket, us, CAST([] AS BIGINT[]) AS held FROM numbered WHERE n = 1
  UNION ALL
  SELECT r.n, r.event_id, r.client, r.bucket, r.us,
    list_filter(CASE WHEN len(s.held) < {limit} THEN list_append(s.held, s.us) ELSE s.held END, lambda x: x > r.us - {window})
  FROM steps s JOIN numbered r ON r.bucket = s.bucket AND r.client = s.client AND r.n = s.n + 1)
SELECT event_id, client, bucket, len(held) < {limit} AS accepted,
  CASE WHEN len(held) >= {limit} THEN greatest(1, CAST(trunc(({window} - (us - held[1])) / 1000000.0) AS BIGINT)) END AS retry_after
FROM steps
"""


def replay_sql(requests: str, limit: int, window_seconds: int) -> str:
    """``requests``: the WITH prefix that defines the view of that name."""
    steps = REPLAY_STEPS.format(limit=limit, window=window_seconds * 1_000_000)
    return requests.replace("WITH ", "WITH RECURSIVE ", 1) + steps


# ----------------------------------------------------------------- streams

_JOB_STATUS = "CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'processing' WHEN 'click' THEN 'completed' WHEN 'purchase' THEN 'low_confidence' ELSE 'error' END"
JOB_STATUS = f"""
SELECT CAST(user_id AS VARCHAR) AS job_id, arg_max({_JOB_STATUS}, ts) AS status, count(*) AS events FROM events GROUP BY user_id
"""
REDACT_STREAM = f"SELECT md5({_redacted('text')}) AS text_md5, count(*) AS copies FROM conversations GROUP BY 1"
_FORM_KEPT = " AND ".join(
    [f"(doc_type <> '{t}' OR field IN {in_list(allowed)})" for t, allowed in PII_ALLOWED.items()]
    + [f"(doc_type IN {in_list(PII_ALLOWED)} OR (field NOT LIKE 'raw!_%' ESCAPE '!' AND field <> 'partner_names'))"]
)
INGESTED = f"""
, kept AS (SELECT doc_type, count(*) AS fields, count(DISTINCT doc_id) AS with_fields FROM ({FORM_FACTS}) x WHERE {_FORM_KEPT} GROUP BY 1)
SELECT expected_type AS doc_type, count(*) AS documents, any_value(fields) AS fields, any_value(with_fields) AS with_fields
FROM form_docs LEFT JOIN kept ON doc_type = expected_type GROUP BY 1
"""
AUDIT_STREAM = """
SELECT strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M') AS window_start, doc_type, status, count(*) AS rows,
  round(avg(duration_ms), 4) AS mean_duration_ms
FROM audit GROUP BY ALL
"""
