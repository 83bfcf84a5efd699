"""Registered queries: every operator over the whole driver tables.

Each entry pairs a Spark job with the SQL that must give the same rows, or
with ``None`` where the operator cannot be said in SQL (text similarity and
the flow built on all of it).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions.redaction import REDACTION_RULES
from inkwell.functions.similarity import stage
from inkwell.functions.text import token_sorted
from inkwell.operators import (
    answers, audit, chat, classify, crosscheck, extract, integrity, limits, lines, mining, model_outputs, purge, questions,
    reconcile, redact, retention, star, statements, validate, vault,
)
from inkwell.plans import oracles as o
from inkwell.plans.checked import CHECKED, CHECKED_FIELDS, RULE_FINDINGS
from inkwell.plans.fixtures import Tables, with_views
from inkwell.plans.forms import FORM_FACTS
from inkwell.plans.flows import vault_flow, verify_flow
from inkwell.rules.signatures import PRIMARY_ANCHORS, SIGNATURES
from inkwell.session import DEALT_ROWS, dealt, shared_folder, spread
from inkwell.sources import encryption, files, logs, store
from inkwell.sources.vault_index import read_vault_index
from inkwell.streaming import jobs
from inkwell.streaming.limiter import rate_limit_stream, state_on_disk

Query = Callable[[SparkSession, str], DataFrame]
CATALOG: dict[str, tuple[Query, str | None]] = {}

KEY = b"0123456789abcdef0123456789abcdef"


def register(name: str, sql: str | None = None):
    def keep(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        CATALOG[name] = (lambda spark, sf_dir: fn(Tables(spark, sf_dir)), sql)
        return fn

    return keep


def texts(t: Tables) -> DataFrame:
    return spread(t.documents).select("doc_id", F.col("text").alias("full_text"), "lang", "source")


def type_docs(t: Tables) -> DataFrame:
    return dealt(t.type_docs)


def form_docs(t: Tables) -> DataFrame:
    return dealt(t.form_docs)


def kyc_fields(t: Tables, *names: str) -> DataFrame:
    """kyc in long form."""
    cols = names or ("pan_number", "ifsc", "raw_aadhaar", "account_number", "name", "father_name", "dob")
    entries = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in cols])
    return t.kyc.select("doc_id", F.explode(entries).alias("_e")).select("doc_id", "_e.*")


def boxed_lines(t: Tables) -> DataFrame:
    return t.ocr_lines


# ------------------------------------------------------------- text and PII


@register("redaction_summary", o.redaction_summary("documents", "text", "source"))
def _(t):
    return redact.redaction_summary(spread(t.documents), "text", ["source"])


@register("redacted_documents", o.redacted_texts("documents", "text"))
def _(t):
    return redact.redact_text(spread(t.documents).select("doc_id", "text"), ["text"]).select("doc_id", F.md5("text").alias("text_md5"))


@register("redaction_by_type", with_views("type_docs") + o.redaction_summary("type_docs", "full_text", "expected_type"))
def _(t):
    return redact.redaction_summary(type_docs(t), "full_text", ["expected_type"])


@register("redact_map", with_views("kyc") + o.REDACT_MAP)
def _(t):
    m = F.create_map(
        F.lit("pan"), F.col("pan_number"), F.lit("Api_Key"), F.col("ifsc"), F.lit("prompt"), F.col("name"),
        F.lit("note"), F.concat(F.lit("account "), F.col("account_number")),
    )
    rows = redact.redact_map(t.kyc.select("doc_id", m.alias("m")), "m")
    return rows.select("doc_id", F.explode("m"))


@register("normalise_text", o.NORMALISE)
def _(t):
    out = redact.normalise_text(texts(t))
    return out.select("doc_id", F.md5("norm_text").alias("norm_md5"), F.length("norm_text").alias("norm_chars"))


@register("text_layer_report", o.TEXT_LAYER)
def _(t):
    pages = texts(t).select("doc_id", F.posexplode(F.split("full_text", "\n")).alias("page_num", "full_text"))
    return lines.text_layer_report(pages)


@register("minimise_pii", with_views("kyc") + o.MINIMISE)
def _(t):
    kinds = F.create_map(*[F.lit(x) for x in (0, "bank_passbook", 1, "aadhaar", 2, "form_16", 3, "pan")])
    rows = kyc_fields(t).withColumn("doc_type", kinds[(F.col("doc_id") % 4).cast("int")])
    return extract.minimise_pii(rows).select("doc_id", "doc_type", "field", "value")


@register("mine_dates", with_views("type_docs") + o.mined("date_text", mining.DATE_SHAPE, o.DATE_CONTEXT_SQL))
def _(t):
    return mining.mine_dates(type_docs(t))


@register("mine_amounts", with_views("type_docs") + o.mined("amount_text", mining.AMOUNT_SHAPE, ""))
def _(t):
    return mining.mine_amounts(type_docs(t))


@register("line_search", o.LINE_SEARCH)
def _(t):
    return mining.line_search(texts(t), o.SEARCH_QUERY)


@register("financial_years", o.FINANCIAL_YEARS)
def _(t):
    docs = t.orders.selectExpr("o_orderkey AS doc_id", f"{o.FY_TEXT} AS full_text", "CAST(o_orderdate AS DATE) AS issued")
    docs = docs.withColumn("issued", F.date_format("issued", "dd/MM/yyyy"))
    out = extract.financial_year_table(docs, issued="issued")
    return out.select("doc_id", F.array_join("years", ",").alias("years"), "latest", "inferred")


# ------------------------------------------------------- identifiers, lookups


def identifier_rows(t: Tables) -> DataFrame:
    return t.kyc.selectExpr("doc_id", f"explode({o.IDENTIFIERS_SPARK}) AS e").select("doc_id", "e.kind", "e.value")


@register("validate_identifiers", with_views("kyc") + o.VALIDATE)
def _(t):
    return validate.validate_identifiers(identifier_rows(t)).select("doc_id", "kind", "value", "valid", "reason")


@register("identifier_pass_rates", with_views("kyc") + o.PASS_RATES)
def _(t):
    return validate.pass_rates(validate.validate_identifiers(identifier_rows(t)), ["kind"])


@register("validate_documents", with_views("kyc") + o.VALIDATE_DOCUMENTS)
def _(t):
    kinds = F.create_map(*[F.lit(x) for x in (0, "bank_passbook", 1, "aadhaar", 2, "form_16", 3, "pan", 4, "voter_id")])
    rows = kyc_fields(t).withColumn("doc_type", kinds[(F.col("doc_id") % 5).cast("int")])
    return validate.validate_documents(rows)


@register("type_metadata", with_views("vault") + o.TYPE_METADATA_SQL)
def _(t):
    return validate.with_type_metadata(t.vault.select("document_id", "doc_type"))


@register("normalise_places", o.PLACES)
def _(t):
    names = F.array(*[F.lit(n) for n in o.PLACE_INPUTS])
    rows = t.customer.select(
        F.col("c_custkey").alias("doc_id"), F.get(names, (F.col("c_custkey") % len(o.PLACE_INPUTS)).cast("int")).alias("taluka")
    )
    return validate.normalise_places(rows, ["taluka"])


# ------------------------------------------------------------- statements


def marked_lines(t: Tables) -> DataFrame:
    return t.statement_lines.selectExpr(
        "doc_id", "seq", "CASE WHEN seq % 3 = 0 THEN NULL ELSE type END AS type", "CAST(amount AS STRING) AS amount",
        "CASE WHEN seq % 5 = 0 THEN NULL ELSE CAST(balance AS STRING) END AS balance", "CAST(seq DIV 8 AS BIGINT) AS stretch",
    )


@register("transaction_totals", with_views("statement_lines") + o.TOTALS)
def _(t):
    rows = t.statement_lines.selectExpr(
        "doc_id", "type", "CASE WHEN seq % 17 = 0 THEN 'n/a' ELSE CAST(amount AS STRING) END AS amount"
    )
    out = statements.transaction_totals(rows)
    return out.withColumns({c: F.col(c).cast("double") for c in ("total_amount", "credit_amount", "debit_amount")})


@register("infer_direction", with_views("statement_lines") + o.DIRECTION)
def _(t):
    return statements.infer_direction(marked_lines(t), ["seq"], ["stretch"]).select("doc_id", "seq", "type")


@register("closing_balance", with_views("type_docs", "statement_lines") + o.CLOSING)
def _(t):
    docs = t.type_docs.filter("expected_type = 'bank_statement'")
    return statements.closing_balance(docs, marked_lines(t), ["seq"])


def statement_pages(t: Tables) -> DataFrame:
    """One page per customer and year, printed from the derived statement."""
    printed = F.concat_ws(
        " ", F.date_format("txn_ts", "dd-MM-yyyy"), F.concat(F.lit("S"), F.col("seq").cast("string")), F.lit("TRANSFER"),
        F.col("amount").cast("string"), F.col("balance").cast("string"),
    )
    wrapped = F.when(F.col("seq") % 4 == 0, F.concat(printed, F.lit("\nwrapped note"))).otherwise(printed)
    rows = t.statement_lines.select("doc_id", F.year("txn_ts").alias("page_num"), "seq", wrapped.alias("line"))
    listed = F.array_sort(F.collect_list(F.struct("seq", "line")))
    page = F.concat(
        F.lit("Transaction Details\nDATE TRAN ID PARTICULARS AMOUNT BALANCE\n"),
        F.array_join(F.transform(listed, lambda x: x["line"]), "\n"), F.lit("\nEND OF REPORT\nPage 1 of 1"),
    )
    return rows.groupBy("doc_id", "page_num").agg(page.alias("full_text"))


@register("statement_rows", with_views("statement_lines") + o.STATEMENT_ROWS)
def _(t):
    rows = statements.statement_rows(statement_pages(t))
    return rows.select("doc_id", F.col("page_num").cast("bigint").alias("page_num"), "date", "description", "amount", "type", "balance")


# ------------------------------------------------------------------- vault


@register("vault_filter_ai", with_views("vault") + o.VAULT_AI)
def _(t):
    return vault.vault_filter(t.vault, mode="ai").select("document_id", "doc_type", "mode")


@register("vault_filter_type", with_views("vault") + o.VAULT_TYPE)
def _(t):
    return vault.vault_filter(t.vault, doc_type="Bank_Statement", mode="offline").select("document_id", "doc_type")


@register("vault_filter_review", with_views("vault") + o.VAULT_REVIEW)
def _(t):
    return vault.vault_filter(t.vault, status="review", ocr_required=True).select("document_id", "status", "risk_score")


@register("vault_search", with_views("vault") + o.VAULT_SEARCH)
def _(t):
    return vault.vault_filter(t.vault, search=" Hention ").select("document_id", "filename")


@register("status_category", with_views("vault") + o.STATUS_CATEGORY)
def _(t):
    both = vault.with_status_category(vault.with_status_category(t.vault, "store", "store_category"), "table", "table_category")
    return both.groupBy("store_category", "table_category").agg(F.count("*").alias("documents"), F.sum("document_id").alias("id_sum"))


@register("repo_filter", with_views("vault") + o.REPO_FILTER)
def _(t):
    return vault.repo_filter(t.vault, 3, mode="offline", status="review_required", search="PDF").select("document_id", "filename")


@register("owner_isolation", with_views("vault") + o.OWNER)
def _(t):
    rows = t.vault.withColumn("user_id", F.when(F.col("document_id") % 5 != 0, F.col("user_id")))
    return vault.for_owner(rows, 2, default_owner=2).select("document_id", "user_id")


@register("canonical_analysis", with_views("vault") + o.CANONICAL)
def _(t):
    rows = t.vault.withColumns({
        "confidence": (F.col("document_id") % 100) / 100.0,
        "fields": F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source")),
        "extracted_fields": F.when(F.col("document_id") % 2 == 0, F.create_map(F.lit("source"), F.lit("extracted"))),
    })
    out = vault.canonical_analysis(rows)
    return out.select(
        F.col("document_id").cast("bigint").alias("document_id"), "document_type", "confidence", "verification_status", "risk_score",
        F.col("extracted_fields")["lang"].alias("f_lang"), F.col("extracted_fields")["source"].alias("f_source"),
    )


@register("field_layers", with_views("kyc", "expected", "qr_fields") + o.FIELD_LAYERS)
def _(t):
    layers = kyc_fields(t, "pan_number", "name", "dob").withColumn("layer", F.lit(1))
    layers = layers.unionByName(t.expected.withColumn("layer", F.lit(2))).unionByName(t.qr_fields.withColumn("layer", F.lit(3)))
    return vault.merge_field_layers(layers.withColumnRenamed("doc_id", "document_id"))


@register("vault_stats", with_views("vault") + o.VAULT_STATS)
def _(t):
    return vault.vault_stats(t.vault)


@register("owner_stats", with_views("vault") + o.OWNER_STATS)
def _(t):
    return vault.owner_stats(t.vault)


@register("documents_by_type", with_views("vault") + o.BY_TYPE)
def _(t):
    return vault.docs_by_type(t.vault)


@register("vault_page", with_views("vault") + o.PAGE)
def _(t):
    return vault.page(t.vault, page=3, limit=20, newest="file_size").select("document_id", "file_size", "total", "page", "page_size", "total_pages")


@register("vault_page_after", with_views("vault") + o.PAGE_AFTER)
def _(t):
    return vault.page_after(t.vault, (o.SEEN_SIZE, o.SEEN_ID), limit=20, newest="file_size").select("document_id", "file_size")


@register("page_deep", with_views("vault") + o.PAGE_DEEP)
def _(t):
    middle = t.vault.count() // 2 // 20 + 1
    out = vault.deep_page(t.vault, page=middle, limit=20, newest="risk_score", ranges=16, small=50)
    return out.select("document_id", "risk_score", "total", "page", "page_size", "total_pages")


def child_tables(t: Tables) -> dict[str, DataFrame]:
    v = t.vault
    return {
        "documents": v,
        "ocr_results": v.selectExpr("document_id", "explode(array(1, 2)) AS row_id", "md5(extracted_text) AS text_md5").withColumn(
            "text_md5", F.concat_ws("-", "text_md5", "row_id")
        ),
        "extracted_fields": v.filter("document_id % 3 = 0").selectExpr("document_id", "1 AS row_id", "lang AS field_lang"),
        "ai_analyses": v.filter("doc_type = 'ai_analyzed'").selectExpr("document_id", "1 AS row_id", "source AS ai_source"),
    }


@register("document_view", with_views("vault") + o.DOCUMENT_VIEW)
def _(t):
    c = child_tables(t)
    docs = c["documents"].select("document_id", F.nullif("verification_status", F.lit("unsupported")).alias("verification_status"), "risk_score")
    return vault.document_view(docs, c["ocr_results"], c["extracted_fields"], c["ai_analyses"])


@register("cascade_delete", with_views("vault") + o.CASCADE)
def _(t):
    ids = t.labels.filter("toxic = 1").select(F.col("doc_id").alias("document_id"))
    return vault.cascade_delete(child_tables(t), ids)[1]


@register("upsert_profiles", o.PROFILES)
def _(t):
    c = t.customer
    existing = c.filter("c_custkey % 3 <> 0").selectExpr(
        "c_custkey AS id", "concat(lower(c_mktsegment), c_custkey, '@old.example') AS email", "c_name AS full_name", "'user' AS role"
    )
    incoming = c.filter("c_custkey % 2 = 0 OR c_custkey % 3 = 0").selectExpr(
        "c_custkey AS id", "concat('u', c_custkey, '@new.example') AS email",
        "CASE WHEN c_custkey % 4 = 0 THEN '' ELSE upper(c_name) END AS full_name", "CAST(NULL AS STRING) AS role",
    )
    return vault.upsert_profiles(existing, incoming, ["U10@new.example ", "machinery1@old.example"])


@register("fan_out_integrity", with_views("vault") + o.FAN_OUT)
def _(t):
    signals = F.expr(
        "CASE WHEN risk_score >= 45 THEN array(named_struct('signal', 'invalid_checksum', 'category', 'consistency', 'score', 30), "
        "named_struct('signal', status, 'category', CAST(NULL AS STRING), 'score', CAST(NULL AS INT))) END"
    )
    return star.fan_out(t.vault.withColumn("signals", signals))["document_integrity_checks"]


@register("fan_out_documents", with_views("vault") + o.FAN_OUT_DOCS)
def _(t):
    rows = star.fan_out(t.vault.withColumn("content", F.encode("extracted_text", "UTF-8")))
    return rows["documents"].select("document_id", "original_filename", "doc_type", "checksum_sha256", "storage_path")


def star_tables(t: Tables) -> dict[str, DataFrame]:
    rows = t.vault.withColumns({
        "content": F.encode("extracted_text", "UTF-8"),
        "fields": F.expr("CASE WHEN document_id % 3 = 0 THEN map('filename', filename, 'lang', lang) WHEN document_id % 3 = 1 THEN map() END"),
        "ai": F.expr(
            "CASE WHEN mode = 'ai' THEN named_struct('provider', CASE WHEN document_id % 2 = 0 THEN 'p' || user_id END, "
            "'model', CAST(NULL AS STRING), 'summary', filename, 'classification', CASE WHEN document_id % 5 = 0 THEN 'other' END) END"
        ),
        "confidence": F.expr("CASE WHEN document_id % 4 > 0 THEN (document_id % 101) / 100.0 END").cast("double"),
        "page_count": F.expr("CASE WHEN document_id % 6 > 0 THEN CAST(document_id % 6 AS INT) END"),
    })
    return star.fan_out(rows)


@register("fan_out_files", with_views("vault") + o.FAN_OUT_FILES)
def _(t):
    return star_tables(t)["document_files"]


@register("fan_out_ocr", with_views("vault") + o.FAN_OUT_OCR)
def _(t):
    rows = star_tables(t)["ocr_results"]
    return rows.select("document_id", F.md5("raw_text").alias("text_md5"), "detected_type", F.col("confidence").cast("double").alias("confidence"), "page_count")


@register("fan_out_checks", with_views("vault") + o.FAN_OUT_CHECKS)
def _(t):
    return star_tables(t)["authenticity_checks"]


@register("fan_out_fields", with_views("vault") + o.FAN_OUT_FIELDS)
def _(t):
    rows = star_tables(t)["extracted_fields"]
    return rows.select("document_id", "verification_status", F.explode("fields").alias("field", "value"))


@register("fan_out_ai", with_views("vault") + o.FAN_OUT_AI)
def _(t):
    return star_tables(t)["ai_analyses"]


@register("star_published", with_views("vault") + o.STAR_PUBLISHED)
def _(t):
    folder = f"{shared_folder(t.spark)}/star"
    tables = star_tables(t)
    halves = [{name: df.where(F.col("document_id") % 2 == i) for name, df in tables.items()} for i in (0, 1)]
    for half in halves:
        star.publish_star(t.spark, half, folder)
    counts = [
        star.read_star(t.spark, folder, name).agg(F.lit(name).alias("child"), F.count("*").alias("rows"), F.count_distinct("document_id").alias("documents"))
        for name in tables
    ]
    out = counts[0]
    for more in counts[1:]:
        out = out.union(more)
    return out


@register("purge_files", with_views("vault") + o.PURGE_FILES)
def _(t):
    folder = f"{shared_folder(t.spark)}/vault-files"
    rows = t.vault.select("document_id", "user_id", "status", "file_size")
    purge.create(rows, folder, files=8)
    done = purge.purge(t.spark, folder, rows.where("user_id = 3 AND status <> 'completed'"), rows.schema)
    left = purge.read(t.spark, folder, rows.schema)
    return left.groupBy("user_id").agg(F.count("*").alias("documents"), F.sum("file_size").alias("bytes")).withColumn("deleted", F.lit(done["deleted"]))


@register("migrate_summary", with_views("vault") + o.MIGRATE)
def _(t):
    legacy = t.vault.withColumn("document_id", F.when(F.col("document_id") % 50 != 49, F.col("document_id")))
    _rows, summary = star.migrate(legacy, t.vault.filter("document_id % 4 = 0"), 99)
    return summary


@register("migrate_rows", with_views("vault") + o.MIGRATE_ROWS)
def _(t):
    rows, _summary = star.migrate(t.vault, t.vault.filter("document_id % 4 = 0"), 99)
    return rows.select("document_id", "user_id", "doc_type", "mode")


@register("encrypt_backfill", o.ENCRYPT)
def _(t):
    rows = spread(t.documents).select("doc_id", F.encode("text", "UTF-8").alias("payload"), F.col("n_chars"))
    half = F.col("doc_id") % 2 == 0
    mixed = encryption.backfill_encrypt(rows.filter(half), "payload", KEY).drop("migrated").unionByName(rows.filter(~half))
    sealed = encryption.backfill_encrypt(mixed, "payload", KEY)
    size = sealed.withColumn("sealed_bytes", F.octet_length("payload"))
    opened = encryption.decrypt_column(size, "payload", KEY)
    return opened.select("doc_id", "migrated", "sealed_bytes", F.md5("payload").alias("payload_md5"))


@register("log_lines", o.LOG_LINES)
def _(t):
    raw = t.events.select(
        F.to_json(F.struct(
            F.lit("INFO").alias("level"), F.col("event_type").alias("event"),
            F.concat(F.lit("user "), F.lpad(F.col("user_id").cast("string"), 9, "0")).alias("message"),
            F.col("event_id").cast("string").alias("request_id"), F.lit("abc").alias("auth_token"), F.col("props").alias("props"),
        )).alias("value")
    )
    parsed = logs.parse_log(logs.log_lines(logs.parse_log(raw)))
    return parsed.select(
        "request_id", "level", "event", "message", F.col("extras")["auth_token"].alias("auth_token"), F.col("extras")["props"].alias("props")
    )


@register("triage_uploads", o.TRIAGE)
def _(t):
    rows = spread(t.documents).select("doc_id", F.expr(o.TRIAGE_NAME).alias("name"), F.expr(o.TRIAGE_CONTENT).alias("content"))
    out = files.triage(rows.withColumn("length", F.octet_length("content")))
    return out.select("doc_id", "ext", "accepted", "reject_reason")


@register("triage_folder", o.TRIAGE_FOLDER)
def _(t):
    folder = f"{shared_folder(t.spark)}/uploads"
    name = F.concat_ws("_", F.lit("u"), "doc_id", F.replace(F.expr(o.TRIAGE_NAME), F.lit("../etc/"), F.lit("..")))
    rows = spread(t.documents).select(
        F.concat(F.lit("lot="), F.pmod("doc_id", F.lit(5)), F.lit("/part="), F.pmod("doc_id", F.lit(3)), F.lit("/"), name).alias("path"),
        F.expr(o.TRIAGE_CONTENT).alias("content"),
    )
    store.write_files(rows, folder)
    out = files.triage_files(t.spark, folder)
    doc_id = F.split("name", "_")[1].cast("long").alias("doc_id")
    return out.select(doc_id, "ext", "length", "accepted", "reject_reason")


@register("vault_index", with_views("vault") + o.VAULT_INDEX)
def _(t):
    folder = f"{shared_folder(t.spark)}/index"
    record = F.struct(
        F.when(F.col("document_id") % 4 > 0, F.col("document_id").cast("string")).alias("document_id"),
        F.col("document_id").cast("string").alias("id"), F.col("user_id").cast("string").alias("user_id"), "filename", "doc_type", "mode",
        "status", "verification_status", "risk_score", "ocr_required", "file_size", F.array("extracted_text", F.lit('"}, {[')).alias("suspicious_signals"),
    )
    # index files of some hundred records each, whole arrays
    lots = t.vault.select(F.floor(F.col("document_id") / 500).alias("lot"), F.to_json(record).alias("record"))
    arrays = lots.groupBy("lot").agg(F.concat(F.lit("[\n  "), F.array_join(F.collect_list("record"), ",\n  "), F.lit("\n]\n")).alias("text"))
    store.write_files(arrays.select(F.concat(F.lit("lot"), "lot", F.lit(".json")).alias("path"), F.encode("text", "UTF-8").alias("content")), folder)
    out = read_vault_index(t.spark, folder, split=100_000)
    return out.select(
        F.col("document_id").cast("long").alias("document_id"), "user_id", "filename", "doc_type", "mode", "status", "verification_status",
        F.col("risk_score").cast("long").alias("risk_score"), "ocr_required", "file_size",
        F.md5(F.concat_ws("|", "suspicious_signals")).alias("signals_md5"),
    )


# -------------------------------------------------------- classification


@register("match_signatures", with_views("type_docs") + o.MATCH_SIGNATURES)
def _(t):
    return classify.match_signatures(classify.split_pages(type_docs(t))).select("doc_id", "page_num", "doc_type", "tier", "evidence")


@register("match_rule_table", with_views("type_docs") + o.MATCH_SIGNATURES)
def _(t):
    rules = t.spark.createDataFrame(
        [(d, tier, p) for d in PRIMARY_ANCHORS for tier, some in (("primary", PRIMARY_ANCHORS[d]), ("secondary", classify.secondary_patterns(d))) for p in some],
        "doc_type string, tier string, pattern string",
    )
    found = classify.match_signatures(classify.split_pages(type_docs(t)), rules)
    return found.select("doc_id", "page_num", "doc_type", "tier", "evidence")


@register("match_signature_table", with_views("type_docs") + o.MATCH_RULES)
def _(t):
    rules = t.spark.createDataFrame(o.OWN_RULES, "doc_type string, tier string, pattern string")
    return classify.match_signatures(classify.split_pages(type_docs(t)), rules).select("doc_id", "page_num", "doc_type", "tier", "evidence")


@register("classify", with_views("type_docs") + o.classify_sql(0))
def _(t):
    out = classify.classify(type_docs(t))
    return out.select(
        "doc_id", "doc_type", "document_type", "confidence", "confidence_level", "issuer", F.array_join("evidence", "|").alias("evidence")
    )


@register("classify_documents", o.CLASSIFY_DOCUMENTS)
def _(t):
    typed = F.when(F.col("doc_type") == "unknown", "unknown").otherwise("typed")
    return classify.classify(texts(t)).groupBy(typed.alias("doc_type")).agg(F.count("*").alias("documents"))


@register("type_mismatch", with_views("type_docs") + o.TYPE_MISMATCH)
def _(t):
    kinds = F.array(*[F.lit(k) for k in SIGNATURES])
    asked = F.get(kinds, (F.col("doc_id") % len(SIGNATURES)).cast("int"))
    return classify.type_mismatch(type_docs(t).withColumn("requested_type", asked).drop("expected_type"))


@register("detection_matrix", with_views("type_docs") + o.DETECTION_MATRIX)
def _(t):
    return classify.detection_matrix(type_docs(t))


@register("self_detection", with_views("type_docs") + o.SELF_DETECTION)
def _(t):
    return classify.self_detection(type_docs(t))


# ------------------------------------------------------------ extraction


def classified_docs(t: Tables) -> DataFrame:
    return type_docs(t).withColumnRenamed("expected_type", "doc_type")


@register("extract_fields", with_views("type_docs") + o.EXTRACT)
def _(t):
    return extract.extract_fields(classified_docs(t)).select("doc_id", "doc_type", "field", "value", "confidence")


@register("extract_minimised", with_views("type_docs") + o.EXTRACT_MINIMISED)
def _(t):
    return extract.minimise_pii(extract.extract_fields(classified_docs(t))).select("doc_id", "doc_type", "field", "value")


@register("extract_forms", with_views("kyc") + FORM_FACTS)
def _(t):
    docs = form_docs(t).withColumnRenamed("expected_type", "doc_type")
    return extract.extract_fields(docs).select("doc_id", "doc_type", "field", "value")


@register("form_detection", with_views("form_docs") + o.FORM_DETECTION)
def _(t):
    return classify.self_detection(form_docs(t))


@register("fill_rates", with_views("type_docs") + o.FILL_RATES)
def _(t):
    docs = classified_docs(t)
    return extract.fill_rates(extract.extract_fields(docs), docs)


@register("language_coverage", with_views("kyc") + o.LANGUAGE)
def _(t):
    docs = t.kyc.selectExpr("doc_id", f"{o.LANG_TYPE} AS doc_type", f"{o.LANG_TEXT} AS full_text")
    fields = t.kyc.selectExpr("doc_id", f"explode({o.LANG_FIELDS_SPARK}) AS e").select("doc_id", "e.field", "e.value")
    return extract.language_coverage(docs, fields)


@register("positional_names", with_views("kyc") + o.POSITIONAL)
def _(t):
    rows = t.kyc.selectExpr("doc_id", f"posexplode({o.CARD_LINES}) AS (line_no, text)").selectExpr(
        "doc_id", "1 AS page_num", "line_no", "text", "0.9 AS confidence"
    )
    return extract.positional_names(rows).select("doc_id", "position", "field", "value")


# ------------------------------------------------------ cross-source checks


@register("cross_check")
def _(t):
    exp = t.expected.withColumnRenamed("field", "key")
    return crosscheck.cross_check(kyc_fields(t), exp)


@register("cross_check_outcomes", with_views("kyc", "expected") + o.CROSS_CHECK)
def _(t):
    exp = t.expected.withColumnRenamed("field", "key")
    out = crosscheck.cross_check(kyc_fields(t), exp)
    return out.groupBy("key", "reason").agg(F.count("*").alias("checks"), F.count_if(F.col("score") == 1.0).alias("exact"))


@register("cross_check_lists", with_views("kyc") + o.CROSS_CHECK_LISTS)
def _(t):
    fields = kyc_fields(t).withColumn("values", F.lit(None).cast("array<string>")).unionByName(
        t.kyc.select("doc_id", F.lit("partner_names").alias("field"), F.lit(None).cast("string").alias("value"), F.expr(o.PARTNERS).alias("values"))
    )
    key = F.expr("CASE WHEN doc_id % 8 = 7 THEN 'partner_names' ELSE 'partners' END").alias("key")
    expected = t.kyc.select("doc_id", key, F.lit(None).cast("string").alias("value"), F.expr(o.EXPECTED_PARTNERS).alias("values"))
    return crosscheck.cross_check_verdicts(fields, expected).select("doc_id", "key", "matched", "reason")


@register("similarity_stages", with_views("kyc") + o.SIMILARITY_STAGES)
def _(t):
    pairs = t.kyc.select(token_sorted(F.col("name")).alias("one"), token_sorted(F.expr(o.OTHER_NAME)).alias("two"))
    by = stage(F.col("one"), F.col("two"), crosscheck.THRESHOLD)
    return pairs.groupBy(by.alias("stage")).agg(F.count("*").alias("pairs"))


@register("reconcile_qr", with_views("kyc", "qr_fields") + o.RECONCILE_QR)
def _(t):
    merged, _d = reconcile.reconcile_qr(kyc_fields(t, "pan_number", "name", "dob"), t.qr_fields)
    return merged


@register("qr_disagreements", with_views("kyc", "qr_fields") + o.QR_DISAGREE)
def _(t):
    _m, rows = reconcile.reconcile_qr(kyc_fields(t, "pan_number", "name", "dob"), t.qr_fields)
    return rows.select("doc_id", "field", "ocr_value", "qr_value", "resolution")


@register("parse_qr", with_views("kyc") + o.PARSE_QR)
def _(t):
    rows = t.kyc.selectExpr("doc_id", f"{o.QR_TYPE} AS doc_type", f"{o.QR_PAYLOAD} AS payload")
    return reconcile.parse_qr(rows)


@register("qr_findings", with_views("kyc", "qr_fields") + o.QR_FINDINGS)
def _(t):
    out = integrity.qr_findings(kyc_fields(t, "pan_number", "name", "dob"), t.qr_fields)
    return out.select("doc_id", "qr_key", "signal", "score", "description")


@register("reconcile_micr", with_views("kyc") + o.MICR)
def _(t):
    cheques = t.kyc.selectExpr("doc_id", f"{o.MICR_LINE} AS text")
    fields = t.kyc.selectExpr("doc_id", f"explode({o.MICR_FIELDS_SPARK}) AS e").select("doc_id", "e.field", "e.value")
    out = reconcile.reconcile_micr(cheques, fields)
    return out.select(
        "doc_id", "cheque_number", "micr_code", "account_number", "tran_code", "micr_confidence", "micr_match",
        F.size("micr_disagreements").cast("bigint").alias("n_disagreements"),
    )


# -------------------------------------------------------------- integrity


@register("overlap_findings", with_views("ocr_lines") + o.OVERLAP)
def _(t):
    return integrity.overlap_findings(boxed_lines(t)).select("doc_id", "signal", "score")


@register("label_findings", with_views("ocr_lines") + o.LABEL_FINDINGS)
def _(t):
    docs = t.orders.selectExpr("o_orderkey AS doc_id", f"{o.ORDER_TYPE} AS doc_type")
    return integrity.label_findings(boxed_lines(t), docs).select("doc_id", "signal", "score", "description")


@register("alignment_findings", with_views("ocr_lines") + o.ALIGNMENT)
def _(t):
    return integrity.alignment_findings(boxed_lines(t)).select("doc_id", "signal", "score")


@register("font_findings", with_views("ocr_lines") + o.FONT)
def _(t):
    return integrity.font_findings(boxed_lines(t)).select("doc_id", "signal", "score")


@register("field_findings", with_views("kyc") + o.FIELD_FINDINGS)
def _(t):
    import datetime

    docs = t.kyc.selectExpr("doc_id", f"{o.FIELD_TYPE} AS doc_type")
    out = integrity.field_findings(kyc_fields(t), docs, today=datetime.date(2026, 1, 1))
    return out.select("doc_id", "signal", "score", "description")


@register("rule_findings", with_views("kyc") + RULE_FINDINGS)
def _(t):
    rows = t.spark.sql("WITH kyc AS (SELECT * FROM {source})" + CHECKED + "SELECT * FROM checked", source=t.kyc)
    entries = F.array(*[
        F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("field"), F.col(name).alias("value"))
        for kind, names in CHECKED_FIELDS.items() for name in names
    ])
    fields = rows.select("doc_id", "doc_type", F.explode(entries).alias("_e")).filter("_e.kind = doc_type").select("doc_id", "_e.field", "_e.value")
    return integrity.field_findings(fields, rows.select("doc_id", "doc_type", "full_text")).select("doc_id", "signal", "score", "description")


@register("all_findings", with_views("ocr_lines") + o.ALL_FINDINGS)
def _(t):
    b = boxed_lines(t)
    both = integrity.all_findings(integrity.alignment_findings(b), integrity.font_findings(b))
    place = (F.col("ordinal.source") * 1_000_000 + F.col("ordinal.place")).alias("ordinal")
    return both.select("doc_id", place, "signal", "category", "score", "description")


def derived_findings(t: Tables) -> DataFrame:
    return t.ocr_lines.selectExpr("doc_id", "line_no AS ordinal", f"{o.RISK_SIGNAL} AS signal", f"{o.RISK_SCORE} AS score", "text AS description")


@register("risk_score", with_views("ocr_lines") + o.RISK)
def _(t):
    docs = t.orders.selectExpr("o_orderkey AS doc_id", f"{o.ORDER_TYPE} AS doc_type")
    out = integrity.risk_score(derived_findings(t), docs)
    return out.withColumn("suspicious_signals", F.array_join("suspicious_signals", "|"))


@register("confidence_pages", with_views("ocr_lines") + o.CONF_PAGES)
def _(t):
    return lines.confidence_rollup(boxed_lines(t))[0]


@register("confidence_documents", with_views("ocr_lines") + o.CONF_DOCS)
def _(t):
    return lines.confidence_rollup(boxed_lines(t))[1]


@register("field_confidence", with_views("ocr_lines") + o.FIELD_CONF)
def _(t):
    fields = t.orders.selectExpr("o_orderkey AS doc_id", f"explode({o.CONF_FIELDS_SPARK}) AS e").select("doc_id", "e.field", "e.value")
    docs = lines.confidence_rollup(boxed_lines(t))[1]
    return lines.field_confidence(fields, boxed_lines(t), docs, kept=fields.filter("field = 'birth'"))


@register("document_status", with_views("ocr_lines") + o.DOC_STATUS)
def _(t):
    docs = lines.confidence_rollup(boxed_lines(t))[1].withColumn("checksum_valid", F.col("doc_id") % 19 != 0)
    both = vault.with_doc_status(docs, True).withColumnRenamed("doc_status", "vault_status")
    return vault.with_doc_status(both, False, 0.95).select("doc_id", "vault_status", F.col("doc_status").alias("api_status"))


@register("ocr_gate", with_views("ocr_lines") + o.GATE)
def _(t):
    docs = t.orders.selectExpr(
        "o_orderkey AS doc_id", "CASE WHEN o_orderkey % 23 = 0 THEN '  ' ELSE o_orderpriority END AS full_text",
        "CASE WHEN o_orderkey % 29 = 0 THEN 0.0D ELSE 0.9D END AS average_confidence",
        "CASE WHEN o_orderkey % 31 = 0 THEN 'engine crashed' END AS engine_error",
    )
    return vault.ocr_gate(docs, boxed_lines(t)).select("doc_id", "usable", "reason", "message")


@register("reading_order", with_views("ocr_lines") + o.READING_ORDER)
def _(t):
    return lines.reading_order(boxed_lines(t)).select("doc_id", "line_no", "reading_pos")


@register("merge_passes", with_views("ocr_lines").replace("WITH ", "WITH RECURSIVE ", 1) + o.MERGE_PASSES)
def _(t):
    en = boxed_lines(t).withColumn("line_no", F.col("line_no").cast("int"))
    dev = en.selectExpr(
        "doc_id", "page_num", "line_no", "CASE WHEN line_no % 2 = 0 THEN concat('नाव ', text) ELSE text END AS text",
        "confidence - 0.01 AS confidence", "x0 + 1 AS x0", "y0 + CASE WHEN line_no % 3 = 0 THEN 400 ELSE 2 END AS y0", "x1 + 1 AS x1",
        "y1 + CASE WHEN line_no % 3 = 0 THEN 400 ELSE 2 END AS y1",
    )
    return lines.merge_passes(en, dev)


# ---------------------------------------------- governance, chat, questions


@register("retention_plan", with_views("retention_index", "retention_files") + o.RETENTION)
def _(t):
    return retention.retention_plan(t.retention_index, t.retention_files, "2000-01-01 00:00:00", 365)[0]


@register("retention_summary", with_views("retention_index", "retention_files") + o.RETENTION_SUMMARY)
def _(t):
    return retention.retention_plan(t.retention_index, t.retention_files, "2000-01-01 00:00:00", 365)[1]


@register("removal_set", with_views("retention_index") + o.REMOVAL)
def _(t):
    index = t.retention_index
    doomed, remaining = retention.removal_set(index.filter("document_id % 3 = 0"), index.filter("document_id % 5 = 0"), index)
    kinds = doomed.withColumn("state", F.lit("removed")).unionByName(remaining.select("document_id").withColumn("state", F.lit("kept")))
    return kinds


@register("audit_rows", with_views("audit") + o.AUDIT_ROWS)
def _(t):
    extra = F.create_map(F.lit("source"), F.col("doc_type"), F.lit("engine_error"), F.col("props"), F.lit("pages_count"), F.lit("2"))
    rows = audit.audit_rows(t.audit.withColumn("extra_meta", extra))
    return rows.select(
        "event", "doc_type", "status", "job_id", "customer_id", "duration_ms", F.size("extra_meta").cast("bigint").alias("n_extra"),
        F.col("extra_meta")["source"].alias("source"),
    )


@register("audit_rollup", with_views("audit") + o.AUDIT_ROLLUP)
def _(t):
    return audit.audit_rollup(t.audit)


@register("chat_sessions", with_views("chat_messages") + o.SESSIONS)
def _(t):
    m = t.chat_messages
    known = m.filter("document_id % 2 = 0 AND turn < 2").selectExpr(
        "user_id", "document_id", "concat('s', document_id, '_', turn) AS session_id", "turn AS created_at"
    )
    return chat.sessions_for(m, known)


@register("chat_history", with_views("chat_messages") + o.HISTORY)
def _(t):
    return chat.chat_history(t.chat_messages, limit=4).select("document_id", "user_id", "role", "position", F.md5("content").alias("content_md5"))


@register("followup_context", with_views("chat_messages") + o.FOLLOWUP)
def _(t):
    rows = t.chat_messages.withColumn("content", F.expr(o.FOLLOWUP_CONTENT))
    out = chat.followup_context(rows, stretch=3)
    return out.select(
        "document_id", "turn", "is_followup", F.md5("last_answer").alias("answer_md5"), F.md5("last_question").alias("question_md5")
    )


@register("replay_limits", o.replay_sql(with_views("requests"), 3, 86400))
def _(t):
    return limits.replay_limits(t.requests, {"upload": 3, "ai_chat": 3, "cleanup": 3}, window_seconds=86400).select(
        "event_id", "client", "bucket", "accepted", "retry_after"
    )


@register("detect_intents", with_views("questions") + o.INTENTS_SQL)
def _(t):
    docs = t.type_docs.select("doc_id", F.col("expected_type").alias("doc_type"))
    return questions.detect_intents(t.questions, docs).select("doc_id", "question", "intent")


@register("lookup_fields", with_views("type_docs", "questions") + o.LOOKUP)
def _(t):
    docs = t.type_docs.withColumnRenamed("expected_type", "doc_type")
    asked = questions.detect_intents(t.questions, docs.select("doc_id", "doc_type"))
    some = kyc_fields(t, "name", "pan_number").filter("doc_id % 2 = 1")
    return questions.lookup_fields(asked, some, docs)


@register("summaries", with_views("type_docs") + o.SUMMARIES)
def _(t):
    docs = t.type_docs.withColumnRenamed("expected_type", "doc_type")
    return questions.summaries(docs, kyc_fields(t, "name", "pan_number"))


@register("key_fields", with_views("type_docs") + o.KEY_FIELDS)
def _(t):
    docs = t.type_docs.withColumnRenamed("expected_type", "doc_type")
    return questions.key_fields(kyc_fields(t, "name", "pan_number", "ifsc"), docs)


@register("answers", with_views("type_docs", "dialogues") + o.ANSWERS)
def _(t):
    docs = t.type_docs.selectExpr(
        "doc_id", "expected_type AS doc_type", "concat('doc_', doc_id, '.pdf') AS filename", "full_text",
        "CASE WHEN doc_id % 5 = 0 THEN 'review_required' WHEN doc_id % 5 = 1 THEN 'unsupported' ELSE 'verified' END AS verification_status",
        "CAST(0 AS INT) AS risk_score", "CAST(NULL AS STRING) AS signals",
    )
    out = answers.answers(t.dialogues, docs, kyc_fields(t, "name", "pan_number"))
    return out.select("document_id", "turn", "rule", "answer")


@register("normalise_model_outputs", with_views("type_docs") + o.MODEL_OUTPUTS)
def _(t):
    docs = type_docs(t)
    raw = dealt(t.kyc.selectExpr("doc_id", f"{o.MODEL_ANSWER} AS raw"))
    out = model_outputs.normalise_model_outputs(raw, docs, kyc_fields(t, "name", "pan_number"))
    return out.withColumn("extracted_fields", F.to_json(F.map_from_entries(F.array_sort(F.map_entries("extracted_fields"))))).withColumn("evidence", F.array_join("evidence", "|"))


# ------------------------------------------------------------ whole flows


@register("vault_summary")
def _(t):
    import datetime

    docs = type_docs(t).withColumn("average_confidence", F.lit(0.9)).drop("expected_type")
    out = vault_flow(docs, t.qr_fields, today=datetime.date(2026, 1, 1))["documents"]
    return out.groupBy("doc_type", "doc_status", "verification_status", "priority", "checksum_reason").agg(
        F.count("*").alias("documents"), F.sum("risk_score").alias("risk_sum")
    )


@register("verify_as_claimed", with_views("type_docs") + o.VERIFY)
def _(t):
    asked = F.when(F.col("doc_id") % 4 == 0, "gst_certificate").otherwise(F.col("expected_type"))
    requests = type_docs(t).withColumn("requested_type", asked).drop("expected_type")
    return verify_flow(requests)["documents"].drop("confidence")


@register("verify_whole", with_views("type_docs") + o.VERIFY_WHOLE)
def _(t):
    asked = F.when(F.col("doc_id") % 4 == 0, "gst_certificate").otherwise(F.col("expected_type"))
    requests = type_docs(t).withColumns({
        "requested_type": asked, "average_confidence": F.when(F.col("doc_id") % 11 == 0, 0.0).otherwise(0.9),
        "job_id": F.col("doc_id"), "customer_id": F.col("doc_id") % 97, "duration_ms": F.col("doc_id") % 50,
    }).drop("expected_type")
    lines = requests.where("doc_id % 9 <> 5").select("doc_id", F.explode(F.split("full_text", "\n")).alias("text"))
    code = "concat('<PrintLetterBarcodeData uid=\"', raw_aadhaar, '\" name=\"CODED NAME\" gender=\"F\" dob=\"', dob, '\" />')"
    coded = t.kyc.where("doc_id % 6 = 1")
    payloads = coded.select("doc_id", F.expr(code).alias("payload"))
    expected = coded.select("doc_id", F.lit("name").alias("key"), F.lit("Name, Coded").alias("value"))
    out = verify_flow(requests, lines, payloads, expected)
    audit = out["audit"].select(
        F.col("job_id").cast("long").alias("doc_id"), "customer_id", "duration_ms", F.col("extra_meta")["qr_detected"].alias("qr_detected")
    )
    names = out["cross_check"].select("doc_id", F.col("matched").alias("name_matched"))
    return out["documents"].drop("confidence").join(audit, "doc_id").join(names, "doc_id", "left")


# --------------------------------------------------------------- streams


def streamed(t: Tables, table: str) -> DataFrame:
    """A driver table read as a stream of its file, or of the files of its folder."""
    path = f"{t.sf_dir}/{table}.parquet"
    # a stream takes a single file only by a pattern; the pattern finds a folder as well
    return t.spark.readStream.schema(t.spark.read.parquet(path).schema).parquet(f"{t.sf_dir}/{table}[.]parquet")


def drained(t: Tables, stream: DataFrame, mode: str = "append") -> DataFrame:
    """Everything a stream emitted, written to the shared folder batch by batch."""
    folder = shared_folder(t.spark)
    out = f"{folder}/out"

    def write(batch: DataFrame, batch_id: int) -> None:
        # a batch replayed after a failure overwrites itself
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    jobs.drain(stream, write, f"{folder}/progress", mode)
    return t.spark.read.parquet(out).drop("batch") if mode == "append" else t.spark.read.parquet(out)


@register("rate_limit_stream", o.replay_sql(with_views("requests"), 3, 86400))
def _(t):
    folder = shared_folder(t.spark)
    events = t.requests.select("event_id", "ts", "client", "bucket").withColumn("client", F.col("client").cast("string"))
    # five sets of files after one another, of six days each, with some requests up to two hours late
    arrival = F.unix_timestamp(F.col("ts").cast("timestamp")) + F.pmod("event_id", F.lit(7)) * 1200
    days = F.floor((arrival - F.unix_timestamp(F.lit("2024-01-01").cast("timestamp"))) / (6 * 86400 + 1))
    slices = events.withColumn("slice", F.greatest(F.lit(0), F.least(F.lit(4), days)))
    # at the end a clock's request, late enough that all others are over
    clock = events.agg(F.max("ts").alias("ts")).select(
        F.lit(None).cast("long").alias("event_id"), (F.col("ts").cast("timestamp") + F.expr("INTERVAL 10 DAYS")).alias("ts"),
        F.lit("clock").alias("client"), F.lit("clock").alias("bucket"),
    )
    for part in [*(slices.where(F.col("slice") == i).drop("slice") for i in range(5)), clock]:
        part.withColumn("ts", F.col("ts").cast("timestamp")).write.mode("append").parquet(f"{folder}/in")
    stream = jobs.file_stream(t.spark, f"{folder}/in", "event_id long, ts timestamp, client string, bucket string", files_per_batch=2)
    with state_on_disk(t.spark):
        verdicts = drained(t, rate_limit_stream(stream, {"upload": 3, "ai_chat": 3, "cleanup": 3}, 86400, watermark="7 days"))
    return verdicts.select("event_id", F.col("client").cast("long").alias("client"), "bucket", "accepted", "retry_after")


@register("redact_stream", o.REDACT_STREAM)
def _(t):
    out = jobs.redact_stream(streamed(t, "conversations").select(F.col("text").alias("value")))
    return drained(t, out).groupBy(F.md5("value").alias("text_md5")).agg(F.count("*").alias("copies"))


@register("ingest_stream", with_views("form_docs") + o.INGESTED)
def _(t):
    folder = shared_folder(t.spark)
    schema = t.form_docs.select("doc_id", "full_text")
    # several files of some thousand documents, half of them per micro-batch: a file is read by one task
    halves = max(4, -(-schema.count() // (2 * DEALT_ROWS)))
    schema.repartition(2 * halves, "doc_id").write.parquet(f"{folder}/pages")
    pages = jobs.file_stream(t.spark, f"{folder}/pages", schema.schema, files_per_batch=halves)
    jobs.ingest_stream(pages, folder, f"{folder}/progress").awaitTermination()
    docs, fields = (t.spark.read.parquet(f"{folder}/{name}") for name in ("documents", "fields"))
    counts = fields.groupBy("doc_type").agg(F.count("*").alias("fields"), F.countDistinct("doc_id").alias("with_fields"))
    return docs.groupBy("doc_type").agg(F.count("*").alias("documents")).join(counts, "doc_type", "left")


@register("ingest_once", with_views("form_docs") + o.INGESTED)
def _(t):
    folder = shared_folder(t.spark)
    start = F.lit("2024-01-01").cast("timestamp")
    at = F.timestamp_seconds(F.unix_timestamp(start) + F.pmod("doc_id", F.lit(3000)))
    rows = t.form_docs.select("doc_id", "full_text", at.alias("delivered_at"))
    again = rows.where("doc_id % 3 = 0").withColumn("delivered_at", F.col("delivered_at") + F.expr("INTERVAL 10 MINUTES"))
    # all documents, two of some within one delivery, and a third of them in later files
    for part in (rows.union(rows.where("doc_id % 7 = 0")), again):
        part.repartition(4, "doc_id").write.mode("append").parquet(f"{folder}/pages")
    pages = jobs.file_stream(t.spark, f"{folder}/pages", rows.schema, files_per_batch=4)
    jobs.ingest_stream(jobs.once(pages), folder, f"{folder}/progress").awaitTermination()
    docs, fields = (t.spark.read.parquet(f"{folder}/{name}") for name in ("documents", "fields"))
    counts = fields.groupBy("doc_type").agg(F.count("*").alias("fields"), F.countDistinct("doc_id").alias("with_fields"))
    return docs.groupBy("doc_type").agg(F.count("*").alias("documents")).join(counts, "doc_type", "left")


@register("job_status_stream", o.JOB_STATUS)
def _(t):
    events = streamed(t, "events").selectExpr("CAST(user_id AS STRING) AS job_id", "ts", f"{o._JOB_STATUS} AS status")
    updates = drained(t, jobs.job_status_stream(events), "update")
    latest = updates.groupBy("job_id").agg(F.max_by(F.struct("status", "events"), F.struct("updated_at", "batch")).alias("_l"))
    return latest.select("job_id", "_l.status", "_l.events")


@register("audit_stream", with_views("audit") + o.AUDIT_STREAM)
def _(t):
    rows = streamed(t, "events").selectExpr(
        "event_id AS job_id", "ts",
        "CASE event_type WHEN 'purchase' THEN 'pan' WHEN 'click' THEN 'aadhaar' WHEN 'view' THEN 'bank_statement' ELSE 'unknown' END AS doc_type",
        "CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'low_confidence' ELSE 'success' END AS status", "value AS duration_ms",
    )
    # every update of a window is written; its last one holds all of its rows
    updates = drained(t, jobs.audit_stream(rows), "update")
    last = updates.groupBy("window_start", "doc_type", "status").agg(
        F.max_by(F.struct("rows", "mean_duration_ms"), "batch").alias("_l")
    )
    start = F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start")
    return last.select(start, "doc_type", "status", "_l.rows", "_l.mean_duration_ms")
