"""Explicit schemas; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

STRING_MAP = T.MapType(T.StringType(), T.StringType())

VAULT = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("document_id", T.StringType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("filename", T.StringType()),
    T.StructField("original_filename", T.StringType()),
    T.StructField("stored_filename", T.StringType()),
    T.StructField("file_path", T.StringType()),
    T.StructField("file_size", T.LongType()),
    T.StructField("file_type", T.StringType()),
    T.StructField("is_encrypted", T.BooleanType()),
    T.StructField("uploaded_at", T.StringType()),
    T.StructField("created_at", T.StringType()),
    T.StructField("doc_type", T.StringType()),
    T.StructField("document_type", T.StringType()),
    T.StructField("issuer", T.StringType()),
    T.StructField("mode", T.StringType()),
    T.StructField("ocr_required", T.BooleanType()),
    T.StructField("text_source", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("pages", T.IntegerType()),
    T.StructField("reason", T.StringType()),
    T.StructField("verification_status", T.StringType()),
    T.StructField("review_required", T.BooleanType()),
    T.StructField("risk_score", T.DoubleType()),
    T.StructField("suspicious_signals", T.ArrayType(T.StringType())),
    T.StructField("human_review_reason", T.StringType()),
    T.StructField("verified_by_ai", T.BooleanType()),
    T.StructField("checksum_valid", T.BooleanType()),
    T.StructField("checksum_reason", T.StringType()),
    T.StructField("extracted_fields", STRING_MAP),
    T.StructField("fields", STRING_MAP),
    T.StructField("field_confidences", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("extracted_text", T.StringType()),
    T.StructField("raw_text", T.StringType()),
    T.StructField("summary", T.StringType()),
    T.StructField("evidence", T.ArrayType(T.StringType())),
    T.StructField("ai_analysis", T.StructType([
        T.StructField("summary", T.StringType()),
        T.StructField("provider", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("classification", T.StringType()),
        T.StructField("evidence", T.ArrayType(T.StringType())),
        T.StructField("extracted_fields", STRING_MAP),
    ])),
])

LOG_LINE = T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("level", T.StringType()),
    T.StructField("logger", T.StringType()),
    T.StructField("request_id", T.StringType()),
    T.StructField("event", T.StringType()),
    T.StructField("message", T.StringType()),
])

PAGES_TEXT = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("page_num", T.IntegerType()),
    T.StructField("full_text", T.StringType()),
])

REQUESTS = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("client", T.LongType()),
    T.StructField("bucket", T.StringType()),
])

JOB_EVENTS = T.StructType([
    T.StructField("job_id", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("status", T.StringType()),
])

AUDIT = T.StructType([
    T.StructField("job_id", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("doc_type", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("duration_ms", T.DoubleType()),
])
