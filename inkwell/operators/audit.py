"""P7 audit projection and A15 roll-up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Extra keys that may be logged.
SAFE_KEYS = ["pages_count", "source", "qr_detected", "micr_detected", "quality_issues"]


def audit_rows(events: DataFrame, extras: str = "extra_meta") -> DataFrame:
    """Fixed columns plus the safe extra keys, numbers rounded."""

    def opt(name: str, kind: str = "string"):
        return F.col(name) if name in events.columns else F.lit(None).cast(kind)

    safe = (
        F.map_filter(F.col(extras), lambda k, _: k.isin(SAFE_KEYS)) if extras in events.columns
        else F.expr("CAST(map() AS MAP<STRING,STRING>)")
    )
    return events.select(
        F.lit("ocr_audit").alias("event"), "doc_type", "status",
        F.round(opt("confidence", "double"), 4).alias("confidence"),
        opt("job_id").cast("string").alias("job_id"), opt("customer_id").cast("string").alias("customer_id"),
        opt("reason").alias("reason"), F.round(opt("duration_ms", "double"), 2).alias("duration_ms"),
        safe.alias("extra_meta"),
    )


def audit_rollup(audit: DataFrame) -> DataFrame:
    """Rows, mean duration and mean confidence per type, status, reason."""
    reason = F.col("reason") if "reason" in audit.columns else F.lit(None).cast("string")
    conf = F.col("confidence") if "confidence" in audit.columns else F.lit(None).cast("double")

    def mean(col):
        dec = col.cast("decimal(18,4)")
        return F.round(F.sum(dec) / F.count(dec), 4).cast("double")

    return audit.groupBy("doc_type", "status", reason.alias("reason")).agg(
        F.count("*").alias("rows"), mean(F.col("duration_ms")).alias("mean_duration_ms"), mean(conf).alias("mean_confidence")
    )
