"""J12 retention plan and U2 removal set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def retention_plan(index: DataFrame, files: DataFrame, now: str, days: int, purge_orphans: bool = True,
                   purge_broken: bool = True) -> tuple[DataFrame, DataFrame]:
    """Rows to act on, and the one-row summary.

    ``index``: document_id, uploaded_at and optionally created_at, file_time.
    ``files``: file_doc_id, one row per stored file.  A row expires when it is
    strictly older than the cut-off; 0 days switches expiry off.
    """
    stamps = [F.col(c).cast("timestamp") for c in ("uploaded_at", "created_at", "file_time") if c in index.columns]
    cutoff = F.lit(now).cast("timestamp") - F.expr(f"INTERVAL '{days}' DAY")
    expired = F.coalesce(F.coalesce(*stamps) < cutoff, F.lit(False)) if days > 0 else F.lit(False)
    rows = index.filter("document_id IS NOT NULL").select("document_id", expired.alias("_expired")).groupBy("document_id").agg(
        F.max("_expired").alias("_expired")
    )
    stored = files.groupBy(F.col("file_doc_id").alias("document_id")).agg(F.count("*").alias("_files"))
    both = rows.withColumn("_row", F.lit(True)).join(stored, "document_id", "full_outer")
    action = (
        F.when(F.col("_expired"), "expired")
        .when(F.col("_row") & F.col("_files").isNull() & F.lit(purge_broken), "broken_reference")
        .when(F.col("_row").isNull() & F.lit(purge_orphans), "orphan_file")
    )
    plan = both.select("document_id", action.alias("action"), F.coalesce("_files", F.lit(0)).alias("files")).filter("action IS NOT NULL")
    summary = plan.agg(
        F.count_if(F.col("action").isin("expired", "broken_reference")).alias("deleted_count"),
        F.count_if(F.col("action") == "expired").alias("expired_count"),
        F.count_if(F.col("action") == "broken_reference").alias("broken_refs_count"),
        F.coalesce(F.sum(F.when(F.col("action") == "orphan_file", F.col("files"))), F.lit(0)).alias("orphans_cleaned"),
    )
    return plan, summary


def removal_set(expired: DataFrame, broken: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct ids to remove, and the index rows that remain."""
    doomed = expired.select("document_id").union(broken.select("document_id")).distinct()
    return doomed, index.join(doomed, "document_id", "left_anti")
