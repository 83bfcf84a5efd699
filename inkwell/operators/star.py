"""S3 fan-out of results to child tables, S4 idempotent migration."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Baseline integrity row and storage labels.
CLEAN_SIGNAL = "All integrity checks passed"
ALGORITHM = "AES-256-GCM"


def fan_out(results: DataFrame, bucket: str = "documents") -> dict[str, DataFrame]:
    """Child tables of processed results.

    ``results`` carries document_id, user_id, filename, doc_type, mode,
    status, file_size, verification_status, risk_score, extracted_text and
    optionally signals ``ARRAY<STRUCT<signal,category,score>>``, fields
    ``MAP``, confidence, page_count, ai ``STRUCT``, content ``BINARY``.
    """

    def opt(name: str, kind: str):
        return F.col(name) if name in results.columns else F.lit(None).cast(kind)

    path = F.concat_ws(
        "/", F.lit(bucket), F.col("user_id").cast("string"), F.col("document_id").cast("string"),
        F.concat(F.col("document_id").cast("string"), F.lit(".enc")),
    )
    checksum = F.sha2(F.col("content"), 256) if "content" in results.columns else opt("checksum_sha256", "string")
    key = ["document_id", "user_id"]
    signals = opt("signals", "array<struct<signal:string,category:string,score:int>>")
    clean = F.array(
        F.struct(F.lit(CLEAN_SIGNAL).alias("signal"), F.lit("overall").alias("category"), F.lit(0).alias("score"))
    )
    out = {
        "documents": results.select(
            *key, F.col("filename").alias("original_filename"), "doc_type", "mode", "status", "file_size",
            checksum.alias("checksum_sha256"), path.alias("storage_path"), "verification_status", "risk_score",
        ),
        "document_files": results.select(
            *key, F.lit(bucket).alias("bucket_name"), path.alias("storage_path"), F.lit(ALGORITHM).alias("encryption_algorithm"), "file_size",
        ),
        "ocr_results": results.filter("extracted_text IS NOT NULL").select(
            *key, F.col("extracted_text").alias("raw_text"), F.col("doc_type").alias("detected_type"),
            F.coalesce(opt("confidence", "double"), F.lit(0.0)).cast("decimal(5,2)").alias("confidence"),
            F.coalesce(opt("page_count", "int"), F.lit(1)).alias("page_count"),
        ),
        "authenticity_checks": results.select(*key, "risk_score", "verification_status"),
        "document_integrity_checks": results.select(
            *key, F.explode(F.when(F.size(signals) > 0, signals).otherwise(clean)).alias("_s")
        ).select(*key, "_s.signal", F.coalesce("_s.category", F.lit("integrity")).alias("category"), F.coalesce("_s.score", F.lit(10)).alias("score")),
    }
    if "fields" in results.columns:
        out["extracted_fields"] = results.filter("size(fields) > 0").select(
            *key, "fields", F.coalesce("verification_status", "status").alias("verification_status")
        )
    if "ai" in results.columns:
        out["ai_analyses"] = results.filter("ai IS NOT NULL").select(
            *key, F.coalesce("ai.provider", F.lit("unknown")).alias("provider"), F.coalesce("ai.model", F.lit("unknown")).alias("model"),
            F.coalesce("ai.summary", F.lit("")).alias("summary"), F.coalesce("ai.classification", F.col("doc_type")).alias("classification"),
        )
    return out


def write_star(tables: dict[str, DataFrame], path: str, mode: str = "append") -> None:
    """Write the child tables; the document table is partitioned by type."""
    for name, df in tables.items():
        writer = df.write.mode(mode)
        if name == "documents":
            writer = writer.partitionBy("doc_type")
        writer.parquet(f"{path.rstrip('/')}/{name}")


def _manifests(spark: SparkSession, path: str) -> tuple:
    """File system, folder and numbers of the manifests of a published star."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_manifests")
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in system.listStatus(folder)] if system.exists(folder) else []
    return system, folder, sorted(int(n[:-5]) for n in names if re.fullmatch(r"[0-9]+[.]json", n))


def manifest(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """Folders of each table of the version that readers see now; empty before the first one."""
    _system, folder, numbers = _manifests(spark, path)
    if not numbers:
        return {}
    lines = spark.read.text(f"{folder}/{numbers[-1]:012d}.json").collect()
    return json.loads("".join(r.value for r in lines))


def publish_star(spark: SparkSession, tables: dict[str, DataFrame], path: str, mode: str = "append") -> int:
    """Write the child tables so that all of them become visible together; the number of the new version.

    Tables go to folders of their own, which no reader knows of; then one file, written under another name and renamed,
    says which folders make up the star.  A run that fails before the renaming leaves the old version as it is, and of two
    writers that start from one version the second fails.  ``read_star`` reads what the newest file says.
    """
    system, folder, numbers = _manifests(spark, path)
    number, run = (numbers[-1] + 1 if numbers else 1), uuid.uuid4().hex
    known = manifest(spark, path) if mode == "append" else {}
    for name, df in tables.items():
        new = f"{name}/run-{run}"
        writer = df.write.partitionBy("doc_type") if name == "documents" else df.write
        writer.parquet(f"{path.rstrip('/')}/{new}")
        known[name] = [*known.get(name, []), new]
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    staged, final = hadoop(folder, f"_{run}"), hadoop(folder, f"{number:012d}.json")
    out = system.create(staged, False)
    out.write(bytearray(json.dumps(known).encode()))
    out.close()
    if system.exists(final) or not system.rename(staged, final):
        raise RuntimeError(f"version {number} of {path} was published by another writer")
    return number


def read_star(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One table of the newest published version."""
    base = path.rstrip("/")
    parts = [spark.read.option("basePath", f"{base}/{f}").parquet(f"{base}/{f}") for f in manifest(spark, path)[name]]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def migrate(legacy: DataFrame, target: DataFrame, default_owner) -> tuple[DataFrame, DataFrame]:
    """Rows to append and the (total, migrated, skipped) summary.

    The owner is mandatory; records without an id are counted, not migrated.
    """
    if default_owner is None or not str(default_owner).strip():
        raise ValueError("a default owner is required; ownership is never invented")
    kind = dict(target.dtypes).get("user_id", "string")
    known = legacy.filter("document_id IS NOT NULL")
    fresh = known.join(target.select("document_id").distinct(), "document_id", "left_anti")
    rows = fresh.withColumn("user_id", F.lit(default_owner).cast(kind))
    rows = rows.withColumns({
        "doc_type": F.coalesce("doc_type", F.lit("unknown")), "mode": F.coalesce("mode", F.lit("offline")),
        "status": F.coalesce("status", F.lit("processed")),
    })
    seen = legacy.join(target.select("document_id").distinct().withColumn("_seen", F.lit(True)), "document_id", "left")
    summary = seen.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("document_id").isNotNull() & F.col("_seen").isNull()).alias("migrated"),
        F.count_if(F.coalesce("_seen", F.lit(False))).alias("skipped"),
    )
    return rows, summary
