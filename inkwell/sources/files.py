"""S1 upload triage and file names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.sources.store import list_files, with_heads

# Accepted extensions, size limits, leading bytes.
EXTENSIONS = [".pdf", ".png", ".jpg", ".jpeg", ".webp"]
MAX_IMAGE, MAX_PDF = 20 * 1024 * 1024, 50 * 1024 * 1024
PNG_HEX, JPEG_HEX = "89504E470D0A1A0A", "FFD8FF"
PDF_MARK, PDF_SCAN = "%PDF-", 1024


def sanitise_filename(name: Column) -> Column:
    """Base name without leading dots and odd characters."""
    base = F.substring_index(F.replace(name, F.lit("\\"), F.lit("/")), "/", -1)
    kept = F.regexp_replace(F.ltrim(base, F.lit(".")), r"[^\p{L}\p{N}._\- ]", "")
    return F.coalesce(F.nullif(kept, F.lit("")), F.lit("document.bin"))


def extension(name: Column) -> Column:
    """Lower-case extension with its dot; a leading dot is not an extension."""
    return F.lower(F.regexp_extract(sanitise_filename(name), r"[^.](\.[^.]*)$", 1))


def triage(df: DataFrame, name: str = "name", content: str = "content", length: str = "length") -> DataFrame:
    """Add ext, accepted and reject_reason, in rule order."""
    ext, body, size = extension(F.col(name)), F.col(content), F.col(length)
    head = F.hex(F.substring(body, 1, 12))
    pdf = F.contains(F.decode(F.substring(body, 1, PDF_SCAN), "ISO-8859-1"), F.lit(PDF_MARK))
    webp = head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250")
    magic = (
        F.when(ext == ".pdf", pdf).when(ext == ".png", head.startswith(PNG_HEX))
        .when(ext.isin(".jpg", ".jpeg"), head.startswith(JPEG_HEX)).when(ext == ".webp", webp)
    )
    traversal = F.contains(F.col(name), F.lit("..")) | F.contains(F.col(name), F.lit("/")) | F.contains(F.col(name), F.lit("\\"))
    reason = (
        F.when(traversal, "path_traversal")
        .when(~ext.isin(EXTENSIONS), "unsupported_type")
        .when(size == 0, "empty_file")
        .when((ext != ".pdf") & (size > MAX_IMAGE), "too_large")
        .when((ext == ".pdf") & (size > MAX_PDF), "too_large")
        .when(~magic, "bad_magic_bytes")  # not known, and no reason, without content
    )
    return df.withColumn("ext", ext).withColumn("reject_reason", reason).withColumn("accepted", F.col("reject_reason").isNull())


def triage_files(spark: SparkSession, path: str) -> DataFrame:
    """S1 over a folder, of any number of files of any size.

    Names and lengths come from listings made by tasks; only files that no rule on name or length rejects are opened,
    and of these the first bytes alone are read.
    """
    listed = list_files(spark, path).withColumn("content", F.lit(None).cast("binary"))
    open_to = triage(listed).where("reject_reason IS NULL")
    settled = triage(listed).where("reject_reason IS NOT NULL")
    read = with_heads(open_to.select("path", "name", "length"), PDF_SCAN)
    judged = triage(read, content="head").unionByName(settled, allowMissingColumns=True)
    return judged.select("path", "name", "ext", "length", "accepted", "reject_reason")
