"""Structured Streaming jobs: ST2-ST5 (ST1 is in ``limiter``)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions.redaction import redact
from inkwell.operators.classify import with_classification
from inkwell.operators.extract import long_fields, minimise_pii, with_fields
from inkwell.sources.logs import log_lines, parse_log

# States of a job, from first to last.
JOB_STATES = ["pending", "processing", "completed", "low_confidence", "error", "failed"]


def redact_stream(log: DataFrame, col: str = "value") -> DataFrame:
    """ST2: JSON log lines redacted by key and text; other lines by text."""
    is_json = F.from_json(F.col(col), "map<string,string>").isNotNull()
    structured = log_lines(parse_log(log.filter(is_json), col))
    plain = log.filter(~F.coalesce(is_json, F.lit(False))).select(redact(F.col(col)).alias("value"))
    return structured.unionByName(plain)


def _ingested(pages: DataFrame, min_margin: int = 0) -> DataFrame:
    """Documents with their type and, in the same row, their fields: each text is matched once."""
    classified = with_classification(pages.select("doc_id", "full_text"), min_margin)
    return with_fields(classified).drop("full_text")


def _as_tables(wide: DataFrame) -> tuple[DataFrame, DataFrame]:
    return wide.drop("fields"), minimise_pii(long_fields(wide))


def ingest_batch(pages: DataFrame, min_margin: int = 0) -> tuple[DataFrame, DataFrame]:
    """Classify, extract and minimise one set of documents."""
    return _as_tables(_ingested(pages, min_margin))


def once(pages: DataFrame, key: str = "doc_id", time: str = "delivered_at", within: str = "1 hour") -> DataFrame:
    """Documents without repeated deliveries: of those with one ``key`` whose times lie ``within`` of each other the first one met.

    The keys seen are kept in the state store until the watermark has passed them, so the state is bounded by the documents
    of that time; a delivery after that counts anew.  Deliveries later than the watermark are left out as repeats are; rows
    without a time or key go on.
    """
    timed = pages.withColumn(time, F.col(time).cast("timestamp"))
    whole = F.col(time).isNotNull() & F.col(key).isNotNull()
    kept = timed.where(whole).withWatermark(time, within).dropDuplicatesWithinWatermark([key])
    return kept.unionByName(timed.where(~whole))


def ingest_stream(pages: DataFrame, out: str, checkpoint: str, available_now: bool = True):
    """ST3: classify -> extract -> minimise -> append, once per micro-batch.

    A batch is written under its own number, so a batch replayed after a lost
    executor or driver overwrites itself instead of adding rows twice.  Put
    ``once`` before it where documents are delivered more than once.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        wide = _ingested(batch).persist(StorageLevel.MEMORY_AND_DISK)  # both tables come from it
        docs, fields = _as_tables(wide)
        docs.write.mode("overwrite").parquet(f"{out}/documents/batch={batch_id}")
        fields.write.mode("overwrite").parquet(f"{out}/fields/batch={batch_id}")
        wide.unpersist()

    writer = pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def job_status_stream(events: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """ST4: latest status per job (update mode)."""
    order = F.array_position(F.array(*[F.lit(s) for s in JOB_STATES]), F.col("status"))
    return (
        events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
        .groupBy("job_id")
        .agg(F.max_by("status", F.struct("ts", order)).alias("status"), F.max("ts").alias("updated_at"), F.count("*").alias("events"))
    )


def audit_stream(audit: DataFrame, minutes: str = "1 minute", watermark: str = "10 minutes") -> DataFrame:
    """ST5: tumbling counts and mean duration per type and status."""
    out = (
        audit.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
        .groupBy(F.window("ts", minutes).alias("w"), "doc_type", "status")
        .agg(F.count("*").alias("rows"), F.avg("duration_ms").alias("mean_duration_ms"))
    )
    return out.select(F.col("w.start").alias("window_start"), "doc_type", "status", "rows", F.round("mean_duration_ms", 4).alias("mean_duration_ms"))


def file_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.format(fmt).load(path)


def drain(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Run a stream over what is there now, then stop."""
    query = (
        stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
