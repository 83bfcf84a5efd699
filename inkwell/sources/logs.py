"""S6 JSON-lines logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions.redaction import redact, redact_entry
from inkwell.schemas import LOG_LINE

_FIXED = [f.name for f in LOG_LINE.fields]


def parse_log(lines: DataFrame, col: str = "value") -> DataFrame:
    """Fixed columns plus a map of everything else."""
    everything = F.from_json(F.col(col), "map<string,string>")
    return lines.withColumn("_m", everything).filter("_m IS NOT NULL").select(
        *[F.try_element_at("_m", F.lit(n)).alias(n) for n in _FIXED],
        F.map_filter("_m", lambda k, _: ~k.isin(_FIXED)).alias("extras"),
    )


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_log(spark.read.text(path))


def redacted_log(log: DataFrame) -> DataFrame:
    return log.withColumns({
        **{n: redact(F.col(n)) for n in ("request_id", "event", "message")},
        "extras": F.transform_values("extras", redact_entry),
    })


def _line(log: DataFrame) -> Column:
    fixed = F.map_from_entries(
        F.filter(
            F.array(*[F.struct(F.lit(n).alias("k"), F.col(n).cast("string").alias("v")) for n in _FIXED]),
            lambda e: e["v"].isNotNull(),
        )
    )
    return F.to_json(F.map_concat(fixed, F.coalesce("extras", F.expr("CAST(map() AS MAP<STRING,STRING>)"))))


def log_lines(log: DataFrame) -> DataFrame:
    """One redacted JSON text per row."""
    clean = redacted_log(log)
    return clean.select(_line(clean).alias("value"))


def write_log(log: DataFrame, path: str, mode: str = "append") -> None:
    log_lines(log).write.mode(mode).text(path)
