"""S2 vault index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.schemas import VAULT
from inkwell.sources.json_array import SPLIT, read_json_array


def read_vault_index(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """Typed records of one index file or of all in a folder (a JSON array each), one large file in many tasks.

    A record that lacks ``document_id`` keeps its ``id``; none is dropped.
    """
    raw = read_json_array(spark, path, VAULT, split)
    return raw.withColumn("document_id", F.coalesce("document_id", "id"))
