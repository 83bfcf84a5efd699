"""Helpers of the subpackage: cut points in the shared folder, column names, tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.column import Column

#: Words of a text are runs of anything but these six ASCII characters.
WORD = r"[^\x20\x09-\x0D]+"


def shared_base(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    Only where it is unset and the session runs on one machine (tests) the warehouse
    folder stands in; a cluster without the setting is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints"
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage is cut, lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_base(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._inkwell_path = path
    return back


def discard(*frames: DataFrame) -> None:
    """Remove tables of ``written`` that no plan reads any more."""
    for df in frames:
        path = getattr(df, "_inkwell_path", None)
        if path is not None:
            spark = df.sparkSession
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


#: Rows of an Arrow batch and of a Parquet reader's batch at most: texts may be long, and a batch of them is in memory
#: several times over.
BATCH_ROWS = 500


def bounded_batches(spark: SparkSession) -> None:
    """Have the session read texts and send them to Python in small batches; lower settings stay."""
    for setting in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize"):
        now = int(spark.conf.get(setting))
        if now <= 0 or now > BATCH_ROWS:
            spark.conf.set(setting, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, wish: str) -> str:
    """``wish``, or a longer name that no column of ``df`` has (in any case)."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


def word_count(text: Column) -> Column:
    """Number of words (see ``WORD``); null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
