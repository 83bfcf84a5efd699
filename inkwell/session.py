"""Session and checkpoint helpers."""

from __future__ import annotations

import re
import uuid

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(app: str = "inkwell", cores: str | int = "*", shuffle_partitions: int = 8,
                  memory: str = "12g") -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    if str(cores).isdigit():
        builder = builder.config("spark.inkwell.scanPartitions", str(cores))
    for key, value in _DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def built_once(build: Callable[[], dict]) -> Callable[[], dict]:
    """Keep the column expressions a function builds for the life of a context.

    Column expressions name columns, not tables, so they can be used on any
    DataFrame; large ones take seconds to assemble.
    """
    kept: list = []

    def get() -> dict:
        context = SparkContext._active_spark_context
        if not kept or kept[0] is not context:
            kept[:] = [context, build()]
        return kept[1]

    return get


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only where the setting is absent (tests, one machine) is a folder chosen.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        configured = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints"
    return configured


def shared_folder(spark: SparkSession) -> str:
    """A new folder for one run's written tables, inside the shared folder."""
    return f"{checkpoint_folder(spark).rstrip('/')}/run-{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of each statement run inside go when it has ended, not when the driver collects its garbage."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back: the plan restarts from columnar files that all executors see."""
    path = f"{shared_folder(df.sparkSession)}/cut"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """A scan dealt over the partitions that the caller's session asks for; by default it stays as it is.

    ``spark.inkwell.scanPartitions`` is for runs over one small file, which would be read by one core.
    """
    wanted = df.sparkSession.conf.get("spark.inkwell.scanPartitions", None)
    return df.repartition(int(wanted)) if wanted else df


#: Rows of one task of ``dealt``.
DEALT_ROWS = 10_000


def dealt(df: DataFrame, by: str = "doc_id") -> DataFrame:
    """A scan dealt over as many tasks as its rows ask for, or as the caller's session does (see ``spread``).

    For tables of few bytes and much work a row: a scan is cut by bytes, so one task would read them.  They are counted
    first, which plain scans answer from the files' footers, and dealt by a key, as the scan would be sorted otherwise.
    """
    wanted = df.sparkSession.conf.get("spark.inkwell.scanPartitions", None)
    return df.repartition(int(wanted or max(1, -(-df.count() // DEALT_ROWS))), by)
