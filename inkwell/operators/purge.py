"""J12/J13 on files: delete documents by rewriting only the files that hold one of them.

A table is a set of Parquet files that the newest version lists, each with its smallest and largest id.  A deletion leaves
out files by these bounds, reads the id column of the others to find the files that hold a doomed id, writes these
anew without it, and publishes a version that lists the new files beside the untouched ones.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.session import cut_lineage


def _versions(spark: SparkSession, path: str) -> tuple:
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_versions")
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in system.listStatus(folder)] if system.exists(folder) else []
    return system, folder, sorted(int(n) for n in names if n.isdigit())


def _publish(spark: SparkSession, files: DataFrame, path: str, number: int) -> int:
    """Make a list of files the version ``number``; of two writers of one number the second fails."""
    system, folder, _ = _versions(spark, path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    staged, final = hadoop(folder, f"_{uuid.uuid4().hex}"), hadoop(folder, f"{number:012d}")
    files.write.parquet(staged.toString())  # a row for each file
    if system.exists(final) or not system.rename(staged, final):
        raise RuntimeError(f"version {number} of {path} was published by another writer")
    return number


def _write(df: DataFrame, path: str, key: str) -> DataFrame:
    """Files of a new folder: ``file``, ``rows``, ``low`` and ``high`` (ids; null ids have no bounds)."""
    run = f"{path.rstrip('/')}/data/run-{uuid.uuid4().hex}"
    df.write.parquet(run)
    there = df.sparkSession.read.schema(df.schema).parquet(run)
    return there.select(F.col("_metadata.file_path").alias("file"), key).groupBy("file").agg(
        F.count("*").alias("rows"), F.min(key).alias("low"), F.max(key).alias("high")
    )


def create(df: DataFrame, path: str, key: str = "document_id", files: int | None = None) -> int:
    """A table of files whose ids lie in ranges, so that few files hold the ids of one deletion."""
    ranged = df.repartitionByRange(files, key) if files else df.repartitionByRange(key)
    return _publish(df.sparkSession, _write(ranged, path, key), path, 1)


def file_list(spark: SparkSession, path: str) -> DataFrame:
    """The files of the newest version, with their bounds."""
    _system, folder, numbers = _versions(spark, path)
    return spark.read.parquet(f"{folder}/{numbers[-1]:012d}")


def read(spark: SparkSession, path: str, schema) -> DataFrame:
    return _read(spark, file_list(spark, path), schema)


def _read(spark: SparkSession, files: DataFrame, schema) -> DataFrame:
    names = [r.file for r in files.select("file").collect()]  # Spark's own file index holds them too
    return spark.read.schema(schema).parquet(*names) if names else spark.createDataFrame([], schema)


def purge(spark: SparkSession, path: str, doomed: DataFrame, schema, key: str = "document_id") -> dict[str, int]:
    """Delete the rows whose id is in ``doomed``; numbers of rows deleted and kept, of files rewritten and untouched."""
    _system, _folder, numbers = _versions(spark, path)
    files = file_list(spark, path)
    ids = cut_lineage(doomed.select(key).where(F.col(key).isNotNull()).distinct())
    least, most = ids.agg(F.min(key), F.max(key)).first()
    near = files.where((F.col("high") >= F.lit(least)) & (F.col("low") <= F.lit(most)))
    held = _read(spark, near, schema).select(F.col("_metadata.file_path").alias("file"), key) if not near.isEmpty() else None
    hit = cut_lineage(held.join(ids, key, "left_semi").groupBy("file").agg(F.count("*").alias("gone"))) if held is not None else None
    if hit is None or hit.isEmpty():
        total, count = files.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.count("*")).first()
        return {"deleted": 0, "kept": total, "rewritten": 0, "untouched": count}
    old = files.join(hit, "file")
    untouched = files.join(hit, "file", "left_anti")
    new = _write(_read(spark, old, schema).join(ids, key, "left_anti"), path, key)
    version = cut_lineage(untouched.unionByName(new))
    _publish(spark, version, path, numbers[-1] + 1)
    gone, rewritten = hit.agg(F.sum("gone"), F.count("*")).first()
    kept, count = version.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.count("*")).first()
    return {"deleted": gone, "kept": kept, "rewritten": rewritten, "untouched": untouched.count()}
