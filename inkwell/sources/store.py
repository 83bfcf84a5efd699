"""Files of a shared store, read from tasks: listings, first bytes, byte ranges."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.session import cut_lineage


#: Whole files that a task hands to Python at once.
FILES_SENT = 16


def opened(path: str):
    """File system and inner path of a location (``/a``, ``file:/a``, ``s3://a/b``, ``hdfs://a/b``)."""
    from pyarrow.fs import FileSystem

    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[len("file:"):]
    return FileSystem.from_uri(path)


def _outer(root: str, inner_root: str, inner: str) -> str:
    return root.rstrip("/") + inner[len(inner_root.rstrip("/")):]


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """``path``, ``name`` and ``length`` of every file below a folder, empty ones too, or of the file itself.

    Folders are listed by tasks, level by level; a level's subfolders are dealt out anew.  The driver holds no names.
    Names that begin with ``.`` or ``_`` are left out, as Spark's own readers do.
    """

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow.fs import FileSelector, FileType

        for part in batches:
            for folder in part["path"]:
                system, inner = opened(folder)
                about = system.get_file_info(inner)
                if about.type == FileType.NotFound:
                    raise FileNotFoundError(folder)
                infos = [about] if about.type == FileType.File else system.get_file_info(FileSelector(inner))
                infos = [i for i in infos if not i.base_name.startswith((".", "_"))]
                for at in range(0, len(infos), 10_000):
                    some = infos[at:at + 10_000]
                    yield pd.DataFrame({
                        "path": [_outer(folder, inner, i.path) for i in some], "name": [i.base_name for i in some],
                        "folder": [i.type == FileType.Directory for i in some], "length": [int(i.size or 0) for i in some],
                    })

    level, found = spark.createDataFrame([(path,)], "path string"), []
    while True:
        there = cut_lineage(level.mapInPandas(listed, "path string, name string, folder boolean, length long"))
        found.append(there.where("NOT folder").select("path", "name", "length"))
        level = there.where("folder").select("path").repartition(spark.sparkContext.defaultParallelism, "path")
        if there.where("folder").isEmpty():
            break
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def with_heads(files: DataFrame, size: int, wanted: str = "true") -> DataFrame:
    """Add ``head``: the first ``size`` bytes of each file for which the condition ``wanted`` holds, else null.

    Files are dealt out evenly, as a listing of a flat folder comes from one task.
    """
    asked = files.withColumn("_asked", F.coalesce(F.expr(wanted), F.lit(False)))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            heads = []
            for path, ask in zip(part["path"], part["_asked"], strict=True):
                if not ask:
                    heads.append(None)
                    continue
                system, inner = opened(path)
                with system.open_input_stream(inner, buffer_size=0) as stream:
                    heads.append(stream.read(size))
            yield part.drop(columns="_asked").assign(head=pd.Series(heads, index=part.index, dtype=object))

    spread = asked.repartition(files.sparkSession.sparkContext.defaultParallelism * 4)
    columns = ", ".join(f"`{c}` {t}" for c, t in files.dtypes)
    return spread.mapInPandas(read, f"{columns}, head binary")


def write_files(rows: DataFrame, folder: str) -> None:
    """Write column ``content`` of each row to ``folder`` under its ``path``.  Names come from the rows, so a task that runs again
    writes the same files."""

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for path, content in zip(part["path"], part["content"], strict=True):
                system, inner = opened(f"{folder}/{path}")
                system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(inner) as stream:
                    stream.write(content)
            yield pd.DataFrame({"files": [len(part)]})

    spark = rows.sparkSession
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, str(FILES_SENT))
    try:
        rows.select("path", "content").mapInPandas(put, "files long").agg(F.sum("files")).collect()
    finally:
        spark.conf.set(setting, before)
