"""Large JSON arrays in many tasks: one file is cut into byte ranges, and each range finds its own elements.

Where a range starts inside the JSON is not known to it: a brace may be part of a string.  So every range first counts its
quotation marks and, for either case, how the depth of brackets changes; running sums over a file's ranges then tell
where each one starts, and with that each range hands out the elements that begin in it, reading on for the last one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.sources.store import list_files, opened

#: Bytes of a range.
SPLIT = 8 << 20
#: Bytes that are read at once beyond a range's end.
AHEAD = 1 << 16

_QUOTE, _SLASH, _COMMA = ord('"'), ord("\\"), ord(",")
_DEPTH = np.zeros(256, np.int8)
_DEPTH[[ord("{"), ord("[")]] = 1
_DEPTH[[ord("}"), ord("]")]] = -1


def _reader(path: str) -> Callable[[int, int], bytes]:
    system, inner = opened(path)
    file = system.open_input_file(inner)

    def read(start: int, size: int) -> bytes:
        return file.read_at(size, start)

    return read


def _escaped_start(read: Callable[[int, int], bytes], start: int) -> bool:
    """Whether the byte at ``start`` stands behind an odd number of backslashes."""
    run = 0
    while start > run:
        size = min(AHEAD, start - run)
        before = read(start - run - size, size)
        here = len(before) - len(before.rstrip(b"\\"))
        run += here
        if here < size:
            break
    return run % 2 == 1


def quotes(raw: np.ndarray, escaped: bool) -> np.ndarray:
    """Positions of the quotation marks that open or close a string; ``escaped``: the first byte is behind a backslash."""
    marks = np.flatnonzero(raw == _QUOTE)
    if not len(marks):
        return marks
    plain = np.flatnonzero(raw != _SLASH)  # a mark's backslashes are what lies between it and the last other byte
    at = np.searchsorted(plain, marks)
    last = np.where(at > 0, plain[np.maximum(at - 1, 0)], -1)
    run = marks - last - 1 + np.where((last < 0) & escaped, 1, 0)
    return marks[run % 2 == 0]


def structure(raw: np.ndarray, escaped: bool, inside: bool) -> tuple[np.ndarray, np.ndarray]:
    """For every byte its change of depth (0 within strings), and whether it is within a string."""
    flips = np.zeros(len(raw), np.int8)
    flips[quotes(raw, escaped)] = 1
    within = (np.cumsum(flips) + inside) % 2 == 1
    return np.where(within, 0, _DEPTH[raw]), within


def elements(read: Callable[[int, int], bytes], start: int, size: int, inside: bool, depth: int, array: bool) -> Iterator[bytes]:
    """The array's elements that begin in a range: after the opening bracket, or after a comma between elements.

    array: whether the file holds an array; if not, the whole value is its one element, of the range where it begins.
    """
    text = read(start, size)
    raw = np.frombuffer(text, np.uint8)
    change, within = structure(raw, _escaped_start(read, start), inside)
    after = depth + np.cumsum(change, dtype=np.int64)
    if array:
        begins = np.flatnonzero(((after == 1) & (change == 1)) | ((after == 1) & (raw == _COMMA) & ~within)) + 1
        ends = np.flatnonzero(((after == 1) & (raw == _COMMA) & ~within) | ((after == 0) & (change == -1)))
    else:
        begins = np.flatnonzero((after == 1) & (change == 1) & (depth == 0))[:1]
        ends = np.flatnonzero((after == 0) & (change == -1)) + 1
    at = np.searchsorted(ends, begins)
    for begin, i in zip(begins.tolist(), at.tolist(), strict=True):
        if i < len(ends):
            yield text[begin:ends[i]]
    if len(begins) and at[-1] == len(ends):  # the last one goes on behind the range
        parts, at_byte = [text[begins[-1]:]], start + len(text)
        inside, depth = bool(within[-1]), int(after[-1])
        while more := read(at_byte, AHEAD):
            raw = np.frombuffer(more, np.uint8)
            change, within = structure(raw, _escaped_start(read, at_byte), inside)
            after = depth + np.cumsum(change, dtype=np.int64)
            over = (after == 0) & (change == -1)
            if array:
                over |= (after == 1) & (raw == _COMMA) & ~within
            stop = np.flatnonzero(over)
            if len(stop):
                parts.append(more[:stop[0] + (0 if array else 1)])
                break
            parts.append(more)
            inside, depth, at_byte = bool(within[-1]), int(after[-1]), at_byte + len(more)
        yield b"".join(parts)


def _ranges(files: DataFrame, split: int) -> DataFrame:
    starts = F.explode(F.sequence(F.lit(0), F.col("length") - 1, F.lit(split))).alias("start")
    cut = files.where("length > 0").select("path", starts)
    return cut.repartition(files.sparkSession.sparkContext.defaultParallelism * 4, "path", "start")


def array_elements(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """``path``, ``start`` (of the range) and ``element`` (JSON text) of all elements of all files at ``path``.

    A file that holds one object instead of an array gives that object.  Empty arrays and empty files give no rows.
    """
    ranges = _ranges(list_files(spark, path), split)

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            out = []
            for path, start in zip(part["path"], part["start"], strict=True):
                read = _reader(path)
                text = read(start, split)
                raw, escaped = np.frombuffer(text, np.uint8), _escaped_start(read, start)
                marks = len(quotes(raw, escaped))
                depths = [int(structure(raw, escaped, inside)[0].sum(dtype=np.int64)) for inside in (False, True)]
                head = text.lstrip(b"\xef\xbb\xbf \t\r\n")[:1] if start == 0 else b""
                out.append((path, start, marks, *depths, head == b"["))
            yield pd.DataFrame(out, columns=["path", "start", "marks", "outside", "within", "array"])

    # a row for each range, not for each byte or element
    about = ranges.mapInPandas(summed, "path string, start long, marks long, outside long, within long, array boolean")
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("marks").over(before), F.lit(0)) % 2 == 1
    about = about.withColumns({"inside": inside, "array": F.first("array").over(Window.partitionBy("path").orderBy("start"))})
    change = F.when(F.col("inside"), F.col("within")).otherwise(F.col("outside"))
    about = about.withColumn("change", change).withColumn("depth", F.coalesce(F.sum("change").over(before), F.lit(0)))

    def handed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["path", "start", "element"]
        for part in batches:
            for row in part.itertuples(index=False):
                some, size = [], 0
                for element in elements(_reader(row.path), row.start, split, row.inside, row.depth, row.array):
                    if element.strip():
                        some.append(element.decode("utf-8", "replace"))
                        size += len(element)
                    if size >= AHEAD:
                        yield pd.DataFrame([(row.path, row.start, e) for e in some], columns=columns, dtype=object)
                        some, size = [], 0
                if some:
                    yield pd.DataFrame([(row.path, row.start, e) for e in some], columns=columns, dtype=object)

    dealt = about.repartition(spark.sparkContext.defaultParallelism * 4, "path", "start")
    return dealt.mapInPandas(handed, "path string, start long, element string")


def read_json_array(spark: SparkSession, path: str, schema: T.StructType, split: int = SPLIT) -> DataFrame:
    """Typed records of JSON arrays; an element that does not fit the schema gives a row of nulls, as Spark's reader does."""
    parsed = array_elements(spark, path, split).select(F.from_json("element", schema).alias("record"))
    return parsed.select(*(F.col("record").getField(f.name).alias(f.name) for f in schema.fields))
