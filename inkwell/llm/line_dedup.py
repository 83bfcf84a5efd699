"""Line dedup: lines that many documents share stay in the first of them only.

Texts are cut at ``\\n``.  A line's key is the line without white space (``[\\x20\\x09-\\x0D]``) at both ends and with
A-Z lower-cased.  Keys are exploded as 128-bit hashes, one row for each key of a document, the distinct documents of
each hash are counted, and hashes that reach the threshold come back to the lines as positions to drop.  Only hashes,
ids and positions are shuffled for that; each text moves once, to meet its own positions, and is put together again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import written

#: White space that is stripped from a line's ends.
SPACE = b" \t\n\x0b\x0c\r"
#: Code points of the shortest key that counts, and documents from which on a key is repeated.
LEAST_CHARS, LEAST_DOCS = 10, 2
#: Keys of a task that are sent to the JVM at once.
SENT = 20_000


def line_keys(text: bytes | None) -> list[bytes]:
    """Key of every line; null is one empty line."""
    return [line.strip(SPACE) for line in (text or b"").lower().split(b"\n")]


def _code_points(key: bytes) -> int:
    return len(key) if key.isascii() else len(key.decode("utf-8", "replace"))


def places(text: bytes | None, least_chars: int = LEAST_CHARS) -> dict[bytes, list[int]]:
    """Positions of each key of ``least_chars`` code points or more."""
    found: dict[bytes, list[int]] = {}
    for at, key in enumerate(line_keys(text)):
        if len(key) >= least_chars and (len(key) >= 4 * least_chars or _code_points(key) >= least_chars):
            found.setdefault(key, []).append(at)
    return found


def without(text: bytes | None, dropped: np.ndarray | None) -> tuple[int, int, bytes]:
    """Number of lines, of dropped lines, and the text of the others."""
    lines = (text or b"").split(b"\n")
    if dropped is None or not len(dropped):
        return len(lines), 0, text or b""
    stays = np.ones(len(lines), bool)
    stays[np.asarray(dropped, np.int64)] = False
    kept = [lines[i] for i in np.flatnonzero(stays).tolist()]
    return len(lines), len(lines) - len(kept), b"\n".join(kept)


def _marked(docs: DataFrame) -> DataFrame:
    """``id``, ``text`` (binary) and the text's hashes ``t1``, ``t2``: rows alike in id and text are one row's repeats."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    plain = docs.select(F.col("doc_id").cast("long").alias("id"), text.alias("text"))
    return plain.select("id", "text", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit("again"), "text").alias("t2"))


def _lines(marked: DataFrame, least_chars: int) -> DataFrame:
    """One row for each key of a row: ``h1``, ``h2``, ``id``, ``t1``, ``t2``, ``at`` (its positions)."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["h", "id", "t1", "t2", "at"]
        out: list[tuple] = []

        def made() -> pd.DataFrame:
            frame = pd.DataFrame(out, columns=columns)
            halves = np.frombuffer(b"".join(frame.pop("h")), "<i8").reshape(-1, 2)
            frame.insert(0, "h1", halves[:, 0])
            frame.insert(1, "h2", halves[:, 1])
            frame["id"] = frame["id"].astype("Int64")
            return frame

        digest = xxhash.xxh3_128_digest
        for part in batches:
            for row_id, text, t1, t2 in zip(part["id"].astype(object), part["text"], part["t1"], part["t2"], strict=True):
                row_id = None if pd.isna(row_id) else int(row_id)
                for key, at in places(text, least_chars).items():
                    out.append((digest(key), row_id, t1, t2, at))
                    if len(out) >= SENT:
                        yield made()
                        out.clear()
        if out:
            yield made()

    return marked.mapInPandas(rows, "h1 long, h2 long, id long, t1 long, t2 long, at array<int>")


def repeated_lines(lines: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """``h1``, ``h2``, ``n_docs`` and ``first`` (the first document) of the keys found in ``least_docs`` documents or more.

    Rows with one doc_id are one document; rows without id are one document for each text and come after all others.
    """
    nameless = F.col("id").isNull()
    document = F.struct(
        nameless.alias("nameless"), F.coalesce("id", F.lit(0)).alias("id"),
        F.when(nameless, F.col("t1")).otherwise(0).alias("t1"), F.when(nameless, F.col("t2")).otherwise(0).alias("t2"),
    )
    held = lines.select("h1", "h2", document.alias("doc")).distinct()
    counted = held.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.min("doc").alias("first"))
    return counted.where(F.col("n_docs") >= least_docs)


def dropped_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """Positions ``dropped`` of the lines that go, by ``id``, ``t1``, ``t2`` of the rows that lose some."""
    lines = written(_lines(_marked(docs), least_chars), "lines")
    repeated = written(repeated_lines(lines, least_docs).select("h1", "h2", "first"), "repeated")
    first = F.col("first")
    stays = F.when(F.col("id").isNull(), first["nameless"] & (first["t1"] == F.col("t1")) & (first["t2"] == F.col("t2")))
    stays = stays.otherwise(~first["nameless"] & (first["id"] == F.col("id")))
    gone = lines.join(repeated, ["h1", "h2"]).where(~stays)
    # repeats of a row bring the same positions again: one set of them is enough
    by_row = gone.groupBy("id", "t1", "t2").agg(F.array_distinct(F.flatten(F.collect_list("at"))).alias("dropped"))
    return by_row


def without_repeated_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """``doc_id``, ``n_lines``, ``n_dropped`` and ``kept`` (the text that stays) of every row.

    A key of ``least_chars`` code points or more that ``least_docs`` documents or more hold loses all its lines, but
    for those in the document with the smallest doc_id that holds it (all its lines there stay).  Documents are told
    apart by doc_id.

    Defined cases: null and empty texts are one empty line and stay empty; lines of white space have an empty key and
    stay; repeated rows are one document and each lose the same lines; rows without doc_id are one document for each
    distinct text and come after all ids; a text all of whose lines go is empty; an empty table gives an empty table;
    other columns are not read.
    """
    marked = _marked(docs)
    null = F.col("id").isNull()
    keyed = marked.withColumns({"nameless": null, "id": F.coalesce("id", F.lit(0))})
    gone = dropped_lines(docs, least_chars, least_docs)
    gone = gone.withColumns({"nameless": null, "id": F.coalesce("id", F.lit(0))})
    met = keyed.join(gone, ["nameless", "id", "t1", "t2"], "left")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            out = [without(t, d) for t, d in zip(part["text"], part["dropped"], strict=True)]
            frame = pd.DataFrame(out, columns=["n_lines", "n_dropped", "kept"])
            frame["kept"] = [k.decode("utf-8", "replace") for k in frame["kept"]]
            frame.insert(0, "doc_id", part["doc_id"].astype("Int64").to_numpy())
            yield frame

    doc_id = F.when(~F.col("nameless"), F.col("id")).alias("doc_id")
    return met.select(doc_id, "text", "dropped").mapInPandas(rows, "doc_id long, n_lines long, n_dropped long, kept string")


def digests(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_lines``, ``n_dropped`` and the SHA-256 of the text that stays."""
    kept = without_repeated_lines(docs)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
