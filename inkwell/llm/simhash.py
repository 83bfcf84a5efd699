"""SimHash near-duplicates: byte-position inverted index, count filtering, verification.

Two 64-bit fingerprints that differ in at most 4 bits differ in at most 4 of their 8 bytes, so they
share at least 4 positional bytes: that is the guaranteed minimum of the count filter.  A posting list
per single byte would hold 1/256 of all rows and its pairs would grow with the square of the input, so
the index keys its lists by three positional bytes at a time.  The 20 triples of ``TRIPLES`` are a
covering: any four positions out of eight contain one of them whole, so every pair that shares four
bytes meets in a list.  Within a list, the shared positional bytes of every pair are tallied, pairs
below the minimum go, and the rest are verified bit by bit.

No list is ever collected whole: lists are cut into blocks of about ``BLOCK`` fingerprints and compared
block against block, and a block pair gives back a spanning forest of its links instead of the links.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import free_name, written
from inkwell.llm.components import components

#: Fingerprints that are compared at once in one list.
BLOCK = 1024


def _triples() -> list[tuple[int, int, int]]:
    """Three groups of positions; the triples inside a group, and two of a group with one of the next.

    Four positions put two or more into some group; this choice (Turan's) leaves no four without a triple.
    """
    groups = [(0, 1, 2), (3, 4, 5), (6, 7)]
    found = [t for g in groups for t in combinations(g, 3)]
    for g, nxt in zip(groups, groups[1:] + groups[:1], strict=True):
        found += [tuple(sorted((*two, one))) for two in combinations(g, 2) for one in nxt]
    return sorted(found)


TRIPLES = _triples()


def fingerprint(text: bytes | None, width: int = 4) -> int:
    """64-bit majority of the XXH64 (seed 42) of a text's word shingles; no words: 0."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(width, len(words))
    hash_of = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1:].tolist(), strict=True)
    return majority(np.array([hash_of(joined[i:j], 42) for i, j in spans], np.uint64))


def majority(hashes: np.ndarray) -> int:
    """Bits set in more than half of the hashes (one or more), counted in eight byte lanes at a time."""
    heads = np.arange(0, len(hashes), 255)
    counts = np.empty((8, 8), np.int64)  # [lane, shift]: how often bit 8 * lane + shift is set
    for shift in range(8):
        lanes = (hashes >> np.uint64(shift)) & np.uint64(0x0101010101010101)
        sums = np.add.reduceat(lanes, heads)
        counts[:, shift] = sums.astype("<u8").view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    bits = (counts.reshape(-1) * 2 > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """``doc_id`` and ``fp`` (the fingerprint's 64 bits as a long) of every row, nothing dropped."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            fps = np.array([fingerprint(t, width) for t in part["text"]], np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "fp": fps})

    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    return plain.mapInPandas(rows, "doc_id long, fp long")


def _forest(left: np.ndarray, right: np.ndarray, bits: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links between two blocks (or within one), as (node, root) pairs."""
    nodes, where = np.unique(np.concatenate((left, right)), return_inverse=True)
    rows, cols = where[: len(left)], where[len(left):]
    root = np.arange(len(nodes))
    linked = np.zeros((len(left), len(right)), bool)
    for i in range(0, len(left), 256):
        differing = left[i:i + 256, None] ^ right[None, :]
        shared = np.zeros(differing.shape, np.uint8)
        for position in range(8):
            shared += (differing >> np.uint64(8 * position)) & np.uint64(0xFF) == 0
        counted = shared >= least
        linked[i:i + 256] = counted & (np.bitwise_count(differing) <= bits)
    while True:
        before = root.copy()
        big = len(nodes)
        np.minimum.at(root, rows, np.where(linked, root[cols][None, :], big).min(axis=1, initial=big))
        np.minimum.at(root, cols, np.where(linked, root[rows][:, None], big).min(axis=0, initial=big))
        root = root[root]
        if (root == before).all():
            break
    hung = root != np.arange(len(nodes))
    return nodes[hung], nodes[root[hung]]


def links(fps: DataFrame, bits: int = 4) -> DataFrame:
    """Links ``a``, ``b`` that connect all fingerprints of ``fps`` (column ``fp``, distinct) within ``bits`` bits.

    Two fingerprints are connected by the links if and only if a chain of fingerprints leads from one
    to the other with at most ``bits`` differing bits a step; not every such step is listed.
    """
    if bits > 4:
        raise ValueError("the index guarantees four shared bytes only up to 4 differing bits")
    byte = [F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(0xFF)) for p in range(8)]

    def key(k: int, triple: tuple[int, int, int]):
        x, y, z = triple
        return (F.lit(k) * (1 << 24) + byte[x] * (1 << 16) + byte[y] * (1 << 8) + byte[z]).cast("long")

    postings = fps.select("fp", F.explode(F.array(*(key(k, t) for k, t in enumerate(TRIPLES)))).alias("list"))
    sizes = postings.groupBy("list").agg(F.count("*").alias("n")).where("n > 1")
    sizes = written(sizes.select("list", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "lists")
    blocks = (
        postings.join(sizes, "list")
        .groupBy("list", "blocks", F.expr("pmod(xxhash64(fp), blocks)").alias("block"))
        .agg(F.collect_list("fp").alias("fps"))
    )
    blocks = written(blocks, "blocks")
    own = blocks.select(F.col("fps").alias("left"), F.array().cast("array<long>").alias("right"))
    many = blocks.where("blocks > 1")
    cross = (
        many.select("list", F.col("block").alias("i"), F.col("fps").alias("left"))
        .join(many.select("list", F.col("block").alias("j"), F.col("fps").alias("right")), "list")
        .where("i < j")
        .select("left", "right")
    )

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for left, right in zip(part["left"], part["right"], strict=True):
                one = np.asarray(left, np.int64).view(np.uint64)
                two = np.asarray(right, np.int64).view(np.uint64) if len(right) else one
                a, b = _forest(one, two, bits, 8 - bits)
                yield pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return own.union(cross).mapInPandas(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, bits: int = 4, width: int = 4) -> DataFrame:
    """Class of every document: ``doc_id``, ``fp`` (long), ``component_id``.

    Words are split at ASCII white space after lower-casing A-Z; shingles of ``width`` words, repeats
    included.  ``component_id`` is the smallest doc_id that is reachable over links of at most ``bits``
    differing bits, itself included.

    Defined cases: null and empty texts and texts of white space have fingerprint 0 and link like any
    other; texts of fewer than ``width`` words have one shingle; repeated rows stay repeated; rows with a
    null doc_id take part and never give the id of a class that has another one (all null: null); an empty
    table gives an empty table; other columns are not read.
    """
    rows = written(fingerprints(docs, width), "fingerprints")
    distinct = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    roots = written(components(links(distinct.select("fp"), bits)), "roots")
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root")
    )
    named = rooted.join(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "root")
    classes = written(named.select("fp", "component_id"), "classes")
    return rows.join(classes, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, bits: int = 4, width: int = 4) -> DataFrame:
    """The documents, one of each class of near-duplicates: the one with the smallest doc_id.

    All columns are kept as they are.  Of repeated rows with that doc_id one stays; classes whose ids
    are all null keep one of their rows.
    """
    kept = near_duplicates(docs, bits, width)
    first = kept.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fp")).alias("own")).count()

    def signed(text: bytes | None) -> int:
        return int(np.uint64(fingerprint(text, width)).view(np.int64))

    return first_rows(docs, first.select("component_id", "own"), signed)


def first_rows(docs: DataFrame, first: DataFrame, key_of: Callable[[bytes | None], int]) -> DataFrame:
    """The rows whose doc_id is a ``component_id`` of ``first``, and one row without id for each ``own`` that is a text's key."""
    columns = docs.columns
    key = free_name(docs, "inkwell_key")
    no_id = docs.where(F.col("doc_id").isNull())
    with_id = docs.where(F.col("doc_id").isNotNull())
    ids = first.where(F.col("component_id").isNotNull()).select(F.col("component_id").alias(key))
    kept = with_id.withColumn(key, F.col("doc_id").cast("long")).join(ids, key, "left_semi")
    one = kept.groupBy(key).agg(*(F.first(c).alias(c) for c in columns)).select(*columns)
    fps = first.where(F.col("component_id").isNull()).select(F.col("own").alias(key))

    def keys_of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield pd.Series([key_of(t) for t in part], dtype="int64")

    hashed = F.pandas_udf(keys_of, "long")(F.col("text").cast("binary"))
    nameless = no_id.withColumn(key, hashed).join(fps, key, "left_semi")
    return one.union(nameless.groupBy(key).agg(*(F.first(c).alias(c) for c in columns)).select(*columns))
