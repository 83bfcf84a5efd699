"""Bloom filters of a bounded size over 64-bit keys, built by Spark and read in Python tasks.

A filter has ``BITS`` bits for each key, but never more than ``MOST_BITS`` (16 MB): beyond that it fills up and lets more
keys through, never fewer, so whoever uses it needs an exact test behind it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS, FEWEST_BITS, MOST_BITS, PAGE = 16, 1 << 16, 1 << 27, 1 << 15


def build(keys: DataFrame) -> np.ndarray:
    """The filter, as bytes, of column ``key`` (long, bits well mixed), which is read twice: give a written table."""
    bits = FEWEST_BITS
    wanted = min(MOST_BITS, BITS * keys.count())
    while bits < wanted:
        bits *= 2
    places = F.explode(F.array(*(F.shiftrightunsigned("key", s).bitwiseAND(F.lit(bits - 1)) for s in (0, 32))))
    placed = keys.select(places.alias("place"))
    pages = placed.groupBy(F.shiftright("place", 15).alias("page")).agg(
        F.collect_set(F.col("place").bitwiseAND(F.lit(PAGE - 1)).cast("int")).alias("set")
    )

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            out = []
            for set_bits in part["set"]:
                page = np.zeros(PAGE, np.uint8)
                page[set_bits] = 1
                out.append(np.packbits(page, bitorder="little").tobytes())
            yield pd.DataFrame({"page": part["page"], "bits": out})

    found = np.zeros(bits // 8, np.uint8)
    for row in pages.mapInPandas(packed, "page long, bits binary").toLocalIterator():
        found[row["page"] * PAGE // 8:(row["page"] + 1) * PAGE // 8] = np.frombuffer(row["bits"], np.uint8)
    return found


def among(keys: np.ndarray, found: np.ndarray) -> np.ndarray:
    """For each key (uint64) whether it may be in the filter."""
    last = np.uint64(len(found) * 8 - 1)
    held = np.ones(len(keys), bool)
    for shift in (0, 32):
        place = ((keys >> np.uint64(shift)) & last).astype(np.int64)
        held &= (found[place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0
    return held
