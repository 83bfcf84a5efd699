"""Connected components of a table of links, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import discard, written


def components(links: DataFrame) -> DataFrame:
    """Smallest node reachable from each node that has a link.

    links: columns ``a`` and ``b`` (long), in any order and with repeats; self-links and
    rows with nulls are ignored.  Returns ``node`` and ``root`` (long), one row per node of a
    link, the root itself included.  An empty table gives an empty table.

    Each round hangs the larger neighbours of a node on its smallest neighbour, then the smaller
    ones, until nothing changes (O(log n) rounds in practice).  The per-node minima are pre-aggregated
    and written before they are joined, so that a hub's rows can be split over tasks (AQE skew join).
    """
    edges = written(
        links.where("a <> b")
        .select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v"))
        .distinct(),
        "links",
    )
    mark = _mark(edges)
    while mark[0]:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = written(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "least")
        large = written(
            both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large"
        )
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        hung = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = written(hung.union(least.select("u", F.col("m").alias("v"))).distinct(), "small")
        discard(edges, low, large, least)
        edges, before, mark = new, mark, _mark(new)
        if mark == before:
            break
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)


def _mark(edges: DataFrame) -> tuple:
    """Number of links and an order-free digest of them."""
    digest = F.xxhash64("u", "v")
    row = edges.agg(
        F.count("*").alias("n"), F.bit_xor(digest).alias("x"), F.sum(digest.cast("decimal(20,0)")).alias("s")
    ).first()
    return row["n"], row["x"], row["s"]
