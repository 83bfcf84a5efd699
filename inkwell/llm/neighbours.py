"""Approximate nearest neighbours: a tree of k-means, searched best bin first.

The tree is fitted on a bounded sample (``SAMPLE`` vectors, documented here), so its size does not depend on the
table; every row is indexed: it goes down to the nearest child at each node, into one of the leaves.  A search
keeps the nodes in a priority queue by the distance to their centroids and opens the nearest one first, leaf by
leaf.  How many leaves are opened is calibrated: a bounded set of rows is compared with all rows, and the visits
are widened until the share of true neighbours in opened leaves reaches the target.

Leaves are cut into tiles of about ``TILE`` vectors by hash, so a leaf may hold any share of the rows.  Queries
meet tiles by leaf, in packed blocks; what leaves a task is at most k neighbours for each query and leaf.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.llm.common import written
from inkwell.llm.vectors import doubles, longs, matrix, one_length, packed, usable

#: Vectors that the tree is fitted on, children of a node, sample vectors of a leaf, rounds of k-means.
SAMPLE, BRANCHES, LEAF, ROUNDS = 20_000, 8, 100, 12
#: Vectors of a tile, queries of a block.
TILE, BLOCK = 64, 512
#: Rows that the visits are calibrated on.
CALIBRATION = 128


@dataclass(frozen=True)
class Tree:
    """Centroids of all nodes (node 0: the root), children of each, and the leaf number of each (-1: none)."""

    centroids: np.ndarray
    children: list[list[int]]
    leaf: np.ndarray

    def assign(self, rows: np.ndarray) -> np.ndarray:
        """Leaf of each row: the nearest child at every node."""
        out = np.zeros(len(rows), np.int32)
        todo = [(0, np.arange(len(rows)))]
        while todo:
            node, own = todo.pop()
            if not self.children[node]:
                out[own] = self.leaf[node]
            elif len(own):
                kids = self.children[node]
                nearest = _distances(rows[own], self.centroids[kids]).argmin(axis=1)
                todo += [(kid, own[nearest == i]) for i, kid in enumerate(kids)]
        return out

    def visits(self, away: np.ndarray) -> Iterator[int]:
        """Leaves in the order of the search, given the query's distances to all centroids."""
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if not self.children[node]:
                yield int(self.leaf[node])
            for kid in self.children[node]:
                heapq.heappush(queue, (away[kid], kid))


def _distances(rows: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Squared distances, for ranking."""
    return (rows**2).sum(axis=1)[:, None] + (others**2).sum(axis=1)[None, :] - 2 * rows @ others.T


def grow(sample: np.ndarray, branches: int = BRANCHES, leaf: int = LEAF) -> Tree:
    """Split the sample by k-means, node by node, until the parts are small or cannot be told apart."""
    rng = np.random.default_rng(7)
    centroids, children, leaves = [sample.mean(axis=0)], [[]], [-1]
    todo, count = [(0, sample)], 0
    while todo:
        node, rows = todo.pop()
        parts = []
        if len(rows) > leaf:
            centres = rows[rng.choice(len(rows), branches, replace=False)]
            for _ in range(ROUNDS):
                nearest = _distances(rows, centres).argmin(axis=1)
                sizes = np.bincount(nearest, minlength=branches)
                sums = np.zeros_like(centres)
                np.add.at(sums, nearest, rows)
                centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres)
            nearest = _distances(rows, centres).argmin(axis=1)
            parts = [(centres[i], rows[nearest == i]) for i in range(branches) if (nearest == i).any()]
        if len(parts) < 2:
            leaves[node], count = count, count + 1
            continue
        for centre, own in parts:
            children[node].append(len(centroids))
            todo.append((len(centroids), own))
            centroids.append(centre)
            children.append([])
            leaves.append(-1)
    return Tree(np.array(centroids), children, np.array(leaves))


def _front(query: np.ndarray, ids: np.ndarray, score: np.ndarray, extra: np.ndarray, k: int):
    """The k nearest of each query, ties to the smaller id."""
    order = np.lexsort((ids, score, query))
    query, ids, score, extra = query[order], ids[order], score[order], extra[order]
    starts = np.flatnonzero(np.concatenate(([True], query[1:] != query[:-1]))) if len(query) else np.zeros(0, np.int64)
    place = np.arange(len(query)) - np.repeat(starts, np.diff(np.append(starts, len(query))))
    kept = place < k
    return query[kept], ids[kept], score[kept], extra[kept]


class _Best:
    """The k nearest rows seen so far of each query of a block."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, k: int):
        self.ids, self.rows, self.k = ids, rows, k
        self.norms = (rows**2).sum(axis=1)
        self.limit = np.full(len(ids), np.inf)
        none = np.zeros(0, np.int64)
        self.best = (none, none, np.zeros(0), none)
        self.new: list[tuple] = []
        self.pending = 0

    def add(self, ids: np.ndarray, rows: np.ndarray, leaf: int) -> None:
        norms = (rows**2).sum(axis=1)
        rough = self.norms[:, None] + norms[None, :] - 2 * self.rows @ rows.T
        slack = 1e-10 * (self.norms[:, None] + norms[None, :])
        query, row = np.nonzero((rough - slack <= self.limit[:, None]) & (self.ids[:, None] != ids[None, :]))
        score = np.sqrt(((self.rows[query] - rows[row]) ** 2).sum(axis=1))
        self.new.append((query, ids[row], score, np.full(len(row), leaf)))
        self.pending += len(row)
        if self.pending > 4 * self.k * len(self.ids) + 4096:
            self.prune()

    def prune(self) -> None:
        self.best = _front(*(np.concatenate(x) for x in zip(self.best, *self.new, strict=True)), self.k)
        self.new, self.pending = [], 0
        query, _, score, _ = self.best
        full = np.bincount(query, minlength=len(self.ids)) >= self.k
        worst = np.zeros(len(self.ids))
        np.maximum.at(worst, query, score)
        self.limit = np.where(full, worst**2 * (1 + 1e-12), np.inf)

    def frame(self) -> pd.DataFrame:
        self.prune()
        query, ids, score, leaf = self.best
        return pd.DataFrame({"query_id": self.ids[query], "vec_id": ids, "score": score, "leaf": leaf.astype(np.int32)})


_FOUND = "query_id long, vec_id long, score double, leaf int"


class Index:
    """Tiles of all rows by leaf, the tree, and the number of leaves that a search opens at least."""

    def __init__(self, rows: DataFrame, sample: int = SAMPLE):
        """rows: ``vec_id`` and ``vector`` (doubles, all of one length)."""
        self.spark = rows.sparkSession
        self.width = one_length(rows, "vector")
        first = rows.select("vector").orderBy(F.xxhash64("vec_id", "vector")).limit(sample).toPandas()
        self.tree = grow(np.stack(first["vector"].to_numpy())) if len(first) else None
        self.leaves = 0 if self.tree is None else int(self.tree.leaf.max()) + 1
        self.opened = self.leaves
        if self.tree is None:
            return
        shared = self.spark.sparkContext.broadcast(self.tree)

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in batches:
                if len(part):
                    yield part.assign(leaf=shared.value.assign(np.stack(part["vector"].to_numpy())))

        placed = written(rows.mapInPandas(place, "vec_id long, vector array<double>, leaf int"), "placed")
        counts = placed.groupBy("leaf").count()  # as many rows as leaves
        self.sizes = {r["leaf"]: r["count"] for r in counts.collect()}
        parts = counts.select("leaf", F.ceil(F.col("count") / TILE).alias("parts"))
        dealt = placed.join(F.broadcast(parts), "leaf").withColumn("tile", F.expr("pmod(xxhash64(vec_id, vector), parts)"))

        def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            ids = rows["vec_id"].to_numpy(np.int64)
            return pd.DataFrame({"leaf": [key[0]], "ids": [packed(ids)], "vectors": [packed(np.stack(rows["vector"].to_numpy()))]})

        tiles = dealt.select("leaf", "tile", "vec_id", "vector").groupBy("leaf", "tile")
        self.tiles = written(tiles.applyInPandas(pack, "leaf int, ids binary, vectors binary"), "tiles")

    def calibrate(self, k: int, recall: float, rows: DataFrame, size: int = CALIBRATION) -> float:
        """Widen the visits until the rows of a bounded set find their true neighbours; returns the share found."""
        some = rows.orderBy(F.xxhash64(F.lit(1), "vec_id", "vector")).limit(size).toPandas()
        ids, vectors = some["vec_id"].to_numpy(np.int64), np.stack(some["vector"].to_numpy())
        shared, width = self.spark.sparkContext.broadcast((ids, vectors)), self.width

        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best = _Best(*shared.value, k)
            for part in batches:
                for leaf, raw, body in zip(part["leaf"], part["ids"], part["vectors"], strict=True):
                    best.add(longs(raw), matrix(body, len(raw) // 8, width), leaf)
            yield best.frame()

        found = _nearest(self.tiles.mapInPandas(search, _FOUND), k).toPandas()  # size x k rows
        if not len(found):
            return 1.0
        away = _distances(vectors, self.tree.centroids)
        order = {q: {leaf: i for i, leaf in enumerate(self.tree.visits(away[j]))} for j, q in enumerate(ids)}
        depth = np.sort([order[q][leaf] for q, leaf in zip(found["query_id"], found["leaf"], strict=True)])
        needed = int(np.ceil(recall * len(depth)))
        self.opened = int(depth[max(0, needed - 1)]) + 1
        return float((depth < self.opened).mean())

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """``query_id``, ``rank``, ``vec_id``, ``score``: the k nearest found of each query (``vec_id``, ``vector``)."""
        shared = self.spark.sparkContext.broadcast((self.tree, self.sizes))
        opened, width = self.opened, self.width

        def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            tree, sizes = shared.value
            for part in batches:
                for at in range(0, len(part), BLOCK):
                    some = part.iloc[at:at + BLOCK]
                    ids, rows = some["vec_id"].to_numpy(np.int64), np.stack(some["vector"].to_numpy())
                    away, by_leaf = _distances(rows, tree.centroids), {}
                    for i in range(len(ids)):
                        seen = 0
                        for number, leaf in enumerate(tree.visits(away[i])):
                            if number >= opened and seen > k:
                                break
                            seen += sizes.get(leaf, 0)
                            by_leaf.setdefault(leaf, []).append(i)
                    yield pd.DataFrame({
                        "leaf": list(by_leaf), "queries": [packed(ids[own]) for own in by_leaf.values()],
                        "rows": [packed(rows[own]) for own in by_leaf.values()],
                    })

        visits = queries.select("vec_id", "vector").mapInPandas(visit, "leaf int, queries binary, rows binary")
        met = written(visits, "visits").join(self.tiles, "leaf").select("leaf", "queries", "rows", "ids", "vectors")

        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best, of = None, None
            for part in batches:
                for leaf, queries, rows, raw, body in zip(*(part[c] for c in part.columns), strict=True):
                    if of != (leaf, queries):  # tiles of a block's leaf come one after the other, mostly
                        if best is not None:
                            yield best.frame()
                        of, ids = (leaf, queries), longs(queries)
                        best = _Best(ids, matrix(rows, len(ids), width), k)
                    best.add(longs(raw), matrix(body, len(raw) // 8, width), leaf)
            if best is not None:
                yield best.frame()

        return _nearest(met.mapInPandas(search, _FOUND), k).select("query_id", "rank", "vec_id", "score")


def _nearest(found: DataFrame, k: int) -> DataFrame:
    by_score = Window.partitionBy("query_id").orderBy("score", "vec_id", "leaf")
    return found.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, recall: float = 0.97) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` (Euclidean distance): the k nearest rows found of each query.

    vectors and queries: ``vec_id`` and ``embedding``.  Nearest first, ties to the smaller vec_id.  recall: share of
    true neighbours that the visits are widened to, on a calibration set; searches always open enough leaves to
    find k rows where there are so many.

    Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and rows with a null
    vec_id, take no part; rows with a query's own vec_id are not its neighbours; an id that repeats among the queries
    is one query, with the smallest of its vectors; a repeated row of ``vectors`` is found as often; an empty table
    gives an empty table; other columns are not read.  Vectors of different lengths are an error.
    """
    rows, asked = (
        df.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select(
            F.col("vec_id").cast("long"), doubles(F.col("embedding")).alias("vector")
        )
        for df in (vectors, queries)
    )
    rows = written(rows, "vectors")
    asked = asked.groupBy("vec_id").agg(F.min("vector").alias("vector"))
    index = Index(rows)
    if index.tree is None:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    index.calibrate(k, recall, rows)
    return index.search(asked, k)
