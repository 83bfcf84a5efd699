"""Near copies by word overlap: SimHash fingerprints and MinHash bands give candidates, exact Jaccard of word shingles decides.

A document's set is that of its 5-word shingles (64-bit hashes).  The fingerprints of the distinct sets go through the
positional byte index of ``simhash`` (count filter, bits verified): sets within ``BITS`` bits are linked.  As few sets of
Jaccard 0.8 are so near, each distinct set is also looked up under ``BANDS`` keys, each
of ``ROWS`` minima: two sets of Jaccard J miss each other in all bands with a chance of (1 - J**5)**30, that is 7e-6 at
J = 0.8 and less above.  Sets that share a key are linked if their signatures, a byte of each minimum, agree in
``AGREE`` places or more; sets of Jaccard 0.8 fail that with a chance below 1e-10.  The components of both kinds of links
are the candidates, and within a candidate all pairs are open to the exact check, whatever linked them.

The check goes by connection, so that many like texts cost about one comparison a text: first each set meets the
candidate's hub, the set nearest to all others; then the sets that are unlike the hub meet all the others, block
against block of about ``SHINGLES`` hashes and ``SETS`` sets, and pairs that are connected already are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm import key_filter, simhash
from inkwell.llm.common import free_name, written
from inkwell.llm.components import components

#: Differing bits of linked fingerprints at most.
BITS = 4
BANDS, ROWS = 30, 5
#: Words of a shingle, and the least Jaccard similarity of near copies as a fraction.
WIDTH, LEAST = 5, (4, 5)
#: Hashes of the sets that are compared at once, and number of these sets.
SHINGLES, SETS = 1 << 16, 512
#: Minima of two signatures that must agree.
AGREE = 85
#: Rows of hashes in an Arrow batch.
ROWS_SENT = 64

_RANDOM = np.random.default_rng(42)
_FLIP, _TIMES = (_RANDOM.integers(0, 1 << 64, BANDS * ROWS, np.uint64) for _ in range(2))
_TIMES |= np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct XXH64 (seed 42) of the word shingles; of fewer words than ``width`` one shingle, of none none."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(width, len(words))
    hash_of = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1:].tolist(), strict=True)
    return np.unique(np.array([hash_of(joined[i:j], 42) for i, j in spans], np.uint64))


def set_id(hashes: np.ndarray) -> int:
    """64-bit digest of a set as a signed number; 0 for the empty set."""
    if not len(hashes):
        return 0
    made = xxhash.xxh64_intdigest(hashes.astype("<u8").tobytes(), 42)
    return made - (1 << 64) if made >> 63 else made


def _minima(hashes: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * ROWS, ~np.uint64(0), np.uint64)
    for i in range(0, len(hashes), 256):
        np.minimum(least, ((hashes[i:i + 256, None] ^ _FLIP) * _TIMES).min(axis=0), out=least)
    return least


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One key a band; none for the empty set."""
    if not len(hashes):
        return np.empty(0, np.int64)
    least = _minima(hashes)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64) * _MIX
    for row in least.reshape(BANDS, ROWS).T:
        keys = (keys ^ row) * _MIX
        keys ^= keys >> np.uint64(29)
    return keys.view(np.int64)


def alike(one: np.ndarray, two: np.ndarray) -> bool:
    """Whether two sorted sets have a Jaccard similarity of ``LEAST`` or more."""
    above, below = LEAST
    few, many = sorted((len(one), len(two)))
    if few * below < many * above:
        return False
    both = np.sort(np.concatenate((one, two)))
    shared = int((both[1:] == both[:-1]).sum())
    return shared * below >= (few + many - shared) * above


def signature(hashes: np.ndarray) -> bytes:
    """One byte of each minimum; none for the empty set."""
    return (_minima(hashes) * _MIX >> np.uint64(56)).astype(np.uint8).tobytes() if len(hashes) else b""


def likely(one: np.ndarray, n_one: np.ndarray, two: np.ndarray, n_two: np.ndarray) -> np.ndarray:
    """Whether sets of these signatures (rows) and sizes may be alike; broadcasts."""
    above, below = LEAST
    sizes = np.minimum(n_one, n_two) * below >= np.maximum(n_one, n_two) * above
    return sizes & ((one == two).sum(axis=-1) >= AGREE)


def fingerprint(hashes: np.ndarray) -> int:
    """SimHash of a set as a signed number; 0 for the empty set."""
    made = simhash.majority(hashes) if len(hashes) else 0
    return made - (1 << 64) if made >> 63 else made


def _signed(packed: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(packed), np.uint8).reshape(-1, BANDS * ROWS)


def _sides(part: pa.RecordBatch) -> Iterator[list[dict[str, np.ndarray | list[bytes]]]]:
    """The blocks ``m`` and ``with`` of one row after another, taken apart only when it is their turn."""
    for i in range(part.num_rows):
        row = []
        for name in ("m", "with"):
            side = part.column(name)[i].values
            held = dict(zip([f.name for f in side.type], side.flatten(), strict=True))
            hashes = held.pop("hashes", None)
            signs = _signed(held.pop("sign").to_pylist())
            row.append({k: v.to_numpy(zero_copy_only=False) for k, v in held.items()} | {"sign": signs, "hashes": [] if hashes is None else hashes.to_pylist()})
        yield row


def _links(found: list[tuple[int, int]]) -> pa.RecordBatch:
    columns = [pa.array([pair[k] for pair in found], pa.int64()) for k in (0, 1)]
    return pa.RecordBatch.from_arrays(columns, ["a", "b"])


def _forest(left: np.ndarray, right: np.ndarray, pairs: Iterator[tuple[int, np.ndarray]]) -> list[tuple[int, int]]:
    """Links of a spanning forest of ``pairs`` (a position on the left, positions on the right)."""
    names, at = np.unique(np.concatenate((left, right)), return_inverse=True)
    label, found = np.arange(len(names)), []
    one, two = at[: len(left)], at[len(left):]
    for i, others in pairs:
        nodes = two[others]
        labels, first = np.unique(label[nodes], return_index=True)
        for other, node in zip(labels.tolist(), nodes[first].tolist(), strict=True):
            own = label[one[i]]
            if other != own:
                found.append((int(names[one[i]]), int(names[node])))
                label[label == other] = own
    return found


def _linked(apart: list[np.ndarray], others: list[np.ndarray], signs: tuple[np.ndarray, np.ndarray], together: bool) -> list[tuple[int, int]]:
    """Links that connect all alike pairs between ``apart`` and ``others``, or within ``apart`` if there are no others, as
    positions in both lists joined.

    together: whether ``others`` are connected already.  Once a set is met, its whole group is left out.
    """
    sets, sizes = [*apart, *others], np.array([len(s) for s in (*apart, *others)])
    both = np.concatenate(signs)
    label, found = np.arange(len(sets)), []
    if together:
        label[len(apart):] = len(apart)
    for i in range(len(apart)):
        begin = len(apart) if others else i + 1
        open_to = np.flatnonzero(label[begin:] != label[i]) + begin
        agree = (both[i] == both[open_to]).sum(axis=1)
        fits = likely(both[i], sizes[i], both[open_to], sizes[open_to])
        for j in open_to[fits][np.argsort(-agree[fits], kind="stable")].tolist():
            if label[j] != label[i] and alike(sets[i], sets[j]):
                found.append((i, j))
                label[label == label[j]] = label[i]
    return found


def _rows(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``set`` of every row, with ``n`` (its shingles), ``fp``, ``keys`` and ``sign`` of the set."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            sets = [shingles(t) for t in part["text"]]
            yield pd.DataFrame({
                "doc_id": part["doc_id"].astype("Int64"), "set": [set_id(s) for s in sets],
                "n": [len(s) for s in sets], "fp": [fingerprint(s) for s in sets], "keys": [band_keys(s) for s in sets], "sign": [signature(s) for s in sets],
            })

    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    return written(plain.mapInPandas(rows, "doc_id long, set long, n long, fp long, keys array<long>, sign binary"), "sets")


def _fingerprint_links(distinct: DataFrame) -> DataFrame:
    """Links ``a``, ``b`` that connect all sets whose fingerprints differ in ``BITS`` bits at most; the empty set has none."""
    prints = distinct.where("n > 0").select("set", "fp")
    firsts = written(prints.groupBy("fp").agg(F.min("set").alias("first")), "prints")
    equal = prints.join(firsts, "fp").where("set <> first").select(F.col("set").alias("a"), F.col("first").alias("b"))
    one, two = (firsts.select(F.col("fp").alias(x), F.col("first").alias(f"set_{x}")) for x in "ab")
    near = simhash.links(firsts.select("fp"), BITS).join(one, "a").join(two, "b")
    return equal.union(near.select("set_a", "set_b"))


def _likely_links(distinct: DataFrame) -> DataFrame:
    """Links ``a``, ``b`` that connect all pairs of sets which share a key and whose signatures may be of alike sets.

    Every set of a key is held against the key's smallest set.  Only in keys where that is not enough, as some set is
    unlike the smallest, these sets are held against all others of the key, block by block.
    """
    postings = distinct.select("set", F.explode("keys").alias("key"))
    keys = postings.groupBy("key").agg(F.min("set").alias("least"), F.count("*").alias("sets")).where("sets > 1")
    met = written(postings.join(written(keys, "keys"), "key"), "met").where("set <> least")
    signs = distinct.select("set", "n", "sign")
    one, two = (signs.select(*(F.col(c).alias(f"{c}_{x}") for c in signs.columns)) for x in "ab")
    pairs = met.select(F.col("set").alias("set_a"), F.col("least").alias("set_b")).distinct().join(one, "set_a").join(two, "set_b")

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            if len(part):
                fits = likely(_signed(part["sign_a"].tolist()), part["n_a"].to_numpy(), _signed(part["sign_b"].tolist()), part["n_b"].to_numpy())
                yield pd.DataFrame({"a": part["set_a"], "b": part["set_b"], "fits": fits})

    judged = written(pairs.mapInPandas(judge, "a long, b long, fits boolean"), "judged")
    unlike = judged.where("NOT fits").select(F.col("a").alias("set"), F.col("b").alias("least"))
    apart = written(met.where("sets > 2").join(unlike, ["set", "least"], "left_semi").select("key", "set"), "apart")
    blocks = F.ceil(F.col("sets") / SETS).cast("int")
    open_keys = apart.select("key").distinct()
    held = met.join(open_keys, "key", "left_semi").join(apart.withColumn("apart", F.lit(True)), ["key", "set"], "left")
    held = held.select("key", "set", F.coalesce("apart", F.lit(False)).alias("apart"), blocks.alias("blocks")).join(signs, "set")
    packed = held.groupBy("key", "blocks", F.expr("pmod(xxhash64(set), blocks)").cast("int").alias("block")).agg(
        F.collect_list(F.struct("set", "n", "sign", "apart")).alias("m"), F.max("apart").alias("some")
    )
    packed = written(packed, "key-blocks")
    left = packed.where("some").select("key", "block", "m", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    right = packed.select("key", F.col("block").alias("other"), F.col("m").alias("with"))
    sides = left.join(right, ["key", "other"]).select("m", "with")

    def forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for one, two in _sides(part):
                apart = one["apart"]
                sets, n, signs = one["set"][apart], one["n"][apart], one["sign"][apart]

                def fitting(n=n, signs=signs, two=two) -> Iterator[tuple[int, np.ndarray]]:
                    for i in range(len(n)):
                        yield i, np.flatnonzero(likely(signs[i], n[i], two["sign"], two["n"]))

                yield _links(_forest(sets, two["set"], fitting()))

    return judged.where("fits").select("a", "b").union(sides.mapInArrow(forests, "a long, b long"))


def _hubs(members: DataFrame) -> DataFrame:
    """``root`` and ``hub`` of each candidate: the set that agrees best with the most frequent bytes of all signatures."""
    bytes_of = F.posexplode(F.split(F.rtrim(F.regexp_replace(F.hex("sign"), "(..)", "$1 ")), " ")).alias("at", "byte")
    counts = members.select("root", bytes_of).groupBy("root", "at", "byte").agg(F.count("*").alias("n"))
    usual = counts.groupBy("root", "at").agg(F.max_by("byte", F.struct("n", "byte")).alias("byte"))
    usual = usual.groupBy("root").agg(F.array_join(F.array_sort(F.collect_list(F.struct("at", "byte")))["byte"], "").alias("usual"))

    def agreement(signs: pd.Series, usual: pd.Series) -> pd.Series:
        return pd.Series((_signed(signs.tolist()) == _signed([bytes.fromhex(u) for u in usual])).sum(axis=1))

    near = members.join(usual, "root").select("root", "set", F.pandas_udf(agreement, "long")("sign", "usual").alias("near"))
    return near.groupBy("root").agg(F.max_by("set", F.struct("near", "set")).alias("hub"))


def _hashes(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``set`` and ``hashes`` (its shingles as bytes) of the sets of ``wanted`` (``set``, ``first_id``).

    Texts stay where they are read: a filter of the wanted ids picks the rows whose shingles are made again.
    """
    shared = docs.sparkSession.sparkContext.broadcast(key_filter.build(wanted.select(F.xxhash64("first_id").alias("key"))))

    def of_ids(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            some = part[key_filter.among(part["key"].to_numpy(np.int64).view(np.uint64), shared.value)]
            sets = [shingles(t) for t in some["text"]]
            yield pd.DataFrame({"set": [set_id(s) for s in sets], "id": some["id"].astype("Int64").to_numpy(), "hashes": [s.tobytes() for s in sets]})

    plain = docs.select(F.xxhash64(F.col("doc_id").cast("long")).alias("key"), F.col("doc_id").cast("long").alias("id"), F.col("text").cast("binary").alias("text"))
    made = plain.mapInPandas(of_ids, "set long, id long, hashes binary")
    asked = wanted.select("set", F.col("first_id").alias("asked"))
    exact = made.join(asked, (made["set"] == asked["set"]) & made["id"].eqNullSafe(asked["asked"])).select(made["set"], "hashes")
    return exact.groupBy("set").agg(F.first("hashes").alias("hashes"))


@contextmanager
def _few_rows(spark: SparkSession) -> Iterator[None]:
    """Within, tables go to Python some ``ROWS_SENT`` rows at a time, as rows hold the hashes of whole texts."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, str(ROWS_SENT))
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def _alike_links(docs: DataFrame, distinct: DataFrame, near_prints: DataFrame) -> DataFrame:
    """Links ``a``, ``b`` between sets that connect all alike pairs of the candidates."""
    roots = components(near_prints.union(_likely_links(distinct)))
    members = written(distinct.join(roots.withColumnRenamed("node", "set"), "set").select("set", "first_id", "n", "sign", "root"), "members")
    hubs = written(_hubs(members), "hubs")
    hashed = _hashes(docs, members).join(members.select("set", "sign", "n", "root"), "set").join(hubs, "root")
    hashed = written(hashed, "hashed")
    # every set against its candidate's hub
    hub_hashes = hashed.where("set = hub").select(F.col("set").alias("hub"), F.col("hashes").alias("hub_hashes"))

    def with_hub(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            near = [
                alike(np.frombuffer(h, np.uint64), np.frombuffer(u, np.uint64))
                for h, u in zip(part["hashes"], part["hub_hashes"], strict=True)
            ]
            yield pd.DataFrame({"set": part["set"], "near": near})

    # a popular hub is sent once to each of its shares
    placed = hashed.select("set", "hub", "hashes", F.expr("pmod(xxhash64(set), 64)").alias("share"))
    spread = placed.select("hub", "share").distinct().join(hub_hashes, "hub")
    near = written(placed.join(spread, ["hub", "share"]).select("set", "hashes", "hub_hashes").mapInPandas(with_hub, "set long, near boolean"), "near")
    stars = members.select("set", "root").join(hubs, "root").join(near.where("near"), "set").select(F.col("set").alias("a"), F.col("hub").alias("b"))
    # sets unlike their hub against all others of the candidate, block by block
    left = written(near.where("NOT near").join(members.select("set", "root"), "set").select("set", "root"), "unlike")
    rooted = left.select("root").distinct()
    open_sets = hashed.join(rooted, "root", "left_semi").join(near, "set")
    sizes = open_sets.groupBy("root", "near").agg(F.ceil(F.greatest(F.sum("n") / SHINGLES, F.count("*") / SETS)).cast("int").alias("blocks"))
    block = F.expr("pmod(xxhash64(set), blocks)").cast("int").alias("block")
    blocks = open_sets.join(written(sizes, "sizes"), ["root", "near"]).groupBy("root", "near", "blocks", block).agg(
        F.collect_list(F.struct("set", "hashes", "sign")).alias("m")
    )
    blocks = written(blocks, "blocks")
    apart = blocks.where("NOT near").select("root", "block", "m")
    own = apart.select("m", F.array().cast(blocks.schema["m"].dataType).alias("with"), F.lit(False).alias("together"))
    others = blocks.select("root", "near", F.col("block").alias("other"), F.col("m").alias("with"))
    cross = apart.join(others, "root").where("near OR block < other").select("m", "with", F.col("near").alias("together"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for (one, two), together in zip(_sides(part), part.column("together").to_pylist(), strict=True):
                sets = [[np.frombuffer(h, np.uint64) for h in side["hashes"]] for side in (one, two)]
                names = np.concatenate((one["set"], two["set"])).tolist()
                found = _linked(*sets, (one["sign"], two["sign"]), together)
                yield _links([(names[i], names[j]) for i, j in found])

    return stars.where("a <> b").union(own.union(cross).mapInArrow(compare, "a long, b long"))


def _classes(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """``set``, ``root`` (a set of the class), ``component_id`` (its smallest doc_id) and ``rows`` of each distinct set."""
    distinct = rows.groupBy("set").agg(
        F.min("doc_id").alias("first_id"), F.count("*").alias("rows"), F.first("n").alias("n"), F.first("fp").alias("fp"),
        F.first("keys").alias("keys"), F.first("sign").alias("sign")
    )
    distinct = written(distinct, "distinct")
    near_prints = written(_fingerprint_links(distinct), "near-prints")
    with _few_rows(docs.sparkSession):
        alike_sets = written(_alike_links(docs, distinct, near_prints), "alike")
    roots = written(components(alike_sets), "roots")
    rooted = distinct.join(roots.withColumnRenamed("node", "set"), "set", "left").select(
        "set", "first_id", "rows", F.coalesce("root", "set").alias("root")
    )
    rooted = written(rooted, "rooted")
    named = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"), F.sum("rows").alias("class_rows"))
    return written(rooted.join(named, "root"), "classes")


def classes(docs: DataFrame) -> DataFrame:
    """``set``, ``root`` (a set of the class) and ``component_id`` (its smallest doc_id) of each distinct set of shingles.

    Two documents are in one class if a chain of documents leads from one to the other with a Jaccard similarity of
    ``LEAST`` or more a step.  Texts without words (null included) have the empty set and are one class.
    """
    return _classes(docs, _rows(docs)).select("set", "root", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents, one of each class: the one with the smallest doc_id.  All columns are kept as they are.

    Defined cases: null and empty texts and texts of white space are one class; of rows alike in doc_id and shingles
    one stays, whichever is met first; rows that share a doc_id but not the class are told apart by their shingles; a
    class without any doc_id keeps one of its rows; an empty table gives an empty table; other columns may have any name.

    Only rows of classes of several rows are shuffled; a filter of their ids lets all others pass where they are read.
    """
    rows = _rows(docs)
    found = _classes(docs, rows)
    several = found.where("class_rows > 1").select("set", "root", "first_id", "component_id")
    named = F.min(F.when(F.col("first_id").eqNullSafe(F.col("component_id")), F.col("set")))
    firsts = written(several.groupBy("root", "component_id").agg(named.alias("set")).select("set", "component_id"), "firsts")
    touched = written(rows.join(several.select("set"), "set", "left_semi").select(F.xxhash64("doc_id").alias("key")).distinct(), "touched")
    shared = docs.sparkSession.sparkContext.broadcast(key_filter.build(touched))
    key, own = free_name(docs, "inkwell_key"), free_name(docs, "inkwell_set")

    def may_be(keys: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in keys:
            yield pd.Series(key_filter.among(part.to_numpy(np.int64).view(np.uint64), shared.value))

    def sets_of(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for keys, texts in parts:
            some = key_filter.among(keys.to_numpy(np.int64).view(np.uint64), shared.value)
            yield pd.Series([set_id(shingles(t)) if s else None for s, t in zip(some, texts, strict=True)], dtype="Int64")

    doc_id = F.col("doc_id").cast("long")
    passing = docs.where(~F.pandas_udf(may_be, "boolean")(F.xxhash64(doc_id))).select(*docs.columns)
    # one function, not repeated by filters that are pushed down: each one in a plan's stage holds a Python worker of every task
    set_of = F.pandas_udf(sets_of, "long").asNondeterministic()
    held = docs.withColumn(own, set_of(F.xxhash64(doc_id), F.col("text").cast("binary"))).where(F.col(own).isNotNull())
    alone = held.join(several.select(F.col("set").alias(own)), own, "left_anti").select(*docs.columns)
    chosen = firsts.select(F.col("set").alias(own), F.col("component_id").alias(key))
    one = held.join(chosen, (held[own] == chosen[own]) & doc_id.eqNullSafe(chosen[key]), "left_semi")
    one = one.groupBy(own).agg(*(F.first(c).alias(c) for c in docs.columns)).select(*docs.columns)
    return passing.union(alone).union(one)
