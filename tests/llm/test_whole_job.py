"""Places where an operator once did less than the whole job."""

import random
import time

import corpus_pipeline
import numpy as np
import pytest
from inkwell.llm import minhash, surrogates

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string"


def word_sets(text):
    words = (text or "").encode().lower().split()
    width = min(5, len(words))
    return {tuple(words[i:i + width]) for i in range(len(words) - width + 1)} if words else set()


def plain_firsts(rows):
    """Smallest ids of the classes, over all pairs."""
    sets, root = {i: word_sets(t) for i, t in rows}, {i: i for i, _ in rows}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for at, i in enumerate(ids):
        for j in ids[:at]:
            a, b = sets[i], sets[j]
            if 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 5 * len(a & b) >= 4 * len(a | b) and top(i) != top(j):
                low, high = sorted((top(i), top(j)))
                root[high] = low
    return sorted(i for i in ids if root[i] == i)


def test_stage_drops_all_near_copies_of_five_words(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, SF)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == plain_firsts(rows)


def test_near_copies_over_blocks_and_chains(spark, monkeypatch):
    """Copies of copies, with more edits a step than 4 bits allow, cut into small blocks; rows without ids."""
    monkeypatch.setattr(minhash, "SHINGLES", 500)
    monkeypatch.setattr(minhash, "SETS", 4)
    rng, rows = random.Random(5), []
    for family in range(4):
        words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        for _ in range(25):
            for _ in range(3):  # Jaccard about 0.86 a step
                words[rng.randrange(200)] = f"w{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(words)))
    rows += [(1000, None), (1001, " "), (1002, "two words"), (1003, "TWO  words")]
    docs = spark.createDataFrame([*rows, (None, "two words"), (None, "no id"), (None, "No id")], SCHEMA).repartition(5)
    kept = [r["doc_id"] for r in minhash.one_of_each(docs).collect()]
    assert kept.count(None) == 1
    assert sorted(i for i in kept if i is not None) == plain_firsts(rows)
    empty = docs.where("false")
    assert minhash.one_of_each(empty).count() == 0


def test_hub_with_many_variants_unlike_each_other(spark, monkeypatch):
    """Variants of one text, each near the text and far from the others, and a second family with the same opening."""
    monkeypatch.setattr(minhash, "SETS", 16)
    rng, rows = random.Random(9), []
    opening = [f"o{rng.randrange(10**6)}" for _ in range(150)]
    for family in range(2):
        base = opening + [f"w{rng.randrange(10**6)}" for _ in range(150)]
        rows.append((1000 + family, " ".join(base)))
        for i in range(60):
            words = list(base)
            for k in rng.sample(range(300), 6):
                words[k] = f"v{rng.randrange(10**6)}"
            rows.append((family * 100 + i, " ".join(words)))
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert sorted(r["doc_id"] for r in minhash.one_of_each(docs).collect()) == plain_firsts(rows)


def test_rows_with_one_id_or_clashing_columns(spark):
    long = " ".join(f"word{i % 97} thing{i % 31}" for i in range(40_000))
    schema = "doc_id long, text string, `set` long, inkwell_key string, root long"
    rows = [
        (1, "one two three four five six", 1, "a", 5), (1, "one two three four five six", 1, "a", 5),
        (1, "another text with the same id", 2, None, 5), (2, "ONE two three four five six", 1, "a", 5),
        (3, long, None, None, None), (4, long + " end", None, "x", 0), (None, None, None, None, None), (None, "", 1, "b", 1), (5, " ", 1, "c", 1),
    ]
    docs = spark.createDataFrame(rows, schema).repartition(3)
    kept = minhash.one_of_each(docs)
    assert kept.columns == docs.columns
    got = sorted(tuple(r)[:2] for r in kept.collect())
    assert got == [(1, "another text with the same id"), (1, "one two three four five six"), (3, long), (5, " ")]


def near_prints(rows):
    """Pairs of texts whose fingerprints lie within 4 bits."""
    prints = {i: minhash.fingerprint(minhash.shingles(t.encode())) & (1 << 64) - 1 for i, t in rows}
    return [(i, j) for i in prints for j in prints if i < j and (prints[i] ^ prints[j]).bit_count() <= 4]


def test_stage_finds_copies_by_their_fingerprints(spark, monkeypatch):
    """Without the bands, the SimHash index alone gives candidates, copies of equal fingerprints included."""
    rng, rows = random.Random(8), []
    for family in range(5):
        words = [f"w{rng.randrange(10**6)}" for _ in range(400)]
        rows += [(10 * family, " ".join(words)), (10 * family + 1, " ".join([*words, "end"])), (10 * family + 2, " ".join(words[:-1]))]
    pairs = near_prints(rows)
    assert {i for pair in pairs for i in pair} == {i for i, _ in rows} and all(i // 10 == j // 10 for i, j in pairs)
    monkeypatch.setattr(minhash, "band_keys", lambda hashes: np.empty(0, np.int64))
    docs = spark.createDataFrame([*rows, (100, None), (101, " "), (102, "two words")], SCHEMA).repartition(3)
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, SF)
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 10, 20, 30, 40, 100, 102]


def test_near_fingerprints_are_checked_on_shingles(spark, monkeypatch):
    """Texts of one fingerprint by chance are candidates, not copies."""
    monkeypatch.setattr(minhash, "fingerprint", lambda hashes: 77)
    rng = random.Random(2)
    rows = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))) for i in range(12)]
    rows += [(20 + i, t + " end") for i, t in rows[:6]]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(2)
    assert sorted(r["doc_id"] for r in minhash.one_of_each(docs).collect()) == plain_firsts(rows) == list(range(12))


def test_unlike_texts_of_one_candidate_take_seconds():
    """A block of many short sets that agree in half their shingles: pairs fall by their signatures."""
    rng = np.random.default_rng(4)
    common = rng.integers(0, 1 << 63, 6, np.uint64)
    sets = [np.unique(np.concatenate((common, rng.integers(0, 1 << 63, 6, np.uint64)))) for _ in range(5000)]
    signs = minhash._signed([minhash.signature(s) for s in sets])
    started = time.time()
    assert minhash._linked(sets, [], (signs, signs[:0]), False) == []
    assert time.time() - started < 60


def test_alike_sets_agree_in_their_signatures():
    rng, least = np.random.default_rng(6), []
    for _ in range(200):
        hashes = rng.integers(0, 1 << 63, 1000, np.uint64)
        one, two = np.sort(hashes[:900]), np.sort(hashes[100:])  # Jaccard 0.8
        assert minhash.alike(one, two)
        signs = minhash._signed([minhash.signature(x) for x in (one, two)])
        least.append((signs[0] == signs[1]).sum())
    assert min(least) >= minhash.AGREE + 10


@pytest.mark.parametrize(("text", "kind", "value"), [
    ("pay 4111 1111 1111 1111 12/25 now", "card", "4111111111111111"),
    ("pay 4111 1111 1111 1111 123", "card", "4111111111111111"),
    ("2 4111 1111 1111 1111", "card", "4111111111111111"),
    ("No.4111 1111 1111 1111-", "card", "4111111111111111"),
    ("visa -4111-1111-1111-1111", "card", "4111111111111111"),
    ("4111 1111 1111 1111 5500 0000 0000 0004", "card", "4111111111111111"),
    ("BE68 5390 0754 7034 BIC KREDBEBB", "iban", "BE68539007547034"),
    ("DE89370400440532013000 EUR", "iban", "DE89370400440532013000"),
    ("BE68 5390 0754 7034 4111 1111 1111 1111", "iban", "BE68539007547034"),
    ("BE68 5390 0754 7034 4111 1111 1111 1111", "card", "4111111111111111"),
    ("SSN.078-05-1120", "ssn", "078051120"),
    ("Tel.212-555-0199", "phone", "+12125550199"),
])
def test_numbers_among_other_groups_are_found(text, kind, value):
    assert (kind, value) in [(m.kind, m.value) for m in surrogates.mentions(text)]


@pytest.mark.parametrize("text", ["1234567890123456", "0.4111111111111111", "x4111111111111111", "4111111111111111.5"])
def test_other_numbers_stay(text):
    assert not surrogates.mentions(text)
