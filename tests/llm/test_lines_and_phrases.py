"""Line dedup and collocation mining against plain Python."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell.llm import collocations, key_filter, line_dedup

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, at string, h1 string, key string"
SHARED = "This passage is in many documents, word for word"


def rows():
    long = "\n".join(f"Line {i % 4000} of the long one" for i in range(20_000))
    return [
        (3, f"\t{SHARED.upper()} \r\nonly here 3 times\nshort", "en"),
        (2, f"{SHARED}\n{SHARED}\n\nshort", "en"),
        (2, f"{SHARED}\n{SHARED}\n\nshort", "en"),
        (4, f"a\n{SHARED}\nb\n  {SHARED}", None),
        (5, None, "en"), (6, "", "en"), (7, "\n\n", None), (None, SHARED, "en"), (None, SHARED, "en"), (None, f"{SHARED}\nx", None),
        (8, long, "en"), (9, "Line 17 of the long one\nline 18 OF the long one", "und"),
        (10, "nameless line\nÄÖÜ äöü ß\n١٢٣٤٥٦٧٨٩", "fr"), (None, "nameless line\nÄÖÜ äöü ß", "fr"),
        (11, "äöü äöü ß\nÄÖÜ äöü ß\n١٢٣٤٥٦٧٨٩٠", "fr"), (12, "١٢٣٤٥٦٧٨٩٠\n١٢٣٤٥٦٧٨٩\x0c", "fr"), (None, None, None),
    ]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "x", None, "y") for r in rows()], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# lines


def plain_lines(table, least_docs=2):
    """Kept texts by the rule as it is written; documents without id are told apart by their text and come last."""
    def name(doc_id, text):
        return (1, 0, text or "") if doc_id is None else (0, doc_id, "")

    def key(line):
        bare = line.strip(" \t\n\x0b\x0c\r")
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in bare)

    held = defaultdict(set)
    for doc_id, text in table:
        for line in (text or "").split("\n"):
            held[key(line)].add(name(doc_id, text))
    gone = {k for k, docs in held.items() if len(k) >= 10 and len(docs) >= least_docs}
    out = []
    for doc_id, text in table:
        lines = (text or "").split("\n")
        doc = name(doc_id, text)
        # names of documents without id have no order but their text's digest: any one of them may be the first
        kept = [x for x in lines if key(x) not in gone or min(held[key(x)]) == doc]
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def test_lines_on_a_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    table = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = line_dedup.digests(docs).collect()
    want = [(i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in plain_lines(table)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert sum(r["n_dropped"] for r in got) > 0


def test_lines_of_odd_rows(odd):
    got = line_dedup.without_repeated_lines(odd)
    assert got.columns == ["doc_id", "n_lines", "n_dropped", "kept"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(plain_lines([r[:2] for r in rows()]), key=str)


def test_lines_of_documents_without_id(spark):
    texts = [f"{SHARED}\n{i}" for i in range(20)] * 2
    docs = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string")
    got = line_dedup.without_repeated_lines(docs).collect()
    # one text, with its repeat, keeps the line; all others lose it
    assert Counter(r["n_dropped"] for r in got) == {0: 2, 1: 38}
    assert {r["kept"] for r in got if r["n_dropped"]} < {str(i) for i in range(20)}


@pytest.mark.parametrize("least_docs", [2, 3, 4])
def test_threshold_counts_documents(spark, least_docs):
    draw = random.Random(5)
    table = [(i // 2, "\n".join(f"common line {draw.randrange(12)}" for _ in range(draw.randrange(6)))) for i in range(40)]
    docs = spark.createDataFrame(table, "doc_id long, text string")
    got = line_dedup.without_repeated_lines(docs, least_docs=least_docs).collect()
    assert sorted(map(tuple, got)) == sorted(plain_lines(table, least_docs))


def test_lines_of_an_empty_table(empty):
    assert line_dedup.digests(empty).collect() == []


# phrases


def plain_phrases(table, least):
    """Every language's phrases, cut and dropped by the rules as they are written."""
    f, n = defaultdict(Counter), Counter()
    for lang, text in table:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, 5):
                f[lang].update(tuple(words[i:i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, counts in f.items():
        often = {p: c for p, c in counts.items() if c >= least and len(p) > 1}
        kept = []
        for phrase, a in often.items():
            inside = (
                c for p, c in often.items()
                if len(p) > len(phrase) and any(p[i:i + len(phrase)] == phrase for i in range(len(p)))
            )
            if any(100 * c >= 80 * a for c in inside):
                continue
            score, k = min((2_000_000 * a // (counts[phrase[:k]] + counts[phrase[k:]]), k) for k in range(1, len(phrase)))
            kept.append((-score, -a, " ".join(phrase).encode(), counts[phrase[:k]], counts[phrase[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:2000], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


@pytest.mark.parametrize("least", [30, 3])
def test_phrases_of_a_whole_table(spark, least):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    table = [(r["lang"], r["text"]) for r in docs.collect()]
    got = collocations.collocations(docs, least=least).collect()
    assert sorted(map(tuple, got)) == plain_phrases(table, least)
    assert len(got) > 5


def test_phrases_of_odd_rows(odd):
    table = [(r[2], r[1]) for r in rows()]
    got = collocations.collocations(odd, least=2)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == plain_phrases(table, 2)


def test_phrases_of_one_repeated_word(spark):
    docs = spark.createDataFrame([("na " * 5000, None), ("", "en"), (None, "en"), (" \t.;", "en")], "text string, lang string")
    got = collocations.collocations(docs).collect()
    # 'na na' lies in 'na na na' nearly as often, and that in the phrase of four
    assert [tuple(r) for r in got] == [("und", 1, "na na na na", 4997, 5000, 4998, 5000, 2_000_000 * 4997 // 9998)]


def test_phrases_of_an_empty_table(empty):
    assert collocations.collocations(empty).collect() == []


def test_chunks_own_each_word_once_and_reach_as_far_as_a_phrase():
    draw = random.Random(3)
    for _ in range(50):
        text = " ".join(draw.choice(["a", "b", "c.", "d", "e\n", "f,g", "é"]) for _ in range(draw.randrange(200))).encode()
        pieces = [p.split() for p in re.split(rb"[.,;:!?\x0a-\x0d]", text)]
        want = Counter(tuple(p[i:i + s]) for p in pieces for s in range(1, 5) for i in range(len(p) - s + 1))
        got = Counter()
        for chunk, own in collocations.chunks(text, every=3):
            parts, at = [p.split(b" ") for p in chunk.split(b"\n")], 0
            for part in parts:
                for i in range(len(part)):
                    if at < own:
                        got.update(tuple(part[i:i + s]) for s in range(1, 5) if i + s <= len(part))
                    at += 1
        assert got == want


def test_shared_passages_are_chunked_alike():
    shared = " ".join(f"w{i % 50}x{i % 7}" for i in range(2000)).encode()
    one, two = (dict.fromkeys(c for c, _ in collocations.chunks(x + b" " + shared)) for x in (b"one", b"two three."))
    assert len(one.keys() & two.keys()) >= len(one) - 2


def test_texts_are_parsed_together_as_each_alone():
    draw = random.Random(4)
    marks = ["a", "b c.", "d\te", "\n", ". ,", "é", "x" * 63, "y" * 64, "z" * 65, "Z" * 200]
    texts = [None, b"", b" .;\n", *(" ".join(draw.choices(marks, k=draw.randrange(80))).encode() for _ in range(40)), None, b"", b"end"]
    found, own, of = collocations._parse(texts, 3, 4)
    alone = [(i, chunk, n) for i, t in enumerate(texts) for chunk, n in collocations.chunks(t, every=3)]
    assert list(zip(of.tolist(), found, own.tolist(), strict=True)) == alone


def test_words_have_one_hash_wherever_they_stand():
    draw = random.Random(5)
    words = sorted({bytes(draw.choices(b"ab\xc3", k=k)) for k in range(1, 80) for _ in range(20)} | {b"\0", b"\0\0", b"a\0"})
    seen = {}
    for _ in range(3):
        draw.shuffle(words)
        sizes = np.array([len(w) for w in words])
        made = collocations._hashes(b" ".join(words), np.cumsum(sizes + 1) - sizes - 1, sizes)
        for word, value in zip(words, made.tolist(), strict=True):
            assert seen.setdefault(word, value) == value
    assert len(set(seen.values())) == len(words)


def test_filter_holds_all_frequent_keys(spark):
    keys = np.random.default_rng(1).integers(-1 << 63, 1 << 63, 5000)
    counts = spark.createDataFrame([(int(k), 2 + i % 3) for i, k in enumerate(keys)], "key long, times long")
    found = collocations._maybe_frequent(counts, 3)
    held = key_filter.among(keys.view(np.uint64), found)
    frequent = np.arange(5000) % 3 > 0
    assert held[frequent].all() and held[~frequent].mean() < 0.05
    assert len(found) * 8 >= 16 * frequent.sum()


def test_exact_scores_beyond_64_bits(spark, monkeypatch):
    big = 9_000_000_000_000_000
    phrases = spark.createDataFrame([("en", "a", 1, big), ("en", "b", 1, big + 3), ("en", "a b", 2, big - 5)], "lang string, phrase string, words int, f long")
    totals = spark.createDataFrame([("en", 3 * big)], "lang string, n long")
    monkeypatch.setattr(collocations, "frequent_phrases", lambda *_: (phrases, totals))
    row = collocations.collocations(phrases.select(F.lit("x").alias("text"))).first()
    assert row["score"] == 2_000_000 * (big - 5) // (2 * big + 3)
