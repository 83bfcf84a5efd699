"""Alignment of two tokenizers against a plain reading of whole texts."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from inkwell.llm import alignment
from inkwell.llm.bpe import _byte_letters

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"
ODD = [
    None, "", " ", "  two  spaces ", "a b", "a▁b", "▁ x", "日本 語", "x\x00y z", "🙂🙃 é́  x", "a\n\nb \n c",
    "<|endoftext|> <s> </s> <0x41>", "fl​at ᠎ e", "don't  we'll 12 34", "�\U000e0001 tag", "ß ẞ ﬁ ½ \x85 \x1c z",
    "word " * 3000, "x" * 5000, "\r\n\tq", "ab́ ́c", "End. ends!? é, 1. _. x² ². 's. a's: (b), c.d.", " ▁▁", "　a 　 b",
]


@pytest.fixture(scope="module")
def tools():
    a = Tokenizer.from_file(A_PATH)
    a.no_truncation()
    a.no_padding()
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=B_PATH)


def plain(text, tools):
    """Ids of A and B, links and groups of one whole text, by byte positions."""
    a, b = tools
    letters = _byte_letters()
    raw = (" " + (text or "")).encode()
    if not text:
        return None
    a_ids, b_ids = a.encode(raw.decode(), add_special_tokens=False).ids, b.encode(text)
    a_parts = [bytes(letters[c] for c in a.id_to_token(i)) for i in a_ids]
    b_parts = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in b_ids]
    if b"".join(a_parts) != raw or b"".join(b_parts) != raw:
        return None
    owner_a = [k for k, p in enumerate(a_parts) for _ in p]
    owner_b = [k for k, p in enumerate(b_parts) for _ in p]
    links = Counter((a_ids[x], b_ids[y]) for x, y in set(zip(owner_a, owner_b, strict=True)))
    last = len(raw) - 1
    ends = [k for k in range(len(raw)) if k == last or (owner_a[k] != owner_a[k + 1] and owner_b[k] != owner_b[k + 1])]
    groups, start = [], 0
    for end in ends:
        one = sorted(set(owner_a[start:end + 1]))
        two = sorted(set(owner_b[start:end + 1]))
        groups.append(",".join(str(a_ids[k]) for k in one) + "|" + ",".join(str(b_ids[k]) for k in two))
        start = end + 1
    return a_ids, b_ids, links, groups


def plain_rows(rows, tools):
    each = [(doc_id, plain(text, tools)) for doc_id, text in rows]
    counts = Counter(pair for _, made in each if made for pair in made[2])
    highest = defaultdict(int)
    for (one, _), n in counts.items():
        highest[one] = max(highest[one], n)
    out = []
    for doc_id, made in each:
        if made is None:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
            continue
        a_ids, b_ids, links, groups = made
        best = sum(n for p, n in links.items() if counts[p] == highest[p[0]])
        total = sum(n * counts[p] for p, n in links.items())
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest()
        out.append((doc_id, len(a_ids), len(b_ids), len(groups), sum(links.values()), best, total, digest))
    return out


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def order(rows):
    return sorted(map(tuple, rows), key=str)


def test_whole_table_and_odd_rows(spark, tools):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame(
        [(i + 1000 if i % 5 else None, t) for i, t in enumerate(ODD)] + [(1002, ODD[2]), (1004, "a b")], "doc_id long, text string"
    )
    both = docs.union(odd)
    rows = [tuple(r) for r in both.collect()]
    got = alignment.aligned(both.repartition(3), A_PATH, B_PATH, block_bytes=50_000).select(*COLUMNS).collect()
    assert order(got) == order(plain_rows(rows, tools))


def test_empty_table_and_clashing_columns(spark, tools):
    empty = spark.createDataFrame([], "doc_id long, text string, block long, pair long")
    assert alignment.aligned(empty, A_PATH, B_PATH).columns == COLUMNS
    assert alignment.aligned(empty, A_PATH, B_PATH).collect() == []
    few = spark.createDataFrame([(1 << 60, "a b", 5, 6), (None, None, None, None)], "doc_id long, text string, block long, pair long")
    got = alignment.aligned(few, A_PATH, B_PATH).select(*COLUMNS).collect()
    assert order(got) == order(plain_rows([(1 << 60, "a b"), (None, None)], tools))


@pytest.fixture(scope="module")
def aligner():
    with open(A_PATH, encoding="utf-8") as a_file, open(B_PATH, "rb") as b_file:
        return alignment.Aligner(a_file.read(), b_file.read())


@settings(max_examples=400, deadline=None)
@given(text=st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from("ab 1'.\n\t  ▁é🙂")), max_size=40))
def test_words_align_as_whole_texts(aligner, tools, text):
    want = plain(text, tools)
    records = aligner.align(aligner.words(text)) if text else []
    if want is None:
        assert not text or None in records
        return
    assert None not in records
    assert ";".join(r[3] for r in records) == ";".join(want[3])
    assert [sum(r[k] for r in records) for k in range(3)] == [len(want[0]), len(want[1]), len(want[3])]


def test_refined_spans_follow_bytes():
    # a character of four bytes over three tokens, all with the character's whole span
    spans, sizes = np.array([(0, 1), (1, 5), (1, 5), (1, 5), (5, 6)]), np.array([1, 1, 2, 1, 1])
    assert alignment.refined(spans, sizes).tolist() == [1, 2, 4, 5, 6]
    links, cuts, ends, groups = alignment.merged(np.array([7, 8]), np.array([3, 4]), np.array([1, 2, 3]), np.array([1, 3, 4]))
    assert links.tolist() == [7 << 32 | 1, 7 << 32 | 2, 8 << 32 | 3] and cuts.tolist() == [1, 3, 4]
    assert ends.tolist() == [3, 4] and groups == ["7|1,2", "8|3"]


@settings(max_examples=200, deadline=None)
@given(words=st.lists(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from("ab1'.,-\n🙂é")), min_size=1, max_size=8), min_size=2, max_size=6))
def test_words_side_by_side_align_as_each_alone(aligner, words):
    assert aligner.align(words) == [aligner.align([w])[0] for w in words]
