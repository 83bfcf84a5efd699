"""Alignment of the tokens of two tokenizers over the same texts.

Tokenizer A (byte-level BPE, ``tokenizers``) reads space+text, tokenizer B (``sentencepiece``, which adds the space)
the text.  A's character offsets and the spans of B's pieces (those of its proto) are coarse cuts; where a token is a part of a
character, a fallback byte or the added space, the bytes that the token stands for refine them.  Merging both lists of
ends gives groups (up to a byte where tokens of both end) and links (pairs of tokens that share a byte).

Neither tokenizer merges over a single space between two characters that are no space, nor between a letter and a mark
behind it (with a vocabulary for which that does not hold texts are read whole), so texts are cut there and each word with
its space is aligned once for many documents.

How many documents link a pair of ids is a matter of the whole corpus.  Documents are put together in blocks of about
``BLOCK`` bytes with a dictionary of their pairs; only the dictionaries meet the corpus-wide counts, and each block
gets back the counts of its own pairs.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.bpe import _byte_letters
from inkwell.llm.common import written

#: Bytes of text of a block, and of the texts that are aligned at once.
BLOCK, STEP = 4 << 20, 1 << 18
#: Words that a worker remembers of each of two times, and the length from which on a word is not remembered.
REMEMBERED, LONG_WORD = 300_000, 64
#: Marks that are aligned apart behind a letter (up to ``LAST_LETTER``, as tokenizers may know other letters beyond it).
MARKS, LAST_LETTER = ".,;:!?", chr(0x24F)
#: A word, or marks in a tuple of one.
Part = str | tuple[str]

#: Code points beside which a space is no place to cut: white space, control and format characters of any kind.
_ODD = ((0x00, 0x20), (0x7F, 0xA0), (0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x1680, 0x1680),
        (0x17B4, 0x17B5), (0x180B, 0x180F), (0x2000, 0x200F), (0x2028, 0x202F), (0x205F, 0x206F), (0x3000, 0x3000),
        (0x3164, 0x3164), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0))
_PLAIN = "[^" + r"\s" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in _ODD) + "]"
#: A space between two plain characters.
_CUT = re.compile(f" (?={_PLAIN})(?<={_PLAIN} )")
#: Words that begin and end with one.
_EDGES = re.compile(f"(?s:{_PLAIN}(?:.*{_PLAIN})?)")


def refined(spans: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Ends of tokens in bytes: a coarse span of the size of the token's own bytes stands; in place of others (parts of
    characters, fallback bytes, added spaces) the bytes of the tokens so far count."""
    return np.where(spans[:, 1] - spans[:, 0] == sizes, spans[:, 1], np.cumsum(sizes))


def merged(a: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Links and groups of two lists of tokens over the same bytes.

    Returns the links (A id in the upper, B id in the lower 32 bits, repeats included) with the byte where each ends, the
    bytes where groups end, and the groups as text.
    """
    cuts = np.sort(np.concatenate((a_ends, b_ends)), kind="stable")
    cuts = cuts[np.append(cuts[1:] != cuts[:-1], True)]  # between two cuts lies one link
    a_of, b_of = np.searchsorted(a_ends, cuts), np.searchsorted(b_ends, cuts)
    both = np.flatnonzero((a_ends[a_of] == cuts) & (b_ends[b_of] == cuts))
    a_text, b_text = [*map(str, a.tolist())], [*map(str, b.tolist())]
    groups, i, j = [], 0, 0
    for i_to, j_to in zip((a_of[both] + 1).tolist(), (b_of[both] + 1).tolist(), strict=True):
        one = a_text[i] if i_to - i == 1 else ",".join(a_text[i:i_to])
        two = b_text[j] if j_to - j == 1 else ",".join(b_text[j:j_to])
        groups.append(f"{one}|{two}")
        i, j = i_to, j_to
    return a[a_of] << 32 | b[b_of], cuts, cuts[both], groups


def _pairs(spans: list[tuple[int, int]]) -> np.ndarray:
    return np.fromiter(chain.from_iterable(spans), np.int64, 2 * len(spans)).reshape(-1, 2)


class Aligner:
    """Both tokenizers with a memory of words; one per Python worker.

    a_json, b_model: contents of the two tokenizer files.
    """

    def __init__(self, a_json: str, b_model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_json)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        self.b = SentencePieceProcessor()
        self.b.LoadFromSerializedProto(b_model)
        letters = _byte_letters()
        self.a_bytes = {
            i: bytes(map(letters.__getitem__, t)) if all(c in letters for c in t) else t.encode()
            for t, i in self.a.get_vocab(with_added_tokens=True).items()
        }
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)
        ]
        self.a_sizes = np.zeros(max(self.a_bytes) + 1, np.int64)
        for i, raw in self.a_bytes.items():
            self.a_sizes[i] = len(raw)
        self.b_sizes = np.array([*map(len, self.b_bytes)])
        self.marks = not any(x.isalpha() and y in MARKS for p in pieces for x, y in pairwise(p))
        self.cuts = not any("▁" in p.lstrip("▁") for p in pieces)
        #: Words met lately, and those of the time before, from which words in use come back.
        self.known: dict[Part, tuple | None] = {}
        self.before: dict[Part, tuple | None] = {}

    def words(self, text: str) -> list[Part]:
        """Parts of the text that can be aligned apart: words, each without the space before it, and in tuples of one the marks
        behind the last letter of a word."""
        if not self.cuts:
            return [text]
        words = _CUT.split(text)
        if not self.marks:
            return words
        parts: list[Part] = []
        for word in words:
            if word and word[-1] in MARKS:
                stem = word.rstrip(MARKS)
                if stem and stem[-1] <= LAST_LETTER and stem[-1].isalpha():
                    parts += (stem, (word[len(stem):],))
                    continue
            parts.append(word)
        return parts

    def align(self, parts: list[Part]) -> list[tuple | None]:
        """For each part (number of A tokens, of B tokens, of groups, groups, links as packed pairs), or None where
        the tokens' bytes differ from its own.  Words that can stand side by side are read as one text."""
        made: dict[int, tuple | None] = {}
        joined = [i for i, w in enumerate(parts) if isinstance(w, str) and _EDGES.fullmatch(w) and chr(0x2581) not in w]
        for i, record in zip(joined, self._read([parts[i] for i in joined]), strict=True):
            made[i] = record
        return [
            made[i] if i in made else self._behind(w[0]) if isinstance(w, tuple) else self._read([w])[0] for i, w in enumerate(parts)
        ]

    def _behind(self, marks: str) -> tuple | None:
        """Alignment of marks behind a letter: that of the letter with them, less that of the letter."""
        (letter,), (both,) = self._read(["a"]), self._read(["a" + marks])
        if letter is None or both is None or not both[3].startswith(letter[3] + ";") or not both[4].startswith(letter[4]):
            return None
        return (*(both[k] - letter[k] for k in range(3)), both[3][len(letter[3]) + 1:], both[4][len(letter[4]):])

    def _read(self, words: list[str]) -> list[tuple | None]:
        if not words:
            return []
        text = " " + " ".join(words)
        raw = text.encode()
        one, two = self.a.encode(text, add_special_tokens=False), self.b.encode(text[1:], return_type="offset_mapping")
        same = one.ids and all(b"".join(map(of.__getitem__, ids)) == raw for of, ids in ((self.a_bytes, one.ids), (self.b_bytes, two["ids"])))
        a, b = np.array(one.ids, np.int64), np.array(two["ids"], np.int64)
        ends = np.cumsum([len(w.encode()) + 1 for w in words])
        if same:
            points = np.frombuffer(text.encode("utf-32-le"), "<u4")
            at = np.concatenate(([0], np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF))))
            spans = _pairs(two["offsets"]) + 1  # the text begins with the space that B adds
            spans[0, 0] = 0
            a_ends = refined(at[_pairs(one.offsets)], self.a_sizes[a])
            b_ends = refined(at[spans], self.b_sizes[b])
            links, cuts, group_ends, groups = merged(a, a_ends, b, b_ends)
            same = (group_ends[np.searchsorted(group_ends, ends)] == ends).all()
        if not same:
            return [None] if len(words) == 1 else [self._read([w])[0] for w in words]
        packed = links.astype("<i8").tobytes()
        upto = [np.searchsorted(x, ends, "right") for x in (a_ends, b_ends, group_ends, cuts)]
        n_a, n_b = (np.diff(x, prepend=0).tolist() for x in upto[:2])
        first_group, first_link = ([0, *x.tolist()] for x in upto[2:])
        return [
            (n_a[k], n_b[k], j - i, ";".join(groups[i:j]), packed[8 * first_link[k]:8 * first_link[k + 1]])
            for k, (i, j) in enumerate(pairwise(first_group))
        ]

    def learn(self, words: list[Part]) -> dict[Part, tuple | None]:
        """Alignments of distinct parts, from memory where it has them."""
        known, before = self.known, self.before
        found, unknown, again = {}, [], {}
        for word in words:
            if word in known:
                found[word] = known[word]
            elif word in before:
                found[word] = again[word] = before[word]
            else:
                unknown.append(word)
        if unknown:
            new = dict(zip(unknown, self.align(unknown), strict=True))
            found |= new
            again |= {w: r for w, r in new.items() if len(w) < LONG_WORD}
        if len(known) + len(again) > REMEMBERED:
            self.before, self.known = known, {}
        self.known |= again
        return found


_ALIGNERS: dict[str, Aligner] = {}


def _aligner(digest: str, a_json: str, b_model: bytes) -> Aligner:
    """The worker's aligner, kept from task to task."""
    if digest not in _ALIGNERS:
        _ALIGNERS.clear()
        _ALIGNERS[digest] = Aligner(a_json, b_model)
    return _ALIGNERS[digest]


class _Block:
    """Documents whose links share one dictionary of id pairs."""

    def __init__(self):
        self.size = 0
        self.places: dict[Part, int] = {}
        self.records: list[tuple] = []
        self.docs: list[tuple] = []
        self.lists: list[np.ndarray] = []

    def add(self, doc_id: int | None, text: str, words: list[Part] | None) -> None:
        """words: the text's parts, all of them known to the block; None without tokens."""
        self.size += len(text.encode())
        if words is None:
            self.docs.append((doc_id, 0, 0, 0, 0, ""))
            self.lists.append(np.empty(0, np.int64))
            return
        at = np.fromiter(map(self.places.__getitem__, words), np.int64, len(words))
        records = [self.records[i] for i in at.tolist()]
        n_a, n_b, n_groups = (sum(r[k] for r in records) for k in range(3))
        digest = hashlib.sha256(";".join([r[3] for r in records]).encode()).hexdigest()
        self.docs.append((doc_id, n_a, n_b, n_groups, sum(len(r[4]) for r in records) // 8, digest))
        self.lists.append(at)

    def row(self, number: int) -> dict:
        """The block as one row: its pairs with their document counts, its documents, and each document's pairs."""
        sizes = np.array([len(r[4]) // 8 for r in self.records], np.int64)
        starts = np.cumsum(sizes) - sizes
        flat = np.frombuffer(b"".join([r[4] for r in self.records]), "<i8")
        pairs, where = np.unique(flat, return_inverse=True)
        documents = np.zeros(len(pairs), np.int64)
        lengths, steps, times = [], [], []
        for at in self.lists:
            n = sizes[at]
            gathered = np.repeat(starts[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            held, counts = np.unique(where[gathered], return_counts=True)
            documents[held] += 1
            lengths.append(len(held))
            steps.append(np.diff(held, prepend=0).astype("<u4"))
            times.append(counts.astype("<u4"))
        packed = b"".join(x.tobytes() for x in (*steps, *times))
        names = ("doc_ids", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
        return {"block": number, "pairs": pairs, "documents": documents} | {
            name: [d[k] for d in self.docs] for k, name in enumerate(names)
        } | {"doc_ids": [d[0] or 0 for d in self.docs], "nameless": [d[0] is None for d in self.docs]} | {"n_pairs": lengths, "held": pa.compress(packed, "zstd", asbytes=True), "held_size": len(packed)}


_BLOCK = (
    "block long, pairs array<long>, documents array<long>, doc_ids array<long>, nameless array<boolean>, n_a array<long>, n_b array<long>, "
    "n_groups array<long>, n_links array<long>, groups_sha256 array<string>, n_pairs array<long>, held binary, held_size long"
)


def _blocks(docs: DataFrame, a_path: str, b_path: str, block_bytes: int) -> DataFrame:
    """Aligned documents in blocks (see ``_Block.row``), written to the shared folder."""
    with open(a_path, encoding="utf-8") as a_file, open(b_path, "rb") as b_file:
        a_json, b_model = a_file.read(), b_file.read()
    digest = hashlib.sha256(a_json.encode() + b_model).hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast((digest, a_json, b_model))  # two files of fixed size

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        aligner, block = _aligner(*shared.value), _Block()
        number = TaskContext.get().partitionId() << 32

        def steps() -> Iterator[list[tuple]]:
            step, size = [], 0
            for part in batches:
                for doc_id, text in zip(part["doc_id"].astype(object), part["text"], strict=True):
                    step.append((None if pd.isna(doc_id) else int(doc_id), text or ""))
                    size += len(text or "")
                    if size >= STEP:
                        yield step
                        step, size = [], 0
            yield step

        def enter(words: list[Part]) -> list[Part]:
            """Have the block know the words; the words back that have no alignment."""
            new = [*dict.fromkeys(w for w in words if w not in block.places)]
            odd = []
            for word, record in aligner.learn(new).items():
                if record is None:
                    odd.append(word)
                else:
                    block.places[word] = len(block.records)
                    block.records.append(record)
            return odd

        for step in steps():
            parted = [aligner.words(text) if text else [] for _, text in step]
            odd = set(enter([w for words in parted for w in words]))
            for (doc_id, text), words in zip(step, parted, strict=True):
                if odd and not odd.isdisjoint(words):  # read whole, it may fit together after all
                    words = [text] if not enter([text]) else []
                block.add(doc_id, text, words or None)
            if block.size >= block_bytes:
                yield pd.DataFrame([block.row(number)])
                number, block = number + 1, _Block()
        if block.docs:
            yield pd.DataFrame([block.row(number)])

    plain = docs.select(F.col("doc_id").cast("long"), F.col("text"))
    return written(plain.mapInPandas(rows, _BLOCK), "aligned")


def pair_counts(blocks: DataFrame) -> DataFrame:
    """``pair`` (A id in the upper, B id in the lower 32 bits), ``n_docs`` and ``best`` (the highest of its A id)."""
    each = blocks.select(F.explode(F.arrays_zip("pairs", "documents")).alias("p")).select("p.pairs", "p.documents")
    counts = each.groupBy(F.col("pairs").alias("pair")).agg(F.sum("documents").alias("n_docs"))
    counts = written(counts.withColumn("a_id", F.shiftright("pair", 32)), "pair-counts")
    most = counts.groupBy("a_id").agg(F.max("n_docs").alias("most"))
    return counts.join(most, "a_id").select("pair", "n_docs", (F.col("n_docs") == F.col("most")).alias("best"))


def aligned(docs: DataFrame, a_path: str, b_path: str, block_bytes: int = BLOCK) -> DataFrame:
    """Alignment of every document: ``doc_id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``,
    ``groups_sha256``.

    a_path, b_path: files of the byte-level BPE and of the sentencepiece model, read in the driver.  ``n_best`` are
    the links whose pair is held by as many documents as any pair of its A id, ``count_sum`` the sum over links of the
    number of documents that hold the pair linked.  ``groups_sha256`` is of the groups as text.

    Defined cases: null and empty texts, and texts whose tokens of A or B do not give space+text byte by byte, have
    no tokens (zeros and an empty string) and link nothing; each row is a document, repeated rows too; rows without
    doc_id are aligned like others; an empty table gives an empty table; other columns are not read.
    """
    blocks = _blocks(docs, a_path, b_path, block_bytes)
    asked = blocks.select("block", F.posexplode("pairs").alias("at", "pair"))
    answers = asked.join(written(pair_counts(blocks), "pair-best"), "pair")
    answers = answers.select(F.col("block").alias("asked"), "at", "n_docs", "best")
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"

    def summed(block: pd.DataFrame, answer: pd.DataFrame) -> pd.DataFrame:
        row = block.iloc[0]
        order = answer["at"].to_numpy(np.int64)
        n_docs, best = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        n_docs[order], best[order] = answer["n_docs"].to_numpy(np.int64), answer["best"].to_numpy(np.int64)
        raw = pa.decompress(row["held"], int(row["held_size"]), "zstd", asbytes=True)
        steps, times = np.frombuffer(raw, "<u4").astype(np.int64).reshape(2, len(raw) // 8)
        n_best, count_sum, at = [], [], 0
        for n in row["n_pairs"]:
            held, often = np.cumsum(steps[at:at + n]), times[at:at + n]
            n_best.append(int(best[held] @ often))
            count_sum.append(int(n_docs[held] @ often))
            at += n
        return pd.DataFrame({
            "doc_id": pd.arrays.IntegerArray(row["doc_ids"].astype(np.int64), row["nameless"].astype(bool)),
            **{c: row[c] for c in ("n_a", "n_b", "n_groups", "n_links")},
            "n_best": n_best, "count_sum": count_sum, "groups_sha256": row["groups_sha256"],
        })

    plain = blocks.drop("pairs", "documents")
    return plain.groupBy("block").cogroup(answers.groupBy("asked")).applyInPandas(summed, schema)
