"""Byte-level BPE encoding by per-prefix dynamic programming, and decoding.

Every prefix of a piece of text has exactly one last token in its BPE encoding.  Going through the
prefixes from left to right, an Aho-Corasick automaton over the vocabulary (for short pieces, of which
many are encoded together in arrays, a tree of the tokens read backwards) gives the tokens that are
suffixes of the prefix; the one that is compatible with the last token of the prefix before it is
stored.  Compatible means that BPE leaves the two tokens' bytes, put together, as these two tokens.
Following the stored tokens from the end back gives the ids, without any merge queue.

Encoding is per piece: the vocabulary's rules never merge over the boundaries that its pattern sets.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the split pattern of the byte-level pre-tokenizer.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same pieces of ASCII texts.
ASCII_PIECES = r"'(?:[stmd]|re|ve|ll)| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"
#: Pieces whose ids, and token pairs of long pieces whose fit, a worker remembers (about); a full memory is
#: emptied, pieces still in use move on from the older to the newer one.
REMEMBERED, PAIRS = 85_000, 170_000
#: Token pairs of short pieces are remembered in 2 ** PAIR_BITS slots.
PAIR_BITS = 19
#: Fixed value: multiplier that spreads keys over the slots.
SPREAD = np.uint64(0x9E3779B97F4A7C15)
#: Longer pieces are not remembered.
LONG_PIECE = 64
#: Pieces of so many bytes at most are encoded together.
SHORT_PIECE = 32
#: Texts, and characters of them (or one text), that are encoded together.
CHUNK_TEXTS, CHUNK_CHARS = 250, 1 << 20


@dataclass(frozen=True)
class Vocabulary:
    """What the executors need: tokens by id, the left and right half of each id (-1: not merged), added tokens by text; the file's digest."""

    tokens: dict[int, bytes]
    halves: tuple[array, array]
    added: dict[str, int]
    digest: str


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the vocabulary file: printable bytes are themselves."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def read_vocabulary(path: str) -> Vocabulary:
    """Read a byte-level BPE tokenizer file (JSON) in the driver; it is small and goes to tasks whole."""
    with open(path, "rb") as file:
        content = file.read()
    spec = json.loads(content)
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    if model["type"] != "BPE" or before.get("type") != "ByteLevel" or not before.get("use_regex", True):
        raise ValueError("not a byte-level BPE tokenizer")
    unsupported = before.get("add_prefix_space") or spec.get("normalizer") or model.get("ignore_merges")
    odd = [t for t in spec["added_tokens"] if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]]
    if unsupported or odd or model.get("dropout"):
        raise ValueError("this tokenizer's options are not supported")
    letters, ids = _byte_letters(), model["vocab"]
    added = {t["content"]: t["id"] for t in spec["added_tokens"]}
    tokens = {i: bytes(letters[c] for c in t) for t, i in ids.items() if t not in added}
    halves = array("i", [-1]) * (max(ids.values(), default=-1) + 1), array("i", [-1]) * (max(ids.values(), default=-1) + 1)
    last = None
    for rank, pair in enumerate(model["merges"]):
        one, two = pair if isinstance(pair, list) else pair.split(" ")
        made = ids[one + two]
        if last is not None and made != last + 1:
            raise ValueError(f"merge {rank} does not make the next id; ids must follow the merge order")
        halves[0][made], halves[1][made], last = ids[one], ids[two], made
    return Vocabulary(tokens, halves, added, hashlib.sha256(content).hexdigest())


class _Table:
    """Fixed map of non-negative int64 keys to int32 values (-1: none), asked for many keys at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, (2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        slots = self._slots(keys)
        while len(keys):
            free = self.keys[slots] == -1
            self.keys[slots[free]] = keys[free]
            placed = self.keys[slots] == keys
            self.values[slots[placed]] = values[placed]
            keys, values, slots = keys[~placed], values[~placed], (slots[~placed] + 1) & self.mask

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * SPREAD) >> self.shift).view(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slots = self._slots(keys)
        there = self.keys[slots]
        same = there == keys
        found = np.where(same, self.values[slots], -1)
        again = np.flatnonzero(~same & (there != -1))
        while len(again):
            slots[again] = at = (slots[again] + 1) & self.mask
            there, same = self.keys[at], self.keys[at] == keys[again]
            found[again[same]] = self.values[at[same]]
            again = again[~same & (there != -1)]
        return found


class Encoder:
    """Encodes and decodes texts with one vocabulary; one per Python worker."""

    def __init__(self, vocabulary: Vocabulary):
        import ahocorasick
        import regex

        self.tokens = vocabulary.tokens
        self.texts = [b""] * (max([*self.tokens, *vocabulary.added.values()], default=-1) + 1)
        for i, t in [*self.tokens.items(), *((i, s.encode()) for s, i in vocabulary.added.items())]:
            self.texts[i] = t
        self.halves = vocabulary.halves
        self.lefts, self.rights = (np.array(half, np.int64) for half in self.halves)
        self.merged = {one << 32 | two: i for i, (one, two) in enumerate(zip(*self.halves, strict=True)) if one >= 0}
        self.added = {s: i.to_bytes(4, "little") for s, i in vocabulary.added.items()}
        self.pieces = regex.compile(PIECES).findall
        self.ascii_pieces = re.compile(ASCII_PIECES, re.ASCII).findall
        names = sorted(self.added, key=len, reverse=True)
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, names)) + ")").split if names else None
        self.automaton = ahocorasick.Automaton()
        self.sizes = np.array([len(t) for t in self.texts], np.int32)
        self.bytes = np.full(256, -1, np.int32)  # ids of single bytes
        for i, token in self.tokens.items():
            if len(token) > 1:
                self.automaton.add_word(token.decode("latin-1"), i)
            elif token:
                self.bytes[token[0]] = i
        self.automaton.make_automaton()
        self.whole = {t: i for i, t in self.tokens.items()}
        self.merges = _Table(np.array([*self.merged], np.int64), np.array([*self.merged.values()], np.int32))
        self._add_endings()
        self.compatible: dict[int, bool] = {}
        self.seen_pairs, self.seen_fits = np.full(1 << PAIR_BITS, -1, np.int64), np.zeros(1 << PAIR_BITS, bool)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _fits(self, left: int, right: int) -> bool:
        """Whether BPE keeps ``left`` and ``right``, side by side, as they are.

        Merges run in id order.  Undo the later of the two tokens' last merges, step by step: at each
        point the tokens at the boundary must not have had an earlier merge with each other.
        """
        (lefts, rights), merged = self.halves, self.merged
        before = 1 << 62  # only merges that come before this id would still have happened
        while True:
            if merged.get(left << 32 | right, before) < before:
                return False
            # of the two merges still standing, the later is undone first; a tie breaks at the left one, made first
            if left > right and rights[left] >= 0:
                before, left = left, rights[left]
            elif lefts[right] >= 0:
                before, right = right + 1, lefts[right]
            elif rights[left] >= 0:
                before, left = left, rights[left]
            else:
                return True

    def _add_endings(self) -> None:
        """The tokens read backwards as a tree: children by node and byte, and the token that a node ends."""
        children: dict[int, int] = {}
        ended = {}
        for i, token in self.tokens.items():
            node = 0
            for byte in reversed(token):
                node = children.setdefault(node << 9 | byte, len(children) + 1)
            ended[node] = i
        self.children = _Table(np.array([*children], np.int64), np.array([*children.values()], np.int32))
        self.ended = np.full(len(children) + 1, -1, np.int32)
        self.ended[[*ended]] = [*ended.values()]

    def _matches(self, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places where tokens of several bytes end, and the tokens; by size."""
        at, node, step = np.arange(len(flat)), np.zeros(len(flat), np.int64), 0
        places, found = [at[:0]], [self.ended[:0]]
        while len(at):
            node = self.children.get(node << 9 | flat[at - step])
            alive = node >= 0
            at, node = at[alive], node[alive].astype(np.int64)
            if step:
                token = self.ended[node]
                some = token >= 0
                places.append(at[some])
                found.append(token[some])
            step += 1
        return np.concatenate(places), np.concatenate(found)

    def _fit_each(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``_fits`` of many pairs, undoing one merge of each at a time."""
        lefts, rights = self.lefts, self.rights
        fits = np.ones(len(left), bool)
        row, before = np.arange(len(left)), np.full(len(left), 1 << 62)
        while len(row):
            made = self.merges.get(left << 32 | right)
            early = (made >= 0) & (made < before)
            fits[row[early]] = False
            one, two = rights[left], lefts[right]
            undo_left = (one >= 0) & ((left > right) | (two < 0))
            on = ~early & (undo_left | (two >= 0))
            before = np.where(undo_left, left, right + 1)[on]
            left, right, row = np.where(undo_left, one, left)[on], np.where(undo_left, right, two)[on], row[on]
        return fits

    def _fit_all(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``_fits`` of many pairs.  A slot of the memory holds the last pair that fell into it."""
        pairs = left.astype(np.int64) << 32 | right
        slots = (pairs.view(np.uint64) * SPREAD) >> np.uint64(64 - PAIR_BITS)
        fits = self.seen_fits[slots]
        missing = np.flatnonzero(self.seen_pairs[slots] != pairs)
        if len(missing):
            some, back = np.unique(pairs[missing], return_inverse=True)
            found = self._fit_each(some >> 32, some & 0xFFFFFFFF)[back]
            fits[missing] = found
            # two pairs of one slot: the places are written in the same order, so pair and verdict stay together
            self.seen_pairs[slots[missing]], self.seen_fits[slots[missing]] = pairs[missing], found
        return fits

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one piece: the unique last token of every prefix, then back from the end.

        Only tokens of several bytes are tried: where none is the last one, the prefix's last byte is.
        """
        last = [-1] * (len(piece) + 1)
        compatible, fits, texts, single = self.compatible, self._fits, self.texts, self.bytes
        for at, token in self.automaton.iter(piece.decode("latin-1")):
            end = at + 1
            if last[end] >= 0:
                continue
            start = end - len(texts[token])
            if start:
                if last[start] < 0:
                    last[start] = int(single[piece[start - 1]])
                    if last[start] < 0:
                        continue
                pair = last[start] << 32 | token  # one number takes half the memory of a tuple
                ok = compatible.get(pair)
                if ok is None:
                    if len(compatible) >= PAIRS:
                        compatible.clear()
                    ok = compatible[pair] = fits(last[start], token)
                if not ok:
                    continue
            last[end] = token
        ids, end = [], len(piece)
        while end:
            token = last[end] if last[end] >= 0 else int(single[piece[end - 1]])
            if token < 0:
                raise ValueError("the vocabulary has no token for a byte")
            ids.append(token)
            end -= len(texts[token])
        ids.reverse()
        return ids

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """``encode_piece`` of many short pieces, packed: the prefixes of one length of all pieces are looked at together."""
        if not pieces:
            return []
        # 256, which no token has, stands before each piece; its place is the empty prefix
        begins = np.cumsum([0, *[len(p) + 1 for p in pieces]])
        begins, ends = begins[:-1], begins[1:] - 1
        flat = np.full(ends[-1] + 1, 256, np.int64)
        flat[np.delete(np.arange(len(flat)), begins)] = np.frombuffer(b"".join(pieces), np.uint8)
        last = np.append(self.bytes, np.int32(-2))[flat]
        at, token = self._matches(flat)
        start = at - self.sizes[token]
        # rounds: by length of the prefix, then the longer token first
        depth = at - np.repeat(begins, ends - begins + 1)[at]
        turn = (depth << 32) - self.sizes[token]
        order = np.argsort(turn, kind="stable")
        at, token, start = at[order], token[order], start[order]
        done = np.zeros(len(flat), bool)
        for i in np.split(np.arange(len(at)), np.flatnonzero(np.diff(turn[order])) + 1):
            i = i[~done[at[i]]]
            before = last[start[i]]
            i, before = i[before != -1], before[before != -1]
            ok = before == -2
            inner = np.flatnonzero(~ok)
            ok[inner] = self._fit_all(before[inner], token[i[inner]])
            i = i[ok]
            last[at[i]], done[at[i]] = token[i], True
        used = np.zeros(len(flat), bool)
        here, stop = ends, begins
        while len(here):
            if (last[here] < 0).any():
                raise ValueError("the vocabulary has no token for a byte")
            used[here] = True
            here = here - self.sizes[last[here]]
            here, stop = here[here > stop], stop[here > stop]
        packed = last[used].astype("<u4").tobytes()
        cuts = (np.cumsum(used)[ends] * 4).tolist()
        return [packed[i:j] for i, j in zip([0, *cuts], cuts)]

    def _cut(self, text: str) -> list[str]:
        """Pieces of a text; an added token in it is a piece (no other piece can have its text)."""
        if not self.split_added or not any(name in text for name in self.added):
            return self.ascii_pieces(text) if text.isascii() else self.pieces(text)
        parts = self.split_added(text)
        return [p for i, part in enumerate(parts) for p in ([part] if i % 2 else self.pieces(part))]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; added tokens in a text are single ids."""
        if len(self.known) >= REMEMBERED // 4:  # the texts of this call add theirs, and the older memory counts as well
            self.known, self.older = {}, self.known
        known, older, whole = self.known, self.older, self.whole
        cut = [self._cut(text) for text in texts]
        brief, short = [], []
        for piece in set(chain.from_iterable(cut)).difference(known):
            packed = older.get(piece) or self.added.get(piece)
            if packed is None:
                raw = piece.encode()
                token = whole.get(raw)
                if token is not None:
                    packed = token.to_bytes(4, "little")
                elif len(raw) <= SHORT_PIECE:
                    short.append((piece, raw))
                    continue
                else:
                    packed = b"".join([i.to_bytes(4, "little") for i in self.encode_piece(raw)])
            known[piece] = packed
            if len(piece) > LONG_PIECE:
                brief.append(piece)
        known.update(zip([p for p, _ in short], self.encode_pieces([raw for _, raw in short])))
        joined = [b"".join(map(known.__getitem__, pieces)) for pieces in cut]
        for piece in brief:
            del known[piece]
        return joined

    def encode(self, text: str) -> bytes:
        """``encode_all`` of one text."""
        return self.encode_all([text])[0]

    def decode(self, packed: bytes) -> str:
        """Text of ids; bytes that are no UTF-8 become U+FFFD."""
        ids = memoryview(packed).cast("I").tolist()
        return b"".join([*map(self.texts.__getitem__, ids)]).decode("utf-8", "replace")


_ENCODERS: dict[str, Encoder] = {}


def _encoder(vocabulary: Vocabulary) -> Encoder:
    """The worker's encoder, kept from task to task."""
    if vocabulary.digest not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[vocabulary.digest] = Encoder(vocabulary)
    return _ENCODERS[vocabulary.digest]


def _chunks(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Cut a batch of texts of these sizes into runs of ``CHUNK_TEXTS`` and ``CHUNK_CHARS`` at most, or of one text."""
    begin = total = 0
    for i, size in enumerate(sizes):
        if i > begin and (i - begin == CHUNK_TEXTS or total + size > CHUNK_CHARS):
            yield begin, i
            begin, total = i, 0
        total += size
    if sizes:
        yield begin, len(sizes)


def encode(docs: DataFrame, path: str, keep_ids: bool = False) -> DataFrame:
    """Encode the whole ``text`` of every row and decode it again.

    path: tokenizer file, read in the driver.  Returns ``doc_id``, ``n_tokens``, ``ids_sha256``,
    ``decoded_sha256`` and, with ``keep_ids``, ``ids`` (array<int>) and ``decoded``.

    Row-local: nothing is shuffled, and a worker holds the vocabulary (of fixed size), a bounded memory
    of pieces and one small
    batch of texts.  Defined cases: null texts encode like empty ones (no ids);
    texts that contain an added token's string give its id; repeated rows give repeated rows; an empty
    table gives an empty table; other columns are not read.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(read_vocabulary(path))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(shared.value)
        for part in batches:
            for i, j in _chunks([len(text) for text in part["text"]]):
                chunk = part.iloc[i:j]
                out = []
                for packed in encoder.encode_all(chunk["text"].tolist()):
                    decoded = encoder.decode(packed)
                    digests = hashlib.sha256(packed).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()
                    kept = (memoryview(packed).cast("I").tolist(), decoded) if keep_ids else ()
                    out.append((len(packed) // 4, *digests, *kept))
                columns = ["n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if keep_ids else [])]
                made = pd.DataFrame(out, columns=columns)
                made.insert(0, "doc_id", chunk["doc_id"].astype("Int64").to_numpy(dtype=object))
                yield made

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if keep_ids:
        schema += ", ids array<int>, decoded string"
    plain = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return plain.mapInPandas(rows, schema)
