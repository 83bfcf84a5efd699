"""Phrase collocations by prefix-free parsing.

Texts become sequences of lower-cased words in pieces.  A word pair whose hash is a multiple of ``EVERY`` triggers a cut
before its second word, wherever it stands, so passages that many documents share are cut into the same chunks.  A
chunk owns the words up to the next cut and overlaps it by as many words of the same piece as a longest phrase can
need; a phrase belongs to the chunk that owns its first word, and so is counted once.  The dictionary of distinct chunks
holds how often each occurs in the parse; phrases are counted inside distinct chunks, weighted by that.

A phrase is frequent only if all phrases in it are.  Words and then pairs are first counted under 64-bit hashes; a Bloom
filter of bounded size (``key_filter``) holds those that may be frequent, and only phrases made of them are counted under
their own text.  Hashes that meet and a filter that is full let more phrases through to that count, never fewer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.llm import key_filter
from inkwell.llm.common import written

#: Words a chunk owns on average.
EVERY = 32
#: Words of a phrase at most, occurrences at least, share (percent) of a phrase's occurrences in a longer one that
#: drops it, and phrases of a language that are returned.
LONGEST, LEAST, COVERED, TOP = 4, 30, 80, 2000
#: Words that are counted at once in a task.
STEP = 1 << 20
#: Bytes of texts that are parsed at once (a longer text by itself).
AT_ONCE = 1 << 21
#: Words of more bytes are hashed one by one.
LONG = 64

#: Ends of pieces become line feeds, tabs become spaces.
_ENDS = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", b"\n" * 9 + b" ")
_K = np.uint64(0x9E3779B97F4A7C15)
#: For 0 to 8 bytes, the mask of that many first bytes.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _K
    return x ^ (x >> np.uint64(32))


def _hashes(text: bytes, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words of ``text``, eight bytes of all words at a time; of words longer than ``LONG`` XXH64."""
    eights = np.ndarray(len(text) + 1, "<u8", text + bytes(8), strides=1)
    made = np.zeros(len(starts), np.uint64)
    some, at, left = np.arange(len(starts)), starts, np.minimum(sizes, LONG)
    while len(at):
        eight = eights[at] & _FIRST[np.minimum(left, 8)]
        made[some] = _mix((made[some] ^ eight) * _K + left.astype(np.uint64))
        more = np.flatnonzero(left > 8)
        some, at, left = some[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(sizes > LONG).tolist():
        made[i] = xxhash.xxh64_intdigest(text[starts[i]:starts[i] + sizes[i]])
    return made


class _Numbers(dict):
    """Numbers words in the order in which they are first asked for."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def _parse(texts: list[bytes | None], every: int, longest: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The chunks of some texts, one text after another; how many words each owns; the text (position) it is of."""
    texts = [t or b"" for t in texts]
    joined = b"\n".join([*texts, b""]).lower().translate(_ENDS)
    raw = np.frombuffer(joined, np.uint8).copy()
    in_word = (raw != 32) & (raw != 10)
    edges = np.flatnonzero(np.diff(in_word, prepend=False))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return [], np.empty(0, np.int64), np.empty(0, np.int64)
    lines = np.cumsum(raw == 10, dtype=np.int32)
    piece_ends = np.append(lines[starts[1:]] > lines[ends[:-1] - 1], True)
    text_starts = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
    heads = np.searchsorted(starts, text_starts)  # first word of each text, or where it would be
    sizes = ends - starts
    hashes = _hashes(joined, starts, sizes)
    cut = np.zeros(len(starts) + 1, bool)
    cut[heads] = True
    cut[1:-1] |= _mix(hashes[:-1] * _K + hashes[1:]) % np.uint64(every) == 0
    firsts = np.flatnonzero(cut[:-1])
    nexts = np.append(firsts[1:], len(starts))
    after_piece = np.flatnonzero(piece_ends) + 1
    lasts = np.minimum(nexts + longest - 1, after_piece[np.searchsorted(after_piece, nexts)])
    raw[ends] = np.where(piece_ends, 10, 32)
    in_word[ends] = True
    normal = raw[in_word].tobytes()
    at = np.cumsum(np.append(0, sizes + 1))
    found = [normal[i:j] for i, j in zip(at[firsts].tolist(), (at[lasts] - 1).tolist(), strict=True)]
    return found, nexts - firsts, np.searchsorted(heads, firsts, "right") - 1


def chunks(text: bytes | None, every: int = EVERY, longest: int = LONGEST) -> list[tuple[bytes, int]]:
    """The parse of a text: for each chunk its words (pieces apart by ``\\n``, words by a space) and how many it owns."""
    found, own, _ = _parse([text], every, longest)
    return list(zip(found, own.tolist(), strict=True))


def dictionary(docs: DataFrame, every: int = EVERY, longest: int = LONGEST) -> DataFrame:
    """Distinct chunks: ``lang``, ``chunk`` (binary), ``own`` (words it owns), ``times`` (in the parse of all texts)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            texts = part.column("text").to_pylist()
            share = np.cumsum([len(t or b"") for t in texts]) // AT_ONCE
            bounds = [*np.flatnonzero(np.diff(share, prepend=-1)).tolist(), len(texts)]
            for i, j in pairwise(bounds):
                found, own, of = _parse(texts[i:j], every, longest)
                langs = part.column("lang").take(pa.array(of + i))
                yield pa.RecordBatch.from_arrays([langs, pa.array(found, pa.binary()), pa.array(own, pa.int32())], ["lang", "chunk", "own"])

    plain = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text"))
    parsed = plain.mapInArrow(rows, "lang string, chunk binary, own int")
    return parsed.groupBy("lang", "chunk", "own").agg(F.count("*").alias("times"))


class _Words:
    """Words of some chunks side by side, as arrays."""

    def __init__(self, langs: list[str], chunked: list[bytes], own: np.ndarray, times: np.ndarray):
        self.text = b"\n".join(chunked)
        raw = np.frombuffer(self.text, np.uint8)
        after = np.flatnonzero((raw == 32) | (raw == 10))
        #: Where in the text each word starts and where it stops.
        self.starts, self.stops = np.append(0, after + 1), np.append(after, len(raw))
        #: Whether a piece ends with the word.
        self.ends = np.append(raw[after] == 10, True)
        begins = np.searchsorted(self.starts, np.cumsum([0, *(len(c) + 1 for c in chunked[:-1])]))
        sizes = np.diff(np.append(begins, len(self.starts)))
        #: Whether a chunk owns the word, and how often the chunk occurs.
        self.own = np.arange(len(self.starts)) - np.repeat(begins, sizes) < np.repeat(own, sizes)
        self.times = np.repeat(times, sizes)
        languages = _Numbers()
        self.lang_at = np.repeat(np.fromiter((languages[x] for x in langs), np.int64, len(langs)), sizes)
        self.langs = [*languages]
        self.hashes = _hashes(self.text, self.starts, self.stops - self.starts)
        self.lang_hashes = np.array([xxhash.xxh64_intdigest(x.encode()) for x in self.langs], np.uint64)[self.lang_at]

    def numbers(self) -> np.ndarray:
        """A number for each word, the same for the same word only."""
        numbers, words = _Numbers(), self.text.replace(b"\n", b" ").split(b" ")
        return np.fromiter((numbers[w] for w in words), np.int64, len(words))

    def word_keys(self) -> np.ndarray:
        return _mix(self.hashes ^ self.lang_hashes)

    def pair_keys(self) -> np.ndarray:
        """Key of the pair that starts at each word but the last."""
        return _mix(self.word_keys()[:-1] * _K + self.hashes[1:])

    def pairs(self) -> np.ndarray:
        """Whether the word and the next one are a pair in one piece."""
        return ~self.ends[:-1]


def _per_step(chunked: DataFrame, count: Callable[[_Words], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Run ``count`` over the dictionary, some ``STEP`` words at a time."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def some() -> Iterator[_Words]:
            parts, size = [], 0
            for part in batches:
                parts.append(part)
                size += pc.sum(part.column("own")).as_py() or 0
                if size >= STEP:
                    yield joined(parts)
                    parts, size = [], 0
            if size:
                yield joined(parts)

        def joined(parts: list[pa.RecordBatch]) -> _Words:
            whole = pa.Table.from_batches(parts)
            own, times = (whole.column(c).to_numpy().astype(np.int64) for c in ("own", "times"))
            return _Words(whole.column("lang").to_pylist(), whole.column("chunk").to_pylist(), own, times)

        for words in some():
            yield from count(words)

    return chunked.select("lang", "chunk", "own", "times").mapInArrow(rows, schema)


def _grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the keys in their order, and where in it each distinct key begins."""
    order = np.argsort(keys)
    ordered = keys[order]
    return order, np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])[:len(keys)])


def _keyed(keys: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
    """Distinct keys with the sum of their times (exact)."""
    order, heads = _grouped(keys)
    sums = np.add.reduceat(times[order], heads) if len(keys) else times
    return pa.RecordBatch.from_arrays([pa.array(keys[order[heads]].view(np.int64)), pa.array(sums)], ["key", "times"])


def _maybe_frequent(counts: DataFrame, least: int) -> np.ndarray:
    """Filter of the keys that occur ``least`` times or more."""
    frequent = counts.groupBy("key").agg(F.sum("times").alias("n")).where(F.col("n") >= least).select("key")
    return key_filter.build(written(frequent, "frequent"))


def frequent_phrases(docs: DataFrame, longest: int = LONGEST, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """``lang``, ``phrase``, ``words`` and ``f`` of the phrases of 1 to ``longest`` words that occur ``least`` times or
    more; and ``lang``, ``n`` (all its words)."""
    spark = docs.sparkSession
    chunked = written(dictionary(docs, longest=longest), "chunks")
    totals = chunked.groupBy("lang").agg(F.sum(F.col("own") * F.col("times")).alias("n"))

    def of_words(some: _Words) -> Iterator[pa.RecordBatch]:
        yield _keyed(some.word_keys()[some.own], some.times[some.own])

    words = spark.sparkContext.broadcast(_maybe_frequent(_per_step(chunked, of_words, "key long, times long"), least))

    def of_pairs(some: _Words) -> Iterator[pa.RecordBatch]:
        known = key_filter.among(some.word_keys(), words.value)
        here = some.own[:-1] & some.pairs() & known[:-1] & known[1:]
        yield _keyed(some.pair_keys()[here], some.times[:-1][here])

    pairs = spark.sparkContext.broadcast(_maybe_frequent(_per_step(chunked, of_pairs, "key long, times long"), least))

    def of_phrases(some: _Words) -> Iterator[pa.RecordBatch]:
        start = np.flatnonzero(some.own & key_filter.among(some.word_keys(), words.value))
        linked = np.append(some.pairs() & key_filter.among(some.pair_keys(), pairs.value), False)
        at = some.numbers()
        names, langs = len(at), pa.array(some.langs, pa.string())
        codes = some.lang_at[start] * names + at[start]
        for size in range(1, longest + 1):
            if size > 1:  # go on where the next pair may be frequent too
                more = linked[start + size - 2]
                start = start[more]
                codes = group[more] * names + at[start + size - 1]
            if not len(start):
                return
            order, begins = _grouped(codes)
            group = np.empty(len(order), np.int64)
            group[order] = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(order))))
            heads = start[order[begins]]
            spans = zip(some.starts[heads].tolist(), some.stops[heads + size - 1].tolist(), strict=True)
            yield pa.RecordBatch.from_arrays([
                langs.take(pa.array(some.lang_at[heads])), pa.array([some.text[i:j] for i, j in spans], pa.binary()),
                pa.array(np.full(len(heads), size, np.int32)), pa.array(np.add.reduceat(some.times[start][order], begins)),
            ], ["lang", "phrase", "words", "times"])

    found = _per_step(chunked, of_phrases, "lang string, phrase binary, words int, times long")
    counted = found.groupBy("lang", "phrase", "words").agg(F.sum("times").alias("f")).where(F.col("f") >= least)
    counted = counted.withColumn("phrase", F.col("phrase").cast("string"))
    return written(counted, "phrases"), written(totals, "totals")


def _part(first: str, size: str) -> Column:
    """``size`` words of the phrase from word ``first`` (1 is the first) on."""
    return F.array_join(F.slice(F.split("phrase", " "), F.expr(first), F.expr(size)), " ")


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, covered: int = COVERED, top: int = TOP) -> DataFrame:
    """The ``top`` phrases of each language: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``.

    ``a`` counts a phrase of 2 to ``longest`` words that occurs ``least`` times or more, overlaps included, ``n`` all words of
    the language.  Cut after its first k words it is ``l`` times the first and ``r`` times the other part; the cut of the
    lowest floor(2000000 a / (l + r)), then the smallest k, gives the score.  A phrase that lies in a longer
    one, itself dropped or not, with ``covered`` percent of its occurrences or more, is dropped.  Order: score and a
    descending, phrase ascending by UTF-8 bytes.

    Defined cases: null languages are ``und``, as that name itself is; null and empty texts and texts of separators
    alone have no words; repeated rows count again; a language without candidates has no rows; an empty table gives
    an empty table; other columns are not read.
    """
    phrases, totals = frequent_phrases(docs, longest, least)
    candidates = phrases.where("words > 1").withColumnRenamed("f", "a")
    cut = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cut = cut.withColumns({"left": _part("1", "k"), "right": _part("k + 1", "words - k")})
    for side, name in (("left", "l"), ("right", "r")):
        part = phrases.select("lang", F.col("phrase").alias(side), F.col("f").alias(name))
        cut = cut.join(part, ["lang", side])
    score = F.expr("CAST(2000000 AS DECIMAL(7, 0)) * CAST(a AS DECIMAL(19, 0)) DIV CAST(l + r AS DECIMAL(20, 0))")
    lowest = cut.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # every shorter phrase of two words or more inside a candidate, with the most that a longer one has
    inside = candidates.where("words > 2").withColumn("size", F.explode(F.sequence(F.lit(2), F.col("words") - 1)))
    inside = inside.withColumn("at", F.explode(F.sequence(F.lit(1), F.expr("words - size + 1"))))
    longer = inside.groupBy("lang", _part("at", "size").alias("phrase")).agg(F.max("a").alias("within"))
    kept = lowest.join(longer, ["lang", "phrase"], "left").where(
        F.coalesce(F.col("within").cast("decimal(19,0)") * 100 < F.col("a").cast("decimal(19,0)") * covered, F.lit(True))
    )
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"),
        "n", F.col("cut.score").alias("score"),
    )
