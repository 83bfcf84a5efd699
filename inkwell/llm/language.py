"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts the n-grams of every labelled text where it lies and adds the counts up by (language,
bucket).  The log-probability matrix (languages x ``BUCKETS``) is of fixed size whatever the corpus; it
is broadcast, and batches of texts are scored in numpy by gathering its rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hash buckets of the n-grams, and lengths of the n-grams.
BUCKETS = 1 << 15
SIZES = (2, 3)
#: Added to every count.
SMOOTHING = 0.5
#: More distinct labels than this are no set of languages; the model's size rests on it.
MAX_LANGUAGES = 512
#: n-grams that are hashed at once.
SLICE = 1 << 18

_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Which code points are letters (Unicode), by code point."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def _plain(text: str | None) -> np.ndarray:
    """Lower-case code points, each run of anything but letters as one space, a space at both ends."""
    points = np.frombuffer((" " + (text or "").lower() + " ").encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[points]
    points = np.where(letter, points, np.uint32(32))
    kept = letter.copy()
    kept[0] = True
    kept[1:] |= letter[:-1]
    return points[kept]


def _hashed(points: np.ndarray, size: int) -> np.ndarray:
    """Bucket of each n-gram of ``size`` code points."""
    n = len(points) - size + 1
    mixed = np.full(n, size, np.uint32)
    for k in range(size):
        mixed *= np.uint32(0x01000193)
        mixed ^= points[k:k + n]
    mixed *= np.uint32(0x9E3779B1)
    return mixed >> np.uint32(17)  # the upper 15 bits


def _sums(texts: list[np.ndarray], weights: np.ndarray) -> np.ndarray:
    """Sum of the rows of ``weights`` over all n-grams of each text."""
    out = np.zeros((len(texts), weights.shape[1]))
    for i, points in enumerate(texts):
        for size in SIZES:
            for at in range(0, max(0, len(points) - size + 1), SLICE):
                buckets = _hashed(points[at:at + SLICE + size - 1], size)
                out[i] += weights[buckets].sum(axis=0)
    return out


def _count(points: np.ndarray, out: np.ndarray) -> None:
    """Add the n-grams of a text to the counts by bucket."""
    for size in SIZES:
        for at in range(0, max(0, len(points) - size + 1), SLICE):
            np.add.at(out, _hashed(points[at:at + SLICE + size - 1], size), 1)


@dataclass(frozen=True)
class LanguageModel:
    """Languages (sorted), prior log-probabilities, and log-probabilities by bucket and language."""

    languages: list[str]
    prior: np.ndarray
    weights: np.ndarray

    def scores(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and posterior probability of each text."""
        plain = [_plain(t) for t in texts]
        names, probability = ["und"] * len(texts), np.zeros(len(texts))
        if not self.languages:
            return names, probability
        logs = _sums(plain, self.weights) + self.prior
        best = logs.argmax(axis=1)
        shares = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
        for i, points in enumerate(plain):
            if (points != 32).any():
                names[i], probability[i] = self.languages[best[i]], shares[i]
        return names, probability


def learn(labelled: DataFrame) -> LanguageModel:
    """Learn from columns ``text`` and ``lang``; rows where one is null and texts without letters add nothing.

    All rows count.  What reaches the driver is one number per language and bucket.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[str, np.ndarray] = {}
        texts: dict[str, int] = {}
        for part in batches:
            for lang, text in zip(part["lang"], part["text"], strict=True):
                plain = _plain(text)
                if len(plain) > 1:
                    own = counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
                    _count(plain, own)
                    texts[lang] = texts.get(lang, 0) + 1
        for lang, found in counts.items():
            buckets = np.flatnonzero(found)
            yield pd.DataFrame({
                "lang": lang, "bucket": np.append(buckets, -1).astype(np.int32), "n": np.append(found[buckets], texts[lang])
            })

    rows = labelled.select("text", "lang").where("text IS NOT NULL AND lang IS NOT NULL")
    found = rows.mapInPandas(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    distinct = rows.select("lang").distinct().limit(MAX_LANGUAGES + 1).count()
    if distinct > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} distinct labels")
    counted = found.toPandas()
    languages = sorted(counted["lang"].unique())
    counts, docs = np.full((BUCKETS, len(languages)), SMOOTHING), np.ones(len(languages))
    place = counted["lang"].map({name: i for i, name in enumerate(languages)}).to_numpy(dtype=np.int64)
    bucket, n = counted["bucket"].to_numpy(), counted["n"].to_numpy()
    real = bucket >= 0
    counts[bucket[real], place[real]] += n[real]
    docs[place[~real]] = n[~real]
    return LanguageModel(languages, np.log(docs / max(docs.sum(), 1)), np.log(counts / counts.sum(axis=0, keepdims=True)))


def predictions(docs: DataFrame, model: LanguageModel):
    """Column struct ``lang_pred``, ``score`` for the column ``text`` of ``docs``, row-local.

    A filter on it is not pushed below it: texts would be predicted twice, by two Python workers of every task.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            names, score = [], []
            for at in range(0, len(texts), 32):
                some, probability = shared.value.scores(list(texts.iloc[at:at + 32]))
                names += some
                score += probability.tolist()
            yield pd.DataFrame({"lang_pred": names, "score": score})

    return F.pandas_udf(predict, "lang_pred string, score double").asNondeterministic()("text")


def held_out():
    """Whether a row is kept from training: crc32 of its doc_id as text leaves 1 when divided by 3 (null id: no)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """Language of every document: ``doc_id``, ``held_out``, ``lang_pred``, ``score``.

    Learns from ``text`` and ``lang`` of the rows that are not held out, then predicts for every row from
    its whole text alone.  Defined cases: null texts and texts without a letter give ``und`` and 0, so does
    any text when nothing could be learned; ties go to the first language by code point; repeated rows stay
    repeated (and count as often in training); an empty table gives an empty table; other columns are not read.
    """
    plain = docs.select("doc_id", held_out().alias("held_out"), "text", "lang")
    model = learn(plain.where(~F.col("held_out")))
    found = plain.select("doc_id", "held_out", predictions(plain, model).alias("p"))
    return found.select(F.col("doc_id").cast("long"), "held_out", "p.lang_pred", "p.score")


def with_known_language(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents whose language is found with a probability of ``least`` or more; the others go.

    All columns are kept as they are, but a null ``lang`` becomes the language found.
    """
    from inkwell.llm.common import free_name

    mark = free_name(docs, "inkwell_language")
    model = learn(docs.where(~held_out()).select("text", "lang"))
    marked = docs.withColumn(mark, predictions(docs, model))
    kept = marked.where((F.col(f"{mark}.lang_pred") != "und") & (F.col(f"{mark}.score") >= least))
    return kept.withColumn("lang", F.coalesce("lang", f"{mark}.lang_pred")).select(*docs.columns)
