"""Quality classifier from weak labels.

Overlapping heuristics vote on every document: good, bad, or no opinion.  Their accuracies are estimated
without any true label by expectation-maximisation over the table of vote patterns.  That table has at most
3 ** len(LABELLERS) rows however many documents there are, and every document is counted in it.  The posterior
of a document's pattern is its label; a linear scorer over hashed words and shapes is trained on the posteriors
of a bounded sample (``SAMPLE`` documents) and scores every document from its whole text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import written

#: Buckets of the hashed features, and documents that the linear scorer is trained on.
BUCKETS, SAMPLE = 1 << 14, 8_000
#: Value of a graded fact's feature; a text's words together have length 1.
FACT_VALUE = 0.3
#: Rounds of expectation-maximisation, and what is added to its counts.
ROUNDS, SMOOTHING = 200, 1.0
#: Passes, batch, step and shrinking of the linear scorer.
PASSES, BATCH, STEP, SHRINK = 12, 64, 0.5, 1e-5
#: Words of a text that a worker turns into features at once.
CHUNK = 1 << 16

#: Facts of a text that the heuristics look at, as columns of ``facts``.
_FACTS = "words long, distinct long, letters long, symbols long, longest_run long, bars long, mean_word double, ended double"


def _facts_of(text: str | None) -> tuple:
    words = (text or "").split()
    n = len(words)
    if not n:
        return 0, 0, 0, 0, 0, 0, 0.0, 0.0
    body = "".join(words)
    letters = sum(map(len, _LETTER_RUNS(body)))
    symbols = sum(map(len, _SYMBOL_RUNS(body)))
    run = longest = 1
    for one, two in zip(words, words[1:]):
        run = run + 1 if one == two else 1
        longest = max(longest, run)
    ended = sum(1 for w in words if w[-1] in ".!?") / n
    return n, len(set(words)), letters, symbols, longest, words.count("|"), len(body) / n, ended


_LETTER_RUNS = re.compile(r"[^\W\d_]+").findall
_SYMBOL_RUNS = re.compile(r"[^\w\s.,;:'’\"()?-]+").findall


def labellers() -> dict[str, Column]:
    """The heuristics: 1 good, 0 bad, null no opinion; from the columns of ``facts``."""
    f = F.col
    body = f("words") * f("mean_word")
    share = lambda x: F.try_divide(f(x).cast("double"), body)
    per_word = lambda x: F.try_divide(f(x).cast("double"), f("words"))

    def vote(bad: Column, good: Column) -> Column:
        return F.when(f("words") == 0, 0).when(bad, 0).when(good, 1)

    return {
        "symbols": vote(share("symbols") > 0.1, share("symbols") < 0.02),
        "letters": vote(share("letters") < 0.7, share("letters") > 0.9),
        "repeats": vote(f("longest_run") >= 8, f("longest_run") <= 2),
        "variety": vote((f("words") >= 50) & (per_word("distinct") < 0.2), (f("words") >= 20) & (per_word("distinct") > 0.35)),
        "table": vote(per_word("bars") > 0.15, per_word("bars") == 0),
        "length": vote(f("words") < 5, f("words") >= 40),
        "word_length": vote((f("mean_word") > 12) | (f("mean_word") < 2.5), f("mean_word").between(3.5, 9)),
        "sentences": vote((f("words") >= 40) & (f("ended") < 0.005), f("ended").between(0.02, 0.4)),
    }


def facts(docs: DataFrame) -> DataFrame:
    """A digest ``h`` of id and text, and the facts of the text, of every document."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in _FACTS.split(", ")]
        for part in batches:
            made = pd.DataFrame([_facts_of(t) for t in part["text"]], columns=names)
            made.insert(0, "h", part["h"].to_numpy())
            yield made

    plain = docs.select(F.xxhash64("doc_id", "text").alias("h"), "text")
    return plain.mapInPandas(rows, f"h long, {_FACTS}")


def fit_labellers(votes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of good for each vote pattern, and each labeller's accuracy (rows: bad, good documents).

    votes: patterns x labellers of 1, 0 and -1 (no opinion); counts: documents of each pattern.  Starts from the
    majority vote, so that class 1 is the one that the labellers call good.
    """
    if not len(votes):
        return np.zeros(0), np.full((2, votes.shape[1]), 0.5)
    given = votes >= 0
    ones = (votes == 1).astype(float)
    share = np.where(given.any(axis=1), ones.sum(axis=1) / np.maximum(given.sum(axis=1), 1), 0.5)
    posterior = 0.1 + 0.8 * share
    accuracy = np.full((2, votes.shape[1]), 0.5)
    for _ in range(ROUNDS):
        weights = np.stack([(1 - posterior) * counts, posterior * counts])
        prior = (weights.sum(axis=1) + SMOOTHING) / (counts.sum() + 2 * SMOOTHING)
        says_one = (weights @ ones + SMOOTHING) / (weights @ given.astype(float) + 2 * SMOOTHING)
        accuracy = np.stack([1 - says_one[0], says_one[1]])
        logs = np.log(prior)[:, None] + np.log(says_one) @ ones.T + np.log(1 - says_one) @ (given & (votes == 0)).T
        new = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))
        if np.abs(new - posterior).max() < 1e-9:
            posterior = new
            break
        posterior = new
    return posterior, accuracy


def _grades(facts: tuple) -> list[str]:
    """Facts of a text in coarse steps, as names of features."""
    n, distinct, letters, symbols, longest, bars, mean_word, ended = facts
    body = max(1.0, n * mean_word)
    return [
        f"words {min(n.bit_length(), 12)}", f"variety {int(10 * distinct / max(1, n))}", f"run {min(longest.bit_length(), 6)}",
        f"letters {int(20 * letters / body)}", f"symbols {min(10, int(50 * symbols / body))}",
        f"bars {min(10, int(20 * bars / max(1, n)))}", f"mean {int(min(mean_word, 20))}", f"ended {int(20 * ended)}",
    ]


class Features:
    """Hashed features of a text: words and their shapes (log counts, scaled to length 1), and its graded facts."""

    def __init__(self):
        self.known: dict[str, tuple[int, int]] = {}

    def _buckets(self, word: str) -> tuple[int, int]:
        shape = "".join(
            dict.fromkeys("a" if c.isalpha() else "9" if c.isdigit() else c for c in word)
        ) + f"/{min(len(word), 20)}"
        found = zlib.crc32(word.lower().encode()) % BUCKETS, zlib.crc32(b"shape:" + shape.encode()) % BUCKETS
        if len(self.known) >= 500_000:
            self.known.clear()  # a memory of work done, nothing else
        self.known[word] = found
        return found

    def of(self, text: str | None, facts: tuple) -> tuple[np.ndarray, np.ndarray]:
        words = (text or "").split()
        total: dict[int, int] = {}
        for at in range(0, len(words), CHUNK):
            known, make = self.known, self._buckets
            both = np.array([known.get(w) or make(w) for w in words[at:at + CHUNK]], np.int64).reshape(-1)
            places, counts = np.unique(both, return_counts=True)
            for place, count in zip(places.tolist(), counts.tolist(), strict=True):
                total[place] = total.get(place, 0) + count
        places = np.fromiter(total, np.int64, len(total))
        values = np.log1p(np.fromiter(total.values(), float, len(total)))
        values /= max(np.sqrt((values**2).sum()), 1e-12)
        graded = [zlib.crc32(f"fact:{g}".encode()) % BUCKETS for g in _grades(facts)]
        return np.append(places, np.array(graded, np.int64)), np.append(values, np.full(len(graded), FACT_VALUE))


_FEATURES: list[Features] = []


def _features() -> Features:
    if not _FEATURES:
        _FEATURES.append(Features())
    return _FEATURES[0]


def fit_linear(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> np.ndarray:
    """Logistic regression on soft labels by averaged mini-batch descent; the last weight is the constant."""
    weights, mean = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    rng, steps = np.random.default_rng(11), 0
    for turn in range(PASSES):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), BATCH):
            some = order[at:at + BATCH]
            places = np.concatenate([rows[i][0] for i in some])
            values = np.concatenate([rows[i][1] for i in some])
            of = np.repeat(np.arange(len(some)), [len(rows[i][0]) for i in some])
            margin = np.bincount(of, weights[places] * values, len(some)) + weights[-1]
            error = labels[some] - 1 / (1 + np.exp(-np.clip(margin, -40, 40)))
            rate = STEP * 20 / (1 + turn)
            weights[:-1] *= 1 - SHRINK * rate
            np.add.at(weights, places, rate * error[of] * values / len(some))
            weights[-1] += 0.1 * rate * error.mean()
            if turn >= PASSES // 2:
                steps += 1
                mean += (weights - mean) / steps
    return mean if steps else weights


def classify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id``, ``posterior`` (of the votes), ``score`` (of the scorer, 0 to 1) and ``kept`` (score 0.5 or more).

    sample: distinct documents that the scorer is trained on, those with the smallest digest of id and text.

    Defined cases: null and empty texts get votes for bad alone and the score 0; repeated rows stay repeated; ties of
    the posterior are 0.5; where all documents vote alike the scorer learns that one answer; an empty table gives an
    empty table; other columns are not read.
    """
    spark = docs.sparkSession
    names = list(labellers())
    voted = facts(docs).select("h", *(c.cast("int").alias(n) for n, c in labellers().items()))
    voted = written(voted, "votes")
    patterns = voted.groupBy(*names).count().toPandas()  # at most 3 ** len(names) rows
    votes = patterns[names].fillna(-1).to_numpy(np.int64)
    posterior, _ = fit_labellers(votes, patterns["count"].to_numpy(float))
    by_pattern = {",".join(map(str, v)): float(p) for v, p in zip(votes.tolist(), posterior, strict=True)}
    pairs = [F.lit(x) for pair in by_pattern.items() for x in pair]
    table = F.create_map(*pairs) if pairs else F.lit(None).cast("map<string,double>")

    def label(votes_of: dict[str, Column]) -> Column:
        return table[F.concat_ws(",", *(F.coalesce(c.cast("int"), F.lit(-1)) for c in votes_of.values()))]

    distinct = voted.dropDuplicates(["h"])  # a document that is repeated counts once
    chosen = distinct.select("h", label({n: F.col(n) for n in names}).alias("posterior")).orderBy("h").limit(sample).toPandas()
    plain = docs.select(F.col("doc_id").cast("long"), F.xxhash64("doc_id", "text").alias("h"), "text")
    edge = int(chosen["h"].max()) if len(chosen) else -(1 << 63)

    def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            made = [_features().of(t, _facts_of(t)) for t in part["text"]]
            places = [p.astype(np.uint16).tobytes() for p, _ in made]
            yield pd.DataFrame({"h": part["h"], "places": places, "values": [v.astype(np.float32).tobytes() for _, v in made]})

    rows = plain.where(F.col("h") <= F.lit(edge)).mapInPandas(featured, "h long, places binary, values binary")
    gathered = rows.dropDuplicates(["h"]).toPandas().sort_values("h")  # the sample's features
    label_of = dict(zip(chosen["h"], chosen["posterior"], strict=True))
    examples = [
        (np.frombuffer(p, np.uint16), np.frombuffer(v, np.float32))
        for p, v in zip(gathered["places"], gathered["values"], strict=True)
    ]
    weights = spark.sparkContext.broadcast(fit_linear(examples, np.array([label_of[h] for h in gathered["h"]])))
    fact_names = [x.split()[0] for x in _FACTS.split(", ")]

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = weights.value
        for part in batches:
            found, out = [], []
            for text in part["text"]:
                own = _facts_of(text)
                places, values = _features().of(text, own)
                margin = float(w[places] @ values + w[-1])
                found.append(own)
                out.append(1 / (1 + np.exp(-np.clip(margin, -40, 40))) if own[0] else 0.0)
            made = pd.DataFrame(found, columns=fact_names)
            made.insert(0, "doc_id", part["doc_id"].astype("Int64").to_numpy(dtype=object))
            yield made.assign(score=out)

    scored = plain.select("doc_id", "text").mapInPandas(score, f"doc_id long, {_FACTS}, score double")
    return scored.select("doc_id", label(labellers()).alias("posterior"), "score", (F.col("score") >= 0.5).alias("kept"))
