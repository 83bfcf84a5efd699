"""From documents to token digests: language, near-duplicates, personal data, mixture, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkwell.llm import bpe, language, minhash, mixing, surrogates
from inkwell.llm.common import bounded_batches, table, written
from inkwell.llm.queries import surrogate_key, tokenizer_path


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; a null ``lang`` is filled in."""
    bounded_batches(spark)
    return language.with_known_language(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: 5-word shingles of Jaccard 0.8 or more, in chains.

    Candidates come from the SimHash index of ``op6`` and, for copies that its 4 bits miss, from MinHash bands.
    """
    bounded_batches(spark)
    return minhash.one_of_each(docs)


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with surrogates in place of personal data."""
    bounded_batches(spark)
    return surrogates.pseudonymise(docs, surrogate_key(spark))


def mixture_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, each as often as it is taken."""
    bounded_batches(spark)
    return mixing.mixed(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the tokens of every document of the mix."""
    bounded_batches(spark)
    return bpe.encode(docs, tokenizer_path(spark))


STAGES = [
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("personal_data", personal_data_stage),
    ("mixture", mixture_stage),
    ("tokens", token_stage),
]

#: Trained models, fingerprints and keyed digests are beyond SQL; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder before the next stage reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
