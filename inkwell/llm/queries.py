"""The registered queries of the subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm import (
    alignment,
    bpe,
    collocations,
    embedding_dedup,
    language,
    line_dedup,
    mixing,
    neighbours,
    quality,
    secrets,
    simhash,
    surrogates,
    url_filter,
)
from inkwell.llm.common import bounded_batches, table

#: Key of the surrogates unless the session sets ``spark.inkwell.surrogateKey``.
DEFAULT_KEY = "inkwell"


def surrogate_key(spark: SparkSession) -> str:
    return spark.conf.get("spark.inkwell.surrogateKey", DEFAULT_KEY)


def _public_file(spark: SparkSession, setting: str, name: str) -> str:
    path = spark.conf.get(setting, None)
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(name)
    return path


def tokenizer_path(spark: SparkSession) -> str:
    """Tokenizer file: ``spark.inkwell.tokenizer``, or the public byte-level vocabulary that is installed."""
    return _public_file(spark, "spark.inkwell.tokenizer", "byte_bpe_50k.json")


def piece_model_path(spark: SparkSession) -> str:
    """Sentencepiece model: ``spark.inkwell.pieceModel``, or the public one that is installed."""
    return _public_file(spark, "spark.inkwell.pieceModel", "piece_bpe_32k.model")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.surrogate_texts(table(spark, sf_dir, "documents"), surrogate_key(spark))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(table(spark, sf_dir, "documents"))


def op5_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.where("vec_id % 100 = 0"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


#: The rules of the URL query as (host, path, verdict).
URL_RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    judged = url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return judged.select(F.col("page_id").cast("long"), "host", "path", "rule", "verdict")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), tokenizer_path(spark))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned(table(spark, sf_dir, "documents"), tokenizer_path(spark), piece_model_path(spark))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digests(table(spark, sf_dir, "documents"))


def _bounded(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        bounded_batches(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {f.__name__: _bounded(f) for f in (
    op1_embedding_dedup, op2_surrogates, op3_quality, op4_secrets, op5_pareto_mix, op6_simhash, op7_neighbours,
    op8_language, op9_url_filter, op10_bpe, op11_collocations,
    op12_alignment, op13_line_dedup,
)}
