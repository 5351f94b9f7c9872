"""Queries of the training-data operators: ``QUERIES`` by name, ``ORACLES`` for those that SQL expresses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodemill.llm import mixing, topk_search, url_filter
from lodemill.llm.common import read


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodemill.llm.html_text import extract

    return extract(read(spark, sf_dir, "pages"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodemill.llm.token_files import token_digest

    return token_digest(spark, read(spark, sf_dir, "documents"), vocabulary(), end_id=0)


def op3_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodemill.llm.line_crf import quality

    return quality(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodemill.llm.near_duplicates import near_duplicates

    return near_duplicates(read(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodemill.llm.mixing import mix

    return mix(read(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodemill.llm.url_filter import filter_urls

    return filter_urls(read(spark, sf_dir, "pages"))


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodemill.llm.topk_search import top_k

    return top_k(read(spark, sf_dir, "embeddings"))


def op8_phrase_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodemill.llm.phrase_prints import fingerprint_documents

    return fingerprint_documents(read(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodemill.llm.zstd_toxicity import toxicity

    return toxicity(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodemill.llm.bpe_trie import bpe_round_trip

    return bpe_round_trip(read(spark, sf_dir, "documents"), vocabulary())


QUERIES = {f.__name__: f for f in (op1_html_text, op2_token_files, op3_line_quality, op4_near_duplicates, op5_mixing, op6_url_filter, op7_top_k, op8_phrase_prints, op9_toxicity, op10_bpe_trie)}

ORACLES: dict[str, str] = {"op5_mixing": mixing.oracle(), "op6_url_filter": url_filter.oracle(), "op7_top_k": topk_search.oracle()}
