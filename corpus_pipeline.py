"""Corpus pipeline over ``documents``: quality, toxicity, near-duplicates, mixing, token ids.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written and
read again as the next one's docs.  All but the last keep the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodemill.llm import bpe_trie, line_crf, mixing, near_duplicates, zstd_toxicity
from lodemill.llm.common import Scratch, read
from lodemill.llm.queries import vocabulary


#: Texts go to Python in batches of this size, not in 10,000 rows at once, which the JVM and the worker hold several times over.
BATCH = "4m"


def batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line CRF scores 0.5 or more; it learns from ``documents`` and ``labels`` of ``sf_dir``.

    Null, empty and blank texts score 1/2 at most times the model's slant, and stay or go by that; very long texts are
    scored whole; repeated rows score alike; an empty table stays empty; other columns pass through, whatever their
    names.
    """
    batches(spark)
    model = line_crf.fit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return line_crf.good_documents(docs, model)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose compression distance scores below 0.3.

    Null, empty and blank texts score 0 and stay; every window of a very long text counts; repeated rows score alike;
    an empty table stays empty; other columns pass through, whatever their names.
    """
    batches(spark)
    model = zstd_toxicity.fit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return zstd_toxicity.clean_documents(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id.

    Null, empty and blank texts and rows without doc_id are duplicates of nothing and stay; rows of one doc_id are one
    document; an empty table stays empty; other columns pass through, whatever their names.
    """
    batches(spark)
    return near_duplicates.distinct_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; their quality weights come from the texts, as stages pass no scores on.

    Null source is a source; null and empty texts have no words and are taken as often as their source has epochs;
    repeated rows are taken alike; an empty table stays empty; other columns pass through, whatever their names.
    """
    batches(spark)
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids) of each row: its token ids with digests of them and of the text they decode to.

    Null and empty texts have no ids; copies, which the mix puts side by side, are encoded once; an empty table stays
    empty; other columns are not read.
    """
    batches(spark)
    rows = bpe_trie.encode_documents(docs, vocabulary())
    return bpe_trie.digests(rows, "ids")


STAGES = [("quality", quality), ("toxicity", toxicity), ("near_dedup", near_dedup), ("mix_sources", mix_sources), ("encode", encode)]

#: SQL expresses neither the models nor the components.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage.  A stage's own intermediate tables, and its input, go once its result is written."""
    scratch, docs = Scratch(spark, "pipeline"), read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        mark = Scratch.mark()
        after = scratch.save(stage(spark, docs, sf_dir), name)
        Scratch.sweep(mark)
        if k:
            scratch.drop(docs)
        docs = after
    return docs
