"""From raw documents to token ids: five stages, each an operator of procyon.llm over all that its predecessor kept.

A stage takes (spark, docs, sf_dir), docs with the columns of `documents`, and returns a DataFrame; all but the last
return those columns again. Its result is written as Parquet in the shared folder and read back for the next stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procyon.llm import bpe, mixing, ngram_jaccard, secrets, toxicity
from procyon.llm.common import save, scratch, table
from procyon.llm.queries import symbol_quality, word_bpe

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier, trained on the labelled ones of docs, scores below 0.3."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs.select(*COLUMNS), model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: five-word shingles, similarity 0.8 or more."""
    return ngram_jaccard.keep_one(docs.select(*COLUMNS))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each found secret replaced by its kind in brackets; n_chars as it is then."""
    return secrets.redact(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as the mix takes them, up to twice each."""
    return mixing.mix(docs.select(*COLUMNS), symbol_quality())


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of each row."""
    return bpe.token_lists(docs, word_bpe())


STAGES = [("toxicity", drop_toxic), ("near_copies", drop_near_copies), ("secrets", redact_secrets), ("mixing", mix_sources), ("bpe", encode)]

#: No SQL: the classifier and the tokenizer cannot be expressed in it. tests/llm hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage saved on its way is deleted when its result is written."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        with scratch(spark):
            docs = save(stage(spark, docs, sf_dir), keep=True)
    return docs
