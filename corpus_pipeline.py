"""A training-data pipeline: each stage works on all documents that the one before it kept.

Language identification drops documents without letters; near-duplicate groups keep one document;
documents that hold a benchmark item are dropped; secrets are masked in the text of the others; the
last stage encodes what is left. Every stage is written as Parquet to the shared checkpoint folder and
read again by the next.

In every stage a null text counts as the empty text, texts of any length are taken whole, an empty table gives an
empty one, and columns beyond those of documents come through untouched, whatever their names (but for
the last stage, which returns its own columns).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tallybridge.llm import bpe, decontaminate, langid, neardup, secrets
from tallybridge.llm.common import shared_folder, table
from tallybridge.llm.registry import tokenizer_file


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those without a label get the predicted one.

    Null and empty texts and texts without letters go. Rows that repeat stay or go together; a null
    doc_id is kept, but is no example to learn from. Of languages with equal likelihood the first by name is given.
    """
    vocabulary = tokenizer_file("piece_bpe_32k.model")
    model = langid.train(docs.filter(langid.fold() != 2), vocabulary)
    return langid.keep_identified(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies: five words, similarity 0.8.

    First is the smallest doc_id; rows without one are documents of their own, after all others. Null, empty and
    short texts are no copies of anything, and stay; of repeated rows one stays.
    """
    return neardup.first_of_groups(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark item, by word edits of at most a fifth of the item.

    Each row is judged by its own text, so repeated rows stay or go together; null and empty texts stay, as
    do all rows if the benchmark is empty; null and empty items match nothing.
    """
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; each secret found is replaced by a mark, and n_chars follows.

    Null texts stay null; overlapping findings are one; repeated rows are masked alike.
    """
    return secrets.mask(docs, secrets.train(docs))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each document's ids and decoded text; a row for each row, repeated or without doc_id."""
    return bpe.digests(bpe.bpe_encode(docs, tokenizer_file("word_bpe_49k.json")))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("bpe", encoding),
]

#: SQL cannot express a trained model or a tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = f"{base}/{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
