"""The queries of this subpackage, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, fim, langid, licenses, neardup, passages, quality, secrets, spelling, suffixes, tokencount, vafile
from .common import table


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(licenses.scan_licenses(table(spark, sf_dir, "documents")))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.digests(secrets.scan_secrets(docs, secrets.train(docs)))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vafile.neighbours(table(spark, sf_dir, "embeddings"))


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digests(suffixes.remove_repeats(table(spark, sf_dir, "documents")))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    separator = 50256
    blocks = tokencount.token_stream(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, separator)
    return tokencount.count_documents(blocks, separator).select("doc_id", "n_tokens")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.identify(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.bpe_encode(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json")))


def op9_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.near_passages(table(spark, sf_dir, "documents"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), width=4)


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.report(table(spark, sf_dir, "documents"))


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(fim.fill_in_middle(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_licenses": op1_licenses,
    "op2_secrets": op2_secrets,
    "op3_decontaminate": op3_decontaminate,
    "op4_top_k": op4_top_k,
    "op5_repeats": op5_repeats,
    "op6_token_counts": op6_token_counts,
    "op7_language": op7_language,
    "op8_bpe": op8_bpe,
    "op9_passages": op9_passages,
    "op10_near_duplicates": op10_near_duplicates,
    "op11_spelling": op11_spelling,
    "op12_quality": op12_quality,
    "op13_fill_in_middle": op13_fill_in_middle,
}

ORACLE_SQL: dict[str, str] = {
    "op4_top_k": vafile.SQL,
    "op10_near_duplicates": neardup.SQL,
    "op11_spelling": spelling.SQL,
    "op13_fill_in_middle": fim.SQL,
}
