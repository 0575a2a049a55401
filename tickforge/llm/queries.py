"""Queries of the text operators over the given tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, factorisation, huffman, jaccard, langid, oracles, quality, separator_scan, sharding, spelling, url_rules, warc, whitening

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of the 49k-word vocabulary; <|endoftext|> ends a document."""
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        tokens = separator_scan.LibraryTokens(f.read(), end_id=49407)
    return separator_scan.token_counts(_table(spark, sf_dir, "documents"), tokens)


def op1_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return separator_scan.token_counts(_table(spark, sf_dir, "documents"))


def op2_huffman_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = huffman.write_files(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return huffman.summary(spark, path)


def op3_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.inventory(warc.archive(_table(spark, sf_dir, "pages")))


def op4_distribution_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_aho_corasick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(_table(spark, sf_dir, "documents"))


def op7_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.learn(docs))
    return found.select("doc_id", langid.held_out(found["doc_id"]).alias("held_out"), "lang_pred", "score")


def op8_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = sharding.stratified_shards(_table(spark, sf_dir, "documents"), n_shards=8)
    return shards.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op9_bpe_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.digests(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge_urls(_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op11_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    machine = factorisation.learn(docs, _table(spark, sf_dir, "labels"), metadata=("n_chars",))
    found = factorisation.score(docs, machine)
    return found.select("doc_id", factorisation.held_out(found["doc_id"]).alias("held_out"), "score", (found["score"] >= 0.7).cast("int").alias("predicted"))


def op12_spectrum_slicing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"), wanted=4)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variant_groups(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_token_scan": op1_token_scan,
    "op1_separator_scan": op1_separator_scan,
    "op2_huffman_tokens": op2_huffman_tokens,
    "op3_warc_chunks": op3_warc_chunks,
    "op4_distribution_divergence": op4_distribution_divergence,
    "op5_aho_corasick": op5_aho_corasick,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_byte_cnn": op7_byte_cnn,
    "op8_stratified_shards": op8_stratified_shards,
    "op9_bpe_matrix": op9_bpe_matrix,
    "op10_url_rules": op10_url_rules,
    "op11_factorisation_machine": op11_factorisation_machine,
    "op12_spectrum_slicing": op12_spectrum_slicing,
    "op13_spelling_variants": op13_spelling_variants,
}
ORACLES: dict[str, str] = oracles.ORACLES
