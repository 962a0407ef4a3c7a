"""Registered queries of the training-data operators and their SQL.

Each query is thin: it reads the whole table, applies one operator with production parameters and
derives the digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.llm import (
    licences, lm_mixing, mixing, near_dups, pieces, quality_classifier, quality_rules, rank_bpe,
    token_blocks, topk, variants, warc, whitening,
)
from lexispark.llm.common import crc_fold
from lexispark.sources.tables import table


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op2_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = warc.write_archives(table(spark, sf_dir, "pages", "page_id", "url", "html"))
    return warc.read_archives(files).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    scored = quality_classifier.classify(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", (crc_fold(F.col("doc_id")) == 0).alias("held_out"), "score",
                         "predicted")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text, and whether they decode to it (blanks for U+2581, as the model has it)."""
    coded = pieces.encode(table(spark, sf_dir, "documents", "doc_id", "text"), decoded=True)
    plain = F.regexp_replace(F.coalesce("text", F.lit("")), pieces.BLANK, " ")
    return coded.select("doc_id", "n_tokens", "ids", (F.col("decoded") == plain).alias("round_trip"))


def op5_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_mixing.score_texts(table(spark, sf_dir, "documents", "doc_id", "text"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text")).select(
        "doc_id", "class_id", "kept")


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings", "vec_id", "embedding").select(
        F.col("vec_id").alias("id"), topk.quantised(F.col("embedding"), 64.0).alias("v"))
    return topk.top_k(rows, rows.filter("id % 20 = 0"), 20)


def op8_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(table(spark, sf_dir, "documents", "doc_id", "text")).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op9_adaptive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.adaptive_quality(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept")


def op10_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_blocks.read_tokens(token_blocks.write_tokens(
        table(spark, sf_dir, "documents", "doc_id", "text")))


def op11_rank_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_bpe.digests(rank_bpe.encode(
        table(spark, sf_dir, "documents", "doc_id", "text"), decoded=True))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(table(spark, sf_dir, "documents", "doc_id", "text"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.components_long(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


QUERIES = {f.__name__: f for f in (
    op1_mix_sources, op2_warc_archives, op3_quality_classifier, op4_sentencepiece,
    op5_context_mixing, op6_near_duplicates, op7_exact_top_k, op8_licence_scan,
    op9_adaptive_quality, op10_token_blocks, op11_rank_bpe, op12_spelling_variants,
    op13_whitening)}
ORACLES = {"op1_mix_sources": mixing.MIX_SQL, "op2_warc_archives": warc.WARC_SQL,
           "op7_exact_top_k": topk.TOPK_SQL, "op8_licence_scan": licences.licence_sql(),
           "op9_adaptive_quality": quality_rules.QUALITY_SQL,
           "op12_spelling_variants": variants.VARIANTS_SQL}
