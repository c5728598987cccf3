"""The registered queries: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bloom_lm, chat_format, decontaminate, jaccard, kneser_ney, language_id, mixing, quality_rules, token_histogram, url_reputation


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


URL_RULES = tuple(
    url_reputation.UrlRule(verdict, rule)
    for verdict, rule in (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
)


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels")
    good = labels.select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good"))
    good = good.where(labels["quality"].isNotNull() & labels["toxic"].isNotNull())
    return url_reputation.judge(_table(spark, sf_dir, "pages").select("page_id", "url"), good, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similarity_classes(_table(spark, sf_dir, "documents"), width=4, percent=85)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held = language_id.held_out(F.col("doc_id"))
    texts = docs.select("doc_id", "text", held.alias("held_out"))
    # rows of a null id have no remainder: they do not teach
    teach = docs.where(F.col("doc_id").isNotNull() & ~held).select("text", "lang")
    return language_id.identify(texts, teach).select("doc_id", "held_out", "lang_pred", "score")


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.item_digest(decontaminate.contamination(docs, _table(spark, sf_dir, "benchmark"), width=8))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.apply_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"), weights=(5, 2, 1), most_copies=3).select("doc_id", "size", "source_size", "target", "taken")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = _table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0")
    return kneser_ney.classify(_table(spark, sf_dir, "documents"), trusted).select("doc_id", "perplexity", "threshold", "kept")


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    rest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10
    held = F.coalesce(rest == 0, F.lit(False))
    return bloom_lm.score(docs.withColumn("held_out", held), docs.where(rest != 0)).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chat_format.canonical(_table(spark, sf_dir, "conversations"))
    return out.select("conv_id", "turn", F.array_join(F.transform("messages", lambda m: m["role"]), ",").alias("roles"), F.size("messages").cast("long").alias("n_messages"), "rendered")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = token_histogram.token_lengths(_table(spark, sf_dir, "documents").select("text"), TOKENIZER)
    return token_histogram.length_histogram(lengths)


#: A tiktoken ranks file; TOKENIZER_RANKS names another.
TOKENIZER = os.environ.get("TOKENIZER_RANKS", "/opt/tokenizers/byte_bpe_50k.tiktoken")

QUERIES = {
    f.__name__: f
    for f in (
        op1_url_filters,
        op2_ngram_jaccard_join,
        op3_language_id,
        op4_benchmark_decontamination,
        op5_quality_rules,
        op6_mixing_sources,
        op7_quality_classifier,
        op8_lm_scoring,
        op9_chat_formatting,
        op10_token_counts,
    )
}
SQL: dict[str, str] = {
    "op1_url_filters": url_reputation.sql(URL_RULES),
    "op2_ngram_jaccard_join": jaccard.SQL,
    "op4_benchmark_decontamination": decontaminate.SQL,
    "op5_quality_rules": quality_rules.SQL,
    "op6_mixing_sources": mixing.SQL,
}
