"""Corpus pipeline: language, quality, near-duplicates, benchmark passages, mixture.

Each stage takes (spark, docs, sf_dir) and works on everything its predecessor kept; all but the last
return the columns of ``docs``. Between stages the documents are written as Parquet and read again.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import decontaminate, jaccard, language_id, mixing, quality_rules
from granary.llm.scratch import measured, stored

#: A document whose language stays in doubt goes.
MIN_LANGUAGE_SCORE = 0.4
#: All rules, but a long document is not dropped for its length.
RULES = tuple(replace(r, high=None) if r.name == "length" else r for r in quality_rules.RULES)
#: Holds all but the text of a row while an operator adds columns beside it, so that no name can clash.
_ROW = "granary_row"


def _packed(docs: DataFrame) -> DataFrame:
    """The text of each row of ``docs``, and its other columns in one."""
    return docs.select("text", F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias(_ROW))


def _unpacked(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """``rows`` of _packed() with the columns of ``docs``."""
    return rows.select(*(F.col("text") if c == "text" else F.col(f"{_ROW}.`{c}`") for c in docs.columns))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is told with some confidence; ``und`` goes.

    A null or empty text, or one without a letter, goes. Equal texts are decided alike, so repeated rows
    stay or go together. A null id or label does not teach but is judged as any other. No rows give no
    rows. All columns of ``docs`` keep their values, whatever their names.
    """
    teach = docs.where(F.col("doc_id").isNotNull() & ~language_id.held_out(F.col("doc_id"))).select("text", "lang")
    found = language_id.identify(_packed(docs), teach)
    return _unpacked(found.where((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= MIN_LANGUAGE_SCORE)), docs)


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that pass every rule; length has no upper bound here.

    Each row is decided by its text alone: repeated rows stay or go together, null and empty texts go.
    No rows give no rows. All columns of ``docs`` keep their values, whatever their names.
    """
    return _unpacked(quality_rules.apply_rules(_packed(docs), RULES).where("kept"), docs)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of linked documents (five words, similarity 0.8) the row of the smallest id.

    Rows are decided one by one: rows of one id can belong to several groups. A null id comes after all
    others; rows of one id in a group go by xxhash64 of the text, and of rows equal in both the one whose
    columns hash lowest stays. Rows that link with none stay, as do null and blank texts, repeated or
    not. All columns of ``docs`` keep their values, whatever their names.
    """
    found = jaccard.similarity_classes(docs, width=5, percent=80, keys=True).where("leads is not null")
    rows = found.groupBy(F.col("doc_id").alias("id_"), F.col("text_hash").alias("hash_")).agg(F.first("leads").alias("leads_"), F.count("*").alias("n_"))
    marks, some = measured(rows.where("not leads_ or n_ > 1"), "marks", F.count_if("leads_").alias("n"))
    # as many marks as there are copies: shuffled at every size
    packed = _packed(docs).withColumns({"id": F.col(f"{_ROW}.doc_id"), "hash": F.xxhash64("text")})
    at = lambda m: packed["id"].eqNullSafe(m["id_"]) & (packed["hash"] == m["hash_"])
    marks = marks.hint("shuffle_hash")
    out = packed.join(marks, at(marks), "left_anti").select("text", _ROW)
    if some["n"]:
        leading = marks.where("leads_")
        again = packed.join(leading, at(leading), "left_semi")
        first = F.min_by(F.struct("text", _ROW), F.xxhash64(_ROW)).alias("first")
        out = out.unionByName(again.groupBy("id", "hash").agg(first).select("first.*"))
    return _unpacked(out, docs)


def remove_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops every document in which a window of any benchmark item occurs: one whole item is a leak.

    Each row is decided by its text alone: repeated rows stay or go together, null and empty texts stay.
    An empty benchmark drops nothing. All columns of ``docs`` keep their values, whatever their names.
    """
    found = decontaminate.contamination(_packed(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _unpacked(found.where(F.size("items") == 0), docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mixture takes, once for each copy, with copy_no (a clashing one is replaced).

    A null source is one of its own; null and empty texts have no words but are drawn like others.
    Repeated rows are drawn one by one. No rows give no rows.
    """
    return mixing.mixed_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("quality_rules", apply_quality_rules),
    ("ngram_jaccard", remove_near_duplicates),
    ("decontamination", remove_benchmark_passages),
    ("mixing", mix_sources),
]

#: Language ID, a trained network, and the multi-pattern search's digest are beyond one SQL statement.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
