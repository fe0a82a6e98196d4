"""The registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratewise.llm import (
    alignment, decontam, divergence, edit_counts, guess_cost, line_dedup, maxent_lm, minhash, packing, preference,
    quality, token_output, winnowing)
from ratewise.llm.common import read_table, remainder, spare_names
from ratewise.llm.oracle_sql import ORACLE_SQL as ORACLE_SQL


def op1_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bradley-Terry quality scores of all documents."""
    docs, labels = (read_table(spark, sf_dir, t) for t in ("documents", "labels"))
    return quality.score_documents(docs, quality.training_labels(labels)).select(
        "doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


def op2_maxent_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of all documents under the hashed maximum-entropy model."""
    return maxent_lm.score_corpus(read_table(spark, sf_dir, "documents"), remainder(F.col("doc_id"), 7) == 2)


def op3_preference_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt and masked completions of every conversation against its reply-swapped twin."""
    turns = read_table(spark, sf_dir, "conversations")
    return preference.format_sides(preference.swapped_replies(turns)).select(
        F.col("pair_id").alias("conv_id"), "prompt_turns", "prompt",
        "chosen", preference.mask_text("chosen_mask").alias("chosen_mask"),
        "rejected", preference.mask_text("rejected_mask").alias("rejected_mask"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item that a document holds within the item's error budget."""
    docs, items = (read_table(spark, sf_dir, t) for t in ("documents", "benchmark"))
    return decontam.find_items(docs, items)


def op5_edit_aware_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents before and after three edits each."""
    docs = read_table(spark, sf_dir, "documents")
    edits, = spare_names(docs, "edits")
    return edit_counts.count_edits(docs.withColumn(edits, edit_counts.sample_edits()), edits_col=edits)


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of the documents whose 3-word shingle sets are 85 % alike."""
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"),
                                   minhash.Similarity(words=3, percent=85)).drop("row_id")


def op7_winnowing_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Winnowing fingerprints of all documents and of their edited texts."""
    return winnowing.edited_fingerprints(read_table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that an earlier line equals or nearly equals."""
    return line_dedup.dedup_lines(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_kept", "text")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1,024 tokens."""
    return packing.pack_documents(read_table(spark, sf_dir, "documents"))


def op10_packed_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed id matrices of all documents written to the shared folder; a digest row per sequence."""
    written = token_output.write_packed(read_table(spark, sf_dir, "documents"))
    width = F.length("input_ids") / token_output.CAPACITY
    return written.select(
        "sequence_id", "n_tokens", "doc_ids", "pieces", "starts", "cu_seqlens",
        width.cast("int").alias("bytes_per_id"),
        F.crc32("input_ids").alias("input_ids_crc32"), F.crc32("position_ids").alias("position_ids_crc32"))


def op11_secret_guess_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents: fixed patterns, and credential values by the cost of guessing them."""
    return guess_cost.find_secrets(read_table(spark, sf_dir, "documents"))


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of all documents' tokens under two vocabularies."""
    return alignment.align(read_table(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances between the sources of each language, and the terms that set each source apart."""
    return divergence.divergence(read_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_quality_ranking,
    op2_maxent_language_model,
    op3_preference_formatting,
    op4_benchmark_decontamination,
    op5_edit_aware_counts,
    op6_minhash_near_dedup,
    op7_winnowing_fingerprints,
    op8_line_dedup,
    op9_best_fit_packing,
    op10_packed_token_output,
    op11_secret_guess_cost,
    op12_tokenizer_alignment,
    op13_source_divergence,
)}
