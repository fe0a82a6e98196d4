"""The corpus pipeline: quality, line dedup, near dedup, decontamination, packing.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before
kept; ``run`` writes each stage's rows as Parquet to the shared folder and reads
them back as the next one's documents.  All stages but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ratewise.llm import decontam, line_dedup, minhash, packing, quality
from ratewise.llm.common import col, materialise, read_table, spare_names


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts (operator 1)."""
    return quality.accepted(docs, quality.training_labels(read_table(spark, sf_dir, "labels")))


def line_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier one has (operator 8).

    A document goes when every line of it, short ones too, equals or nearly equals
    an earlier one: it holds nothing new.  ``n_chars`` follows the text.
    """
    out = line_dedup.dedup_lines(docs)
    _, _, n_new = out.columns[-3:]
    out = out.where(col(n_new).isNull() | (col(n_new) > 0))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*map(col, docs.columns))


def near_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (operator 6): five-word shingles, similarity 0.8.

    Rows without a doc_id stay; of rows that repeat a doc_id and its text one
    stays, and other texts of the id are judged by themselves.
    """
    tie, rank = spare_names(docs, "tie", "repeat")
    found = minhash.repeats(docs, minhash.Similarity(words=5, percent=80))
    gone = materialise(found.withColumnRenamed("tie", tie), "pipeline-gone")
    named = docs.where("doc_id is not null").withColumn(tie, F.xxhash64("text")) \
        .join(gone, ["doc_id", tie], "left_anti") \
        .withColumn(rank, F.row_number().over(Window.partitionBy("doc_id", tie).orderBy(tie))) \
        .where(F.col(rank) == 1)
    return named.select(*map(col, docs.columns)).unionByName(docs.where("doc_id is null"))


def benchmark_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item (operator 4)."""
    return decontam.clean(docs, read_table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of what is left, with its sequence and place (operator 9)."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", quality_filter),
    ("line dedup", line_filter),
    ("minhash near-dedup", near_filter),
    ("benchmark decontamination", benchmark_filter),
    ("best-fit packing", pack),
]

#: A learnt classifier and a vocabulary's token ids can't be expressed in SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written and reread."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
