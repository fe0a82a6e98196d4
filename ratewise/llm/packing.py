"""Best-fit packing of tokenized documents into sequences of a fixed capacity.

Best-fit decreasing needs only how many pieces of each length exist.  So the
corpus is tokenized in one pass that keeps lengths, the histogram of lengths
(at most ``capacity`` numbers, whatever the corpus) is packed with a segment
tree over remaining capacities, and every piece finds its place from its rank
among the pieces of its length.  The ranks come from a two-level count: pieces
are spread over buckets by a hash, counted per (length, bucket), and numbered
inside a bucket from the bucket's offset, so a length that a third of all
documents share is still spread over all tasks.  No text and no ids are
shuffled.

Defined cases: NULL and empty texts are one piece that holds the end id alone;
texts of any length are cut, never shortened; repeated rows and repeated or
NULL doc_ids are packed row by row; extra columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratewise.llm import bpe, fit_tree
from ratewise.llm.common import col, identified, materialise, partitions, restored, schema

CAPACITY = 1024
END_ID = 2
_PIECES = "doc_id long, no_id boolean, row_id long, piece int, start long, length long, ids_crc32 long"


def cuts(n: int, capacity: int) -> np.ndarray:
    """Starts of a document's pieces: all but the first hold ``capacity`` tokens."""
    first = n % capacity or min(n, capacity)
    return np.concatenate(([0], np.arange(first, n, capacity))) if n else np.zeros(0, np.int64)


def document_ids(enc: bpe.Encoder, text: str | None, end_id: int) -> np.ndarray:
    """A document's ids and the end id, as little-endian unsigned 32-bit integers."""
    ids = enc.ids(text)
    out = np.empty(len(ids) + 1, "<u4")
    out[:-1] = ids
    out[-1] = end_id
    return out


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of every document; no shuffle."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = bpe.encoder(tokenizer)
        for batch in batches:
            out = []
            for doc_id, no_id, row_id, text in zip(batch.doc_id, batch.no_id, batch.row_id, batch.text):
                ids = document_ids(enc, text, end_id)
                starts = cuts(len(ids), capacity)
                ends = np.append(starts[1:], len(ids))
                out += [(doc_id, no_id, row_id, k, int(a), int(b - a), zlib.crc32(ids[a:b].tobytes()))
                        for k, (a, b) in enumerate(zip(starts, ends))]
            yield pd.DataFrame(out, columns=columns)

    columns = [f.name for f in schema(_PIECES)]
    return restored(identified(docs, id_col, text_col).mapInPandas(encode, schema(_PIECES)))


def best_fit(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``sequence_id`` and ``offset`` for pieces (any columns, ``length`` and a unique (row_id, piece)).

    The runs that are sent to the tasks are bounded by the number of lengths
    (see ``fit_tree.pack_counts``), not by the corpus.
    """
    spark = pieces.sparkSession
    buckets = partitions(spark)
    dealt = pieces.withColumn("_bucket", F.pmod(F.xxhash64("row_id", "piece"), F.lit(buckets)))
    sizes = materialise(dealt.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n")), "packing-sizes")
    counts = np.zeros(capacity + 1, np.int64)
    for row in sizes.groupBy("length").agg(F.sum("_n").alias("n")).collect():  # at most ``capacity`` rows
        counts[row.length] = row.n
    runs = fit_tree.pack_counts(counts, capacity)
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("length", "_bucket").orderBy("row_id", "piece")
    ranked = dealt.withColumn("_in", F.row_number().over(inside) - 1).join(offsets, ["length", "_bucket"]) \
        .withColumn("_rank", F.col("_before") + F.col("_in"))

    @F.pandas_udf("sequence_id long, offset long")
    def placed(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        bins, offset = fit_tree.place(runs, length.to_numpy(np.int64), rank.to_numpy(np.int64))
        return pd.DataFrame({"sequence_id": bins, "offset": offset})

    return ranked.select(*map(col, pieces.columns), placed("length", "_rank").alias("_place")) \
        .select("*", "_place.*").drop("_place")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY,
                   end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All documents packed: one row per piece with its sequence and place."""
    tokenizer = tokenizer or bpe.default_path()
    pieces = materialise(token_pieces(docs, tokenizer, capacity, end_id, id_col, text_col), "packing-pieces")
    return best_fit(pieces, capacity).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
