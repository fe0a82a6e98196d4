"""Packed token-id matrices on disk.

Every scan task tokenizes its documents, cuts the overlong ones without loss,
packs its pieces best-fit decreasing (segment tree over remaining capacities)
and writes one row per sequence: the id row, the cumulative segment lengths and
the positions, which restart at every segment.  A task packs its pieces in
rounds of a bounded number of tokens; the fullest bins leave at the end of a
round, and bins that still have room are carried to the next, up to half a
round's tokens, so memory stays bounded, every round takes in as much again, and
almost no place is lost.  Ids cross no shuffle, and a task that is
run again writes the same rows.

Defined cases: NULL and empty texts are one segment with the end id alone;
repeated rows and repeated or NULL doc_ids are packed row by row; extra columns
are ignored; an empty table writes an empty data set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ratewise.llm import bpe, fit_tree
from ratewise.llm.common import fresh_path, identified, schema
from ratewise.llm.packing import CAPACITY, END_ID, cuts, document_ids

ROUND_TOKENS = 8_000_000
_ROWS = ("sequence_id long, n_tokens int, doc_ids array<long>, pieces array<int>, starts array<long>, "
         "cu_seqlens array<int>, input_ids binary, position_ids binary")


class _Packer:
    """Best-fit decreasing of one task's pieces, in rounds."""

    def __init__(self, capacity: int, pad_id: int, dtype: str):
        self.capacity, self.pad_id, self.dtype = capacity, pad_id, dtype
        self.pieces: list[tuple[int | None, int, int, np.ndarray]] = []
        self.tokens = 0

    def add(self, piece: tuple[int | None, int, int, np.ndarray]) -> None:
        self.pieces.append(piece)
        self.tokens += len(piece[3])

    def sequences(self, last: bool) -> Iterator[list[tuple]]:
        """Bins of the pieces held; unless ``last``, bins under 98 % stay for the next round, the emptiest first,
        up to half of ``ROUND_TOKENS``."""
        lengths = np.array([len(p[3]) for p in self.pieces], np.int64)
        runs = fit_tree.pack_counts(np.bincount(lengths, minlength=self.capacity + 1), self.capacity)
        order = np.argsort(lengths, kind="stable")
        ranks = np.empty(len(lengths), np.int64)
        by_length = lengths[order]
        ranks[order] = np.arange(len(order)) - np.searchsorted(by_length, by_length)
        bins, offsets = fit_tree.place(runs, lengths, ranks)
        by_bin = np.lexsort((offsets, bins))
        edges = np.flatnonzero(np.diff(bins[by_bin], prepend=-1, append=-1))
        filled = np.add.reduceat(lengths[by_bin], edges[:-1])
        stay = np.zeros(len(filled), bool)
        if not last:
            emptiest = np.argsort(filled, kind="stable")
            fits = np.cumsum(filled[emptiest]) <= ROUND_TOKENS // 2
            stay[emptiest] = fits & (filled[emptiest] < 0.98 * self.capacity)
        held: list[tuple] = []
        for lo, hi, kept in zip(edges, edges[1:], stay):
            row = [self.pieces[i] for i in by_bin[lo:hi]]
            if kept:
                held += row
            else:
                yield row
        self.pieces, self.tokens = held, sum(len(p[3]) for p in held)

    def row(self, sequence_id: int, pieces: list[tuple]) -> tuple:
        ids = np.full(self.capacity, self.pad_id, self.dtype)
        positions = np.zeros(self.capacity, self.dtype)
        ends = np.cumsum([len(p[3]) for p in pieces])
        for end, (_, _, _, part) in zip(ends, pieces):
            ids[end - len(part):end] = part
            positions[end - len(part):end] = np.arange(len(part))
        return (sequence_id, int(ends[-1]), [p[0] for p in pieces], [p[1] for p in pieces], [p[2] for p in pieces],
                [0, *ends.tolist()], ids.tobytes(), positions.tobytes())


def packed_rows(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID,
                pad_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per sequence; ``input_ids`` and ``position_ids`` hold ``capacity`` little-endian
    unsigned integers (16 bits where the vocabulary and capacity fit, else 32)."""
    tokenizer = tokenizer or bpe.default_path()
    columns = [f.name for f in schema(_ROWS)]

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = bpe.encoder(tokenizer)
        dtype = "<u2" if max(enc.size, capacity, end_id + 1, pad_id + 1) <= 1 << 16 else "<u4"
        packer, first, made = _Packer(capacity, pad_id, dtype), None, 0

        def rounds(last: bool) -> Iterator[pd.DataFrame]:
            nonlocal made
            rows = []
            for pieces in packer.sequences(last):
                rows.append(packer.row(first + made, pieces))
                made += 1
                if len(rows) == 2000:
                    yield pd.DataFrame(rows, columns=columns)
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=columns)

        for batch in batches:
            if first is None and len(batch):
                first = int(batch.row_id.iat[0])  # unique to the task: no task makes more sequences than rows x 2**20
            for doc_id, no_id, text in zip(batch.doc_id, batch.no_id, batch.text):
                ids = document_ids(enc, text, end_id).astype(dtype)
                starts = cuts(len(ids), capacity)
                for k, part in enumerate(np.split(ids, starts[1:])):
                    packer.add((None if no_id else int(doc_id), k, int(starts[k]), part))
                if packer.tokens >= ROUND_TOKENS:
                    yield from rounds(False)
        if packer.pieces:
            yield from rounds(True)

    return identified(docs, id_col, text_col).mapInPandas(pack, schema(_ROWS))


def write_packed(docs: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write the packed matrices as Parquet under ``path`` (default: a new folder in the shared
    storage) and return the written data set."""
    spark = docs.sparkSession
    path = path or fresh_path(spark, "packed-ids")
    packed_rows(docs, **options).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema(_ROWS)).parquet(path)
