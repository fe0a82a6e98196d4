"""Document fingerprints by winnowing.

The k-grams of a text's code points get rolling hashes; of every ``window``
consecutive hashes the smallest is chosen, of equal ones the rightmost, and a
choice is kept once with its position.  Any run of at least window + k - 1 code
points that two texts share leaves a common fingerprint in both, and no common
run shorter than k can; the kept positions say where.

A text shorter than k is its own only gram; a text with fewer hashes than a
window is one window; an empty (or NULL) text has an empty fingerprint.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratewise.llm.common import identified, partitions, restored, schema
from ratewise.llm.words import mix

K = 16
WINDOW = 24
_BASE = 0x2545F4914F6CDD1D
_OUT = ("row_id long, doc_id long, no_id boolean, n_chars long, edited_sha256 string, fingerprint string, "
        "edited_fingerprint string, near_edited double, near_next double")


def code_points(text: str | None) -> np.ndarray:
    """Code points of a text; a lone surrogate counts as '?'."""
    return np.frombuffer((text or "").encode("utf-32-le", "replace"), "<u4")


def gram_hashes(points: np.ndarray, k: int) -> np.ndarray:
    """A 32-bit hash of every k-gram: the polynomial of the previous one, rolled on by doubling."""
    width = min(k, len(points))
    if not width:
        return np.empty(0, np.uint64)
    codes = mix(points.astype(np.uint64) + np.uint64(1))
    # grams of 1, 2, 4 ... points joined along the binary digits of the width
    out, have, block, size, step = None, 0, codes, 1, _BASE
    while True:
        if width & size:
            out = block if out is None else out[:len(out) - size] * np.uint64(step) + block[have:have + len(out) - size]
            have += size
        size *= 2
        if size > width:
            break
        half = size // 2
        block = block[:-half] * np.uint64(step) + block[half:]
        step = step * step % (1 << 64)
    return mix(out[:len(points) - width + 1]) >> np.uint64(32)


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """Positions chosen: the smallest hash of each window, the rightmost of equal ones."""
    n = len(hashes)
    if not n:
        return np.empty(0, np.int64)
    low = np.uint64(0xFFFFFFFF)
    # one number orders by hash, then by position from the right
    keyed = (hashes << np.uint64(32)) | (low - np.arange(n, dtype=np.uint64))
    width = min(window, n)
    # minima from block starts and to block ends give the minimum of any window of a block's width
    padded = np.full(-(-n // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:n] = keyed
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(back[:n - width + 1], ahead[width - 1:n])
    return np.unique((low - (least & low)).astype(np.int64))


class Fingerprint:
    """Chosen hashes with their positions."""

    def __init__(self, points: np.ndarray, k: int = K, window: int = WINDOW):
        hashes = gram_hashes(points, k)
        self.positions = winnow(hashes, window)
        self.hashes = hashes[self.positions].astype(np.uint32)
        self.distinct = np.unique(self.hashes)

    def __str__(self) -> str:
        """Position and hash, eight hexadecimal digits each, in the order of the text."""
        pairs = np.empty((len(self.positions), 2), ">u4")
        pairs[:, 0], pairs[:, 1] = self.positions, self.hashes
        return pairs.tobytes().hex(" ", 8)

    def likeness(self, other: "Fingerprint") -> float:
        """Common part of all distinct hashes of both (0 to 1); two empty ones are alike."""
        if not len(self.distinct) and not len(other.distinct):
            return 1.0
        both = len(np.intersect1d(self.distinct, other.distinct, assume_unique=True))
        return both / (len(self.distinct) + len(other.distinct) - both)


def fingerprints(docs: DataFrame, k: int = K, window: int = WINDOW,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, fingerprint) of every row; NULL texts are empty, ids may repeat or be NULL."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            points = [code_points(t) for t in batch.text]
            yield pd.DataFrame({"doc_id": batch.doc_id, "no_id": batch.no_id, "n_chars": [len(p) for p in points],
                                "fingerprint": [str(Fingerprint(p, k, window)) for p in points]})

    return restored(identified(docs, id_col, text_col).mapInPandas(
        run, schema("doc_id long, no_id boolean, n_chars long, fingerprint string")))


def _chained(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Documents in pieces of descending id; each piece also holds the document that follows its last.

    The order is cut at quantiles of the ids, so one shuffle moves each text
    once, and one more text for a piece (its ``guest``).  Equal ids share a
    piece and are ordered by a hash of their texts; NULL ids count as 0.
    """
    spark = docs.sparkSession
    rows = identified(docs, id_col, text_col).withColumn("tie", F.xxhash64("text"))
    n = 4 * partitions(spark)
    cut_at = rows.select(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 20 * n).alias("q")).first().q
    splits = np.unique(np.array(cut_at or [0], np.int64))

    @F.pandas_udf("int")
    def piece_of(doc_id: pd.Series) -> pd.Series:
        return pd.Series(len(splits) - np.searchsorted(splits, doc_id.to_numpy(), side="left")).astype("int32")

    dealt = rows.withColumn("piece", piece_of("doc_id"))
    # The first of a piece follows the last of the piece before; one small row per piece comes to the driver.
    first = dealt.groupBy("piece").agg(F.max(F.struct("doc_id", "tie")).alias("row")).orderBy("piece").collect()
    after = [(r.row.doc_id, r.row.tie, first[k - 1].piece) for k, r in enumerate(first)]
    if not after:
        return dealt.withColumn("guest", F.lit(False))
    wanted = spark.createDataFrame(after, "doc_id long, tie long, piece int")
    guests = rows.join(F.broadcast(wanted), ["doc_id", "tie"]).withColumn("guest", F.lit(True))
    return dealt.withColumn("guest", F.lit(False)).unionByName(guests)


def edited_fingerprints(docs: DataFrame, k: int = K, window: int = WINDOW,
                        id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text.

    The edited text has the last floor(n / 2) code points replaced by the first
    as many (or all) of the next document in descending order of the ids; the
    first follows the last.  A table of one row is its own next.
    """
    columns = [f.name for f in schema(_OUT)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, held_print, held_row, piece = None, None, None, None
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                points = code_points(row.text)
                print_ = Fingerprint(points, k, window)
                if held is not None and row.piece == piece:
                    cut = len(held) - len(held) // 2
                    edited = np.concatenate([held[:cut], points[:len(held) // 2]])
                    other = Fingerprint(edited, k, window)
                    text = edited.tobytes().decode("utf-32-le").encode()
                    out.append((held_row.row_id, held_row.doc_id, held_row.no_id, len(held),
                                hashlib.sha256(text).hexdigest(), str(held_print), str(other),
                                held_print.likeness(other), held_print.likeness(print_)))
                # a guest ends its piece (equal guests may repeat)
                held = None if row.guest else points
                held_print, held_row, piece = print_, row, row.piece
            yield pd.DataFrame(out, columns=columns)

    rows = _chained(docs, id_col, text_col)
    dealt = rows.repartition(partitions(docs.sparkSession), "piece") \
        .sortWithinPartitions("piece", "guest", F.col("doc_id").desc(), F.col("tie").desc())
    return restored(dealt.mapInPandas(run, schema(_OUT))).drop("row_id")
