"""Quality scores from a Bradley-Terry ranking of labelled documents.

A document's score is a weighted sum of features of its text.  Every labelled
pair (good, bad) is a comparison that the good one should win, with probability
sigmoid(w . (x_good - x_bad)); w minimises the logistic loss over the pairs
plus a small ridge.  The loss of feature differences has no intercept, so the
decision comes from a quantile of the scores: the share of bad labels says which
quantile of the labelled scores is the threshold, and scores are mapped to 0..1
so that this threshold is ``DECISION``.

Training covers every labelled row.  The labelled documents are dealt to blocks
of about ``BLOCK`` by a hash of their id; documents of a label that a block would
hold fewer than ``SPREAD`` of are dealt to several blocks each, so that a block
holds ``SPREAD`` of them on average (none with a chance of e^-SPREAD) and at most
SPREAD / BLOCK of all labelled rows is added.  In a block each good document
meets ``OPPONENTS`` bad ones and each bad one as many good ones (spread evenly,
the rarer side repeats).  Gradients and Hessians are summed on the cluster; only
sums of the size of the model come to the driver.

Defined cases: NULL and empty texts have the features of an empty text; without
labels of both kinds all weights are 0 and every document scores ``NEUTRAL``;
repeated labels of a document count each, NULL labels don't count; very long
texts are read whole; extra columns are ignored; empty ``documents`` give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratewise.llm.common import col, identified, materialise, pick, restored, schema, spare_names
from ratewise.llm.words import mix, word_bounds

DECISION = 0.3
NEUTRAL = 0.5
BLOCK = 512
SPREAD = 64
OPPONENTS = 8
STEPS = 12
RIDGE = 1e-3
HASHED = 32

_KINDS = ("lower", "upper", "digit", "space", "newline", "stop", "mark", "symbol", "high")
_KIND = np.full(256, _KINDS.index("symbol"), np.uint8)
_KIND[97:123] = _KINDS.index("lower")
_KIND[65:91] = _KINDS.index("upper")
_KIND[48:58] = _KINDS.index("digit")
_KIND[[9, 11, 12, 13, 32]] = _KINDS.index("space")
_KIND[10] = _KINDS.index("newline")
_KIND[[ord(c) for c in ".,;:"]] = _KINDS.index("stop")
_KIND[[ord(c) for c in "!?'\"()-"]] = _KINDS.index("mark")
_KIND[128:] = _KINDS.index("high")

#: Features: shares of byte kinds, word shapes, repetition, and a hashed spectrum of byte pairs.
FEATURES = len(_KINDS) + 16 + HASHED


def _word_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A cheap key per word from its first bytes, last bytes and length (for repetition shares only)."""
    first = data[starts].astype(np.uint64) | data[np.minimum(starts + 1, ends - 1)].astype(np.uint64) << np.uint64(8)
    last = data[ends - 1].astype(np.uint64) | data[np.maximum(ends - 2, starts)].astype(np.uint64) << np.uint64(8)
    middle = data[(starts + ends) // 2].astype(np.uint64)
    return first | last << np.uint64(16) | middle << np.uint64(32) | (ends - starts).astype(np.uint64) << np.uint64(40)


def features(text: str | None) -> np.ndarray:
    """The feature vector of a whole text."""
    data = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    out = np.zeros(FEATURES)
    n = len(data)
    out[0] = np.log1p(n) / 10
    if not n:
        return out
    kind = _KIND[data]
    share = np.bincount(kind, minlength=len(_KINDS)) / n
    out[1:1 + len(_KINDS)] = np.sqrt(share)
    at = 1 + len(_KINDS)
    starts, ends = word_bounds(data)
    words = len(starts)
    if words:
        length = ends - starts
        first, last = kind[starts], kind[ends - 1]
        upper = np.add.reduceat(kind == _KINDS.index("upper"), starts)
        upper = np.minimum(upper, length)
        keys = _word_keys(data, starts, ends)
        distinct = len(np.unique(keys))
        pairs = len(np.unique(mix(keys[:-1]) + keys[1:])) if words > 1 else 1
        symbol = _KINDS.index("symbol")
        out[at:at + 13] = (
            length.mean() / 10, min(length.std() / 10, 3), (length <= 3).mean(), (length >= 12).mean(),
            (last == symbol).mean(), (first == symbol).mean(), ((length > 1) & (upper * 2 > length)).mean(),
            (last == _KINDS.index("mark")).mean(), (last == _KINDS.index("stop")).mean(),
            ((length == 1) & (first == symbol)).mean(), distinct / words, pairs / max(words - 1, 1),
            (keys[1:] == keys[:-1]).mean() if words > 1 else 0)
    lines = (text or "").split("\n")
    out[at + 13] = 1 - len(set(lines)) / len(lines)
    out[at + 14] = np.log1p(len(lines)) / 10
    if n > 1:
        pair = (kind[:-1].astype(np.uint64) << np.uint64(8)) + kind[1:]
        spectrum = np.bincount((mix(pair) % np.uint64(HASHED)).astype(np.int64), minlength=HASHED)
        out[at + 15:at + 15 + HASHED] = np.sqrt(spectrum / (n - 1))
    return out


@dataclass
class Ranking:
    """Weights over standardised features, and the score that decides."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.scale @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """0..1: the chance to win against a document at the threshold, shifted so that a tie is ``DECISION``."""
        if not self.weights.any():
            return np.full(len(x), NEUTRAL)
        # rounded, so that equal texts score alike wherever they stand in a batch
        z = np.round(self.raw(x) - self.threshold, 9) + np.log(DECISION / (1 - DECISION))
        out = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        return np.where(z >= np.log(DECISION / (1 - DECISION)), np.maximum(out, DECISION), out)


def block_pairs(label: np.ndarray, opponents: int = OPPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """Indices (good, bad) of a block's comparisons."""
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    if not len(good) or not len(bad):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    n = max(len(good), len(bad))
    turn = np.arange(n * opponents)
    a = good[turn % len(good)] if len(good) == n else good[(turn + turn // n * (n // opponents + 1)) % len(good)]
    b = bad[turn % len(bad)] if len(bad) == n else bad[(turn + turn // n * (n // opponents + 1)) % len(bad)]
    return a, b


def _unpack(cells: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(cells), np.float32).reshape(-1, FEATURES).astype(np.float64)


def feature_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, no_id, row_id, x) of every document; x holds ``FEATURES`` 32-bit floats.  Written once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[["doc_id", "no_id", "row_id"]].assign(
                x=[features(t).astype(np.float32).tobytes() for t in batch.text])

    return materialise(identified(docs, id_col, text_col).mapInPandas(
        run, schema("doc_id long, no_id boolean, row_id long, x binary")), "quality-features")


def _summed(parts: DataFrame) -> np.ndarray:
    """Element-wise sum of the vectors in rows (at, value); as long as the model, not the data."""
    rows = parts.groupBy("at").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(max([r["at"] for r in rows], default=-1) + 1)
    for r in rows:
        out[r["at"]] = r["value"]
    return out


def _vector(values: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"at": np.arange(len(values)), "value": values})


_SUM = "at long, value double"


def deal(rows: DataFrame, blocks: int, bad: int, good: int) -> DataFrame:
    """``rows`` (doc_id, row_id, label, x) with their ``block``, the rarer label's repeated over several blocks."""
    first = F.pmod(F.xxhash64("doc_id"), F.lit(blocks))
    if blocks < 2:
        return rows.withColumn("block", first)
    times = [max(1, -(-SPREAD * blocks // n)) for n in (bad, good)]
    copies = F.when(F.col("label") == 0, F.lit(times[0])).otherwise(F.lit(times[1]))
    again = F.pmod(F.xxhash64("doc_id", "copy"), F.lit(blocks))
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), copies))) \
        .withColumn("block", F.when(F.col("copy") == 1, first).otherwise(again)).drop("copy")


def fit(table: DataFrame, labels: DataFrame) -> Ranking:
    """The ranking learnt from ``labels`` (doc_id, label 0/1) over a feature table."""
    marked = labels.where("doc_id is not null and label in (0, 1)")
    rows = materialise(table.where("not no_id").join(marked, "doc_id").select("doc_id", "row_id", "label", "x"),
                       "quality-labelled")

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(2 + 2 * FEATURES)
        for batch in batches:
            if len(batch):
                x = _unpack(batch.x)
                total += np.concatenate([[len(x), (batch.label == 0).sum()], x.sum(axis=0), (x * x).sum(axis=0)])
        yield _vector(total)

    got = _summed(rows.mapInPandas(moments, _SUM))
    n, bad = (int(got[0]), int(got[1])) if len(got) else (0, 0)
    zero = Ranking(np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES), 0.0)
    if not bad or bad == n:
        return zero
    mean = got[2:2 + FEATURES] / n
    deviation = np.sqrt(np.maximum(got[2 + FEATURES:] / n - mean ** 2, 0))
    model = Ranking(mean, np.where(deviation > 1e-6, deviation, 1.0), np.zeros(FEATURES), 0.0)

    blocks = -(-n // BLOCK)
    dealt = deal(rows, blocks, bad, n - bad)

    def gathered(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["row_id", "label"])
        return pd.DataFrame({"x": [b"".join(block.x)], "label": [bytes(block.label.astype(np.uint8))]})

    # a block holds about BLOCK small rows, however many labels there are
    data = materialise(dealt.groupBy("block").applyInPandas(gathered, schema("x binary, label binary")),
                       "quality-blocks")

    def slope(weights: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros(1 + FEATURES + FEATURES * FEATURES)
            for batch in batches:
                for x, label in zip(batch.x, batch.label):
                    z = (np.frombuffer(x, np.float32).reshape(-1, FEATURES) - model.mean) / model.scale
                    a, b = block_pairs(np.frombuffer(label, np.uint8))
                    if len(a):
                        d = z[a] - z[b]
                        lost = 1 / (1 + np.exp(np.clip(d @ weights, -500, 500)))
                        total += np.concatenate([[len(d)], d.T @ lost, ((d.T * (lost * (1 - lost))) @ d).ravel()])
            yield _vector(total)
        return _summed(data.mapInPandas(run, _SUM))

    weights = np.zeros(FEATURES)
    for _ in range(STEPS):
        got = slope(weights)
        if not got[0]:
            return zero
        gradient = got[1:1 + FEATURES] / got[0] - RIDGE * weights
        curve = got[1 + FEATURES:].reshape(FEATURES, FEATURES) / got[0] + RIDGE * np.eye(FEATURES)
        step = np.linalg.solve(curve, gradient)
        weights = weights + step
        if np.abs(step).max() < 1e-4:
            break
    model.weights = np.round(weights, 6)

    def raws(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"raw": model.raw(_unpack(batch.x))})

    share = bad / n
    low, high = rows.mapInPandas(raws, schema("raw double")).select(
        F.percentile_approx("raw", [share, min(1.0, share + 1 / n)], 100_000)).first()[0]
    model.threshold = (low + high) / 2
    return model


def training_labels(labels: DataFrame, held_out_of: int = 5) -> DataFrame:
    """(doc_id, label) of ``labels.quality`` without the rows whose crc32(doc_id) mod ``held_out_of`` is 0."""
    return pick(labels, doc_id="doc_id", label="quality").withColumn("doc_id", F.col("doc_id").cast("long")) \
        .where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % held_out_of != 0)


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted) of every row of ``docs``, learnt from ``labels`` (doc_id, label)."""
    table = feature_table(docs, id_col, text_col)
    model = fit(table, labels)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                score = model.score(_unpack(batch.x))
                yield batch[["doc_id", "no_id"]].assign(score=score, predicted=(score >= DECISION).astype(np.int32))

    return restored(table.mapInPandas(run, schema("doc_id long, no_id boolean, score double, predicted int")))


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that the classifier accepts.

    The rows are written once with their features beside them, so that no text is
    looked at again for the verdict; nothing but features is shuffled.
    """
    (x,) = spare_names(docs, "features")

    @F.pandas_udf("binary")
    def featured(text: pd.Series) -> pd.Series:
        return pd.Series([features(t).astype(np.float32).tobytes() for t in text], dtype=object)

    stored = materialise(docs.withColumn(x, featured(col(text_col))), "quality-documents")
    table = identified(pick(stored, doc_id=id_col, x=x), "doc_id", "x").withColumnRenamed("text", "x")
    model = fit(table, labels)

    @F.pandas_udf("boolean")
    def accepts(cells: pd.Series) -> pd.Series:
        if not len(cells):
            return pd.Series([], dtype=bool)
        return pd.Series(model.score(_unpack(cells)) >= DECISION)

    return stored.where(accepts(col(x))).select(*map(col, docs.columns))
