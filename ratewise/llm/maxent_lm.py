"""A hashed maximum-entropy language model with a class-factored softmax over all words.

P(word | context) = P(class | context) * P(node | class, context) * P(word | node).

* Classes: the most frequent words, in order, are dealt to classes of near-equal
  weight; all other words, unseen ones too, belong to tail classes by a hash of
  their last two bytes; the end of a text is a class of its own.
* P(class | context) is a softmax over hashed features of the context: the word
  before, the two words before together, and the words two and three places
  before (skips).  A context word outside the most frequent ones is replaced by
  its tail class.
* P(node | class, context) is a softmax with the word before and the skip as
  hashed features.  The nodes of a class of frequent words are its words; those
  of a tail class are its children, to which its words are dealt by their hash.
* P(word | node) is 1 for a frequent word and the add-one estimate
  (c + 1) / (N_child + V_child + 1) for a word of a tail class's child.

Without training all weights are 0 and the model is a smoothed unigram model, so
what it gains over the base score comes from the trained weights.

The model grows with the vocabulary: ``sizes`` gives the numbers of classes,
words, children, context words and hashed rows for V distinct words.  Up to
``VOCABULARY`` words they are the constants below; beyond, the number of weights
grows by a power of V below one half (13 MB at 5 * 10^5 words, 0.7 GB at 10^10);
a task holds them, in training three times.

Training: counts of all training words are summed on the cluster.  Then every
task goes once through its training texts in small batches, updates its copy of
the weights by the batch's gradient (AdaGrad), and sends its changes;
the changes are averaged on the cluster, each feature's by how often a task met
it.  Scan partitions of less than ``TASK_TOKENS`` tokens share a task, so that what
the tasks send stays in proportion to the texts.  The texts are dealt to
``ROUNDS`` rounds by a hash, each round starting from the average of the one
before, so every training text is used once.

Scoring goes through the texts in batches of tokens; word counts beyond the
``HEAD`` most frequent ones (whose table is sent to the tasks, a fixed number of
rows) come from a join of the rare words with the whole count table.  Words are
named by 64-bit hashes.

Defined cases: NULL and empty texts have the end token alone; repeated rows
count and are scored row by row; a NULL doc_id counts as the text '' for the
split; without training texts all counts are 0; extra columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratewise.llm.common import identified, materialise, partitions, restored, schema
from ratewise.llm.words import lowered, mix, word_bounds, word_hashes

HEAD = 65_536
VOCABULARY = 1 << 19
CONTEXT = 16_384
WORDS = 1_024
HEAD_CLASSES = 15
TAIL_CLASSES = 16
CHILDREN = 64
ROWS = 1 << 15
WORD_ROWS = 1 << 10
MINIBATCH = 1 << 16
ROUNDS = 2
RATE = 0.6
CHUNK = 1 << 17
TASK_TOKENS = 1 << 23

#: Ids of the end of a text and of the places before its start (no word hash has 0 or 16).
END, START = 0, 16
_LN10 = np.log(10)
_TAIL = np.uint64(TAIL_CLASSES - 1)
_TAIL_BITS = np.uint64(TAIL_CLASSES.bit_length() - 1)


@dataclass(frozen=True)
class Sizes:
    """Sizes of a model; rows and children are powers of two."""

    context: int
    words: int
    head_classes: int
    children: int
    rows: int
    word_rows: int

    @property
    def classes(self) -> int:
        return self.head_classes + TAIL_CLASSES + 1


def sizes(distinct: int) -> Sizes:
    """Sizes for a vocabulary of ``distinct`` words, without an upper limit but that the context words and the
    softmax's own words are among the ``HEAD`` ones."""
    times = max(1.0, distinct / VOCABULARY)

    def grown(base: int, power: float) -> int:
        return int(base * times ** power)

    def doubled(base: int, power: float) -> int:
        return base << round(np.log2(times) * power)

    return Sizes(min(HEAD, grown(CONTEXT, 1 / 2)), min(HEAD, grown(WORDS, 1 / 3)), grown(HEAD_CLASSES, 1 / 6),
                 doubled(CHILDREN, 1 / 6), doubled(ROWS, 1 / 4), doubled(WORD_ROWS, 1 / 6))


def token_ids(text: str | None) -> np.ndarray:
    """A text's words as 64-bit ids whose low bits hold the tail class, and the end."""
    data = lowered(text)
    starts, ends = word_bounds(data)
    out = np.empty(len(starts) + 1, np.uint64)
    if len(starts):
        last = data[ends - 1].astype(np.uint64)
        before = np.where(ends - starts > 1, data[np.maximum(ends - 2, 0)], 0).astype(np.uint64)
        tail = mix(last << np.uint64(8) | before) & _TAIL
        hashes = word_hashes(data, (starts, ends)) & ~_TAIL
        out[:-1] = np.where(hashes <= np.uint64(START), np.uint64(32), hashes) | tail
    out[-1] = END
    return out


class Lookup:
    """Ranks of known ids: open addressing in a sparse table, all probes of a batch together."""

    def __init__(self, ids: np.ndarray):
        self.bits = max(10, int(len(ids)).bit_length() + 3)
        self.keys = np.full(1 << self.bits, 1, np.uint64)  # 1 is no word's id
        self.ranks = np.full(1 << self.bits, -1, np.int32)
        todo, place = np.arange(len(ids)), self._place(ids)
        while len(todo):
            free = self.ranks[place] < 0
            _, first = np.unique(place, return_index=True)
            take = np.zeros(len(todo), bool)
            take[first] = True
            take &= free
            self.keys[place[take]] = ids[todo[take]]
            self.ranks[place[take]] = todo[take]
            todo, place = todo[~take], (place[~take] + 1) & ((1 << self.bits) - 1)

    def _place(self, ids: np.ndarray) -> np.ndarray:
        return (mix(ids) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, ids: np.ndarray) -> np.ndarray:
        """The rank of each id, -1 of unknown ones."""
        place = self._place(ids)
        out = np.where(self.keys[place] == ids, self.ranks[place], -1)
        open_ = np.flatnonzero((out < 0) & (self.ranks[place] >= 0))
        while len(open_):
            place[open_] = (place[open_] + 1) & ((1 << self.bits) - 1)
            at = place[open_]
            hit = self.keys[at] == ids[open_]
            out[open_[hit]] = self.ranks[at[hit]]
            open_ = open_[~hit & (self.ranks[at] >= 0)]
        return out


@dataclass
class Model:
    """Counts of the head, class layout and weights."""

    sizes: Sizes
    head: np.ndarray            # ids by falling count, the end among the model's words
    head_counts: np.ndarray
    total: int                  # N
    distinct: int               # V
    class_log: np.ndarray       # log of the classes' counts
    tail_log10: np.ndarray      # log10(N_child + V_child + 1) of the tail classes' children
    member_class: np.ndarray    # class of each of the model's words
    member_place: np.ndarray    # its column among the words ordered by class
    lows: np.ndarray            # first node column of each class
    highs: np.ndarray           # the one after its last
    node_log: np.ndarray        # log of the nodes' counts, by column
    by_class: np.ndarray
    by_node: np.ndarray

    @property
    def floor(self) -> float:
        return np.log10(self.total + self.distinct + 1)


@dataclass
class Batch:
    """Tokens of several texts with what the model needs of them."""

    ids: np.ndarray
    rank: np.ndarray
    doc: np.ndarray
    klass: np.ndarray
    column: np.ndarray      # node column
    child: np.ndarray       # child of all tail classes' children, -1 for the model's words
    rows: np.ndarray        # (features, tokens) rows of the class weights
    node_rows: np.ndarray   # (2, tokens) rows of the node weights


class Reader:
    """Turns texts into batches under a model."""

    def __init__(self, model: Model):
        self.model, self.lookup = model, Lookup(model.head)

    def read(self, texts: list[np.ndarray]) -> Batch:
        m = self.model
        ids = np.concatenate(texts)
        sizes = np.array([len(t) for t in texts])
        doc = np.repeat(np.arange(len(texts)), sizes)
        rank = self.lookup(ids)
        words = len(m.member_class)
        inside = (rank >= 0) & (rank < words)
        tail = (ids & _TAIL).astype(np.int64)
        child = tail * m.sizes.children + (ids >> _TAIL_BITS & np.uint64(m.sizes.children - 1)).astype(np.int64)
        child[inside] = -1
        klass, column = m.sizes.head_classes + tail, words + child
        klass[inside], column[inside] = m.member_class[rank[inside]], m.member_place[rank[inside]]
        seen = np.where((rank >= 0) & (rank < m.sizes.context), ids, np.uint64(2) + (ids & _TAIL))
        place = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)

        def back(k: int) -> np.ndarray:
            out = np.full(len(ids), START, np.uint64)
            out[k:] = seen[:-k] if k < len(ids) else seen[:0]
            out[place < k] = START
            return out

        one, two, three = back(1), back(2), back(3)
        hashed = [mix(one + np.uint64(0x51)), mix(mix(one) + two + np.uint64(0x52)),
                  mix(two + np.uint64(0x5300)), mix(three + np.uint64(0x540000))]
        rows = np.stack([(h & np.uint64(m.sizes.rows - 1)).astype(np.int64) for h in hashed])
        node_rows = np.stack([(hashed[k] >> np.uint64(40) & np.uint64(m.sizes.word_rows - 1)).astype(np.int64)
                              for k in (0, 2)])
        return Batch(ids, rank, doc, klass, column, child, rows, node_rows)


def _class_logits(m: Model, rows: np.ndarray) -> np.ndarray:
    """Logits of the classes; the priors are at most 0, which keeps exp() in range."""
    logits = np.take(m.by_class, rows[0], axis=0)
    for r in rows[1:]:
        logits += np.take(m.by_class, r, axis=0)
    logits += (m.class_log - m.class_log.max()).astype(np.float32)
    return logits


def _node_logits(m: Model, c: int, rows: np.ndarray) -> np.ndarray:
    """Logits of the nodes of a class."""
    lo, hi = m.lows[c], m.highs[c]
    table = m.by_node[:, lo:hi]
    logits = table[rows[0]]
    logits += table[rows[1]]
    logits += (m.node_log[lo:hi] - m.node_log[lo:hi].max()).astype(np.float32)
    return logits


def _total(odds: np.ndarray) -> np.ndarray:
    return np.maximum(odds @ np.ones(odds.shape[1], np.float32), np.float32(1e-30))


def _log10_of(logits: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """log10 of the softmax at one column of each row."""
    own = logits[np.arange(len(logits)), chosen].astype(np.float64)
    np.exp(logits, out=logits)
    return (own - np.log(_total(logits).astype(np.float64))) / _LN10


def _error(logits: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """The loss's gradient by the logits: the softmax less 1 at the chosen column."""
    np.exp(logits, out=logits)
    logits *= (1 / _total(logits))[:, None]
    logits[np.arange(len(logits)), chosen] -= 1
    return logits


def _by_class(m: Model, klass: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(class, its tokens) of the classes of several nodes."""
    order = np.argsort(klass.astype(np.uint16), kind="stable")
    edges = np.searchsorted(klass[order], np.arange(m.sizes.classes + 1))
    for c in np.flatnonzero((np.diff(edges) > 0) & (m.highs - m.lows > 1)):
        yield c, order[edges[c]:edges[c + 1]]


def log_probabilities(m: Model, b: Batch) -> np.ndarray:
    """log10 P(class | context) * P(node | class, context) of every token."""
    out = np.empty(len(b.ids))
    for lo in range(0, len(b.ids), 1 << 13):
        s = slice(lo, lo + (1 << 13))
        out[s] = _log10_of(_class_logits(m, b.rows[:, s]), b.klass[s])
    for c, at in _by_class(m, b.klass):
        for lo in range(0, len(at), 1 << 12):
            part = at[lo:lo + (1 << 12)]
            out[part] += _log10_of(_node_logits(m, c, b.node_rows[:, part]), b.column[part] - m.lows[c])
    return out


def _sums(values: np.ndarray, order: np.ndarray, first: np.ndarray, times: np.ndarray, short: int = 64) -> np.ndarray:
    """Sums of ``values[order[first:first + times]]`` by falling ``times``: the few long runs one by one, the short
    ones together, a place of all of them at a time."""
    total = np.take(values, order[first], axis=0)
    long = int(np.searchsorted(-times, -short))  # runs of more than ``short``
    for k in range(long):
        total[k] = np.take(values, order[first[k]:first[k] + times[k]], axis=0).sum(axis=0)
    for j in range(1, short):
        end = int(np.searchsorted(-times, -j))
        if end > long:
            total[long:end] += np.take(values, order[first[long:end] + j], axis=0)
    return total


class Trainer:
    """A task's copy of the weights, with AdaGrad sums and the use of each row."""

    def __init__(self, model: Model):
        self.m = model
        self.start = model.by_class.copy(), model.by_node.copy()
        self.squares = np.ones_like(model.by_class), np.ones_like(model.by_node)
        self.used = np.zeros(len(model.by_class)), np.zeros(len(model.by_node))

    def _update(self, k: int, rows: np.ndarray, gradient: np.ndarray, lo: int, hi: int) -> None:
        """Add the gradients of equal rows up and step against them; ``rows`` repeats the gradient's length."""
        small = len(self.used[k]) <= 1 << 16  # then a radix sort
        order = np.argsort(rows.astype(np.uint16) if small else rows, kind="stable")
        ordered = rows[order]
        first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        times = np.diff(first, append=len(rows))
        by_times = np.argsort(-times, kind="stable")
        row, times = ordered[first[by_times]], times[by_times]
        total = _sums(gradient, order % len(gradient), first[by_times], times)
        weights, squares = (self.m.by_class, self.m.by_node)[k], self.squares[k]
        grown = squares[row, lo:hi]
        grown += total * total
        squares[row, lo:hi] = grown
        total *= RATE / np.sqrt(grown)
        weights[row, lo:hi] -= total
        self.used[k][row] += times

    def learn(self, b: Batch) -> None:
        m = self.m
        for lo in range(0, len(b.ids), MINIBATCH):
            s = slice(lo, lo + MINIBATCH)
            rows, klass = b.rows[:, s], b.klass[s]
            self._update(0, rows.ravel(), _error(_class_logits(m, rows), klass), 0, m.sizes.classes)
            for c, at in _by_class(m, klass):
                node_rows = b.node_rows[:, s][:, at]
                error = _error(_node_logits(m, c, node_rows), b.column[s][at] - m.lows[c])
                self._update(1, node_rows.ravel(), error, m.lows[c], m.highs[c])

    def changes(self, block: int = 1 << 14) -> Iterator[tuple[int, int, bytes, bytes]]:
        """(table, first row, changes as 16-bit floats, use) of blocks of rows that were used."""
        for k, now in enumerate((self.m.by_class, self.m.by_node)):
            step = max(1, block // max(1, now.shape[1]))
            for lo in range(0, len(now), step):
                use = self.used[k][lo:lo + step]
                if use.any():
                    moved = now[lo:lo + step] - self.start[k][lo:lo + step]
                    yield k, lo, moved.astype(np.float16).tobytes(), use.tobytes()


def _chunks(texts: pd.Series) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """Token ids of consecutive texts, about ``CHUNK`` tokens at a time: (first, end, ids)."""
    held, lo, size = [], 0, 0
    for k, text in enumerate(texts):
        held.append(token_ids(text))
        size += len(held[-1])
        if size >= CHUNK:
            yield lo, k + 1, held
            held, lo, size = [], k + 1, 0
    if held:
        yield lo, len(texts), held


def count_tokens(docs: DataFrame) -> DataFrame:
    """(token, n) of the texts of ``docs``; every task adds up what it reads before the shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, _, ids in _chunks(batch.text):
                token, n = np.unique(np.concatenate(ids), return_counts=True)
                yield pd.DataFrame({"token": token.view(np.int64), "n": n})

    return materialise(docs.select("text").mapInPandas(run, "token long, n long")
                       .groupBy("token").agg(F.sum("n").alias("n")), "lm-counts")


def layout(total: int, distinct: int, ids: np.ndarray, n: np.ndarray, ends: int, size: Sizes,
           tails: np.ndarray) -> Model:
    """The untrained model: ``ids`` and their counts ``n`` are the head's, by falling count; ``tails`` holds tokens
    and words of each child of the tail classes, the model's own words included."""
    # the end is one of the model's words
    at = np.flatnonzero(ids == END)
    ids, n = np.delete(ids, at), np.delete(n, at)
    where = min(size.words - 1, len(ids))
    if len(at) and at[0] < size.words:
        where = int(at[0])
    ids, n = np.insert(ids, where, np.uint64(END)), np.insert(n, where, ends)
    words = min(size.words, len(ids))
    # head classes: consecutive words of near-equal weight (square root of the count)
    weight = np.cumsum(np.sqrt(np.maximum(n[:words], 1)))
    klass = (weight - weight[0] / 2) / weight[-1] * size.head_classes
    klass = np.minimum(klass, size.head_classes - 1).astype(np.int64)
    klass[ids[:words] == END] = size.classes - 1
    order = np.argsort(klass, kind="stable")
    column = np.empty(words, np.int64)
    column[order] = np.arange(words)
    # tail classes: all words but the model's
    own = ids[:words][n[:words] > 0]
    child = (own & _TAIL) * np.uint64(size.children) + (own >> _TAIL_BITS & np.uint64(size.children - 1))
    tails = tails.copy()
    np.subtract.at(tails, child.astype(np.int64), np.stack([n[:words][n[:words] > 0], np.ones(len(own))], axis=1))
    in_class = np.zeros(size.classes)
    np.add.at(in_class, klass, n[:words])
    of_tails = tails.sum(axis=1)
    tail = slice(size.head_classes, size.head_classes + TAIL_CLASSES)
    in_class[tail] = of_tails.reshape(TAIL_CLASSES, -1).sum(axis=1)
    lows = np.searchsorted(klass[order], np.arange(size.classes))
    highs = np.searchsorted(klass[order], np.arange(size.classes), side="right")
    lows[tail] = words + np.arange(TAIL_CLASSES) * size.children
    highs[tail] = lows[tail] + size.children
    nodes = np.log(np.concatenate([np.maximum(n[:words][order], 1), of_tails + 1]))
    return Model(size, ids, n, total, distinct, np.log(in_class + 1), np.log10(of_tails + 1), klass, column, lows,
                 highs, nodes, np.zeros((size.rows, size.classes), np.float32),
                 np.zeros((size.word_rows, len(nodes)), np.float32))


def initial_model(counts: DataFrame) -> Model:
    """Class layout and priors from the count table; ``HEAD`` rows and one per child come to the driver."""
    total, distinct, ends = counts.agg(
        F.sum("n"), F.count(F.lit(1)), F.sum(F.when(F.col("token") == END, F.col("n")))).first()
    size = sizes(distinct)
    top = counts.orderBy(F.desc("n"), "token").limit(HEAD).toPandas()
    tails = np.zeros((TAIL_CLASSES * size.children, 2))
    low = F.col("token").bitwiseAND(F.lit(TAIL_CLASSES * size.children - 1))
    for r in counts.groupBy(low.alias("low")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        tails[r.low % TAIL_CLASSES * size.children + r.low // TAIL_CLASSES] = r.n, r.v
    return layout(int(total or 0), int(distinct), top.token.to_numpy(np.int64).view(np.uint64),
                  top.n.to_numpy(np.int64), int(ends or 0), size, tails)


def train(docs: DataFrame, model: Model) -> Model:
    """The model after a pass over ``docs`` (row_id, text)."""
    spark = docs.sparkSession
    tasks = -(-max(1, model.total) // (ROUNDS * TASK_TOKENS))
    for turn in range(ROUNDS):

        def run(batches: Iterator[pd.DataFrame], model: Model = model) -> Iterator[pd.DataFrame]:
            trainer, reader = Trainer(model), Reader(model)
            for batch in batches:
                for _, _, ids in _chunks(batch.text):
                    trainer.learn(reader.read(ids))
            yield pd.DataFrame(trainer.changes(), columns=["k", "first", "moved", "used"])

        def added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            key, moved, used = None, None, None
            for batch in batches:
                for k, first, m, u in zip(batch.k, batch["first"], batch.moved, batch.used):
                    u = np.frombuffer(u)
                    m = np.frombuffer(m, np.float16).reshape(len(u), -1) * u[:, None]
                    if (k, first) == key:
                        moved, used = moved + m, used + u
                        continue
                    if key:
                        yield pd.DataFrame([(*key, moved.tobytes(), used.tobytes())], columns=batch.columns)
                    key, moved, used = (k, first), m, u
            if key:
                yield pd.DataFrame([(*key, moved.tobytes(), used.tobytes())], columns=["k", "first", "moved", "used"])

        form = "k int, first int, moved binary, used binary"
        part = docs.where(F.pmod(F.xxhash64("text"), F.lit(ROUNDS)) == turn).coalesce(tasks)
        sums = part.select("text").mapInPandas(run, form).repartition(partitions(spark), "k", "first") \
            .sortWithinPartitions("k", "first").mapInPandas(added, form)
        for r in sums.collect():  # as large as the model
            table = (model.by_class, model.by_node)[r.k]
            used = np.frombuffer(r.used)
            moved = np.frombuffer(r.moved).reshape(len(used), -1) / np.maximum(used, 1)[:, None]
            table[r.first:r.first + len(used)] += moved.astype(np.float32)
    return model


_SCORED = ("doc_id long, no_id boolean, row_id long, held_out boolean, n_tokens long, n_known long, "
           "base_score double, score double, rare array<long>, times array<int>")


def score(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """Scores of ``docs`` (doc_id, no_id, row_id, held_out, text)."""
    columns = [f.name for f in schema(_SCORED)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, reader = model, Reader(model)
        # by rank; the last entry is read for words outside the head (rank -1)
        head_log, head_known = np.append(np.log10(m.head_counts + 1), 0.0), np.append(m.head_counts > 0, False)
        for batch in batches:
            for lo, hi, ids in _chunks(batch.text):
                b = reader.read(ids)
                n = hi - lo
                own = head_log[b.rank]
                model_log = log_probabilities(m, b)
                tail = b.child >= 0
                model_log[tail] += own[tail] - m.tail_log10[b.child[tail]]
                total = lambda x: np.bincount(b.doc, x, minlength=n)
                rare = np.flatnonzero(b.rank < 0)
                rare = rare[np.argsort(b.ids[rare])]
                doc = b.doc[rare]
                order = rare[np.argsort(doc.astype(np.uint16) if n <= 1 << 16 else doc, kind="stable")]
                doc, token = b.doc[order], b.ids[order].view(np.int64)
                first = np.flatnonzero(np.diff(doc, prepend=-1) | np.diff(token, prepend=0)) if len(order) else order
                times = np.diff(first, append=len(order)).astype(np.int32)
                edges = np.searchsorted(doc[first], np.arange(n + 1))
                part = batch.iloc[lo:hi]
                out = part[["doc_id", "no_id", "row_id", "held_out"]].assign(
                    n_tokens=np.bincount(b.doc, minlength=n), n_known=total(head_known[b.rank]).astype(np.int64),
                    base_score=total(own - m.floor), score=total(model_log),
                    rare=[token[first[x:y]] for x, y in zip(edges, edges[1:])],
                    times=[times[x:y] for x, y in zip(edges, edges[1:])])
                yield out[columns]

    scored = materialise(docs.mapInPandas(run, _SCORED), "lm-scores")
    more = scored.select("row_id", F.explode(F.arrays_zip("rare", "times")).alias("r")) \
        .select("row_id", F.col("r.rare").alias("token"), F.col("r.times").alias("times")) \
        .join(counts, "token").groupBy("row_id").agg(
            F.sum("times").alias("more_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more_log"))
    out = scored.drop("rare", "times").join(more, "row_id", "left")
    log = F.coalesce("more_log", F.lit(0.0))
    return restored(out).select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"), (F.col("base_score") + log).alias("base_score"),
        (F.col("score") + log).alias("score"))


def score_corpus(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows scored by a model that learnt from those that are not ``held_out`` (a condition on doc_id)."""
    rows = identified(docs, id_col, text_col)
    real_id = F.when(~F.col("no_id"), F.col("doc_id"))
    rows = rows.withColumn("given", F.col("doc_id")).withColumn("doc_id", real_id) \
        .withColumn("held_out", held_out).withColumn("doc_id", F.col("given")).drop("given")
    training = rows.where(~F.col("held_out"))
    counts = count_tokens(training)
    model = train(training, initial_model(counts))
    return score(rows, model, counts)
