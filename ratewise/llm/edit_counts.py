"""Token counts that follow edits.

A document keeps the pre-tokens of its text in the leaves of a segment tree;
every node holds the characters and tokens below it.  An edit descends by
characters to the place it touches, splits only the text around it into
pre-tokens again (from two pre-tokens before, until the new split meets an old
boundary), encodes only the pre-tokens that are new, and updates the sums on
the way to the root.

Why this gives the counts of a full encoding: byte-level BPE encodes each
pre-token by itself, and the split pattern, read from a boundary on, depends only
on the text after it; a pre-token is decided by its characters and at most two
that follow.  So pre-tokens that end two characters or more before an edit stay,
and once a boundary of the new split meets an old one behind the edit, all after
it stays.

Defined cases: NULL texts are empty; edits beyond the text are moved to its end,
negative starts to its beginning, NULL replacements are empty, NULL edits are
skipped; without edits both counts are equal; repeated rows and ids are counted
row by row; very long texts are one tree; extra columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratewise.llm import bpe
from ratewise.llm.common import col, restored, schema, ship

LEAF = 32
CACHE = 400_000
_OUT = ("doc_id long, no_id boolean, n_tokens long, n_tokens_edited long, n_chars_edited long, n_pretokens long, "
        "n_resplit long, edited_sha256 string")


class Counter:
    """Tokens of pre-tokens, remembered up to a bounded number of them."""

    def __init__(self, tokenizer: str):
        import public_tokenizers
        self.encoder = bpe.encoder(tokenizer)
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.known: dict[str, int] = {}

    def split(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def counts(self, pretokens: list[str]) -> list[int]:
        known = self.known
        if len(known) > CACHE:
            known.clear()
        out = []
        for p in pretokens:
            n = known.get(p)
            if n is None:
                n = known[p] = self.encoder.count(p)
            out.append(n)
        return out


class SegmentTree:
    """Pre-tokens of one text in leaves of about ``LEAF``, with sums of characters and tokens."""

    def __init__(self, counter: Counter, text: str):
        self.counter = counter
        self.resplit = 0
        self._build(counter.split(text))

    def _build(self, pretokens: list[str]) -> None:
        n = max(1, -(-len(pretokens) // LEAF))
        self.width = 1 << (n - 1).bit_length()
        self.leaves = [pretokens[k:k + LEAF] for k in range(0, len(pretokens), LEAF)]
        self.leaves += [[] for _ in range(self.width - len(self.leaves))]
        counts = self.counter.counts(pretokens)
        self.chars = [0] * (2 * self.width)
        self.tokens = [0] * (2 * self.width)
        for k, leaf in enumerate(self.leaves):
            self.chars[self.width + k] = sum(map(len, leaf))
            self.tokens[self.width + k] = sum(counts[k * LEAF:(k + 1) * LEAF])
        for node in range(self.width - 1, 0, -1):
            self._sum(node)

    def _sum(self, node: int) -> None:
        self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
        self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    def _set(self, leaf: int, pretokens: list[str]) -> None:
        """Replace a leaf and update its subtree sums up to the root."""
        self.leaves[leaf] = pretokens
        node = self.width + leaf
        self.chars[node] = sum(map(len, pretokens))
        self.tokens[node] = sum(self.counter.counts(pretokens))
        while node > 1:
            node >>= 1
            self._sum(node)

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    def text(self) -> str:
        return "".join(p for leaf in self.leaves for p in leaf)

    def _find(self, place: int) -> tuple[int, int, int]:
        """(leaf, index, start) of the pre-token that holds the character ``place``, or the text's end."""
        node, before = 1, 0
        while node < self.width:
            node *= 2
            if place >= before + self.chars[node] and self.chars[node + 1]:
                before += self.chars[node]
                node += 1
        leaf = node - self.width
        for index, p in enumerate(self.leaves[leaf]):
            if place < before + len(p):
                return leaf, index, before
            before += len(p)
        return leaf, len(self.leaves[leaf]), before

    def _back(self, leaf: int, index: int, steps: int) -> tuple[int, int, int]:
        """The place ``steps`` pre-tokens before (or the first), and the characters in between."""
        moved = 0
        while steps:
            while not index:
                if not leaf:
                    return leaf, 0, moved
                leaf -= 1
                index = len(self.leaves[leaf])
            index -= 1
            moved += len(self.leaves[leaf][index])
            steps -= 1
        return leaf, index, moved

    def _from(self, leaf: int, index: int) -> Iterator[tuple[int, int, str]]:
        """(leaf, index after it, pre-token) onwards."""
        while leaf < self.width:
            row = self.leaves[leaf]
            while index < len(row):
                index += 1
                yield leaf, index, row[index - 1]
            leaf, index = leaf + 1, 0

    def edit(self, start: int, length: int, insert: str) -> None:
        """Replace ``length`` characters from ``start`` on by ``insert``."""
        start = min(max(start, 0), self.n_chars)
        length = min(max(length, 0), self.n_chars - start)
        if not length and not insert:
            return
        leaf, index, at = self._find(start)
        first_leaf, first_index, moved = self._back(leaf, index, 2)
        origin = at - moved
        head = start - origin  # characters kept before the edit
        old, ends, begin = "", [], origin
        rest = self._from(first_leaf, first_index)
        wanted, done = 8, False
        stop = (first_leaf, first_index)
        while True:
            parts = []
            for stop_leaf, stop_index, p in rest:
                stop = (stop_leaf, stop_index)
                parts.append(p)
                begin += len(p)
                ends.append((begin - origin, stop))
                if begin >= start + length and len(parts) >= wanted:
                    break
            else:
                done = True
            old += "".join(parts)
            new_text = old[:head] + insert + old[head + length:]
            split = self.counter.split(new_text)
            shift = len(insert) - length
            # old boundaries behind the edit, where the new split may meet them
            boundary = {end + shift: where for end, where in ends if end >= head + length}
            place, keep, meet = 0, 0, None
            for keep, p in enumerate(split, 1):
                place += len(p)
                if place >= head + len(insert) and place in boundary and place + 2 <= len(new_text):
                    meet = boundary[place]
                    break
            if meet:
                split = split[:keep]
                break
            if done:
                meet = stop
                break
            wanted *= 2
        self.resplit += len(split)
        last_leaf, last_index = meet
        tail = self.leaves[last_leaf][last_index:]
        for k in range(first_leaf + 1, last_leaf + 1):
            self._set(k, [])
        self._set(first_leaf, self.leaves[first_leaf][:first_index] + split + tail)
        if len(self.leaves[first_leaf]) > 8 * LEAF:
            self._build([p for row in self.leaves for p in row])


def count_edits(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text",
                edits_col: str = "edits") -> DataFrame:
    """Token counts of each text before and after its edits, which apply one after the other.

    ``edits_col`` is an array of structs (start, length, insert); starts are
    places in the text as the edits before have left it.  No shuffle.
    """
    tokenizer = tokenizer or bpe.default_path()
    ship(docs.sparkSession)
    columns = [f.name for f in schema(_OUT)]
    edits = F.transform(F.filter(F.coalesce(col(edits_col), F.array()), lambda e: e.isNotNull()), lambda e: F.struct(
        F.coalesce(e["start"].cast("long"), F.lit(0).cast("long")), F.coalesce(e["length"].cast("long"), F.lit(0).cast("long")),
        F.coalesce(e["insert"], F.lit(""))))
    given = col(id_col).cast("long")
    rows = docs.select(F.coalesce(given, F.lit(0).cast("long")).alias("doc_id"), given.isNull().alias("no_id"),
                       col(text_col).alias("text"), F.to_json(edits).alias("edits"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json
        counter = Counter(tokenizer)
        for batch in batches:
            out = []
            for doc_id, no_id, text, edits in zip(batch.doc_id, batch.no_id, batch.text, batch.edits):
                tree = SegmentTree(counter, (text or "").encode("utf-8", "replace").decode())
                before, n = tree.n_tokens, sum(map(len, tree.leaves))
                for e in json.loads(edits):
                    tree.edit(*e.values())
                edited = tree.text()
                out.append((doc_id, no_id, before, tree.n_tokens, tree.n_chars, n, tree.resplit,
                            hashlib.sha256(edited.encode()).hexdigest()))
            yield pd.DataFrame(out, columns=columns)

    return restored(rows.mapInPandas(run, _OUT))


def with_edits(docs: DataFrame, edits: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with an array column ``edits`` from rows (doc_id, seq, start, length, insert) of ``edits``."""
    own = edits.groupBy(F.col("doc_id").alias("_edited")).agg(
        F.sort_array(F.collect_list(F.struct("seq", "start", "length", "insert"))).alias("edits"))
    return docs.join(own, col(id_col) == F.col("_edited"), "left").drop("_edited")


def sample_edits(text: str = "text", doc_id: str = "doc_id"):
    """Three edits of a text as a column: its first 16 characters again at a quarter, 24 characters
    taken out in the middle, and 8 replaced by the id at three quarters."""
    n = F.coalesce(F.length(col(text)), F.lit(0)).cast("long")

    def edit(start, length, insert):
        return F.struct(start.cast("long").alias("start"), F.lit(length).cast("long").alias("length"),
                        insert.alias("insert"))
    return F.array(edit(F.floor(n / 4), 0, F.substring(F.coalesce(col(text), F.lit("")), 1, 16)),
                   edit(F.floor(n / 2), 24, F.lit("")),
                   edit(F.floor(n * 3 / 4), 8, F.concat(F.lit(" "), F.coalesce(col(doc_id).cast("string"), F.lit("")))))
