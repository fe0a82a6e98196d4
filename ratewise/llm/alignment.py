"""Alignment of the tokens that two tokenizers give for one text.

Tokens are byte ranges of the same bytes.  Every token points to the token
farthest to the right among those that overlap it (of two that end together, the
second tokenizer's); pointers are doubled, ``next = next[next]`` over all tokens
of a block of documents at once, until nothing changes.  Each token then points to
the last token of its component, which ends where a token of the other kind ends
too: the components are the groups, and the two last tokens of a group are a link.

How often a pair of ids is linked is a count over the corpus.  A block of texts is
tokenized once; its groups' digests and its links, as places in the block's list
of distinct pairs, are written.  Distinct pairs are counted with their numbers per
block; their corpus-wide counts come back to the block, which adds them up per
document.  No table of the size of the vocabularies is broadcast or collected.

Memory: a Python worker holds the arrays of one block.  A block is written as many
rows, each of a few of its documents or of a part of its list of pairs, in short row
groups, so that Parquet's writer and reader, which count rows before they look at
bytes, hold a few MB of them at once.  A row exceeds its limit only by its last document.

Defined cases: NULL and empty texts, and texts that one of the tokenizers can't
give back byte by byte, have no tokens (zeros, empty digest); strings of special
tokens are plain text; texts of any length are aligned whole; repeated rows and
ids get a row each and all count; NULL ids stay NULL; other columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratewise.llm import bpe
from ratewise.llm.common import identified, materialise, restored, schema

#: Size of text, and of what is kept of each document, after which a block is closed.
BLOCK_BYTES = 1 << 20
#: Bytes after which a row of a block is closed.
ROW_BYTES = 1 << 16
#: Bytes that a row keeps of a document besides its links.
_DOC_BYTES = 128
#: Row groups of a few MB, whose size is looked at from the first row on (else from the hundredth).
_FILES = {"parquet.block.size": str(8 << 20), "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1"}
_SHIFT = 32
_BLOCK = ("block long, doc_ids array<long>, no_ids array<boolean>, n_a array<long>, n_b array<long>, n_groups array<long>, "
          "digests array<string>, links binary, pairs binary, times binary")
_OUT = ("doc_id long, no_id boolean, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
        "groups_sha256 string")


def _names(columns: str) -> list[str]:
    """The names in a list of columns with their types; Python tasks have no session that parses it."""
    return [c.split()[0] for c in columns.split(", ")]


def default_pieces() -> str:
    """The installed public piece vocabulary."""
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


class Tokenizers:
    """Both tokenizers with the bytes of each of their ids."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        self.a = bpe.encoder(a_path)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        with open(a_path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = bpe._byte_of_char()
        entries = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.a_bytes = [b""] * (max(entries.values()) + 1)
        for token, i in entries.items():
            self.a_bytes[i] = bytes(byte_of[c] for c in token)
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.a_length, self.b_length = (np.array([len(t) for t in table]) for table in (self.a_bytes, self.b_bytes))
        # each id as text with what follows it: inside its group, or as its side's last
        names = [np.array([f"{i}{c}" for c in (",", end) for i in range(len(table))], object)
                 for table, end in ((self.a_bytes, "|"), (self.b_bytes, ";"))]
        self.a_names, self.b_names = names

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of both; none where the tokens' bytes aren't those of the text behind a blank."""
        none = np.empty(0, np.int64), np.empty(0, np.int64)
        if not text:
            return none
        whole = (" " + text).encode("utf-8", "replace")
        a = self.a.ids(" " + text).tolist()
        b = self.b.encode(text, num_threads=1)
        if b"".join([self.a_bytes[i] for i in a]) != whole or b"".join([self.b_bytes[i] for i in b]) != whole:
            return none
        return np.array(a, np.int64), np.array(b, np.int64)


@lru_cache(maxsize=2)
def tokenizers(a_path: str, b_path: str) -> Tokenizers:
    """One pair of tokenizers per Python worker."""
    return Tokenizers(a_path, b_path)


def terminals(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token of both sides the place, on the second side, of its component's last token.

    The ends are those of two splits of the same bytes into tokens.
    """
    n = len(a_ends)
    a_starts, b_starts = (np.append(0, e[:-1]) if len(e) else e for e in (a_ends, b_ends))
    # the last token of the other side that starts before this one ends reaches farthest
    to_b = np.searchsorted(b_starts, a_ends, "left") - 1
    to_a = np.searchsorted(a_starts, b_ends, "left") - 1
    own = np.arange(len(b_ends)) + n
    nxt = np.concatenate([to_b + n, np.where(a_ends[to_a] > b_ends, to_a, own)]) if n else np.empty(0, np.int64)
    while True:
        further = nxt[nxt]
        if np.array_equal(further, nxt):
            return nxt[:n] - n, nxt[n:] - n
        nxt = further


class Aligned:
    """The groups and links of a block of texts."""

    def __init__(self, both: Tokenizers, texts: list[str | None]):
        found = [both.encode(t) for t in texts]
        a, b = (np.concatenate([f[k] for f in found]) if found else np.empty(0, np.int64) for k in (0, 1))
        self.n_a, self.n_b = (np.array([len(f[k]) for f in found], np.int64) for k in (0, 1))
        a_ends, b_ends = np.cumsum(both.a_length[a]), np.cumsum(both.b_length[b])
        a_last, b_last = terminals(a_ends, b_ends)
        is_last = b_last == np.arange(len(b))
        group = np.cumsum(is_last) - 1
        a_group, b_group = group[a_last], group[b_last]
        ends = np.flatnonzero(is_last)
        a_is_last = np.append(a_group[1:] != a_group[:-1], True) if len(a) else np.empty(0, bool)
        #: ids of the linked tokens, one link per group
        self.link_a, self.link_b = a[a_is_last], b[ends]
        self.n_groups = self._per_text(b_group, self.n_b)
        # a group's tokens stand together, the first side's before the second's
        first_b = np.append(0, ends + 1)
        first_a = np.append(0, np.flatnonzero(a_is_last) + 1)
        names = np.empty(len(a) + len(b), object)
        names[np.arange(len(a)) + first_b[a_group]] = both.a_names[a + a_is_last * len(both.a_bytes)]
        names[np.arange(len(b)) + first_a[b_group + 1]] = both.b_names[b + is_last * len(both.b_bytes)]
        edges = np.append(0, np.cumsum(self.n_a + self.n_b))
        self.digests = ["" if lo == hi else hashlib.sha256("".join(names[lo:hi].tolist())[:-1].encode()).hexdigest()
                        for lo, hi in zip(edges, edges[1:])]

    @staticmethod
    def _per_text(groups: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        edges = np.append(0, np.cumsum(lengths))
        before = np.append(0, groups + 1)[edges]
        return np.diff(before)


def _places(n_pairs: int) -> str:
    """The type of a place in a list of so many pairs."""
    return "<u2" if n_pairs <= 1 << 16 else "<u4"


def _block_rows(both: Tokenizers, held: list[tuple]) -> pd.DataFrame:
    """The rows of a block of (doc_id, no_id, row_id, text): its documents', then those of its distinct pairs."""
    found = Aligned(both, [r[3] for r in held])
    pairs, links, times = np.unique((found.link_a << _SHIFT) | found.link_b, return_inverse=True, return_counts=True)
    links = links.astype(_places(len(pairs)))
    edges = np.append(0, np.cumsum(found.n_groups))
    # a row ends with the document that brings it over the limit
    before = edges[:-1] * links.itemsize + np.arange(len(held)) * _DOC_BYTES
    starts = np.flatnonzero(np.diff(before // ROW_BYTES, prepend=-1))
    block, rows = held[0][2], []
    for lo, hi in zip(starts, np.append(starts[1:], len(held))):
        rows.append((block, [r[0] for r in held[lo:hi]], [r[1] for r in held[lo:hi]], found.n_a[lo:hi], found.n_b[lo:hi],
                     found.n_groups[lo:hi], found.digests[lo:hi], links[edges[lo]:edges[hi]].tobytes(), None, None))
    step = ROW_BYTES // 16
    for lo in range(0, len(pairs), step):
        rows.append((block, [], [], [], [], [], [], None,
                     *(x[lo:lo + step].astype("<i8").tobytes() for x in (pairs, times))))
    return pd.DataFrame(rows, columns=_names(_BLOCK))


def aligned_blocks(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """The rows of all blocks of texts: some documents' numbers and their links as places in the
    block's list of distinct pairs, or (no documents, no links) a part of that list."""

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[list]:
        held, size = [], 0
        for batch in batches:
            for row in zip(batch.doc_id, batch.no_id, batch.row_id, batch.text):
                held.append(row)
                size += len(row[3] or "") + _DOC_BYTES
                if size > BLOCK_BYTES:
                    yield held
                    held, size = [], 0
        if held:
            yield held

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        both = tokenizers(a_path, b_path)
        for held in blocks(batches):
            yield _block_rows(both, held)
            held.clear()

    return identified(docs, id_col, text_col).mapInPandas(run, schema(_BLOCK))


def block_pairs(blocks: DataFrame) -> DataFrame:
    """(block, pair, n): the distinct id pairs of each block and how often the block links them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block, pairs, times in zip(batch.block, batch.pairs, batch.times):
                yield pd.DataFrame({"block": block, "pair": np.frombuffer(pairs, "<i8"), "n": np.frombuffer(times, "<i8")})

    return blocks.where("pairs IS NOT NULL").select("block", "pairs", "times") \
        .mapInPandas(run, schema("block long, pair long, n long"))


def pair_counts(pairs: DataFrame) -> DataFrame:
    """(pair, n, best): corpus-wide counts; ``best`` where no pair of the same second id has more."""
    second = F.col("pair").bitwiseAND((1 << _SHIFT) - 1)
    return pairs.groupBy("pair").agg(F.sum("n").alias("n")) \
        .withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy(second)))


def _score(blocks: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
    """Sums of one block's documents from the counts of its distinct pairs."""
    counts = counts.sort_values("pair")  # as the block's own list is
    n, best = (counts[c].to_numpy(np.int64) for c in ("n", "best"))
    columns = {c: np.concatenate(blocks[many].tolist())
               for c, many in (("doc_id", "doc_ids"), ("no_id", "no_ids"), ("n_a", "n_a"), ("n_b", "n_b"),
                               ("n_groups", "n_groups"), ("groups_sha256", "digests"))}
    links = np.frombuffer(b"".join(blocks.links), _places(len(counts)))
    edges = np.append(0, np.cumsum(columns["n_groups"].astype(np.int64)))
    sums = {c: np.diff(np.append(0, np.cumsum(x[links]))[edges]) for c, x in (("n_best", best), ("count_sum", n))}
    return pd.DataFrame(columns | sums | {"n_links": columns["n_groups"]})[_names(_OUT)]


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """Groups and links of every text under two tokenizers, and the links' corpus-wide counts.

    ``a_path``: a byte-level BPE file; ``b_path``: a piece model that puts a blank before a text.
    """
    blocks = materialise(aligned_blocks(docs, a_path or bpe.default_path(), b_path or default_pieces(), id_col, text_col),
                         "alignment-blocks", **_FILES)
    pairs = block_pairs(blocks)
    counts = materialise(pair_counts(pairs), "alignment-pairs")
    known = pairs.select("block", "pair").join(counts, "pair")
    scored = blocks.where("links IS NOT NULL").drop("pairs", "times").groupBy("block").cogroup(known.groupBy("block")) \
        .applyInPandas(_score, schema(_OUT))
    return restored(scored)


def group_texts(text: str, a_path: str | None = None, b_path: str | None = None) -> list[tuple[list[bytes], list[bytes]]]:
    """The groups of one text as the tokens' bytes, for looking at."""
    both = tokenizers(a_path or bpe.default_path(), b_path or default_pieces())
    a, b = both.encode(text)
    a_last, b_last = terminals(np.cumsum(both.a_length[a]), np.cumsum(both.b_length[b]))
    return [([both.a_bytes[i] for i in a[a_last == t]], [both.b_bytes[i] for i in b[b_last == t]])
            for t in np.unique(b_last)]
