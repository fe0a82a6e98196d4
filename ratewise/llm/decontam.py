"""Benchmark decontamination by pigeonhole edit matching.

A document holds a test item if some part of its text is within the item's
error budget of edits (insertions, deletions, substitutions).  The budget is one
edit for every ``PER_EDIT`` characters.  An item is split into budget + 1 pieces
of near-equal length; an occurrence with at most that many edits leaves one
piece untouched, so all occurrences lie around exact piece hits.  One automaton
finds the hits of all pieces in a pass over a text, and Myers' bit-parallel
distance decides around each hit.

Texts are compared lower-cased with runs of white space as one space.  The items
are used in blocks of about ``BLOCK_CHARS`` characters, one after the other (each
one's rows are written before the next begins), so what is sent to the tasks is
bounded for any number of items; documents are never shuffled.

Defined cases: NULL and empty texts hold nothing, NULL and empty items are held
by nothing; repeated documents and items each count; extra columns are ignored;
empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratewise.llm.common import col, materialise, pick, ship

PER_EDIT = 14
BLOCK_CHARS = 2_000_000
_MATCH = "array<struct<item_id: bigint, distance: int, start: bigint, end: bigint>>"


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def budget(item: str, per_edit: int = PER_EDIT) -> int:
    return len(item) // per_edit


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """(start, piece) of ``errors`` + 1 consecutive pieces."""
    n = errors + 1
    edges = [k * len(item) // n for k in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(edges, edges[1:]) if b > a]


class Pattern:
    """Myers' automaton of one pattern: a column of the distance table in two bit vectors."""

    def __init__(self, text: str):
        self.length = len(text)
        self.bits: dict[str, int] = {}
        for i, c in enumerate(text):
            self.bits[c] = self.bits.get(c, 0) | 1 << i

    def best_end(self, text: str, most: int) -> tuple[int, int] | None:
        """(distance, end) of the best occurrence in ``text`` with at most ``most`` edits, the first of equal ones."""
        full, top = (1 << self.length) - 1, 1 << self.length - 1
        plus, minus, distance, best = full, 0, self.length, None
        get = self.bits.get
        for j, c in enumerate(text, 1):
            equal = get(c, 0)
            across = equal | minus
            down = ((equal & plus) + plus ^ plus) | equal
            up = minus | ~(down | plus) & full
            drop = plus & down
            if up & top:
                distance += 1
            elif drop & top:
                distance -= 1
                if distance <= most:
                    best, most = (distance, j), distance - 1
                    if not distance:
                        break
            up = up << 1 & full
            plus = drop << 1 & full | ~(across | up) & full
            minus = up & across
        return best


class Matcher:
    """Finds the items of a block in texts."""

    def __init__(self, items: list[tuple[int, str]], per_edit: int):
        self.items = [(item_id, text, budget(text, per_edit)) for item_id, text in items]
        self.forward = [None] * len(items)
        where: dict[str, list[tuple[int, int]]] = {}
        for k, (_, text, errors) in enumerate(self.items):
            for start, piece in pieces(text, errors):
                where.setdefault(piece, []).append((k, start))
        self.automaton = ahocorasick.Automaton()
        for piece, at in where.items():
            self.automaton.add_word(piece, (len(piece), at))
        if where:
            self.automaton.make_automaton()

    def find(self, raw: str | None) -> list[tuple[int, int, int, int]]:
        """(item_id, distance, start, end) in the normal form of a text: each item's best occurrence."""
        text = normal(raw)
        if not text or not len(self.automaton):
            return []
        diagonals: dict[int, set[int]] = {}
        for end, (length, at) in self.automaton.iter(text):
            for k, start in at:
                diagonals.setdefault(k, set()).add(end + 1 - length - start)
        out = []
        for k, found in diagonals.items():
            best = self._verify(k, text, sorted(found))
            if best:
                out.append((self.items[k][0], *best))
        return sorted(out)

    def _verify(self, k: int, text: str, diagonals: list[int]) -> tuple[int, int, int] | None:
        _, item, errors = self.items[k]
        for d in diagonals:
            if d >= 0 and text.startswith(item, d):
                return 0, d, d + len(item)
        if not errors:
            return None
        if self.forward[k] is None:
            self.forward[k] = Pattern(item), Pattern(item[::-1])
        ahead, back = self.forward[k]
        best: tuple[int, int] | None = None
        lo = hi = None
        windows = []
        for d in diagonals:  # hits on near diagonals share a window
            a, b = max(0, d - errors), min(len(text), d + len(item) + errors)
            if hi is not None and a <= hi:
                hi = max(hi, b)
            else:
                if hi is not None:
                    windows.append((lo, hi))
                lo, hi = a, b
        windows.append((lo, hi))
        for a, b in windows:
            found = ahead.best_end(text[a:b], best[0] - 1 if best else errors)
            if found:
                best = found[0], a + found[1]
                if not best[0]:
                    break
        if best is None:
            return None
        distance, end = best
        start = max(0, end - len(item) - distance)
        return distance, end - back.best_end(text[start:end][::-1], distance)[1], end


def item_blocks(items: DataFrame, id_col: str = "item_id", text_col: str = "text",
                block_chars: int = BLOCK_CHARS) -> Iterator[tuple[list[tuple[int, str]], bool]]:
    """(items, whether there are more blocks than one) of each block of about ``block_chars``
    characters, read by a job of its own, so the driver holds one at a time."""
    rows = pick(items, item_id=id_col, text=text_col).where("item_id is not null and text is not null")
    total = rows.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    n = total // block_chars + 1
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for k in range(n):
        found = [(int(r.item_id), normal(r.text)) for r in rows.where(block == k).collect()]
        yield sorted(x for x in found if x[1]), n > 1


def matches(text: Column, block: list[tuple[int, str]], per_edit: int = PER_EDIT) -> Column:
    """The items of a block that each text holds, as an array of structs."""
    held: list[Matcher] = []

    @F.pandas_udf(_MATCH)
    def run(texts: pd.Series) -> pd.Series:
        if not held:
            held.append(Matcher(block, per_edit))
        return pd.Series([[{"item_id": i, "distance": d, "start": a, "end": b} for i, d, a, b in held[0].find(t)]
                          for t in texts])

    return run(text)


def find_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               item_id_col: str = "item_id", item_text_col: str = "text", per_edit: int = PER_EDIT,
               block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, distance, start, end) for each document row and item that it holds;
    start and end are places in the text's normal form."""
    ship(docs.sparkSession)
    found = []
    for block, several in item_blocks(items, item_id_col, item_text_col, block_chars):
        rows = pick(docs, doc_id=id_col, text=text_col) \
            .select("doc_id", F.explode(matches(F.col("text"), block, per_edit)).alias("m")).select("doc_id", "m.*")
        found.append(materialise(rows, "decontam-found") if several else rows)
    return reduce(DataFrame.unionByName, found)


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id_col: str = "item_id",
          item_text_col: str = "text", per_edit: int = PER_EDIT, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no item."""
    ship(docs.sparkSession)
    for block, several in item_blocks(items, item_id_col, item_text_col, block_chars):
        docs = docs.where(F.size(matches(col(text_col), block, per_edit)) == 0)
        docs = materialise(docs, "decontam-clean") if several else docs
    return docs
