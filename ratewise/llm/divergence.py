"""How the term use of the sources of a language differs: run-length columns.

Every source of a language is a column of counts over the language's kept terms.
The vocabulary is dealt into slices of terms of like total count; a slice is put
into an order that brings equal counts together, and each column becomes runs of
equal counts.  Two columns are compared by intersecting their run boundaries:
the difference of the two shares is taken once per common run and multiplied by
its length, so the work of a pair follows the runs and not the vocabulary.

A share is ``p = 1 + floor(10**9 * (count + 5) / (N + 5 * V))`` in whole numbers:
N occurrences of the V kept terms in the column.  Exact for N + 5 V under
9 * 10**15.

One pass over the texts counts terms per task and sends the counts, no texts.
A slice holds about ``SLICE`` entries and a task those of two blocks of ``BLOCK``
sources of it, whatever the corpus; a pair's slices are added up afterwards.  Joins
on a language or a source spread its words by term first (``_spread_join``).

Defined cases: NULL text, lang and source are ''; a document without terms makes
its (lang, source) group known all the same; repeated rows and ids are documents
of their own; a language without kept terms gives its pairs the value 0; a
language with one source has no pairs; an empty table gives no rows; texts of any
length are read whole; other columns are not looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratewise.llm.common import col, materialise, partitions, schema, ship

MIN_DOCS = 30
TOP_TERMS = 50
UNIT = 1_000_000_000
PRIOR = 5
#: Entries (terms and sources) of a slice, about: frequent terms are in many sources and make slices of fewer terms.
SLICE = 8192
BLOCK = 32
#: Entries that a task counts up before it sends them on.
HELD = 400_000

#: A-Z lower-cased, all other ASCII but a-z turned into blanks: what is left between blanks are the terms.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """Runs of letters A-Z and characters beyond ASCII, A-Z lower-cased, as UTF-8."""
    return (text or "").encode("utf-8", "replace").translate(_TERM_BYTES).split(b" ") if text else []


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source",
                text_col: str = "text") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents, partial per task.

    The term '' counts the group's documents, so a group without terms is there too.
    """
    ship(docs.sparkSession)
    given = docs.select(*[F.coalesce(col(c).cast("string"), F.lit("")).alias(n) for n, c in
                          (("lang", lang_col), ("source", source_col), ("text", text_col))])

    def flushed(held: dict) -> pd.DataFrame:
        rows = [(lang, source, term.decode(), n, seen[term]) for (lang, source), (count, seen) in held.items()
                for term, n in count.items()]
        return pd.DataFrame(rows, columns=["lang", "source", "term", "n", "docs"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = {}, 0
        for batch in batches:
            for lang, source, text in zip(batch.lang, batch.source, batch.text):
                count, seen = held.setdefault((lang, source), (Counter({b"": 0}), Counter()))
                found = Counter(terms(text))
                found[b""] = 0
                before = len(count)
                count.update(found)
                seen.update(found.keys())
                size += len(count) - before
                if size > HELD:
                    yield flushed(held)
                    held, size = {}, 0
        if held:
            yield flushed(held)

    return given.mapInPandas(run, schema("lang string, source string, term string, n long, docs long"))


def kept_counts(partial: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, source, term, n, lang_n, first): the kept terms' counts, and a row with term '' per group.

    ``first`` marks one row of each (lang, term).  One shuffle serves the sum and
    the windows.
    """
    whole = partial.repartition("lang", "term").groupBy("lang", "source", "term").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    return whole.withColumn("lang_n", F.sum("n").over(of_term)).withColumn("lang_docs", F.sum("docs").over(of_term)) \
        .withColumn("first", F.row_number().over(of_term.orderBy("source")) == 1) \
        .where((F.col("term") == "") | (F.col("lang_docs") >= min_docs)) \
        .select("lang", "source", "term", "n", "lang_n", "first")


def share(count: Column, total: Column, size: Column) -> Column:
    """1 + floor(UNIT * (count + PRIOR) / (total + PRIOR * size)) in whole numbers."""
    over = F.lit(UNIT).cast("decimal(10,0)") * (count + PRIOR).cast("decimal(19,0)")
    under = (total + PRIOR * size).cast("decimal(19,0)")
    # without its remainder the decimal division has a whole result
    return ((over - over % under) / under).cast("long") + 1


def shares(count: np.ndarray, total: int, size: int) -> np.ndarray:
    """The same in numpy: the nine digits of the unit are divided out three at a time."""
    under = int(total) + PRIOR * int(size)
    rest = count.astype(np.int64) + PRIOR
    out = rest // under
    rest = rest % under
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // under
        rest = rest % under
    return out + 1


class Runs:
    """A column of counts as runs: where each starts, and its share."""

    def __init__(self, counts: np.ndarray, length: int, total: int, size: int):
        """``counts`` in vocabulary order; the rest up to ``length`` is 0."""
        if len(counts) < length:
            counts = np.append(counts, 0)
        self.starts = np.append(0, np.flatnonzero(np.diff(counts)) + 1)
        self.share = shares(counts[self.starts], total, size)
        self.length = length

    def distance(self, other: "Runs") -> int:
        """Sum of the differences of the shares, one product per common run."""
        edges = np.union1d(self.starts, other.starts)
        lengths = np.diff(np.append(edges, self.length))
        mine = self.share[np.searchsorted(self.starts, edges, "right") - 1]
        its = other.share[np.searchsorted(other.starts, edges, "right") - 1]
        return int((np.abs(mine - its) * lengths).sum())


def clustered(table: np.ndarray) -> np.ndarray:
    """The rows (terms) in an order that brings equal counts together: columns of few distinct counts first."""
    if not table.size:
        return table
    kinds = [len(np.unique(c)) for c in table.T]
    return table[np.lexsort([table[:, k] for k in np.argsort(kinds)[::-1]])]


def _compare(group: pd.DataFrame) -> pd.DataFrame:
    """All pairs of two blocks of sources over one slice of the vocabulary."""
    heads = group[group.term == ""].sort_values("place")
    rows = group[group.term != ""]
    codes, found = pd.factorize(rows.term)
    table = np.zeros((len(found), len(heads)), np.int64)
    places = heads.place.to_numpy()
    table[codes, np.searchsorted(places, rows.place.to_numpy())] = rows.n.to_numpy()
    table = clustered(table)
    length = int(heads.slice_terms.iat[0])
    runs = [Runs(table[:, k], length, n, v) for k, (n, v) in enumerate(zip(heads.total, heads.size_v))]
    lo, hi = int(group.lo.iat[0]), int(group.hi.iat[0])
    blocks = places // BLOCK
    out = [(heads.lang.iat[0], places[i], places[j], runs[i].distance(runs[j]))
           for i in np.flatnonzero(blocks == lo) for j in np.flatnonzero(blocks == hi) if i < j]
    return pd.DataFrame(out, columns=["lang", "a", "b", "value"])


def _groups(counts: DataFrame) -> DataFrame:
    """(lang, source, total, place, size_v, lang_total, n_sources): one row per group."""
    of_lang = counts.where("term <> ''").groupBy("lang").agg(
        F.sum("n").alias("lang_total"), F.count_if("first").alias("size_v"))
    of_group = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    ranked = Window.partitionBy("lang").orderBy("source")
    return of_group.withColumn("place", F.row_number().over(ranked) - 1) \
        .withColumn("n_sources", F.count(F.lit(1)).over(Window.partitionBy("lang"))) \
        .join(of_lang, "lang", "left").fillna(0, ["lang_total", "size_v"])


def _spread_join(words: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """``words`` with the columns of ``small``, whose keys may each stand for a large part of the words:
    the words of a key are spread over the partitions by term, and ``small`` is repeated for each."""
    n = partitions(words.sparkSession)
    return words.withColumn("_spread", F.pmod(F.xxhash64("term"), F.lit(n)).cast("int")) \
        .join(small.withColumn("_spread", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))), [*keys, "_spread"]).drop("_spread")


def _pair_sums(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, value) for the places a < b of a language with kept terms."""
    like = F.length(F.bin("lang_n")).alias("like")  # terms of like total count share slices
    words = counts.where("term <> ''").withColumn("like", like)
    sizes = words.where("n > 0").groupBy("lang", "like").agg(
        F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / SLICE)).cast("long").alias("slices"))
    dealt = _spread_join(words, sizes, ["lang", "like"]).withColumn("slice", F.pmod(F.xxhash64("term"), "slices"))
    slices = dealt.where("first").groupBy("lang", "like", "slice").agg(F.count(F.lit(1)).alias("slice_terms"))
    last_block = F.floor((F.col("n_sources") - 1) / BLOCK)
    own = groups.where("size_v > 0").withColumn("block", F.floor(F.col("place") / BLOCK)) \
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), last_block))) \
        .withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))
    key = ["lang", "like", "slice", "lo", "hi"]
    rows = _spread_join(dealt.where("n > 0"), own.select("lang", "source", "place", "lo", "hi"), ["lang", "source"]).select(
        *key, "term", "place", "n", F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("size_v"),
        F.lit(0).cast("long").alias("slice_terms"))
    heads = own.join(slices, "lang").select(
        *key, F.lit("").alias("term"), "place", F.lit(0).cast("long").alias("n"), "total", "size_v", "slice_terms")
    return rows.unionByName(heads).groupBy(*key) \
        .applyInPandas(_compare, schema("lang string, a long, b long, value long")) \
        .groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS, lang_col: str = "lang",
               source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` compares a source with each other source of
    its language, part ``term`` lists the terms it uses most beyond the language's share."""
    counts = materialise(kept_counts(term_counts(docs, lang_col, source_col, text_col), min_docs), "divergence-counts")
    groups = materialise(_groups(counts), "divergence-groups")
    a, b = (groups.select("lang", F.col("source").alias(f"source_{x}"), F.col("place").alias(x)) for x in "ab")
    # each other source is wanted by definition: the pairs of a language are the result
    both = a.join(b, "lang").where("a < b").join(_pair_sums(counts, groups), ["lang", "a", "b"], "left") \
        .withColumn("value", F.coalesce("value", F.lit(0).cast("long")))
    pair = both.select("lang", F.explode(F.array(
        F.struct(F.col("source_a").alias("source"), F.col("source_b").alias("item")),
        F.struct(F.col("source_b").alias("source"), F.col("source_a").alias("item")))).alias("_x"), "value") \
        .select("lang", "_x.source", F.lit("pair").alias("part"), "_x.item", "value")
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pair = pair.withColumn("rank", F.row_number().over(order))
    stats = groups.select("lang", "source", "total", "lang_total", "size_v")
    p = share(F.col("n"), F.col("total"), F.col("size_v"))
    q = share(F.col("lang_n"), F.col("lang_total"), F.col("size_v"))
    term = _spread_join(counts.where("term <> '' and n > 0"), stats, ["lang", "source"]) \
        .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (p - q).alias("value")) \
        .where("value > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pair.unionByName(term)


ORACLE = f"""
WITH read AS (
  SELECT row_number() OVER () AS r, ifnull(lang, '') AS lang, ifnull(source, '') AS source,
    regexp_extract_all(translate(ifnull(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS found FROM documents),
words AS (SELECT r, lang, source, unnest(found) AS term FROM read),
kept AS (SELECT lang, term, count(*) AS lang_n FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= {MIN_DOCS}),
used AS (SELECT lang, source, term, count(*) AS n FROM words GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM read),
cells AS (
  SELECT lang, source, term, ifnull(n, 0) AS n, lang_n
  FROM groups JOIN kept USING (lang) LEFT JOIN used USING (lang, source, term)),
scored AS (
  SELECT lang, source, term, n,
    1 + ({UNIT}::HUGEINT * (n + {PRIOR})) // (sum(n) OVER g + {PRIOR} * count(*) OVER g) AS p,
    1 + ({UNIT}::HUGEINT * (lang_n + {PRIOR})) // (sum(lang_n) OVER g + {PRIOR} * count(*) OVER g) AS q
  FROM cells WINDOW g AS (PARTITION BY lang, source)),
apart AS (
  SELECT lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM scored a JOIN scored b USING (lang, term) GROUP BY ALL),
valued AS (
  SELECT lang, a.source, 'pair' AS part, b.source AS item, ifnull(value, 0)::BIGINT AS value
  FROM groups a JOIN groups b USING (lang) LEFT JOIN apart ON apart.lang = a.lang AND apart.source = a.source AND apart.item = b.source
  WHERE a.source <> b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM scored WHERE n > 0 AND p > q)
SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
FROM valued QUALIFY part = 'pair' OR rank <= {TOP_TERMS}
"""
