"""MinHash near-duplicates by a signature-coordinate inverted join.

A document's set holds its distinct word shingles; documents with
|A & B| / |A | B| >= threshold are linked.  Documents with equal sets are one
class and travel once.

1. Every class gets a MinHash signature.  A pair at the threshold agrees in
   fewer than ``least_matches`` coordinates with a probability of at most 1e-6
   (the exact binomial tail).
2. Inverted join: a class is posted under its (coordinate, value) pairs.  Two
   signatures with t of m coordinates in common meet in the first m - t + 1
   pairs of both when all order them by how many classes have them, rarest
   first; so only that prefix is posted, and pairs that no other class has
   take places in it but are skipped.
3. Links are searched until no list can add one.  First the least class of a
   list is compared with all others of it.  A list that still holds several
   components is closed if it is short: the collisions of two signatures are
   counted, a pair is looked at in the first list that both share only, and
   members of one component are skipped, as they are joined.  A long one is
   split: its members agree in d coordinates, so those with t in common agree in
   t - d of the other m - d, and meet again in the first m - t + 1 of these, in
   the order of how many members of the list have them.  The parts are lists
   like any other: first the least class, then closed or split again, as long as
   that leaves at most a quarter of the comparisons.
4. Whoever has enough collisions is confirmed on the full sets.

A list that a third of all classes share is thus a row per class for the first
comparison, and then falls apart: what a member shares with no other member of
the list is skipped.  Lists whose members agree in so much that splitting saves
little (copies of one text, most of which the least class has joined) are gone
through in pairs of blocks, which many tasks share.  Nothing is cut off.
Joins of a list's or a hub's row with its members are dealt to shares of like
size, whose number follows from the length of the list.

Defined cases: NULL, empty and word-less texts have an empty set and link with
nothing; repeated rows share a class; a NULL doc_id can't name a component but
its row is linked like any other; extra columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratewise.llm.common import identified, materialise, partitions, restored, row_groups, schema
from ratewise.llm.components import components
from ratewise.llm.words import lowered, mix, shingle_set, word_hashes

#: Members of a list that one task compares with each other; longer lists are split.
BLOCK = 1024
#: Members of a list (pairs of a hub) that one copy of the list's (hub's) own row serves.
SHARE = 64
#: Members of a long list that tell whether it is worth splitting (whole results either way).
SAMPLE = 256
MISSED = 1e-6


@lru_cache
def _least_matches(coordinates: int, percent: int) -> int:
    t, missed = percent / 100, 0.0
    for k in range(coordinates):
        missed += comb(coordinates, k) * t ** k * (1 - t) ** (coordinates - k)
        if missed > MISSED:
            return max(1, k)
    return coordinates


@dataclass(frozen=True)
class Similarity:
    """Shingle length, threshold in percent and signature size."""

    words: int = 5
    percent: int = 80
    coordinates: int = 40

    @property
    def least_matches(self) -> int:
        """Matches that a pair at the threshold misses with a probability of at most ``MISSED``."""
        return _least_matches(self.coordinates, self.percent)

    @property
    def prefix(self) -> int:
        return self.coordinates - self.least_matches + 1

    def linked(self, common: int, a: int, b: int) -> bool:
        return 100 * common >= self.percent * (a + b - common)


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text."""
    return shingle_set(word_hashes(lowered(text)), words)


def signature(set_: np.ndarray, coordinates: int) -> np.ndarray:
    """The least value of each of ``coordinates`` hash functions over a set, as 32-bit integers."""
    seeds = mix(np.arange(1, coordinates + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None]
    least = np.full(coordinates, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for lo in range(0, len(set_), 1024):
        values = seeds ^ set_[None, lo:lo + 1024]
        values *= np.uint64(0xD6E8FEB86659FD93)
        least = np.minimum(least, values.min(axis=1))
    return (least >> np.uint64(32)).astype(np.uint32)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows with ``tie``, a hash of the text that tells rows of one doc_id apart."""
    return identified(docs, id_col, text_col).withColumn("tie", F.xxhash64("text"))


def _signatures(docs: DataFrame, s: Similarity, id_col: str, text_col: str) -> DataFrame:
    """A row per document: its set's size, 128-bit digest and signature (empty set: no digest)."""
    out = schema("doc_id long, no_id boolean, row_id long, tie long, n_shingles long, digest binary, sig binary")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingles(t, s.words) for t in batch.text]
            yield batch[["doc_id", "no_id", "row_id", "tie"]].assign(
                n_shingles=[len(x) for x in sets],
                digest=[xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in sets],
                sig=[signature(x, s.coordinates).tobytes() if len(x) else None for x in sets])

    return materialise(_rows(docs, id_col, text_col).mapInPandas(run, out), "minhash-signatures")


def _postings(members: DataFrame, s: Similarity, depth: int) -> DataFrame:
    """(list, key, class_id, used, prefix, n) from members (list, class_id, used, sig) of lists.

    ``used`` has a bit for each of the ``depth`` coordinates that the members of a list agree
    in, ``prefix`` for each other one that is posted; n members of the list have the key.
    """
    m = s.coordinates

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.sig), np.uint32).reshape(-1, m).astype(np.int64)
            free = (batch.used.to_numpy(np.int64)[:, None] >> np.arange(m) & 1) == 0
            row = np.nonzero(free)[0]
            yield batch[["list", "class_id", "used"]].iloc[row] \
                .assign(key=(sig | (np.arange(m, dtype=np.int64) << 32))[free])

    out = schema("list long, class_id long, used long, key long")
    pairs = members.select("list", "class_id", "used", "sig").mapInPandas(spread, out)
    shared = pairs.groupBy("list", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # members' shared pairs, rarest first; the pairs no other member has come before them
    mine = pairs.join(shared, ["list", "key"]).groupBy("list", "class_id", "used") \
        .agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("p"))  # at most ``coordinates`` entries
    posted = F.slice("p", 1, F.greatest(F.lit(0), F.lit(s.prefix - (m - depth)) + F.size("p")))
    mine = mine.select("list", "class_id", "used", posted.alias("p")).where(F.size("p") > 0)
    bits = F.expr("aggregate(p, 0L, (acc, x) -> acc | shiftleft(1L, cast(shiftright(x.key, 32) as int)))")
    return materialise(
        mine.select("list", "class_id", "used", bits.alias("prefix"), F.explode("p").alias("p"))
        .select("list", "p.key", "class_id", "used", "prefix", "p.n"), "minhash-postings")


def _shares(n: F.Column) -> F.Column:
    """How many shares the members of a list (the pairs of a hub) are dealt to."""
    return F.ceil(n / SHARE).cast("int")


def _share(n: F.Column) -> F.Column:
    """A member's share."""
    return F.pmod(F.xxhash64("class_id"), _shares(n)).cast("int")


def _back(members: DataFrame, own: DataFrame) -> DataFrame:
    """``members`` of lists with their list's row in ``own`` (list, key, n, ...), which is repeated for each share."""
    each = own.withColumn("share", F.explode(F.sequence(F.lit(0), _shares(F.col("n")) - 1))).drop("n")
    return members.withColumn("share", _share(F.col("n"))).join(each, ["list", "key", "share"]).drop("share")


def _confirm(pairs: DataFrame, texts: DataFrame, s: Similarity) -> DataFrame:
    """Links (u, v) among ``pairs`` (hub, class_id), confirmed on the full sets.

    A hub's text goes once to each share of its pairs, the others' texts once.
    """
    # a hub's pairs are counted in parts, so that the count comes back to a part and not to a hub
    part = F.pmod(F.xxhash64(F.lit(0), "class_id"), F.lit(partitions(pairs.sparkSession))).cast("int")
    parts = pairs.groupBy("hub", part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    counts = parts.select("hub", "part").join(parts.groupBy("hub").agg(F.sum("n").alias("n")), "hub")
    pairs = pairs.withColumn("part", part).join(counts, ["hub", "part"]) \
        .select("hub", "class_id", _share(F.col("n")).alias("salt"))
    hubs = pairs.select("hub", "salt").distinct().withColumn("class_id", F.col("hub")).withColumn("role", F.lit(0))
    rows = hubs.unionByName(pairs.withColumn("role", F.lit(1))).join(texts, "class_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hub = set_ = None
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                own = shingles(row.text, s.words)
                if row.role == 0:
                    hub, set_ = row.hub, own
                elif row.hub == hub:
                    common = len(np.intersect1d(own, set_, assume_unique=True))
                    if s.linked(common, len(own), len(set_)):
                        out.append((row.class_id, hub))
            yield pd.DataFrame(out, columns=["u", "v"])

    return rows.repartition(partitions(pairs.sparkSession), "hub", "salt") \
        .sortWithinPartitions("hub", "salt", "role").mapInPandas(run, schema("u long, v long"))


def _matches(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal coordinates of every signature of ``a`` with every one of ``b``."""
    out = np.zeros((len(a), len(b)), np.uint8)
    for k in range(a.shape[1]):
        out += a[:, k, None] == b[None, :, k]
    return out


def _candidates(group: pd.DataFrame, s: Similarity) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of a block pair that are to be confirmed: enough collisions, another
    component, and this list is the first that both share.  The most alike come first."""
    first, second = int(group["bi"].iat[0]), int(group["bj"].iat[0])
    block = group["block"].to_numpy()
    left = np.flatnonzero(block == first)
    right = left if first == second else np.flatnonzero(block == second)
    if not len(left) or not len(right):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    sig = np.frombuffer(b"".join(group.sig), np.uint32).reshape(-1, s.coordinates)
    prefix = group["prefix"].to_numpy(np.int64)
    component = group["component"].to_numpy(np.int64)
    ok = component[left][:, None] != component[right][None, :]
    if first == second:
        ok &= left[:, None] < right[None, :]
    a, b = np.nonzero(ok)
    if len(a):
        matches = _matches(sig[left], sig[right])
        a, b = np.nonzero(ok & (matches >= s.least_matches))
        best = np.argsort(-matches[a, b].astype(np.int16), kind="stable")
        a, b = a[best], b[best]
    a, b = left[a], right[b]
    place = int(group["key"].iat[0]) >> 32
    earlier = np.zeros(len(a), bool)
    both = prefix[a] & prefix[b]
    for k in range(place):
        earlier |= (both >> k & 1).astype(bool) & (sig[a, k] == sig[b, k])
    return a[~earlier], b[~earlier]


_GROUP = ["list", "key", "bi", "bj"]


def _block() -> F.Column:
    return F.pmod(F.xxhash64("class_id", "key"), F.ceil(F.col("n") / BLOCK)).cast("int")


def _blocks(lists: DataFrame) -> DataFrame:
    """Rows of lists dealt to block pairs (bi <= bj) of about ``BLOCK`` rows a block; ``n`` is a list's length."""
    last = F.ceil(F.col("n") / BLOCK).cast("int") - 1
    dealt = lists.withColumn("block", _block()).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    return dealt.withColumn("bi", F.least("block", "other")).withColumn("bj", F.greatest("block", "other")) \
        .drop("other")


def _dealt(blocks: DataFrame) -> DataFrame:
    return blocks.repartition(partitions(blocks.sparkSession), *_GROUP).sortWithinPartitions(*_GROUP)


def _confirm_group(group: pd.DataFrame, s: Similarity) -> list[tuple[int, int]]:
    """Links of a block pair that join two of its components; a forest, as more would tell nothing new."""
    a, b = _candidates(group, s)
    if not len(a):
        return []
    ids = group["class_id"].to_numpy()
    comp = group["component"].to_numpy()
    parent = {c: c for c in set(comp.tolist())}

    def root(c: int) -> int:
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    sets: dict[int, np.ndarray] = {}
    out = []
    for i, j in zip(a.tolist(), b.tolist()):
        p, q = root(int(comp[i])), root(int(comp[j]))
        if p == q:
            continue
        for k in (i, j):
            if k not in sets:
                sets[k] = shingles(group["text"].iat[k], s.words)
        x, y = sets[i], sets[j]
        if 100 * min(len(x), len(y)) < s.percent * max(len(x), len(y)):
            continue
        if s.linked(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)):
            parent[p] = q
            out.append((int(ids[i]), int(ids[j])))
    return out


def _hub_links(postings: DataFrame, sigs: DataFrame, texts: DataFrame, s: Similarity) -> DataFrame:
    """Links of the least class of each list with the others of it."""
    hub = postings.groupBy("list", "key", "n").agg(F.min("class_id").alias("hub"))
    pairs = _back(postings, hub).where("class_id <> hub").select("hub", "class_id").distinct()
    pairs = pairs.join(sigs, "class_id") \
        .join(sigs.select(F.col("class_id").alias("hub"), F.col("sig").alias("hub_sig")), "hub")

    def enough(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch[c]), np.uint32).reshape(-1, s.coordinates) for c in ("sig", "hub_sig"))
            yield batch.loc[(x == y).sum(axis=1) >= s.least_matches, ["hub", "class_id"]]

    likely = materialise(pairs.mapInPandas(enough, schema("hub long, class_id long")), "minhash-likely")
    return materialise(_confirm(likely, texts, s), "minhash-links")


def _open(postings: DataFrame, links: DataFrame) -> DataFrame:
    """Members, with their ``component``, of the lists that hold several; ``n`` is a list's number of members."""
    found = materialise(components(links), "minhash-components")
    own = postings.join(found.withColumnRenamed("node", "class_id"), "class_id", "left") \
        .withColumn("component", F.coalesce("component", "class_id"))
    several = own.groupBy("list", "key", "n").agg(F.count(F.lit(1)).alias("members"), F.min("component").alias("lo"),
                                                  F.max("component").alias("hi")) \
        .where("members > 2 and lo <> hi").select("list", "key", "n", "members")
    return materialise(_back(own, several).drop("n").withColumnRenamed("members", "n"), "minhash-open")


def _block_links(lists: DataFrame, sigs: DataFrame, texts: DataFrame, s: Similarity) -> DataFrame:
    """Links that join the components of open lists, in block pairs."""
    kept = schema("list long, key long, class_id long, bi int, bj int")

    def busy(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for place, group in row_groups(batches, _GROUP):
            a, b = _candidates(group, s)
            for i in np.union1d(a, b).tolist():
                out.append((*place[:2], int(group["class_id"].iat[i]), *place[2:]))
            if len(out) > 10_000:
                yield pd.DataFrame(out, columns=kept.names)
                out = []
        yield pd.DataFrame(out, columns=kept.names)

    # Counting collisions needs no text; texts go only to block pairs with something to confirm.
    blocks = materialise(_dealt(_blocks(lists.join(sigs, "class_id"))).mapInPandas(busy, kept), "minhash-busy")
    again = blocks.join(lists, ["list", "key", "class_id"]) \
        .select(*blocks.columns, "prefix", "component", _block().alias("block")) \
        .join(sigs, "class_id").join(texts, "class_id")

    def confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, group in row_groups(batches, _GROUP):
            found = _confirm_group(group, s)
            if found:
                yield pd.DataFrame(found, columns=["u", "v"])

    return materialise(_dealt(again).mapInPandas(confirm, schema("u long, v long")), "minhash-more-links")


def _split(lists: DataFrame, sigs: DataFrame, s: Similarity, depth: int) -> DataFrame:
    """(list, key, n) of the long lists whose parts would take at most a quarter of their comparisons,
    measured on about ``SAMPLE`` members of each."""
    some = lists.where(F.col("n") > BLOCK) \
        .where(F.pmod(F.xxhash64(F.lit(2), "class_id", "key"), F.ceil(F.col("n") / SAMPLE)) == 0)
    some = materialise(some.select("list", "key", "n", "class_id", "used"), "minhash-sample")
    parts = _postings(_parts(some).join(sigs, "class_id"), s, depth).groupBy("list", "key") \
        .agg(F.count(F.lit(1)).alias("c")).groupBy("list").agg(F.sum(F.col("c") * F.col("c")).alias("work"))
    own = some.groupBy("list", "key", "n").agg(F.count(F.lit(1)).alias("taken"))
    return own.withColumn("part", _part()).join(parts.withColumnRenamed("list", "part"), "part", "left") \
        .where(4 * F.coalesce("work", F.lit(0)) <= F.col("taken") * F.col("taken")).select("list", "key", "n")


def _part() -> F.Column:
    return F.xxhash64("list", "key")


def _parts(lists: DataFrame) -> DataFrame:
    """The members of each list as those of a list of their own, which agree in its key too."""
    place = F.shiftright("key", 32).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place)
    return lists.select(_part().alias("list"), "class_id", F.col("used").bitwiseOR(bit).alias("used"))


def _links(classes: DataFrame, texts: DataFrame, postings: DataFrame, s: Similarity) -> DataFrame:
    """Links that join all classes which the threshold joins; ``postings`` are those of the whole corpus."""
    sigs = classes.select("class_id", "sig")
    links = _hub_links(postings, sigs, texts, s)
    for depth in range(1, s.least_matches + 1):
        lists = _open(postings, links)
        # members of a list agree in ``depth`` coordinates: from the least matches on it can't be split
        if depth == s.least_matches or lists.where(F.col("n") > BLOCK).isEmpty():
            return links.unionByName(_block_links(lists, sigs, texts, s))
        split = materialise(_split(lists, sigs, s, depth), "minhash-split")
        if split.isEmpty():
            return links.unionByName(_block_links(lists, sigs, texts, s))
        links = links.unionByName(_block_links(lists.join(split, ["list", "key"], "left_anti"), sigs, texts, s))
        members = _back(lists, split).select(*lists.columns)
        postings = _postings(_parts(members).join(sigs, "class_id"), s, depth)
        links = links.unionByName(_hub_links(postings, sigs, texts, s))
    return links


def _members(docs: DataFrame, s: Similarity, id_col: str, text_col: str) -> DataFrame:
    """Every row with its component (NULL: empty set) and the component's first (doc_id, tie)."""
    rows = _signatures(docs, s, id_col, text_col)
    # One class per distinct set, named by its first row.
    classes = materialise(rows.where("digest is not null").groupBy("digest", "sig")
                          .agg(F.min(F.struct("row_id", "doc_id", "no_id", "tie")).alias("first"))
                          .select("digest", "sig", F.col("first.row_id").alias("class_id"), "first.doc_id",
                                  "first.no_id", "first.tie"), "minhash-classes")
    whole = F.lit(0).cast("long")
    postings = _postings(classes.withColumns({"list": whole, "used": whole}), s, 0)
    place = ["doc_id", "no_id", "tie"]
    wanted = classes.join(postings.select("class_id").distinct(), "class_id").select(*place, "class_id")
    texts = materialise(_rows(docs, id_col, text_col).select(*place, "text").join(wanted, place)
                        .dropDuplicates(place).select("class_id", "text"), "minhash-texts")
    found = components(_links(classes, texts, postings, s))
    of_class = classes.select("digest", "class_id") \
        .join(found.withColumnRenamed("node", "class_id"), "class_id", "left") \
        .select("digest", F.coalesce("component", "class_id").alias("component"))
    members = rows.select("digest", "doc_id", "no_id", "row_id", "tie", "n_shingles").join(of_class, "digest", "left")
    first = members.where("component is not null and not no_id").groupBy("component") \
        .agg(F.min(F.struct("doc_id", "tie")).alias("first"))
    return members.join(first, "component", "left")


def repeats(docs: DataFrame, similarity: Similarity = Similarity(),
            id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tie) of the texts, named by id and ``xxhash64``, that aren't their component's first."""
    return _members(docs, similarity, id_col, text_col) \
        .where(~F.col("no_id") & (F.struct("doc_id", "tie") != F.col("first"))).select("doc_id", "tie").distinct()


def near_duplicates(docs: DataFrame, similarity: Similarity = Similarity(),
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row_id, doc_id, n_shingles, component_id, kept) for every row of ``docs``.

    ``component_id`` is the smallest doc_id of the documents reachable over links
    (itself included), ``kept`` whether it is this document's.
    """
    out = _members(docs, similarity, id_col, text_col) \
        .withColumn("component_id", F.when(F.col("component").isNull() & ~F.col("no_id"), F.col("doc_id"))
                    .otherwise(F.col("first.doc_id")))
    return restored(out).select(
        "row_id", "doc_id", "n_shingles", "component_id",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))
