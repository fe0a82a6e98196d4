"""Line dedup across documents by a segment-partition edit join, in DataFrame functions only.

A line goes when an earlier line equals it, however short; a line of at least
``min_chars`` characters also when an earlier one of that length is within
``max_edits`` edits (Levenshtein) of it (a shorter one holds too few characters
for its segments to tell).  Earlier means by (doc_id, place in the document) of the
first occurrence.  Lines of blanks always stay.

Near lines are found by the pigeonhole principle: a line of length l is split
into max_edits + 1 segments, and a line within max_edits of it holds one of them
unchanged, at a place that the edits left and right of it allow.  So a line is
indexed under (segment number, segment), and probes, for each length from its
own down to max_edits less, the few substrings that can match each segment.  Pairs
that meet and whose letter counts differ by what so many edits can explain are
confirmed with a banded bit-parallel edit distance: the 2 * max_edits + 1 cells of
a column that matter are the bits of two whole numbers.

What moves: the texts are written once, bucketed by document, so that line
texts and verdicts meet without shuffling or sorting texts again (the flags of a
document's lines are the hashed side of those joins); the joins in between carry
hashes.  Lines are named by 128-bit hashes for equality and 64-bit hashes
in the edit join.  A line that a third of all rows share is pre-aggregated to
its first occurrence before the shuffle; joins on lines leave skewed keys to
the adaptive skew join.

Defined cases: NULL texts stay NULL and empty ones empty; a document whose lines
all go has the empty text and ``n_kept`` 0; rows that repeat a document (same id,
same text) are treated alike; documents with a NULL doc_id come last in the
order; extra columns stay as they are; an empty table gives no rows.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratewise.llm.common import col, fresh_path, materialise, partitions, spare_names

MAX_EDITS = 2
MIN_CHARS = 32
#: Letters whose counts are compared before the distance (any set works; frequent ones tell most).
LETTERS = "etaoinsr"
_LAST_ID = 2 ** 63 - 1
#: Added to the length in rows that probe but aren't indexed; over any line's length.
_PROBE_ONLY = 1 << 40


def probes(max_edits: int) -> list[tuple[int, int, int]]:
    """(shorter by, segment, shift): where a line's substrings can match the segments of a line
    that is ``shorter by`` characters shorter.

    With i edits at most left of segment i and the others right of it, the
    substring starts at the segment's start plus a shift within both bounds.
    """
    out = []
    for less in range(max_edits + 1):
        for i in range(max_edits + 1):
            rest = max_edits - i
            out += [(less, i, shift) for shift in range(max(-i, less - rest), min(i, less + rest) + 1)]
    return out


def _key(line: Column, segment: Column, start: Column, size: Column) -> Column:
    return F.xxhash64(segment, F.substring(line, start + 1, size))


def _letters(line: Column) -> Column:
    """Counts of ``LETTERS`` modulo 256, a byte each in a long."""
    packed = F.lit(0).cast("long")
    for k, c in enumerate(LETTERS):
        n = (F.octet_length(line) - F.octet_length(F.replace(line, F.lit(c), F.lit("")))) % 256
        packed = packed.bitwiseOR(F.shiftleft(n.cast("long"), 8 * k))
    return packed


def _explained(a: Column, b: Column, max_edits: int) -> Column:
    """Whether so many edits can explain the letter counts: an edit adds one letter at most and takes one at most."""
    more = fewer = F.lit(0)
    for k in range(len(LETTERS)):
        d = (F.shiftright(a, 8 * k).bitwiseAND(F.lit(255)) - F.shiftright(b, 8 * k).bitwiseAND(F.lit(255)) + 128) \
            .bitwiseAND(F.lit(255)) - 128
        more, fewer = more + F.greatest(d, F.lit(0)), fewer + F.greatest(-d, F.lit(0))
    return (more <= max_edits) & (fewer <= max_edits)


def _near(lines: DataFrame, max_edits: int) -> DataFrame:
    """Pairs (a, b) of line hashes that share a segment and may be near; from (h1, line) of distinct lines.

    Keys don't hold the length: the size of a segment says it up to a few
    characters, so a substring that serves several lengths is sent once.
    """
    parts = max_edits + 1
    base = lines.select("h1", "line", _letters(F.col("line")).alias("letters"), F.length("line").cast("int").alias("n"))
    # One code for all places, run per place: written out for each of them it is a method too long for the JVM to compile.
    combos = F.array(*[F.struct(F.lit(less).alias("less"), F.lit(i).alias("i"), F.lit(shift).alias("shift"))
                       for less, i, shift in probes(max_edits)])
    begin = lambda less, i: F.expr(f"cast((n - ({less})) * ({i}) div {parts} as int)")
    placed = base.select("h1", "letters", "n", "line", F.explode(combos).alias("c")) \
        .select("h1", "letters", "n", "line", "c.*") \
        .select("*", (begin("less", "i") + F.col("shift")).alias("start"), (begin("less", "i + 1") - begin("less", "i")).alias("size"))
    i = F.col("i")

    def before(d: int) -> Column:
        """Whether the probes of a length ``d`` characters longer have this substring too."""
        less, shift = F.col("less") - d, F.col("start") - begin(f"less - {d}", "i")
        return (less >= 0) & (F.col("size") == begin(f"less - {d}", "i + 1") - begin(f"less - {d}", "i")) \
            & (shift >= F.greatest(-i, less - max_edits + i)) & (shift <= F.least(i, less + max_edits - i))

    once = placed.where(~reduce(lambda x, y: x | y, [before(d) for d in range(1, parts)], F.lit(False)))
    # A line's own segments serve as index and as probe; ``reach`` is its length, and out of reach in
    # rows that only probe.  Both sides of the join are thus the same rows, shuffled once.
    own = (F.col("less") == 0) & (F.col("shift") == 0)
    reach = F.col("n").cast("long") + F.when(own, F.lit(0)).otherwise(F.lit(_PROBE_ONLY))
    rows = once.select("h1", "letters", _key(F.col("line"), i, F.col("start"), F.col("size")).alias("key"), reach.alias("reach"))
    index, probe = rows.alias("i"), rows.alias("p")
    length = F.col("p.reach").bitwiseAND(F.lit(_PROBE_ONLY - 1))
    meet = (F.col("i.key") == F.col("p.key")) & (F.col("i.h1") != F.col("p.h1")) \
        & (F.col("i.reach") <= length) & (F.col("i.reach") >= length - max_edits) \
        & ((F.col("i.reach") != length) | (F.col("i.h1") < F.col("p.h1"))) \
        & _explained(F.col("i.letters"), F.col("p.letters"), max_edits)
    return index.join(probe, meet).select(F.col("i.h1").alias("a"), F.col("p.h1").alias("b")).distinct()


def banded_distance(a: Column, b: Column, most: int) -> Column:
    """Edit distance of two texts of at least ``most`` characters if it is up to ``most``, else more than that.

    Column j of the distance table is kept for the rows j - most to j + most: bit d of
    ``up`` (``down``) says that row j - most + d is one more (less) than the row before
    it.  A step takes the bits where the next character of ``b`` equals one of those
    rows' characters of ``a``, and the sum follows the lowest row of the band, then the
    last row of ``a`` once the band has reached it.  Where the distance is up to ``most``,
    a path of so many edits crosses each column at most 2 * most rows above that row, so
    the sum is never over 3 * most; once it is, the columns left are passed over.
    """
    width = 2 * most + 1
    ones = (1 << width) - 1
    bit = lambda x: F.lit(x).cast("long")
    inside = lambda x: x.bitwiseAND(bit(ones))
    shifted = lambda x: F.shiftright(x, 1)

    def step(texts: Column, acc: Column, j: Column) -> Column:
        equal = reduce(lambda m, d: m + F.when(F.get(texts["x"], j - most + d) == F.get(texts["y"], j), bit(1 << d)).otherwise(bit(0)),
                       range(width), bit(0))
        return F.struct(acc["up"].alias("up"), acc["down"].alias("down"), acc["sum"].alias("sum"), equal.alias("equal"), j.alias("j"))

    def diagonal(s: Column) -> Column:
        carried = inside(s["equal"].bitwiseAND(s["up"]) + s["up"]).bitwiseXOR(s["up"])
        return F.struct(s["up"].alias("up"), s["down"].alias("down"), s["sum"].alias("sum"), s["j"].alias("j"),
                        carried.bitwiseOR(s["equal"]).bitwiseOR(s["down"]).alias("zero"))

    def across(s: Column) -> Column:
        more = s["down"].bitwiseOR(inside(F.bitwise_not(s["zero"].bitwiseOR(s["up"]))))
        return F.struct(s["sum"].alias("sum"), s["j"].alias("j"), s["zero"].alias("zero"), more.alias("more"),
                        s["zero"].bitwiseAND(s["up"]).alias("less"))

    def after(texts: Column, s: Column) -> Column:
        enter = F.size(texts["x"]) - most  # the column from which the band holds the last row
        last = F.call_function("shiftleft", bit(1), (2 * most - 1 - (s["j"] - enter)).cast("int"))
        on = lambda m, at: (m.bitwiseAND(at) != 0).cast("int")
        total = s["sum"] + F.when(s["j"] < enter, 1 - on(s["zero"], bit(1 << (width - 1)))) \
            .otherwise(on(s["more"], last) - on(s["less"], last))
        return F.struct(s["less"].bitwiseOR(inside(F.bitwise_not(shifted(s["zero"]).bitwiseOR(s["more"])))).alias("up"),
                        shifted(s["zero"]).bitwiseAND(s["more"]).alias("down"), total.alias("sum"))

    def once(s: Column, part) -> Column:
        """``part`` of ``s``, which is worked out once however often the part names it."""
        return F.get(F.transform(F.array(s), part), F.lit(0))

    start = F.struct(bit(((1 << (most + 1)) - 1) << most).alias("up"), bit(0).alias("down"), F.lit(most).alias("sum"))
    both = F.struct(F.split(a, "").alias("x"), F.split(b, "").alias("y"))
    return once(both, lambda texts: F.aggregate(
        F.sequence(F.lit(0), F.size(texts["y"]) - 1), start,
        lambda acc, j: F.when(acc["sum"] > 3 * most, acc).otherwise(
            once(once(once(step(texts, acc, j), diagonal), across), lambda s: after(texts, s))))["sum"])


def dedup_lines(docs: DataFrame, max_edits: int = MAX_EDITS, min_chars: int = MIN_CHARS,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the repeated lines taken out of the text, and the columns ``n_lines``, ``n_kept``
    (lines before and after) and ``n_new`` (lines that no earlier line equals or nearly equals; NULL
    where there are only blank lines)."""
    spark = docs.sparkSession
    if min_chars <= max_edits:
        raise ValueError("min_chars must be over max_edits")
    d, tie, n_lines, n_kept, n_new, keep = spare_names(
        docs, "line_doc", "line_tie", "n_lines", "n_kept", "n_new", "line_keep")
    place = [d, tie]
    table, buckets = f"llm_lines_{uuid.uuid4().hex}", partitions(spark)
    docs.withColumns({d: F.coalesce(col(id_col).cast("long"), F.lit(_LAST_ID)), tie: F.xxhash64(col(text_col))}) \
        .repartition(buckets, *place).write.bucketBy(buckets, *place).option("compression", "zstd") \
        .option("path", fresh_path(spark, "lines")).saveAsTable(table)
    stored = spark.table(table)
    split = F.split(col(text_col), "\n", -1)

    # Every line's hash and its first occurrence.
    lines = stored.select(*place, F.posexplode(split).alias("pos", "line"))
    hashed = materialise(lines.select(
        *place, "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"),
        (F.length("line") < min_chars).alias("short"), (F.btrim("line") == "").alias("blank")), "line-hashes")
    written = hashed.where("not blank")
    first = materialise(written.groupBy("h1", "h2").agg(F.min(F.struct(*place, "pos")).alias("first")), "line-firsts")
    at = F.struct(*place, "pos")
    flagged = written.join(first, ["h1", "h2"]).select(*place, "pos", "h1", (at == F.col("first")).alias("new")) \
        .unionByName(hashed.where("blank").select(*place, "pos", "h1", F.lit(None).cast("boolean").alias("new")))

    def verdicts(rows: DataFrame) -> DataFrame:
        """Per document its lines' flags (keep, new) in their order."""
        return rows.groupBy(*place).agg(F.sort_array(F.collect_set(F.struct(
            "pos", F.coalesce("new", F.lit(True)).alias("keep"), "new"))).alias(keep))

    # Distinct long lines with their texts, where the texts lie.
    starts = written.where("not short").join(first, ["h1", "h2"]).where(at == F.col("first")).select(*place, "pos", "h1")
    chosen = starts.groupBy(*place).agg(F.sort_array(F.collect_set(F.struct("pos", "h1"))).alias("chosen"))

    def texts(chosen: DataFrame) -> DataFrame:
        """(h1, line) of the chosen places (pos, h1) of each document."""
        return stored.select(*place, split.alias("lines")).join(chosen.hint("shuffle_hash"), place) \
            .select(F.explode(F.transform("chosen", lambda c: F.struct(
                c["h1"].alias("h1"), F.get("lines", c["pos"]).alias("line")))).alias("c")).select("c.*")

    pairs = materialise(_near(texts(chosen), max_edits), "line-pairs")
    wanted = pairs.select(F.col("a").alias("h1")).unionByName(pairs.select(F.col("b").alias("h1"))).distinct()
    places = first.select("h1", "first").join(wanted, "h1")
    few = places.select("first.*", "h1").groupBy(*place) \
        .agg(F.sort_array(F.collect_set(F.struct("pos", "h1"))).alias("chosen"))
    known = materialise(texts(few).join(places, "h1"), "line-candidates")
    side = lambda x: known.select(F.col("h1").alias(x), F.col("line").alias(f"{x}_line"), F.col("first").alias(f"{x}_first"))
    near = pairs.join(side("a"), "a").join(side("b"), "b") \
        .where(banded_distance(F.col("a_line"), F.col("b_line"), max_edits) <= max_edits)
    late = materialise(near.select(F.when(F.col("a_first") < F.col("b_first"), F.col("b")).otherwise(F.col("a"))
                                   .alias("h1")).distinct(), "line-late")
    judged = flagged.join(late.withColumn("late", F.lit(True)), "h1", "left") \
        .select(*place, "pos", (F.col("new") & F.col("late").isNull()).alias("new"))

    staying = F.filter(F.arrays_zip(split.alias("line"), F.col(keep).alias("flag")), lambda x: x["flag"]["keep"])
    out = stored.join(verdicts(judged).hint("shuffle_hash"), place, "left")
    left = F.size(staying)
    return out.select(
        *[F.when(col(text_col).isNotNull(), F.array_join(F.transform(staying, lambda x: x["line"]), "\n")).alias(c)
          if c == text_col else col(c) for c in docs.columns],
        F.when(col(text_col).isNull(), 0).otherwise(F.size(split)).alias(n_lines),
        F.when(col(text_col).isNull(), 0).otherwise(left).alias(n_kept),
        F.when(F.exists(col(keep), lambda x: x["new"].isNotNull()),
               F.size(F.filter(col(keep), lambda x: x["new"]))).alias(n_new))
