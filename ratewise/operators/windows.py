"""Ordered operators: keep-last dedup (CL2/WN9) and forward fill (WN8/CL9).

Both are written so that one hot key (a third of all rows under one key)
does not end up sorted inside a single task:

* ``dedup_keep_last`` is ``row_number() = 1`` over the identity key.  Spark
  plans it as a WindowGroupLimit that runs twice: partially in every map
  task *before* the shuffle (a hot key leaves each task as one row) and
  finally after it.  ``dedup_keep_last_agg`` is the same result as a
  ``max_by`` aggregate (sort-based, also partial before the shuffle).
* ``fill_forward`` splits each group into ranges of the order key
  (``chunk``), fills inside each (group, chunk) with a window, then carries
  the last non-null value of earlier chunks through a second window over the
  per-chunk summary, which has one row per (group, chunk) only.
* ``running_sum`` (cumulative share, ranking) deals the rows into ranges of
  the sort order by splitters, sums inside each range, and adds the total of
  all earlier ranges from a one-row-per-range summary.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratewise.functions.text import quoted
from ratewise.plans.shared import shared


def dedup_keep_last(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Keep, for each identity ``key``, the row with the greatest ``order`` tuple.

    NULLs in the key compare equal (like pandas ``drop_duplicates``); NULLs
    in the order sort lowest.  The order tuple should be unique within a key
    (add an ingest position); remaining columns break any leftover tie, so
    the result is deterministic.
    """
    rest = [c for c in df.columns if c not in key and c not in order]
    w = Window.partitionBy(*[F.col(quoted(c)) for c in key]) \
        .orderBy(*[F.col(quoted(c)).desc_nulls_last() for c in order + rest])
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def dedup_keep_last_agg(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Same result as ``dedup_keep_last`` through ``max_by`` (sort aggregate)."""
    rest = [c for c in df.columns if c not in key]
    ordk = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in rest if c not in order])
    kept = (df.groupBy(*key)
              .agg(F.max_by(F.struct(*[F.col(c) for c in rest]), ordk).alias("_row")))
    return kept.select(*key, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)


def dedup_rate(before: DataFrame, after: DataFrame) -> DataFrame:
    """DQ9: rows before and after dedup, removed and % removed."""
    from ratewise.functions.exact import percent_half_up
    b = before.agg(F.count(F.lit(1)).alias("rows_before"))
    a = after.agg(F.count(F.lit(1))).scalar()
    return (b.withColumn("rows_after", a)
             .withColumn("removed", F.col("rows_before") - F.col("rows_after"))
             .withColumn("pct_removed", percent_half_up(F.col("removed"), F.col("rows_before"), 1)))


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` with NULL equal to NULL; the keys appear once."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = [left[quoted(k)].eqNullSafe(renamed[quoted(f"_r_{k}")]) for k in keys]
    return left.join(renamed, on, how).drop(*[f"_r_{k}" for k in keys])


def fill_forward(df: DataFrame, group: list[str], order: str, cols: list[str],
                 chunk: int | None = None, levels: int = 1, ranges: int | None = None) -> DataFrame:
    """Replace NULLs in ``cols`` by the last non-NULL value earlier in ``order``
    within ``group`` (pandas ``ffill`` per group; a NULL group is a group).
    ``order`` must be unique within a group.

    With ``chunk`` (a width on a numeric ``order``), groups are split into
    ranges ``order div chunk``: each (group, range) is filled locally, and the
    value carried into a range is the last non-NULL value of the earlier
    ranges.  That carry is itself a forward fill over the one-row-per-range
    summary (a NULL probe row is placed just before each range's summary
    row, so the fill at the probe sees strictly earlier ranges only), and it
    is computed the same chunked way, ``levels`` more times: every level
    shrinks what one task holds of a hot group by about ``chunk`` / 2 (the
    probes double the summary), and only the last level is a plain window.

    The summary takes whole rows of the local fill, so both uses have the same
    columns and the planner reuses one shuffle: the source is read once.

    With ``ranges`` the pieces are ranges of (group, order) at quantiles of the
    rows instead (``with_range``): balanced for any order, sparse ones, times and
    texts too, where a width would make a range of every row.  A group has at most
    ``ranges`` of them, so the carry is a window over that summary.  The quantiles
    take one more read of the group and order columns.
    """
    c_ = lambda name: F.col(quoted(name))
    if ranges is not None:
        return _fill_ranges(df, group, order, cols, ranges)
    if chunk is None:
        w = Window.partitionBy(*map(c_, group)).orderBy(c_(order)).rowsBetween(Window.unboundedPreceding, 0)
        return df.select(*[F.last(c_(c), ignorenulls=True).over(w).alias(c) if c in cols else c_(c)
                           for c in df.columns])
    places = range(len(cols))
    part = f"_chunk{levels}"                       # names of this level: the levels nest
    own = lambda k: f"_l{levels}_{k}"              # noqa: E731
    carried = lambda k: f"_c{levels}_{k}"          # noqa: E731
    d = df.withColumn(part, F.floor(c_(order) / F.lit(chunk)).cast("bigint"))
    win = Window.partitionBy(*map(c_, group), part).orderBy(c_(order)).rowsBetween(Window.unboundedPreceding, 0)
    local = d.select(*map(c_, d.columns), *[F.last(c_(cols[k]), ignorenulls=True).over(win).alias(own(k))
                                            for k in places])
    summ = local.groupBy(*map(c_, group), part) \
        .agg(F.max_by(F.struct(*map(c_, local.columns)), c_(order)).alias("_last")) \
        .select(*map(c_, group), part, *[F.col(f"_last.{own(k)}").alias(carried(k)) for k in places])
    # value carried into a chunk = last non-null summary of strictly earlier
    # chunks: each summary row becomes a NULL probe at 2·chunk and the value
    # at 2·chunk+1, and that sequence is forward-filled
    types = {f.name: f.dataType for f in summ.schema.fields}
    two = F.explode(F.array(
        F.struct((F.col(part) * 2).alias("_pos"), *[F.lit(None).cast(types[carried(k)]).alias(carried(k)) for k in places]),
        F.struct((F.col(part) * 2 + 1).alias("_pos"), *[F.col(carried(k)) for k in places])))
    keyed = summ.select(*map(c_, group), two.alias("_p")).select(*map(c_, group), "_p.*")
    filled = fill_forward(keyed, group, "_pos", [carried(k) for k in places],
                          chunk if levels > 0 else None, levels - 1)
    carry = filled.where(F.col("_pos") % 2 == 0).select(
        *map(c_, group), F.shiftright("_pos", 1).alias(part), *[carried(k) for k in places])
    out = null_safe_join(local, carry, [*group, part], "left")
    return out.select(*[F.coalesce(F.col(own(cols.index(c))), F.col(carried(cols.index(c)))).alias(c) if c in cols
                        else c_(c) for c in df.columns])


def _fill_ranges(df: DataFrame, group: list[str], order: str, cols: list[str], ranges: int) -> DataFrame:
    c_ = lambda name: F.col(quoted(name))
    key = order_key(df, [*group, order])
    own, carried = ([f"_fr_{x}{k}" for k in range(len(cols))] for x in ("own", "carried"))
    inside = Window.partitionBy(*map(c_, group), "_fr_range").orderBy(c_(order)).rowsBetween(Window.unboundedPreceding, 0)
    local = with_range(df, key, ranges, "_fr_range")
    local = local.select("*", *[F.last(c_(c), ignorenulls=True).over(inside).alias(o) for c, o in zip(cols, own)],
                         key.alias("_fr_key"))
    last = local.groupBy(*map(c_, group), "_fr_range").agg(F.max_by(F.struct(*map(c_, local.columns)), "_fr_key").alias("_fr_last"))
    earlier = Window.partitionBy(*map(c_, group)).orderBy("_fr_range").rowsBetween(Window.unboundedPreceding, -1)
    carry = last.select(*map(c_, group), "_fr_range", *[F.last(f"_fr_last.{o}", ignorenulls=True).over(earlier).alias(c)
                                                     for o, c in zip(own, carried)])
    out = null_safe_join(local, carry, [*group, "_fr_range"])
    return out.select(*[F.coalesce(F.col(own[cols.index(c)]), F.col(carried[cols.index(c)])).alias(c) if c in cols
                        else c_(c) for c in df.columns])


def number_lines(df: DataFrame, out: str = "line") -> DataFrame:
    """SC2: one dense line number from 1 on, in the order of files and of the rows in them.

    ``df`` is a frame of ``scan_many_ordered``.  Rows are numbered inside their
    split, the splits' counts are summed up in the order of paths and offsets
    (``running_sum`` over one row per split), and each split starts from its sum:
    the numbers are the same for any size of splits, and no task holds more than
    a split.  Both uses of the rows read one shuffle, so a split is read once and
    its bounds can't change between them.
    """
    own = ["_file", "_split", "_row"]
    rows = df.repartition("_file", "_split")
    at = Window.partitionBy("_file", "_split").orderBy("_row")
    whole = F.struct(*[F.col(quoted(c)) for c in df.columns])
    # whole rows here too: the same columns, the same shuffle
    sizes = rows.groupBy("_file", "_split").agg(F.count(F.lit(1)).alias("_n"), F.max_by(whole, "_row").alias("_last")) \
        .select("_file", "_split", F.when(F.col("_last").isNotNull(), F.col("_n")).alias("_n")).repartition("_file")
    starts = running_sum(shared(sizes), "_n", ["_file", "_split"], "_upto") \
        .select("_file", "_split", (F.col("_upto") - F.col("_n")).alias("_start"))
    numbered = rows.withColumn(out, F.row_number().over(at)).join(starts, ["_file", "_split"])
    return numbered.withColumn(out, F.col("_start") + F.col(out)).drop("_start", *own)


def fill_hierarchy(df: DataFrame, levels: list[str], order: str, header_col: str, header_value: str,
                   leaf_col: str, group: list[str] | None = None, chunk: int | None = None,
                   ranges: int | None = None) -> DataFrame:
    """CL9: drop repeated header rows (PF14, NULL kept), forward-fill the
    hierarchy levels in file order, keep only leaf rows (PF13).  ``order`` is one
    column, such as the number of ``number_lines``; ranges of it (at quantiles, or
    ``chunk`` wide) are filled apart, so a sheet of any length is never one task's
    work."""
    body = df.where(~F.col(header_col).eqNullSafe(F.lit(header_value)))
    filled = fill_forward(body, group or [], order, levels, chunk, ranges=None if chunk else _ranges(df, ranges))
    return filled.where(F.col(leaf_col).isNotNull())


def top_n_per_group(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """SL4/WN6: first n rows per group (row_number ≤ n → WindowGroupLimit)."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("ranking", F.row_number().over(w)).where(F.col("ranking") <= n)


def order_key(df: DataFrame, order: list) -> Column:
    """``order`` as one struct whose natural order is the order asked for.

    Items are names or sort orders of columns (``F.col(name).desc()`` and the
    like).  Each becomes a flag that places NULL and a value that ascends:
    integers are complemented for descending order, other numbers negated, dates
    and times counted, texts written in complemented hexadecimal digits.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    parts = []
    for item in order:
        text = item if isinstance(item, str) else str(item)[len("Column<'"):-len("'>")]
        m = None if isinstance(item, str) else re.fullmatch(r"(.*) (ASC|DESC) NULLS (FIRST|LAST)", text)
        name, down, last = (m[1], m[2] == "DESC", m[3] == "LAST") if m else (text, False, False)
        name = name.strip("`").replace("``", "`")
        if name not in kinds:
            raise ValueError(f"order is by columns; {name!r} is none")
        c, kind = F.col(quoted(name)), kinds[name]
        if down:
            c = _falling(c, kind)
        parts += [F.when(F.col(quoted(name)).isNull(), int(last)).otherwise(int(not last)), c]
    return F.struct(*[p.alias(f"k{k}") for k, p in enumerate(parts)])


def _falling(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.IntegralType):
        return F.bitwise_not(c.cast("bigint"))
    if isinstance(kind, T.NumericType):
        return -c
    if isinstance(kind, T.BooleanType):
        return ~c
    if isinstance(kind, T.DateType):
        return -F.unix_date(c)
    if isinstance(kind, T.TimestampType):
        return -F.unix_micros(c)
    digits = "0123456789ABCDEF"  # G closes a text: the longer of two that begin alike comes first
    return F.concat(F.translate(F.hex(c.cast("binary")), digits, digits[::-1]), F.lit("G"))


#: Rows of the sample per range; its splitters are every so many-th of them.
SAMPLED = 16


def with_range(df: DataFrame, key: Column, ranges: int, name: str = "_range") -> DataFrame:
    """``df`` with the range of each row, 0 to ``ranges``, a function of its ``key`` alone.

    Splitters are quantiles of a sample: of each of ``SAMPLED * ranges`` classes of
    keys by one hash, the key with the smallest other hash; a uniform sample of any
    table that is the same whenever it is taken, and combined in the tasks before
    it is shuffled by class.  The splitters are one bounded row, evaluated once per
    plan as a scalar subquery.  Rows of equal keys share a range.
    """
    sample = df.select(key.alias("k")).groupBy(F.pmod(F.xxhash64("k"), F.lit(SAMPLED * ranges)).alias("class")) \
        .agg(F.min_by("k", F.xxhash64(F.lit(1), "k")).alias("k"))
    width = max(1, math.isqrt(ranges))
    # a splitter for every SAMPLED rows of the sample: a small table has fewer ranges
    splits = sample.agg(F.sort_array(F.collect_list("k")).alias("s")) \
        .select(F.filter("s", lambda k, i: (i + 1) % SAMPLED == 0).alias("all")) \
        .select(F.struct("all", F.filter("all", lambda k, i: i % width == width - 1).alias("heads")))
    at = df.withColumn("_wr_splits", splits.scalar()).withColumn("_wr_key", key)
    # the blocks of splitters that lie before the row, then the splitters of the block it falls into
    at = at.withColumn("_wr_before", F.size(F.filter("_wr_splits.heads", lambda k: k <= F.col("_wr_key"))) * width)
    inner = F.size(F.filter(F.slice("_wr_splits.all", F.col("_wr_before") + 1, width), lambda k: k <= F.col("_wr_key")))
    return at.withColumn(name, F.col("_wr_before") + inner).drop("_wr_splits", "_wr_key", "_wr_before")


def _ranges(df: DataFrame, ranges: int | None) -> int:
    return ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def running_sum(df: DataFrame, value, order: list, out: str, by: list[str] | None = None,
                ranges: int | None = None, count: str | None = None, total: str | None = None) -> DataFrame:
    """WN3/WN5: cumulative sum of ``value`` in ``order`` (within ``by``), ROWS frame.

    ``order`` (names or sort orders of columns) must be a total order: end it with
    a unique key.  ``count`` names a column for the row number in the same order,
    ``total`` one for the group's whole sum, both from the same pass.

    No group is sorted in one task: rows are dealt into ranges of (by, order) by
    splitters (``with_range``), so a large group is split; each range computes its
    sums, and a range starts from the prefix sum of the totals of the earlier
    ranges, a summary of at most #groups + #ranges rows.  NULL is a group like
    any other.  The range is a function of the row, so nothing is cached; the
    summary takes whole rows of the local sums, so both have the same columns and
    one shuffle serves them.  ``ranges`` defaults to the session's shuffle
    partitions.  The splitters take another read of ``df``, of the order's columns
    alone; an aggregate goes through ``shared`` first, to be computed once.
    """
    by = list(by or [])
    c_ = lambda name: F.col(quoted(name))
    v = c_(value) if isinstance(value, str) else value
    upto = (Window.unboundedPreceding, Window.currentRow)
    key = order_key(df, [*by, *order])
    dealt = with_range(df, key, _ranges(df, ranges), "_rs_range").withColumn("_rs_v", v)
    inside = Window.partitionBy(*map(c_, by), "_rs_range").orderBy(*[c_(o) if isinstance(o, str) else o for o in order]) \
        .rowsBetween(*upto)
    local = dealt.withColumn("_rs_sum", F.sum("_rs_v").over(inside)).withColumn("_rs_n", F.count(F.lit(1)).over(inside)) \
        .withColumn("_rs_key", key)
    last = local.groupBy(*map(c_, by), "_rs_range").agg(F.max_by(F.struct(*map(c_, local.columns)), "_rs_key").alias("_rs_last"))
    earlier = Window.partitionBy(*map(c_, by)).orderBy("_rs_range").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    offsets = last.select(*map(c_, by), "_rs_range",
                          zero(F.sum("_rs_last._rs_sum").over(earlier)).alias("_rs_sum0"), zero(F.sum("_rs_last._rs_n").over(earlier)).alias("_rs_n0"),
                          F.sum("_rs_last._rs_sum").over(Window.partitionBy(*map(c_, by))).alias("_rs_total"))
    joined = null_safe_join(local, offsets, [*by, "_rs_range"])
    more = {out: F.col("_rs_sum0") + F.col("_rs_sum")}
    if count:
        more[count] = F.col("_rs_n0") + F.col("_rs_n")
    if total:
        more[total] = F.col("_rs_total")
    return joined.withColumns(more).drop("_rs_range", "_rs_v", "_rs_sum", "_rs_n", "_rs_key", "_rs_sum0", "_rs_n0", "_rs_total")
