"""Rank selection in large groups (AG8)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratewise.functions.text import quoted
from ratewise.operators.windows import running_sum
from ratewise.plans.shared import shared


def group_median(df: DataFrame, group: list[str], value: str, out: str = "median", rows: str = "rows",
                 ranges: int | None = None) -> DataFrame:
    """AG8 for groups of any size: the exact interpolated median of ``value`` per ``group``.

    Equal values are counted first, before the shuffle.  The counts are dealt into
    ranges of (group, value), the ranges' sums give every value the ranks that it
    takes up in its group (``running_sum``), and the values at the two middle ranks
    are picked.  No group is in one task and none is held as a list.

    NULL values don't count, NULL is a group like any other, and a group without a
    value has NULL.  ``rows`` names the count of values.  The result is a double.
    """
    keys = [F.col(quoted(g)) for g in group]
    per = df.groupBy(*keys, F.col(quoted(value)).alias("_value")).agg(F.count(F.col(quoted(value))).alias("_n"))
    ranked = running_sum(shared(per), "_n", ["_value"], "_upto", group, ranges, total=rows)
    first, last = F.col("_upto") - F.col("_n"), F.col("_upto") - 1  # ranks of this value, from 0

    def at(rank):
        return F.max(F.when((first <= rank) & (rank <= last), F.col("_value").cast("double")))
    low, high = at(F.expr(f"({quoted(rows)} - 1) div 2")), at(F.expr(f"{quoted(rows)} div 2"))
    picked = ranked.groupBy(*keys).agg(F.max(quoted(rows)).alias(rows), low.alias("_low"), high.alias("_high"))
    return picked.select(*keys, quoted(rows), (F.col("_low") + (F.col("_high") - F.col("_low")) / 2).alias(out))
