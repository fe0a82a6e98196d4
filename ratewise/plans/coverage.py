"""Coverage rule.

A month is *adequate* when its event count is at least ``fraction`` times the
exact median of the monthly counts over the whole requested calendar, zero
months included (K1).

Plan shape, at any scale: the fact is reduced to one row per month by a
partial/final hash aggregate (one shuffle of at most #months rows per map
task), the month series is generated on the driver side of the plan (a
bounded LocalRelation: #months rows), and the two are joined with the
calendar as the broadcast side.  The median runs on the 1-row-per-month frame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def calendar(spark: SparkSession, start: str, end: str) -> DataFrame:
    """SC7: one row per month from the month of ``start`` to the month of ``end``."""
    return spark.range(1).select(
        F.explode(F.sequence(F.trunc(F.lit(start).cast("date"), "month"),
                             F.trunc(F.lit(end).cast("date"), "month"),
                             F.expr("INTERVAL 1 MONTH"))).alias("month"))


def monthly_counts(events: DataFrame, date_col: str = "event_date") -> DataFrame:
    """Events per month (partial aggregation before the shuffle)."""
    return (events.select(F.trunc(F.col(date_col), "month").alias("month"))
                  .groupBy("month").agg(F.count(F.lit(1)).alias("n")))


def coverage_from_counts(spark: SparkSession, monthly: DataFrame, start: str, end: str,
                         fraction: float = 0.5) -> DataFrame:
    """(month, n, ok) for every calendar month from a (month, n) frame.

    Months outside the calendar are ignored (K16/K17); months without events
    count as zero and take part in the median (K1).
    """
    cal = calendar(spark, start, end)
    lo = F.trunc(F.lit(start).cast("date"), "month")
    hi = F.trunc(F.lit(end).cast("date"), "month")
    # restricted to the calendar, the counts have at most #months rows: a
    # bounded broadcast side; the calendar itself is the probe side
    inside = monthly.where((F.col("month") >= lo) & (F.col("month") <= hi))
    dense = (cal.join(F.broadcast(inside), "month", "left")
                .select("month", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")))
    # AG8 + PF18: the median over the calendar's rows (one per month, a bounded
    # frame) next to each of them, so the counts are computed once
    med = F.percentile("n", F.lit(0.5)).over(Window.partitionBy())
    return dense.select("month", "n", (F.col("n") >= F.lit(fraction) * med).alias("ok"))


def coverage(spark: SparkSession, events: DataFrame, start: str, end: str,
             fraction: float = 0.5, date_col: str = "event_date") -> DataFrame:
    """A1 core: (month, n, ok) for every calendar month of an event fact."""
    return coverage_from_counts(spark, monthly_counts(events, date_col), start, end, fraction)


def coverage_monthly(spark: SparkSession, events: DataFrame, start: str, end: str,
                     fraction: float = 0.5) -> DataFrame:
    """A1: month as 'yyyy-MM', event count, adequate flag."""
    cov = coverage(spark, events, start, end, fraction)
    return cov.select(F.date_format("month", "yyyy-MM").alias("month"),
                      F.col("n").alias("events"), F.col("ok").alias("adequate"))


def adequate_months_per_year(cov: DataFrame) -> DataFrame:
    """A2: number of adequate months per calendar year."""
    return (cov.groupBy(F.year("month").alias("year"))
               .agg(F.count_if("ok").alias("adequate_months")))


def comparable_months(cov: DataFrame, first: int, last: int) -> DataFrame:
    """A3: months of the year adequate in both comparison years."""
    return (cov.where(F.year("month").isin(first, last))
               .groupBy(F.month("month").alias("month_of_year"))
               .agg(F.bool_and("ok").alias("all_ok"), F.count(F.lit(1)).alias("k"))
               .where(F.col("all_ok") & (F.col("k") == 2))
               .select("month_of_year"))


def coverage_summary(cov: DataFrame) -> DataFrame:
    """Adequate months out of the total, per year and overall."""
    scopes = cov.rollup(F.year("month").alias("year")).agg(
        F.count_if("ok").alias("adequate_months"), F.count(F.lit(1)).alias("months"))
    return scopes.select(F.coalesce(F.col("year").cast("string"), F.lit("all")).alias("scope"),
                         "adequate_months", "months",
                         (F.col("months") - F.col("adequate_months")).alias("inadequate_months"))
