"""Data-quality checks.

Each check is a lazy DataFrame: one aggregate over the checked table, so a
check costs one scan and a small shuffle, and never brings rows to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ratewise.functions.exact import percent_half_up
from ratewise.functions.text import quoted


def key_check(df: DataFrame, key: list[str]) -> DataFrame:
    """DQ1: rows, distinct keys, keys seen more than once, surplus rows."""
    per = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    return per.agg(F.sum("_n").cast("bigint").alias("rows"),
                   F.count(F.lit(1)).alias("distinct_keys"),
                   F.count_if(F.col("_n") > 1).alias("duplicated_keys"),
                   F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n") - 1)), F.lit(0)).cast("bigint")
                    .alias("surplus_rows"))


def split_not_null(df: DataFrame, cols: list[str]) -> tuple[DataFrame, DataFrame]:
    """DQ2: (accepted, rejected) — rejected rows have a NULL in a required column."""
    bad = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in cols])
    return df.where(~bad), df.where(bad)


def with_verdict(df: DataFrame, cols: list[str], out: str = "verdict") -> DataFrame:
    """DQ2 in one pass: 'rejected' for rows with a NULL in a required column, else 'accepted'.

    Both sides stay in one frame, to be counted or landed together
    (``land_batch(..., partition_by=[out])``).
    """
    bad = reduce(lambda a, b: a | b, [F.col(quoted(c)).isNull() for c in cols])
    return df.withColumn(out, F.when(bad, F.lit("rejected")).otherwise(F.lit("accepted")))


def not_null_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """DQ2 summary: NULL count per required column."""
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(f"{c}_nulls") for c in cols])


def orphans(fact: DataFrame, key: str, dim: DataFrame, dim_key: str) -> DataFrame:
    """DQ3: fact rows whose non-NULL key has no dimension row: count and %."""
    per = fact.groupBy(F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    known = dim.select(F.col(dim_key).alias("_k")).distinct().withColumn("_hit", F.lit(True))
    j = per.join(known, "_k", "left")
    return j.agg(F.sum("_n").cast("bigint").alias("rows"),
                 F.coalesce(F.sum(F.when(F.col("_k").isNotNull() & F.col("_hit").isNull(), F.col("_n"))),
                            F.lit(0)).cast("bigint").alias("orphan_rows"),
                 F.count_if(F.col("_k").isNotNull() & F.col("_hit").isNull()).alias("orphan_keys")) \
            .withColumn("pct_orphan", percent_half_up(F.col("orphan_rows"), F.col("rows"), 2))


def orphan_rows(fact: DataFrame, key: str, dim: DataFrame, dim_key: str) -> DataFrame:
    """DQ3 listing: the orphan rows themselves (left anti-join)."""
    return fact.where(F.col(key).isNotNull()).join(
        dim.select(F.col(dim_key).alias(key)).distinct(), key, "left_anti")


def width_check(df: DataFrame, widths: dict[str, int]) -> DataFrame:
    """DQ4: per column, values longer than the declared width."""
    return df.agg(*[F.count_if(F.length(c) > n).alias(f"{c}_too_long") for c, n in widths.items()])


def range_check(df: DataFrame, col: str, type_name: str) -> DataFrame:
    """DQ5: values that do not fit the target type (NULL after try_cast)."""
    v = F.col(col)
    return df.agg(F.count_if(v.isNotNull()).alias("non_null"),
                  F.count_if(v.isNotNull() & v.try_cast(type_name).isNull()).alias("out_of_range"))


def empty_columns(df: DataFrame) -> DataFrame:
    """DQ6: non-NULL count per column, one row per column (0 = all NULL)."""
    counts = df.agg(*[F.count(F.col(quoted(c))).alias(f"n{k}") for k, c in enumerate(df.columns)])
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"n{k}").cast("bigint").alias("non_null"))
                      for k, c in enumerate(df.columns)])
    return counts.select(F.explode(pairs).alias("p")).select("p.column_name", "p.non_null") \
                 .withColumn("all_null", F.col("non_null") == 0)


def one_to_one(df: DataFrame, short_key: str, long_key: str) -> DataFrame:
    """DQ7: short keys mapping to more than one long key (prefix must be unambiguous)."""
    per = df.groupBy(short_key).agg(F.count_distinct(long_key).alias("_k"))
    return per.agg(F.count(F.lit(1)).alias("short_keys"),
                   F.count_if(F.col("_k") > 1).alias("ambiguous_keys"))


@dataclass(frozen=True)
class Constraint:
    """One rule of a table: ``metric`` is an aggregate that counts what breaks it.

    For a rule that needs something to be there (``needs``), the metric counts
    that, and fewer than ``needs`` of it is one violation.
    """

    name: str
    column: str
    metric: Column
    needs: int = 0


def not_null(column: str) -> Constraint:
    """DQ2."""
    return Constraint("not_null", column, F.count_if(F.col(quoted(column)).isNull()))


def max_width(column: str, width: int) -> Constraint:
    """DQ4."""
    return Constraint(f"max_width_{width}", column, F.count_if(F.length(quoted(column)) > width))


def fits(column: str, type_name: str) -> Constraint:
    """DQ5: non-NULL values that the type can't hold."""
    c = F.col(quoted(column))
    return Constraint(f"fits_{type_name}", column, F.count_if(c.isNotNull() & c.try_cast(type_name).isNull()))


def one_of(column: str, values: list) -> Constraint:
    """Non-NULL values outside a fixed list."""
    return Constraint("one_of", column, F.count_if(~F.col(quoted(column)).isin(list(values))))


def filled(column: str) -> Constraint:
    """DQ6: a column that nothing fills."""
    return Constraint("filled", column, F.count(F.col(quoted(column))), needs=1)


def has_rows(at_least: int = 1) -> Constraint:
    """DQ8."""
    return Constraint(f"rows_{at_least}", "*", F.count(F.lit(1)), needs=at_least)


def watched(df: DataFrame, rules: list[Constraint], name: str | None = None) -> tuple[DataFrame, Observation]:
    """``df`` with the rules' metrics measured while it passes by, whatever is done with it.

    All metrics are one mergeable aggregate beside the rows: no scan, shuffle or
    pass of their own.  Put it right before the write, where each row passes once.
    """
    seen = Observation(name) if name else Observation()
    metrics = [r.metric.alias(f"m{k}") for k, r in enumerate(rules)]
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *metrics), seen


def constraint_report(spark: SparkSession, rules: list[Constraint], seen: dict) -> DataFrame:
    """One row per rule: (constraint, column_name, rows, violations, passed)."""
    rows = []
    for k, r in enumerate(rules):
        n = seen[f"m{k}"]
        broken = int(n < r.needs) if r.needs else n
        rows.append((r.name, r.column, seen["rows"], broken, not broken))
    return spark.createDataFrame(rows, "constraint string, column_name string, rows long, violations long, passed boolean")


def write_checked(df: DataFrame, rules: list[Constraint], path: str) -> DataFrame:
    """DQ2, DQ4-DQ6 and DQ8 in the scan that lands the table; the report is one row per rule."""
    through, seen = watched(df, rules)
    through.write.mode("overwrite").parquet(path)
    return constraint_report(df.sparkSession, rules, seen.get)
