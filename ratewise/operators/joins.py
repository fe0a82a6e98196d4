"""Join operators that need more than one equi-join (JN10, JN11/CL15, JN12)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratewise.functions.text import quoted


def or_join_labels(facts: DataFrame, dim: DataFrame, code: str = "code",
                   sub: str = "sub", cat: str = "cat", labels=("sub_label", "cat_label"),
                   prefer_exact: bool = False) -> DataFrame:
    """JN10: ``facts LEFT JOIN dim ON code = sub OR code = cat`` without a nested loop.

    Every dim row is listed under its subcategory and its category code (once
    when they are equal), and one left equi-join on that list gives the pairs of
    the OR condition; ``facts`` is read once, and rows matching neither keep
    NULL labels.  A category code matches every subcategory row of the
    category, exactly as the OR condition does (K8).  ``prefer_exact=True`` keeps one row per fact row
    instead: the subcategory's labels if the code is a subcategory, else only
    the category label — no fan-out.
    """
    lab = list(labels)
    d = dim.select(F.col(sub).alias("_sub"), F.col(cat).alias("_cat"), *lab)
    if prefer_exact:
        sub_l, cat_l = lab
        by_sub = d.select("_sub", *lab).dropDuplicates(["_sub"])
        by_cat = d.groupBy(F.col("_cat").alias("_kc")).agg(F.min(cat_l).alias("_k_cat"))
        x = facts.join(by_sub, facts[code] == F.col("_sub"), "left")
        x = x.join(by_cat, x[code] == F.col("_kc"), "left")
        hit = F.col("_sub").isNotNull()
        return x.select(*facts.columns,
                        F.when(hit, F.col(sub_l)).alias(sub_l),
                        F.when(hit, F.col(cat_l)).otherwise(F.col("_k_cat")).alias(cat_l))
    keys = d.select(F.explode(F.array_distinct(F.array_compact(F.array("_sub", "_cat")))).alias("_key"), *lab)
    return facts.join(keys, facts[code] == F.col("_key"), "left").drop("_key")


#: Largest dictionary, by the planner's measure, that is turned into maps; past it, joins.
MAP_BYTES = 64 << 10


def plan_bytes(df: DataFrame) -> int:
    """The planner's measure of a frame's size, known without running it (very large where it knows nothing)."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def decode_dictionary(df: DataFrame, dictionary: DataFrame, columns: dict[str, str],
                      suffix: str = "_label", name_col: str = "column_name",
                      key_col: str = "key", value_col: str = "value", map_bytes: int = MAP_BYTES) -> DataFrame:
    """CL15/JN11: decode code columns through an EAV dictionary.

    ``columns`` maps a column of ``df`` to its name in the dictionary; the label of
    a column is ``<column><suffix>``.  Repeated dictionary rows of a key decode to
    the least value (JN12), unmatched and NULL codes to NULL.

    A dictionary of up to ``map_bytes`` is pivoted once into a map per column, one
    row in all (a scalar subquery), and every column is looked up in its map: no
    join and no shuffle of ``df`` for any number of columns.  A larger one (or of
    unknown size) is joined once per column without a hint, so the planner
    broadcasts what its size allows and shuffles the rest with skew splitting.
    Nothing runs while the plan is built.
    """
    names = sorted(set(columns.values()))
    entries = dictionary.where(F.col(quoted(name_col)).isin(names)) \
        .groupBy(F.col(quoted(name_col)).alias("_name"), F.col(quoted(key_col)).cast("string").alias("_key")) \
        .agg(F.min(quoted(value_col)).alias("_value")).where(F.col("_key").isNotNull())
    code = lambda c: F.col(quoted(c)).cast("string")
    if plan_bytes(dictionary) <= map_bytes:
        pair = F.struct("_key", "_value")
        maps = entries.agg(F.struct(*[
            F.map_from_entries(F.collect_list(F.when(F.col("_name") == n, pair))).alias(f"m{k}")
            for k, n in enumerate(names)])).scalar()
        out = df.withColumn("_maps", maps)
        return out.withColumns({c + suffix: F.try_element_at(F.col(f"_maps.m{names.index(n)}"), code(c))
                                for c, n in columns.items()}).drop("_maps")
    out = df
    for c, n in columns.items():
        d = entries.where(F.col("_name") == n).select("_key", F.col("_value").alias(c + suffix))
        out = out.join(d, code(c) == F.col("_key"), "left").drop("_key")
    return out
