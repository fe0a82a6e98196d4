"""Connected components of a link table, by alternating large-star and small-star steps.

Each step sends the neighbours of a node to the smallest of them, aggregated
before the shuffle; the links never leave the cluster and only their number and
a checksum come to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratewise.llm.common import materialise


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Links (u > v) after one step; ``large``: neighbours above a node go to its least neighbour,
    otherwise the node and its neighbours below."""
    if large:
        near = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = links.select("u", "v")
    least = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    joined = near.join(least, "u")
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")) \
            .unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")) \
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (u, v); component is the smallest node reachable."""
    now = links.where(F.col("u") != F.col("v")) \
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    seen = None
    while True:
        now = materialise(_star(_star(now, large=True), large=False), "components")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            break
        seen = tuple(state)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")) \
        .unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
