"""Silver tables: the conformed roles written once, read by every analysis.

In production the fact-to-dimension joins of the role views (events ⋈
supplier ⋈ part, orders ⋈ customer) run once per data refresh instead of once
per analysis.  Facts are range-partitioned on (date, row hash) and sorted by
date before writing, so parquet row-group statistics let period filters
(``event_date BETWEEN``) skip data, and no date holds a writer alone.  Tables are written dimensions first (``publish``), and readers get
the same role schemas as ``ratewise.sources.fixtures``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratewise.sources import fixtures as fx
from ratewise.sources.tables import publish

DEPENDS_ON = {
    "events_fact": ["sectors", "occupations", "diagnoses"],
    "exposure": ["sectors"],
    "notices": [],
}
DATE_COL = {"events_fact": "event_date", "notices": "event_date", "exposure": "year"}


def build_roles(spark: SparkSession, raw_dir: str) -> dict[str, DataFrame]:
    """The role views over a raw data folder, clustered by date for writing."""
    roles = {
        "sectors": fx.sectors(spark, raw_dir),
        "occupations": fx.occupations(spark, raw_dir),
        "diagnoses": fx.diagnoses(spark, raw_dir),
        "events_fact": fx.events_fact(spark, raw_dir),
        "exposure": fx.exposure(spark, raw_dir),
        "notices": fx.notices(spark, raw_dir),
    }
    for name, col in DATE_COL.items():
        roles[name] = date_clustered(roles[name], col)
    return roles


def date_clustered(df: DataFrame, col: str, partitions: int | None = None) -> DataFrame:
    """Range-partition on (date, row hash), sort by date inside each partition.

    The row hash after the date lets the sampled range bounds fall inside one
    date, so a hot date (or a year-grained column with 3 values) is spread
    over many writers instead of one; each file still covers a narrow date
    range.  Without ``partitions`` the count comes from the session and AQE
    may coalesce it.
    """
    spread = F.xxhash64(*[F.col(c) for c in df.columns])
    keys = [F.col(col), spread]
    r = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    return r.sortWithinPartitions(col)


def publish_silver(spark: SparkSession, raw_dir: str, out_dir: str,
                   selected: list[str] | None = None) -> list[str]:
    """Write the selected roles (and the facts that depend on them) under ``out_dir``."""
    return publish(build_roles(spark, raw_dir), out_dir, DEPENDS_ON, selected)


def read_role(spark: SparkSession, silver_dir: str, name: str) -> DataFrame:
    """One silver role table."""
    return spark.read.parquet(f"{silver_dir.rstrip('/')}/{name}")
