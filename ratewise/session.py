"""Session helpers.

The library never creates a session inside an operator: every operator takes
DataFrames and returns a lazy DataFrame.  These helpers are for scripts,
tests and the bench only.
"""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

# Settings that hold at any scale.  Partition counts are left to AQE
# (coalescing after each shuffle), skew joins are split at run time, and
# ANSI mode stays on so bad casts and divisions by zero fail loudly unless an
# operator asks for try_* semantics on purpose.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    # PySpark otherwise records the Python call site of every Column function
    # (several JVM round trips and a stack walk per call) to enrich error
    # messages; with the exact-rounding expressions that is most of the
    # driver-side plan-building time.  Errors still name the failing expression.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "ratewise") -> SparkSession:
    """A local session for tests and the bench (UI off, AQE on)."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in BASE_CONF.items():
        builder = builder.config(k, v)
    builder = (builder
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", os.environ.get("RATEWISE_DRIVER_MEMORY", "16g")))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark

