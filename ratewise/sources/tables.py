"""Scans and sinks."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scan_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """SC4: read one parquet table of a data folder, as its files are now."""
    return spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")


CORRUPT = "_corrupt_record"


def scan_csv(spark: SparkSession, path, schema: T.StructType, sep: str = ";",
             encoding: str = "ISO-8859-1", header: bool = True, multi_line: bool = False,
             corrupt: str | None = CORRUPT) -> DataFrame:
    """SC1: delimited read with an explicit schema.

    Codes are declared as strings in ``schema`` so leading zeros survive; the
    schema is never inferred (integers with gaps would drift to double).  A
    quoted field may hold the separator and doubled quotes.  Files are split, so
    a large one is the work of many tasks; where fields hold line breaks, ask for
    ``multi_line`` (such files aren't split).  A row that doesn't fit the
    schema keeps its whole text in the ``corrupt`` column, which is NULL
    otherwise; ``corrupt=None`` makes such a row an error.
    """
    reader = (spark.read.option("sep", sep).option("encoding", encoding)
              .option("header", str(header).lower()).option("enforceSchema", "true")
              .option("quote", '"').option("escape", '"').option("multiLine", str(multi_line).lower()))
    if corrupt is None:
        return reader.option("mode", "FAILFAST").schema(schema).csv(path)
    return (reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", corrupt)
            .schema(T.StructType([*schema.fields, T.StructField(corrupt, T.StringType())])).csv(path))


def scan_many_ordered(spark: SparkSession, path, schema: T.StructType, **opts) -> DataFrame:
    """SC2: many files read as one frame, with an ingest-order key.

    The reference concatenates files sorted by path and keeps the last
    duplicate, so the order of rows matters.  Spark reads files in parallel in
    no particular order; the order is therefore made explicit as columns:
    ``_file`` (the whole path, so equal names in two folders stay apart),
    ``_split`` (byte offset of the split inside the file) and ``_row`` (a
    counter increasing with the row order inside a split); together they give
    a total order consistent with (file, line).
    """
    df = scan_csv(spark, path, schema, **opts)
    return (df.withColumn("_file", F.col("_metadata.file_path"))
              .withColumn("_split", F.col("_metadata.file_block_start"))
              .withColumn("_row", F.monotonically_increasing_id()))


def scan_years(spark: SparkSession, path_of, years, schema: T.StructType, year_col: str = "year",
               **opts) -> DataFrame:
    """SC3: one file (or folder) per year, ``path_of(year)``, stacked with the year as a column."""
    return union_all([scan_csv(spark, path_of(y), schema, **opts).withColumn(year_col, F.lit(int(y)))
                      for y in years])


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the cluster's shared folder (``spark.checkpoint.dir``); a local session
    without the setting gets a folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="ratewise-")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def union_all(frames: list[DataFrame]) -> DataFrame:
    """SO2/SO4/SC3: stack same-shape frames by column name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def table_counts(spark: SparkSession, root: str, names: list[str]) -> DataFrame:
    """SC8/A34/DQ8: row count of every named table, one row per table.

    Each count is a separate scan whose partial counts are combined; parquet
    answers ``count(*)`` from footers, so no column data is read.
    """
    parts = [scan_table(spark, root, n).agg(F.count(F.lit(1)).alias("n_rows"))
             .select(F.lit(n).alias("table_name"), "n_rows") for n in names]
    return union_all(parts)


def _files(spark: SparkSession, path: str):
    """Spark's file system for ``path`` (any store it reads) and the path in it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _files(spark, path)
    return fs.exists(at)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library wrote."""
    fs, at = _files(spark, path)
    fs.delete(at, True)


def list_tables(spark: SparkSession, root: str) -> list[str]:
    """Names of the parquet tables of a data folder."""
    fs, at = _files(spark, root)
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    return sorted(n[:-len(".parquet")] for n in names if n.endswith(".parquet"))


def register_tables(spark: SparkSession, root: str, prefix: str = "") -> list[str]:
    """SC4/SC8: every table of a data folder as a view in the session's catalog, ``prefix`` before its name."""
    names = list_tables(spark, root)
    for n in names:
        scan_table(spark, root, n).createOrReplaceTempView(prefix + n)
    return names


def catalog_counts(spark: SparkSession, prefix: str = "") -> DataFrame:
    """SC8/SO2/A34: row count of whatever the catalog lists under ``prefix``, one row per table."""
    names = [t.name for t in spark.catalog.listTables(pattern=f"{prefix}*")]
    empty = spark.range(0).select(F.lit("").alias("table_name"), F.col("id").alias("n_rows"))
    return union_all([empty, *[spark.table(n).agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.lit(n[len(prefix):]).alias("table_name"), "n_rows") for n in sorted(names)]])


def land(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> None:
    """SK1: write a collected source (bronze).  CSV gets a header, no index."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", "true").csv(path)
    else:
        w.format(fmt).save(path)


def append(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> None:
    """SK3: append rows to an existing table (batching = output partitions).

    ``partition_by`` must repeat the table's partition columns.
    """
    w = df.write.mode("append").format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def land_batch(df: DataFrame, path: str, batch: int, partition_by: list[str] | None = None) -> None:
    """SK3 with retries: a batch has a folder of its own, which landing it again replaces.

    The table is read from ``path`` with ``batch`` as a column.  Everything a batch
    wrote before goes, partitions that it no longer has too.
    """
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(f"{path}/batch={batch}")


def publish(tables: dict[str, DataFrame], root: str, depends_on: dict[str, list[str]],
            selected: list[str] | None = None) -> list[str]:
    """SK2: full refresh of the selected tables, dimensions before facts.

    Refreshing a dimension also invalidates every fact that references it
    (the reference empties them with TRUNCATE ... CASCADE), so those are
    rewritten too.  Returns the tables written, in write order.
    """
    chosen = set(selected or tables)
    changed = True
    while changed:  # close over dependants (small metadata graph, not data)
        changed = False
        for t, deps in depends_on.items():
            if t not in chosen and chosen.intersection(deps):
                chosen.add(t)
                changed = True
    order: list[str] = []

    def visit(t: str) -> None:
        if t in order:
            return
        for d in depends_on.get(t, []):
            if d in chosen:
                visit(d)
        order.append(t)

    for t in sorted(chosen):
        visit(t)
    for t in order:
        tables[t].write.mode("overwrite").parquet(f"{root.rstrip('/')}/{t}")
    return order
