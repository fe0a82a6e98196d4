"""ST1 + CL2: keep-last kept up to date as overlapping batches arrive.

The table is kept in buckets of the identity key.  A micro-batch rewrites the
buckets that its keys fall into, and no others: the rows of those buckets and of
the batch go through ``dedup_keep_last`` together and are written under the
batch's number,

    rows/batch=<number>/bucket=<bucket>/...     one version of a bucket
    heads/batch=<number>/...                    the buckets that the batch rewrote

and ``heads`` is written last: a batch counts once its heads are there.  A bucket's
rows are those of the latest batch that rewrote it.  A batch that is run again
(the stream replays it after a failure) starts from the versions before it and
overwrites its own folders, so running it twice changes nothing.  Keep-last is
associative, so the result is that of one pass over all batches together.

Work and memory follow the batch and the buckets it touches; the driver sees one
number per bucket.  Rows are shuffled once and sorted once per batch: they are dealt
by bucket and part of a bucket, which serves keep-last and the writing alike, and a
task holds a few parts, not whole buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratewise.functions.text import quoted
from ratewise.operators.windows import dedup_keep_last
from ratewise.sources.tables import exists, remove

BUCKETS = 64
#: Parts that a bucket's rows are dealt to, and files that it has at most.
PARTS = 16


def _hash(key: list[str]):
    return F.xxhash64(*[F.col(quoted(k)) for k in key])


def _bucket(key: list[str], buckets: int):
    return F.pmod(_hash(key), F.lit(buckets)).cast("int")


def _part(key: list[str]):
    """The part of its bucket, by other bits of the hash."""
    return F.pmod(F.shiftright(_hash(key), 32), F.lit(PARTS)).cast("int")


def heads(spark: SparkSession, root: str, before: int | None = None) -> dict[int, int]:
    """The latest batch of each bucket (of batches under ``before``): one row per bucket comes to the driver."""
    if not exists(spark, f"{root}/heads"):
        return {}
    known = spark.read.schema("bucket int, batch long").parquet(f"{root}/heads")
    if before is not None:
        known = known.where(F.col("batch") < before)
    return {r.bucket: r.batch for r in known.groupBy("bucket").agg(F.max("batch").alias("batch")).collect()}


def _read(spark: SparkSession, root: str, latest: dict[int, int], schema: T.StructType) -> DataFrame:
    paths = [f"{root}/rows/batch={batch}/bucket={bucket}" for bucket, batch in sorted(latest.items())]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def apply_batch(batch: DataFrame, number: int, root: str, key: list[str], order: list[str],
                buckets: int = BUCKETS) -> list[int]:
    """Take one batch in; returns the buckets it rewrote.  Safe to repeat."""
    spark = batch.sparkSession
    schema = batch.schema
    dealt = batch.withColumn("bucket", _bucket(key, buckets))
    touched = [r.bucket for r in dealt.select("bucket").distinct().orderBy("bucket").collect()]
    if not touched:
        return []
    latest = {b: v for b, v in heads(spark, root, number).items() if b in set(touched)}
    both = batch.unionByName(_read(spark, root, latest, schema)) if latest else batch
    place = ["bucket", "_part"]
    placed = both.withColumns({"bucket": _bucket(key, buckets), "_part": _part(key)}).repartition(*place)
    kept = dedup_keep_last(placed, place + key, order).drop("_part")
    kept.write.mode("overwrite").partitionBy("bucket").option("compression", "zstd").parquet(f"{root}/rows/batch={number}")
    spark.createDataFrame([(b,) for b in touched], "bucket int").coalesce(1) \
        .write.mode("overwrite").parquet(f"{root}/heads/batch={number}")
    return touched


def current(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """The table as of the last batch: the latest version of every bucket."""
    return _read(spark, root, heads(spark, root), schema)


def vacuum(spark: SparkSession, root: str) -> int:
    """Delete the versions that later batches have replaced; returns how many.  For a time without a running batch."""
    latest = heads(spark, root)
    known = spark.read.schema("bucket int, batch long").parquet(f"{root}/heads") if latest else None
    old = [(r.batch, r.bucket) for r in known.distinct().collect() if latest[r.bucket] != r.batch] if latest else []
    for batch, bucket in old:
        remove(spark, f"{root}/rows/batch={batch}/bucket={bucket}")
    return len(old)


def start_upsert(spark: SparkSession, landing: str, root: str, checkpoint: str, schema: T.StructType,
                 key: list[str], order: list[str], buckets: int = BUCKETS, fmt: str = "parquet",
                 files_per_batch: int | None = None, available_now: bool = True, **options):
    """Start the stream that takes in the files of ``landing`` as they come; returns the StreamingQuery."""
    reader = spark.readStream.schema(schema).format(fmt).options(**options)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", str(files_per_batch))
    w = reader.load(landing).writeStream.option("checkpointLocation", checkpoint) \
        .foreachBatch(lambda batch, number: apply_batch(batch, number, root, key, order, buckets) and None)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")).start()
