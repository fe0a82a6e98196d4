"""ST1: incremental landing of overlapping monthly files (optional extension).

The reference collects monthly event files that overlap each other and keeps
the last copy of each duplicate (CL2).  As a stream:

* a file-source ``readStream`` picks up new CSV files in the landing folder
  (explicit schema, latin1, ``;``), one micro-batch at a time;
* ``foreachBatch`` stamps every row with its ingest position
  (micro-batch id, file path, split offset, row counter) and appends the batch
  to a bronze parquet table;
* ``current_view`` re-applies keep-last over the bronze table with that
  ingest order, so a row from a later file (or later batch) replaces an
  earlier copy, exactly as concatenating the files in order and keeping the
  last duplicate would.

The stream is restartable from its checkpoint (exactly-once file tracking);
appends are idempotent per batch id because each batch writes into its own
``_batch=<id>`` partition with overwrite semantics for that partition only.
Note that ``dropDuplicatesWithinWatermark`` keeps the *first* row, which is why
it is not used here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratewise.operators.windows import dedup_keep_last

ORDER_COLS = ["_batch", "_file", "_split", "_row"]


def _stamp(batch: DataFrame, batch_id: int) -> DataFrame:
    return (batch.withColumn("_batch", F.lit(batch_id).cast("bigint"))
                 .withColumn("_row", F.monotonically_increasing_id()))


def start_landing(spark: SparkSession, landing: str, bronze: str, checkpoint: str,
                  schema: T.StructType, sep: str = ";", encoding: str = "ISO-8859-1",
                  max_files_per_trigger: int | None = None, available_now: bool = True):
    """Start the landing stream; returns the StreamingQuery."""
    reader = (spark.readStream.schema(schema).option("sep", sep).option("encoding", encoding)
                   .option("header", "true"))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    src = (reader.csv(landing)
                 .withColumn("_file", F.col("_metadata.file_path"))
                 .withColumn("_split", F.col("_metadata.file_block_start")))

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        (_stamp(batch, batch_id).write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("_batch").parquet(bronze))

    w = src.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def current_view(spark: SparkSession, bronze: str, key: list[str]) -> DataFrame:
    """Keep-last over everything landed so far (ingest order = batch, file, position)."""
    df = spark.read.parquet(bronze)
    kept = dedup_keep_last(df, key, ORDER_COLS)
    return kept.drop(*ORDER_COLS)
