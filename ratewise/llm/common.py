"""Helpers of the training-data operators: shared storage, names, row groups.

Intermediate results are written as Parquet to the folder that the cluster
names in ``spark.checkpoint.dir`` and read back, so a lost executor costs the
tasks it ran and not the lineage before the table.
"""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_CHECKPOINT = "spark.checkpoint.dir"
#: Scratch folder of each local application without the setting.
_SCRATCH: dict[str, str] = {}
#: Applications whose executors have this subpackage.
_SHIPPED: set[str] = set()


#: Session settings that bound what a Python worker holds of long texts: rows and bytes of an
#: Arrow batch (Spark's defaults are 10,000 rows and 64 MiB).  A value set by the user stays.
_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"),
          "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8388608b")}


def ship(spark: SparkSession) -> None:
    """Send this subpackage to the executors' Python workers, once per application, and bound
    the batches they get."""
    for key, (default, bounded) in _BATCH.items():
        if spark.conf.get(key) == default:
            spark.conf.set(key, bounded)
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    here = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="llm-code-")) / "ratewise_llm.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for file in (here.parent / "__init__.py", *sorted(here.glob("*.py"))):
            z.write(file, file.relative_to(here.parent.parent))
    spark.sparkContext.addPyFile(str(archive))
    _SHIPPED.add(app)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, through Spark's reader (any store Spark reads)."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a scratch folder only for a local session without one."""
    configured = spark.conf.get(_CHECKPOINT, None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError(f"{_CHECKPOINT} must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _SCRATCH:
        _SCRATCH[app] = "file://" + tempfile.mkdtemp(prefix="llm-shared-")
    return _SCRATCH[app]


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, evaluates once.

    ``options``: further ones of the Parquet writer.
    """
    spark = df.sparkSession
    ship(spark)
    path = fresh_path(spark, label)
    df.write.option("compression", "zstd").options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    """Partition count of the session's shuffles; grows with the cluster's setting."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spare_names(df: DataFrame, *wanted: str) -> list[str]:
    """Column names like ``wanted`` that ``df`` (case-insensitively) doesn't use."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def col(name: str) -> F.Column:
    """A column by its exact name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """``df`` reduced to the named columns: pick(df, doc_id='id', text='body')."""
    return df.select(*[col(src).alias(dst) for dst, src in columns.items()])


def identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, no_id, row_id, text): what Python tasks need of a document.

    A NULL id travels as 0 with ``no_id`` set, because pandas would turn a
    column of integers with NULLs into floats.  ``restored`` undoes it.
    """
    ship(docs.sparkSession)
    given = pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return given.select(F.coalesce("doc_id", F.lit(0).cast("long")).alias("doc_id"),
                        F.col("doc_id").isNull().alias("no_id"),
                        F.monotonically_increasing_id().alias("row_id"), "text")


def restored(df: DataFrame) -> DataFrame:
    """``doc_id`` NULL again where ``no_id`` is set; ``no_id`` dropped."""
    return df.withColumn("doc_id", F.when(~F.col("no_id"), F.col("doc_id"))).drop("no_id")


def remainder(doc_id: F.Column, divisor: int) -> F.Column:
    """crc32(doc_id as text) mod ``divisor``; a NULL id counts as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % divisor


def schema(text: str) -> T.StructType:
    return T.StructType.fromDDL(text)


def row_groups(batches: Iterable[pd.DataFrame], keys: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """Groups of consecutive equal ``keys`` over batches that are sorted by them.

    Holds one group and one batch: the caller bounds the size of a group.
    """
    held: list[pd.DataFrame] = []
    held_key: tuple | None = None
    for batch in batches:
        if not len(batch):
            continue
        change = (batch[keys] != batch[keys].shift()).any(axis=1).to_numpy().copy()
        change[0] = True
        starts = [*change.nonzero()[0], len(batch)]
        for lo, hi in zip(starts, starts[1:]):
            key = tuple(batch[k].iat[lo] for k in keys)
            if held and key != held_key:
                yield held_key, pd.concat(held, ignore_index=True)
                held = []
            held_key = key
            held.append(batch.iloc[lo:hi])
    if held:
        yield held_key, pd.concat(held, ignore_index=True)
