"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gavelstream.shipping import ship_package

#: White space of every word-based operator here, as a class of Java's and Python's regular expressions.
WHITE = r"[\x20\x09-\x0D]"
#: A word is what such white space separates.
WORD = r"[^\x20\x09-\x0D]+"
#: Sorts after every real id; stands for a null id where an order is needed.
LAST_ID = 2**63 - 1


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (spark.checkpoint.dir).

    Where it is unset a local master gets a temporary folder; a cluster has no
    safe default, so there it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="spark-")
    return _local_dirs[app]


_local_dirs: dict[str, str] = {}


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back.

    This cuts the lineage, so that several readers share one computation, and
    survives lost executors. The files stay until the folder is cleared.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1000, size: str = "16m") -> None:
    """Make Python workers ready: send them the package, and bound an Arrow batch so that long texts fit their memory."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def fixed_splits(spark: SparkSession) -> None:
    """Keep the way files are split from following the number of executors, which may change while a query runs.

    Operators that number rows by scan order need every pass to see one order.
    """
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        spark.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))


def least_hashed(rows: DataFrame, place: Column, most: int, expected: float | None = None) -> DataFrame:
    """At most `most` of the rows, those of the least place, a pseudorandom long from 0 on.

    Ordering takes `most` rows of every task to one, so that only a share of the
    rows takes part, twice as many as are asked for at least if there are
    `expected` rows (unset, they are counted).
    """
    expected = rows.count() if expected is None else expected
    if expected > 2 * most + 1000:
        rows = rows.where(place < int((2 * most + 1000) / expected * 2**63))
    return rows.orderBy(place, *[c for c in rows.columns if c in ("doc_id", "text")]).limit(most)


def from_files(df: DataFrame) -> DataFrame:
    """df, written first if it does not come from files.

    Files give the same rows in the same order each time; rows of other origin
    need not. A DataFrame that joins, groups or deals out what it reads from
    files need not either, and is the caller's to write.
    """
    return df if df.inputFiles() else stash(df, "rows")


def unused(name: str, columns: list[str]) -> str:
    """The name, with as many underscores before it as make it a new one (Spark compares names without case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
