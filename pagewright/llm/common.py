"""Helpers that the corpus operators share: work tables, words and hashing."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the only characters that part words here.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]+"
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only where the session names none and runs on one machine, as in tests, a temporary folder is made and remembered.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="pagewright-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/pagewright/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def _settings(spark: SparkSession, values: dict[str, str]):
    """Session settings that hold inside."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def materialise(df: DataFrame, name: str, batch_rows: int | None = None, codec: str = "snappy", parted: str | None = None, options: dict[str, str] | None = None) -> DataFrame:
    """Write a work table to the shared folder and read it back, which cuts the lineage.

    A lost executor costs a re-read of files, not a rerun of what made them. Shuffle files go when the table is
    complete, as nothing reads them again. ``batch_rows``: rows of a batch that goes to Python, where rows are wide.
    ``parted``: a column of few values that have folders of their own; a task writes them side by side, unsorted.
    ``discard`` deletes the table.
    """
    spark = df.sparkSession
    path = work_path(spark, name)
    with _settings(spark, {SHUFFLE_CLEANUP: "true"} | ({BATCH_ROWS: str(batch_rows)} if batch_rows else {}) | ({WRITERS: "8"} if parted else {})):
        df.write.options(**(options or {})).option("compression", codec).parquet(path, partitionBy=parted)
    out = spark.read.schema(df.schema).parquet(path)
    out._work_path = path
    return out


def collected(df: DataFrame):
    """A bounded table on the driver, as Arrow; its shuffle files go at once."""
    with _settings(df.sparkSession, {SHUFFLE_CLEANUP: "true"}):
        return df.select("*").toArrow()


def discard(*tables: DataFrame) -> None:
    """Delete work tables that nothing reads any more. Tables that are not work tables stay."""
    for table in tables:
        path = vars(table).pop("_work_path", None)
        if path:
            remove(table.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def numbered(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The table with its columns named ``in0``, ``in1``, ... and these names by the old ones.

    Inside an operator no column of the caller can then clash with one of its own, whatever the caller's are called.
    """
    names = [f"in{i}" for i in range(len(df.columns))]
    return df.toDF(*names), dict(zip(df.columns, names))


def restored(df: DataFrame, names: dict[str, str], **instead: Column) -> DataFrame:
    """The caller's columns again, those in ``instead`` replaced."""
    return df.select(*[instead.get(old, F.col(new)).alias(old) for old, new in names.items()])


def word_array(text: Column) -> Column:
    """The words of a text as an array; null gives an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+"), "")


def word_count(text: Column) -> Column:
    """Number of words, without building an array of them."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_CLASS)), F.lit(0)).cast("long")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
