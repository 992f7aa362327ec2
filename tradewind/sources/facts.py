"""Prepared facts, stored by month: a period reads its months only, new days replace theirs, footers tell the latest day."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.periods import Latest, month_name


# The rows that one write shuffles at once, and the most slices that more are dealt to, as each slice reads the input.
SLICE_ROWS, MOST_SLICES = 1_000_000, 8


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; with a local master and no such setting, a new one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"file://{tempfile.mkdtemp(prefix='spark-')}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _by_month(df: DataFrame, day: str) -> DataFrame:
    """df with its month; rows are dealt so that a month is in few files, and one with many rows in several."""
    return df.withColumn(month_name(day), F.trunc(day, "month")).hint("rebalance", month_name(day))


@contextlib.contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within it, what a query has shuffled leaves the disk when the query ends, not when the driver next collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def slices_for(rows: int) -> int:
    """The slices in which so many rows are written."""
    return max(1, min(MOST_SLICES, rows // SLICE_ROWS))


def sliced(df: DataFrame, key: str, slices: int) -> list[DataFrame]:
    """df in slices of about equal size, each with all rows of its keys; null is a key, too. Joins by the key are sliced on both sides."""
    if slices == 1:
        return [df]
    return [df.where(F.pmod(F.xxhash64(key), F.lit(slices)) == k) for k in range(slices)]


def write_facts(df: DataFrame, path: str, day: str = "date", key: str | None = None, slices: int = 1) -> None:
    """Writes a table of facts, by month, in place of all that was there. Rows without a day have a part of their own.

    Its columns are kept beside it, at path.columns, as a table without rows has no files. With slices, rows are written
    in so many by their keys, one after the other: the disk holds what one of them has shuffled, not what all have.
    """
    _by_month(df.limit(0), day).coalesce(1).write.mode("overwrite").parquet(f"{path}.columns")
    with freed_shuffles(df.sparkSession):
        for k, part in enumerate(sliced(df, key, slices)):
            _by_month(part, day).write.mode("append" if k else "overwrite").option("partitionOverwriteMode", "static").option("compression", "zstd").partitionBy(month_name(day)).parquet(path)


def replace_months(df: DataFrame, path: str, day: str = "date") -> None:
    """Writes the months that come in df in place of the same months, and leaves the others as they are."""
    _by_month(df, day).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(month_name(day)).parquet(path)


def _read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(spark.read.parquet(f"{path}.columns").schema).parquet(path)


def footer_session(spark: SparkSession) -> SparkSession:
    """A session of the same application that takes MIN, MAX and COUNT of Parquet files from their footers; the given one stays as it is."""
    session = spark.newSession()
    session.conf.set("spark.sql.sources.useV1SourceList", "")
    session.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return session


def footer_extent(spark: SparkSession, path: str, day: str = "date") -> DataFrame:
    """One row (first, last, n) of the facts that have a day, read from the files' footers alone; rows without a day are in files of their own."""
    rows = _read(footer_session(spark), path).where(F.col(month_name(day)).isNotNull())
    return rows.agg(F.min(day).alias("first"), F.max(day).alias("last"), F.count("*").alias("n"))


def read_facts(spark: SparkSession, path: str, day: str = "date") -> DataFrame:
    """Facts that write_facts() wrote, which know their latest day; a filter of them is a table of its own and does not."""
    df = _read(spark, path)
    df.latest = Latest(day, footer_extent(spark, path, day).first()["last"])
    return df
