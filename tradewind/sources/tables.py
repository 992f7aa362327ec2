"""Reading and writing tables: Parquet, JDBC, the catalog, report files, record files, layouts by key, published versions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .facts import freed_shuffles, sliced


@dataclass(frozen=True)
class Split:
    """How a JDBC table is read in parts: a column of numbers, days or times, and the parts. Bounds that are not given are asked for."""

    column: str
    parts: int
    first: str | int | None = None
    last: str | int | None = None


def scan_table(spark: SparkSession, name: str, folder: str | None = None, jdbc: dict[str, str] | None = None, split: Split | None = None) -> DataFrame:
    """A table by name: a Parquet file in a folder, a JDBC table, or one of the catalog.

    A JDBC table that is split is read by as many tasks as it has parts, each with its range of the column; the first
    and the last range are open, so that no row is lost whatever the bounds, nulls included. Filters and columns go to
    the database.
    """
    if folder is not None:
        return spark.read.parquet(f"{folder}/{name}.parquet")
    if jdbc is None:
        return spark.table(name)
    reader = spark.read.format("jdbc").options(**jdbc)
    if split is None:
        return reader.option("dbtable", name).load()
    first, last = split.first, split.last
    if first is None or last is None:
        column = spark.sparkContext._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(jdbc["url"]).quoteIdentifier(split.column)
        ends = reader.option("query", f"SELECT MIN({column}) AS a, MAX({column}) AS b FROM {name}").load().first()
        first, last = (ends[0] if first is None else first), (ends[1] if last is None else last)
    reader = spark.read.format("jdbc").options(**jdbc).option("dbtable", name)
    if first is None or last is None or split.parts < 2:  # an empty table, or nothing to split
        return reader.load()
    return reader.options(partitionColumn=split.column, lowerBound=str(first), upperBound=str(last), numPartitions=str(split.parts)).load()


def scan_csv_report(spark: SparkSession, path: str) -> DataFrame:
    """A report as text columns under its own header; a byte order mark is left out."""
    return spark.read.option("header", True).csv(path)


def list_tables(spark: SparkSession) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables() if not t.isTemporary)


def save_table(df: DataFrame, name: str, path: str | None = None) -> None:
    """Creates a catalog table, in place of one of that name; in a folder of its own, if a path is given."""
    writer = df.write.mode("overwrite")
    (writer if path is None else writer.option("path", path)).saveAsTable(name)


def save_by_key(df: DataFrame, name: str, key: str, buckets: int, path: str | None = None, slices: int = 1) -> DataFrame:
    """Creates a catalog table whose files are dealt by a key, and reads it.

    What is grouped, joined or numbered by that key, or by it and others, needs no shuffle of the table any more. Rows
    are dealt before they are written, so that each bucket is one file, or one of each slice: with slices, rows are
    written in so many by their keys, one after the other, and the disk holds what one of them has shuffled. Such a
    table has its name when all rows are there; it takes the place of none.
    """
    spark = df.sparkSession
    if slices > 1 and spark.catalog.tableExists(name):
        raise ValueError(f"there is a table {name}, which slices do not replace")
    fresh = name if slices == 1 else f"{name}_slices"
    with freed_shuffles(spark):
        for k, part in enumerate(sliced(df, key, slices)):
            writer = part.repartition(buckets, key).write.mode("append" if k else "overwrite").option("compression", "zstd").bucketBy(buckets, key).sortBy(key)
            (writer if path is None else writer.option("path", path)).saveAsTable(fresh)
    if fresh != name:
        spark.sql(f"ALTER TABLE {fresh} RENAME TO {name}")
    return spark.table(name)


def swap_tables(spark: SparkSession, name: str, fresh: str, backup: str) -> None:
    """Renames a table to its backup and a fresh one to its name. Between the two there is none of that name: publish() is for readers that go on."""
    spark.sql(f"ALTER TABLE {name} RENAME TO {backup}")
    spark.sql(f"ALTER TABLE {fresh} RENAME TO {name}")


# Published tables: every version is a table of its own, name_v<n>; `name` is a view of the current one, name_backup of the
# one before. Replacing the view is one step of the catalog, so readers find the old table or the new one.


def _versions(spark: SparkSession, name: str) -> dict[int, str]:
    found = [t for t in list_tables(spark) if t.startswith(f"{name.lower()}_v") and t[len(name) + 2 :].isdigit()]
    return {int(t[len(name) + 2 :]): t for t in found}


def _points_to(spark: SparkSession, view: str) -> str | None:
    """The version that a view shows."""
    if not spark.catalog.tableExists(view):
        return None
    return spark.sql(f"SHOW TBLPROPERTIES {view} ('published')").first()["value"]


def _point(spark: SparkSession, view: str, table: str) -> None:
    spark.sql(f"CREATE OR REPLACE VIEW {view} TBLPROPERTIES ('published' = '{table}') AS SELECT * FROM {table}")


def publish(df: DataFrame, name: str, path: str | None = None) -> str:
    """Makes df the table `name`, the one before its backup, and drops older versions; gives the new version's table.

    The version is written whole before anything points to it. If the job ends between two steps, `name` still shows a
    whole table, and repair() or the next publish() clears what is left over. One job at a time may publish a name.
    """
    spark = df.sparkSession
    repair(spark, name)
    old = _points_to(spark, name)
    fresh = f"{name.lower()}_v{max(_versions(spark, name), default=0) + 1}"
    save_table(df, fresh, None if path is None else f"{path}/{fresh}")
    if old is not None:
        _point(spark, f"{name}_backup", old)
    _point(spark, name, fresh)
    repair(spark, name)
    return fresh


def restore_backup(spark: SparkSession, name: str) -> None:
    """Makes the backup the current table again, and the current one the backup."""
    now, before = _points_to(spark, name), _points_to(spark, f"{name}_backup")
    if before is None:
        raise ValueError(f"{name} has no backup")
    _point(spark, name, before)
    _point(spark, f"{name}_backup", now)


def repair(spark: SparkSession, name: str) -> list[str]:
    """Drops the versions that neither the table nor its backup shows, whole or half written, and gives their names."""
    kept = {_points_to(spark, name), _points_to(spark, f"{name}_backup")}
    dropped = [t for t in _versions(spark, name).values() if t not in kept]
    for t in dropped:
        spark.sql(f"DROP TABLE IF EXISTS {t}")
    return dropped


def write_records(df: DataFrame, path: str) -> None:
    """One JSON record a row."""
    df.write.mode("overwrite").json(path)


class TooManyRecords(ValueError):
    """A result has more rows than a driver should take."""


def records(df: DataFrame, limit: int = 10_000) -> Iterator[dict]:
    """The rows of a bounded result as dicts, a partition at a time.

    The rows are counted first, up to one above the limit; with more than the limit nothing is fetched and
    TooManyRecords is raised, at the call. Nested rows become dicts, too.
    """
    few = df.limit(limit + 1).persist()
    if few.count() > limit:
        few.unpersist()
        raise TooManyRecords(f"the result has more than {limit} rows; write it with write_records() instead")

    def plain(value: object) -> object:
        if isinstance(value, Row):
            return {k: plain(v) for k, v in value.asDict().items()}
        return [plain(v) for v in value] if isinstance(value, list) else value

    def each() -> Iterator[dict]:
        try:
            for row in few.toLocalIterator():
                yield plain(row)
        finally:
            few.unpersist()

    return each()


def with_load_columns(df: DataFrame, source: str) -> DataFrame:
    return df.withColumns({"source_file": F.lit(source), "imported_at": F.current_timestamp()})
