"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from contextvars import ContextVar
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType

#: Bytes of a side that checked_broadcast() may broadcast; beyond it the join shuffles.
BROADCAST_BYTES = 64 << 20
#: Bytes of a batch that goes to a Python worker; texts are long, and the buffers of the largest batch stay.
BATCH_BYTES = 1 << 20


_own_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset.

    Our own is local to the machine, so only a local master may do without the setting; it is one an application.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        folder = _own_folders.get(app) or _own_folders.setdefault(app, f"file://{tempfile.mkdtemp(prefix='spark-')}")
    return folder


def _delete(spark: SparkSession, path: str, on_exit: bool = False) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if on_exit:
        files.deleteOnExit(place)
    else:
        files.delete(place, True)


def staged(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back, which cuts its lineage.

    The files outlive lost executors and go with discard(), or else when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stages/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _delete(spark, path, on_exit=True)
    out = spark.read.schema(df.schema).parquet(path)
    out.stage_path = path
    for made in _scratch.get():
        made.append(out)
    return out


#: The lists that staged() adds to; each thread has its own.
_scratch: ContextVar[tuple[list[DataFrame], ...]] = ContextVar("scratch", default=())


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """The list of tables that are staged inside, so that they can be discarded when the result is written."""
    made: list[DataFrame] = []
    before = _scratch.set((*_scratch.get(), made))
    try:
        yield made
    finally:
        _scratch.reset(before)


def discard(*tables: DataFrame) -> None:
    """Deletes the files of staged() tables that nothing reads any more."""
    for df in tables:
        _delete(df.sparkSession, df.stage_path)


def size_in_bytes(df: DataFrame) -> int:
    """About how much memory the rows of df take, counted by Spark: strings, bytes and elements of arrays by their number."""

    def width(column: Column, kind) -> Column:
        if isinstance(kind, StringType | BinaryType):
            return F.coalesce(F.octet_length(column), F.lit(0)) + 16
        if isinstance(kind, ArrayType):
            if isinstance(kind.elementType, StringType | BinaryType):
                return F.aggregate(F.coalesce(column, F.array().cast(kind)), F.lit(32), lambda n, x: n + F.coalesce(F.octet_length(x), F.lit(0)) + 16)
            each = 8 * (1 + len(kind.elementType.fields)) if hasattr(kind.elementType, "fields") else 8
            return F.coalesce(F.size(column), F.lit(0)) * each + 32
        if isinstance(kind, MapType):
            return F.coalesce(F.size(column), F.lit(0)) * 64 + 32
        return F.lit(8)

    fields = [width(F.col(f"`{f.name}`"), f.dataType).cast("long") for f in df.schema.fields]
    row = fields[0]
    for x in fields[1:]:
        row = row + x
    return df.agg(F.sum(row + 16)).first()[0] or 0


def checked_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its rows take at most `limit` bytes, else df as it is. Best given a staged table."""
    return F.broadcast(df) if size_in_bytes(df) <= limit else df


def bound_batches(df: DataFrame) -> DataFrame:
    """df; from now on its session hands at most about BATCH_BYTES at once to Python workers, unless another bound than the default is set."""
    name, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    if conf.get(name) == "67108864b":
        conf.set(name, str(BATCH_BYTES))
    return df


def give_back_memory() -> None:
    """Hands freed memory of this process back to the system; a Python worker lives on after its task and would keep it."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # other C libraries than glibc
        ctypes.CDLL(None).malloc_trim(0)


def collected(df: DataFrame) -> pa.Table:
    """The rows of df, a bounded number, as columns: some bytes of the driver's memory each instead of an object for each value."""
    table = df.toArrow()
    give_back_memory()
    return table


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, a function of batches, after whose last result the worker gives back the memory that it has freed."""

    @wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back_memory()

    return wrapped


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def literal_rows(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """A small table of fixed values, as a projection of literals."""
    structs = [F.struct(*(F.lit(v).alias(n) for v, n in zip(r, names, strict=True))) for r in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))
