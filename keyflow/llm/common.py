"""Small helpers that all corpus operators share."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The whole table ``name`` below ``sf_dir``, read by Spark so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which driver and executors share.

    Only where the setting is absent in a local session a local folder is made and set; it goes when the driver ends. On a
    cluster the setting must be there, as executors don't see each other's folders.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="keyflow-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        base = "file://" + folder
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._materialized = path
    return out


def forget(*frames: DataFrame) -> None:
    """Delete what ``materialize`` wrote for frames from which nothing is read any more."""
    for frame in frames:
        path = getattr(frame, "_materialized", None)
        if path:
            spark = frame.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of text that a task deals with on average, where there are more than the session's shuffle partitions hold.
TASK_BYTES = 96 << 20


def tasks(frame: DataFrame, *columns: str) -> tuple[int, int]:
    """(tasks, bytes): the bytes of some columns, and into how many tasks to deal them: the session's number of shuffle
    partitions, or more where those would grow with the input."""
    size = sum(F.coalesce(F.sum(F.octet_length(c)), F.lit(0)) for c in columns)
    total = int(frame.agg(size.alias("n")).first()[0] or 0)
    return max(partitions(frame.sparkSession), total // TASK_BYTES), total


def _give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for mapInArrow, giving memory that is no longer used back to the system when a task ends: workers live on."""

    def task(batches: Iterator) -> Iterator:
        yield from run(batches)
        _give_back()

    return task


def released_group(run: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """The same for a function of one group (applyInArrow), after each group."""

    def task(group: pa.Table) -> pa.Table:
        out = run(group)
        _give_back()
        return out

    return task


def released_groups(run: Callable[[pa.Table, pa.Table], pa.Table]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The same for a function of two groups."""

    def task(left: pa.Table, right: pa.Table) -> pa.Table:
        out = run(left, right)
        _give_back()
        return out

    return task


def text_of(column: str = "text") -> Column:
    """The text, a null one as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))
