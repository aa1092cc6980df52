"""Shared plumbing: the shared folder, written tables that cut lineage, text patterns."""

from __future__ import annotations

import ctypes
import re
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the text contracts, and a run of anything else.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of a batch that a Python worker gets.
BATCH = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """A new folder that driver and executors share, gone when the session ends.

    ``spark.checkpoint.dir`` names the parent; only a session on one machine, as
    in tests, may leave it unset.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir isn't set")
        base = "/tmp/checkpoints"
    path = f"{base.rstrip('/')}/citeloom-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return str(fs.makeQualified(p).toString())


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage is cut, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = shared_dir(spark) + "/t"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def part_files(df: DataFrame) -> list[str]:
    """The files of a written table."""
    return sorted(df.inputFiles())


def safe(df: DataFrame, *cols: str) -> DataFrame:
    """Only the named columns, so that clashing extra columns can't interfere."""
    return df.select(*[F.col(f"`{c}`") for c in cols])


#: What a worker keeps from task to task, by kind; tasks of another kind drop it.
_KEPT: dict[tuple, object] = {}


def kept(kind: str, key: str, make: Callable[[str], object]) -> object:
    """make(key), made once in a worker."""
    if (kind, key) not in _KEPT:
        _KEPT.clear()
        _KEPT[kind, key] = make(key)
    return _KEPT[kind, key]


def lean(run: Callable[[Iterator], Iterator], keeps: str = "") -> Callable[[Iterator], Iterator]:
    """A function for mapInArrow that gives memory back when its task ends, since workers live on; it keeps one kind of objects."""

    def then_trim(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for k in [k for k in _KEPT if k[0] != keeps]:
            del _KEPT[k]
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another C library
                pass

    return then_trim


def mapped(df: DataFrame, run: Callable[[Iterator], Iterator], schema: str, keeps: str = "") -> DataFrame:
    """df.mapInArrow, lean and in batches of some BATCH bytes, unless the session already asks for less.

    A batch exists several times over, in the JVM and in Python; Spark's default
    of 64 MB for each would take much of a small executor.
    """
    spark, name = df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.fullmatch(r"(\d+)b?", spark.conf.get(name))
    if now and not 0 < int(now[1]) <= BATCH:
        spark.conf.set(name, str(BATCH))
    return df.mapInArrow(lean(run, keeps), schema)
