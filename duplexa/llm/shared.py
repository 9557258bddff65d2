"""Helpers that several operators use: settled tables, Arrow batches, columns."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that a kernel handles at once; a longer single text is handled alone.
GROUP_BYTES = 4 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir. Only where all run in one process (a local master, as in tests) a folder of this machine does instead."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return given or _own_dir()


@functools.cache
def _own_dir() -> str:
    return f"file://{tempfile.mkdtemp(prefix='duplexa-')}"


#: Paths settled in each scratch() that is open, the innermost last.
_scopes: list[list[str]] = []


def _path(spark: SparkSession, name: str) -> tuple[JavaObject, JavaObject]:
    where = spark._jvm.org.apache.hadoop.fs.Path(name)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def settle(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it again: cuts lineage, survives lost executors and gives later joins true sizes.

    The files go when forget is called, when the scratch() around ends, or else with the application.
    """
    spark = df.sparkSession
    name = f"{shared_dir(spark)}/duplexa-{uuid.uuid4().hex}"
    df.write.parquet(name)
    files, where = _path(spark, name)
    files.deleteOnExit(where)
    if _scopes:
        _scopes[-1].append(name)
    out = spark.read.schema(df.schema).parquet(name)
    out.settled_at = name
    return out


def forget(*tables: DataFrame) -> None:
    """Delete settled tables that nothing reads any more."""
    for df in tables:
        files, where = _path(df.sparkSession, df.settled_at)
        files.delete(where, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """All that is settled inside goes at the end, but for what the given function settles."""
    _scopes.append([])

    def keep(df: DataFrame) -> DataFrame:
        out = settle(df)
        _scopes[-1].remove(out.settled_at)
        return out

    try:
        yield keep
    finally:
        for name in _scopes.pop():
            files, where = _path(spark, name)
            files.delete(where, True)


def slices(batch: pa.RecordBatch, column: str, size: int = GROUP_BYTES) -> Iterator[pa.RecordBatch]:
    """Rows of a batch in runs of at most about size bytes of that text column."""
    import numpy as np

    from .kernels import text_bytes

    offsets, _ = text_bytes(batch.column(column))
    at, n = 0, batch.num_rows
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1
        to = min(max(to, at + 1), n)
        yield batch.slice(at, to - at)
        at = to
