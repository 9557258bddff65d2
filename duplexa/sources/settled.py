"""Tables that are settled: written to the folder that driver and executors share, and read again. That cuts lineage, survives lost executors and gives later joins true sizes."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _own_dir() -> str:
    return f"file://{tempfile.mkdtemp(prefix='duplexa-')}"


def shared_dir(spark: SparkSession) -> str:
    """From spark.checkpoint.dir; a folder of this machine only where all runs in one process."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return given or _own_dir()


def settled(df: DataFrame) -> DataFrame:
    """df, written and read again; the files go with the application."""
    spark = df.sparkSession
    name = f"{shared_dir(spark)}/duplexa-{uuid.uuid4().hex}"
    df.write.parquet(name)
    where = spark._jvm.org.apache.hadoop.fs.Path(name)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(name)
