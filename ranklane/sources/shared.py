"""Intermediate tables in the folder that driver and executors share, so that a lost executor costs no more than the running step."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


@cache
def _own_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="ranklane-")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or one of our own where that is unset and all is one process (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (named or _own_dir()).rstrip("/")


@cache
def _root(spark: SparkSession) -> str:
    """One folder a session, which goes when the driver ends."""
    root = f"{shared_dir(spark)}/ranklane-{uuid.uuid4().hex}"

    def end() -> None:
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(root)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001  the session has ended before us
            return

    atexit.register(end)
    return root


def kept(df: DataFrame) -> DataFrame:
    """The table, written as Parquet and read back, which cuts its lineage and fixes what is not deterministic in it."""
    path = f"{_root(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
