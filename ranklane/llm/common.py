"""What several corpus operators share: columns, scratch tables and connected components."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


#: Rows of an Arrow batch whose texts are Python objects at once.
ROWS = 256


def slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches' rows, ROWS at a time: a worker's memory follows these, not Spark's batches."""
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            yield batch.slice(start, ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named Parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@cache
def _own_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="ranklane-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset and all is one process (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (named or _own_dir()).rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Tables written to the shared folder, so that a lost executor costs no more than the running step.

    keep() writes a table and reads it back, which cuts its lineage, and gives its place as well;
    drop() deletes a place that nothing needs any more. What is left goes when the driver ends.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/ranklane-{uuid.uuid4().hex}"
        self.made = 0
        atexit.register(self._end)

    def write(self, df: DataFrame) -> tuple[DataFrame, str]:
        self.made += 1
        path = f"{self.root}/{self.made}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def keep(self, df: DataFrame) -> DataFrame:
        return self.write(df)[0]

    def drop(self, path: str) -> None:
        _delete(self.spark, path)

    def _end(self) -> None:
        try:
            _delete(self.spark, self.root)
        except Exception:  # noqa: BLE001  the session has ended before us
            return


def word_count(text: Column) -> Column:
    """The number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def crc_mod(key: Column, divisor: int) -> Column:
    """crc32 of the key as text, modulo divisor; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % divisor


def components(edges: DataFrame, scratch: Scratch, most_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable over undirected edges (a, b).

    Each round gives a node the smallest label among its neighbours, gives the same to the label's own
    node (so that chains fold together) and lets labels jump to their labels' labels; it is then written
    to the shared folder. Minima are partially aggregated, so a node with very many links costs no task
    more than its share. Only nodes with a link occur. No edge is collected to the driver.
    """
    pairs = edges.where("a <> b").select("a", "b")
    both, both_path = scratch.write(pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label, path = scratch.write(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")))
    for _ in range(most_rounds):
        near = both.join(label.withColumnsRenamed({"node": "b", "label": "seen"}), "b").groupBy(F.col("a").alias("node")).agg(F.min("seen").alias("seen"))
        step = label.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "seen").alias("label"))
        hook = step.groupBy(F.col("old").alias("node")).agg(F.min("label").alias("hook"))
        step = step.join(hook, "node", "left").select("node", "old", F.least("label", "hook").alias("label"))
        jump = step.select(F.col("node").alias("label"), F.col("label").alias("jump"))
        fresh, fresh_path = scratch.write(step.join(jump, "label", "left").select("node", "old", F.least("label", "jump").alias("label")))
        scratch.drop(path)
        label, path = fresh.select("node", "label"), fresh_path
        if fresh.where("label <> old").isEmpty():
            scratch.drop(both_path)
            return label.withColumnRenamed("label", "component")
    raise RuntimeError(f"components: no end after {most_rounds} rounds")
