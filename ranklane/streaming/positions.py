"""Position sums of lists that arrive over time: the same mergeable aggregate, kept up to date by a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ranklane.operators import profiles


def lists_to_rows(lists: DataFrame) -> DataFrame:
    """(cell, state, pos, token, len) from a stream of (cell, state, ids)."""
    return lists.select("cell", "state", F.size("ids").cast("bigint").alias("len"), F.posexplode("ids").alias("pos", "token")).select("cell", "state", "pos", "token", "len")


def keep_sums(lists: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Runs over what has arrived and writes each batch's state of the sums that changed: (state, token, sum_norm_pos, n_cells, batch).

    State is one row for each state and token. A batch that is run again after a failure overwrites its own folder.
    """
    sums = profiles.position_sums(lists_to_rows(lists), "state")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return sums.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def latest(spark, path: str) -> DataFrame:
    """(state, token, sum_norm_pos, n_cells): the newest row of each key."""
    rows = spark.read.parquet(path)
    newest = rows.groupBy("state", "token").agg(F.max_by(F.struct("sum_norm_pos", "n_cells"), "batch").alias("x"))
    return newest.select("state", "token", "x.*")
