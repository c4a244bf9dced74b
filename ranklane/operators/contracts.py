"""Checks of manifests, runs and merges, and picks among results."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Species a manifest may name.
SPECIES = ("mouse", "human", "drosophila")


def manifest_faults(manifest: DataFrame) -> DataFrame:
    """(sample_id, fault) of each broken rule: empty id or state, unknown species, repeated id, more than one species."""
    n = F.count("*").over(Window.partitionBy("sample_id"))
    kinds = manifest.agg(F.count_distinct(F.lower("species")).alias("_kinds"))
    m = manifest.withColumn("_n", n).crossJoin(F.broadcast(kinds))
    empty = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    faults = F.array_compact(F.array(
        F.when(empty("sample_id"), "empty sample_id"), F.when(empty("state"), "empty state"), F.when(~F.coalesce(F.lower("species").isin(*SPECIES), F.lit(False)), "unknown species"),
        F.when(F.col("_n") > 1, "duplicate sample_id"), F.when(F.col("_kinds") > 1, "several species"),
    ))
    return m.select("sample_id", F.explode(faults).alias("fault"))


def coverage(manifest: DataFrame, folders: DataFrame) -> DataFrame:
    """(sample_id, missing_in): names that only one of both sides has."""
    a, b = manifest.select("sample_id", F.lit(1).alias("m")).distinct(), folders.select("sample_id", F.lit(1).alias("f")).distinct()
    return a.join(b, "sample_id", "full").where("m IS NULL OR f IS NULL").select("sample_id", F.when(F.col("m").isNull(), "manifest").otherwise("folders").alias("missing_in"))


def missing_states(wanted: DataFrame, cells: DataFrame) -> DataFrame:
    """Wanted states that no cell has."""
    return wanted.join(cells.select("state").distinct(), "state", "left_anti")


def shard_gaps(shards: DataFrame) -> DataFrame:
    """(prefix, n, highest, complete): whether the shards of a prefix are numbered 0 to n - 1."""
    return shards.groupBy("prefix").agg(F.count_distinct("shard").alias("n"), F.max("shard").alias("highest")).withColumn("complete", F.col("highest") + 1 == F.col("n"))


def merge_faults(markers: DataFrame, files: DataFrame) -> DataFrame:
    """(fault) of a parallel run: chunks missing, hashes that differ, counts that do not add up, files that do not match.

    markers: (chunk_id, chunk_count, config_sha256, centroid_sha256, n_cells, n_before, files); files: (name).
    """
    m = markers.agg(
        F.count_distinct("chunk_id").alias("n"), F.max("chunk_count").alias("count"), F.count_distinct("config_sha256").alias("configs"), F.count_distinct("centroid_sha256").alias("centroids"),
        F.sum("n_cells").alias("cells"), F.max("n_before").alias("before"), F.min("n_before").alias("before_low"),
    )
    listed = markers.select(F.explode("files").alias("name"))
    by_name = listed.groupBy("name").agg(F.count("*").alias("k")).join(files.select("name", F.lit(1).alias("there")), "name", "full")
    f = by_name.agg(F.count_if(F.col("k") > 1).alias("twice"), F.count_if(F.col("k").isNull()).alias("extra"), F.count_if(F.col("there").isNull()).alias("absent"))
    told = F.array_compact(F.array(
        F.when(F.col("n") != F.col("count"), "chunks missing"), F.when(F.col("configs") != 1, "configs differ"), F.when(F.col("centroids") != 1, "centroids differ"),
        F.when((F.col("cells") != F.col("before")) | (F.col("before") != F.col("before_low")), "cell counts differ"), F.when(F.col("twice") > 0, "file listed twice"),
        F.when(F.col("extra") > 0, "file not listed"), F.when(F.col("absent") > 0, "file missing"),
    ))
    return m.crossJoin(F.broadcast(f)).select(F.explode(told).alias("fault"))


def top_significant(stats: DataFrame, least: int = 20) -> DataFrame:
    """The significant row of largest shift among those with enough detections; ties by gene. One row or none."""
    return stats.where((F.col("sig") == 1) & (F.col("n") >= least)).orderBy(F.desc("mean_shift"), "gene").limit(1)


def best_run(runs: DataFrame) -> DataFrame:
    """(run, accuracy) of the highest accuracy, ties to the lowest run."""
    return runs.agg(F.max(F.struct("accuracy", (-F.col("run")).alias("r"))).alias("b")).select((-F.col("b.r")).alias("run"), "b.accuracy")


def classifier_metrics(rows: DataFrame, truth: str, pred: str) -> DataFrame:
    """(accuracy, precision, recall, f1): macro means over the classes of either column, 0 where undefined."""
    both = rows.select(F.explode(F.array(F.struct(F.col(truth).alias("c"), (F.col(truth) == F.col(pred)).alias("hit"), F.lit("t").alias("side")), F.struct(F.col(pred).alias("c"), (F.col(truth) == F.col(pred)).alias("hit"), F.lit("p").alias("side")))).alias("x")).select("x.*")
    t, p = F.count_if(F.col("side") == "t"), F.count_if(F.col("side") == "p")
    k = both.groupBy("c").agg(F.count_if(F.col("hit") & (F.col("side") == "t")).alias("tp"), t.alias("t"), p.alias("p"))
    k = k.select("tp", "t", F.coalesce(F.col("tp") / F.nullif(F.col("p"), F.lit(0)), F.lit(0.0)).alias("prec"), F.coalesce(F.col("tp") / F.nullif(F.col("t"), F.lit(0)), F.lit(0.0)).alias("rec"))
    f1 = F.coalesce(2 * F.col("prec") * F.col("rec") / F.nullif(F.col("prec") + F.col("rec"), F.lit(0.0)), F.lit(0.0))
    return k.agg((F.sum("tp") / F.sum("t")).alias("accuracy"), F.avg("prec").alias("precision"), F.avg("rec").alias("recall"), F.avg(f1).alias("f1"))


def rare_classes_dropped(rows: DataFrame, label: str, threshold: float) -> DataFrame:
    """rows of classes with more than threshold times all rows."""
    n = rows.agg(F.count("*").alias("_all"))
    kept = rows.groupBy(label).agg(F.count("*").alias("_n")).crossJoin(F.broadcast(n)).where(F.col("_n") > threshold * F.col("_all")).select(label)
    return rows.join(kept, label, "left_semi")


def stability(events: DataFrame, drop: float = 0.02, growth: float = 1.5, idle: float = 0.99) -> DataFrame:
    """(seed, s1, s2): whether each seed's feedback events stay near the first and its idle ones settle.

    events: (seed, kind, event_index, rho, disp).
    """
    fb, rest = F.col("kind") == "feedback", F.col("kind") == "idle"
    first = lambda c, k: F.min_by(F.when(k, F.col(c)), F.when(k, F.col("event_index")))
    last = lambda c, k: F.max_by(F.when(k, F.col(c)), F.when(k, F.col("event_index")))
    s1 = (F.min(F.when(fb, F.col("rho"))) >= first("rho", fb) - drop) & (F.max(F.when(fb, F.col("disp"))) <= growth * F.greatest(first("disp", fb), F.lit(1.0)))
    s2 = (last("rho", rest) >= idle) & (last("disp", rest) <= first("disp", rest))
    return events.groupBy("seed").agg(F.coalesce(s1, F.lit(False)).alias("s1"), F.coalesce(s2, F.lit(False)).alias("s2"))


def length_summary(cells: DataFrame, column: str, cap: int) -> DataFrame:
    """n, median, mean, sample deviation, minimum, maximum and how many reach the cap."""
    x = F.col(column)
    return cells.agg(F.count(x).alias("n"), F.percentile(x, F.lit(0.5)).alias("median"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.min(x).alias("shortest"), F.max(x).alias("longest"), F.count_if(x >= cap).alias("n_capped"))


def config_sha256(config: Mapping) -> str:
    """SHA-256 of a setting's canonical JSON; chunk ids do not enter."""
    return hashlib.sha256(json.dumps({k: v for k, v in config.items() if k != "chunk_id"}, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()
