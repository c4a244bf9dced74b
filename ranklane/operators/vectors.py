"""Vectors of cells and states: centroids, shifts, pooling, projection and clusters.

Vectors are arrays of doubles; sums over cells go by position (posexplode), so they combine map-side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ranklane.sources.shared import kept


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector has no length."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def distance(a: Column, b: Column) -> Column:
    d = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return norm(d)


def mean_vectors(rows: DataFrame, by: str, vector: str) -> DataFrame:
    """(by, vec): the mean vector of each group."""
    means = rows.select(by, F.posexplode(vector).alias("i", "x")).groupBy(by, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("vec"))


def pool(tokens: DataFrame, vector: str, limit: str) -> DataFrame:
    """(cell, vec): the mean of each cell's token vectors at positions below its length."""
    return mean_vectors(tokens.where(F.col("pos") < F.col(limit)), "cell", vector)


def signature(centroids: DataFrame, digits: int = 3) -> DataFrame:
    """(state, signature): SHA-256 of the rounded coordinates, which small noise leaves as it is."""
    told = F.concat_ws(",", F.transform("vec", lambda x: F.format_string("%.3f", F.round(x, digits) + F.lit(0.0))))
    return centroids.select("state", F.sha2(F.concat_ws("|", F.col("state").cast("string"), told), 256).alias("signature"))


def cosine_shift(before: Column, after: Column, end: Column) -> Column:
    """Cosine to the end state after minus before."""
    return cosine(after, end) - cosine(before, end)


def shift_table(rows: DataFrame, start: str, pert: str, end: DataFrame) -> DataFrame:
    """rows with shift_l2, shift_toward (distance to the end before minus after) and cos_shift_toward.

    end: one row (vec).
    """
    j = rows.crossJoin(F.broadcast(end.select(F.col("vec").alias("_end"))))
    s, p, e = F.col(start), F.col(pert), F.col("_end")
    return j.withColumns({"shift_l2": distance(s, p), "shift_toward": distance(s, e) - distance(p, e), "cos_shift_toward": cosine_shift(s, p, e)}).drop("_end")


def group_summary(shifts: DataFrame, by: str, metric: str, least: int = 2) -> DataFrame:
    """(by, n, mean, median, sem) of a metric for groups of at least `least` cells."""
    v = F.col(metric)
    out = shifts.groupBy(by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.percentile(v, F.lit(0.5)).alias("median"), F.coalesce(F.stddev_samp(v) / F.sqrt(F.count(v)), F.lit(0.0)).alias("sem"))
    return out.where(F.col("n") >= least)


def project(rows: DataFrame, vector: str, k: int = 2) -> DataFrame:
    """rows with pca, the first k principal components."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = rows.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    out = PCA(k=k, inputCol="_v", outputCol="_p").fit(v).transform(v)
    return out.withColumn("pca", vector_to_array("_p")).drop("_v", "_p")


def cluster(rows: DataFrame, vector: str, k_min: int = 2, k_max: int = 6, seed: int = 42) -> DataFrame:
    """rows with cluster, k-means with the number of clusters of best silhouette."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    v = kept(rows).withColumn("features", array_to_vector(F.col(vector).cast("array<double>")))
    best = None
    for k in range(k_min, k_max + 1):
        fitted = KMeans(k=k, seed=seed, maxIter=20).fit(v).transform(v)
        score = ClusteringEvaluator().evaluate(fitted)
        if best is None or score > best[0]:
            best = (score, fitted)
    return best[1].withColumnRenamed("prediction", "cluster").drop("features")


def hashed_provider(encoded: DataFrame, dims: int = 16, decay: float = 0.02) -> DataFrame:
    """(cell, vec): a stand-in for a model: each token's vector from its hash, weighted down with its position.

    Deterministic, so edits and scores can be tested without a model; any function of the same shape takes its place.
    """
    x = encoded.select("cell", F.exp(-decay * F.col("pos")).alias("w"), F.posexplode(F.array(*[(F.pmod(F.xxhash64(F.lit(i), F.col("token")), F.lit(2001)) - 1000) / 1000.0 for i in range(dims)])).alias("i", "x"))
    sums = x.groupBy("cell", "i").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("x"))
    return sums.groupBy("cell").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("vec"))
