"""Queries of centroids, shifts, pooling, projection and clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ranklane.operators import vectors
from ranklane.plans import inputs
from ranklane.plans.catalogue import query

_X = "x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings)"
_CENT = f"{_X}, cent AS (SELECT label, i, avg(v) AS v FROM x GROUP BY 1, 2)"


def _centroids(spark, sf_dir):
    return vectors.mean_vectors(inputs.table(spark, sf_dir, "embeddings"), "label", "embedding")


@query(f"WITH {_CENT} SELECT label, i - 1 AS i, round(v, 6) AS x FROM cent")
def state_centroids(spark, sf_dir):
    c = _centroids(spark, sf_dir).select("label", F.posexplode("vec").alias("i", "x"))
    return c.select("label", F.col("i").cast("bigint").alias("i"), F.round("x", 6).alias("x"))


# a vector's perturbed form is its coordinates in reverse; the end state is label 0

_SHIFT = f"""{_CENT}, e AS (SELECT i, v FROM cent WHERE label = 0), p AS (SELECT a.vec_id, a.label, a.i, a.v AS s, b.v AS q, e.v AS e FROM x a JOIN x b ON a.vec_id = b.vec_id AND b.i = 65 - a.i JOIN e ON e.i = a.i),
g AS (SELECT vec_id, any_value(label) AS label, sqrt(sum((s - q) * (s - q))) AS l2, sqrt(sum((s - e) * (s - e))) - sqrt(sum((q - e) * (q - e))) AS toward, sum(q * e) / sqrt(sum(q * q) * sum(e * e)) - sum(s * e) / sqrt(sum(s * s) * sum(e * e)) AS cs FROM p GROUP BY vec_id)"""


def _shifts(spark, sf_dir):
    end = _centroids(spark, sf_dir).where("label = 0").select("vec")
    rows = inputs.table(spark, sf_dir, "embeddings").withColumn("pert", F.reverse("embedding"))
    return vectors.shift_table(rows, "embedding", "pert", end)


@query(f"WITH {_SHIFT} SELECT vec_id, round(l2, 5) AS shift_l2, round(toward, 5) AS shift_toward FROM g")
def l2_shift_toward(spark, sf_dir):
    return _shifts(spark, sf_dir).select("vec_id", F.round("shift_l2", 5).alias("shift_l2"), F.round("shift_toward", 5).alias("shift_toward"))


@query(f"WITH {_SHIFT} SELECT vec_id, round(cs, 5) AS cos_shift FROM g")
def cosine_shift(spark, sf_dir):
    return _shifts(spark, sf_dir).select("vec_id", F.round("cos_shift_toward", 5).alias("cos_shift"))


@query(f"WITH {_SHIFT} SELECT label, count(*) AS n, round(avg(l2), 5) AS mean, round(quantile_cont(l2, 0.5), 5) AS median, round(coalesce(stddev_samp(l2) / sqrt(count(*)), 0.0), 5) AS sem FROM g GROUP BY label HAVING count(*) >= 2")
def group_shift_summary(spark, sf_dir):
    out = vectors.group_summary(_shifts(spark, sf_dir), "label", "shift_l2")
    return out.select("label", "n", *[F.round(c, 5).alias(c) for c in ("mean", "median", "sem")])


@query(f"WITH {_X} SELECT label AS cell, i - 1 AS i, round(avg(v), 6) AS x FROM x WHERE vec_id % 10 < 4 GROUP BY 1, 2")
def masked_mean_pool(spark, sf_dir):
    """Vectors as token states of a cell (their label), of which the first four of every ten are not padding."""
    t = inputs.table(spark, sf_dir, "embeddings").select(F.col("label").alias("cell"), (F.col("vec_id") % 10).alias("pos"), F.lit(4).alias("n"), "embedding")
    return vectors.pool(t, "embedding", "n").select("cell", F.posexplode("vec").alias("i", "x")).select("cell", F.col("i").cast("bigint").alias("i"), F.round("x", 6).alias("x"))


@query()
def centroid_signature(spark, sf_dir):
    """Hashes of rounded centroids; sums of doubles differ in their last bits between engines, so without SQL."""
    return vectors.signature(_centroids(spark, sf_dir).withColumnRenamed("label", "state"))


@query()
def pca_2d(spark, sf_dir):
    return vectors.project(inputs.table(spark, sf_dir, "embeddings"), "embedding").select("vec_id", "label", "pca")


@query()
def kmeans_auto_k(spark, sf_dir):
    return vectors.cluster(inputs.table(spark, sf_dir, "embeddings"), "embedding", 2, 4).select("vec_id", "cluster")


@query()
def provider_shifts(spark, sf_dir):
    """The whole scoring path with the stand-in provider: lists, an edit, vectors, shifts toward the goal state."""
    from ranklane.functions import lists
    from ranklane.operators import encode

    cells = inputs.cells(spark, sf_dir)
    before = encode.to_lists(inputs.encoded(spark, sf_dir))
    after = before.select("cell", lists.overexpress(F.col("ids"), lists.keys((15, 9, 604))).alias("ids"))
    v0, v1 = (vectors.hashed_provider(encode.from_lists(x)) for x in (before, after))
    goal = vectors.mean_vectors(v0.join(cells.where(F.col("state") == inputs.GOAL), "cell").withColumn("one", F.lit(1)), "one", "vec").select("vec")
    rows = v0.join(cells.where(F.col("state") == inputs.START), "cell").join(v1.withColumnRenamed("vec", "pert"), "cell")
    return vectors.shift_table(rows, "vec", "pert", goal).select("cell", "shift_l2", "shift_toward", "cos_shift_toward")
