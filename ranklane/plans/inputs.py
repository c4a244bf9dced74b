"""Domain inputs built from the star-schema tables, and the same as SQL.

Cells are suppliers (long lists) or customers (short ones), genes are parts, counts are sums of quantities,
a cell's state is its supplier's region.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ranklane.operators import encode, profiles

START, GOAL = "AFRICA", "ASIA"
#: Keys that a list keeps at most.
LONG, SHORT = 2048, 2048
#: Order lines of a task.
A_TASK = 250_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks(spark: SparkSession, sf_dir: str) -> int:
    """Into how many parts the order lines are dealt: as many as hold A_TASK each, so that a task's sorts do not grow with the table."""
    return max(spark.sparkContext.defaultParallelism, -(-table(spark, sf_dir, "lineitem").count() // A_TASK))


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell, gene, cnt) of suppliers, dealt by gene."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_quantity").repartition(tasks(spark, sf_dir), "l_partkey")
    return lines.groupBy(F.col("l_suppkey").alias("cell"), F.col("l_partkey").alias("gene")).agg(F.sum("l_quantity").alias("cnt"))


def counts_of(spark: SparkSession, sf_dir: str, which) -> DataFrame:
    """(cell, token, v): the quantities of the order lines that a condition holds for."""
    lines = table(spark, sf_dir, "lineitem").where(which)
    return lines.groupBy(F.col("l_suppkey").alias("cell"), F.col("l_partkey").alias("token")).agg(F.sum("l_quantity").alias("v"))


def customer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell, gene, cnt) of customers, dealt by gene."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    lines = lines.select("o_custkey", "l_partkey", "l_quantity").repartition(tasks(spark, sf_dir), "l_partkey")
    return lines.groupBy(F.col("o_custkey").alias("cell"), F.col("l_partkey").alias("gene")).agg(F.sum("l_quantity").alias("cnt"))


def tokens(counts_df: DataFrame) -> DataFrame:
    """(gene, token): numbers behind four reserved ones."""
    return counts_df.select("gene").distinct().select("gene", (F.col("gene") + 4).alias("token"))


def vocab(counts_df: DataFrame) -> DataFrame:
    return encode.vocabulary(tokens(counts_df), encode.medians(counts_df))


def encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell, pos, token, len) of suppliers."""
    c = counts(spark, sf_dir)
    return encode.rank(encode.normalise(c, vocab(c), parts=tasks(spark, sf_dir)), LONG)


def customer_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell, ids) of customers."""
    c = customer_counts(spark, sf_dir)
    return encode.to_lists(encode.rank(encode.normalise(c, vocab(c), parts=tasks(spark, sf_dir)), SHORT))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell, state) of suppliers."""
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return s.join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("s_suppkey").alias("cell"), F.col("r_name").alias("state"))


def in_state(spark: SparkSession, sf_dir: str, state: str) -> DataFrame:
    return encoded(spark, sf_dir).join(cells(spark, sf_dir).where(F.col("state") == state), "cell").drop("state")


def ranks(spark: SparkSession, sf_dir: str, state: str) -> DataFrame:
    """(token, rank, n_cells) of a state's suppliers."""
    return profiles.state_ranks(in_state(spark, sf_dir, state))


def ranks_of(spark: SparkSession, sf_dir: str, *states: str) -> list[DataFrame]:
    """ranks() of several states, from lists that are encoded and summed once."""
    e = encoded(spark, sf_dir).join(cells(spark, sf_dir).where(F.col("state").isin(*states)), "cell")
    every = profiles.state_ranks(e, "state")
    return [every.where(F.col("state") == s).drop("state") for s in states]


def shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(gene, cell, shift): a stand-in for cosine shifts, one for each order line."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.select(F.pmod(F.col("l_partkey"), F.lit(97)).alias("gene"), F.col("l_orderkey").alias("cell"), (F.col("l_quantity") - F.round(F.col("l_discount") * 100) + F.pmod(F.col("l_partkey"), F.lit(7))).alias("shift"))


def _encode(counts_cte: str, prefix: str, most: int) -> str:
    p = prefix
    return f"""{counts_cte},
{p}vocab AS (SELECT gene, gene + 4 AS token, quantile_cont(cnt, 0.5) AS med FROM {p}counts WHERE cnt > 0 GROUP BY gene),
{p}val AS (SELECT c.cell, v.token, c.cnt / sum(c.cnt) OVER (PARTITION BY c.cell) * 10000.0 / v.med AS w FROM {p}counts c JOIN {p}vocab v USING (gene)),
{p}enc AS (SELECT cell, rn - 1 AS pos, token, least(n, {most}) AS len FROM (SELECT cell, token, row_number() OVER (PARTITION BY cell ORDER BY w DESC, token) AS rn, count(*) OVER (PARTITION BY cell) AS n FROM {p}val WHERE w > 0) WHERE rn <= {most})"""


COUNTS = "counts AS (SELECT l_suppkey AS cell, l_partkey AS gene, sum(l_quantity) AS cnt FROM lineitem GROUP BY 1, 2)"
C_COUNTS = "c_counts AS (SELECT o_custkey AS cell, l_partkey AS gene, sum(l_quantity) AS cnt FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"
ENC = _encode(COUNTS, "", LONG)
C_LISTS = _encode(C_COUNTS, "c_", SHORT) + ", lists AS (SELECT cell, list(token ORDER BY pos) AS ids FROM c_enc GROUP BY cell)"
CELLS = "cells AS (SELECT s_suppkey AS cell, r_name AS state FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
STATES = f"""{ENC}, {CELLS},
es AS (SELECT enc.*, state FROM enc JOIN cells USING (cell)),
tot AS (SELECT state, count(DISTINCT cell) AS n FROM es GROUP BY state),
sums AS (SELECT state, token, sum(pos / greatest(len - 1, 1)) AS s, count(*) AS n_cells FROM es GROUP BY state, token),
pb AS (SELECT state, token, (s + n - n_cells) / n AS rank, n_cells FROM sums JOIN tot USING (state)),
r0 AS (SELECT * FROM pb WHERE state = '{START}'), r1 AS (SELECT * FROM pb WHERE state = '{GOAL}')"""
SHIFTS = "shifts AS (SELECT l_partkey % 97 AS gene, l_orderkey AS cell, l_quantity - round(l_discount * 100) + l_partkey % 7 AS shift FROM lineitem)"
