"""Chains of edits: runs, random counterparts, comparisons across seeds, gains and verdicts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ranklane.functions import lists
from ranklane.operators import profiles
from ranklane.operators.ranking import average_rank
from ranklane.sources.shared import kept


def run_chain(start: DataFrame, steps: Sequence[tuple[str, Sequence[int]]], rerank: Callable[[DataFrame, DataFrame], DataFrame] | None = None, pin: bool = False, on_event: Callable[[str, int, DataFrame], DataFrame] | None = None) -> DataFrame:
    """(kind, step, cell, ids) of every event of a chain: the start, each edit, and the reordering after it.

    start: (cell, ids). rerank gets the lists before and after the edit and returns (cell, ids); with pin the keys
    overexpressed so far stay in front. on_event may return a written copy of an event, which cuts the plan.
    """
    events, now = [start.select(F.lit("start").alias("kind"), F.lit(0).alias("step"), "cell", "ids")], start.select("cell", "ids")
    for number, (name, tokens) in enumerate(steps, 1):
        before = now
        now = now.select("cell", lists.apply_steps(F.col("ids"), [(name, tokens)]).alias("ids"))
        now = on_event("edit", number, now) if on_event else now
        events.append(now.select(F.lit("edit").alias("kind"), F.lit(number).alias("step"), "cell", "ids"))
        if rerank:
            after = rerank(before, now).select("cell", F.col("ids").alias("_new"))
            held = lists.keys(lists.final_overexpressed(steps[:number]))
            new = lists.pin_front(F.col("ids"), F.col("_new"), held) if pin else F.col("_new")
            now = now.join(after, "cell").select("cell", lists.keep_tail(F.col("ids"), new).alias("ids"))
            now = on_event("feedback", number, now) if on_event else now
            events.append(now.select(F.lit("feedback").alias("kind"), F.lit(number).alias("step"), "cell", "ids"))
    out = events[0]
    for e in events[1:]:
        out = out.unionByName(e)
    return out


def endpoints(events: DataFrame) -> DataFrame:
    """(chain, cell, value) of each cell's last step."""
    return events.groupBy("chain", "cell").agg(F.max_by("value", "step").alias("value"))


def endpoint_gain(final: DataFrame, reference: DataFrame) -> DataFrame:
    """(chain, cell, gain): endpoints minus those of the same chain without feedback."""
    r = endpoints(reference).withColumnRenamed("value", "ref")
    return endpoints(final).join(r, ["chain", "cell"]).select("chain", "cell", (F.col("value") - F.col("ref")).alias("gain"))


def conditional_gain(gains: DataFrame, configured: str, treated: DataFrame, available: DataFrame, least: int = 3) -> DataFrame:
    """specific_gain over treated cells and, in each, the random chains available there; cells with fewer than `least` go.

    gains: (chain, cell, gain); treated: (cell); available: (chain, cell).
    """
    g = gains.join(treated.select("cell").distinct(), "cell")
    random = g.where(F.col("chain") != configured).join(available.select("chain", "cell").distinct(), ["chain", "cell"])
    per = random.groupBy("cell").agg(F.count("*").alias("n"), F.avg("gain").alias("r"), F.max("gain").alias("m")).where(F.col("n") >= least)
    own = g.where(F.col("chain") == configured).select("cell", F.col("gain").alias("c")).join(per, "cell")
    return own.agg(F.count("*").alias("n_cells"), F.avg("n").alias("chains_per_cell"), F.avg("c").alias("configured_gain"), F.avg("r").alias("random_gain"), F.avg(F.col("c") - F.col("r")).alias("specific_gain"), F.avg((F.col("c") > F.col("m")).cast("int")).alias("frac_above_all"))


def draw_random_chains(strata: DataFrame, n_chains: int, seed: int) -> DataFrame:
    """(chain, target, token): for each configured token n tokens of its stratum, without replacement where there are enough.

    Drawn in the order of a hash of seed, target and token, so the same seed gives the same tokens whatever the order
    of steps. strata: (target, token).
    """
    rn = F.row_number().over(Window.partitionBy("target").orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("target").cast("string"), F.col("token").cast("string")))))
    n = F.count("*").over(Window.partitionBy("target"))
    ranked = strata.select("target", "token", (rn - 1).alias("at"), n.alias("n")).where(F.col("at") < n_chains)
    chains = F.explode(F.sequence(F.lit(0), F.lit(n_chains - 1)))
    return ranked.select("target", "token", "at", "n", chains.alias("chain")).where(F.col("chain") % F.least("n", F.lit(n_chains)) == F.col("at")).select("chain", "target", "token")


def balance(picks: DataFrame, strata: DataFrame, covariates: DataFrame) -> DataFrame:
    """(target, picks_mean, stratum_mean, smd) of a covariate (token, v) over picks and strata."""
    p = picks.join(covariates, "token").select("target", F.col("v").alias("p"), F.lit(None).cast("double").alias("s"))
    s = strata.join(covariates, "token").select("target", F.lit(None).cast("double").alias("p"), F.col("v").alias("s"))
    sd = F.sqrt((F.var_samp("p") + F.var_samp("s")) / 2)
    return p.unionByName(s).groupBy("target").agg(F.avg("p").alias("picks_mean"), F.avg("s").alias("stratum_mean"), F.when(sd > 0, (F.avg("p") - F.avg("s")) / sd).when(sd == 0, 0.0).alias("smd"))


def seed_agreement(finals: DataFrame, parts: int | None = None) -> DataFrame:
    """(seed_a, seed_b, cell, n_shared, spearman) of the final lists of each pair of seeds. finals: (seed, cell, pos, token).

    parts: into how many parts the cells' keys, and then the cells, are dealt.
    """
    a, b = finals.select(F.col("seed").alias("seed_a"), "cell", "token", F.col("pos").alias("pa")), finals.select(F.col("seed").alias("seed_b"), "cell", "token", F.col("pos").alias("pb"))
    if parts:
        a, b = (x.repartition(parts, "cell", "token") for x in (a, b))
    both = a.join(b, ["cell", "token"]).where("seed_a < seed_b")
    both = both.repartition(parts, "cell") if parts else both
    ranked = both.select("seed_a", "seed_b", "cell", average_rank("pa", "seed_a", "seed_b", "cell").alias("ra"), average_rank("pb", "seed_a", "seed_b", "cell").alias("rb"))
    return ranked.groupBy("seed_a", "seed_b", "cell").agg(F.count("*").alias("n_shared"), profiles.correlation("ra", "rb").alias("spearman"))


def shuffled_within(rows: DataFrame, cell: str, pos: str, value: str, seed: int, parts: int | None = None) -> DataFrame:
    """rows with the value of another row of the same cell: each cell's values in the order of a hash. parts: into how many parts the places are dealt."""
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(cell).cast("string"), F.col(pos).cast("string")))
    numbered = rows.withColumn("_rn", F.row_number().over(Window.partitionBy(cell).orderBy(pos)))
    dealt = rows.select(F.col(cell), F.col(value).alias("shuffled"), F.row_number().over(Window.partitionBy(cell).orderBy(order)).alias("_rn"))
    if parts:
        numbered, dealt = (x.repartition(parts, cell, "_rn") for x in (numbered, dealt))
    return numbered.join(dealt, [cell, "_rn"]).drop("_rn")


def predicted(method: str, alpha: float, bound: float) -> Column:
    """A method's predicted displacement from columns base, delta_norm, delta_logit (z-scored within the cell) and, for linear, decoded."""
    per = Window.partitionBy("cell")

    def z(c: str) -> Column:
        sd = F.stddev_pop(c).over(per)
        return F.when(sd > 0, (F.col(c) - F.avg(c).over(per)) / sd).otherwise(0.0)

    return {
        "identity": lambda: F.lit(0.0), "base_rank": lambda: -F.col("base"), "norm": lambda: lists.clamp(-alpha * z("delta_norm"), bound), "delta_mlm": lambda: lists.clamp(-alpha * z("delta_logit"), bound),
        "linear": lambda: lists.clamp(F.col("decoded"), bound),
    }[method]()


def decode(delta_h: Column, weights: Sequence[float], bound: float) -> Column:
    """bound * tanh(w . delta_h)."""
    w = F.array(*[F.lit(float(x)) for x in weights])
    return bound * F.tanh(F.aggregate(F.zip_with(delta_h, w, lambda x, y: x * y), F.lit(0.0), lambda a, v: a + v))


def fit_decoder(samples: DataFrame, dims: int, bound: float, epochs: int = 20, rate: float = 1.0, smooth: float = 1e-3) -> np.ndarray:
    """Weights of decode() by gradient descent on the squared error of the target; from zero, so untrained it changes nothing.

    samples: (delta_h, target). Each epoch is one aggregate of `dims` sums; nothing else comes to the driver.
    """
    w, samples = np.zeros(dims), kept(samples.select("delta_h", "target"))
    for _ in range(epochs):
        p = decode(F.col("delta_h"), w, bound)
        slope = (p - F.col("target")) * (bound - p * p / bound)
        sums = samples.select(slope.alias("s"), "delta_h").select(*[(F.col("s") * F.col("delta_h")[i]).alias(f"g{i}") for i in range(dims)]).agg(F.count("*"), *[F.sum(f"g{i}") for i in range(dims)]).first()
        if not sums[0]:
            break
        w -= rate * (np.array(sums[1:], float) / sums[0] + smooth * w)
    return w
