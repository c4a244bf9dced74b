"""Statistical kernels: rank sums, over-representation, contrasts, bootstrap and permutation tests.

The pool of all shifts is ranked once, over its distinct values; every key's rank sum follows from those
ranks and its own values, so no key sorts the pool again.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ranklane.functions.aggregates import correlation
from ranklane.operators.ranking import average_rank, average_ranks, bh_adjust, numbered, quantiles, with_ranks
from ranklane.sources.shared import kept


@F.pandas_udf(T.DoubleType())
def two_sided_p(z: pd.Series) -> pd.Series:
    """The normal distribution's two-sided p-value, one for each aggregated row."""
    return z.map(lambda x: math.erfc(abs(x) / math.sqrt(2)) if x == x and x is not None else float("nan"))


def shifts_vs_pool(shifts: DataFrame) -> DataFrame:
    """(gene, mean_shift, n, z): each gene's shifts against the pool of all, which holds them too.

    Average ranks in the union of pool and gene, normal approximation, no correction for ties; z is that of
    the pool's rank sum. shifts: (gene, shift).
    """
    pool = average_ranks(shifts, "shift")
    own = shifts.groupBy("gene", "shift").agg(F.count("*").alias("c"))
    per = Window.partitionBy("gene")
    below = F.coalesce(F.sum("c").over(per.orderBy("shift").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # a value's rank in the union: in the pool, plus the gene's own smaller values, plus half of its equal ones
    ranked = own.withColumn("below", below).join(pool.select(F.col("value").alias("shift"), "rank"), "shift").withColumn("r", F.col("rank") + F.col("below") + F.col("c") / 2.0)
    total = shifts.agg(F.count("*").alias("np"))
    out = ranked.groupBy("gene").agg(F.sum(F.col("c") * F.col("r")).alias("wg"), F.sum("c").alias("ng"), (F.sum(F.col("c") * F.col("shift")) / F.sum("c")).alias("mean_shift")).crossJoin(F.broadcast(total))
    # as doubles: the product of three counts leaves the range of a bigint at some 36 million shifts
    many, few = F.col("np").cast("double"), F.col("ng").cast("double")
    n = many + few
    wp = n * (n + 1) / 2 - F.col("wg")
    return out.select("gene", "mean_shift", F.col("ng").alias("n"), ((wp - many * (n + 1) / 2) / F.sqrt(many * few * (n + 1) / 12)).alias("z"))


def rank_sums(test: DataFrame, null: DataFrame) -> DataFrame:
    """(gene, test_mean, null_mean, difference, n_test, n_null, z): each gene's test values against its null ones, NaN left out."""
    both = test.select("gene", F.col("shift"), F.lit(1).alias("t")).unionByName(null.select("gene", F.col("shift"), F.lit(0).alias("t"))).where(~F.isnan("shift"))
    ranked = both.withColumn("r", average_rank("shift", "gene"))
    is_test = F.col("t") == 1
    out = ranked.groupBy("gene").agg(
        F.avg(F.when(is_test, F.col("shift"))).alias("test_mean"), F.avg(F.when(~is_test, F.col("shift"))).alias("null_mean"), F.count_if(is_test).alias("n_test"), F.count_if(~is_test).alias("n_null"), F.sum(F.when(is_test, F.col("r"))).alias("w"),
    )
    tests, nulls = F.col("n_test").cast("double"), F.col("n_null").cast("double")  # their product with n leaves the range of a bigint
    n = tests + nulls
    z = (F.col("w") - tests * (n + 1) / 2) / F.sqrt(F.nullif(tests * nulls * (n + 1) / 12.0, F.lit(0.0)))
    return out.select("gene", "test_mean", "null_mean", (F.col("test_mean") - F.col("null_mean")).alias("difference"), "n_test", "n_null", z.alias("z"))


def with_significance(stats: DataFrame, level: float = 0.05) -> DataFrame:
    """stats (with z) with p, fdr and sig."""
    return bh_adjust(stats.withColumn("p", two_sided_p("z")), "p", tie="gene").withColumn("sig", (F.col("fdr") < level).cast("int"))


def log_factorial(k: Column) -> Column:
    """ln k! of a whole number: a table up to 15, Stirling's series beyond, off by less than 1e-11 there."""
    few = F.array(*[F.lit(math.lgamma(i + 1)) for i in range(16)])
    x = k.cast("double")
    series = x * F.ln(x) - x + 0.5 * F.ln(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    return F.when(k < 16, F.try_element_at(few, (F.greatest(k, F.lit(0)) + 1).cast("int"))).otherwise(series)


def upper_tail(k: Column, size: Column, n: Column, total: Column) -> Column:
    """The chance of k or more of a set of `size` among n drawn from `total`: a sum over k..min(size, n) within the row."""
    choose = lambda a, b: log_factorial(a) - log_factorial(b) - log_factorial(a - b)
    one = lambda x: F.when(total - size - n + x >= 0, F.exp(choose(size, x) + choose(total - size, n - x) - choose(total, n))).otherwise(0.0)
    return F.least(F.lit(1.0), F.aggregate(F.sequence(k, F.least(size, n)), F.lit(0.0), lambda s, x: s + one(x)))


def over_representation(query: DataFrame, background: DataFrame, sets: DataFrame, min_size: int = 1) -> DataFrame:
    """(term, k, term_size, n_query, n_background, odds, p, genes): one-sided hypergeometric tails of the overlaps.

    query and background: (symbol); sets: (term, symbol). Query symbols outside the background do not count;
    terms without overlap give no row.
    """
    bg = background.select(F.upper("symbol").alias("symbol")).distinct()
    q = query.select(F.upper("symbol").alias("symbol")).distinct().join(bg, "symbol").withColumn("hit", F.lit(1))
    members = sets.select("term", F.upper("symbol").alias("symbol")).distinct().join(bg, "symbol").join(q, "symbol", "left")
    terms = members.groupBy("term").agg(F.count("hit").alias("k"), F.count("*").alias("term_size"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("hit") == 1, F.col("symbol")))), ";").alias("genes"))
    sizes = bg.agg(F.count("*").alias("n_background")).crossJoin(F.broadcast(q.agg(F.count("*").alias("n_query"))))
    t = terms.where((F.col("k") > 0) & (F.col("term_size") >= min_size)).crossJoin(F.broadcast(sizes))
    p = upper_tail(F.col("k"), F.col("term_size"), F.col("n_query"), F.col("n_background"))
    b, c = F.col("n_query") - F.col("k"), F.col("term_size") - F.col("k")
    odds = F.when(b * c == 0, F.lit(float("inf"))).otherwise(F.col("k") * (F.col("n_background") - F.col("n_query") - c) / (b * c))
    return t.select("term", "k", "term_size", "n_query", "n_background", odds.alias("odds"), p.alias("p"), "genes")


def profile_metrics(result: DataFrame, reference: DataFrame, fdr: float) -> DataFrame:
    """(sig_jaccard, sig_shared, cosine) of two term tables: significant terms, and minus log10 p over all terms (missing p is 1)."""
    a = result.select("term", F.col("p").alias("pa"), (F.col("fdr") < fdr).alias("sa"))
    b = reference.select("term", F.col("p").alias("pb"), (F.col("fdr") < fdr).alias("sb"))
    low = lambda c: -F.log10(F.greatest(F.coalesce(c, F.lit(1.0)), F.lit(1e-300)))
    j = a.join(b, "term", "full").select(low(F.col("pa")).alias("x"), low(F.col("pb")).alias("y"), F.coalesce("sa", F.lit(False)).alias("sa"), F.coalesce("sb", F.lit(False)).alias("sb"))
    shared, either = F.count_if(F.col("sa") & F.col("sb")), F.count_if(F.col("sa") | F.col("sb"))
    size = F.sqrt(F.sum(F.col("x") * F.col("x")) * F.sum(F.col("y") * F.col("y")))
    return j.agg((shared / F.nullif(either, F.lit(0))).alias("sig_jaccard"), shared.alias("sig_shared"), (F.sum(F.col("x") * F.col("y")) / F.nullif(size, F.lit(0.0))).alias("cosine"))


def closeness(rows: DataFrame, d: str, goal: str, top: float = 0.2) -> DataFrame:
    """(progress, cosine, spearman, distance_closed, toward_goal) of changes d against the goal's, one row a token.

    toward_goal looks at the tokens whose goal change is in the largest `top` share by size and not 0.
    """
    named = rows.select(F.col(d).alias("d"), F.col(goal).alias("g"))
    cut = quantiles(named.select(F.abs("g").alias("g")), "g", [1.0 - top]).select(F.col("quantiles")[0].alias("_cut"))
    x = with_ranks(named, {"d": "rd", "g": "rg"}).crossJoin(F.broadcast(cut))
    big = (F.abs("g") >= F.col("_cut")) & (F.col("g") != 0)
    dg, gg, dd = F.sum(F.col("d") * F.col("g")), F.nullif(F.sum(F.col("g") * F.col("g")), F.lit(0.0)), F.nullif(F.sum(F.col("d") * F.col("d")), F.lit(0.0))
    gap = F.col("g") - F.col("d")
    return x.agg(
        (dg / gg).alias("progress"), (dg / F.sqrt(dd * gg)).alias("cosine"), correlation("rd", "rg").alias("spearman"), (1 - F.sqrt(F.sum(gap * gap)) / F.sqrt(gg)).alias("distance_closed"),
        F.avg(F.when(big, (F.signum("d") == F.signum("g")).cast("int"))).alias("toward_goal"),
    )


def auc_goal_gain(rows: DataFrame, d: str, goal: str, token: str, fraction: float = 0.1) -> DataFrame:
    """(auc): chance that d of a token of lowest goal change is below that of one of highest, ties counting half."""
    many = rows.agg(F.count("*").alias("n"))
    placed = numbered(rows.select(F.col(d).alias("d"), F.col(goal).alias("_goal"), F.col(token).alias("_token")), "_goal", "_token")
    x = placed.crossJoin(F.broadcast(many)).withColumn("k", F.greatest(F.lit(1), F.ceil(F.col("n") * fraction)))
    ends = x.where((F.col("position") < F.col("k")) | (F.col("position") >= F.col("n") - F.col("k")))
    high = F.sum(F.when(F.col("position") >= F.col("n") - F.col("k"), F.col("r")))
    k = F.first("k")
    return with_ranks(ends, {"d": "r"}).agg(((high - k * (k + 1) / 2.0) / (k * k)).alias("auc"))


def set_means(values: DataFrame, sets: DataFrame, least: int = 10) -> DataFrame:
    """(term, n, mean) of a value over the members of each set with enough of them. values: (symbol, v)."""
    return sets.select("term", "symbol").distinct().join(values, "symbol").groupBy("term").agg(F.count("*").alias("n"), F.avg("v").alias("mean")).where(F.col("n") >= least)


def compare_to_placebos(values: DataFrame, query: float | Column) -> DataFrame:
    """(n, placebo_mean, placebo_sd, z, p_empirical) of a query value among placebo values (v)."""
    q = F.lit(query) if not isinstance(query, Column) else query
    v = values.where(F.col("v").isNotNull() & ~F.isnan("v"))
    mean, sd = F.avg("v"), F.nullif(F.stddev_samp("v"), F.lit(0.0))
    return v.agg(F.count("*").alias("n"), mean.alias("placebo_mean"), F.stddev_samp("v").alias("placebo_sd"), ((q - mean) / sd).alias("z"), ((1 + F.count_if(F.col("v") >= q)) / (1 + F.count("*"))).alias("p_empirical"))


def smd(a: Column, b: Column) -> Column:
    """Standardised mean difference of two columns' values (nulls left out), for use in agg(); 0 where neither varies."""
    sd = F.sqrt((F.var_samp(a) + F.var_samp(b)) / 2)
    return F.when(sd > 0, (F.avg(a) - F.avg(b)) / sd).otherwise(0.0)


def specific_gain(gains: DataFrame, configured: str) -> DataFrame:
    """Point estimates of the configured chain's gain beyond the random chains'. gains: (chain, cell, gain)."""
    is_conf = F.col("chain") == configured
    cells = gains.groupBy("cell").agg(F.max(F.when(is_conf, F.col("gain"))).alias("c"), F.avg(F.when(~is_conf, F.col("gain"))).alias("r"), F.max(F.when(~is_conf, F.col("gain"))).alias("m"))
    chains = gains.where(~is_conf).groupBy("chain").agg(F.avg("gain").alias("g"))
    over_cells = cells.agg(
        F.count("*").alias("n_cells"), F.avg("c").alias("configured_gain"), F.avg("r").alias("random_gain"), F.avg(F.col("c") - F.col("r")).alias("specific_gain"),
        F.percentile(F.col("c") - F.col("r"), F.lit(0.5)).alias("specific_median"), F.avg((F.col("c") > F.col("r")).cast("int")).alias("frac_positive"), F.avg((F.col("c") > F.col("m")).cast("int")).alias("frac_above_all"),
    )
    both = chains.crossJoin(F.broadcast(over_cells.select("configured_gain"))).agg(
        F.count("*").alias("n_chains"), F.stddev_samp("g").alias("sd_chains"), (1 + F.count_if(F.col("g") >= F.col("configured_gain"))).alias("rank_among_random"),
        ((F.first("configured_gain") - F.avg("g")) / F.nullif(F.stddev_samp("g"), F.lit(0.0))).alias("z_vs_random"),
    )
    return over_cells.crossJoin(F.broadcast(both))


def running_mean(chains: DataFrame) -> DataFrame:
    """chains (i, gain) with the mean of the first i and its standard error."""
    w = Window.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return chains.select("i", "gain", F.avg("gain").over(w).alias("running_mean"), (F.stddev_samp("gain").over(w) / F.sqrt(F.count("*").over(w))).alias("running_se"))


def hash_sign(key: Column, draw: Column) -> Column:
    """+1 or -1 from the first hex digit of an md5 of both."""
    first = F.substring(F.md5(F.concat_ws(":", draw.cast("string"), key.cast("string"))), 1, 1)
    return F.when(first < "8", 1).otherwise(-1)


def sign_flip_test(diffs: DataFrame, key: str, draws: int) -> DataFrame:
    """(n, mean_diff, p_value) of a paired two-sided permutation test; signs are hashes of draw and key.

    Each row is exploded into its signed values, `draws` of them, which are summed map-side.
    """
    d = diffs.where(F.col("diff").isNotNull() & ~F.isnan("diff"))
    base = d.agg(F.count("*").alias("n"), F.avg("diff").alias("mean_diff"))
    sums = d.select(key, "diff", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw")).groupBy("draw").agg((F.sum(F.col("diff") * hash_sign(F.col(key), F.col("draw"))) / F.count("*")).alias("m"))
    hit = sums.crossJoin(F.broadcast(base)).agg(F.first("n").alias("n"), F.first("mean_diff").alias("mean_diff"), ((1 + F.count_if(F.abs("m") >= F.abs(F.col("mean_diff")) - 1e-12)) / float(draws + 1)).alias("p_value"))
    return hit


def mixture(values: DataFrame, column: str, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(means, variances, weights) of two normal components, the lower mean first, by expectation-maximisation.

    Each round is one aggregate over the values; six sums come back.
    """
    v = kept(values.select(F.col(column).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v")))
    (lo, hi), var = quantiles(v, "v", [0.25, 0.75]).first().quantiles, v.agg(F.var_pop("v")).first()[0]
    mean, var, weight = np.array([lo, hi], float), np.array([max(var, 1e-6)] * 2, float), np.array([0.5, 0.5])
    for _ in range(rounds):
        like = [F.lit(float(weight[i] / math.sqrt(var[i]))) * F.exp(-(F.col("v") - float(mean[i])) * (F.col("v") - float(mean[i])) / float(2 * var[i])) for i in (0, 1)]
        r = like[1] / F.greatest(like[0] + like[1], F.lit(1e-300))
        s = v.select("v", r.alias("r")).agg(F.count("*"), F.sum("r"), F.sum(F.col("r") * F.col("v")), F.sum(F.col("r") * F.col("v") * F.col("v")), F.sum("v"), F.sum(F.col("v") * F.col("v"))).first()
        n1 = min(max(s[1], 1e-9), s[0] - 1e-9)
        n0 = s[0] - n1
        fresh = np.array([(s[4] - s[2]) / n0, s[2] / n1])
        var = np.maximum(np.array([(s[5] - s[3]) / n0, s[3] / n1]) - fresh**2, 1e-12)
        done = np.abs(fresh - mean).max() < 1e-9
        mean, weight = fresh, np.array([n0, n1]) / s[0]
        if done:
            break
    order = np.argsort(mean)
    return mean[order], var[order], weight[order]


def impact(value: Column, means: np.ndarray, variances: np.ndarray, weights: np.ndarray) -> Column:
    """1 for the component of the lower mean, 0 for the other; beyond the outer means the side decides."""
    score = [math.log(weights[i] / math.sqrt(variances[i])) - (value - float(means[i])) * (value - float(means[i])) / float(2 * variances[i]) for i in (0, 1)]
    return F.when(value > float(means[1]), 0).when(value < float(means[0]), 1).otherwise((score[0] >= score[1]).cast("int"))
