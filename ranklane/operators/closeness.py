"""How close changes come to the goal's: for keys, for means of key sets and for enriched terms, against placebo chains.

Changes of all chains are rows (chain, token, d), so every metric is one aggregate over them; what is ranked is ranked over
ranges. Values come in long form: (level, metric, chain, value).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ranklane.functions.aggregates import correlation
from ranklane.operators import ranking, reports
from ranklane.sources.shared import kept

#: The chain that the others are placebos of.
CONFIGURED = "configured"


def vector_metrics(values: DataFrame, *by: str, top: float = 0.2) -> DataFrame:
    """(by, progress, cosine, spearman, distance_closed, toward_goal) of the changes d against g of each group; null where undefined.

    toward_goal looks at the rows whose g is in the largest `top` share by size and not 0.
    """
    v = kept(values.select(*by, F.col("d").cast("double").alias("d"), F.col("g").cast("double").alias("g")))
    cut = ranking.quantiles(v.select(*by, F.abs("g").alias("_g")), "_g", [1.0 - top], *by).select(*by, F.col("quantiles")[0].alias("_cut"))
    x = ranking.ranks_within(v, {"d": "_rd", "g": "_rg"}, *by).join(cut, list(by))
    dg, gg, dd, gap = F.sum(F.col("d") * F.col("g")), F.nullif(F.sum(F.col("g") * F.col("g")), F.lit(0.0)), F.nullif(F.sum(F.col("d") * F.col("d")), F.lit(0.0)), F.col("g") - F.col("d")
    big = (F.abs("g") >= F.col("_cut")) & (F.col("g") != 0)
    return x.groupBy(*by).agg(
        (dg / gg).alias("progress"), (dg / F.sqrt(dd * gg)).alias("cosine"), correlation("_rd", "_rg").alias("spearman"), (1 - F.sqrt(F.sum(gap * gap)) / F.sqrt(gg)).alias("distance_closed"),
        F.avg(F.when(big, (F.signum("d") == F.signum("g")).cast("int"))).alias("toward_goal"),
    )


def auc_goal_gain(values: DataFrame, key: str, *by: str, fraction: float = 0.1) -> DataFrame:
    """(by, auc_goal_gain): the chance that d of a key of lowest g is below that of one of highest, ties counting half; equal g by key."""
    v = values.select(*by, F.col(key).alias("_key"), F.col("d").cast("double").alias("d"), F.col("g").cast("double").alias("g"))
    placed = kept(ranking.running(v, F.lit(1).cast("bigint"), *by, "g", "_key"))
    groups = placed.groupBy(*by).agg(F.min("before").alias("_first"), F.count("*").alias("_n"))
    at, k = F.col("before") - F.col("_first"), F.greatest(F.lit(1), F.ceil(F.col("_n") * fraction))
    high = at >= F.col("_n") - k
    # a key of a very small group is in both ends
    ends = placed.join(groups, list(by)).select(*by, "d", k.alias("_k"), F.explode(F.filter(F.array(F.when(at < k, F.lit(0)), F.when(high, F.lit(1))), lambda x: x.isNotNull())).alias("_high"))
    ranked = ranking.ranks_within(ends, {"d": "_r"}, *by)
    k = F.first("_k")
    return ranked.groupBy(*by).agg(((F.sum(F.when(F.col("_high") == 1, F.col("_r"))) - k * (k + 1) / 2.0) / (k * k)).alias("auc_goal_gain"))


def _long(wide: DataFrame, *metrics: str) -> DataFrame:
    return wide.select("level", "chain", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("x")).select("level", "x.metric", "chain", "x.value")


def set_changes(changes: DataFrame, goal: DataFrame, sets: DataFrame, symbols: DataFrame, least: int = 10) -> DataFrame:
    """(library, term, chain, d, g): mean changes over the keys of each set with at least `least` of them.

    changes: (chain, token, d); goal: (token, g); sets: (library, term, symbol); symbols: (token, symbol), a key without one going by its number.
    """
    named = goal.join(symbols, "token", "left").select("token", "g", F.upper(F.coalesce("symbol", F.col("token").cast("string"))).alias("symbol"))
    members = kept(sets.select("library", "term", F.upper("symbol").alias("symbol")).distinct().join(named, "symbol"))
    large = members.groupBy("library", "term").agg(F.count("*").alias("_n"), F.avg("g").alias("g")).where(F.col("_n") >= least)
    means = members.join(changes, "token").groupBy("library", "term", "chain").agg(F.avg("d").alias("d"))
    return means.join(large.drop("_n"), ["library", "term"])


def key_and_set_values(changes: DataFrame, goal: DataFrame, sets: DataFrame, symbols: DataFrame, least: int = 10) -> DataFrame:
    """(level, metric, chain, value): level "gene" over keys, and each library over its sets' means."""
    by_key = changes.join(goal, "token").select(F.lit("gene").alias("level"), "chain", "token", "d", "g")
    return values_of(by_key, set_changes(changes, goal, sets, symbols, least).select(F.col("library").alias("level"), "chain", "d", "g"))


def values_of(by_key: DataFrame, by_set: DataFrame) -> DataFrame:
    """(level, metric, chain, value) of keys (level, chain, token, d, g) and sets (level, chain, d, g)."""
    metrics = ("progress", "cosine", "spearman", "distance_closed", "toward_goal")
    vectors = _long(vector_metrics(by_key.select("level", "chain", "d", "g").unionByName(by_set), "level", "chain"), *metrics)
    return vectors.unionByName(_long(auc_goal_gain(by_key, "token", "level", "chain"), "auc_goal_gain"))


def profile_values(terms: DataFrame, fdr: float) -> DataFrame:
    """(level, metric, chain, value) of enrichments (list, library, term, p, fdr) against the list "goal"; other lists are named kind|chain.

    The Jaccard index and number of shared significant terms, and the cosine of minus log10 p, a term that a list lacks counting 0.
    """
    low = -F.log10(F.greatest(F.col("p"), F.lit(1e-300)))
    x = terms.select("list", "library", "term", low.alias("a"), (F.col("fdr") < fdr).alias("s"))
    goal = kept(x.where("list = 'goal'").select("library", "term", F.col("a").alias("b"), F.col("s").alias("sb")))
    whole = goal.groupBy("library").agg(F.sum(F.col("b") * F.col("b")).alias("bb"), F.count_if("sb").alias("n_b"))
    other = x.where("list <> 'goal'").join(goal, ["library", "term"], "left")
    g = other.groupBy("list", "library").agg(F.sum(F.col("a") * F.col("a")).alias("aa"), F.sum(F.col("a") * F.col("b")).alias("ab"), F.count_if("s").alias("n_a"), F.count_if(F.col("s") & F.col("sb")).alias("both")).join(whole, "library", "left").fillna(0, ["ab", "n_b", "bb"])
    told = g.select(
        F.concat(F.lit("ora:"), "library").alias("level"), F.split("list", r"\|", 2).alias("_l"), (F.col("both") / F.nullif(F.col("n_a") + F.col("n_b") - F.col("both"), F.lit(0))).alias("sig_jaccard"), F.col("both").cast("double").alias("sig_shared"),
        (F.col("ab") / F.nullif(F.sqrt(F.col("aa") * F.col("bb")), F.lit(0.0))).alias("cosine"),
    )
    long = _long(told.withColumn("chain", F.col("_l")[1]).withColumn("level", F.concat_ws("\0", "level", F.col("_l")[0])), "sig_jaccard", "sig_shared", "cosine")
    parts = F.split("level", "\0")
    return long.select(parts[0].alias("level"), F.concat_ws("_", parts[1], "metric").alias("metric"), "chain", "value")


def enrichment_values(table: DataFrame, changes: DataFrame, sets: DataFrame, symbols: DataFrame, fraction: float = 0.1, fdr: float = 0.05) -> DataFrame:
    """(level, metric, chain, value) at level "ora:library": each chain's two lists of top keys (isp: lowest start rank plus change;
    dspec: lowest change) against the goal's (lowest goal rank). table: (token, start_rank, goal_rank)."""
    scores = changes.join(table, "token").select(F.explode(F.array(F.struct(F.lit("isp").alias("k"), (F.col("start_rank") + F.col("d")).alias("s")), F.struct(F.lit("dspec").alias("k"), F.col("d").alias("s")))).alias("x"), "chain", "token")
    scores = scores.select(F.concat_ws("|", "x.k", "chain").alias("list"), "token", F.col("x.s").alias("score")).unionByName(table.select(F.lit("goal").alias("list"), "token", F.col("goal_rank").alias("score")))
    placed = kept(ranking.running(scores, F.lit(1).cast("bigint"), "list", "score", "token"))
    groups = placed.groupBy("list").agg(F.min("before").alias("_first"), F.count("*").alias("_n"))
    top = placed.join(groups, "list").where(F.col("before") - F.col("_first") < F.ceil(F.col("_n") * fraction))
    named = table.select("token").join(symbols, "token", "left").select("token", F.coalesce("symbol", F.col("token").cast("string")).alias("symbol"))
    return profile_values(reports.fan_out(top.join(named, "token").select("list", "symbol"), named, sets, fdr=fdr), fdr)


def against_placebos(values: DataFrame, configured: str = CONFIGURED) -> DataFrame:
    """(level, metric, value, placebo_mean, placebo_sd, z, p_empirical, n_placebos) of the configured chain's values among the other chains'."""
    own = values.where(F.col("chain") == configured).select("level", "metric", F.col("value").alias("q"))
    rest = values.where((F.col("chain") != configured) & F.col("value").isNotNull() & ~F.isnan("value")).select("level", "metric", "value")
    j = own.join(rest, ["level", "metric"], "left")
    n, sd = F.count("value"), F.stddev_samp("value")
    return j.groupBy("level", "metric").agg(
        F.first("q").alias("value"), F.avg("value").alias("placebo_mean"), sd.alias("placebo_sd"), ((F.first("q") - F.avg("value")) / F.nullif(sd, F.lit(0.0))).alias("z"),
        F.when(n > 0, (1 + F.count_if(F.col("value") >= F.col("q"))) / (1 + n)).alias("p_empirical"), n.alias("n_placebos"),
    )


def report(table: DataFrame, placebos: DataFrame, sets: DataFrame, symbols: DataFrame, seeds: DataFrame | None = None, fraction: float = 0.1, fdr: float = 0.05, least: int = 10) -> tuple[DataFrame, DataFrame]:
    """(values, summary): every metric of the configured chain and of each placebo chain, and the former among the latter.

    table: (token, start_rank, goal_rank, delta_spec); placebos: (seed, chain, token, d), averaged over seeds; seeds: (seed, token, d), the
    configured chain's change in single seeds, which the summary has in by_seed (level and metric to value) without
    comparing them.
    """
    goal = kept(table.select("token", (F.col("goal_rank") - F.col("start_rank")).alias("g")))
    mean = placebos.groupBy("chain", "token").agg(F.avg("d").alias("d"))
    changes = kept(table.select(F.lit(CONFIGURED).alias("chain"), "token", F.col("delta_spec").alias("d")).unionByName(mean.where(F.col("chain") != CONFIGURED)))
    values = kept(key_and_set_values(changes, goal, sets, symbols, least).unionByName(enrichment_values(table, changes, sets, symbols, fraction, fdr)))
    summary = against_placebos(values)
    if seeds is not None:
        each = key_and_set_values(seeds.select(F.col("seed").cast("string").alias("chain"), "token", "d"), goal, sets, symbols, least)
        told = each.groupBy("level", "metric").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("chain", "value")))).alias("by_seed"))
        summary = summary.join(told, ["level", "metric"], "left")
    return values, summary


def write_report(values: DataFrame, summary: DataFrame, placebos: DataFrame, folder: str) -> None:
    """closeness_values, closeness_summary (CSV) and placebo_pseudo_delta_spec (gzipped CSV, long) in a folder."""
    out = lambda df, name, **how: df.coalesce(1).write.mode("overwrite").options(header=True, **how).csv(f"{folder}/{name}")
    out(values.orderBy("level", "metric", "chain"), "closeness_values")
    out(summary.drop("by_seed").orderBy("level", "metric"), "closeness_summary")
    out(placebos.groupBy("chain", "token").agg(F.avg("d").alias("pseudo_delta_spec")).orderBy("chain", "token"), "placebo_pseudo_delta_spec", compression="gzip")
