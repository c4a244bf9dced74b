"""Joining, aggregating and comparing results of runs: lists against libraries, seeds, methods, bootstraps."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ranklane.functions import text
from ranklane.operators import ranking, resampling, statistics
from ranklane.sources.shared import kept

#: Fixed values: (organism of the data, organism of the model) and the mapping between them.
PAIRS = {("mouse", "human"): "mouse_to_human", ("human", "mouse"): "human_to_mouse", ("drosophila", "human"): "drosophila_to_human", ("drosophila", "mouse"): "drosophila_to_mouse"}


def above(rows: DataFrame, key: str, column: str, limit: float, name: str, *order: str) -> DataFrame:
    """(key, n, name): how many rows a key has, and whether their mean is above a limit.

    A sum of doubles depends on its order. Where the mean is so near the limit that this decides, values are added up in the given
    order, by a running sum over the key's sorted rows; all others are plain aggregates.
    """
    told = rows.groupBy(key).agg(F.count("*").alias("n"), F.avg(column).alias("_mean"), F.max(F.abs(column)).alias("_most"))
    close = F.abs(F.col("_mean") - limit) <= F.col("n") * F.greatest(F.col("_most"), F.lit(abs(limit))) * 1e-15
    told = kept(told.withColumn("_close", F.coalesce(close, F.lit(False))))
    so_far = F.sum(column).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    near = rows.join(told.where("_close").select(key), key, "left_semi").select(key, column, *order).where(F.col(column).isNotNull()).withColumn("_sum", so_far)
    ordered = near.groupBy(key).agg((F.max_by("_sum", F.struct(*order)) / F.count("*")).alias("_ordered"))
    return told.join(ordered, key, "left").select(key, "n", (F.coalesce("_ordered", "_mean") > limit).alias(name))


def with_stats(background: DataFrame, stats: DataFrame, key: str, flags: tuple[str, ...]) -> DataFrame:
    """Every background row with its statistics; flags of rows without any are false, their numbers null."""
    joined = background.join(stats, key, "left")
    return joined.select(*[(F.coalesce(F.col(c), F.lit(False)) if c in flags else F.col(c)).alias(c) for c in joined.columns])


def seed_mean(rows: DataFrame, key: str, value: str = "delta", seed: str = "seed") -> DataFrame:
    """(key, delta, n_seeds): the mean over seeds of each key's value; a seed's several values of a key are averaged first."""
    of_seed = rows.groupBy(key, seed).agg(F.avg(value).alias("v"))
    return of_seed.groupBy(key).agg(F.avg("v").alias(value), F.count("v").alias("n_seeds"))


def gene_aggregate(rows: DataFrame, order: str) -> DataFrame:
    """(token, pred, target): the mean prediction of a token, and its target in the row of largest order."""
    return rows.groupBy("token").agg(F.avg("pred").alias("pred"), F.max_by("target", order).alias("target"))


def variation(value: str) -> Column:
    """The sample deviation over the size of the mean; NaN is left out, and fewer than two values or a mean of 0 give null."""
    v = F.when(~F.isnan(F.col(value).cast("double")), F.col(value))
    return F.when(F.count(v) >= 2, F.stddev_samp(v) / F.nullif(F.abs(F.avg(v)), F.lit(0.0)))


def gap_closed(baseline: str, method: str, ceiling: str) -> Column:
    """The share of the way from baseline to ceiling that a method goes; null where there is none."""
    return (F.col(method) - F.col(baseline)) / F.nullif(F.col(ceiling) - F.col(baseline), F.lit(0.0))


def union_runs(runs: Mapping[str, DataFrame], seed: str = "seed") -> DataFrame:
    """All runs' rows with a run column; a seed that two runs have is an error."""
    every = None
    for name, df in sorted(runs.items()):
        named = df.withColumn("run", F.lit(name))
        every = named if every is None else every.unionByName(named)
    if every is None:
        raise ValueError("no runs")
    twice = [r[seed] for r in every.groupBy(seed).agg(F.count_distinct("run").alias("n")).where("n > 1").orderBy(seed).limit(5).collect()]
    if twice:
        raise ValueError(f"seeds in more than one run: {twice}")
    return every


def downsample(rows: DataFrame, value: str, k: int, seed: int = 42) -> DataFrame:
    """(value, copy): k values (all, if fewer) in the order of a hash of seed, value and number among its equals, so the rows' order does not matter."""
    numbered = rows.select(F.col(value).alias("value")).groupBy("value").agg(F.count("*").alias("n")).select("value", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy"))
    drawn = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("value").cast("string"), F.col("copy").cast("string")).cast("binary"))
    return numbered.orderBy(drawn, "value", "copy").limit(k)


def conversion(organism: Column, model: Column) -> Column:
    """The mapping that data of an organism needs for a model of another: null for the same one, an error for a pair without one."""
    out = F.when(organism == model, F.lit(None).cast("string"))
    for (a, b), name in PAIRS.items():
        out = out.when((organism == a) & (model == b), F.lit(name))
    return out.otherwise(F.raise_error(F.concat(F.lit("no conversion: "), organism, F.lit(" to "), model)).cast("string"))


def group_order(rows: DataFrame, group: str, shift: str | None = None, least: int = 2, clusters: bool = False) -> DataFrame:
    """(group, n, mean_shift, ord): detected types of at least that many rows, by falling mean shift, or by frequency without one.

    Clusters are ordered by frequency, whatever their names and sizes.
    """
    named = rows if clusters else rows.where(text.is_label(F.col(group).cast("string")))
    mean = F.avg(shift) if shift else F.lit(None).cast("double")
    counted = named.groupBy(group).agg(F.count("*").alias("n"), mean.alias("mean_shift")).where(F.col("n") >= (1 if clusters else max(1, least)))
    first = F.desc("mean_shift") if shift and not clusters else F.desc("n")
    return counted.withColumn("ord", F.row_number().over(Window.orderBy(first, group)))  # of groups


def lollipop(stats: DataFrame, shift: str, key: str, least: int = 20, top: int = 15) -> DataFrame:
    """The significant rows of at least that many detections: the top ones of either sign by size of the shift."""
    fit = stats.where(F.col("sig") & (F.col("n") >= least))
    rising = fit.where(F.col(shift) > 0).orderBy(F.desc(shift), key).limit(top)
    return rising.unionByName(fit.where(F.col(shift) < 0).orderBy(F.asc(shift), key).limit(top))


def paired(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    """(cell, token, a, b) of the samples that both sets have."""
    return a.select("cell", "token", F.col(value).alias("a")).join(b.select("cell", "token", F.col(value).alias("b")), ["cell", "token"])


def fan_out(lists: DataFrame, background: DataFrame, sets: DataFrame, universes: DataFrame | None = None, fdr: float = 0.05) -> DataFrame:
    """(list, library, term, k, term_size, n_query, n_background, p, fdr, sig): every list against every library.

    lists: (list, symbol); sets: (library, term, symbol); background: (symbol), which is every list's universe unless
    universes, (list, symbol), has one for it. Symbols count once and in capitals; terms without overlap give no row;
    fdr is adjusted within each list and library.
    """
    upper = F.upper("symbol").alias("symbol")
    q, members = lists.select("list", upper).distinct(), sets.select("library", "term", upper).distinct()
    plain = background.select(upper).distinct()
    own = universes.select("list", upper).distinct().join(q.select("list").distinct(), "list", "left_semi") if universes is not None else q.limit(0)
    # lists without a universe of their own share the background: its terms are counted once for all of them
    shared = q.join(own.select("list").distinct(), "list", "left_anti").join(plain, "symbol", "left_semi")
    special = q.join(own, ["list", "symbol"], "left_semi")
    count = lambda df, name, *by: df.groupBy(*by).agg(F.count("*").alias(name))
    term = ("library", "term")
    overlaps = lambda hits: count(hits.join(members, "symbol"), "k", "list", *term)
    of_shared = overlaps(shared).join(count(members.join(plain, "symbol"), "term_size", *term), list(term)).join(count(shared, "n_query", "list"), "list").crossJoin(F.broadcast(count(plain, "n_background")))
    of_special = overlaps(special).join(count(own.join(members, "symbol"), "term_size", "list", *term), ["list", *term]).join(count(special, "n_query", "list"), "list").join(count(own, "n_background", "list"), "list")
    columns = ("list", *term, "k", "term_size", "n_query", "n_background")
    terms = of_shared.select(*columns).unionByName(of_special.select(*columns))
    p = statistics.upper_tail(F.col("k"), F.col("term_size"), F.col("n_query"), F.col("n_background"))
    adjusted = ranking.bh_adjust(terms.withColumn("p", p), "p", "list", "library", tie="term")
    return adjusted.withColumn("sig", F.col("fdr") < fdr)


def compare_methods(rows: DataFrame, base: str, parts: int | None = None) -> DataFrame:
    """(method, n_cells, rho, gain): each method's mean over cells of the rank correlation of prediction and target, and
    what it has over the base method. rows: (method, cell, token, pred, target). parts: into how many parts methods' cells are dealt."""
    cell = F.struct("method", "cell").alias("by")
    dealt = rows.select(cell, "pred", "target")
    by_cell = ranking.spearman_by(dealt.repartition(parts, "by") if parts else dealt, "pred", "target", "by").select("by.method", "rho")
    told = by_cell.groupBy("method").agg(F.count("rho").alias("n_cells"), F.avg("rho").alias("rho"))
    return told.crossJoin(F.broadcast(told.where(F.col("method") == base).select(F.col("rho").alias("_base")))).select("method", "n_cells", "rho", (F.col("rho") - F.col("_base")).alias("gain"))


def bootstrap_mean(rows: DataFrame, value: str, clusters: tuple[str, ...], draws: int = 200, seed: int = 7) -> DataFrame:
    """(mean, low, high): the mean and the bounds between which 95 % of the bootstrap means lie, clusters being drawn.

    Two cluster columns (cells and chains, say) are drawn independently and their numbers multiplied. Rows are summed by
    their clusters before draws multiply them.
    """
    sums = rows.where(F.col(value).isNotNull()).groupBy(*clusters).agg(F.sum(value).alias("s"), F.count("*").alias("n"))
    each = sums.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    weight = F.lit(1)
    for i, c in enumerate(clusters):
        weight = weight * resampling.times_drawn(resampling.hashed(F.col(c), F.col("draw"), seed + i))
    means = each.withColumn("w", weight).groupBy("draw").agg((F.sum(F.col("w") * F.col("s")) / F.nullif(F.sum(F.col("w") * F.col("n")), F.lit(0))).alias("m"))
    bounds = means.agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))  # one value a draw
    return sums.agg((F.sum("s") / F.sum("n")).alias("mean")).crossJoin(F.broadcast(bounds))
