"""Aggregates over ranked lists: position sums, pseudobulk ranks, displacements and contrasts.

Encoded rows are (cell, pos, token, len). Sums are mergeable partial aggregates: what is shuffled is one row
for each token and task.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ranklane.functions.aggregates import correlation
from ranklane.operators import sketches
from ranklane.operators.ranking import numbered, quantiles
from ranklane.sources.shared import kept

#: A stratum match: targets that meet a copy of the population together, keys that they meet in one task, and keys of a block.
DEALT, CROWD, BLOCK = 16384, 8192, 128


def norm_pos() -> Column:
    """A position over the list's last one (0 for a list of one)."""
    return F.col("pos") / F.greatest(F.col("len") - 1, F.lit(1))


def position_sums(encoded: DataFrame, *by: str) -> DataFrame:
    """(by, token, sum_norm_pos, n_cells)."""
    return encoded.groupBy(*by, "token").agg(F.sum(norm_pos()).alias("sum_norm_pos"), F.count("*").alias("n_cells"))


def capped_position_sums(encoded: DataFrame, cells: DataFrame, most: int, seed: int = 0) -> DataFrame:
    """(state, token, sum_norm_pos, n_cells) over at most `most` cells of each state, drawn by a hash of the cell.

    cells: (cell, state), of which only those with a list count. The draw is a mergeable sample, so no state's cells are sorted.
    """
    listed = encoded.where("pos = 0").select("cell").join(cells.select("cell", "state"), "cell")
    return position_sums(encoded.join(sketches.bottom_k(listed, "state", "cell", most, seed), "cell"), "state")


def write_positions(encoded: DataFrame, cells: DataFrame, symbols: DataFrame, folder: str, most: int = 3000, states: Mapping[str, str] | None = None) -> None:
    """Position sums of each state as `<name>_positions` and the vocabulary (token, symbol) as `genes`, as gzipped CSV.

    states: file name by state, such as {"Control": "start"}; each is read, summed and written apart from the others' rows.
    """
    sums = capped_position_sums(encoded, cells.where(F.col("state").isin(*states)) if states else cells, most)
    named = states or {r[0]: r[0] for r in cells.select("state").distinct().collect()}
    out = lambda df, name: df.coalesce(1).write.mode("overwrite").option("compression", "gzip").csv(f"{folder}/{name}", header=True)
    for state, name in named.items():
        out(sums.where(F.col("state") == state).select("token", "sum_norm_pos", "n_cells").orderBy("token"), f"{name}_positions")
    out(symbols.select("token", "symbol").orderBy("token"), "genes")


def merge_position_sums(*parts: DataFrame) -> DataFrame:
    """Partial sums of several runs added up."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("token").agg(F.sum("sum_norm_pos").alias("sum_norm_pos"), F.sum("n_cells").alias("n_cells"))


def cells_per(encoded: DataFrame, *by: str) -> DataFrame:
    """(by, n): the number of cells."""
    return encoded.groupBy(*by).agg(F.count_distinct("cell").alias("n"))


def pseudobulk(sums: DataFrame, totals: DataFrame, *by: str) -> DataFrame:
    """(by, token, rank): the mean normalised position over all cells, absent ones counting as last (1)."""
    joined = sums.join(totals, list(by)) if by else sums.crossJoin(F.broadcast(totals))  # totals is one row
    return joined.select(*by, "token", ((F.col("sum_norm_pos") + F.col("n") - F.col("n_cells")) / F.col("n")).alias("rank"), "n_cells")


def state_ranks(encoded: DataFrame, *by: str) -> DataFrame:
    """(by, token, rank, n_cells): pseudobulk() of lists that are read once and whose sums are written; a cell is counted at its first key."""
    first = F.count_if(F.col("pos") == 0).alias("_first")
    sums = kept(encoded.groupBy(*by, "token").agg(F.sum(norm_pos()).alias("sum_norm_pos"), F.count("*").alias("n_cells"), first))
    return pseudobulk(sums.drop("_first"), sums.groupBy(*by).agg(F.sum("_first").alias("n")), *by)


def displacement(start: DataFrame, final: DataFrame) -> DataFrame:
    """(token, delta): final minus start rank over the tokens of either side, absent ones at 1."""
    s, f = start.select("token", F.col("rank").alias("r0")), final.select("token", F.col("rank").alias("r1"))
    return s.join(f, "token", "full").select("token", (F.coalesce("r1", F.lit(1.0)) - F.coalesce("r0", F.lit(1.0))).alias("delta"))


def mean_positions(encoded: DataFrame, *by: str) -> DataFrame:
    """(by, token, mean_pos, n_cells): raw mean position where present."""
    return encoded.groupBy(*by, "token").agg(F.avg("pos").alias("mean_pos"), F.count("*").alias("n_cells"))


def mean_length(encoded: DataFrame, *by: str) -> DataFrame:
    """(by, mean_len) over cells."""
    return encoded.groupBy(*by, "cell").agg(F.first("len").alias("len")).groupBy(*by).agg(F.avg("len").alias("mean_len"))


def observed_delta(control: DataFrame, observed: DataFrame, least: int = 5) -> DataFrame:
    """(token, delta): difference of mean positions over mean lengths, for tokens seen in enough cells of both states."""

    def side(encoded: DataFrame, name: str) -> DataFrame:
        length = mean_length(encoded).select(F.greatest(F.col("mean_len") - 1, F.lit(1.0)).alias("d"))
        return mean_positions(encoded).where(F.col("n_cells") >= least).crossJoin(F.broadcast(length)).select("token", (F.col("mean_pos") / F.col("d")).alias(name))

    return side(control, "p0").join(side(observed, "p1"), "token").select("token", (F.col("p1") - F.col("p0")).alias("delta"))


def start_profiles(encoded: DataFrame, totals: DataFrame) -> DataFrame:
    """(token, detection, med_pos): share of cells that have the token, median normalised position there."""
    middle = quantiles(encoded.select("token", norm_pos().alias("p")), "p", [0.5], "token").select("token", F.col("quantiles")[0].alias("med_pos"))
    seen = encoded.groupBy("token").agg(F.count("*").alias("c")).join(middle, "token")
    return seen.crossJoin(F.broadcast(totals)).select("token", (F.col("c") / F.col("n")).alias("detection"), "med_pos")


def background(start: DataFrame, goal: DataFrame, least: int, rule: str = "both", exclude: DataFrame | None = None) -> DataFrame:
    """Tokens seen in at least `least` cells of both states, or of either, without the excluded ones."""
    s, g = (x.where(F.col("n_cells") >= least).select("token") for x in (start, goal))
    if rule not in ("both", "either"):
        raise ValueError("background is 'both' or 'either'")
    kept = s.intersect(g) if rule == "both" else s.union(g).distinct()
    return kept if exclude is None else kept.join(exclude.select("token"), "token", "left_anti")


def delta_spec(displacements: DataFrame, configured: str, members: DataFrame) -> DataFrame:
    """(token, delta_configured, delta_placebo_mean, n_placebos, delta_spec).

    displacements: (chain, token, delta), dense over the tokens of all chains. members: (chain, token), the
    chains' own tokens; a placebo chain is left out where it has the token itself.
    """
    own = members.select("chain", "token", F.lit(True).alias("own"))
    d = displacements.join(own, ["chain", "token"], "left")
    is_conf = F.col("chain") == configured
    used = ~is_conf & F.col("own").isNull()
    out = d.groupBy("token").agg(F.max(F.when(is_conf, F.col("delta"))).alias("delta_configured"), F.avg(F.when(used, F.col("delta"))).alias("delta_placebo_mean"), F.count_if(used).alias("n_placebos"))
    return out.withColumn("delta_spec", F.col("delta_configured") - F.col("delta_placebo_mean"))


def leave_one_out(displacements: DataFrame, configured: str, members: DataFrame) -> DataFrame:
    """(chain, token, pseudo): each placebo chain against the mean of the others; 0 at its own tokens and where no other is left.

    The others' mean is the total minus the own value, so no chain is joined with another.
    """
    own = members.select("chain", "token", F.lit(True).alias("own"))
    d = displacements.where(F.col("chain") != configured).join(own, ["chain", "token"], "left")
    usable = F.when(F.col("own").isNull(), F.col("delta"))
    per = Window.partitionBy("token")
    total, n = F.sum(usable).over(per), F.count(usable).over(per)
    others = (F.coalesce(total, F.lit(0.0)) - F.coalesce(usable, F.lit(0.0))) / F.nullif(n - usable.isNotNull().cast("int"), F.lit(0))
    return d.select("chain", "token", F.when(F.col("own").isNotNull(), F.lit(0.0)).otherwise(F.coalesce(F.col("delta") - others, F.lit(0.0))).alias("pseudo"))


def rank_table(tokens: DataFrame, start: DataFrame, goal: DataFrame, delta: DataFrame) -> DataFrame:
    """(token, start_rank, goal_rank, delta_spec, predicted_rank); missing ranks are 1, missing changes 0."""
    out = tokens.join(start.select("token", F.col("rank").alias("s")), "token", "left").join(goal.select("token", F.col("rank").alias("g")), "token", "left").join(delta.select("token", F.col("delta_spec").alias("d")), "token", "left")
    s, g, d = F.coalesce("s", F.lit(1.0)), F.coalesce("g", F.lit(1.0)), F.coalesce("d", F.lit(0.0))
    return out.select("token", s.alias("start_rank"), g.alias("goal_rank"), d.alias("delta_spec"), (s + d).alias("predicted_rank"))


def top_fraction(scores: DataFrame, fraction: float) -> DataFrame:
    """The ceil(fraction * n) lowest scores, ties by token; scores is one row a token."""
    told = scores.where("score IS NOT NULL")
    many = told.agg(F.count("*").alias("_n"))
    return numbered(told, "score", "token").crossJoin(F.broadcast(many)).where(F.col("position") < F.ceil(F.col("_n") * fraction)).drop("_n", "position")


def align_left(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every key of the left lists with its position in the right list of the same cell, or -1 and valid false."""
    r = right.select("cell", "token", F.col("pos").alias("right_pos"))
    return left.join(r, ["cell", "token"], "left").select("cell", "token", "pos", F.coalesce("right_pos", F.lit(-1)).alias("right_pos"), F.col("right_pos").isNotNull().alias("valid"))


def shared(left: DataFrame, right: DataFrame) -> DataFrame:
    """(cell, token, pos_a, pos_b) of keys that both lists of a cell have."""
    a, b = left.select("cell", "token", F.col("pos").alias("pos_a")), right.select("cell", "token", F.col("pos").alias("pos_b"))
    return a.join(b, ["cell", "token"])


def pair_metrics(left: DataFrame, right: DataFrame) -> DataFrame:
    """Per cell: shared keys, Spearman over their order, median, 90th percentile and maximum of moves, share moved."""
    w = Window.partitionBy("cell")
    s = shared(left, right).select("cell", F.abs(F.col("pos_b") - F.col("pos_a")).cast("double").alias("d"), F.row_number().over(w.orderBy("pos_a")).cast("double").alias("ra"), F.row_number().over(w.orderBy("pos_b")).cast("double").alias("rb"))
    out = s.groupBy("cell").agg(
        F.count("*").alias("n_shared"), correlation("ra", "rb").alias("spearman"), F.percentile("d", F.lit(0.5)).alias("disp_median"), F.percentile("d", F.lit(0.9)).alias("disp_p90"),
        F.max("d").alias("disp_max"), F.avg((F.col("d") > 0).cast("int")).alias("frac_moved"),
    )
    few = F.col("n_shared") < 2
    return out.select("cell", "n_shared", *[F.when(~few, F.col(c)).alias(c) for c in ("spearman", "disp_median", "disp_p90", "disp_max", "frac_moved")])


def summarise(cells: DataFrame, metrics: list[str], *by: str) -> DataFrame:
    """Median and quartiles over cells of each metric, in long form: (by, metric, median, q25, q75)."""
    long = cells.select(*by, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in metrics])).alias("x")).select(*by, "x.*")
    q = F.percentile("v", F.array(F.lit(0.5), F.lit(0.25), F.lit(0.75)))
    return long.where(F.col("v").isNotNull() & ~F.isnan("v")).groupBy(*by, "metric").agg(q.alias("q")).select(*by, "metric", F.col("q")[0].alias("median"), F.col("q")[1].alias("q25"), F.col("q")[2].alias("q75"))


def stratum(targets: DataFrame, population: DataFrame, least: int = 50, windows: tuple[float, ...] = (0.1, 0.2, 0.3)) -> DataFrame:
    """(target, token, rank_window): population tokens whose detection is within half and twice the target's and whose
    rank is near; the window widens until `least` match, last without a limit.

    The population is cut into blocks of keys of like detection and near rank. Targets meet blocks by octave of detection and cell of
    rank (the window without a limit: by octave alone), not keys: a block wholly inside the target's bounds is counted or listed as one,
    only those that a bound crosses are looked into. A window's matches are counted first, which shuffles a row for each target and
    task; pairs are listed once, for the window that serves their target, and go straight to the result. Targets are dealt into DEALT
    of equal size and a cell's blocks into CROWD keys, so that a crowded cell is met by many tasks. Population and targets: (token, detection, rank).
    """
    slack = 1e-9  # bounds of octaves and cells are widened by more than rounding; blocks and keys are then compared exactly
    told = "detection > 0 AND token IS NOT NULL"
    octave, strip = (F.floor(F.log2("d") * n).cast("int") for n in (1, 8))
    p = population.where(told).select("token", F.col("detection").alias("d"), F.col("rank").cast("double").alias("r"))
    p = kept(numbered(p.withColumn("octave", octave).withColumn("strip", strip), "strip", "r", "token"))
    t = kept(targets.where(told).select(F.col("token").alias("target"), F.col("detection").alias("td"), F.col("rank").cast("double").alias("tr")))
    low, high = F.col("td") / 2, F.col("td") * 2
    gap = lambda r: r - F.col("tr")
    first = lambda x: F.floor(F.log2("td") + x).cast("int")

    def fits(d: Column, r: Column, window: float) -> Column:
        near = (d >= low) & (d <= high)
        return near & (F.abs(gap(r)) <= window) if window < math.inf else near

    def blocks_of(window: float) -> tuple[DataFrame, list[str]]:
        if window == math.inf:
            some, where = p, ["octave"]
        else:
            some, where = p.where("r IS NOT NULL AND NOT isnan(r)").withColumn("cell", F.floor(F.col("r") / window).cast("bigint")), ["octave", "cell"]
        ends = [f(c).alias(f"{c}{i}") for c in ("d", "r") for i, f in enumerate((F.min, F.max))]
        cut = some.groupBy(*where, "strip", F.floor(F.col("position") / BLOCK).alias("block")).agg(F.count("*").cast("int").alias("n"), *ends, F.collect_list(F.struct("token", "d", "r")).alias("x"))
        return kept(cut.select(*where, "block", "n", "d0", "d1", "r0", "r1", *[F.col(f"x.{c}").alias(name) for c, name in (("token", "tokens"), ("d", "ds"), ("r", "rs"))])), where

    def met(some: DataFrame, blocks: DataFrame, where: list[str], window: float) -> DataFrame:
        """A row for each target and each block that is not wholly outside its bounds, with whether it is wholly inside."""
        salts = max(1, math.ceil(some.count() / DEALT))
        sizes = blocks.groupBy(*where).agg(F.ceil(F.sum("n") / CROWD).cast("int").alias("parts"))  # a row for each cell
        wide = some.withColumn("salt", F.pmod(F.hash("target"), F.lit(salts))).withColumn("octave", F.explode(F.sequence(first(-1 - slack), first(1 + slack))))
        if window < math.inf:
            edge = lambda x: F.floor((F.col("tr") + x * (1 + slack)) / window).cast("bigint")
            wide = wide.where("tr IS NOT NULL AND NOT isnan(tr)").withColumn("cell", F.explode(F.sequence(edge(-window), edge(window))))
        wide = wide.join(F.broadcast(sizes), where).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        every = blocks.join(F.broadcast(sizes), where).withColumn("part", F.pmod(F.hash("block"), F.col("parts"))).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        keys, cells = [*where, "part", "salt"], (sizes.agg(F.sum("parts")).first()[0] or 0) * salts
        many = max(some.sparkSession.sparkContext.defaultParallelism, min(cells, 4096))
        pairs = wide.drop("parts").repartition(many, *keys).join(every.drop("parts", "block").repartition(many, *keys).hint("shuffle_hash"), keys)
        pairs = pairs.where((F.col("d1") >= low) & (F.col("d0") <= high))
        if window < math.inf:
            pairs = pairs.where((gap(F.col("r0")) <= window) & (gap(F.col("r1")) >= -window))
        return pairs.withColumn("inside", fits(F.col("d0"), F.col("r0"), window) & fits(F.col("d1"), F.col("r1"), window))

    def counted(some: DataFrame, *blocks, window: float) -> DataFrame:
        at = F.explode(F.when(F.col("inside"), F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.col("n") - 1)))
        looked = met(some, *blocks, window).withColumn("i", at).where(F.col("inside") | fits(F.col("ds")[F.col("i")], F.col("rs")[F.col("i")], window))
        found = looked.groupBy("target").agg(F.sum(F.when(F.col("inside"), F.col("n")).otherwise(1)).alias("n"))
        own = some.join(p, F.col("token") == F.col("target")).where(fits(F.col("d"), F.col("r"), window)).groupBy("target").agg(F.count("*").alias("own"))
        return found.join(own, "target", "left").select("target", (F.col("n") - F.coalesce("own", F.lit(0))).alias("n"))

    def listed(some: DataFrame, *blocks, window: float) -> DataFrame:
        every = met(some, *blocks, window).select("target", "td", "tr", "inside", "ds", "rs", F.posexplode("tokens").alias("i", "token"))
        one = F.col("inside") | fits(F.col("ds")[F.col("i")], F.col("rs")[F.col("i")], window)
        return every.where(one & (F.col("token") != F.col("target"))).select("target", "token", F.lit(window).alias("rank_window"))

    out = None
    for window in (*windows, math.inf):
        served, blocks = t, blocks_of(window)
        if window < math.inf:
            enough = kept(counted(t, *blocks, window=window).where(F.col("n") >= least).select("target"))
            served, t = kept(t.join(enough, "target", "left_semi")), kept(t.join(enough, "target", "left_anti"))
        some = listed(served, *blocks, window=window)
        out = some if out is None else out.unionByName(some)
        if t.isEmpty():
            break
    return out


def detection_pool(pool: DataFrame, reference: float, low: float = 0.5, high: float = 2.0) -> DataFrame:
    """Pool tokens whose detection lies within [low, high] times the reference."""
    return pool.where(F.col("detection").between(low * reference, high * reference))
