"""Bootstraps over cells: rank correlations of pooled samples in which every draw ranks its own rows.

A draw takes a cell a Poisson number of times, from a hash, so no list of cells is gathered and reruns agree. The numbers of all draws
travel as one array a cell. Weighted ranks follow from cumulated weights: a column's distinct values carry, for all draws
at once, how much weight they have and how much lies below. Draw 0 takes every cell once and gives the point estimate.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ranklane.operators import ranking
from ranklane.sources.shared import kept

#: Draws that travel together: a row carries 8 bytes for each, and for each column that is ranked.
TOGETHER = 250
#: Values of a method's column whose ranks every task has.
FEW = 4096
#: Rows in order of the target that a task sweeps.
A_RANGE = 1_000_000
#: Poisson steps that the 32 bits of a hash tell apart.
STEPS = 12
#: What a correlation is made of, summed.
_SUMS = ("n", "p", "t", "pp", "tt", "pt")


def hashed(key: Column, draw: Column, seed: int) -> Column:
    """A number in [0, 1) with 32 bits, from an md5 of seed, draw and key."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), draw.cast("string"), key.cast("string")).cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)


def poisson_steps() -> list[float]:
    """The Poisson distribution of mean 1 up to 0, 1, ... as a number is taken over once for each step that its uniform one reaches."""
    out, total, term = [], 0.0, 0.36787944117144233
    for n in range(STEPS):
        total += term
        out.append(total)
        term /= n + 1
    return out


def times_drawn(uniform: Column) -> Column:
    """The Poisson number of mean 1 that a uniform one stands for."""
    out = F.lit(0)
    for step in poisson_steps():
        out = out + (uniform >= step).cast("int")
    return out


def draw_weights(keys: DataFrame, key: str, first: int, last: int, seed: int) -> DataFrame:
    """(key, w): how often each distinct key is taken in the draws first to last; draw 0 takes each once."""
    uniform = F.transform(F.sequence(F.lit(first), F.lit(last)), lambda d: F.when(d == 0, 0.5).otherwise(hashed(F.col(key), d, seed)))  # 0.5 is taken once
    return keys.select(key).distinct().withColumn("w", F.transform(uniform, lambda u: times_drawn(u).cast("tinyint")))


def _matrix(column: pa.Array, kind: type = np.float64) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


def _by_value(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The weights of a task's equal values added up, FEW values at a time."""
    held = None

    def out(values: np.ndarray, w: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(values), pa.array(list(w), pa.list_(pa.float64()))], names=["v", "w"])

    for batch in batches:
        if batch.num_rows:
            v, w = batch.column(0).to_numpy(), _matrix(batch.column(1))
            if held:
                v, w = np.concatenate([held[0], v]), np.concatenate([held[1], w])
            order = np.argsort(v, kind="stable")
            values, first = np.unique(v[order], return_index=True)
            held = values, np.add.reduceat(w[order], first, axis=0)
            if len(values) > FEW:
                yield out(*held)
                held = None
    if held:
        yield out(*held)


def _cumulated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, v, r) of a range in order: r is the weight below v in this range plus half of v's own and a half; last the range's weight, with v null."""
    part, below, value, own = TaskContext.get().partitionId(), None, None, None

    def out(vs: list, rs: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part] * len(vs), pa.int32()), pa.array(vs, pa.float64()), pa.array(rs, pa.list_(pa.float64()))], names=["part", "v", "r"])

    for batch in batches:
        vs, rs = [], []
        w = _matrix(batch.column(1)) if batch.num_rows else None
        for i, v in enumerate(batch.column(0).to_numpy()):
            if v == value:
                own = own + w[i]
                continue
            if value is not None:
                vs.append(value)
                rs.append(below + (own + 1) / 2)
                below = below + own
            else:
                below = np.zeros(w.shape[1])
            value, own = v, w[i]
        yield out(vs, rs)
    if value is not None:
        yield out([value, None], [below + (own + 1) / 2, below + own])


def weighted_ranks(rows: DataFrame, column: str) -> DataFrame:
    """(v, r): the average rank of each distinct value of a column in every draw; rows: the column and w, an array.

    Equal values are added up by every task before they meet, and ranges of values are cumulated apart. The driver gets one row of
    draws a range, to tell each what lies below it.
    """
    x = rows.select((F.col(column).cast("double") + 0.0).alias("v"), "w")
    summed = x.mapInArrow(_by_value, "v double, w array<double>").repartitionByRange("v").sortWithinPartitions("v")
    ranged = kept(summed.mapInArrow(_cumulated, "part int, v double, r array<double>"))
    before, offsets = None, []
    for r in sorted(ranged.where("v IS NULL").collect(), key=lambda r: r.part):
        offsets.append((r.part, [0.0] * len(r.r) if before is None else before.tolist()))
        before = np.array(r.r) if before is None else before + np.array(r.r)
    lower = rows.sparkSession.createDataFrame(offsets, "part int, o array<double>")
    return ranged.where("v IS NOT NULL").join(F.broadcast(lower), "part").select("v", F.zip_with("r", "o", lambda r, o: r + o).alias("r"))


def _swept(names: Sequence[str], tables: Sequence[tuple[np.ndarray, np.ndarray] | None], first: int):
    """Sums over a range of rows in order of the target, whose ranks u are counted from the range's first row.

    tables: the values and ranks of a method of few values, whose column holds values; None: the column holds ranks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, m = TaskContext.get().partitionId(), len(names)
        done: dict[int, np.ndarray] = {}  # by bin: n, u, uu and, for each method, p, pp, pu
        open_: dict[int, np.ndarray] = {}  # by bin, of the value at hand: n and, for each method, p
        value, below, own = None, 0.0, 0.0

        def close() -> None:
            u = below + (own + 1) / 2
            for b, x in open_.items():
                at = done[b]
                at[1] += x[0] * u
                at[2] += x[0] * u * u
                at[5::3] += x[1:] * u
            open_.clear()

        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                some = batch.slice(start, 4096)
                t, bins, w = some.column(0).to_numpy(), some.column(1).to_numpy(), _matrix(some.column(2))
                ps = [_matrix(some.column(3 + i)) if told is None else told[1][np.searchsorted(told[0], some.column(3 + i).to_numpy() + 0.0)] for i, told in enumerate(tables)]
                if value is None:
                    value = t[0]
                edges = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
                owns = np.add.reduceat(w, edges, axis=0)
                if t[0] != value:
                    close()
                    value, below, own = t[0], below + own, 0.0
                # the first run may have begun before, the last may go on: both wait until their value is through
                belows = below + np.r_[np.zeros((1, w.shape[1])), np.cumsum(np.r_[own + owns[:1], owns[1:]], axis=0)[:-1]]
                inner = np.repeat(belows + (owns + 1) / 2, np.diff(np.r_[edges, len(t)]), axis=0)
                last = edges[-1]
                head = edges[1] if len(edges) > 1 else len(t)
                found, place = np.unique(bins, return_inverse=True)
                hot = np.zeros((len(found), len(t)))
                hot[place, np.arange(len(t))] = 1.0
                for b in found:
                    done.setdefault(int(b), np.zeros((3 + 3 * m, w.shape[1])))

                def wait(lo: int, hi: int) -> None:
                    n, each = hot[:, lo:hi] @ w[lo:hi], [hot[:, lo:hi] @ (w[lo:hi] * p[lo:hi]) for p in ps]
                    for k, b in enumerate(found):
                        if hot[k, lo:hi].any():
                            at = open_.setdefault(int(b), np.zeros((1 + m, w.shape[1])))
                            at[0] += n[k]
                            for i in range(m):
                                at[1 + i] += each[i][k]

                wp = [w * p for p in ps]
                plain = [hot @ w, *[hot @ x for x in wp], *[hot @ (x * p) for x, p in zip(wp, ps, strict=True)]]
                for k, b in enumerate(found):
                    at = done[int(b)]
                    at[0] += plain[0][k]
                    for i in range(m):
                        at[3 + 3 * i] += plain[1 + i][k]
                        at[4 + 3 * i] += plain[1 + m + i][k]
                wait(0, head)
                own = own + owns[0]
                if len(edges) > 1:
                    close()
                    wu = w[head:last] * inner[head:last]
                    mid = [hot[:, head:last] @ wu, hot[:, head:last] @ (wu * inner[head:last]), *[hot[:, head:last] @ (wu * p[head:last]) for p in ps]]
                    for k, b in enumerate(found):
                        at = done[int(b)]
                        at[1] += mid[0][k]
                        at[2] += mid[1][k]
                        for i in range(m):
                            at[5 + 3 * i] += mid[2 + i][k]
                    value, below, own = t[last], belows[-1], owns[-1]
                    wait(last, len(t))
        if value is not None:
            close()
        for b, x in done.items():
            draws = x.shape[1]
            for i, name in enumerate(names):
                arrays = [pa.array(np.full(draws, part, np.int32)), pa.array(np.arange(draws, dtype=np.int32) + first), pa.array([name] * draws), pa.array(np.full(draws, b, np.int32)), *[pa.array(x[j]) for j in (0, 3 + 3 * i, 1, 4 + 3 * i, 2, 5 + 3 * i)]]
                yield pa.RecordBatch.from_arrays(arrays, names=["part", "draw", "method", "bin", "n", "p", "u", "pp", "uu", "pu"])

    return run


def resampled_sums(rows: DataFrame, methods: Sequence[str], target: str, cell: str, draws: int, seed: int = 0, bin_col: str | None = None) -> DataFrame:
    """(draw, method, bin, n, p, t, pp, tt, pt): sums of the weighted ranks of each method's column and of the target, for draws 0 to `draws`.

    Rows with a null or NaN among these columns are left out. Ranks are those of the draw: over all its rows, cells taken as often as
    they are. bin_col: sums are kept apart by it (one bin without it). TOGETHER draws travel at once. Rows go by ranges of the target, in
    order, so its ranks are counted where they lie and what precedes a range is added to the sums; ranks of a method of at most
    FEW values are a table that every task has, those of others are joined. What a task returns is a row for each draw, method and bin.
    """
    columns = list(dict.fromkeys([*methods, target]))
    fine = F.col(cell).isNotNull()
    for c in columns:
        fine = fine & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    b = F.col(bin_col).cast("int") if bin_col else F.lit(0)
    rows = kept(rows.where(fine).select(F.col(cell).alias("_cell"), b.alias("_bin"), *[(F.col(c).cast("double") + 0.0).alias(f"_c{i}") for i, c in enumerate(columns)]))
    many = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // A_RANGE))
    out = None
    for first in range(0, draws + 1, TOGETHER):
        weights = kept(draw_weights(rows, "_cell", first, min(draws, first + TOGETHER - 1), seed))
        drawn = kept(rows.join(weights, "_cell").drop("_cell"))
        x, tables, carried = drawn, [], []
        for m in methods:
            i = columns.index(m)
            told = weighted_ranks(drawn, f"_c{i}").select(F.col("v").alias(f"_v{i}"), F.col("r").alias(f"_r{i}"))
            some = told.limit(FEW + 1).collect() if drawn.select(f"_c{i}").distinct().limit(FEW + 1).count() <= FEW else None
            if some is not None:
                some.sort(key=lambda r: r[0])
                tables.append((np.array([r[0] for r in some]), np.array([r[1] for r in some])))
                carried.append(f"_c{i}")
            else:
                tables.append(None)
                x = x.join(told, F.col(f"_c{i}") == F.col(f"_v{i}")).drop(f"_v{i}")
                carried.append(f"_r{i}")
        t = f"_c{columns.index(target)}"
        dealt = x.select(F.col(t).alias("_t"), "_bin", "w", *[F.col(c).alias(f"_m{k}") for k, c in enumerate(carried)]).repartitionByRange(many, "_t").sortWithinPartitions("_t")
        swept = kept(dealt.mapInArrow(_swept(list(methods), tables, first), "part int, draw int, method string, bin int, n double, p double, u double, pp double, uu double, pu double"))
        size = swept.where(F.col("method") == methods[0]).groupBy("draw", "part").agg(F.sum("n").alias("_n"))  # a row for each draw and range
        o = F.coalesce(F.sum("_n").over(Window.partitionBy("draw").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        sums = swept.join(size.select("draw", "part", o.alias("o")), ["draw", "part"])
        o, n, u = F.col("o"), F.col("n"), F.col("u")
        sums = sums.select("draw", "method", "bin", "n", "p", (u + o * n).alias("t"), "pp", (F.col("uu") + 2 * o * u + o * o * n).alias("tt"), (F.col("pu") + o * F.col("p")).alias("pt"))
        out = sums if out is None else out.unionByName(sums)
    return kept(out.groupBy("draw", "method", "bin").agg(*[F.sum(c).alias(c) for c in ("n", "p", "t", "pp", "tt", "pt")]))


def pooled(sums: DataFrame) -> DataFrame:
    """(draw, method, rho): the pooled rank correlation of each draw, whatever the bins; null where it is undefined."""
    whole = sums.groupBy("draw", "method").agg(*[F.sum(c).alias(c) for c in ("n", "p", "t", "pp", "tt", "pt")])
    return ranking.partial_of_sums(whole, "draw", "method").withColumnRenamed("partial", "rho")


def partial(sums: DataFrame) -> DataFrame:
    """(draw, method, rho): the correlation of each draw's ranks without their bins' means."""
    return ranking.partial_of_sums(sums.where("n > 0"), "draw", "method").withColumnRenamed("partial", "rho")


def _told(values: DataFrame, point: str, by: tuple[str, ...], ci: float, index_rule: bool) -> DataFrame:
    """(by, point, ci_low, ci_high, n_boot, excludes_zero) of (by, draw, x); the draws of a group are as many as were asked for."""
    drawn = F.when((F.col("draw") > 0) & F.col("x").isNotNull(), F.col("x"))
    g = values.groupBy(*by).agg(F.max(F.when(F.col("draw") == 0, F.col("x"))).alias(point), F.array_sort(F.collect_list(drawn)).alias("_xs"))
    n, alpha = F.size("_xs"), (1.0 - ci) / 2.0
    if index_rule:  # whole places of the sorted draws, the lower one place further out
        low, high = F.greatest(F.lit(0), F.floor(F.lit(alpha) * n) - 1), F.least(n - 1, F.floor(F.lit(1.0 - alpha) * n))
        ends = [F.try_element_at("_xs", (e + 1).cast("int")) for e in (low, high)]
    else:
        def between(q: float) -> Column:
            h = F.lit(q) * (n - 1)
            a, b = (F.try_element_at("_xs", (e + 1).cast("int")) for e in (F.floor(h), F.ceil(h)))
            return a + (b - a) * (h - F.floor(h))
        ends = [between(alpha), between(1.0 - alpha)]
    enough = n >= 2
    out = g.select(*by, point, *[F.when(enough, e).alias(name) for e, name in zip(ends, ("ci_low", "ci_high"), strict=True)], n.cast("bigint").alias("n_boot"))
    return out.withColumn("excludes_zero", (F.col("ci_low") > 0) | (F.col("ci_high") < 0))


def _minus(values: DataFrame, a: str, b: str) -> DataFrame:
    """(draw, x): method a's value less method b's in the same draw."""
    of = lambda m: F.max(F.when(F.col("method") == m, F.col("rho")))
    return values.groupBy("draw").agg((of(a) - of(b)).alias("x"))


def delta_rho_of(sums: DataFrame, a: str, b: str, ci: float = 0.95) -> DataFrame:
    """bootstrap_delta_rho() from resampled_sums()."""
    return _told(_minus(pooled(sums), a, b), "delta_rho", (), ci, True)


def bootstrap_delta_rho(rows: DataFrame, a: str, b: str, target: str, cell: str, draws: int = 1000, seed: int = 0, ci: float = 0.95) -> DataFrame:
    """(delta_rho, ci_low, ci_high, n_boot, excludes_zero) of the pooled rank correlations' difference, cells being drawn.

    n_boot counts the draws in which it is defined; with fewer than two such draws or cells there is no interval.
    """
    out = delta_rho_of(resampled_sums(rows, [a, b], target, cell, draws, seed), a, b, ci)
    few = rows.agg((F.count_distinct(cell) < 2).alias("_few"))
    none = lambda c: F.when(~F.col("_few"), F.col(c)).alias(c)
    return out.crossJoin(F.broadcast(few)).select("delta_rho", none("ci_low"), none("ci_high"), F.when(F.col("_few"), 0).otherwise(F.col("n_boot")).alias("n_boot"), none("excludes_zero"))


def bootstrap_partial(rows: DataFrame, pred: str, target: str, base: str, cell: str, draws: int = 1000, seed: int = 0, bins: int = 20) -> DataFrame:
    """(partial, ci_low, ci_high, n_boot, excludes_zero) given the base; the bins' edges are those of all rows, in every draw."""
    sums = resampled_sums(ranking.base_bins(rows, base, bins), [pred], target, cell, draws, seed, "bin")
    return _told(partial(sums).select("draw", F.col("rho").alias("x")), "partial", (), 0.95, False)


def bootstrap_partial_diff(rows: DataFrame, a: str, b: str, target: str, base: str, cell: str, draws: int = 1000, seed: int = 0, bins: int = 20) -> DataFrame:
    """(diff, ci_low, ci_high, n_boot, excludes_zero): the difference of two methods' partial correlations, paired by draw."""
    sums = resampled_sums(ranking.base_bins(rows, base, bins), [a, b], target, cell, draws, seed, "bin")
    return _told(_minus(partial(sums), a, b), "diff", (), 0.95, False)


def specific_gain(gains: DataFrame, configured: str, draws: int = 2000, seed: int = 0) -> DataFrame:
    """One row: the configured chain's gain over cells beyond the mean random chain's, its interval, and its place among the random ones.

    gains: (chain, cell, gain), of the same cells for every chain. The interval draws cells and, where there are two or more, random
    chains, independently. null_*: each random chain in turn as if it were the configured one, against the mean of the
    others; these and z need three chains. Rows become a row for each chain and draw where they lie.
    """
    is_conf = F.col("chain") == configured
    g = kept(gains.select("chain", "cell", F.col("gain").cast("double").alias("gain")))
    cells = kept(g.groupBy("cell").agg(F.max(F.when(is_conf, F.col("gain"))).alias("c"), F.avg(F.when(~is_conf, F.col("gain"))).alias("r"), F.max(F.when(~is_conf, F.col("gain"))).alias("m")))
    over = cells.agg(
        F.count("*").alias("n_cells"), F.avg("c").alias("configured_gain_mean"), F.avg("r").alias("random_gain_mean"), F.avg(F.col("c") - F.col("r")).alias("specific_gain_mean"),
        F.avg((F.col("c") > F.col("r")).cast("int")).alias("frac_cells_positive"), F.avg((F.col("c") > F.col("m")).cast("int")).alias("frac_cells_above_all_random"),
    )
    median = ranking.quantiles(cells.select((F.col("c") - F.col("r")).alias("d")), "d", [0.5]).select(F.col("quantiles")[0].alias("specific_gain_median"))
    chains = g.where(~is_conf).groupBy("chain").agg(F.avg("gain").alias("g"))  # a row a chain
    every = Window.partitionBy()
    n = F.count("*").over(every)
    pseudo = F.col("g") - (F.sum("g").over(every) - F.col("g")) / F.nullif(n - 1, F.lit(0))
    placed = chains.withColumn("pseudo", pseudo).crossJoin(F.broadcast(over.select("configured_gain_mean", "specific_gain_mean")))
    three = F.count("*") >= 3
    sd = F.stddev_samp("g")
    among = placed.agg(
        F.count("*").alias("n_random_chains"), sd.alias("random_gain_sd_chains"), (sd / F.sqrt(F.count("*"))).alias("random_gain_se_chains"), (1 + F.count_if(F.col("g") >= F.col("configured_gain_mean"))).alias("rank_among_random"),
        F.when(three, (F.first("configured_gain_mean") - F.avg("g")) / F.nullif(sd, F.lit(0.0))).alias("z_vs_random"), F.when(three, F.stddev_samp("pseudo")).alias("null_sd"), F.when(three, F.max("pseudo")).alias("null_max"),
        F.when(three, (1 + F.count_if(F.col("pseudo") >= F.col("specific_gain_mean"))) / (1 + F.count("*"))).alias("null_empirical_p"),
    )
    each = g.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    weighed = each.withColumn("w", times_drawn(hashed(F.col("cell"), F.col("draw"), seed)))
    of_chain = weighed.groupBy("draw", "chain").agg(F.sum(F.col("w") * F.col("gain")).alias("s"), F.sum("w").alias("n"))
    several = g.where(~is_conf).agg((F.count_distinct("chain") > 1).alias("_several"))
    v = F.when(F.col("_several"), times_drawn(hashed(F.col("chain"), F.col("draw"), seed + 1))).otherwise(1)
    of_draw = of_chain.crossJoin(F.broadcast(several)).withColumn("v", F.when(is_conf, 0).otherwise(v)).groupBy("draw").agg(
        (F.max(F.when(is_conf, F.col("s"))) / F.nullif(F.max(F.when(is_conf, F.col("n"))), F.lit(0))).alias("c"), (F.sum(F.col("v") * F.col("s")) / F.nullif(F.sum(F.col("v") * F.col("n")), F.lit(0))).alias("r"),
    )
    interval = _told(of_draw.select("draw", (F.col("c") - F.col("r")).alias("x")), "_none", (), 0.95, False).select(F.col("ci_low").alias("specific_gain_ci_low"), F.col("ci_high").alias("specific_gain_ci_high"))
    out = over.crossJoin(F.broadcast(median)).crossJoin(F.broadcast(among)).crossJoin(F.broadcast(interval))  # one row each
    return out.withColumn("specific_fraction", F.col("specific_gain_mean") / F.nullif(F.col("configured_gain_mean"), F.lit(0.0)))


def contrasts(sums: DataFrame, rows: DataFrame, primary: str, others: Sequence[str], target: str, cell: str, least: int = 10, flips: int = 10_000) -> DataFrame:
    """(baseline, delta_rho, ci_low, ci_high, n_boot, excludes_zero, n, mean_diff, p_value): the primary method against each other one.

    sums: of resampled_sums() over all of them. The sign-flip test pairs the methods' correlations within each cell of `least` rows or more.
    """
    from ranklane.operators import statistics

    long = None
    for m in dict.fromkeys([primary, *others]):
        some = ranking.spearman_by(rows, m, target, cell, least).where("rho IS NOT NULL").select(F.lit(m).alias("method"), F.col(cell).alias("cell"), "rho")
        long = some if long is None else long.unionByName(some)
    wide = kept(long.groupBy("cell").agg(*[F.max(F.when(F.col("method") == m, F.col("rho"))).alias(f"_{i}") for i, m in enumerate(dict.fromkeys([primary, *others]))]))
    places = {m: i for i, m in enumerate(dict.fromkeys([primary, *others]))}
    out = None
    for m in others:
        diffs = wide.select("cell", (F.col(f"_{places[primary]}") - F.col(f"_{places[m]}")).alias("diff"))
        one = delta_rho_of(sums, primary, m).crossJoin(statistics.sign_flip_test(diffs, "cell", flips)).select(F.lit(m).alias("baseline"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def _rank_sums(binned: DataFrame, methods: Sequence[str], target: str) -> dict[str, DataFrame]:
    """By method, (bin, n, p, t, pp, tt, pt): sums over each bin of the centred ranks of its column and of the target, among rows that have all of them."""
    mean = binned.agg(((F.count("*") + 1) / 2.0).alias("_mean"))
    names = {c: f"_r{i}" for i, c in enumerate(dict.fromkeys([*methods, target]))}
    ranked = ranking.with_ranks(binned.select("bin", *names), names).crossJoin(F.broadcast(mean))  # one row
    r = lambda c: F.col(names[c]) - F.col("_mean")
    t = r(target)
    each = [F.sum(x).alias(f"{a}{i}") for i, m in enumerate(methods) for a, x in (("p", r(m)), ("pp", r(m) * r(m)), ("pt", r(m) * t))]
    sums = kept(ranked.groupBy("bin").agg(F.count("*").alias("n"), F.sum(t).alias("t"), F.sum(t * t).alias("tt"), *each))
    return {m: sums.select("bin", "n", F.col(f"p{i}").alias("p"), "t", F.col(f"pp{i}").alias("pp"), "tt", F.col(f"pt{i}").alias("pt")) for i, m in enumerate(methods)}


def method_scores(rows: DataFrame, methods: Sequence[str], target: str, cell: str, token: str, base: str, ks: Sequence[int] = (10, 50), least: int = 10, bins: int = 10) -> DataFrame:
    """One row a method: pooled, partial, within-cell and by-key rank correlations, hits and gains among the first k keys, and calibration.

    rows: a prediction column for each method beside target, cell, token and base. Keys are aggregated as mean predictions against
    the target that each has (the same in all cells, with a pseudobulk target).
    """
    rows = kept(rows.select(*dict.fromkeys([*methods, target, cell, token, base])))
    binned = ranking.base_bins(rows, base, 20)
    bare = rows.agg(*[F.count_if(F.col(m).isNull()).alias(m) for m in methods]).first()
    sums = {}
    # what lacks no prediction has the same ranks of the target for all such methods
    for group in filter(None, [[m for m in methods if not bare[m]], *[[m] for m in methods if bare[m]]]):
        sums |= _rank_sums(binned, group, target)
    # cells of about A_RANGE rows a task are gathered once, keys summed once for all methods
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // A_RANGE))
    every_cell = kept(ranking.spearmans_by(rows.select(*dict.fromkeys([cell, *methods, target])).repartition(parts, cell), {m: f"rho{i}" for i, m in enumerate(methods)}, target, cell, least))
    every_key = kept(rows.groupBy(token).agg(*[F.avg(m).alias(f"_pred{i}") for i, m in enumerate(methods)], F.max(target).alias("_obs")))
    out = None
    for i, m in enumerate(methods):
        whole = ranking.partial_of_sums(sums[m].agg(*[F.sum(c).alias(c) for c in _SUMS])).select(F.col("partial").alias("pooled_spearman")).crossJoin(sums[m].agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_samples")))
        part = ranking.partial_of_sums(sums[m]).withColumnRenamed("partial", "partial_spearman_given_base")
        cells = every_cell.select(cell, F.col(f"rho{i}").alias("rho")).where("rho IS NOT NULL")
        told = ranking.quantiles(cells, "rho", [0.25, 0.5, 0.75])
        within = cells.agg(F.count("*").alias("n_cells_scored")).join(told, F.lit(True), "left").select("n_cells_scored", *[F.col("quantiles")[i].alias(f"cellwise_spearman_{q}") for i, q in enumerate(("q25", "median", "q75"))])
        keys = every_key.select(token, F.col(f"_pred{i}").alias("_pred"), "_obs")
        by_key = ranking.with_ranks(keys, {"_pred": "_p", "_obs": "_t"}).agg(F.count("*").alias("n_genes_scored"), ranking.correlation("_p", "_t").alias("gene_aggregated_spearman"))
        calibration = ranking.calibration_bins(rows, m, target, bins, cell, token)
        monotone = calibration.select(ranking.average_rank("bin").alias("a"), ranking.average_rank("obs_mean").alias("b")).agg(F.when(F.count("*") >= 2, ranking.correlation("a", "b")).alias("calibration_monotonicity"))
        one = whole.crossJoin(part).crossJoin(within).crossJoin(by_key).crossJoin(monotone)  # one row each
        for k in ks:
            for up, name in ((True, "up"), (False, "down")):
                found = ranking.precision_ndcg(keys, "_pred", "_obs", token, k, up)
                one = one.crossJoin(found.select(F.col("precision").alias(f"precision_at_{k}_{name}"), F.col("ndcg").alias(f"ndcg_at_{k}_{name}")))
        one = one.select(F.lit(m).alias("method"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def base_control(rows: DataFrame, methods: Sequence[str], target: str, token: str, base: str, strata: int = 5) -> DataFrame:
    """(method, stratum, n, spearman, target_mean) within each stratum of the base, and for "base_only" and "base_rank", stratum null, over all rows.

    base_only is the mean target of the base's bin among keys of the other parity; strata are bins by quantiles of the base, from 0.
    """
    rows = kept(rows.select(*dict.fromkeys([*methods, target, token, base])))
    named = ranking.base_bins(rows, base, strata)
    out = None
    for m in methods:
        some = named.groupBy("bin").agg(F.count("*").alias("n"), F.avg(target).alias("target_mean")).join(stratum_spearman(named, m, target), "bin").select(F.lit(m).alias("method"), F.col("bin").alias("stratum"), "n", "spearman", "target_mean")
        out = some if out is None else out.unionByName(some)
    fitted = ranking.crossfit_base(rows, token, base, target)
    for name, frame, column in (("base_only", fitted, "pred"), ("base_rank", rows, base)):
        x = ranking.with_ranks(frame.select(F.col(column).alias("_x"), F.col(target).alias("_y")), {"_x": "_p", "_y": "_t"})
        out = out.unionByName(x.agg(F.lit(name).alias("method"), F.lit(None).cast("int").alias("stratum"), F.count("*").alias("n"), ranking.correlation("_p", "_t").alias("spearman"), F.avg("_y").alias("target_mean")))
    return out


def stratum_spearman(binned: DataFrame, pred: str, target: str) -> DataFrame:
    """(bin, spearman) of each bin's own ranks; null for fewer than three rows."""
    x = ranking.ranks_within(binned.select("bin", F.col(pred).cast("double").alias("_p"), F.col(target).cast("double").alias("_t")), {"_p": "_pr", "_t": "_tr"}, "bin")
    return x.groupBy("bin").agg(F.when(F.count("*") >= 3, ranking.correlation("_pr", "_tr")).alias("spearman"))


def direction_verdict(contrast: DataFrame, partial_interval: DataFrame, required: Sequence[str]) -> DataFrame:
    """(beats, does_not_beat, beats_required_baselines, adds_beyond_base_rank, passed): whether the primary method holds.

    It beats a baseline if its pooled correlation is higher and the difference's interval leaves zero out. It passes if it beats all
    required baselines that were compared (at least one) and its partial correlation's interval lies above zero.
    """
    beaten = (F.col("delta_rho") > 0) & F.coalesce(F.col("excludes_zero"), F.lit(False))
    names = lambda keep: F.array_sort(F.collect_list(F.when(keep, F.col("baseline"))))
    needed = F.col("baseline").isin(*required)
    told = contrast.agg(names(beaten).alias("beats"), names(~beaten).alias("does_not_beat"), ((F.count_if(needed) > 0) & (F.count_if(needed & ~beaten) == 0)).alias("beats_required_baselines"))
    own = partial_interval.select(F.coalesce(F.col("ci_low") > 0, F.lit(False)).alias("adds_beyond_base_rank"))
    return told.crossJoin(F.broadcast(own)).withColumn("passed", F.col("beats_required_baselines") & F.col("adds_beyond_base_rank"))
