"""Ranks, rank correlations, quantiles, top-k metrics, quotas and samples.

What is ordered over a whole table is dealt by ranges of the order, and sorted and counted range by range; what lies before a range
comes from the ranges' sums, a row for each. Values are ranked and quantiles found over their distinct values, whose
counts are partially aggregated. Windows without a partition run over such sums, or over tokens' or groups'
aggregates, never over rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ranklane.functions.aggregates import correlation
from ranklane.sources.shared import kept


def average_rank(value: Column | str, *by: str) -> Column:
    """1-based rank, equal values sharing their mean rank, within the partition."""
    value = F.col(value) if isinstance(value, str) else value
    return F.rank().over(Window.partitionBy(*by).orderBy(value)) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / 2.0


def running(rows: DataFrame, amount: Column, *order: str | Column) -> DataFrame:
    """rows with before: the sum of amount over the rows that precede in the order, which must tell all rows apart.

    Rows are dealt by ranges of the order and written; each range is summed, and its rows add to what earlier ranges hold.
    """
    dealt = rows.withColumn("_amount", amount).repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    dealt = kept(dealt)
    sums = dealt.groupBy("_range").agg(F.sum("_amount").alias("_sum"))
    earlier = F.coalesce(F.sum("_sum").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each range
    inside = F.coalesce(F.sum("_amount").over(Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = dealt.withColumn("_inside", inside).join(F.broadcast(sums.select("_range", earlier.alias("_earlier"))), "_range")
    return placed.withColumn("before", F.col("_earlier") + F.col("_inside")).drop("_range", "_amount", "_inside", "_earlier")


def numbered(rows: DataFrame, *order: str | Column) -> DataFrame:
    """rows with position, from 0, in an order that tells all rows apart."""
    return running(rows, F.lit(1).cast("bigint"), *order).withColumnRenamed("before", "position")


def average_ranks(values: DataFrame, column: str) -> DataFrame:
    """(value, n, rank): average rank of each distinct value over all rows, from a running sum of counts."""
    counts = values.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return running(counts, F.col("n"), "value").select("value", "n", (F.col("before") + (F.col("n") + 1) / 2.0).alias("rank"))


def with_ranks(rows: DataFrame, ranks: dict[str, str]) -> DataFrame:
    """rows with the average rank of each named column over all rows, under its given name; rows with a null there are left out."""
    for column, name in ranks.items():
        told = average_ranks(rows.where(F.col(column).isNotNull()), column).select(F.col("value").alias(column), F.col("rank").alias(name))
        rows = rows.join(told, column)
    return rows


def ranks_within(rows: DataFrame, ranks: dict[str, str], *by: str) -> DataFrame:
    """rows with the average rank of each named column within its group, under its given name; rows with a null there are left out.

    From running counts of the distinct values of all groups in order, so no group is gathered.
    """
    for column, name in ranks.items():
        counts = rows.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("_n"))
        placed = kept(running(counts, F.col("_n"), *by, column))
        first = placed.groupBy(*by).agg(F.min("before").alias("_first"))
        rows = rows.join(placed.join(first, list(by)).select(*by, column, (F.col("before") - F.col("_first") + (F.col("_n") + 1) / 2.0).alias(name)), [*by, column])
    return rows


def quantiles(rows: DataFrame, column: str, shares: Sequence[float], *by: str) -> DataFrame:
    """(by, quantiles): the exact quantiles of a column over each group, or over all rows, interpolated between neighbours.

    Found among the distinct values in order of group and value; no group's values are gathered. Nulls and NaN are left
    out; a group without a value has no row, and neither has an empty table.
    """
    v = rows.where(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double")))
    counts = v.groupBy(*by, F.col(column).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    placed = kept(running(counts, F.col("_n"), *by, "_v"))
    groups = placed.groupBy(*by).agg(F.min("before").alias("_first"), F.sum("_n").alias("_all"))
    joined = placed.join(groups, list(by)) if by else placed.crossJoin(F.broadcast(groups))  # one row
    at = F.col("before") - F.col("_first")
    place = [F.lit(float(q)) * (F.col("_all") - 1) for q in shares]
    ends = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(up).alias("up"), (F.ceil(h) if up else F.floor(h)).alias("k"), (h - F.floor(h)).alias("part")) for i, h in enumerate(place) for up in (False, True)])
    hit = joined.withColumn("_e", F.explode(F.filter(ends, lambda e: (e["k"] >= at) & (e["k"] < at + F.col("_n")))))
    of = lambda up: F.max(F.when(F.col("_e.up") == up, F.col("_v")))
    low, high = of(False), of(True)
    each = hit.groupBy(*by, F.col("_e.i").alias("_i")).agg((low + (high - low) * F.max("_e.part")).alias("_q"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_i", "_q"))), lambda x: x["_q"]).alias("quantiles")
    out = each.groupBy(*by).agg(listed)
    return out if by else out.where(F.size("quantiles") > 0)


def spearman_by(rows: DataFrame, a: str, b: str, by: str, least: int = 2) -> DataFrame:
    """(by, n, rho): correlation of average ranks within each group; null for fewer rows than `least` or constant values."""
    return spearmans_by(rows, {a: "rho"}, b, by, least)


def spearmans_by(rows: DataFrame, rhos: dict[str, str], b: str, by: str, least: int = 2) -> DataFrame:
    """spearman_by() of several columns against b, under their given names; groups are gathered once for all of them."""
    ranked = rows.select(by, *[average_rank(a, by).alias(f"_{name}") for a, name in rhos.items()], average_rank(b, by).alias("_b"))
    out = ranked.groupBy(by).agg(F.count("*").alias("n"), *[correlation(f"_{name}", "_b").alias(name) for name in rhos.values()])
    return out.select(by, "n", *[F.when(F.col("n") >= least, F.col(name)).alias(name) for name in rhos.values()])


def base_bins(rows: DataFrame, base: str, bins: int) -> DataFrame:
    """rows with bin: how many of the inner quantile edges are at most the base value. The edges are one small row."""
    edges = quantiles(rows, base, [i / bins for i in range(1, bins)]).withColumnRenamed("quantiles", "_edges")
    return rows.crossJoin(F.broadcast(edges)).withColumn("bin", F.size(F.filter("_edges", lambda e: e <= F.col(base)))).drop("_edges")


def demeaned(rows: DataFrame, column: str, name: str, *by: str) -> DataFrame:
    """rows with name: the column less its mean in the group, from means that are aggregated and joined, so no group's rows meet."""
    means = rows.groupBy(*by).agg(F.avg(column).alias("_mean"))
    return rows.join(means, list(by)).withColumn(name, F.col(column) - F.col("_mean")).drop("_mean")


def partial_of_sums(sums: DataFrame, *by: str) -> DataFrame:
    """(by, partial): the correlation of p and t without their bins' means, from n, p, t, pp, tt and pt summed over each bin."""
    part = lambda ab, a, b: F.sum(F.col(ab) - F.col(a) * F.col(b) / F.nullif(F.col("n"), F.lit(0)))
    size = F.sqrt(F.greatest(part("pp", "p", "p"), F.lit(0.0)) * F.greatest(part("tt", "t", "t"), F.lit(0.0)))
    return sums.groupBy(*by).agg((part("pt", "p", "t") / F.nullif(size, F.lit(0.0))).alias("partial"))


def partial_sums(weight: Column | None = None) -> list[Column]:
    """The aggregates that partial_of_sums() reads, of columns p and t."""
    w = F.lit(1) if weight is None else weight
    p, t = F.col("p"), F.col("t")
    return [F.sum(w).alias("n"), *[F.sum(w * x).alias(a) for a, x in (("p", p), ("t", t), ("pp", p * p), ("tt", t * t), ("pt", p * t))]]


def partial_spearman(rows: DataFrame, pred: str, target: str, base: str, bins: int = 20) -> DataFrame:
    """(partial): correlation of the ranks of pred and target, both without their mean in a bin of the base rank.

    Ranks are centred on their overall mean before they are squared, which leaves the result as it is and keeps its digits.
    """
    binned = base_bins(rows.select(pred, target, base), base, bins)
    mean = rows.agg(((F.count("*") + 1) / 2.0).alias("_mean"))
    ranked = with_ranks(binned, {pred: "_p", target: "_t"} if pred != target else {pred: "_p"}).crossJoin(F.broadcast(mean))
    centred = ranked.select("bin", (F.col("_p") - F.col("_mean")).alias("p"), (F.col("_t" if pred != target else "_p") - F.col("_mean")).alias("t"))
    return partial_of_sums(centred.groupBy("bin").agg(*partial_sums()))


def crossfit_base(rows: DataFrame, token: str, base: str, target: str, bins: int = 20) -> DataFrame:
    """rows with pred: the mean target of the same bin among tokens of the other parity; 0 where there is none."""
    binned = base_bins(rows, base, bins).withColumn("fold", F.pmod(F.col(token), F.lit(2)))
    means = binned.groupBy("bin", (1 - F.col("fold")).alias("fold")).agg(F.avg(target).alias("_mean"))
    return binned.join(means, ["bin", "fold"], "left").withColumn("pred", F.coalesce("_mean", F.lit(0.0))).drop("_mean")


def calibration_bins(rows: DataFrame, pred: str, obs: str, bins: int, *ties: str) -> DataFrame:
    """(bin, n, pred_mean, obs_mean): bins of like size in order of the prediction, then of the ties; bin b begins at floor(b n / bins).

    Rows are summed by value of the prediction, which places all that do not lie across a bin's end; rows of the values that do (fewer
    than bins) are summed by the first tie as well, and so on. So no row is put in order by itself before the last tie.
    """
    rows = rows.select(F.col(pred).alias("_k0"), F.col(obs).alias("_obs"), *[F.col(t).alias(f"_k{i}") for i, t in enumerate(ties, 1)])
    many = rows.count()
    bin_of = lambda at: F.floor(((at + 1) * bins - 1) / F.lit(many)).cast("long")
    left, starts, out = rows, None, None
    for depth in range(len(ties) + 1):
        keys = [f"_k{i}" for i in range(depth + 1)]
        sums = left.groupBy(*keys).agg(F.count("*").alias("n"), F.count("_obs").alias("_m"), F.sum("_obs").alias("_obs"))
        placed = kept(running(sums, F.col("n"), *keys))
        if starts is not None:  # what lies before a group among all rows, and what lies before it in this table
            first = placed.groupBy(*keys[:-1]).agg(F.min("before").alias("_first"))
            same = lambda x: [F.col(f"p.{k}").eqNullSafe(F.col(f"{x}.{k}")) for k in keys[:-1]]
            placed = placed.alias("p").join(F.broadcast(first).alias("f"), same("f")).join(F.broadcast(starts).alias("s"), same("s"))
            placed = placed.select("p.*", (F.col("p.before") - F.col("f._first") + F.col("s._start")).alias("_at")).drop("before").withColumnRenamed("_at", "before")
        placed = placed.withColumn("bin", bin_of(F.col("before")))
        whole = F.col("bin") == bin_of(F.col("before") + F.col("n") - 1)
        some = placed if depth == len(ties) else placed.where(whole)
        some = some.select("bin", "n", F.when(F.col("_k0").isNotNull(), F.col("n")).otherwise(0).alias("_p"), (F.col("_k0") * F.col("n")).alias("_pred"), "_m", "_obs")
        out = some if out is None else out.unionByName(some)
        if depth < len(ties):
            starts = kept(placed.where(~whole).select(*keys, F.col("before").alias("_start")))  # fewer rows than bins
            left = left.alias("r").join(F.broadcast(starts).alias("s"), [F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys], "left_semi")
    mean = lambda total, n: F.sum(total) / F.nullif(F.sum(n), F.lit(0))
    return out.groupBy("bin").agg(F.sum("n").alias("n"), mean("_pred", "_p").alias("pred_mean"), mean("_obs", "_m").alias("obs_mean"))


def precision_ndcg(rows: DataFrame, pred: str, obs: str, token: str, k: int, up: bool) -> DataFrame:
    """(precision, ndcg) of the k most negative (up) or most positive predictions against the observations; null for fewer than k rows.

    Each of the three orders is cut to its k first rows by every task before they meet.
    """
    sign = 1 if up else -1
    x = rows.select(F.col(token).alias("token"), (sign * F.col(pred)).alias("pred"), (sign * F.col(obs)).alias("obs"), F.greatest(F.lit(0.0), -sign * F.col(obs)).alias("rel"))

    def first(*order: str | Column) -> DataFrame:
        top = x.orderBy(*order).limit(k)
        return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # of k rows

    gain = lambda top: top.agg(F.sum(F.col("rel") / F.log2(F.col("rank") + 1)).alias("gain"))
    by_pred, by_obs = first("pred", "token"), first("obs", "token")
    hits = by_pred.join(by_obs.select("token"), "token", "left_semi").agg(F.count("*").alias("hits"))
    told = x.agg(F.count("*").alias("n")).crossJoin(hits).crossJoin(gain(by_pred)).crossJoin(gain(first(F.desc("rel"), "token")).withColumnRenamed("gain", "ideal"))
    enough = F.col("n") >= k
    return told.select(F.when(enough, F.col("hits") / float(k)).alias("precision"), F.when(enough & (F.col("ideal") > 0), F.col("gain") / F.col("ideal")).alias("ndcg"))


def bh_adjust(rows: DataFrame, p: str, *by: str, tie: str) -> DataFrame:
    """rows with fdr: Benjamini-Hochberg step-up over each group's p-values."""
    w = Window.partitionBy(*by)
    n, rn = F.count(p).over(w), F.row_number().over(w.orderBy(p, tie))
    stepped = rows.withColumn("_rn", rn).withColumn("_m", F.col(p) * n / F.col("_rn"))
    least = F.min("_m").over(w.orderBy(F.desc("_rn")).rowsBetween(Window.unboundedPreceding, 0))
    return stepped.withColumn("fdr", F.least(F.lit(1.0), least)).drop("_rn", "_m")


def top_terms(terms: DataFrame, k: int, fdr: float) -> DataFrame:
    """The first k terms by fdr; terms of the same keys and fdr are one row, and a block of equal fdr is not cut in two.

    terms: (term, fdr, n_overlap, genes), genes being the sorted keys as text.
    """
    seen = terms.where("fdr IS NOT NULL AND n_overlap > 0")
    merged = seen.groupBy("genes", "fdr").agg(F.min("term").alias("term"), (F.count("*") - 1).alias("n_merged"), F.first("n_overlap").alias("n_overlap"))
    n = F.count("*").over(Window.partitionBy())
    order = Window.orderBy("fdr")
    # a block of equal fdr that ends behind row k is cut as a whole
    last = F.rank().over(order) + F.count("*").over(Window.partitionBy("fdr")) - 1
    return merged.withColumns({"_last": last, "_n": n}).where((F.col("_last") <= k) | (F.col("_n") <= k)).select("term", "fdr", "n_overlap", "n_merged", (F.col("fdr") < fdr).alias("sig"))


def capped_per_state(cells: DataFrame, states: list[str], most: int) -> DataFrame:
    """The first `most` cells of each listed state, in the cells' own order."""
    rn = F.row_number().over(Window.partitionBy("state").orderBy("cell"))
    return cells.where(F.col("state").isin(*states)).withColumn("_rn", rn).where(F.col("_rn") <= most).drop("_rn")


def stride_shard(cells: DataFrame, shards: int) -> DataFrame:
    """cells with shard: the row number in order of falling length, modulo the number of shards."""
    return numbered(cells, F.desc("length"), "cell").withColumn("shard", F.pmod(F.col("position"), F.lit(shards)).cast("int")).drop("position")


def hamilton(groups: DataFrame, total: int) -> DataFrame:
    """(grp, size, quota): largest-remainder shares of total, never above a group's size.

    One row for each group. Equal remainders go to the group with more left, then by name.
    """
    everything = Window.partitionBy()
    n = F.sum("size").over(everything)
    raw = F.col("size") * (F.least(F.lit(total), F.col("_n")) / F.col("_n"))
    g = groups.withColumn("_n", n).withColumn("_raw", raw).withColumn("_low", F.least(F.floor("_raw"), F.col("size")))
    left = F.least(F.lit(total), F.col("_n")) - F.sum("_low").over(everything)
    rn = F.row_number().over(Window.orderBy((F.col("_raw") - F.floor("_raw")).desc(), (F.col("size") - F.col("_low")).desc(), "grp"))
    return g.withColumns({"_left": left, "_rn": rn}).select("grp", "size", (F.col("_low") + (F.col("_rn") <= F.col("_left")).cast("long")).alias("quota"))


def rescued(quotas: DataFrame, total: int) -> DataFrame:
    """Quotas after each empty group got one from the largest, where the total is enough for all groups.

    The n-th empty group takes from the donor whose n-th spare one it is, donors in order of falling quota; one
    row for each group.
    """
    everything = Window.partitionBy()
    q = quotas.withColumn("_groups", F.count("*").over(everything)).withColumn("_need", F.sum(((F.col("quota") == 0) & (F.col("size") > 0)).cast("long")).over(everything))
    order = Window.orderBy(F.desc("quota"), "grp")
    spare = F.greatest(F.col("quota") - 1, F.lit(0))
    before = F.coalesce(F.sum(spare).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total_spare = F.sum(spare).over(everything)
    q = q.withColumns({"_before": before, "_spare": spare, "_total": total_spare})
    zero_rank = F.sum(((F.col("quota") == 0) & (F.col("size") > 0)).cast("long")).over(Window.orderBy("grp").rowsBetween(Window.unboundedPreceding, 0))
    taken = F.greatest(F.lit(0), F.least(F.col("_spare"), F.col("_need") - F.col("_before")))
    given = ((F.col("quota") == 0) & (F.col("size") > 0) & (zero_rank <= F.col("_total"))).cast("long")
    return q.select("grp", "size", F.when(F.col("_groups") > total, F.col("quota")).otherwise(F.col("quota") - taken + given).cast("long").alias("quota"))


def stratified_sample(rows: DataFrame, quotas: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """rows (with grp), each group's quota drawn in the order of an md5 of seed and key, so reruns and partitions do not matter."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))
    drawn = F.row_number().over(Window.partitionBy("grp").orderBy(h, key))
    return rows.withColumn("_rn", drawn).join(quotas.select("grp", "quota"), "grp").where(F.col("_rn") <= F.col("quota")).drop("_rn", "quota")


def split_tokens(token: Column, fraction: float, seed: int) -> Column:
    """Whether a token belongs to the held-out part: by a multiplicative hash modulo a prime."""
    h = F.pmod(token.cast("decimal(38,0)") * F.lit(2_654_435_761) + F.lit(seed * 97_531), F.lit(1_000_003))
    return h.cast("double") / 1_000_003 < min(max(fraction, 0.0), 1.0)


def spread_selection(rows: DataFrame, n: int, longest: bool) -> DataFrame:
    """n rows in order of (length, idx): the longest, or evenly spread from the first to the last."""
    if longest:
        return rows.orderBy(F.desc("length"), F.desc("idx")).limit(n)
    many = rows.agg(F.count("*").alias("_n"))
    r = numbered(rows, "length", "idx").crossJoin(F.broadcast(many))
    steps = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.rint(j * (F.col("_n") - 1) / F.lit(max(n - 1, 1))).cast("int"))
    return r.where(F.array_contains(steps, F.col("position").cast("int"))).drop("position", "_n")
