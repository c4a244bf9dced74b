"""Queries of ranks, tests, over-representation, contrasts and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ranklane.operators import contracts, ranking
from ranklane.operators import statistics as stats
from ranklane.plans import inputs
from ranklane.plans.catalogue import query
from ranklane.plans.inputs import GOAL, SHIFTS, START, STATES

# ranks

_AVG = "rank() OVER (PARTITION BY {p} ORDER BY {v}) + (count(*) OVER (PARTITION BY {p}, {v}) - 1) / 2.0"


@query("SELECT l_suppkey AS cell, l_linenumber AS line, l_orderkey AS k, " + _AVG.format(p="l_suppkey", v="l_quantity") + " AS avg_rank FROM lineitem")
def avg_rank_ties(spark, sf_dir):
    return inputs.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("cell"), F.col("l_linenumber").alias("line"), F.col("l_orderkey").alias("k"), ranking.average_rank("l_quantity", "l_suppkey").alias("avg_rank"))


@query("WITH c AS (SELECT l_quantity AS value, count(*) AS n FROM lineitem GROUP BY 1) SELECT value, n, coalesce(sum(n) OVER (ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / 2.0 AS rank FROM c")
def avg_rank_distinct(spark, sf_dir):
    return ranking.average_ranks(inputs.table(spark, sf_dir, "lineitem"), "l_quantity")


@query("WITH r AS (SELECT l_suppkey AS cell, " + _AVG.format(p="l_suppkey", v="l_quantity") + " AS a, " + _AVG.format(p="l_suppkey", v="l_extendedprice") + " AS b FROM lineitem) SELECT cell, count(*) AS n, round(corr(a, b), 6) AS rho FROM r GROUP BY cell")
def spearman_by_cell(spark, sf_dir):
    lines = inputs.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("cell"), "l_quantity", "l_extendedprice").repartition(inputs.tasks(spark, sf_dir), "cell")
    out = ranking.spearman_by(lines, "l_quantity", "l_extendedprice", "cell")
    return out.withColumn("rho", F.round("rho", 6))


_PARTS = "p AS (SELECT p_partkey AS token, p_retailprice AS base, p_size * 1.0 AS pred, (p_partkey * 7919 % 1000) / 10.0 AS target FROM part)"


def _parts(spark, sf_dir):
    return inputs.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("token"), F.col("p_retailprice").alias("base"), (F.col("p_size") * 1.0).cast("double").alias("pred"), (F.col("p_partkey") * 7919 % 1000 / 10.0).cast("double").alias("target"))


def _edges(bins: int) -> str:
    return f"{_PARTS}, e AS (SELECT quantile_cont(base, {[i / bins for i in range(1, bins)]}) AS edges FROM p), binned AS (SELECT p.*, len(list_filter(edges, lambda x: x <= base)) AS bin FROM p CROSS JOIN e)"


@query(f"WITH {_edges(20)} SELECT bin, token, round(target - avg(target) OVER (PARTITION BY bin), 6) AS demeaned FROM binned")
def base_bins_demean(spark, sf_dir):
    binned = ranking.base_bins(_parts(spark, sf_dir), "base", 20)
    return ranking.demeaned(binned, "target", "demeaned", "bin").select("bin", "token", F.round("demeaned", 6).alias("demeaned"))


@query(f"WITH {_edges(20)}, r AS (SELECT bin, {_AVG.format(p='1', v='pred')} AS p, {_AVG.format(p='1', v='target')} AS t FROM binned), d AS (SELECT p - avg(p) OVER (PARTITION BY bin) AS p, t - avg(t) OVER (PARTITION BY bin) AS t FROM r) SELECT round(corr(p, t), 6) AS partial FROM d")
def partial_spearman(spark, sf_dir):
    return ranking.partial_spearman(_parts(spark, sf_dir), "pred", "target", "base").select(F.round("partial", 6).alias("partial"))


@query(f"WITH {_edges(20)}, m AS (SELECT bin, 1 - token % 2 AS fold, avg(target) AS mean FROM binned GROUP BY 1, 2) SELECT token, round(coalesce(mean, 0.0), 6) AS pred FROM binned b LEFT JOIN m ON b.bin = m.bin AND b.token % 2 = m.fold")
def crossfit_base_only(spark, sf_dir):
    return ranking.crossfit_base(_parts(spark, sf_dir).drop("pred"), "token", "base", "target").select("token", F.round("pred", 6).alias("pred"))


@query(f"WITH {_PARTS}, o AS (SELECT *, row_number() OVER (ORDER BY pred, token) - 1 AS rn, count(*) OVER () AS n FROM p), b AS (SELECT *, ((rn + 1) * 10 - 1) // n AS bin FROM o) SELECT bin, count(*) AS n, round(avg(pred), 6) AS pred_mean, round(avg(target), 6) AS obs_mean FROM b GROUP BY bin")
def calibration_bins(spark, sf_dir):
    out = ranking.calibration_bins(_parts(spark, sf_dir), "pred", "target", 10, "token")
    return out.select("bin", "n", F.round("pred_mean", 6).alias("pred_mean"), F.round("obs_mean", 6).alias("obs_mean"))


@query(f"""WITH {_PARTS}, q AS (SELECT token, pred - 25 AS pred, target - 50 AS obs FROM p), r AS (SELECT row_number() OVER (ORDER BY pred, token) AS rp, row_number() OVER (ORDER BY obs, token) AS ro, greatest(0.0, -obs) AS rel, row_number() OVER (ORDER BY greatest(0.0, -obs) DESC, token) AS ri FROM q)
SELECT count(*) FILTER (WHERE rp <= 25 AND ro <= 25) / 25.0 AS precision, round(sum(rel / log2(rp + 1)) FILTER (WHERE rp <= 25) / sum(rel / log2(ri + 1)) FILTER (WHERE ri <= 25), 6) AS ndcg FROM r""")
def precision_ndcg_at_k(spark, sf_dir):
    rows = _parts(spark, sf_dir).select("token", (F.col("pred") - 25).alias("pred"), (F.col("target") - 50).alias("obs"))
    return ranking.precision_ndcg(rows, "pred", "obs", "token", 25, True).withColumn("ndcg", F.round("ndcg", 6))


# shifts

_RANKSUM = f"""{SHIFTS}, pool AS (SELECT shift, count(*) AS n FROM shifts GROUP BY shift), pr AS (SELECT shift, coalesce(sum(n) OVER (ORDER BY shift ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / 2.0 AS r FROM pool),
own AS (SELECT gene, shift, count(*) AS c FROM shifts GROUP BY 1, 2), rk AS (SELECT gene, shift, c, r + coalesce(sum(c) OVER (PARTITION BY gene ORDER BY shift ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + c / 2.0 AS r FROM own JOIN pr USING (shift)),
g AS (SELECT gene, sum(c * r) AS wg, sum(c) AS ng, sum(c * shift) / sum(c) AS mean_shift, (SELECT count(*) FROM shifts) AS np FROM rk GROUP BY gene),
z AS (SELECT gene, mean_shift, ng, ((np + ng) * (np + ng + 1) / 2.0 - wg - np * (np + ng + 1) / 2.0) / sqrt(np * ng * (np + ng + 1) / 12.0) AS z FROM g)"""


@query(f"WITH {_RANKSUM} SELECT gene, round(mean_shift, 6) AS mean_shift, ng::BIGINT AS n, round(z, 5) AS z FROM z")
def goal_state_stats(spark, sf_dir):
    return stats.shifts_vs_pool(inputs.shifts(spark, sf_dir).select("gene", "shift")).select("gene", F.round("mean_shift", 6).alias("mean_shift"), "n", F.round("z", 5).alias("z"))


@query()
def goal_state_significance(spark, sf_dir):
    """With p, fdr and sig, which need the error function that SQL lacks."""
    return stats.with_significance(stats.shifts_vs_pool(inputs.shifts(spark, sf_dir).select("gene", "shift")))


_VS = f"""{SHIFTS}, r AS (SELECT gene, shift, cell % 2 AS t, {_AVG.format(p='gene', v='shift')} AS r FROM shifts),
g AS (SELECT gene, avg(shift) FILTER (WHERE t = 1) AS test_mean, avg(shift) FILTER (WHERE t = 0) AS null_mean, count(*) FILTER (WHERE t = 1) AS n_test, count(*) FILTER (WHERE t = 0) AS n_null, sum(r) FILTER (WHERE t = 1) AS w FROM r GROUP BY gene)"""


@query(f"WITH {_VS} SELECT gene, round(test_mean, 6) AS test_mean, round(null_mean, 6) AS null_mean, round(test_mean - null_mean, 6) AS difference, n_test, n_null, round((w - n_test * (n_test + n_null + 1) / 2.0) / sqrt(n_test * n_null * (n_test + n_null + 1) / 12.0), 5) AS z FROM g")
def vs_null_stats(spark, sf_dir):
    s = inputs.shifts(spark, sf_dir)
    out = stats.rank_sums(s.where("cell % 2 = 1"), s.where("cell % 2 = 0"))
    return out.select("gene", *[F.round(c, 6).alias(c) for c in ("test_mean", "null_mean", "difference")], "n_test", "n_null", F.round("z", 5).alias("z"))


@query(f"WITH {SHIFTS} SELECT gene, count(*) AS n FROM shifts GROUP BY gene")
def detection_counts(spark, sf_dir):
    return inputs.shifts(spark, sf_dir).groupBy("gene").agg(F.count("*").alias("n"))


@query(f"WITH {SHIFTS} SELECT cell, shift FROM shifts WHERE gene = 11")
def aggregate_group(spark, sf_dir):
    return inputs.shifts(spark, sf_dir).where("gene = 11").select("cell", "shift")


_BH = "p AS (SELECT p_partkey AS gene, p_type AS grp, (p_partkey * 7919 % 100003) / 100003.0 * (p_size / 50.0) AS p FROM part), s AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY p, gene) AS rn, count(*) OVER (PARTITION BY grp) AS n FROM p)"


@query(f"WITH {_BH} SELECT grp, gene, round(least(1.0, min(p * n / rn) OVER (PARTITION BY grp ORDER BY rn DESC ROWS UNBOUNDED PRECEDING)), 6) AS fdr FROM s")
def bh_adjust(spark, sf_dir):
    p = F.col("p_partkey") * 7919 % 100003 / 100003.0 * (F.col("p_size") / 50.0)
    rows = inputs.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("gene"), F.col("p_type").alias("grp"), p.cast("double").alias("p"))
    return ranking.bh_adjust(rows, "p", "grp", tie="gene").select("grp", "gene", F.round("fdr", 6).alias("fdr"))


@query(f"WITH {_RANKSUM} SELECT gene, round(mean_shift, 6) AS mean_shift FROM z WHERE ng >= 5 QUALIFY row_number() OVER (ORDER BY mean_shift DESC, gene) <= 10")
def top_shifters(spark, sf_dir):
    """The ten genes of highest mean shift (a report: the limit is the feature)."""
    s = stats.shifts_vs_pool(inputs.shifts(spark, sf_dir).select("gene", "shift")).where("n >= 5")
    return s.orderBy(F.desc("mean_shift"), "gene").limit(10).select("gene", F.round("mean_shift", 6).alias("mean_shift"))


@query(f"WITH {_RANKSUM} SELECT gene, round(mean_shift, 6) AS mean_shift, ng::BIGINT AS n FROM z WHERE abs(z) > 1.5 AND ng >= 20 QUALIFY row_number() OVER (ORDER BY mean_shift DESC, gene) = 1")
def top1_significant(spark, sf_dir):
    s = stats.shifts_vs_pool(inputs.shifts(spark, sf_dir).select("gene", "shift")).withColumn("sig", (F.abs("z") > 1.5).cast("int"))
    return contracts.top_significant(s).select("gene", F.round("mean_shift", 6).alias("mean_shift"), "n")


# sets: brands are terms, parts symbols

_SETS = "sets AS (SELECT DISTINCT p_brand AS term, upper(p_partkey || '-' || p_brand) AS symbol FROM part), bg AS (SELECT DISTINCT upper(l_partkey || '-' || p_brand) AS symbol FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 10), q AS (SELECT DISTINCT upper(l_partkey || '-' || p_brand) AS symbol FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity >= 49)"
_ORA = f"""{_SETS}, qb AS (SELECT * FROM q WHERE symbol IN (SELECT symbol FROM bg)), nn AS (SELECT (SELECT count(*) FROM bg) AS n_background, (SELECT count(*) FROM qb) AS n_query),
t AS (SELECT term, count(*) FILTER (WHERE symbol IN (SELECT symbol FROM qb)) AS k, count(*) AS term_size, string_agg(symbol, ';' ORDER BY symbol) FILTER (WHERE symbol IN (SELECT symbol FROM qb)) AS genes FROM sets WHERE symbol IN (SELECT symbol FROM bg) GROUP BY term),
u AS (SELECT * FROM t CROSS JOIN nn WHERE k > 0), x AS (SELECT *, unnest(range(k, least(term_size, n_query) + 1)) AS x FROM u),
l AS (SELECT term, sum(exp(lgamma(term_size + 1) - lgamma(x + 1) - lgamma(term_size - x + 1) + lgamma(n_background - term_size + 1) - lgamma(n_query - x + 1) - lgamma(n_background - term_size - n_query + x + 1) - lgamma(n_background + 1) + lgamma(n_query + 1) + lgamma(n_background - n_query + 1))) AS p FROM x WHERE n_background - term_size - n_query + x >= 0 GROUP BY term),
ora AS (SELECT u.term, k, term_size, n_query, n_background, genes, least(1.0, p) AS p, CASE WHEN (n_query - k) * (term_size - k) = 0 THEN 1e308 ELSE k * (n_background - n_query - (term_size - k)) / ((n_query - k) * (term_size - k)) END AS odds FROM u JOIN l USING (term)),
adj AS (SELECT *, row_number() OVER (ORDER BY p, term) AS rn, count(*) OVER () AS n FROM ora), fd AS (SELECT *, least(1.0, min(p * n / rn) OVER (ORDER BY rn DESC ROWS UNBOUNDED PRECEDING)) AS fdr FROM adj)"""


def _ora(spark, sf_dir):
    part = inputs.table(spark, sf_dir, "part")
    symbol = F.concat_ws("-", F.col("p_partkey").cast("string"), "p_brand")
    lines = inputs.table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    sets = part.select(F.col("p_brand").alias("term"), symbol.alias("symbol"))
    bg = lines.where("l_quantity > 10").select(symbol.alias("symbol")).distinct()
    out = stats.over_representation(lines.where("l_quantity >= 49").select(symbol.alias("symbol")), bg, sets)
    return ranking.bh_adjust(out, "p", tie="term")


@query(f"WITH {_ORA} SELECT term, k, term_size, n_query, n_background, round(p, 6) AS p, round(odds, 5) AS odds, round(fdr, 6) AS fdr, genes FROM fd")
def ora_hypergeom(spark, sf_dir):
    out = _ora(spark, sf_dir).withColumn("odds", F.when(F.col("odds") == float("inf"), 1e308).otherwise(F.col("odds")))
    return out.select("term", "k", "term_size", "n_query", "n_background", F.round("p", 6).alias("p"), F.round("odds", 5).alias("odds"), F.round("fdr", 6).alias("fdr"), "genes")


@query("""WITH t AS (SELECT p_brand AS term, round(p_size / 50.0, 1) AS fdr, p_size % 3 AS n_overlap, p_type AS genes FROM part), m AS (SELECT genes, fdr, min(term) AS term, count(*) - 1 AS n_merged, any_value(n_overlap) AS o FROM t WHERE n_overlap = 1 GROUP BY genes, fdr),
r AS (SELECT *, rank() OVER (ORDER BY fdr) + count(*) OVER (PARTITION BY fdr) - 1 AS last, count(*) OVER () AS n FROM m) SELECT term, fdr::DOUBLE AS fdr, o AS n_overlap, n_merged, fdr < 0.3 AS sig FROM r WHERE last <= 6 OR n <= 6""")
def top_terms_tie_aware(spark, sf_dir):
    """Rows of equal keys and fdr merged, no block of equal fdr cut."""
    t = inputs.table(spark, sf_dir, "part").select(F.col("p_brand").alias("term"), F.round(F.col("p_size") / 50.0, 1).cast("double").alias("fdr"), (F.col("p_size") % 3).alias("n_overlap"), F.col("p_type").alias("genes"))
    return ranking.top_terms(t.where("n_overlap = 1"), 6, 0.3)


@query(f"WITH {_SETS}, v AS (SELECT upper(p_partkey || '-' || p_brand) AS symbol, p_retailprice AS v FROM part) SELECT term, count(*) AS n, round(avg(v), 6) AS mean FROM sets JOIN v USING (symbol) GROUP BY term HAVING count(*) >= 10")
def set_means(spark, sf_dir):
    symbol = F.concat_ws("-", F.col("p_partkey").cast("string"), "p_brand")
    part = inputs.table(spark, sf_dir, "part")
    out = stats.set_means(part.select(symbol.alias("symbol"), F.col("p_retailprice").alias("v")), part.select(F.col("p_brand").alias("term"), symbol.alias("symbol")))
    return out.withColumn("mean", F.round("mean", 6))


@query(f"""WITH {_ORA}, ref AS (SELECT term, CASE WHEN length(term) % 2 = 0 THEN least(1.0, p * 2) ELSE p END AS pb, fdr < 0.6 AS sb FROM fd WHERE k % 3 <> 0), j AS (SELECT -log10(greatest(coalesce(p, 1.0), 1e-300)) AS x, -log10(greatest(coalesce(pb, 1.0), 1e-300)) AS y, coalesce(fdr < 0.6, false) AS sa, coalesce(sb, false) AS sb FROM fd FULL JOIN ref USING (term))
SELECT round(count(*) FILTER (WHERE sa AND sb) / nullif(count(*) FILTER (WHERE sa OR sb), 0), 6) AS sig_jaccard, count(*) FILTER (WHERE sa AND sb) AS sig_shared, round(sum(x * y) / sqrt(sum(x * x) * sum(y * y)), 6) AS cosine FROM j""")
def ora_profile(spark, sf_dir):
    out = _ora(spark, sf_dir)
    ref = out.where("k % 3 <> 0").withColumn("p", F.when(F.length("term") % 2 == 0, F.least(F.lit(1.0), F.col("p") * 2)).otherwise(F.col("p")))
    m = stats.profile_metrics(out, ref, 0.6)
    return m.select(F.round("sig_jaccard", 6).alias("sig_jaccard"), "sig_shared", F.round("cosine", 6).alias("cosine"))


# closeness to the goal

_CLOSE = f"{STATES}, x AS (SELECT token, coalesce(r1.rank, 1.0) - coalesce(r0.rank, 1.0) AS g, coalesce(o.rank, 1.0) - coalesce(r0.rank, 1.0) AS d FROM r0 FULL JOIN r1 USING (token) FULL JOIN (SELECT token, rank FROM pb WHERE state = 'EUROPE') o USING (token))"


def _close(spark, sf_dir):
    states = inputs.ranks_of(spark, sf_dir, START, GOAL, "EUROPE")
    r0, r1, r2 = (r.select("token", F.col("rank").alias(n)) for r, n in zip(states, ("s", "g", "o"), strict=True))
    j = r0.join(r1, "token", "full").join(r2, "token", "full")
    one = F.lit(1.0)
    return j.select("token", (F.coalesce("g", one) - F.coalesce("s", one)).alias("g"), (F.coalesce("o", one) - F.coalesce("s", one)).alias("d"))


@query(f"""WITH {_CLOSE}, c AS (SELECT quantile_cont(abs(g), 0.8) AS cut FROM x), r AS (SELECT round(d, 9) AS d9, round(g, 9) AS g9, * FROM x CROSS JOIN c), k AS (SELECT *, {_AVG.format(p='1', v='d9')} AS rd, {_AVG.format(p='1', v='g9')} AS rg FROM r)
SELECT round(sum(d * g) / sum(g * g), 5) AS progress, round(sum(d * g) / sqrt(sum(d * d) * sum(g * g)), 5) AS cosine, round(corr(rd, rg), 5) AS spearman, round(1 - sqrt(sum((g - d) * (g - d))) / sqrt(sum(g * g)), 5) AS distance_closed FROM k""")
def closeness_vector_metrics(spark, sf_dir):
    rows = _close(spark, sf_dir).select("token", F.round("d", 9).alias("d"), F.round("g", 9).alias("g"))
    return stats.closeness(rows, "d", "g").select(*[F.round(c, 5).alias(c) for c in ("progress", "cosine", "spearman", "distance_closed")])


@query(f"""WITH {_CLOSE}, y AS (SELECT token, round(d, 9) AS d, round(g, 9) AS g FROM x), o AS (SELECT d, row_number() OVER (ORDER BY g, token) AS rn, count(*) OVER () AS n, greatest(1, ceil(count(*) OVER () * 0.1)) AS k FROM y),
e AS (SELECT *, {_AVG.format(p='1', v='d')} AS r FROM o WHERE rn <= k OR rn > n - k) SELECT round((sum(r) FILTER (WHERE rn > n - k) - any_value(k) * (any_value(k) + 1) / 2.0) / (any_value(k) * any_value(k)), 6) AS auc FROM e""")
def auc_goal_gain(spark, sf_dir):
    rows = _close(spark, sf_dir).select("token", F.round("d", 9).alias("d"), F.round("g", 9).alias("g"))
    return stats.auc_goal_gain(rows, "d", "g", "token").select(F.round("auc", 6).alias("auc"))


@query("WITH v AS (SELECT c_mktsegment AS s, avg(c_acctbal) AS v FROM customer GROUP BY 1), q AS (SELECT v FROM v WHERE s = 'BUILDING') SELECT count(*) AS n, round(avg(v.v), 4) AS placebo_mean, round(stddev_samp(v.v), 4) AS placebo_sd, round((any_value(q.v) - avg(v.v)) / stddev_samp(v.v), 4) AS z, round((1 + count(*) FILTER (WHERE v.v >= q.v)) / (1 + count(*)), 6) AS p_empirical FROM v, q WHERE v.s <> 'BUILDING'")
def compare_placebos(spark, sf_dir):
    v = inputs.table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.avg("c_acctbal").alias("v"))
    both = v.where("c_mktsegment <> 'BUILDING'").crossJoin(F.broadcast(v.where("c_mktsegment = 'BUILDING'").select(F.col("v").alias("q"))))
    out = _placed(both)
    return out.select("n", *[F.round(c, 4).alias(c) for c in ("placebo_mean", "placebo_sd", "z")], F.round("p_empirical", 6).alias("p_empirical"))


def _placed(both):
    q = both.agg(F.first("q")).first()[0]  # one number
    return stats.compare_to_placebos(both, float(q))


_GAINS = "gains AS (SELECT l_returnflag || l_linestatus AS chain, l_suppkey AS cell, avg(l_quantity) AS gain FROM lineitem GROUP BY 1, 2)"


@query(f"""WITH {_GAINS}, c AS (SELECT cell, max(gain) FILTER (WHERE chain = 'NO') AS c, avg(gain) FILTER (WHERE chain <> 'NO') AS r, max(gain) FILTER (WHERE chain <> 'NO') AS m FROM gains GROUP BY cell),
h AS (SELECT chain, avg(gain) AS g FROM gains WHERE chain <> 'NO' GROUP BY chain), o AS (SELECT count(*) AS n_cells, avg(c) AS configured_gain, avg(r) AS random_gain, avg(c - r) AS specific_gain, quantile_cont(c - r, 0.5) AS specific_median, avg(CASE WHEN c > r THEN 1 ELSE 0 END) AS frac_positive, avg(CASE WHEN c > m THEN 1 ELSE 0 END) AS frac_above_all FROM c)
SELECT n_cells, round(configured_gain, 5) AS configured_gain, round(random_gain, 5) AS random_gain, round(specific_gain, 5) AS specific_gain, round(specific_median, 5) AS specific_median, round(frac_positive, 5) AS frac_positive, round(frac_above_all, 5) AS frac_above_all, (SELECT count(*) FROM h) AS n_chains, (SELECT round(stddev_samp(g), 5) FROM h) AS sd_chains, (SELECT 1 + count(*) FROM h WHERE g >= configured_gain) AS rank_among_random, round((configured_gain - (SELECT avg(g) FROM h)) / (SELECT stddev_samp(g) FROM h), 4) AS z_vs_random FROM o""")
def specific_gain_point(spark, sf_dir):
    g = inputs.table(spark, sf_dir, "lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("chain"), F.col("l_suppkey").alias("cell")).agg(F.avg("l_quantity").alias("gain"))
    out = stats.specific_gain(g, "NO")
    five = ("configured_gain", "random_gain", "specific_gain", "specific_median", "frac_positive", "frac_above_all", "sd_chains")
    return out.select("n_cells", "n_chains", "rank_among_random", *[F.round(c, 5).alias(c) for c in five], F.round("z_vs_random", 4).alias("z_vs_random"))


@query("WITH c AS (SELECT month(o_orderdate) AS i, avg(o_totalprice) AS gain FROM orders GROUP BY 1) SELECT i::INTEGER AS i, round(gain, 3) AS gain, round(avg(gain) OVER w, 3) AS running_mean, round(stddev_samp(gain) OVER w / sqrt(count(*) OVER w), 3) AS running_se FROM c WINDOW w AS (ORDER BY i ROWS UNBOUNDED PRECEDING)")
def running_random_mean(spark, sf_dir):
    c = inputs.table(spark, sf_dir, "orders").groupBy(F.month("o_orderdate").alias("i")).agg(F.avg("o_totalprice").alias("gain"))
    return stats.running_mean(c).select("i", *[F.round(x, 3).alias(x) for x in ("gain", "running_mean", "running_se")])


@query("""WITH d AS (SELECT l_suppkey AS cell, avg(l_quantity) - 25.5 AS diff FROM lineitem GROUP BY 1), b AS (SELECT count(*) AS n, avg(diff) AS mean_diff FROM d),
s AS (SELECT draw, sum(diff * CASE WHEN substr(md5(draw || ':' || cell), 1, 1) < '8' THEN 1 ELSE -1 END) / count(*) AS m FROM d CROSS JOIN (SELECT unnest(range(1, 201)) AS draw) GROUP BY draw)
SELECT any_value(n) AS n, round(any_value(mean_diff), 6) AS mean_diff, (1 + count(*) FILTER (WHERE abs(m) >= abs(mean_diff) - 1e-12)) / 201.0 AS p_value FROM s CROSS JOIN b""")
def sign_flip_test(spark, sf_dir):
    d = inputs.table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("cell")).agg((F.avg("l_quantity") - 25.5).alias("diff"))
    return stats.sign_flip_test(d, "cell", 200).withColumn("mean_diff", F.round("mean_diff", 6))


@query()
def mixture_impact(spark, sf_dir):
    """Each gene's mean shift in a mixture of two normals; iterative, so without SQL."""
    means = inputs.shifts(spark, sf_dir).groupBy("gene").agg(F.avg("shift").alias("mean_shift"))
    fitted = stats.mixture(means, "mean_shift")
    return means.withColumn("impact", stats.impact(F.col("mean_shift"), *fitted))


# samples and quotas

@query("SELECT s_suppkey AS cell, r_name AS state FROM (SELECT s_suppkey, r_name, row_number() OVER (PARTITION BY r_name ORDER BY s_suppkey) AS rn FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('AFRICA', 'ASIA')) WHERE rn <= 3")
def centroid_sample_per_state(spark, sf_dir):
    return ranking.capped_per_state(inputs.cells(spark, sf_dir), [START, GOAL], 3)


@query("WITH c AS (SELECT l_suppkey AS cell, count(DISTINCT l_partkey) AS length FROM lineitem GROUP BY 1) SELECT cell, length, ((row_number() OVER (ORDER BY length DESC, cell)) - 1) % 4 AS shard FROM c")
def stride_shard(spark, sf_dir):
    c = inputs.table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("cell")).agg(F.count_distinct("l_partkey").alias("length"))
    return ranking.stride_shard(c, 4).withColumn("shard", F.col("shard").cast("bigint"))


_HAM = "g AS (SELECT p_brand AS grp, count(*) AS size FROM part GROUP BY 1), r AS (SELECT *, size * (least(77, sum(size) OVER ()) / (sum(size) OVER ())) AS raw, least(77, sum(size) OVER ()) AS total FROM g), h AS (SELECT *, least(floor(raw)::BIGINT, size) AS low FROM r), q AS (SELECT grp, size, low + CASE WHEN row_number() OVER (ORDER BY raw - floor(raw) DESC, size - low DESC, grp) <= total - sum(low) OVER () THEN 1 ELSE 0 END AS quota FROM h)"


def _groups(spark, sf_dir):
    return inputs.table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("grp")).agg(F.count("*").alias("size"))


@query(f"WITH {_HAM} SELECT grp, size, quota::BIGINT AS quota FROM q")
def hamilton_quota(spark, sf_dir):
    return ranking.hamilton(_groups(spark, sf_dir), 77)


@query(f"WITH {_HAM}, d AS (SELECT p_partkey, p_brand AS grp, row_number() OVER (PARTITION BY p_brand ORDER BY md5('0:' || p_partkey), p_partkey) AS rn FROM part) SELECT d.grp, p_partkey FROM d JOIN q USING (grp) WHERE rn <= quota")
def stratified_sample(spark, sf_dir):
    """77 parts by brand quotas, drawn by hashes (the sample is the feature)."""
    rows = inputs.table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("grp"))
    return ranking.stratified_sample(rows, ranking.rescued(ranking.hamilton(_groups(spark, sf_dir), 77), 77), "p_partkey")


@query("SELECT p_partkey AS token, (p_partkey::HUGEINT * 2654435761 + 3 * 97531) % 1000003 / 1000003.0 < 0.2 AS held_out FROM part")
def token_split(spark, sf_dir):
    return inputs.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("token"), ranking.split_tokens(F.col("p_partkey"), 0.2, 3).alias("held_out"))


@query("WITH r AS (SELECT o_orderkey AS idx, length(o_orderpriority)::BIGINT AS length FROM orders), s AS (SELECT *, row_number() OVER (ORDER BY length, idx) - 1 AS i, count(*) OVER () AS n FROM r) SELECT idx, length FROM s WHERE i IN (SELECT round_even(j * (n - 1) / 6.0, 0)::BIGINT FROM (SELECT unnest(range(0, 7)) AS j), (SELECT count(*) AS n FROM r))")
def spread_selection(spark, sf_dir):
    r = inputs.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("idx"), F.length("o_orderpriority").cast("bigint").alias("length"))
    return ranking.spread_selection(r, 7, False)


@query("SELECT count(*) AS n, quantile_cont(n_chars, 0.5) AS median, round(avg(n_chars), 4) AS mean, round(stddev_samp(n_chars), 4) AS sd, min(n_chars) AS shortest, max(n_chars) AS longest, count(*) FILTER (WHERE n_chars >= 2048) AS n_capped FROM documents")
def length_summary(spark, sf_dir):
    out = contracts.length_summary(inputs.table(spark, sf_dir, "documents"), "n_chars", 2048)
    return out.withColumns({"mean": F.round("mean", 4), "sd": F.round("sd", 4)})

