"""Queries of bootstraps, method comparison and the verdict built on them.

Samples are pairs of supplier (cell) and part (key); whole numbers stand for predictions and targets, so that equal ones are equal in
every engine. Draws come from md5, so SQL draws the same cells.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ranklane.operators import ranking, resampling
from ranklane.operators import statistics as stats
from ranklane.plans import inputs
from ranklane.plans.catalogue import query

_SUMS = ("n", "p", "t", "pp", "tt", "pt")


def poisson_sql(key: str, draw: str, seed: int) -> str:
    """How often a key is taken in a draw, as resampling.times_drawn() says."""
    u = f"CAST('0x' || substr(md5('{seed}:' || {draw} || ':' || {key}), 1, 8) AS BIGINT) / 4294967296.0"
    return f"len(list_filter([{', '.join(repr(x) for x in resampling.poisson_steps())}]::DOUBLE[], lambda x: ({u}) >= x))"


def _drawn_sql(rows: str, methods: tuple[str, ...], draws: int, seed: int, bins: bool = False) -> str:
    """CTEs up to rho (draw, method, rho) of rows (cell, target, the methods and, with bins, bin)."""
    rank = lambda c: f"sum(w) OVER (PARTITION BY draw ORDER BY {c} RANGE UNBOUNDED PRECEDING) - (sum(w) OVER (PARTITION BY draw, {c}) - 1) / 2.0"
    b = "bin" if bins else "0"
    long = " UNION ALL ".join(f"SELECT draw, '{m}' AS method, bin, w, r_{m} AS p, r_target AS t FROM rk" for m in methods)
    return f"""dk AS (SELECT DISTINCT cell FROM {rows}), dw AS (SELECT cell, draw, CASE WHEN draw = 0 THEN 1 ELSE {poisson_sql('cell', 'draw', seed)} END AS w FROM dk, (SELECT unnest(range(0, {draws + 1})) AS draw)),
dx AS (SELECT draw, w, {b} AS bin, {', '.join(f'r.{m}' for m in (*methods, 'target'))} FROM {rows} r JOIN dw USING (cell) WHERE w > 0),
rk AS (SELECT draw, w, bin, {', '.join(f'{rank(m)} AS r_{m}' for m in (*methods, 'target'))} FROM dx), lg AS ({long}),
sm AS (SELECT draw, method, bin, sum(w) AS n, sum(w * p) AS p, sum(w * t) AS t, sum(w * p * p) AS pp, sum(w * t * t) AS tt, sum(w * p * t) AS pt FROM lg GROUP BY 1, 2, 3),
rho AS (SELECT draw, method, sum(pt - p * t / n) / nullif(sqrt(sum(pp - p * p / n) * sum(tt - t * t / n)), 0) AS rho FROM sm GROUP BY 1, 2)"""


def _interval_sql(source: str, point: str, by: str, index_rule: bool) -> str:
    """(by, point, ci_low, ci_high, n_boot, excludes_zero) from source (by, draw, x)."""
    keys = f"{by}, " if by else ""
    low, high = ("xs[greatest(0, floor(0.025 * len(xs))::INT - 1) + 1]", "xs[least(len(xs) - 1, floor(0.975 * len(xs))::INT) + 1]") if index_rule else ("list_aggregate(xs, 'quantile_cont', 0.025)", "list_aggregate(xs, 'quantile_cont', 0.975)")
    return f"""SELECT {keys}point AS {point}, {low} AS ci_low, {high} AS ci_high, len(xs) AS n_boot, ({low}) > 0 OR ({high}) < 0 AS excludes_zero FROM (
SELECT {keys}max(x) FILTER (WHERE draw = 0) AS point, list(x ORDER BY x) FILTER (WHERE draw > 0 AND x IS NOT NULL) AS xs FROM {source} {'GROUP BY ' + by if by else ''})"""


_LINES = "s AS (SELECT l_suppkey AS cell, l_partkey AS token, max(l_quantity) AS quantity, max(round(l_discount * 100)) AS discount, max(round(l_tax * 100)) AS tax, max(round(l_extendedprice * 100)) - 3000000 AS target FROM lineitem GROUP BY 1, 2)"
_METHODS = ("quantity", "tax")


def samples(spark, sf_dir):
    """(cell, token, quantity, discount, tax, target): one row for each pair of supplier and part."""
    cents = lambda c: F.max(F.round(F.col(c) * 100))
    lines = inputs.table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_quantity", "l_discount", "l_tax", "l_extendedprice").repartition(inputs.tasks(spark, sf_dir), "l_suppkey").groupBy(F.col("l_suppkey").alias("cell"), F.col("l_partkey").alias("token"))
    return lines.agg(F.max("l_quantity").alias("quantity"), cents("l_discount").alias("discount"), cents("l_tax").alias("tax"), (cents("l_extendedprice") - 3000000).alias("target"))


def _rounded(df, *kept: str):
    return df.select(*kept, *[F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes if c not in kept])


_DELTA = f"WITH {_LINES}, {_drawn_sql('s', _METHODS, 60, 5)}, d AS (SELECT draw, max(rho) FILTER (WHERE method = 'quantity') - max(rho) FILTER (WHERE method = 'tax') AS x FROM rho GROUP BY draw)"


@query(f"{_DELTA} SELECT round(delta_rho, 6) AS delta_rho, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high, n_boot, excludes_zero FROM ({_interval_sql('d', 'delta_rho', '', True)})")
def bootstrap_delta_rho(spark, sf_dir):
    """How much better quantity than tax ranks all pooled samples, suppliers being drawn again and again."""
    return _rounded(resampling.bootstrap_delta_rho(samples(spark, sf_dir), "quantity", "tax", "target", "cell", 60, 5))


_EDGES = "e AS (SELECT quantile_cont(discount, [" + ", ".join(repr(i / 20) for i in range(1, 20)) + "]) AS es FROM s), sb AS (SELECT s.*, len(list_filter(es, lambda x: x <= discount)) AS bin FROM s, e)"
_PARTIAL = f"WITH {_LINES}, {_EDGES}, {_drawn_sql('sb', _METHODS, 60, 5, True)}"


@query(f"{_PARTIAL}, d AS (SELECT draw, rho AS x FROM rho WHERE method = 'quantity') SELECT round(partial, 6) AS partial, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high, n_boot, excludes_zero FROM ({_interval_sql('d', 'partial', '', False)})")
def bootstrap_ci(spark, sf_dir):
    """The partial correlation of quantity and price given the discount, with its interval."""
    return _rounded(resampling.bootstrap_partial(samples(spark, sf_dir), "quantity", "target", "discount", "cell", 60, 5))


@query(f"{_PARTIAL}, d AS (SELECT draw, max(rho) FILTER (WHERE method = 'quantity') - max(rho) FILTER (WHERE method = 'tax') AS x FROM rho GROUP BY draw) SELECT round(diff, 6) AS diff, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high, n_boot, excludes_zero FROM ({_interval_sql('d', 'diff', '', False)})")
def bootstrap_partial_diff(spark, sf_dir):
    return _rounded(resampling.bootstrap_partial_diff(samples(spark, sf_dir), "quantity", "tax", "target", "discount", "cell", 60, 5))


_GAINS = "g AS (SELECT l_linenumber AS chain, l_suppkey AS cell, avg(l_quantity) - 25 AS gain FROM lineitem GROUP BY 1, 2)"


@query(f"""WITH {_GAINS}, c AS (SELECT cell, max(gain) FILTER (WHERE chain = 1) AS c, avg(gain) FILTER (WHERE chain <> 1) AS r, max(gain) FILTER (WHERE chain <> 1) AS m FROM g GROUP BY 1),
o AS (SELECT count(*) AS n_cells, avg(c) AS configured_gain_mean, avg(r) AS random_gain_mean, avg(c - r) AS specific_gain_mean, quantile_cont(c - r, 0.5) AS specific_gain_median, avg((c > r)::INT) AS frac_cells_positive, avg((c > m)::INT) AS frac_cells_above_all_random FROM c),
k AS (SELECT chain, avg(gain) AS g FROM g WHERE chain <> 1 GROUP BY 1), ps AS (SELECT *, g - (sum(g) OVER () - g) / (count(*) OVER () - 1) AS pseudo FROM k),
a AS (SELECT count(*) AS n_random_chains, stddev_samp(g) AS random_gain_sd_chains, stddev_samp(g) / sqrt(count(*)) AS random_gain_se_chains, 1 + count(*) FILTER (WHERE g >= configured_gain_mean) AS rank_among_random,
  (any_value(configured_gain_mean) - avg(g)) / stddev_samp(g) AS z_vs_random, stddev_samp(pseudo) AS null_sd, max(pseudo) AS null_max, (1 + count(*) FILTER (WHERE pseudo >= specific_gain_mean)) / (1 + count(*)) AS null_empirical_p FROM ps, o),
e AS (SELECT *, unnest(range(1, 101)) AS draw FROM g), w AS (SELECT *, {poisson_sql('cell', 'draw', 4)} AS w FROM e), gs AS (SELECT draw, chain, sum(w * gain) AS s, sum(w) AS n FROM w GROUP BY 1, 2),
v AS (SELECT *, CASE WHEN chain = 1 THEN 0 ELSE {poisson_sql('chain', 'draw', 5)} END AS v FROM gs),
d AS (SELECT max(s / nullif(n, 0)) FILTER (WHERE chain = 1) - sum(v * s) / nullif(sum(v * n), 0) AS x FROM v GROUP BY draw),
i AS (SELECT quantile_cont(x, 0.025) AS specific_gain_ci_low, quantile_cont(x, 0.975) AS specific_gain_ci_high FROM d)
SELECT n_cells, n_random_chains, rank_among_random, {', '.join(f'round({c}, 6) AS {c}' for c in ('configured_gain_mean', 'random_gain_mean', 'specific_gain_mean', 'frac_cells_positive', 'frac_cells_above_all_random', 'specific_gain_median', 'random_gain_sd_chains', 'random_gain_se_chains', 'z_vs_random', 'null_sd', 'null_max', 'null_empirical_p', 'specific_gain_ci_low', 'specific_gain_ci_high'))},
round(specific_gain_mean / nullif(configured_gain_mean, 0), 6) AS specific_fraction FROM o, a, i""")
def specific_gain_interval(spark, sf_dir):
    """A configured chain (first lines) against random ones (the others), cells and chains being drawn."""
    g = inputs.table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("chain"), F.col("l_suppkey").alias("cell")).agg((F.avg("l_quantity") - 25).alias("gain"))
    return _rounded(resampling.specific_gain(g.withColumn("chain", F.col("chain").cast("string")), "1", 100, 4))


_ALL = ("quantity", "discount", "tax")
_RANKED = lambda v, by="": f"rank() OVER ({by} ORDER BY {v}) + (count(*) OVER ({(by + ', ') if by else 'PARTITION BY '}{v}) - 1) / 2.0"


def _ranks_at(k: int, up: bool, m: str) -> str:
    sign, name = (1, "up") if up else (-1, "down")
    rel = f"greatest(0.0, {-sign} * obs)"
    return f"""{m}_{name} AS (SELECT CASE WHEN count(*) >= {k} THEN count(*) FILTER (WHERE rp <= {k} AND ro <= {k}) / {k}.0 END AS precision_at_{k}_{name}, CASE WHEN count(*) >= {k} AND sum(rel / log2(ri + 1)) FILTER (WHERE ri <= {k}) > 0 THEN sum(rel / log2(rp + 1)) FILTER (WHERE rp <= {k}) / sum(rel / log2(ri + 1)) FILTER (WHERE ri <= {k}) END AS ndcg_at_{k}_{name}
FROM (SELECT {rel} AS rel, row_number() OVER (ORDER BY {sign} * pred, token) AS rp, row_number() OVER (ORDER BY {sign} * obs, token) AS ro, row_number() OVER (ORDER BY {rel} DESC, token) AS ri FROM {m}_k))"""


def _method_sql(m: str) -> str:
    return f"""{m}_a AS (SELECT *, {_RANKED(m)} AS p, {_RANKED('target')} AS t, row_number() OVER (ORDER BY {m}, cell, token) - 1 AS place, count(*) OVER () AS n FROM sb),
{m}_w AS (SELECT count(*) AS n_samples, covar_pop(p, t) / nullif(stddev_pop(p) * stddev_pop(t), 0) AS pooled_spearman FROM {m}_a), {m}_d AS (SELECT p - avg(p) OVER (PARTITION BY bin) AS p, t - avg(t) OVER (PARTITION BY bin) AS t FROM {m}_a),
{m}_p AS (SELECT covar_pop(p, t) / nullif(stddev_pop(p) * stddev_pop(t), 0) AS partial_spearman_given_base FROM {m}_d),
{m}_r AS (SELECT cell, {_RANKED(m, 'PARTITION BY cell')} AS p, {_RANKED('target', 'PARTITION BY cell')} AS t FROM s), {m}_c AS (SELECT covar_pop(p, t) / nullif(stddev_pop(p) * stddev_pop(t), 0) AS rho FROM {m}_r GROUP BY cell HAVING count(*) >= 10),
{m}_q AS (SELECT count(rho) AS n_cells_scored, quantile_cont(rho, 0.25) AS cellwise_spearman_q25, quantile_cont(rho, 0.5) AS cellwise_spearman_median, quantile_cont(rho, 0.75) AS cellwise_spearman_q75 FROM {m}_c),
{m}_k AS (SELECT token, avg({m}) AS pred, max(target) AS obs FROM s GROUP BY token), {m}_g AS (SELECT count(*) AS n_genes_scored, covar_pop(p, t) / nullif(stddev_pop(p) * stddev_pop(t), 0) AS gene_aggregated_spearman FROM (SELECT {_RANKED('pred')} AS p, {_RANKED('obs')} AS t FROM {m}_k)),
{m}_b AS (SELECT ((place + 1) * 10 - 1) // n AS bin, avg(target) AS o FROM {m}_a GROUP BY 1), {m}_m AS (SELECT covar_pop(p, t) / nullif(stddev_pop(p) * stddev_pop(t), 0) AS calibration_monotonicity FROM (SELECT {_RANKED('bin')} AS p, {_RANKED('o')} AS t FROM {m}_b)),
{_ranks_at(10, True, m)}, {_ranks_at(10, False, m)}"""


_SCORES = ("pooled_spearman", "partial_spearman_given_base", "cellwise_spearman_q25", "cellwise_spearman_median", "cellwise_spearman_q75", "gene_aggregated_spearman", "calibration_monotonicity", "precision_at_10_up", "ndcg_at_10_up", "precision_at_10_down", "ndcg_at_10_down")


@query(f"WITH {_LINES}, {_EDGES}, " + ", ".join(map(_method_sql, _METHODS)) + " " + " UNION ALL ".join(f"SELECT '{m}' AS method, n_samples, n_cells_scored, n_genes_scored, {', '.join(f'round({c}, 6) AS {c}' for c in _SCORES)} FROM {', '.join(f'{m}_{t}' for t in ('w', 'p', 'q', 'g', 'm', 'up', 'down'))}" for m in _METHODS))
def method_scores(spark, sf_dir):
    """Everything that one method's predictions are scored by."""
    return _rounded(resampling.method_scores(samples(spark, sf_dir), _METHODS, "target", "cell", "token", "discount", ks=(10,)), "method")


def _flips_sql(a: str, b: str, draws: int) -> str:
    return f"""SELECT '{b}' AS baseline, any_value(n) AS n, any_value(mean_diff) AS mean_diff, (1 + count(*) FILTER (WHERE abs(m) >= abs(mean_diff) - 1e-12)) / {draws + 1}.0 AS p_value FROM (
SELECT draw, count(*) AS n, avg(diff) AS mean_diff, sum(diff * CASE WHEN substr(md5(draw || ':' || cell), 1, 1) < '8' THEN 1 ELSE -1 END) / count(*) AS m FROM (SELECT cell, x.rho - y.rho AS diff, unnest(range(1, {draws + 1})) AS draw FROM cw x JOIN cw y USING (cell) WHERE x.method = '{a}' AND y.method = '{b}') GROUP BY draw)"""


_CELLWISE = " UNION ALL ".join(f"SELECT '{m}' AS method, cell, covar_pop(p, t) / nullif(stddev_pop(p) * stddev_pop(t), 0) AS rho FROM (SELECT cell, {_RANKED(m, 'PARTITION BY cell')} AS p, {_RANKED('target', 'PARTITION BY cell')} AS t FROM s) GROUP BY cell HAVING count(*) >= 10" for m in _ALL)
_CONTRASTS = f"""{_drawn_sql('s', _ALL, 40, 5)}, d AS (SELECT o.method AS baseline, draw, q.rho - o.rho AS x FROM rho q JOIN rho o USING (draw) WHERE q.method = 'quantity' AND o.method <> 'quantity'),
bi AS ({_interval_sql('d', 'delta_rho', 'baseline', True)}), cw AS ({_CELLWISE}), fl AS ({_flips_sql('quantity', 'discount', 100)} UNION ALL {_flips_sql('quantity', 'tax', 100)}), ct AS (SELECT * FROM bi JOIN fl USING (baseline))"""


def _contrasts(spark, sf_dir):
    s = samples(spark, sf_dir)
    sums = resampling.resampled_sums(s, _ALL, "target", "cell", 40, 5)
    return resampling.contrasts(sums, s, "quantity", ("discount", "tax"), "target", "cell", flips=100)


@query(f"WITH {_LINES}, {_CONTRASTS} SELECT baseline, round(delta_rho, 6) AS delta_rho, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high, n_boot, excludes_zero, n, round(mean_diff, 6) AS mean_diff, round(p_value, 6) AS p_value FROM ct")
def method_contrasts(spark, sf_dir):
    """Quantity against the other methods, by bootstrap and by sign flips."""
    return _rounded(_contrasts(spark, sf_dir), "baseline")


@query(f"""WITH {_LINES}, {_CONTRASTS}, {_EDGES}, {_drawn_sql('sb', ('quantity',), 40, 5, True).replace('dk AS', 'dk2 AS').replace('FROM dk', 'FROM dk2').replace('dw AS', 'dw2 AS').replace('JOIN dw ', 'JOIN dw2 ').replace('dx AS', 'dx2 AS').replace('FROM dx', 'FROM dx2').replace('rk AS', 'rk2 AS').replace('FROM rk', 'FROM rk2').replace('lg AS', 'lg2 AS').replace('FROM lg', 'FROM lg2').replace('sm AS', 'sm2 AS').replace('FROM sm', 'FROM sm2').replace('rho AS (', 'rho2 AS (')},
d2 AS (SELECT draw, rho AS x FROM rho2), pi AS ({_interval_sql('d2', 'partial', '', False)}), b AS (SELECT baseline, delta_rho > 0 AND excludes_zero AS beaten FROM ct)
SELECT coalesce((SELECT string_agg(baseline, ',' ORDER BY baseline) FROM b WHERE beaten), '') AS beats, coalesce((SELECT string_agg(baseline, ',' ORDER BY baseline) FROM b WHERE NOT beaten), '') AS does_not_beat,
(SELECT count(*) > 0 AND count(*) FILTER (WHERE NOT beaten) = 0 FROM b WHERE baseline IN ('discount', 'norm')) AS beats_required_baselines, ci_low > 0 AS adds_beyond_base_rank,
(SELECT count(*) > 0 AND count(*) FILTER (WHERE NOT beaten) = 0 FROM b WHERE baseline IN ('discount', 'norm')) AND ci_low > 0 AS passed FROM pi""")
def direction_verdict(spark, sf_dir):
    own = resampling.bootstrap_partial(samples(spark, sf_dir), "quantity", "target", "discount", "cell", 40, 5)
    out = resampling.direction_verdict(_contrasts(spark, sf_dir), own, ("discount", "norm"))
    return out.withColumns({c: F.array_join(c, ",") for c in ("beats", "does_not_beat")})


@query(f"""WITH {_LINES}, e AS (SELECT quantile_cont(discount, [0.2, 0.4, 0.6, 0.8]) AS es FROM s), sb AS (SELECT s.*, len(list_filter(es, lambda x: x <= discount)) AS bin FROM s, e),
r AS (SELECT *, {_RANKED('quantity', 'PARTITION BY bin')} AS p, {_RANKED('target', 'PARTITION BY bin')} AS t FROM sb), o AS (SELECT {_RANKED('discount')} AS p, {_RANKED('target')} AS t, target FROM s),
e20 AS (SELECT quantile_cont(discount, [{', '.join(repr(i / 20) for i in range(1, 20))}]) AS es FROM s), f AS (SELECT s.*, len(list_filter(es, lambda x: x <= discount)) AS b, token % 2 AS fold FROM s, e20), fm AS (SELECT b, 1 - fold AS fold, avg(target) AS pred FROM f GROUP BY 1, 2),
fp AS (SELECT round(coalesce(pred, 0), 3) AS pred, target FROM f LEFT JOIN fm USING (b, fold)), fr AS (SELECT {_RANKED('pred')} AS p, {_RANKED('target')} AS t, target FROM fp)
SELECT 'quantity' AS method, bin::INTEGER AS stratum, count(*) AS n, round(covar_pop(p, t) / nullif(stddev_pop(p) * stddev_pop(t), 0), 6) AS spearman, round(avg(target), 3) AS target_mean FROM r GROUP BY bin
UNION ALL SELECT 'base_rank', NULL, count(*), round(covar_pop(p, t) / nullif(stddev_pop(p) * stddev_pop(t), 0), 6), round(avg(target), 3) FROM o
UNION ALL SELECT 'base_only', NULL, count(*), round(covar_pop(p, t) / nullif(stddev_pop(p) * stddev_pop(t), 0), 6), round(avg(target), 3) FROM fr""")
def base_rank_control(spark, sf_dir):
    """Whether quantity says more than its base, the discount: within strata of it, and against predictors that know only it."""
    out = resampling.base_control(samples(spark, sf_dir), ("quantity",), "target", "token", "discount")
    return out.withColumns({"spearman": F.round("spearman", 6), "target_mean": F.round("target_mean", 3)})
