"""Queries that join, aggregate and compare results of runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ranklane.operators import reports
from ranklane.plans import inputs
from ranklane.plans.catalogue import query
from ranklane.plans.resampling import poisson_sql


@query("WITH s AS (SELECT l_partkey AS token, count(*) AS n, avg(l_discount) > 0.05 AS sig FROM lineitem WHERE l_quantity >= 40 GROUP BY 1) SELECT p_partkey AS token, n, coalesce(sig, false) AS sig FROM part LEFT JOIN s ON token = p_partkey")
def stats_rank_table(spark, sf_dir):
    lines = inputs.table(spark, sf_dir, "lineitem").where("l_quantity >= 40")
    stats = reports.above(lines.select(F.col("l_partkey").alias("token"), "l_discount", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")), "token", "l_discount", 0.05, "sig", "_file", "_row")
    return reports.with_stats(inputs.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("token")), stats, "token", ("sig",))


@query("WITH s AS (SELECT l_partkey AS token, l_linenumber AS seed, avg(l_quantity - 25) AS v FROM lineitem GROUP BY 1, 2) SELECT token, round(avg(v), 6) AS delta, count(*) AS n_seeds FROM s GROUP BY 1")
def multi_seed_mean(spark, sf_dir):
    rows = inputs.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("token"), F.col("l_linenumber").alias("seed"), (F.col("l_quantity") - 25).alias("delta"))
    return reports.seed_mean(rows, "token").withColumn("delta", F.round("delta", 6))


@query("SELECT o_custkey AS token, round(avg(o_totalprice), 4) AS pred, arg_max(o_orderpriority, o_orderkey) AS target FROM orders GROUP BY 1")
def gene_aggregate(spark, sf_dir):
    o = inputs.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("token"), F.col("o_totalprice").alias("pred"), F.col("o_orderpriority").alias("target"), "o_orderkey")
    return reports.gene_aggregate(o, "o_orderkey").withColumn("pred", F.round("pred", 4))


@query("SELECT l_partkey AS token, CASE WHEN count(*) >= 2 THEN round(stddev_samp(l_quantity) / nullif(abs(avg(l_quantity)), 0), 6) END AS cv FROM lineitem GROUP BY 1")
def variation_by_token(spark, sf_dir):
    return inputs.table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("token")).agg(F.round(reports.variation("l_quantity"), 6).alias("cv"))


@query("WITH b AS (SELECT p_brand AS brand, min(p_retailprice) AS b, avg(p_retailprice) AS m, max(p_retailprice) AS c FROM part GROUP BY 1) SELECT brand, round((m - b) / nullif(c - b, 0), 6) AS closed FROM b")
def gap_closed(spark, sf_dir):
    b = inputs.table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("brand")).agg(F.min("p_retailprice").alias("b"), F.avg("p_retailprice").alias("m"), F.max("p_retailprice").alias("c"))
    return b.select("brand", F.round(reports.gap_closed("b", "m", "c"), 6).alias("closed"))


@query("WITH r AS (SELECT CASE WHEN l_linenumber <= 3 THEN 'a' ELSE 'b' END AS run, l_linenumber AS seed, l_quantity AS v FROM lineitem) SELECT run, seed, count(*) AS n, round(avg(v), 6) AS mean FROM r GROUP BY 1, 2")
def seed_union(spark, sf_dir):
    rows = inputs.table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("seed"), F.col("l_quantity").alias("v"))
    every = reports.union_runs({"a": rows.where("seed <= 3"), "b": rows.where("seed > 3")})
    return every.groupBy("run", "seed").agg(F.count("*").alias("n"), F.round(F.avg("v"), 6).alias("mean"))


@query("WITH n AS (SELECT o_custkey AS value, unnest(range(1, count(*) + 1)) AS copy FROM orders GROUP BY 1) SELECT value, copy FROM n ORDER BY md5('42:' || value || ':' || copy), value, copy LIMIT 1000")
def null_downsample(spark, sf_dir):
    return reports.downsample(inputs.table(spark, sf_dir, "orders"), "o_custkey", 1000)


_ORGANISM = "CASE {c} % 3 WHEN 0 THEN 'human' WHEN 1 THEN 'mouse' ELSE {e} END"


@query(f"WITH o AS (SELECT c_custkey AS k, {_ORGANISM.format(c='c_custkey', e=chr(39) + 'drosophila' + chr(39))} AS a, CASE WHEN c_nationkey % 2 = 0 THEN 'human' ELSE 'mouse' END AS b FROM customer) SELECT k, CASE WHEN a <> b THEN a || '_to_' || b END AS pair FROM o")
def conversion_pairs(spark, sf_dir):
    c = inputs.table(spark, sf_dir, "customer")
    organism = F.element_at(F.array(F.lit("human"), F.lit("mouse"), F.lit("drosophila")), (F.col("c_custkey") % 3 + 1).cast("int"))
    return c.select(F.col("c_custkey").alias("k"), reports.conversion(organism, F.when(F.col("c_nationkey") % 2 == 0, "human").otherwise("mouse")).alias("pair"))


@query("WITH g AS (SELECT p_brand AS kind, count(*) AS n, avg(p_retailprice - 1400) AS m FROM part GROUP BY 1 HAVING count(*) >= 3) SELECT kind, n, round(m, 6) AS mean_shift, row_number() OVER (ORDER BY m DESC, kind) AS ord FROM g")
def group_order(spark, sf_dir):
    p = inputs.table(spark, sf_dir, "part").select(F.col("p_brand").alias("kind"), (F.col("p_retailprice") - 1400).alias("shift"))
    return reports.group_order(p, "kind", "shift", 3).withColumn("mean_shift", F.round("mean_shift", 6))


_LOLLIPOP = "s AS (SELECT l_partkey AS gene, count(*) AS n, round(avg(l_quantity - 25), 6) AS shift, abs(avg(l_quantity - 25)) > 1 AS sig FROM lineitem GROUP BY 1), f AS (SELECT * FROM s WHERE sig AND n >= 20)"


@query(f"WITH {_LOLLIPOP} (SELECT gene, n, shift FROM f WHERE shift > 0 ORDER BY shift DESC, gene LIMIT 15) UNION ALL (SELECT gene, n, shift FROM f WHERE shift < 0 ORDER BY shift, gene LIMIT 15)")
def lollipop(spark, sf_dir):
    shift = F.avg(F.col("l_quantity") - 25)
    s = inputs.table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("gene")).agg(F.count("*").alias("n"), F.round(shift, 6).alias("shift"), (F.abs(shift) > 1).alias("sig"))
    return reports.lollipop(s, "shift", "gene").select("gene", "n", "shift")


@query("WITH a AS (SELECT l_suppkey AS cell, l_partkey AS token, sum(l_quantity) AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2), b AS (SELECT l_suppkey AS cell, l_partkey AS token, sum(l_quantity) AS v FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1, 2) SELECT cell, token, a.v AS a, b.v AS b FROM a JOIN b USING (cell, token)")
def paired_samples(spark, sf_dir):
    of = lambda flag: inputs.counts_of(spark, sf_dir, F.col("l_returnflag") == flag)
    return reports.paired(of("R"), of("N"), "v")


_LISTS = """q AS (SELECT DISTINCT l_returnflag AS list, l_partkey || '-X' AS symbol FROM lineitem WHERE l_quantity >= 49), bg AS (SELECT DISTINCT l_partkey || '-X' AS symbol FROM lineitem WHERE l_quantity > 10),
own AS (SELECT DISTINCT 'N' AS list, l_partkey || '-X' AS symbol FROM lineitem WHERE l_quantity > 30), uni AS (SELECT list, symbol FROM (SELECT DISTINCT list FROM q WHERE list <> 'N') CROSS JOIN bg UNION ALL SELECT * FROM own),
sets AS (SELECT 'brand' AS library, p_brand AS term, p_partkey || '-X' AS symbol FROM part UNION SELECT 'size', 's' || p_size, p_partkey || '-X' FROM part),
qb AS (SELECT q.* FROM q JOIN uni USING (list, symbol)), nn AS (SELECT list, n_background, n_query FROM (SELECT list, count(*) AS n_background FROM uni GROUP BY 1) JOIN (SELECT list, count(*) AS n_query FROM qb GROUP BY 1) USING (list)),
t AS (SELECT u.list, library, term, count(qb.symbol) AS k, count(*) AS term_size FROM sets JOIN uni u USING (symbol) LEFT JOIN qb ON qb.list = u.list AND qb.symbol = sets.symbol GROUP BY 1, 2, 3),
u AS (SELECT * FROM t JOIN nn USING (list) WHERE k > 0), x AS (SELECT *, unnest(range(k, least(term_size, n_query) + 1)) AS x FROM u),
l AS (SELECT list, library, term, sum(exp(lgamma(term_size + 1) - lgamma(x + 1) - lgamma(term_size - x + 1) + lgamma(n_background - term_size + 1) - lgamma(n_query - x + 1) - lgamma(n_background - term_size - n_query + x + 1) - lgamma(n_background + 1) + lgamma(n_query + 1) + lgamma(n_background - n_query + 1))) AS p FROM x WHERE n_background - term_size - n_query + x >= 0 GROUP BY 1, 2, 3),
o AS (SELECT u.*, least(1.0, p) AS p FROM u JOIN l USING (list, library, term)), adj AS (SELECT *, row_number() OVER (PARTITION BY list, library ORDER BY p, term) AS rn, count(*) OVER (PARTITION BY list, library) AS n FROM o),
fd AS (SELECT *, least(1.0, min(p * n / rn) OVER (PARTITION BY list, library ORDER BY rn DESC ROWS UNBOUNDED PRECEDING)) AS fdr FROM adj)"""


@query(f"WITH {_LISTS} SELECT list, library, term, k, term_size, n_query, n_background, round(log10(p), 6) AS log_p, round(log10(fdr), 6) AS log_fdr, fdr < 0.05 AS sig FROM fd")
def ora_fan_out(spark, sf_dir):
    lines, part = inputs.table(spark, sf_dir, "lineitem"), inputs.table(spark, sf_dir, "part")
    symbol = lambda c: F.concat(F.col(c).cast("string"), F.lit("-X")).alias("symbol")
    sets = part.select(F.lit("brand").alias("library"), F.col("p_brand").alias("term"), symbol("p_partkey")).union(part.select(F.lit("size"), F.concat(F.lit("s"), F.col("p_size").cast("string")), symbol("p_partkey")))
    own = lines.where("l_quantity > 30").select(F.lit("N").alias("list"), symbol("l_partkey"))
    out = reports.fan_out(lines.where("l_quantity >= 49").select(F.col("l_returnflag").alias("list"), symbol("l_partkey")), lines.where("l_quantity > 10").select(symbol("l_partkey")), sets, own)
    return out.select("list", "library", "term", "k", "term_size", "n_query", "n_background", F.round(F.log10("p"), 6).alias("log_p"), F.round(F.log10("fdr"), 6).alias("log_fdr"), "sig")


_RANK = "rank() OVER (PARTITION BY method, cell ORDER BY {v}) + (count(*) OVER (PARTITION BY method, cell, {v}) - 1) / 2.0"
_METHODS = "lines AS (SELECT l_suppkey AS cell, l_extendedprice AS target, l_quantity AS quantity, l_discount AS discount, l_tax AS tax FROM lineitem), m AS (SELECT 'quantity' AS method, cell, quantity AS pred, target FROM lines UNION ALL SELECT 'discount', cell, discount, target FROM lines UNION ALL SELECT 'tax', cell, tax, target FROM lines)"


@query(f"WITH {_METHODS}, r AS (SELECT method, cell, {_RANK.format(v='pred')} AS a, {_RANK.format(v='target')} AS b FROM m), c AS (SELECT method, cell, corr(a, b) AS rho FROM r GROUP BY 1, 2), t AS (SELECT method, count(rho) AS n_cells, avg(rho) AS rho FROM c GROUP BY 1) SELECT method, n_cells, round(rho, 6) AS rho, round(rho - (SELECT rho FROM t WHERE method = 'tax'), 6) AS gain FROM t")
def method_comparison(spark, sf_dir):
    lines = inputs.table(spark, sf_dir, "lineitem")
    rows = None
    for name in ("quantity", "discount", "tax"):
        some = lines.select(F.lit(name).alias("method"), F.col("l_suppkey").alias("cell"), F.col(f"l_{name}").alias("pred"), F.col("l_extendedprice").alias("target"))
        rows = some if rows is None else rows.unionByName(some)
    return reports.compare_methods(rows, "tax", 3 * inputs.tasks(spark, sf_dir)).select("method", "n_cells", F.round("rho", 6).alias("rho"), F.round("gain", 6).alias("gain"))


def _bootstrap_sql(head: str, rows: str, keys: str, weight: str) -> str:
    return f"WITH {head}, s AS (SELECT {keys}, sum(v) AS s, count(*) AS n FROM {rows} WHERE v IS NOT NULL GROUP BY ALL), e AS (SELECT *, unnest(range(0, 200)) AS draw FROM s), w AS (SELECT *, {weight} AS w FROM e), m AS (SELECT draw, sum(w * s) / nullif(sum(w * n), 0) AS m FROM w GROUP BY 1) SELECT round((SELECT sum(s) / sum(n) FROM s), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM m"


@query(_bootstrap_sql("g AS (SELECT l_suppkey AS cell, l_linenumber AS chain, l_quantity - 25 AS v FROM lineitem WHERE l_returnflag = 'R')", "g", "cell, chain", f"{poisson_sql('cell', 'draw', 7)} * {poisson_sql('chain', 'draw', 8)}"))
def bootstrap_two_way(spark, sf_dir):
    """A gain's mean, with cells and chains drawn independently."""
    g = inputs.table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("cell"), F.col("l_linenumber").alias("chain"), (F.col("l_quantity") - 25).alias("v"))
    return reports.bootstrap_mean(g, "v", ("cell", "chain")).select(*[F.round(c, 6).alias(c) for c in ("mean", "low", "high")])
