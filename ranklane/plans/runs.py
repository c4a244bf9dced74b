"""Queries of data sets and chains of edits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ranklane.functions import lists
from ranklane.operators import chains, datasets, encode, profiles
from ranklane.plans import inputs
from ranklane.plans.catalogue import query
from ranklane.plans.inputs import C_LISTS


@query("SELECT o_orderkey AS k FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderpriority IN ('1-URGENT', '2-HIGH')")
def filter_data(spark, sf_dir):
    o = inputs.table(spark, sf_dir, "orders")
    return datasets.keep_listed(o, {"o_orderstatus": ["F", "O"], "o_orderpriority": ["1-URGENT", "2-HIGH"]}).select(F.col("o_orderkey").alias("k"))


@query("SELECT c_custkey AS cell, c_mktsegment AS state, 'study' AS batch, CASE c_mktsegment WHEN 'BUILDING' THEN 'b' WHEN 'MACHINERY' THEN 'm' ELSE c_mktsegment END AS label FROM customer")
def metadata_derive(spark, sf_dir):
    c = inputs.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cell"), "c_mktsegment")
    return datasets.apply_metadata(c, {"c_mktsegment": "state", "absent": "x"}, {"batch": "study", "cell": "no"}, {"label": ("state", {"BUILDING": "b", "MACHINERY": "m"})})


@query("WITH o AS (SELECT o_orderkey AS k, o_orderpriority AS label, row_number() OVER (ORDER BY o_orderkey * 7919 % 1000003, o_orderkey) - 1 AS r FROM orders), c AS (SELECT k, label, CASE WHEN r < (SELECT round(count(*) * 0.8) FROM o) THEN 'train' ELSE 'eval' END AS part FROM o) SELECT k, label, part FROM c WHERE part = 'train' OR label IN (SELECT label FROM c WHERE part = 'train')")
def train_eval_split(spark, sf_dir):
    o = inputs.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("label"))
    return datasets.train_eval_split(o, "k", "label", 0.8, F.struct((F.col("k") * 7919 % 1000003).alias("h"), "k"))


@query("WITH c AS (SELECT l_suppkey AS cell, count(DISTINCT l_partkey) AS length FROM lineitem GROUP BY 1 ORDER BY 1 LIMIT 20) SELECT cell, length, row_number() OVER (ORDER BY length DESC, cell) - 1 AS ord FROM c")
def longest_first_cap(spark, sf_dir):
    c = inputs.table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("cell")).agg(F.count_distinct("l_partkey").alias("length"))
    return datasets.longest_first(c, 20, True).withColumn("ord", F.col("ord").cast("bigint"))


@query("WITH v AS (SELECT 'G' || p_partkey AS gene, p_partkey + 4 AS token FROM part), s AS (SELECT 'G' || p_partkey AS gene, arg_min(p_brand || p_size, p_partkey) AS symbol FROM part WHERE p_partkey % 3 <> 0 GROUP BY 1) SELECT token, coalesce(symbol, gene) AS symbol FROM v LEFT JOIN s USING (gene)")
def token_symbols(spark, sf_dir):
    p = inputs.table(spark, sf_dir, "part")
    gene = F.concat(F.lit("G"), F.col("p_partkey").cast("string"))
    symbols = p.where("p_partkey % 3 <> 0").select(F.concat("p_brand", F.col("p_size").cast("string")).alias("symbol"), gene.alias("gene"), F.col("p_partkey").alias("ord"))
    return datasets.token_symbols(p.select(gene.alias("gene"), (F.col("p_partkey") + 4).alias("token")), symbols)


@query("WITH m AS (SELECT 'P' || p_partkey AS id, p_brand AS symbol, p_type AS text FROM part WHERE p_partkey % 2 = 0), c AS (SELECT 'P' || p_partkey AS id, p_brand AS symbol, 'by hand ' || p_size AS text FROM part WHERE p_partkey % 5 = 0), k AS (SELECT 'P' || p_partkey AS key FROM part UNION SELECT lower(p_brand) FROM part) SELECT key, coalesce((SELECT max(text) FROM c WHERE id = key), (SELECT max(text) FROM m WHERE id = key), (SELECT max(text) FROM c WHERE upper(symbol) = upper(key)), (SELECT max(text) FROM m WHERE upper(symbol) = upper(key))) AS text FROM k")
def brief_functions(spark, sf_dir):
    p = inputs.table(spark, sf_dir, "part").withColumn("id", F.concat(F.lit("P"), F.col("p_partkey").cast("string")))
    main = p.where("p_partkey % 2 = 0").select("id", F.col("p_brand").alias("symbol"), F.col("p_type").alias("text"))
    hand = p.where("p_partkey % 5 = 0").select("id", F.col("p_brand").alias("symbol"), F.concat(F.lit("by hand "), F.col("p_size").cast("string")).alias("text"))
    keys = p.select(F.col("id").alias("key")).union(p.select(F.lower("p_brand")))
    return datasets.brief_functions(keys, main, hand)


@query("WITH o AS (SELECT 'a' || p_size AS source, 'b' || (p_partkey % 40) AS target FROM part), f AS (SELECT 'a' || x AS id FROM (SELECT unnest([3, 5]) AS x) UNION ALL SELECT 'b7') SELECT DISTINCT source, target FROM o WHERE source IN (SELECT id FROM f) OR target IN (SELECT id FROM f)")
def forbidden_overlay(spark, sf_dir):
    p = inputs.table(spark, sf_dir, "part")
    o = p.select(F.concat(F.lit("a"), F.col("p_size").cast("string")).alias("source"), F.concat(F.lit("b"), (F.col("p_partkey") % 40).cast("string")).alias("target"))
    return datasets.forbidden_in_overlay(o, spark.createDataFrame([("a3",), ("a5",), ("b7",)], "id string"))


# chains

_EV = "ev AS (SELECT l_returnflag AS chain, l_suppkey AS cell, l_linenumber AS step, sum(l_quantity) AS value FROM lineitem GROUP BY ALL), fin AS (SELECT chain, cell, arg_max(value, step) AS value FROM ev GROUP BY 1, 2), ref AS (SELECT chain, cell, arg_max(value, step) AS ref FROM ev WHERE step <= 3 GROUP BY 1, 2), g AS (SELECT chain, cell, value - ref AS gain FROM fin JOIN ref USING (chain, cell))"


def _gains(spark, sf_dir):
    e = inputs.table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("chain"), F.col("l_suppkey").alias("cell"), F.col("l_linenumber").alias("step")).agg(F.sum("l_quantity").alias("value"))
    return chains.endpoint_gain(e, e.where("step <= 3"))


@query(f"WITH {_EV} SELECT chain, cell, gain FROM g")
def chain_endpoint_gain(spark, sf_dir):
    return _gains(spark, sf_dir)


@query(f"WITH {_EV}, r AS (SELECT cell, count(*) AS n, avg(gain) AS r, max(gain) AS m FROM g WHERE chain <> 'R' AND cell % 4 <> length(chain) + 1 AND cell % 3 <> 0 GROUP BY cell HAVING count(*) >= 2) SELECT count(*) AS n_cells, round(avg(n), 5) AS chains_per_cell, round(avg(gain), 5) AS configured_gain, round(avg(r), 5) AS random_gain, round(avg(gain - r), 5) AS specific_gain, round(avg(CASE WHEN gain > m THEN 1 ELSE 0 END), 5) AS frac_above_all FROM g JOIN r USING (cell) WHERE chain = 'R'")
def conditional_specific_gain(spark, sf_dir):
    g = _gains(spark, sf_dir)
    out = chains.conditional_gain(g, "R", g.where("cell % 3 <> 0").select("cell"), g.where("cell % 4 <> length(chain) + 1"), 2)
    return out.select("n_cells", *[F.round(c, 5).alias(c) for c in out.columns[1:]])


@query("WITH s AS (SELECT p_size AS target, p_partkey AS token FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY md5('3:' || target || ':' || token)) - 1 AS rn, count(*) OVER (PARTITION BY target) AS n FROM s) SELECT chain::INTEGER AS chain, target, token FROM r, (SELECT unnest(range(0, 6)) AS chain) WHERE rn < 6 AND chain % least(n, 6) = rn")
def random_chain_draw(spark, sf_dir):
    s = inputs.table(spark, sf_dir, "part").select(F.col("p_size").alias("target"), F.col("p_partkey").alias("token"))
    return chains.draw_random_chains(s, 6, 3)


@query("WITH s AS (SELECT p_size AS target, p_partkey AS token, p_retailprice AS v FROM part), p AS (SELECT * FROM s WHERE token % 2 = 0) SELECT target, round((SELECT avg(v) FROM p WHERE p.target = t.target), 4) AS picks_mean, round(avg(v), 4) AS stratum_mean, round(((SELECT avg(v) FROM p WHERE p.target = t.target) - avg(v)) / sqrt(((SELECT var_samp(v) FROM p WHERE p.target = t.target) + var_samp(v)) / 2), 4) AS smd FROM s t GROUP BY target")
def covariate_balance(spark, sf_dir):
    p = inputs.table(spark, sf_dir, "part")
    s = p.select(F.col("p_size").alias("target"), F.col("p_partkey").alias("token"))
    out = chains.balance(s.where("token % 2 = 0"), s, p.select(F.col("p_partkey").alias("token"), F.col("p_retailprice").alias("v")))
    return out.select("target", *[F.round(c, 4).alias(c) for c in ("picks_mean", "stratum_mean", "smd")])


_FIN = f"WITH {C_LISTS}, s AS (SELECT cell, unnest(ids) AS token, generate_subscripts(ids, 1) AS i, len(ids) AS n FROM lists), f AS (SELECT 1 AS seed, cell, token, i AS pos FROM s UNION ALL SELECT 2, cell, token, i + 3 * (token % 4) FROM s UNION ALL SELECT 3, cell, token, -i FROM s WHERE token % 3 <> 0)"


@query(f"{_FIN}, b AS (SELECT x.seed AS seed_a, y.seed AS seed_b, x.cell, x.pos AS pa, y.pos AS pb FROM f x JOIN f y ON x.cell = y.cell AND x.token = y.token AND x.seed < y.seed), r AS (SELECT *, rank() OVER (PARTITION BY seed_a, seed_b, cell ORDER BY pa) + (count(*) OVER (PARTITION BY seed_a, seed_b, cell, pa) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY seed_a, seed_b, cell ORDER BY pb) + (count(*) OVER (PARTITION BY seed_a, seed_b, cell, pb) - 1) / 2.0 AS rb FROM b) SELECT seed_a, seed_b, cell, count(*) AS n_shared, round(covar_pop(ra, rb) / nullif(stddev_pop(ra) * stddev_pop(rb), 0), 5) AS spearman FROM r GROUP BY 1, 2, 3")
def cross_seed_agreement(spark, sf_dir):
    s = encode.from_lists(inputs.customer_lists(spark, sf_dir)).select("cell", "token", (F.col("pos") + 1).alias("i"))
    f = s.select(F.lit(1).alias("seed"), "cell", "token", F.col("i").cast("bigint").alias("pos")).unionByName(s.select(F.lit(2).alias("seed"), "cell", "token", (F.col("i") + 3 * (F.col("token") % 4)).alias("pos"))).unionByName(s.where("token % 3 <> 0").select(F.lit(3).alias("seed"), "cell", "token", (-F.col("i")).cast("bigint").alias("pos")))
    return chains.seed_agreement(f, 3 * inputs.tasks(spark, sf_dir)).withColumn("spearman", F.round("spearman", 5))


@query(f"WITH {C_LISTS}, x AS (SELECT cell, unnest(ids) AS token, generate_subscripts(ids, 1) - 1 AS pos FROM lists), a AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY pos) AS rn FROM x), b AS (SELECT cell, token AS shuffled, row_number() OVER (PARTITION BY cell ORDER BY md5('7:' || cell || ':' || pos)) AS rn FROM x) SELECT cell, pos, token, shuffled FROM a JOIN b USING (cell, rn)")
def shuffle_control(spark, sf_dir):
    x = encode.from_lists(inputs.customer_lists(spark, sf_dir)).select("cell", F.col("pos").cast("bigint").alias("pos"), "token")
    return chains.shuffled_within(x, "cell", "pos", "token", 7, inputs.tasks(spark, sf_dir)).select("cell", "pos", "token", "shuffled")


@query(f"""WITH {C_LISTS}, e AS (SELECT cell, list_concat([15]::BIGINT[], list_filter(ids, lambda x: x <> 15))[1:len(ids)] AS ids FROM lists), r AS (SELECT cell, list_concat(list_filter(ids, lambda x: x = 15), list_filter(list_reverse(ids), lambda x: x <> 15)) AS ids FROM e), d AS (SELECT cell, list_filter(ids, lambda x: x NOT IN (9, 12)) AS ids FROM r),
q AS (SELECT cell, list_concat(list_filter(ids, lambda x: x = 15), list_filter(list_reverse(ids), lambda x: x <> 15)) AS ids FROM d) SELECT cell, array_to_string(ids, ' ') AS ids FROM q""")
def chain_run(spark, sf_dir):
    """Two steps with a reordering after each (here: the list in reverse), overexpressed keys pinned; the last lists."""
    reverse = lambda before, after: after.select("cell", F.reverse("ids").alias("ids"))
    events = chains.run_chain(inputs.customer_lists(spark, sf_dir), [("oe", (15,)), ("kd", (9, 12))], reverse, pin=True)
    return events.where("kind = 'feedback' AND step = 2").select("cell", F.array_join("ids", " ").alias("ids"))


_SAMPLES = f"{C_LISTS}, x AS (SELECT cell, unnest(ids) AS token, generate_subscripts(ids, 1) - 1 AS pos, len(ids) AS n FROM lists WHERE len(ids) > 1), sm AS (SELECT cell, token, pos / (n - 1) AS base, (token % 17) / 10.0 AS dn FROM x)"


@query(f"WITH {_SAMPLES}, z AS (SELECT cell, token, base, CASE WHEN stddev_pop(dn) OVER w > 0 THEN (dn - avg(dn) OVER w) / stddev_pop(dn) OVER w ELSE 0 END AS z FROM sm WINDOW w AS (PARTITION BY cell)) SELECT cell, token, round(-base, 6) AS base_rank, round(greatest(-0.3, least(0.3, -0.2 * z)), 5) AS norm FROM z")
def baseline_predictions(spark, sf_dir):
    x = encode.from_lists(inputs.customer_lists(spark, sf_dir).where(F.size("ids") > 1)).select("cell", "token", profiles.norm_pos().alias("base"), (F.col("token") % 17 / 10.0).cast("double").alias("delta_norm"))
    return x.select("cell", "token", F.round(chains.predicted("base_rank", 0.2, 0.3), 6).alias("base_rank"), F.round(chains.predicted("norm", 0.2, 0.3), 5).alias("norm"))


@query()
def decoder_fit(spark, sf_dir):
    """A decoder trained by aggregated gradients on embeddings, and its predictions."""
    e = inputs.table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("delta_h"))
    e = e.withColumn("target", 0.3 * F.tanh(F.col("delta_h")[0] - F.col("delta_h")[1]))
    w = chains.fit_decoder(e, 64, 0.3, 8, 50.0)
    return e.select("vec_id", "target", chains.decode(F.col("delta_h"), w, 0.3).alias("predicted"))


@query(f"WITH {C_LISTS} SELECT cell, array_to_string(list_transform(range(0, len(ids)), lambda i: format('{{:.12f}}', i / greatest(len(ids) - 1, 1))), ' ') AS norm FROM lists")
def base_rank_norm(spark, sf_dir):
    norm = F.transform(lists.base_rank_norm(F.col("ids")), lambda x: F.format_string("%.12f", x))
    return inputs.customer_lists(spark, sf_dir).select("cell", F.array_join(norm, " ").alias("norm"))
