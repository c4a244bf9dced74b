"""Queries of sketches, placebo counterfactuals and keys' vectors in two contexts.

Where vectors are needed, those of the embeddings table stand for a model's: its labels are cells, its rows their keys, and
reversed or turned coordinates are other contexts of the same key.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ranklane.functions import lists
from ranklane.operators import closeness, counterfactuals, encode, profiles, rerank, sketches, vectors
from ranklane.plans import inputs
from ranklane.plans.catalogue import query
from ranklane.plans.inputs import CELLS, ENC, GOAL, START, STATES
from ranklane.sources.shared import kept

_X = "x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings)"


@query(f"WITH {_X} SELECT label, i - 1 AS i, count(*) AS n, round(sum(v) / count(*), 6) AS mean, round(min(v), 6) AS low, round(max(v), 6) AS high, true AS median_near FROM x GROUP BY 1, 2")
def embedding_summary(spark, sf_dir):
    """Digests of every coordinate by label; median_near counts, for each, whether the median's rank is within 1 % of the middle."""
    e = inputs.table(spark, sf_dir, "embeddings")
    d = sketches.digests(e, "embedding", "label").withColumn("median", sketches.quantile("means", "weights", "low", "high", F.lit(0.5)))
    values = e.select("label", F.posexplode("embedding").alias("i", "v"))
    ranks = values.join(d.select("label", "i", "median"), ["label", "i"]).groupBy("label", "i").agg(F.count_if(F.col("v") < F.col("median")).alias("below"), F.count_if(F.col("v") <= F.col("median")).alias("upto"))
    near = (F.col("below") <= 0.51 * F.col("n") + 1) & (F.col("upto") >= 0.49 * F.col("n") - 1)
    return d.join(ranks, ["label", "i"]).select("label", F.col("i").cast("bigint").alias("i"), "n", F.round(F.col("total") / F.col("n"), 6).alias("mean"), F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), near.alias("median_near"))


@query()
def embedding_medians(spark, sf_dir):
    """Median vectors from digests, which are approximate, so without SQL."""
    return sketches.summarise_vectors(inputs.table(spark, sf_dir, "embeddings"), "embedding", "median", "label")


@query(f"""WITH {ENC}, {CELLS}, c AS (SELECT DISTINCT enc.cell, state FROM enc JOIN cells USING (cell)),
s AS (SELECT cell, state FROM (SELECT *, row_number() OVER (PARTITION BY state ORDER BY md5('0:' || cell), cell) AS rn FROM c) WHERE rn <= 20)
SELECT state, token, round(sum(pos / greatest(len - 1, 1)), 6) AS sum_norm_pos, count(*) AS n_cells FROM enc JOIN s USING (cell) GROUP BY 1, 2""")
def isp_positions(spark, sf_dir):
    """Position sums of at most 20 cells a state, so that some states are capped and some are not."""
    sums = profiles.capped_position_sums(inputs.encoded(spark, sf_dir), inputs.cells(spark, sf_dir), 20)
    return sums.withColumn("sum_norm_pos", F.round("sum_norm_pos", 6))


_STEPS = [("overexpress", (15, 9)), ("delete", (604, 77, 120))]
_PLACEBOS = [[(31, 32), (33, 34, 35)], [(9, 41), (42, 43, 44)], [(51, 52), (53, 54, 55)], [(61, 62), (63, 64, 63 + 22)]]


def _undo_sql(number: int, oe: dict, ko: dict) -> str:
    array = lambda x: f"{list(x)}::BIGINT[]"
    oc, op, kc, kp = array(oe), array(oe.values()), array(ko), array(ko.values())
    return f"""SELECT {number} AS placebo, cell, usable, CASE WHEN usable THEN array_to_string(list_filter(restored, lambda x: NOT list_contains(gone, x)), ',') END AS ids,
CASE WHEN usable THEN array_to_string(list_sort(list_distinct(old || nw || gone)), ',') END AS excluded FROM (
SELECT *, list_reduce(list_prepend(new, list_transform(slots, lambda z: [z])), lambda acc, x: CASE WHEN list_contains(acc, x[1]) THEN acc ELSE
  acc[:CASE WHEN len(list_filter(start[1:list_position(start, x[1]) - 1], lambda a: list_contains(acc, a) AND NOT list_contains({op} || {kp}, a))) > 0
    THEN list_position(acc, list_filter(start[1:list_position(start, x[1]) - 1], lambda a: list_contains(acc, a) AND NOT list_contains({op} || {kp}, a))[-1]) ELSE front END] || [x[1]] ||
  acc[CASE WHEN len(list_filter(start[1:list_position(start, x[1]) - 1], lambda a: list_contains(acc, a) AND NOT list_contains({op} || {kp}, a))) > 0
    THEN list_position(acc, list_filter(start[1:list_position(start, x[1]) - 1], lambda a: list_contains(acc, a) AND NOT list_contains({op} || {kp}, a))[-1]) ELSE front END + 1:] END) AS restored FROM (
SELECT *, CASE WHEN NOT list_contains(nw, new[1]) THEN 0 WHEN NOT list_contains(nw, new[2]) THEN 1 ELSE 2 END AS front FROM (
SELECT *, list_transform(list_filter(ids, lambda x: list_contains(old, x) OR NOT list_contains(nw, x)), lambda x: coalesce(nw[list_position(old, x)], x)) AS new,
  len(list_filter(gone, lambda q: NOT list_contains(ids, q))) = 0 AS usable FROM (
SELECT *, list_transform(old, lambda c: ({op})[list_position({oc}, c)]) AS nw, list_transform(slots, lambda c: ({kp})[list_position({kc}, c)]) AS gone FROM (
SELECT *, list_filter({oc}, lambda c: list_contains(ids, c)) AS old, list_filter(start, lambda c: list_contains({kc}, c)) AS slots FROM l)))))"""


_SUBS = counterfactuals.substitutions(_STEPS, _PLACEBOS)
_LISTS = f"""{ENC}, s0 AS (SELECT cell, list(token ORDER BY pos) AS start FROM enc GROUP BY cell),
l AS (SELECT cell, start, list_filter(([15, 9]::BIGINT[] || list_filter(start, lambda x: x NOT IN (15, 9)))[:len(start)], lambda x: x NOT IN (604, 77, 120)) AS ids FROM s0)"""


@query(f"WITH {_LISTS} " + " UNION ALL ".join(_undo_sql(i, dict(s.oe), dict(s.ko)) for i, s in enumerate(_SUBS)))
def undo_delete_redo(spark, sf_dir):
    """Every supplier's list after a chain, as it would be under each usable placebo; one of four shares a key with the chain."""
    cells = encode.to_lists(inputs.encoded(spark, sf_dir)).select("cell", F.col("ids").alias("start"), lists.apply_steps(F.col("ids"), _STEPS).alias("ids"))
    out = counterfactuals.counterfactual_lists(cells, _SUBS)
    return out.select("placebo", "cell", "usable", F.array_join("ids", ",").alias("ids"), F.array_join(F.array_sort("excluded"), ",").alias("excluded"))


# three placebos; k turns of a vector's coordinates are a key's state under one

_TURN = (5, 10, 15)


@query(f"""WITH e AS (SELECT label AS cell, vec_id AS token, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT unnest([0, 1, 2]) AS p),
u AS (SELECT e.*, p, (cell + p) % 4 <> 3 AS usable, cell % 3 = p AS plain, token % 7 <> 0 AS valid FROM e CROSS JOIN p),
g AS (SELECT cell, token, any_value(v) AS v, any_value(valid) AS valid, count(*) FILTER (WHERE usable AND plain) AS plain_n, list(p) FILTER (WHERE usable AND NOT plain AND token % 6 <> p AND token % 5 <> p) AS ps FROM u GROUP BY cell, token),
c AS (SELECT *, CASE WHEN valid THEN plain_n + coalesce(len(ps), 0) ELSE 0 END AS n, unnest(range(64)) AS i FROM g)
SELECT cell, token, i, round(CASE WHEN n > 0 THEN (plain_n * v[i + 1] + coalesce(list_sum(list_transform(ps, lambda p: v[(i + 5 * (p + 1)) % 64 + 1])), 0)) / n - v[64 - i] ELSE 0 END, 6) AS mediator, n AS n_placebos FROM c""")
def placebo_mediator(spark, sf_dir):
    e = inputs.table(spark, sf_dir, "embeddings").select(F.col("label").alias("cell"), F.col("vec_id").alias("token"), F.col("embedding").alias("vec"))
    control = e.where("token % 7 <> 0").withColumn("vec", F.reverse("vec"))
    placebos = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("placebo")
    turned = F.element_at(F.array(*[F.concat(F.slice("vec", k + 1, 64 - k), F.slice("vec", 1, k)) for k in _TURN]), F.col("placebo") + 1)
    states = e.select(placebos, "cell", "token", "vec").where("token % 5 <> placebo").withColumn("vec", turned)
    gone = F.collect_list(F.when(F.col("token") % 6 == F.col("placebo"), F.col("token")))
    edits = e.select(placebos, "cell", "token").groupBy("placebo", "cell").agg(gone.alias("gone"))
    excluded = F.when(F.col("cell") % 3 == F.col("placebo"), F.array().cast("array<bigint>")).otherwise(F.array_append("gone", F.lit(-1).cast("bigint")))
    edits = edits.select("placebo", "cell", ((F.col("cell") + F.col("placebo")) % 4 != 3).alias("usable"), excluded.alias("excluded"))
    out = counterfactuals.placebo_mediator(e, control, edits, states)
    return out.select("cell", "token", F.posexplode("mediator").alias("i", "mediator"), "n_placebos").select("cell", "token", F.col("i").cast("bigint").alias("i"), F.round("mediator", 6).alias("mediator"), "n_placebos")


_CONTEXTS = """e AS (SELECT label AS cell, vec_id AS token, embedding::DOUBLE[] AS v, embedding[1]::DOUBLE AS w FROM embeddings),
l AS (SELECT cell, list(token ORDER BY w DESC, token) AS ids FROM e GROUP BY cell),
k AS (SELECT cell, unnest(list_filter(ids, lambda x: x NOT IN (3, 14, 159))[:greatest(len(ids) - 3, 0)]) AS token FROM l),
cs AS (SELECT cell, token, list_dot_product(v, list_reverse(v)) / list_dot_product(v, v) AS cos FROM k JOIN e USING (cell, token))"""


def _cosines(spark, sf_dir):
    e = inputs.table(spark, sf_dir, "embeddings").select(F.col("label").alias("cell"), F.col("vec_id").alias("token"), F.col("embedding").alias("vec"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("vec")[0]).alias("w"), "token")))
    cells = e.groupBy("cell").agg(F.transform(order, lambda x: x["token"]).alias("ids"))
    return counterfactuals.context_cosines(cells, e, e.withColumn("vec", F.reverse("vec")), (3, 14, 159))


@query(f"WITH {_CONTEXTS} SELECT cell, token, round(cos, 6) AS cos FROM cs")
def context_cosines(spark, sf_dir):
    return _cosines(spark, sf_dir).withColumn("cos", F.round("cos", 6))


@query(f"WITH {_CONTEXTS} SELECT cell, count(*) AS n, round(avg(cos), 6) AS score FROM cs GROUP BY 1")
def context_scores(spark, sf_dir):
    return counterfactuals.context_scores(_cosines(spark, sf_dir)).withColumn("score", F.round("score", 6))


_SAMPLE = f"""{ENC}, u AS (SELECT cell, pos, token, pos / greatest(len - 1, 1) AS base_rank, p_retailprice AS target, row_number() OVER (PARTITION BY cell ORDER BY md5('3:' || cell || ':' || pos), pos) AS rn FROM enc JOIN part ON token = p_partkey + 4)"""


@query(f"WITH {_SAMPLE} SELECT cell, pos, token, round(base_rank, 6) AS base_rank, target FROM u WHERE rn <= 100")
def gene_sample(spark, sf_dir):
    """A hundred keys of each supplier's list, with the retail price for a target."""
    targets = inputs.table(spark, sf_dir, "part").select((F.col("p_partkey") + 4).alias("token"), F.col("p_retailprice").alias("target"))
    return counterfactuals.sampled_keys(inputs.encoded(spark, sf_dir), targets, 100, 3).withColumn("base_rank", F.round("base_rank", 6))


@query("""WITH e AS (SELECT label AS cell, vec_id AS token, embedding::DOUBLE[] AS v, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos, count(*) OVER (PARTITION BY label) AS len FROM embeddings),
s AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY md5('0:' || cell || ':' || pos), pos) AS rn FROM e), t AS (SELECT *, unnest(range(64)) AS i FROM s WHERE rn <= 16)
SELECT cell, token, round(pos / greatest(len - 1, 1), 6) AS base_rank, i, round(CASE WHEN token % 7 <> 0 THEN v[i + 1] - v[(i + 5) % 64 + 1] / 2 ELSE 0 END, 6) AS delta_h, round(CASE WHEN token % 7 <> 0 THEN sqrt(list_dot_product(v, v)) / 2 ELSE 0 END, 6) AS delta_norm FROM t""")
def evaluation_samples(spark, sf_dir):
    """Sixteen keys of each cell with their change of state; the control's vectors are turned and half as long, and every seventh is missing."""
    e = inputs.table(spark, sf_dir, "embeddings").select(F.col("label").alias("cell"), F.col("vec_id").alias("token"), F.col("embedding").cast("array<double>").alias("vec"))
    ordered = encode.from_lists(e.groupBy("cell").agg(F.array_sort(F.collect_list("token")).alias("ids")))
    control = e.where("token % 7 <> 0").withColumn("vec", F.transform(F.concat(F.slice("vec", 6, 59), F.slice("vec", 1, 5)), lambda x: x / 2))
    sample = counterfactuals.sampled_keys(ordered, e.select("token", F.lit(0.0).alias("target")), 16)
    out = counterfactuals.evaluation_samples(sample, e, control)
    return out.select("cell", "token", F.round("base_rank", 6).alias("base_rank"), F.posexplode("delta_h").alias("i", "d"), F.round("delta_norm", 6).alias("delta_norm")).select("cell", "token", "base_rank", F.col("i").cast("bigint").alias("i"), F.round("d", 6).alias("delta_h"), "delta_norm")


# three states stand for chains, of which one is the configured one

_CHANGES = f"""{STATES}, tab AS (SELECT token, r0.rank AS s, r1.rank AS e FROM r0 JOIN r1 USING (token) WHERE r0.n_cells >= 3 AND r1.n_cells >= 3),
ch AS (SELECT CASE c.chain WHEN 'AMERICA' THEN 'configured' ELSE c.chain END AS chain, tab.token, round(coalesce(pb.rank, 1.0) - s, 9) AS d, round(e - s, 9) AS g FROM tab CROSS JOIN (SELECT DISTINCT state AS chain FROM pb WHERE state NOT IN ('{START}', '{GOAL}')) c LEFT JOIN pb ON pb.state = c.chain AND pb.token = tab.token),
sets AS (SELECT 'brand' AS library, p_brand AS term, p_partkey + 4 AS token FROM part UNION ALL SELECT 'size', 's' || p_size, p_partkey + 4 FROM part),
lv AS (SELECT 'gene' AS level, chain, token, d, g FROM ch UNION ALL SELECT library, chain, NULL, round(avg(d), 9), round(avg(g), 9) FROM ch JOIN sets USING (token) GROUP BY library, term, chain HAVING count(*) >= 10),
cu AS (SELECT level, chain, quantile_cont(abs(g), 0.8) AS cut FROM lv GROUP BY 1, 2),
rk AS (SELECT *, rank() OVER (PARTITION BY level, chain ORDER BY d) + (count(*) OVER (PARTITION BY level, chain, d) - 1) / 2.0 AS rd, rank() OVER (PARTITION BY level, chain ORDER BY g) + (count(*) OVER (PARTITION BY level, chain, g) - 1) / 2.0 AS rg FROM lv),
me AS (SELECT level, chain, sum(d * g) / sum(g * g) AS progress, sum(d * g) / sqrt(sum(d * d) * sum(g * g)) AS cosine, corr(rd, rg) AS spearman, 1 - sqrt(sum((g - d) * (g - d))) / sqrt(sum(g * g)) AS distance_closed, avg((sign(d) = sign(g))::INT) FILTER (WHERE abs(g) >= cut AND g <> 0) AS toward_goal FROM rk JOIN cu USING (level, chain) GROUP BY 1, 2),
po AS (SELECT chain, d, row_number() OVER (PARTITION BY chain ORDER BY g, token) - 1 AS at_, count(*) OVER (PARTITION BY chain) AS n FROM lv WHERE level = 'gene'), en AS (SELECT chain, d, at_ >= n - ceil(n * 0.1) AS hi, ceil(n * 0.1) AS k FROM po WHERE at_ < ceil(n * 0.1) OR at_ >= n - ceil(n * 0.1)),
er AS (SELECT *, rank() OVER (PARTITION BY chain ORDER BY d) + (count(*) OVER (PARTITION BY chain, d) - 1) / 2.0 AS r FROM en), au AS (SELECT chain, (sum(r) FILTER (WHERE hi) - any_value(k) * (any_value(k) + 1) / 2) / (any_value(k) * any_value(k)) AS v FROM er GROUP BY 1),
va AS (SELECT level, m AS metric, chain, v AS value FROM (UNPIVOT me ON progress, cosine, spearman, distance_closed, toward_goal INTO NAME m VALUE v) UNION ALL SELECT 'gene', 'auc_goal_gain', chain, v FROM au)"""


def _goal_changes(spark, sf_dir):
    e = inputs.encoded(spark, sf_dir).join(inputs.cells(spark, sf_dir), "cell")
    pb = profiles.state_ranks(e, "state")
    of = lambda state, name: pb.where((F.col("state") == state) & (F.col("n_cells") >= 3)).select("token", F.col("rank").alias(name))
    table = kept(of(START, "start_rank").join(of(GOAL, "goal_rank"), "token"))
    chains = ["AMERICA", "EUROPE", "MIDDLE EAST"]
    wide = pb.groupBy("token").pivot("state", chains).agg(F.first("rank"))
    each = table.join(wide, "token").select("token", "start_rank", F.explode(F.array(*[F.struct(F.lit(closeness.CONFIGURED if c == "AMERICA" else c).alias("chain"), F.col(c).alias("r")) for c in chains])).alias("x"))
    changes = kept(each.select("x.chain", "token", F.round(F.coalesce("x.r", F.lit(1.0)) - F.col("start_rank"), 9).alias("d")))
    return table.select("token", F.round(F.col("goal_rank") - F.col("start_rank"), 9).alias("g")), changes


def _sets(spark, sf_dir):
    part = inputs.table(spark, sf_dir, "part")
    symbol = (F.col("p_partkey") + 4).cast("string").alias("symbol")
    return part.select(F.lit("brand").alias("library"), F.col("p_brand").alias("term"), symbol).unionByName(part.select(F.lit("size").alias("library"), F.concat(F.lit("s"), F.col("p_size").cast("string")).alias("term"), symbol))


def _closeness(spark, sf_dir):
    goal, changes = _goal_changes(spark, sf_dir)
    symbols = goal.select("token", F.col("token").cast("string").alias("symbol"))
    by_key = changes.join(goal, "token").select(F.lit("gene").alias("level"), "chain", "token", "d", "g")
    by_set = closeness.set_changes(changes, goal, _sets(spark, sf_dir), symbols).select(F.col("library").alias("level"), "chain", F.round("d", 9).alias("d"), F.round("g", 9).alias("g"))
    return closeness.values_of(by_key, by_set)


@query(f"WITH {_CHANGES} SELECT level, metric, chain, round(value, 5) AS value FROM va")
def closeness_values(spark, sf_dir):
    """Every metric of the configured chain and of the others, over keys and over two libraries of sets."""
    return _closeness(spark, sf_dir).withColumn("value", F.round("value", 5))


@query(f"""WITH {_CHANGES}, q AS (SELECT level, metric, value FROM va WHERE chain = 'configured'), o AS (SELECT level, metric, value AS v FROM va WHERE chain <> 'configured')
SELECT level, metric, round(any_value(value), 5) AS value, round(avg(v), 5) AS placebo_mean, round(stddev_samp(v), 5) AS placebo_sd, (1 + count(*) FILTER (WHERE v >= value)) / (1.0 + count(*)) AS p_empirical, count(*) AS n_placebos FROM q JOIN o USING (level, metric) GROUP BY 1, 2""")
def closeness_summary(spark, sf_dir):
    out = closeness.against_placebos(_closeness(spark, sf_dir)).drop("z")
    return out.withColumns({c: F.round(c, 5) for c in ("value", "placebo_mean", "placebo_sd")})


# reordering: the control's vectors are half as long, turned, and every seventh is missing; a key's logit is its vector's first coordinate

_KEYS = """e AS (SELECT label AS cell, vec_id AS token, embedding::DOUBLE[] AS v, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos, count(*) OVER (PARTITION BY label) AS len FROM embeddings),
c AS (SELECT *, pos / greatest(len - 1, 1) AS base, CASE WHEN token % 7 <> 0 THEN sqrt(list_dot_product(v, v)) * (1 - (token % 5) / 8.0) ELSE 0 END AS dn, CASE WHEN token % 7 <> 0 THEN v[1] - v[6] * (token % 5) / 8.0 ELSE 0 END AS dl FROM e)"""
_Z = lambda c: f"CASE WHEN stddev_pop({c}) OVER w > 0 THEN ({c} - avg({c}) OVER w) / stddev_pop({c}) OVER w ELSE 0 END"
_MOVED = f"""{_KEYS}, pr AS (SELECT 'norm' AS rule, cell, token, pos, base + greatest(-0.2, least(0.2, -0.1 * {_Z('dn')})) AS p FROM c WINDOW w AS (PARTITION BY cell)
UNION ALL SELECT 'delta_mlm', cell, token, pos, base + greatest(-0.2, least(0.2, -0.1 * {_Z('dl')})) FROM c WINDOW w AS (PARTITION BY cell)
UNION ALL SELECT 'teacher', cell, token, pos, base + greatest(-0.2, least(0.2, CASE WHEN token % 3 = 0 THEN (token % 11 - 5) / 10.0 ELSE 0 END)) FROM c),
mv AS (SELECT rule, cell, token, pos, row_number() OVER (PARTITION BY rule, cell ORDER BY round_even(p / 0.01, 0) * 0.01, pos) - 1 AS new FROM pr)"""


def _reordered(spark, sf_dir):
    e = inputs.table(spark, sf_dir, "embeddings").select(F.col("label").alias("cell"), F.col("vec_id").alias("token"), F.col("embedding").cast("array<double>").alias("vec"))
    ordered = encode.from_lists(e.groupBy("cell").agg(F.array_sort(F.collect_list("token")).alias("ids")))
    turned = F.concat(F.slice("vec", 6, 59), F.slice("vec", 1, 5))
    control = e.where("token % 7 <> 0").withColumn("vec", F.transform(turned, lambda x: x * (F.col("token") % 5) / 8.0))
    logit = lambda df: df.select("cell", "token", F.col("vec")[0].alias("logit"))
    delta = e.where("token % 3 = 0").select("token", ((F.col("token") % 11 - 5) / 10.0).alias("delta")).distinct()
    out = None
    for rule, rows in (("norm", rerank.state_changes(ordered, e, control)), ("delta_mlm", rerank.logit_changes(ordered, logit(e), logit(control))), ("teacher", rerank.with_teacher(ordered, delta))):
        some = rerank.reorder(rows, rerank.shift_of(rule, 0.1, 0.2), 0.01).withColumn("rule", F.lit(rule))
        out = some if out is None else out.unionByName(some)
    return out


@query(f"WITH {_MOVED} SELECT rule, cell, string_agg(token::VARCHAR, ',' ORDER BY new) AS ids FROM mv GROUP BY 1, 2")
def reranked_lists(spark, sf_dir):
    """Every cell's list in the order that three rules give it."""
    return _reordered(spark, sf_dir).select("rule", "cell", F.array_join("after", ",").alias("ids"))


@query(f"""WITH {_MOVED}, cl AS (SELECT rule, cell, 1 - 6 * sum((new - pos) * (new - pos)) / (count(*) * (count(*) * count(*) - 1.0)) AS rho, avg(abs(new - pos)) AS d, avg((new <> pos)::INT) AS f, count(*) FILTER (WHERE new < 10 AND pos < 10) / (20.0 - count(*) FILTER (WHERE new < 10 AND pos < 10)) AS j FROM mv GROUP BY 1, 2)
SELECT rule, count(*) AS n_cells, round(avg(rho), 6) AS spearman, round(avg(d), 6) AS mean_abs_displacement, round(avg(f), 6) AS frac_moved, round(avg(j), 6) AS top_jaccard FROM cl GROUP BY 1""")
def rerank_diagnostics(spark, sf_dir):
    moved, out = _reordered(spark, sf_dir), None
    for rule in ("norm", "delta_mlm", "teacher"):
        some = rerank.diagnostics(moved.where(F.col("rule") == rule), 10).select(F.lit(rule).alias("rule"), "*")
        out = some if out is None else out.unionByName(some)
    return out.select("rule", "n_cells", *[F.round(c, 6).alias(c) for c in ("spearman", "mean_abs_displacement", "frac_moved", "top_jaccard")])


@query("""WITH e AS (SELECT label AS cell, vec_id AS token, embedding::DOUBLE[] AS v, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos, count(*) OVER (PARTITION BY label) AS len FROM embeddings),
x AS (SELECT *, unnest(range(64)) AS i FROM e), g AS (SELECT i, avg(v[i + 1]) AS g FROM x WHERE cell = 0 GROUP BY i),
r AS (SELECT cell, token, len, row_number() OVER (PARTITION BY cell ORDER BY pos) AS rn FROM e WHERE token NOT IN (3, 14, 159)), k AS (SELECT cell, token FROM r WHERE rn <= len - 3),
m AS (SELECT x.cell, x.i, avg(v[i + 1]) FILTER (WHERE k.token IS NOT NULL) AS ao, avg(v[64 - i]) FILTER (WHERE k.token IS NOT NULL) AS ap, avg(v[i + 1]) AS mo, avg(v[64 - i]) FILTER (WHERE pos >= 2) AS mp FROM x LEFT JOIN k ON k.cell = x.cell AND k.token = x.token GROUP BY 1, 2)
SELECT cell, round(sum(ap * g) / sqrt(sum(ap * ap) * sum(g * g)) - sum(ao * g) / sqrt(sum(ao * ao) * sum(g * g)), 5) AS aligned, round(sum(mp * g) / sqrt(sum(mp * mp) * sum(g * g)) - sum(mo * g) / sqrt(sum(mo * mo) * sum(g * g)), 5) AS pooled FROM m JOIN g USING (i) GROUP BY cell""")
def goal_state_shifts(spark, sf_dir):
    """Cells' shifts to the goal state (the mean of cell 0) after an edit, over the keys in both contexts and over whole lists."""
    e = inputs.table(spark, sf_dir, "embeddings").select(F.col("label").alias("cell"), F.col("vec_id").alias("token"), F.col("embedding").cast("array<double>").alias("vec"))
    cells = e.groupBy("cell").agg(F.array_sort(F.collect_list("token")).alias("ids"))
    goal = vectors.mean_vectors(e.where("cell = 0"), "cell", "vec").select("vec")
    after = e.withColumn("vec", F.reverse("vec"))
    aligned = rerank.aligned_goal_shift(cells, e, after, goal, (3, 14, 159), "overexpress").withColumnRenamed("goal_state_shift", "aligned")
    placed = lambda df: encode.from_lists(cells).join(df, ["cell", "token"])
    pooled = rerank.mean_goal_shift(placed(e), placed(after), goal, 2).withColumnRenamed("goal_state_shift", "pooled")
    return aligned.join(pooled, "cell").select("cell", F.round("aligned", 5).alias("aligned"), F.round("pooled", 5).alias("pooled"))
