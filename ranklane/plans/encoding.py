"""Queries of the encoder, the rank edits and the comparisons of lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from ranklane.functions import lists
from ranklane.operators import encode, profiles
from ranklane.plans import inputs
from ranklane.plans.catalogue import query
from ranklane.plans.inputs import C_LISTS, COUNTS, ENC, GOAL, START, STATES
from ranklane.sources.shared import kept

UP, DOWN, CHAIN, PLACEBO = (15, 9, 604), (11, 12, 13, 50, 77), (9, 15, 21), (30, 31, 32)


def _text(ids) -> F.Column:
    return F.array_join(ids, " ")


@query(f"WITH {COUNTS}, v AS (SELECT gene, gene + 4 AS token, quantile_cont(cnt, 0.5) AS med FROM counts GROUP BY gene) SELECT gene, token, round(med, 6) AS med FROM v")
def vocab_intersection(spark, sf_dir):
    return inputs.vocab(inputs.counts(spark, sf_dir)).select("gene", "token", F.round("med", 6).alias("med"))


@query(f"WITH {ENC} SELECT cell, token, round(w, 6) AS w FROM val")
def cell_normalize(spark, sf_dir):
    c = inputs.counts(spark, sf_dir)
    return encode.normalise(c, inputs.vocab(c)).select("cell", "token", F.round("w", 6).alias("w"))


@query(f"WITH {ENC} SELECT cell, pos, token, len FROM enc")
def rank_encode(spark, sf_dir):
    return inputs.encoded(spark, sf_dir)


@query(f"WITH {ENC} SELECT DISTINCT cell, len FROM enc")
def encode_lengths(spark, sf_dir):
    return encode.to_lists(inputs.encoded(spark, sf_dir)).select("cell", F.size("ids").cast("bigint").alias("len"))


@query("SELECT o_orderkey AS cell, o_orderpriority AS file FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS rn FROM orders WHERE o_orderstatus <> 'P') WHERE rn <= 50")
def shard_cap(spark, sf_dir):
    o = inputs.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("cell"), F.col("o_orderkey").alias("cell_ord"), F.col("o_orderpriority").alias("file"), (F.col("o_orderstatus") != "P").cast("int").alias("filter_pass"))
    return encode.cap_per_file(o, 50).select("cell", "file")


@query(f"WITH {STATES} SELECT token, round(rank, 6) AS score FROM (SELECT *, row_number() OVER (ORDER BY rank, token) AS rn, count(*) OVER () AS n FROM r0) WHERE rn <= ceil(n * 0.1)")
def encode_pseudobulk_topfraction(spark, sf_dir):
    """Which parts rank highest in the start state."""
    r = inputs.ranks(spark, sf_dir, START).select("token", F.col("rank").alias("score"))
    return profiles.top_fraction(r, 0.1).select("token", F.round("score", 6).alias("score"))


def _edit(sql: str) -> str:
    return f"WITH {C_LISTS} SELECT cell, array_to_string({sql}, ' ') AS ids FROM lists"


def _not_in(ids: str, gone) -> str:
    return f"list_filter({ids}, lambda x: x NOT IN {tuple(gone)})"


@query(_edit(_not_in("ids", DOWN)))
def edit_delete_group(spark, sf_dir):
    return inputs.customer_lists(spark, sf_dir).select("cell", _text(lists.delete(F.col("ids"), lists.keys(DOWN))).alias("ids"))


@query(_edit(f"list_concat({list(UP)}::BIGINT[], {_not_in('ids', UP)})[1:len(ids)]"))
def edit_overexpress_group(spark, sf_dir):
    return inputs.customer_lists(spark, sf_dir).select("cell", _text(lists.overexpress(F.col("ids"), lists.keys(UP))).alias("ids"))


_STEP1 = f"list_concat({list(UP)}::BIGINT[], {_not_in('ids', UP)})[1:len(ids)]"


@query(f"WITH {C_LISTS}, s AS (SELECT cell, {_STEP1} AS ids FROM lists), t AS (SELECT cell, {_not_in('ids', (604, 11))} AS ids FROM s) SELECT cell, array_to_string(list_concat([77]::BIGINT[], {_not_in('ids', (77, -1))})[1:len(ids)], ' ') AS ids FROM t")
def edit_step_sequence(spark, sf_dir):
    steps = [("oe", UP), ("kd", (604, 11)), ("overexpress", (77,))]
    return inputs.customer_lists(spark, sf_dir).select("cell", _text(lists.apply_steps(F.col("ids"), steps)).alias("ids"))


@query(f"WITH {C_LISTS} SELECT cell, token, array_to_string(list_filter(ids, lambda x: x <> token), ' ') AS ids FROM (SELECT cell, ids, unnest(ids) AS token FROM lists)")
def edit_genomewide_delete_enum(spark, sf_dir):
    each = inputs.customer_lists(spark, sf_dir).select("cell", "ids", F.explode("ids").alias("token"))
    return each.select("cell", "token", _text(F.array_remove(F.col("ids"), F.col("token"))).alias("ids"))


@query(f"WITH {C_LISTS} SELECT cell, pos, array_to_string(list_concat([ids[pos + 1]], list_filter(ids, lambda x, i: i <> pos + 1)), ' ') AS ids FROM (SELECT cell, ids, unnest(range(1, len(ids))) AS pos FROM lists)")
def edit_genomewide_front_enum(spark, sf_dir):
    each = inputs.customer_lists(spark, sf_dir).where(F.size("ids") > 1).select("cell", "ids", F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("pos"))
    return each.select("cell", F.col("pos").cast("bigint").alias("pos"), _text(lists.to_front(F.col("ids"), F.col("pos"))).alias("ids"))


@query(f"WITH {C_LISTS}, p AS (SELECT cell, ids, list_position(ids, 15) - 1 AS a, unnest(range(0, len(ids))) AS o FROM lists WHERE list_contains(ids, 15)) SELECT cell, least(a, o) AS i, greatest(a, o) AS j, array_to_string(list_filter(ids, lambda x, k: k - 1 <> a AND k - 1 <> o), ' ') AS ids FROM p WHERE a <> o")
def edit_anchor_pairs(spark, sf_dir):
    """The anchor key with every other position of its list."""
    at = (F.array_position("ids", F.lit(15)) - 1).cast("int")
    p = inputs.customer_lists(spark, sf_dir).where(F.array_contains("ids", F.lit(15))).select("cell", "ids", at.alias("a"), F.posexplode("ids").alias("o", "token")).where("a <> o")
    return p.select("cell", F.least("a", "o").cast("bigint").alias("i"), F.greatest("a", "o").cast("bigint").alias("j"), _text(lists.remaining(F.col("ids"), F.array("a", "o"))).alias("ids"))


@query(f"WITH {C_LISTS} SELECT cell, array_to_string(CASE WHEN len(f) > 0 THEN f ELSE [-100] END, ' ') AS at FROM (SELECT cell, list_filter(list_transform({list(UP)}, lambda t: coalesce(list_position(ids, t), 0) - 1), lambda p: p >= 0) AS f FROM lists)")
def perturb_index(spark, sf_dir):
    return inputs.customer_lists(spark, sf_dir).select("cell", _text(lists.positions_of(F.col("ids"), lists.keys(UP))).alias("at"))


@query(_edit(f"list_concat(list_filter(ids, lambda x: x IN {DOWN}), list_filter(list_reverse(ids), lambda x: x NOT IN {DOWN}))"))
def edit_pin_front(spark, sf_dir):
    return inputs.customer_lists(spark, sf_dir).select("cell", _text(lists.pin_front(F.col("ids"), F.reverse("ids"), lists.keys(DOWN))).alias("ids"))


_MAP = " ".join(f"WHEN {c} THEN {p}" for c, p in zip(CHAIN, PLACEBO, strict=True))
_ACTIVE = " OR ".join(f"(x = {p} AND list_contains(ids, {c}))" for c, p in zip(CHAIN, PLACEBO, strict=True))


@query(_edit(f"list_transform(list_filter(ids, lambda x: NOT ({_ACTIVE})), lambda x: CASE x {_MAP} ELSE x END)"))
def edit_swap_tokens(spark, sf_dir):
    return inputs.customer_lists(spark, sf_dir).select("cell", _text(lists.swap(F.col("ids"), lists.keys(CHAIN), lists.keys(PLACEBO))).alias("ids"))


@query(f"WITH {C_LISTS}, x AS (SELECT cell, unnest(ids) AS token, generate_subscripts(ids, 1) AS i FROM lists) SELECT cell, array_to_string(list(token ORDER BY round_even((i + token % 13) / 5.0, 0), i), ' ') AS ids FROM x GROUP BY cell")
def edit_priority_permute(spark, sf_dir):
    """Reordered by a priority that is snapped to a grid of five."""
    priority = F.transform("ids", lambda t, i: (i + 1 + F.pmod(t, F.lit(13))).cast("double"))
    return inputs.customer_lists(spark, sf_dir).select("cell", _text(lists.by_priority(F.col("ids"), priority, 5.0)).alias("ids"))


@query(f"WITH {C_LISTS}, x AS (SELECT cell, unnest(ids) AS token, generate_subscripts(ids, 1) - 1 AS pos, len(ids) AS n FROM lists), pr AS (SELECT token, avg(pos) AS p FROM x WHERE cell % 2 = 0 GROUP BY token) SELECT cell, array_to_string(list(token ORDER BY coalesce(p, n + 1.0), pos), ' ') AS ids FROM x LEFT JOIN pr USING (token) WHERE cell % 2 = 1 GROUP BY cell")
def edit_oracle_permute(spark, sf_dir):
    """The odd cells' lists in the order of mean positions in the even cells; unseen keys last, in their own order."""
    x = encode.from_lists(inputs.customer_lists(spark, sf_dir))
    seen = profiles.mean_positions(x.where("cell % 2 = 0")).select("token", F.col("mean_pos").alias("p"))
    j = x.where("cell % 2 = 1").join(seen, "token", "left").select("cell", "token", F.struct(F.coalesce("p", F.col("len") + 1.0).alias("p"), "pos", "token").alias("o"))
    return j.groupBy("cell").agg(_text(F.transform(F.array_sort(F.collect_list("o")), lambda r: r["token"])).alias("ids"))


@query(f"WITH {C_LISTS} SELECT cell, array_to_string(list_concat(ids, list_transform(range(0, 16), lambda x: 0))[1:16], ' ') AS ids, array_to_string(list_transform(range(1, 17), lambda i: CASE WHEN i <= len(ids) THEN 1 ELSE 0 END), ' ') AS mask FROM lists")
def pad_and_mask(spark, sf_dir):
    rows = inputs.customer_lists(spark, sf_dir).withColumnRenamed("ids", "own")
    return rows.select("cell", _text(lists.attention(F.col("own"), 16)).alias("mask"), _text(lists.pad(F.col("own"), 16)).alias("ids"))


@query(f"WITH {C_LISTS}, x AS (SELECT cell, ids, list_filter(list_transform({list(UP)}, lambda t: coalesce(list_position(ids, t), 0) - 1), lambda p: p >= 0) AS v FROM lists) SELECT cell, array_to_string(list_concat(v, list_filter(list_transform(range(1, len(ids) + 1), lambda i: len(ids) - i), lambda p: NOT list_contains(v, p)))[1:3], ' ') AS at FROM x")
def alignment_indices(spark, sf_dir):
    ids = F.col("ids")
    return inputs.customer_lists(spark, sf_dir).select("cell", _text(lists.alignment_positions(lists.positions_of(ids, lists.keys(UP)), F.size(ids), F.lit(3))).alias("at"))


# comparisons of lists: each list against itself after the edits above

_BEFORE_AFTER = f"""WITH {C_LISTS}, after AS (SELECT cell, {_STEP1} AS ids2 FROM lists),
a AS (SELECT cell, unnest(ids) AS token, generate_subscripts(ids, 1) - 1 AS pos FROM lists),
b AS (SELECT cell, unnest(ids2) AS token, generate_subscripts(ids2, 1) - 1 AS pos FROM after)"""


def _pair(spark, sf_dir):
    before = inputs.customer_lists(spark, sf_dir)
    after = before.select("cell", lists.overexpress(F.col("ids"), lists.keys(UP)).alias("ids"))
    return encode.from_lists(before), encode.from_lists(after)


@query(f"{_BEFORE_AFTER} SELECT b.cell, b.token, b.pos, coalesce(a.pos, -1) AS right_pos, a.pos IS NOT NULL AS valid FROM b LEFT JOIN a ON a.cell = b.cell AND a.token = b.token")
def align_tokens_left(spark, sf_dir):
    before, after = _pair(spark, sf_dir)
    return profiles.align_left(after, before).withColumns({"pos": F.col("pos").cast("bigint"), "right_pos": F.col("right_pos").cast("bigint")})


@query(f"{_BEFORE_AFTER} SELECT a.cell, a.token, a.pos AS pos_a, b.pos AS pos_b FROM a JOIN b ON a.cell = b.cell AND a.token = b.token")
def shared_token_pairs(spark, sf_dir):
    out = profiles.shared(*_pair(spark, sf_dir))
    return out.withColumns({"pos_a": F.col("pos_a").cast("bigint"), "pos_b": F.col("pos_b").cast("bigint")})


_METRICS = f"""{_BEFORE_AFTER}, s AS (SELECT a.cell, abs(b.pos - a.pos) AS d, row_number() OVER (PARTITION BY a.cell ORDER BY a.pos) AS ra, row_number() OVER (PARTITION BY a.cell ORDER BY b.pos) AS rb FROM a JOIN b ON a.cell = b.cell AND a.token = b.token),
m AS (SELECT cell, count(*) AS n_shared, corr(ra, rb) AS spearman, quantile_cont(d, 0.5) AS disp_median, quantile_cont(d, 0.9) AS disp_p90, max(d)::DOUBLE AS disp_max, avg(CASE WHEN d > 0 THEN 1 ELSE 0 END) AS frac_moved FROM s GROUP BY cell HAVING count(*) >= 2)"""


@query(f"{_METRICS} SELECT cell, n_shared, round(spearman, 6) AS spearman, round(disp_median, 6) AS disp_median, round(disp_p90, 6) AS disp_p90, disp_max, round(frac_moved, 6) AS frac_moved FROM m")
def pair_metrics(spark, sf_dir):
    m = profiles.pair_metrics(*_pair(spark, sf_dir)).where("n_shared >= 2")
    return m.select("cell", "n_shared", *[F.round(c, 6).alias(c) for c in ("spearman", "disp_median", "disp_p90", "disp_max", "frac_moved")])


@query(f"{_METRICS}, l AS (UNPIVOT (SELECT cell, spearman, disp_median, frac_moved FROM m) ON spearman, disp_median, frac_moved INTO NAME metric VALUE v) SELECT metric, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.25), 6) AS q25, round(quantile_cont(v, 0.75), 6) AS q75 FROM l WHERE v IS NOT NULL AND NOT isnan(v) GROUP BY metric")
def chain_drift_summary(spark, sf_dir):
    out = profiles.summarise(profiles.pair_metrics(*_pair(spark, sf_dir)), ["spearman", "disp_median", "frac_moved"])
    return out.select("metric", *[F.round(c, 6).alias(c) for c in ("median", "q25", "q75")])


@query(f"WITH {C_LISTS}, x AS (SELECT cell, ids[1:5] AS p, {_STEP1}[1:5] AS q FROM lists) SELECT cell, round(len(list_intersect(p, q)) / len(list_distinct(list_concat(p, q))), 6) AS jaccard FROM x")
def topk_jaccard(spark, sf_dir):
    after = lists.overexpress(F.col("ids"), lists.keys(UP))
    return inputs.customer_lists(spark, sf_dir).select("cell", F.round(lists.topk_jaccard(F.col("ids"), after, 5), 6).alias("jaccard"))


# profiles of states

@query(f"WITH {STATES} SELECT state, token, round(s, 6) AS sum_norm_pos, n_cells FROM sums")
def position_sums(spark, sf_dir):
    e = inputs.encoded(spark, sf_dir).join(inputs.cells(spark, sf_dir), "cell")
    return profiles.position_sums(e, "state").withColumn("sum_norm_pos", F.round("sum_norm_pos", 6))


@query(f"WITH {STATES} SELECT state, token, round(rank, 6) AS rank, n_cells FROM pb")
def pseudobulk_rank(spark, sf_dir):
    e = inputs.encoded(spark, sf_dir).join(inputs.cells(spark, sf_dir), "cell")
    return profiles.pseudobulk(profiles.position_sums(e, "state"), profiles.cells_per(e, "state"), "state").withColumn("rank", F.round("rank", 6))


@query(f"WITH {STATES} SELECT token, round(coalesce(r1.rank, 1.0) - coalesce(r0.rank, 1.0), 6) AS delta FROM r0 FULL JOIN r1 USING (token)")
def displacement_outer(spark, sf_dir):
    return profiles.displacement(*inputs.ranks_of(spark, sf_dir, START, GOAL)).withColumn("delta", F.round("delta", 6))


@query(f"WITH {STATES} SELECT token FROM r0 WHERE n_cells >= 3 INTERSECT SELECT token FROM r1 WHERE n_cells >= 3")
def background_both(spark, sf_dir):
    return profiles.background(*inputs.ranks_of(spark, sf_dir, START, GOAL), 3)


@query(f"WITH {STATES} SELECT token FROM (SELECT token FROM r0 WHERE n_cells >= 3 UNION SELECT token FROM r1 WHERE n_cells >= 3) WHERE token NOT IN (10, 20, 30)")
def background_either(spark, sf_dir):
    out = spark.createDataFrame([(10,), (20,), (30,)], "token bigint")
    return profiles.background(*inputs.ranks_of(spark, sf_dir, START, GOAL), 3, "either", out)


_PROFILES = f"{STATES}, prof AS (SELECT token, count(*) / (SELECT n FROM tot WHERE state = '{START}') AS detection, quantile_cont(pos / greatest(len - 1, 1), 0.5) AS med_pos FROM es WHERE state = '{START}' GROUP BY token)"


@query(f"WITH {_PROFILES} SELECT token, round(detection, 6) AS detection, round(med_pos, 6) AS med_pos FROM prof")
def start_profiles(spark, sf_dir):
    e = inputs.in_state(spark, sf_dir, START)
    return profiles.start_profiles(e, profiles.cells_per(e)).select("token", F.round("detection", 6).alias("detection"), F.round("med_pos", 6).alias("med_pos"))


def _stratum_sql(least: int) -> str:
    n = lambda w: f"count(*) FILTER (WHERE gap <= {w}) OVER (PARTITION BY target)"
    return f"""WITH {_PROFILES}, near AS (SELECT t.token AS target, p.token, abs(p.med_pos - t.med_pos) AS gap FROM prof t JOIN prof p ON p.detection >= t.detection / 2 AND p.detection <= t.detection * 2 AND p.token <> t.token),
w AS (SELECT *, CASE WHEN {n(0.1)} >= {least} THEN 0.1 WHEN {n(0.2)} >= {least} THEN 0.2 WHEN {n(0.3)} >= {least} THEN 0.3 ELSE 9.0 END AS lim FROM near)
SELECT target, token, lim::DOUBLE AS rank_window FROM w WHERE gap <= lim"""


@query(_stratum_sql(200))
def stratum_band_match(spark, sf_dir):
    e = kept(inputs.in_state(spark, sf_dir, START))
    p = kept(profiles.start_profiles(e, profiles.cells_per(e)).select("token", "detection", F.col("med_pos").alias("rank")))
    out = profiles.stratum(p, p, 200)
    return out.withColumn("rank_window", F.when(F.col("rank_window") > 1, 9.0).otherwise(F.col("rank_window")))


@query(f"WITH {_PROFILES} SELECT token FROM prof WHERE detection BETWEEN 0.5 * 0.3 AND 2.0 * 0.3")
def detection_matched_pool(spark, sf_dir):
    e = inputs.in_state(spark, sf_dir, START)
    return profiles.detection_pool(profiles.start_profiles(e, profiles.cells_per(e)), 0.3).select("token")


_MEANS = f"""{STATES}, ml AS (SELECT state, greatest(avg(len) - 1, 1.0) AS d FROM (SELECT DISTINCT state, cell, len FROM es) GROUP BY state),
mp AS (SELECT state, token, avg(pos) / any_value(d) AS p FROM es JOIN ml USING (state) GROUP BY state, token HAVING count(*) >= 2)"""


@query(f"WITH {_MEANS} SELECT a.token, round(b.p - a.p, 6) AS delta FROM mp a JOIN mp b ON a.token = b.token WHERE a.state = '{START}' AND b.state = '{GOAL}'")
def observed_delta_rank(spark, sf_dir):
    return profiles.observed_delta(inputs.in_state(spark, sf_dir, START), inputs.in_state(spark, sf_dir, GOAL), 2).withColumn("delta", F.round("delta", 6))


# chains: the other states stand for chains whose final ranks differ from the start's

_CHAINS = f"""{STATES}, toks AS (SELECT DISTINCT token FROM pb), chains AS (SELECT DISTINCT state AS chain FROM pb WHERE state <> '{START}'),
disp AS (SELECT chain, token, coalesce(f.rank, 1.0) - coalesce(s.rank, 1.0) AS delta FROM chains CROSS JOIN toks LEFT JOIN pb f ON f.state = chain AND f.token = toks.token LEFT JOIN r0 s ON s.token = toks.token),
disp1 AS (SELECT chain, toks.token, delta FROM disp JOIN toks USING (token)),
members AS (SELECT chain, token FROM disp1 WHERE token % 40 = length(chain)),
used AS (SELECT d.chain, d.token, d.delta, m.token IS NULL AS free FROM disp1 d LEFT JOIN members m ON d.chain = m.chain AND d.token = m.token)"""
_CHAINS = _CHAINS.replace("SELECT chain, token, coalesce(f.rank", "SELECT chain, toks.token, coalesce(f.rank")


def _all_ranks(spark, sf_dir):
    """(state, token, rank, n_cells) of every state, from sums that are written once for all that reads them."""
    e = inputs.encoded(spark, sf_dir).join(inputs.cells(spark, sf_dir), "cell")
    return profiles.state_ranks(e, "state")


def _chains(spark, sf_dir, pb=None):
    pb = _all_ranks(spark, sf_dir) if pb is None else pb
    s0 = pb.where(F.col("state") == START).select("token", F.col("rank").alias("s"))
    states = [r[0] for r in inputs.table(spark, sf_dir, "region").select("r_name").collect() if r[0] != START]
    wide = pb.groupBy("token").pivot("state", states).agg(F.first("rank"))  # one row a token: dense over the chains
    dense = wide.join(s0, "token", "left").select("token", "s", F.explode(F.array(*[F.struct(F.lit(c).alias("chain"), F.col(c).alias("r")) for c in states])).alias("x"))
    disp = dense.select("x.chain", "token", (F.coalesce("x.r", F.lit(1.0)) - F.coalesce("s", F.lit(1.0))).alias("delta"))
    return disp, disp.where(F.col("token") % 40 == F.length("chain")).select("chain", "token")


_DELTA = f"""{_CHAINS}, ds AS (SELECT token, max(delta) FILTER (WHERE chain = '{GOAL}') AS delta_configured, avg(delta) FILTER (WHERE chain <> '{GOAL}' AND free) AS delta_placebo_mean, count(*) FILTER (WHERE chain <> '{GOAL}' AND free) AS n_placebos FROM used GROUP BY token)"""


@query(f"WITH {_DELTA} SELECT token, round(delta_configured, 6) AS delta_configured, round(delta_placebo_mean, 6) AS delta_placebo_mean, n_placebos, round(delta_configured - delta_placebo_mean, 6) AS delta_spec FROM ds")
def delta_spec(spark, sf_dir):
    out = profiles.delta_spec(*_swap(_chains(spark, sf_dir)))
    return out.select("token", *[F.round(c, 6).alias(c) for c in ("delta_configured", "delta_placebo_mean", "delta_spec")], "n_placebos")


def _swap(pair):
    return pair[0], GOAL, pair[1]


@query(f"""WITH {_CHAINS}, p AS (SELECT *, CASE WHEN free THEN delta END AS u FROM used WHERE chain <> '{GOAL}'),
q AS (SELECT a.chain, a.token, a.delta, a.free, avg(b.u) AS others FROM p a LEFT JOIN p b ON a.token = b.token AND a.chain <> b.chain GROUP BY ALL)
SELECT chain, token, round(CASE WHEN free THEN coalesce(delta - others, 0.0) ELSE 0.0 END, 6) AS pseudo FROM q""")
def loo_contrast(spark, sf_dir):
    return profiles.leave_one_out(*_swap(_chains(spark, sf_dir))).withColumn("pseudo", F.round("pseudo", 6))


@query(f"""WITH {_DELTA}, bg AS (SELECT token FROM r0 WHERE n_cells >= 3 INTERSECT SELECT token FROM r1 WHERE n_cells >= 3)
SELECT token, round(coalesce(r0.rank, 1.0), 6) AS start_rank, round(coalesce(r1.rank, 1.0), 6) AS goal_rank, round(coalesce(delta_configured - delta_placebo_mean, 0.0), 6) AS delta_spec, round(coalesce(r0.rank, 1.0) + coalesce(delta_configured - delta_placebo_mean, 0.0), 6) AS predicted_rank
FROM bg LEFT JOIN r0 USING (token) LEFT JOIN r1 USING (token) LEFT JOIN ds USING (token)""")
def rank_table(spark, sf_dir):
    pb = _all_ranks(spark, sf_dir)
    r0, r1 = (pb.where(F.col("state") == s).drop("state") for s in (START, GOAL))
    out = profiles.rank_table(profiles.background(r0, r1, 3), r0, r1, profiles.delta_spec(*_swap(_chains(spark, sf_dir, pb))))
    return out.select("token", *[F.round(c, 6).alias(c) for c in ("start_rank", "goal_rank", "delta_spec", "predicted_rank")])


