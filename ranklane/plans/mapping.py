"""Queries of key mapping, annotation and contracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ranklane.functions import text
from ranklane.operators import annotate, contracts, keymap
from ranklane.plans import inputs
from ranklane.plans.catalogue import query
from ranklane.plans.inputs import CELLS, COUNTS, GOAL, START

# a relation: parts are sources (ENS ids with versions, every seventh a symbol), brand and size make targets

_REL = """rel AS (SELECT CASE WHEN p_partkey % 7 = 0 THEN p_brand || p_size ELSE 'ENS' || (p_partkey % 900) END AS source, 'ENSG' || p_brand || p_size AS target,
CASE WHEN p_size % 3 = 0 THEN 'ortholog_one2one' WHEN p_size % 3 = 1 THEN 'ortholog_one2many' ELSE 'ortholog_many2many' END AS kind, p_partkey AS ord FROM part),
cur AS (SELECT 'ENS' || (p_partkey % 900) AS source, 'ENSG' || p_brand || p_size AS target, '' AS kind, p_partkey AS ord FROM part WHERE p_partkey % 25 = 1)"""


def _rel(spark, sf_dir):
    p = inputs.table(spark, sf_dir, "part")
    ens = F.concat(F.lit("ENS"), (F.col("p_partkey") % 900).cast("string"))
    target = F.concat(F.lit("ENSG"), F.col("p_brand"), F.col("p_size").cast("string"))
    kind = F.when(F.col("p_size") % 3 == 0, "ortholog_one2one").when(F.col("p_size") % 3 == 1, "ortholog_one2many").otherwise("ortholog_many2many")
    rel = p.select(F.when(F.col("p_partkey") % 7 == 0, F.concat("p_brand", F.col("p_size").cast("string"))).otherwise(ens).alias("source"), target.alias("target"), kind.alias("kind"), F.col("p_partkey").alias("ord"))
    cur = p.where("p_partkey % 25 = 1").select(ens.alias("source"), target.alias("target"), F.lit("").alias("kind"), F.col("p_partkey").alias("ord"))
    return rel, cur


@query(f"WITH {_REL} SELECT source, arg_max(target, ord) AS target FROM rel GROUP BY source")
def ortholog_legacy_last_wins(spark, sf_dir):
    return keymap.last_wins(_rel(spark, sf_dir)[0])


@query(f"WITH {_REL} SELECT source, min(target) AS target FROM rel GROUP BY source")
def ortholog_best_of_n(spark, sf_dir):
    return keymap.smallest_target(_rel(spark, sf_dir)[0])


_ONE = f"""{_REL}, c AS (SELECT * FROM rel WHERE kind = 'ortholog_one2one'), pr AS (SELECT DISTINCT source, target FROM c WHERE starts_with(source, 'ENS') OR starts_with(source, 'FBgn')),
one AS (SELECT source, target FROM pr WHERE source IN (SELECT source FROM pr GROUP BY source HAVING count(*) = 1) AND target IN (SELECT target FROM pr GROUP BY target HAVING count(*) = 1)
UNION ALL SELECT source, arg_min(target, ord) FROM c WHERE NOT (starts_with(source, 'ENS') OR starts_with(source, 'FBgn')) GROUP BY source),
hand AS (SELECT source, arg_max(target, ord) AS target FROM cur GROUP BY source), ov AS (SELECT source, coalesce(hand.target, one.target) AS target FROM one FULL JOIN hand USING (source)),
m AS (SELECT *, starts_with(source, 'ENS') AS pri, source IN (SELECT source FROM cur) AS pref FROM ov),
tab AS (SELECT source, target FROM (SELECT *, count(*) OVER (PARTITION BY target, pri) AS n, sum(CASE WHEN pref THEN 1 ELSE 0 END) OVER (PARTITION BY target, pri) AS k FROM m) WHERE NOT pri OR n = 1 OR (k = 1 AND pref))"""


@query(f"WITH {_ONE} SELECT source, target FROM one")
def ortholog_one2one(spark, sf_dir):
    return keymap.one2one(_rel(spark, sf_dir)[0])


@query(f"WITH {_ONE} SELECT source, target FROM ov")
def curated_override(spark, sf_dir):
    rel, cur = _rel(spark, sf_dir)
    return keymap.override(keymap.one2one(rel), cur)


@query(f"WITH {_ONE} SELECT source, target FROM tab")
def collision_drop(spark, sf_dir):
    rel, cur = _rel(spark, sf_dir)
    return keymap.load(rel, cur, "one2one")


_RESOLVE = f"""{_ONE}, keys AS (SELECT DISTINCT CASE WHEN l_partkey % 5 = 0 THEN 'sym' || (l_partkey % 400) WHEN l_partkey % 5 = 1 THEN 'ENSG' || (l_partkey % 300) || '.2' ELSE 'ENS' || (l_partkey % 900) || '.' || (l_partkey % 3) END AS key FROM lineitem),
syms AS (SELECT 'SYM' || g AS symbol, 'ENS' || g AS id FROM (SELECT unnest(range(0, 400)) AS g)),
k AS (SELECT key, CASE WHEN starts_with(key, 'ENS') THEN split_part(key, '.', 1) ELSE key END AS norm FROM keys),
res AS (SELECT key, coalesce(a.target, b.target, s.target, CASE WHEN starts_with(norm, 'ENSG') THEN norm END) AS target, CASE WHEN coalesce(a.target, b.target) IS NOT NULL THEN 'table' WHEN s.target IS NOT NULL THEN 'symbol' WHEN starts_with(norm, 'ENSG') THEN 'native' ELSE 'unmapped' END AS via
FROM k LEFT JOIN tab a ON a.source = key LEFT JOIN tab b ON b.source = norm LEFT JOIN (SELECT symbol, target FROM syms JOIN tab ON tab.source = id) s ON s.symbol = upper(key) AND NOT starts_with(key, 'ENS'))"""


def _keys(spark, sf_dir):
    k = F.col("l_partkey")
    s = lambda x: x.cast("string")
    name = F.when(k % 5 == 0, F.concat(F.lit("sym"), s(k % 400))).when(k % 5 == 1, F.concat(F.lit("ENSG"), s(k % 300), F.lit(".2"))).otherwise(F.concat(F.lit("ENS"), s(k % 900), F.lit("."), s(k % 3)))
    return inputs.table(spark, sf_dir, "lineitem").select(name.alias("key"), F.col("l_suppkey").alias("file")).distinct()


def _resolved(spark, sf_dir):
    rel, cur = _rel(spark, sf_dir)
    symbols = spark.range(400).select(F.concat(F.lit("SYM"), F.col("id").cast("string")).alias("symbol"), F.concat(F.lit("ENS"), F.col("id").cast("string")).alias("id"))
    return keymap.resolve(_keys(spark, sf_dir).select("key").distinct(), keymap.load(rel, cur, "one2one"), symbols, "ENSG")


@query(f"WITH {_RESOLVE} SELECT key, target, via FROM res")
def resolve_id_priority(spark, sf_dir):
    return _resolved(spark, sf_dir)


@query(f"WITH {_RESOLVE}, o AS (SELECT key, target, row_number() OVER (ORDER BY key) AS ord FROM res), f AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY ord) AS rn FROM o) SELECT ord, key, CASE WHEN rn = 1 THEN target END AS target FROM f")
def convert_perturbation_list(spark, sf_dir):
    from pyspark.sql import Window

    res = _resolved(spark, sf_dir)
    keys = res.select("key", F.row_number().over(Window.orderBy("key")).alias("ord"))
    return keymap.convert_ordered(keys, res)


_TABLE = "tb AS (SELECT p_partkey AS source, p_brand || p_size AS target FROM part WHERE p_partkey % 11 <> 0)"


def _table(spark, sf_dir):
    return inputs.table(spark, sf_dir, "part").where("p_partkey % 11 <> 0").select(F.col("p_partkey").alias("source"), F.concat("p_brand", F.col("p_size").cast("string")).alias("target"))


@query(f"WITH {COUNTS}, {_TABLE} SELECT cell, target AS gene, sum(cnt) AS cnt FROM counts JOIN tb ON gene = source GROUP BY ALL")
def matrix_collapse_sum(spark, sf_dir):
    return keymap.collapse_sum(inputs.counts(spark, sf_dir), _table(spark, sf_dir))


@query(f"""WITH {COUNTS}, {_TABLE}, j AS (SELECT cell, source, target, cnt FROM counts JOIN tb ON gene = source), dense AS (SELECT s.source, s.target, coalesce(j.cnt, 0) AS cnt FROM (SELECT DISTINCT source, target FROM j) s CROSS JOIN (SELECT DISTINCT cell FROM counts) c LEFT JOIN j ON j.source = s.source AND j.cell = c.cell),
m AS (SELECT target, source, quantile_cont(cnt, 0.5) AS m FROM dense GROUP BY 1, 2), b AS (SELECT target, source FROM m QUALIFY row_number() OVER (PARTITION BY target ORDER BY m DESC, source) = 1) SELECT cell, j.target AS gene, cnt FROM j JOIN b USING (target, source)""")
def matrix_collapse_best_median(spark, sf_dir):
    c = inputs.counts(spark, sf_dir)
    return keymap.collapse_best(c, _table(spark, sf_dir), c.select("cell").distinct().count())


_INSPECT = f"""{_RESOLVE}, allr AS (SELECT source, target, kind, 0 AS hand FROM rel UNION ALL SELECT source, target, kind, 1 FROM cur), ix AS (SELECT DISTINCT CASE WHEN starts_with(source, 'ENS') THEN split_part(source, '.', 1) ELSE source END AS norm, target, kind, hand FROM allr),
fd AS (SELECT key, norm, coalesce(string_agg(DISTINCT ix.target, ',' ORDER BY ix.target), '') AS candidates, coalesce(string_agg(DISTINCT nullif(kind, ''), ',' ORDER BY nullif(kind, '')), '') AS kinds, coalesce(max(hand), 0) AS curated FROM k LEFT JOIN ix USING (norm) GROUP BY key, norm),
ins AS (SELECT key, candidates, kinds, tab.target, CASE WHEN tab.target IS NOT NULL AND curated = 1 THEN 'curated_bridge' WHEN tab.target IS NOT NULL THEN 'mapped_one2one' WHEN kinds LIKE '%one2many%' THEN 'ortholog_one2many' WHEN kinds LIKE '%many2many%' THEN 'ortholog_many2many' WHEN kinds <> '' THEN 'dropped_ambiguous' ELSE 'no_ortholog' END AS status, curated FROM fd LEFT JOIN tab ON tab.source = norm)"""


def _inspected(spark, sf_dir):
    rel, cur = _rel(spark, sf_dir)
    return keymap.inspect(_keys(spark, sf_dir).select("key"), rel, cur, keymap.load(rel, cur, "one2one"))


@query(f"WITH {_INSPECT} SELECT * FROM ins")
def mapping_inspection(spark, sf_dir):
    return _inspected(spark, sf_dir)


@query(f"""WITH {_RESOLVE}, kf AS (SELECT DISTINCT l_suppkey AS file, CASE WHEN l_partkey % 5 = 0 THEN 'sym' || (l_partkey % 400) WHEN l_partkey % 5 = 1 THEN 'ENSG' || (l_partkey % 300) || '.2' ELSE 'ENS' || (l_partkey % 900) || '.' || (l_partkey % 3) END AS key FROM lineitem),
voc AS (SELECT DISTINCT target FROM rel WHERE ord % 2 = 0), lv AS (SELECT file, key FROM kf UNION ALL SELECT NULL, key FROM (SELECT DISTINCT key FROM kf)), pt AS (SELECT file, r.target, count(*) AS n, max(CASE WHEN voc.target IS NOT NULL THEN 1 END) AS known FROM lv JOIN res r USING (key) LEFT JOIN voc ON voc.target = r.target GROUP BY ALL)
SELECT file, sum(n)::BIGINT AS n_input, coalesce(sum(n) FILTER (WHERE target IS NOT NULL), 0)::BIGINT AS n_mapped, (sum(n) - coalesce(sum(n) FILTER (WHERE target IS NOT NULL), 0))::BIGINT AS n_unmapped, round(100.0 * coalesce(sum(n) FILTER (WHERE target IS NOT NULL), 0) / sum(n), 2) AS pct_mapped, count(target) AS n_targets, count(*) FILTER (WHERE target IS NOT NULL AND n > 1) AS n_many_to_one, count(known) AS n_in_vocab FROM pt GROUP BY file""")
def conversion_report_grouping_sets(spark, sf_dir):
    known = _rel(spark, sf_dir)[0].where("ord % 2 = 0").select(F.col("target").alias("gene")).distinct()
    return keymap.conversion_report(_keys(spark, sf_dir), _resolved(spark, sf_dir), known)


@query(f"""WITH {_INSPECT}, crit AS (SELECT DISTINCT p_type AS critical_set, 'ENS' || (p_partkey % 900) || '.' || (p_partkey % 3) AS key FROM part),
j AS (SELECT critical_set, crit.key, here.key IS NOT NULL AS here, ins.target, coalesce(status, 'no_ortholog') AS status FROM crit LEFT JOIN (SELECT DISTINCT key FROM keys) here USING (key) LEFT JOIN ins USING (key)),
g AS (SELECT critical_set, count(*) AS n, count(*) FILTER (WHERE here) AS n_present, count(*) FILTER (WHERE here AND target IS NULL) AS n_lost, count(*) FILTER (WHERE here AND target IS NULL AND status <> 'ortholog_one2many') AS n_block FROM j GROUP BY 1)
SELECT critical_set, n, n_present, n_lost, CASE WHEN n_present = 0 THEN 'not_applicable' WHEN n_block > 0 THEN 'block' WHEN n_lost > 0 THEN 'warn' ELSE 'pass' END AS verdict FROM g""")
def loss_gate_verdict(spark, sf_dir):
    k = F.col("p_partkey")
    crit = inputs.table(spark, sf_dir, "part").select(F.col("p_type").alias("critical_set"), F.concat(F.lit("ENS"), (k % 900).cast("string"), F.lit("."), (k % 3).cast("string")).alias("key"))
    return keymap.loss_gate(crit, _keys(spark, sf_dir).select("key"), _inspected(spark, sf_dir), ("ortholog_one2many",))


@query("SELECT n_name AS name, n_name AS first_spelling, lower(n_name) AS id FROM nation")
def symbol_lookup(spark, sf_dir):
    n = inputs.table(spark, sf_dir, "nation")
    symbols = n.select(F.lower("n_name").alias("symbol"), F.lower("n_name").alias("id"))
    found = keymap.lookup_symbols(n.select(F.col("n_name").alias("name")), symbols)
    return found.select("name", text.spellings(F.col("name"))[0].alias("first_spelling"), "id")


# annotation: types of parts are labels, parts with small sizes their core markers

_PANEL = "panel AS (SELECT p_type AS label, CASE WHEN p_size <= 20 THEN 'core' WHEN p_size <= 30 THEN 'support' ELSE 'anti' END AS role, p_partkey AS gene FROM part WHERE p_size <= 36)"
_LOGS = f"{COUNTS}, logs AS (SELECT cell, gene, ln(1 + cnt / sum(cnt) OVER (PARTITION BY cell) * 10000.0) AS x FROM counts)"
_SCORES = f"""{_LOGS}, {_PANEL}, sz AS (SELECT label, role, count(*) AS m FROM panel GROUP BY 1, 2), al AS (SELECT cell, sum(x) AS all_x FROM logs GROUP BY 1), ng AS (SELECT count(*) AS n FROM part),
ins AS (SELECT cell, label, role, sum(x) AS in_x, count(*) FILTER (WHERE x > 0) AS hits FROM logs JOIN panel USING (gene) GROUP BY ALL),
sc AS (SELECT al.cell, sz.label, sz.role, coalesce(in_x, 0) / m - (all_x - coalesce(in_x, 0)) / (ng.n - m) AS score, coalesce(hits, 0) AS hits FROM al CROSS JOIN sz CROSS JOIN ng LEFT JOIN ins ON ins.cell = al.cell AND ins.label = sz.label AND ins.role = sz.role)"""


def _scores(spark, sf_dir):
    part = inputs.table(spark, sf_dir, "part")
    panel = part.where("p_size <= 36").select(F.col("p_type").alias("label"), F.when(F.col("p_size") <= 20, "core").when(F.col("p_size") <= 30, "support").otherwise("anti").alias("role"), F.col("p_partkey").alias("gene"))
    return annotate.marker_scores(annotate.log_normalise(inputs.counts(spark, sf_dir)), panel, part.count())


@query(f"WITH {_SCORES} SELECT cell, label, role, round(score, 5) AS score FROM sc")
def marker_score_fallback(spark, sf_dir):
    return _scores(spark, sf_dir).select("cell", "label", "role", F.round("score", 5).alias("score"))


@query(f"WITH {_SCORES} SELECT cell, label, hits FROM sc WHERE role = 'core'")
def detected_hits(spark, sf_dir):
    return _scores(spark, sf_dir).where("role = 'core'").select("cell", "label", "hits")


_LADDER = f"""{_SCORES}, cp AS (SELECT cell, label, max(score) FILTER (WHERE role = 'core') AS core, max(hits) FILTER (WHERE role = 'core') AS hits, max(score) FILTER (WHERE role = 'support') AS s, max(score) FILTER (WHERE role = 'anti') AS a FROM sc GROUP BY 1, 2),
tt AS (SELECT cell, label, core, CASE WHEN hits >= 2 THEN core + 0.35 * greatest(coalesce(s, 0), 0) - 0.75 * greatest(coalesce(a, 0), 0) END AS score FROM cp),
rk AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY coalesce(score, -1e308) DESC, label) AS r, CASE WHEN score IS NOT NULL AND core >= 0.2 THEN 1 ELSE 0 END AS ok FROM tt),
rc AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY ok DESC, core DESC, label) AS c FROM rk),
w AS (SELECT cell, max(label) FILTER (WHERE r = 1) AS l0, max(label) FILTER (WHERE r = 2) AS l1, max(score) FILTER (WHERE r = 1) AS s0, max(score) FILTER (WHERE r = 2) AS s1, max(label) FILTER (WHERE c = 1 AND ok = 1) AS c0, max(label) FILTER (WHERE c = 2 AND ok = 1) AS c1, max(core) FILTER (WHERE c = 1 AND ok = 1) AS k0, max(core) FILTER (WHERE c = 2 AND ok = 1) AS k1 FROM rc GROUP BY cell)"""


@query(f"""WITH {_LADDER} SELECT cell, CASE WHEN s0 IS NULL OR s0 < 0.2 THEN 'Ambiguous' WHEN k1 IS NOT NULL AND k0 > 0 AND k1 >= 0.6 * k0 THEN 'Doublet_suspected' WHEN k1 IS NOT NULL AND k0 > 0 AND k1 >= 0.5 * k0 THEN 'ambiguous_cross_compartment'
WHEN s1 >= 0.2 AND s1 >= 0.6 * s0 THEN 'Doublet_suspected' WHEN s1 >= 0.2 AND s1 >= 0.5 * s0 THEN 'ambiguous_cross_compartment' WHEN s1 IS NOT NULL AND s0 - s1 < 0.05 AND s0 < 0.5 THEN 'Ambiguous' ELSE l0 END AS label, round(coalesce(s0, 0.0), 5) AS score FROM w""")
def label_ladder(spark, sf_dir):
    out = annotate.decide(annotate.compose(_scores(spark, sf_dir)))
    return out.select("cell", "label", F.round("score", 5).alias("score"))


@query("SELECT c_custkey AS cell, CASE WHEN trim(c_mktsegment) <> '' AND starts_with(c_name, 'Customer#00') THEN c_mktsegment ELSE 'own' END AS label FROM customer")
def metadata_preference(spark, sf_dir):
    c = inputs.table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("cell"), annotate.prefer_metadata("auto", F.lit("own"), F.col("c_mktsegment"), F.col("c_name"), "Customer#00").alias("label"))


@query(f"WITH {_PANEL}, v AS (SELECT DISTINCT l_partkey AS gene FROM lineitem WHERE l_quantity >= 49) SELECT label, count(v.gene) AS known, count(*) AS registered, count(v.gene) * 2 <= count(*) AS low FROM panel LEFT JOIN v USING (gene) WHERE role = 'core' GROUP BY label")
def vocabulary_confidence(spark, sf_dir):
    part = inputs.table(spark, sf_dir, "part")
    panel = part.where("p_size <= 20").select(F.col("p_type").alias("label"), F.lit("core").alias("role"), F.col("p_partkey").alias("gene"))
    return annotate.low_vocabulary(panel, inputs.table(spark, sf_dir, "lineitem").where("l_quantity >= 49").select(F.col("l_partkey").alias("gene")))


# contracts

@query("WITH m AS (SELECT CASE WHEN s_suppkey % 9 = 0 THEN '' ELSE n_name END AS sample_id, CASE WHEN s_suppkey % 8 = 0 THEN '' ELSE r_name END AS state, CASE WHEN s_suppkey % 5 = 0 THEN 'yeast' ELSE 'Human' END AS species FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey), n AS (SELECT *, count(*) OVER (PARTITION BY sample_id) AS k, (SELECT count(DISTINCT lower(species)) FROM m) AS kinds FROM m) SELECT sample_id, 'empty sample_id' AS fault FROM n WHERE sample_id = '' UNION ALL SELECT sample_id, 'empty state' FROM n WHERE state = '' UNION ALL SELECT sample_id, 'unknown species' FROM n WHERE lower(species) NOT IN ('mouse', 'human', 'drosophila') UNION ALL SELECT sample_id, 'duplicate sample_id' FROM n WHERE k > 1 UNION ALL SELECT sample_id, 'several species' FROM n WHERE kinds > 1")
def manifest_validate(spark, sf_dir):
    s = inputs.table(spark, sf_dir, "supplier").join(inputs.table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(inputs.table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    blank = lambda k, c: F.when(F.col("s_suppkey") % k == 0, "").otherwise(F.col(c))
    return contracts.manifest_faults(s.select(blank(9, "n_name").alias("sample_id"), blank(8, "r_name").alias("state"), F.when(F.col("s_suppkey") % 5 == 0, "yeast").otherwise("Human").alias("species")))


@query("WITH a AS (SELECT DISTINCT c_nationkey AS sample_id FROM customer WHERE c_nationkey % 4 <> 0), b AS (SELECT DISTINCT s_nationkey AS sample_id FROM supplier) SELECT sample_id, 'folders' AS missing_in FROM a WHERE sample_id NOT IN (SELECT sample_id FROM b) UNION ALL SELECT sample_id, 'manifest' FROM b WHERE sample_id NOT IN (SELECT sample_id FROM a)")
def coverage_diff(spark, sf_dir):
    a = inputs.table(spark, sf_dir, "customer").where("c_nationkey % 4 <> 0").select(F.col("c_nationkey").alias("sample_id"))
    return contracts.coverage(a, inputs.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("sample_id")))


@query(f"WITH {CELLS} SELECT DISTINCT state FROM cells")
def distinct_states(spark, sf_dir):
    return inputs.cells(spark, sf_dir).select("state").distinct()


@query(f"WITH {CELLS} SELECT state FROM (VALUES ('{START}'), ('{GOAL}'), ('NOWHERE')) t(state) WHERE state NOT IN (SELECT state FROM cells)")
def state_preflight(spark, sf_dir):
    return contracts.missing_states(spark.createDataFrame([(START,), (GOAL,), ("NOWHERE",)], "state string"), inputs.cells(spark, sf_dir))


@query("WITH s AS (SELECT DISTINCT o_orderstatus AS prefix, o_custkey % 17 AS shard FROM orders WHERE o_custkey % 17 <> length(o_orderpriority)) SELECT prefix, count(DISTINCT shard) AS n, max(shard) AS highest, max(shard) + 1 = count(DISTINCT shard) AS complete FROM s GROUP BY prefix")
def shard_gaps(spark, sf_dir):
    o = inputs.table(spark, sf_dir, "orders").where(F.col("o_custkey") % 17 != F.length("o_orderpriority"))
    return contracts.shard_gaps(o.select(F.col("o_orderstatus").alias("prefix"), (F.col("o_custkey") % 17).alias("shard")))


@query("""WITH m AS (SELECT n_regionkey AS chunk_id, 6 AS chunk_count, count(*) AS n_cells FROM nation GROUP BY 1) SELECT fault FROM (SELECT CASE WHEN (SELECT count(DISTINCT chunk_id) FROM m) <> 6 THEN 'chunks missing' END AS fault UNION ALL SELECT CASE WHEN (SELECT sum(n_cells) FROM m) <> 26 THEN 'cell counts differ' END UNION ALL SELECT CASE WHEN (SELECT count(*) FROM nation WHERE n_nationkey % 10 = 3) > 0 THEN 'file not listed' END) WHERE fault IS NOT NULL""")
def chunk_merge_validate(spark, sf_dir):
    n = inputs.table(spark, sf_dir, "nation")
    listed = F.collect_list(F.when(F.col("n_nationkey") % 10 != 3, F.col("n_name")))
    m = n.groupBy(F.col("n_regionkey").alias("chunk_id")).agg(F.count("*").alias("n_cells"), listed.alias("files"))
    m = m.select("*", F.lit(6).alias("chunk_count"), F.lit("c").alias("config_sha256"), F.lit("k").alias("centroid_sha256"), F.lit(26).alias("n_before"))
    return contracts.merge_faults(m, n.select(F.col("n_name").alias("name")))


@query("WITH r AS (SELECT s_suppkey AS run, round(s_acctbal / 1000)::DOUBLE AS accuracy FROM supplier) SELECT run, accuracy FROM r QUALIFY row_number() OVER (ORDER BY accuracy DESC, run) = 1")
def best_checkpoint(spark, sf_dir):
    return contracts.best_run(inputs.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("run"), F.round(F.col("s_acctbal") / 1000).alias("accuracy")))


@query("""WITH r AS (SELECT quality AS t, toxic AS p FROM labels), c AS (SELECT DISTINCT t AS c FROM r UNION SELECT DISTINCT p FROM r), k AS (SELECT c, (SELECT count(*) FROM r WHERE t = c AND p = c) AS tp, (SELECT count(*) FROM r WHERE t = c) AS t, (SELECT count(*) FROM r WHERE p = c) AS p FROM c),
q AS (SELECT *, coalesce(tp / nullif(p, 0), 0) AS prec, coalesce(tp / nullif(t, 0), 0) AS rec FROM k) SELECT round(sum(tp) / sum(t), 6) AS accuracy, round(avg(prec), 6) AS precision, round(avg(rec), 6) AS recall, round(avg(coalesce(2 * prec * rec / nullif(prec + rec, 0), 0)), 6) AS f1 FROM q""")
def classifier_metrics(spark, sf_dir):
    out = contracts.classifier_metrics(inputs.table(spark, sf_dir, "labels"), "quality", "toxic")
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query("SELECT event_id, event_type FROM events WHERE event_type IN (SELECT event_type FROM events GROUP BY 1 HAVING count(*) > 0.19 * (SELECT count(*) FROM events))")
def rare_class_drop(spark, sf_dir):
    return contracts.rare_classes_dropped(inputs.table(spark, sf_dir, "events").select("event_id", "event_type"), "event_type", 0.19)


@query("SELECT DISTINCT event_type AS label, dense_rank() OVER (ORDER BY event_type) - 1 AS id FROM events")
def label_ids(spark, sf_dir):
    from pyspark.sql import Window

    return inputs.table(spark, sf_dir, "events").select(F.col("event_type").alias("label")).distinct().select("label", (F.row_number().over(Window.orderBy("label")) - 1).cast("bigint").alias("id"))


@query("""WITH e AS (SELECT user_id % 7 AS seed, CASE WHEN event_type = 'click' THEN 'idle' ELSE 'feedback' END AS kind, event_id AS event_index, 0.97 + (event_id % 10) / 300.0 AS rho, 1.0 + event_id % 3 AS disp FROM events),
g AS (SELECT seed, min(rho) FILTER (WHERE kind = 'feedback') AS lo, arg_min(rho, event_index) FILTER (WHERE kind = 'feedback') AS r0, max(disp) FILTER (WHERE kind = 'feedback') AS hi, arg_min(disp, event_index) FILTER (WHERE kind = 'feedback') AS d0, arg_max(rho, event_index) FILTER (WHERE kind = 'idle') AS ir, arg_max(disp, event_index) FILTER (WHERE kind = 'idle') AS id1, arg_min(disp, event_index) FILTER (WHERE kind = 'idle') AS id0 FROM e GROUP BY seed)
SELECT seed, coalesce(lo >= r0 - 0.02 AND hi <= 1.5 * greatest(d0, 1.0), false) AS s1, coalesce(ir >= 0.99 AND id1 <= id0, false) AS s2 FROM g""")
def stability_verdict(spark, sf_dir):
    e = inputs.table(spark, sf_dir, "events")
    rows = e.select((F.col("user_id") % 7).alias("seed"), F.when(F.col("event_type") == "click", "idle").otherwise("feedback").alias("kind"), F.col("event_id").alias("event_index"), (0.97 + (F.col("event_id") % 10) / 300.0).cast("double").alias("rho"), (1.0 + F.col("event_id") % 3).cast("double").alias("disp"))
    return contracts.stability(rows)


@query("SELECT p_partkey AS k, CASE WHEN length(x) <= 12 THEN x ELSE rtrim(CASE WHEN contains(x[1:11], ' ') THEN regexp_replace(x[1:11], ' [^ ]*$', '') ELSE x[1:11] END, ' ,;/-') || '…' END AS label FROM (SELECT p_partkey, trim(regexp_replace(p_name, '\\s+', ' ', 'g'), ' ,;') AS x FROM part)")
def short_term_labels(spark, sf_dir):
    return inputs.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), text.short_label(F.col("p_name"), 12).alias("label"))


@query("SELECT source, coalesce(nullif(split_part(source || '-B-' || lang, '-', 2), ''), source) AS state, lang AS suffix FROM (SELECT DISTINCT source, lang FROM documents)")
def folder_names(spark, sf_dir):
    d = inputs.table(spark, sf_dir, "documents").select("source", "lang").distinct()
    state, suffix = text.sample_folder(F.concat_ws("-", "source", F.lit("B"), "lang"))
    return d.select("source", state.alias("state"), suffix.alias("suffix"))


@query("SELECT user_id, event_type, json_extract_string(props, '$.page') AS page, count(*) AS n FROM events GROUP BY ALL")
def json_field_counts(spark, sf_dir):
    e = inputs.table(spark, sf_dir, "events")
    return e.groupBy("user_id", "event_type", F.get_json_object("props", "$.page").alias("page")).agg(F.count("*").alias("n"))
