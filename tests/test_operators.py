"""Operators on small frames with known results."""

from __future__ import annotations

import hashlib
import math
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from ranklane.functions import text
from ranklane.operators import annotate, contracts, datasets, encode, keymap, profiles, ranking, reports
from ranklane.operators import statistics as stats
from ranklane.sources import readers
from ranklane.sources.shared import kept


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_first_token_follows_counts(spark):
    counts = frame(spark, [(c, g, float(x)) for c, xs in enumerate([[40, 10, 1, 1], [5, 30, 2, 1]]) for g, x in enumerate(xs)], "cell bigint, gene bigint, cnt double")
    vocab = frame(spark, [(g, g + 5, 1.0) for g in range(4)], "gene bigint, token bigint, med double")
    lists = {r.cell: r.ids for r in encode.to_lists(encode.rank(encode.normalise(counts, vocab))).collect()}
    assert lists[0][0] == 5 and lists[1][0] == 6 and lists[0] == [5, 6, 7, 8]


def test_position_sums_and_ranks(spark):
    e = encode.from_lists(frame(spark, [(1, [10, 11, 12]), (2, [11, 10])], "cell bigint, ids array<bigint>"))
    r = {x.token: x["rank"] for x in profiles.pseudobulk(profiles.position_sums(e), profiles.cells_per(e)).collect()}
    assert r == {10: 0.5, 11: 0.25, 12: 1.0}
    halves = [profiles.position_sums(e.where(f"cell = {c}")) for c in (1, 2)]
    merged = {x.token: x.sum_norm_pos for x in profiles.merge_position_sums(*halves).collect()}
    assert merged == {10: 1.0, 11: 0.5, 12: 1.0}


def test_bh(spark):
    rows = frame(spark, [(0, 0.01), (1, 0.04), (2, 0.03)], "gene int, p double")
    got = {r.gene: round(r.fdr, 10) for r in ranking.bh_adjust(rows, "p", tie="gene").collect()}
    assert got == {0: 0.03, 1: 0.04, 2: 0.04}


def test_over_representation_is_the_upper_tail(spark):
    bg = frame(spark, [(f"g{i}",) for i in range(100)], "symbol string")
    q = frame(spark, [(f"G{i}",) for i in range(12)], "symbol string")
    sets = frame(spark, [("T1", f"g{i}") for i in (0, 1, 2, 50, 51, 52, 53, 54, 55, 56)] + [("T2", "g99")], "term string, symbol string")
    (row,) = stats.over_representation(q, bg, sets).collect()
    want = sum(math.comb(10, x) * math.comb(90, 12 - x) for x in range(3, 11)) / math.comb(100, 12)
    assert (row.term, row.k, row.term_size) == ("T1", 3, 10) and abs(row.p - want) < 1e-9


def test_rank_sum_matches_brute_force(spark):
    import random

    r = random.Random(5)
    rows = [(g, float(r.randrange(6))) for g in range(4) for _ in range(r.randrange(3, 9))]
    got = {x.gene: x for x in stats.shifts_vs_pool(frame(spark, rows, "gene int, shift double")).collect()}
    pool = [s for _, s in rows]
    for g in range(4):
        own = [s for k, s in rows if k == g]
        both = sorted(pool + own)
        rank = lambda v: (2 * both.index(v) + both.count(v) + 1) / 2  # noqa: E731, B023
        w, n1, n2 = sum(map(rank, pool)), len(pool), len(own)
        z = (w - n1 * (n1 + n2 + 1) / 2) / math.sqrt(n1 * n2 * (n1 + n2 + 1) / 12)
        assert abs(got[g].z - z) < 1e-9


def test_two_sided_p(spark):
    p = frame(spark, [(1.959963984540054,)], "z double").select(stats.two_sided_p("z").alias("p")).first().p
    assert abs(p - 0.05) < 1e-12


def test_one2one_and_collisions(spark):
    s = "source string, target string, kind string, ord int"
    rel = frame(spark, [("ENS1", "T1", "", 1), ("ENS2", "T2", "", 2), ("ENS3", "T2", "", 3), ("ENS4", "T3", "", 4), ("ENS4", "T4", "", 5), ("Sym", "T9", "", 6), ("Sym", "T8", "", 7)], s)
    assert {tuple(r) for r in keymap.one2one(rel).collect()} == {("ENS1", "T1"), ("Sym", "T9")}
    cur = frame(spark, [("ENS7", "T1", "", 1)], s)
    assert {tuple(r) for r in keymap.load(rel, cur, "one2one").collect()} == {("ENS7", "T1"), ("Sym", "T9")}
    assert dict(map(tuple, keymap.last_wins(rel).collect()))["ENS4"] == "T4"


def test_hamilton_and_rescue(spark):
    g = frame(spark, [("a", 90), ("b", 9), ("c", 1)], "grp string, size bigint")
    q = ranking.hamilton(g, 10)
    assert {r.grp: r.quota for r in q.collect()} == {"a": 9, "b": 1, "c": 0}
    assert {r.grp: r.quota for r in ranking.rescued(q, 10).collect()} == {"a": 8, "b": 1, "c": 1}


def test_spearman_handles_ties_and_constants(spark):
    rows = frame(spark, [(1, 1.0, 2.0), (1, 2.0, 3.0), (1, 2.0, 9.0), (2, 1.0, 1.0), (2, 1.0, 2.0)], "cell int, a double, b double")
    got = {r.cell: r.rho for r in ranking.spearman_by(rows, "a", "b", "cell").collect()}
    assert abs(got[1] - 0.8660254037844387) < 1e-9 and got[2] is None


def test_result_does_not_depend_on_partitions(spark):
    rows = frame(spark, [(g % 5, float(g * 7 % 11)) for g in range(200)], "gene int, shift double")
    a = sorted(map(tuple, stats.shifts_vs_pool(rows.repartition(7)).collect()))
    b = sorted(map(tuple, stats.shifts_vs_pool(rows.coalesce(1)).collect()))
    assert [x[0] for x in a] == [x[0] for x in b] and all(abs(x[3] - y[3]) < 1e-9 for x, y in zip(a, b, strict=True))


def test_mixture_orders_components(spark):
    rows = frame(spark, [(-5.0 + i / 50,) for i in range(40)] + [(3.0 + i / 50,) for i in range(60)], "v double")
    mean, _, weight = stats.mixture(rows, "v")
    assert mean[0] < -4 and mean[1] > 3 and abs(weight[0] - 0.4) < 0.01


def test_texts(spark):
    df = frame(spark, [(" ENSG01.3 ", "positive regulation of cell differentiation in something long (GO:12)", "dropped_no_ortholog"), ("Tp53.1", "short", None)], "id string, term string, why string")
    got = df.select(text.normal_id(F.col("id")), text.short_label(F.col("term")), text.drop_reason(F.col("why"))).collect()
    assert got[0][0] == "ENSG01" and got[1][0] == "Tp53.1"
    assert got[0][1] == "+ cell diff. in something long" and got[1][1] == "short"
    assert got[0][2] == "No ortholog in the conversion table." and got[1][2].startswith("Unmapped")


def test_ladder(spark):
    s = "cell int, label string, core double, hits int, score double"
    rows = [(1, "A", 0.9, 3, 0.9), (1, "B", 0.1, 3, 0.1), (2, "A", 0.9, 3, 0.9), (2, "B", 0.8, 3, 0.8), (3, "A", 0.1, 3, 0.1), (3, "B", 0.0, 0, None), (4, "A", 1.0, 3, 1.0), (4, "B", 0.55, 3, 0.55)]
    got = {r.cell: r.label for r in annotate.decide(frame(spark, rows, s)).collect()}
    assert got == {1: "A", 2: "Doublet_suspected", 3: "Ambiguous", 4: "ambiguous_cross_compartment"}


def test_merge_faults(spark):
    m = frame(spark, [(0, 2, "c", "k", 3, 6, ["a"]), (1, 2, "c", "k2", 2, 6, ["b"])], "chunk_id int, chunk_count int, config_sha256 string, centroid_sha256 string, n_cells int, n_before int, files array<string>")
    got = {r.fault for r in contracts.merge_faults(m, frame(spark, [("a",), ("x",)], "name string")).collect()}
    assert got == {"centroids differ", "cell counts differ", "file not listed", "file missing"}


def test_readers(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("Sample-ID\tdisease\tspecies\tbatch\n#q2:types\tx\tx\tx\ns1\tctl\tHuman\t1\ns2\till\thuman\t\n")
    m = readers.read_manifest(spark, f"file://{tmp_path}/m.tsv")
    assert m.columns == ["sample_id", "state", "species", "batch"] and m.count() == 2
    assert contracts.manifest_faults(m).count() == 0
    with pytest.raises(readers.ManifestError):
        readers.manifest_header(["sample_id", "state"])
    (tmp_path / "x").mkdir()
    (tmp_path / "x/matrix.mtx").write_text("%%MatrixMarket matrix coordinate integer general\n%c\n2 3 3\n1 1 5\n2 1 1\n1 3 2\n")
    (tmp_path / "x/features.tsv").write_text("ENSG1.2\tA\nENSG2\tB\n")
    (tmp_path / "x/barcodes.tsv").write_text("AA\nCC\nGG\n")
    got = {tuple(r) for r in readers.read_10x(spark, f"file://{tmp_path}/x", "s1").collect()}
    assert got == {("s1", "s1_AA", "ENSG1", 5.0), ("s1", "s1_AA", "ENSG2", 1.0), ("s1", "s1_GG", "ENSG1", 2.0)}
    assert {r.col: r.n for r in readers.entries_per_cell(readers.read_mtx(spark, f"file://{tmp_path}/x/matrix.mtx"), 3).collect()} == {1: 2, 2: 0, 3: 1}
    (tmp_path / "l.gmt").write_text("Term A\t\tabc1,1.0\tABC2\nshort\tx\nTerm A\t\tabc3\n")
    assert {tuple(r) for r in readers.read_gmt(spark, f"file://{tmp_path}/l.gmt").collect()} == {("Term A", "ABC1"), ("Term A", "ABC2"), ("Term A", "ABC3")}
    (tmp_path / "o.tsv").write_text("source_id\ttarget_id\torthology_type\nENSM1.1\tENSG1\tOrtholog_One2One\n\tx\t\n")
    assert [tuple(r)[:3] for r in readers.read_relation(spark, f"file://{tmp_path}/o.tsv").collect()] == [("ENSM1", "ENSG1", "ortholog_one2one")]
    (tmp_path / "p.json").write_text('{"types": {"A": {"human": ["X", "Y"]}, "B": {"human": {"core": ["Z"], "anti": ["Q"]}}, "G": {"assign": false, "human": ["W"]}}}')
    assert {tuple(r) for r in readers.read_panel(spark, f"file://{tmp_path}/p.json", "human").collect()} == {("A", "core", "X"), ("A", "core", "Y"), ("B", "core", "Z"), ("B", "anti", "Q")}


def test_content_fingerprint(spark, tmp_path):
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for name, data in (("b.bin", b"12"), ("sub/a b.txt", b"x"), ("sub/config.json", b"{}"), ("sub0", b"y")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    lines = "".join(f"{name}\0{sha(data)}\n" for name, data in (("b.bin", b"12"), ("sub/a b.txt", b"x"), ("sub/config.json", b"{}"), ("sub0", b"y")))
    assert readers.content_fingerprint(spark, str(tmp_path)) == {"kind": "directory", "file_count": 4, "fingerprint_mode": "full", "content_fingerprint_sha256": sha(lines.encode())}
    assert readers.content_fingerprint(spark, f"{tmp_path}/b.bin") == {"kind": "file", "file_count": 1, "content_fingerprint_sha256": sha(b"12")}
    fast = readers.content_fingerprint(spark, f"file://{tmp_path}", fast=True)
    (tmp_path / "sub/config.json").write_bytes(b"[]")
    assert readers.content_fingerprint(spark, str(tmp_path), fast=True)["content_fingerprint_sha256"] != fast["content_fingerprint_sha256"]
    with pytest.raises(FileNotFoundError):
        readers.content_fingerprint(spark, f"{tmp_path}/none")


def test_conversion_report_is_written(spark, tmp_path):
    keys = frame(spark, [("f1", "a"), ("f1", "b"), ("f2", "b"), ("f2", "c")], "file string, key string")
    report = keymap.conversion_report(keys, frame(spark, [("a", "T1"), ("b", "T1")], "key string, target string"), frame(spark, [("T1",)], "gene string"))
    unmapped = frame(spark, [("z", None, "no_ortholog", "x"), ("c", "C", None, None)], "source_id string, symbol string, drop_reason string, brief_function string")
    readers.write_conversion_report(report, unmapped, str(tmp_path), most=1)
    told = [r.value for r in spark.read.text(f"{tmp_path}/conversion_report.txt").collect()]
    assert told[0] == "all files: 3 keys, 2 mapped (66.67 %), 1 unmapped, 1 targets, 1 of them from several keys, 1 in the vocabulary" and len(told) == 3
    assert {(r.file, r.n_input) for r in spark.read.json(f"{tmp_path}/conversion_report.json").collect()} == {(None, 3), ("f1", 2), ("f2", 2)}
    assert [tuple(r) for r in spark.read.csv(f"{tmp_path}/conversion_unmapped_genes.tsv", sep="\t", header=True).collect()] == [("c", "C", None, None)]
    readers.write_conversion_report(report, unmapped.limit(0), f"{tmp_path}/none")
    assert not (tmp_path / "none/conversion_unmapped_genes.tsv").exists()


def test_libraries(spark, tmp_path):
    (tmp_path / "libraries.json").write_text('{"libraries": {"GO_x": {"label": "Ontology"}, "KEGG_2": {}}, "default_by_species": {"human": ["GO_x", "KEGG_2"], "mouse": ["GO_x"]}}')
    (tmp_path / "GO_x.gmt").write_text("T1\t\ta\tb\n")
    (tmp_path / "KEGG_2.gmt").write_text("T2\t\tc\n")
    told = readers.read_libraries(spark, str(tmp_path))
    assert (told.label("GO_x"), told.label("KEGG_2"), told.label("a_b")) == ("Ontology", "KEGG 2", "a b")
    assert told.default("Mouse") == ["GO_x"] and told.default("drosophila") == ["GO_x", "KEGG_2"]
    assert {tuple(r) for r in readers.read_default_sets(spark, str(tmp_path), "human").collect()} == {("GO_x", "T1", "A"), ("GO_x", "T1", "B"), ("KEGG_2", "T2", "C")}


def test_variation_and_group_order(spark):
    x = frame(spark, [(2.0,), (4.0,), (math.nan,), (None,)], "v double")
    assert math.isclose(x.agg(reports.variation("v").alias("c")).first().c, math.sqrt(2) / 3)
    rows = frame(spark, [("Unknown", 9.0)] * 5 + [("b", 1.0)] * 3 + [("a", 2.0)] * 2 + [("one", 8.0), ("Ambiguous", 8.0)], "g string, s double")
    told = lambda df: [r.g for r in df.orderBy("ord").collect()]
    assert told(reports.group_order(rows, "g", "s")) == ["a", "b"]
    assert told(reports.group_order(rows, "g")) == ["b", "a"]
    assert told(reports.group_order(rows, "g", "s", least=1)) == ["one", "a", "b"]
    assert told(reports.group_order(rows, "g", "s", clusters=True)) == ["Unknown", "b", "a", "Ambiguous", "one"]


def test_exact_split(spark):
    for n in (1, 2, 3, 7, 10, 16):
        rows = frame(spark, [(i, "x", (i * 7) % 17) for i in range(n)], "k int, label string, o int")
        parts = {r.k: r.part for r in datasets.train_eval_split(rows, "k", "label", 0.8, F.col("o")).collect()}
        train = sorted(range(n), key=lambda i: i * 7 % 17)[: math.floor(n * 0.8 + 0.5)]
        assert {k for k, p in parts.items() if p == "train"} == set(train)


def test_upper_tail(spark):
    """Against sums of exact fractions, from small to large backgrounds."""
    cases = [(3, 10, 20, 100), (1, 5, 5, 12), (0, 3, 4, 30), (7, 7, 9, 40), (25, 60, 300, 2000), (40, 900, 800, 20_000), (12, 12, 12, 12)]
    df = frame(spark, cases, "k bigint, s bigint, n bigint, t bigint")
    for r in df.withColumn("p", stats.upper_tail(F.col("k"), F.col("s"), F.col("n"), F.col("t"))).collect():
        exact = sum(Fraction(math.comb(r.s, x) * math.comb(r.t - r.s, r.n - x), math.comb(r.t, r.n)) for x in range(r.k, min(r.s, r.n) + 1) if r.n - x <= r.t - r.s)
        assert math.isclose(r.p, float(exact), rel_tol=1e-8), r


def test_lists_without_and_with_universes(spark):
    """A list with a universe of its own is judged in it, the others in the background; nothing is written out for each list."""
    lists = frame(spark, [("p", "a"), ("p", "b"), ("p", "zz"), ("o", "a"), ("o", "c"), ("none", "q")], "list string, symbol string")
    background = frame(spark, [(x,) for x in "abcdefgh"], "symbol string")
    sets = frame(spark, [("L", "T", x) for x in "abc"] + [("L", "U", "h")], "library string, term string, symbol string")
    universe = frame(spark, [("o", x) for x in "acd"], "list string, symbol string")
    got = {(r.list, r.term): (r.k, r.term_size, r.n_query, r.n_background) for r in reports.fan_out(lists, background, sets, universe).collect()}
    assert got == {("p", "T"): (2, 3, 2, 8), ("o", "T"): (2, 2, 2, 3)}


def test_entry_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_stratum_counts_matches_before_it_lists_them(spark, monkeypatch):
    rows = [(i, 0.1 + (i % 7) / 10, (i * 37 % 101) / 100) for i in range(150)]
    p = spark.createDataFrame(rows, "token long, detection double, rank double")
    written = []
    monkeypatch.setattr(profiles, "DEALT", 40)
    monkeypatch.setattr(profiles, "kept", lambda df: written.append(df.count()) or kept(df))
    got = {tuple(r) for r in profiles.stratum(p, p, 12).collect()}
    want = set()
    for t, td, tr in rows:
        near = [(x, abs(r - tr)) for x, d, r in rows if x != t and td / 2 <= d <= td * 2]
        w = next((w for w in (0.1, 0.2, 0.3) if sum(g <= w for _, g in near) >= 12), float("inf"))
        want |= {(t, x, w) for x, g in near if g <= w}
    assert got == want and len({w for _, _, w in want}) > 1
    assert max(written) <= len(rows)  # never the pairs


def test_rank_sums_of_millions_of_shifts(spark):
    n = 1_800_000  # n * n * (2 n + 1) leaves the range of a bigint
    one = stats.shifts_vs_pool(spark.range(n).select(F.lit(1).alias("gene"), (F.col("id") % 3).cast("double").alias("shift"))).first()
    assert one.n == n and one.z == pytest.approx(0.0, abs=1e-6)
    half = spark.range(2 * n).select(F.lit(1).alias("gene"), (F.col("id") % 2).cast("double").alias("shift"), (F.col("id") < n).alias("t"))
    both = stats.rank_sums(half.where("t"), half.where("NOT t")).first()
    assert both.n_test == both.n_null == n and both.z == pytest.approx(0.0, abs=1e-6)


def test_a_mean_at_the_limit_is_taken_in_order(spark):
    values = {k: [(7 * k + 3 * i * i) % 11 / 100 for i in range(6)] for k in range(60)}
    values |= {100 + k: [(5 + d) / 100 for d in (k % 5, -(k % 4), -(k % 5), k % 4, 1, -1)] for k in range(60)}
    rows = [(k, x, i) for k, xs in values.items() for i, x in enumerate(xs)]
    want = {}
    for k, xs in values.items():
        s = 0.0
        for x in xs:
            s += x
        want[k] = s / len(xs) > 0.05
    backwards = frame(spark, rows[::-1], "k long, x double, i long").coalesce(1)
    got = {r.k: r.sig for r in reports.above(backwards, "k", "x", 0.05, "sig", "i").collect()}
    plain = {r.k: r.sig for r in backwards.groupBy("k").agg((F.avg("x") > 0.05).alias("sig")).collect()}
    assert got == want and plain != want


def test_tasks_grow_with_the_order_lines(spark, monkeypatch):
    from ranklane.plans import catalogue, inputs

    where = "/root/testdata/sf0.001"
    monkeypatch.setattr(inputs, "A_TASK", 500)
    many = inputs.tasks(spark, where)
    assert many >= 8
    assert inputs.counts(spark, where).rdd.getNumPartitions() == many
    assert catalogue.QUERIES["spearman_by_cell"](spark, where).rdd.getNumPartitions() == many


def test_stratum_meets_blocks(spark, monkeypatch):
    """Blocks inside, across and outside a target's bounds; a detection at an octave's end; ranks that are not known; targets that are no keys."""
    for name, n in (("DEALT", 50), ("CROWD", 20), ("BLOCK", 8)):
        monkeypatch.setattr(profiles, name, n, raising=False)
    rows = [(i, 0.02 * (1 + i * 29 % 40), (i * 37 % 211) / 210) for i in range(240)] + [(300, 2.0**-28, 0.5), (301, 2.0**-29, 0.5), (302, 0.3, None), (303, 0.3, float("nan"))]
    goals = [(i, d * 1.1, r) for i, d, r in rows[:240:3]] + [(900, 0.3, 0.45), (901, 0.03, 1.0), *rows[-4:]]
    p, t = (frame(spark, x, "token long, detection double, rank double") for x in (rows, goals))
    want = set()
    for g, td, tr in goals:
        near = [(x, abs(r - tr) if None not in (r, tr) else float("nan")) for x, d, r in rows if x != g and td / 2 <= d <= td * 2]
        w = next((w for w in (0.1, 0.2, 0.3) if sum(gap <= w for _, gap in near) >= 26), float("inf"))
        want |= {(g, x, w) for x, gap in near if gap <= w or w == float("inf")}
    got = [tuple(r) for r in profiles.stratum(t, p, 26).collect()]
    assert len(got) == len(set(got)) and set(got) == want and {(300, 301, float("inf")), (301, 300, float("inf"))} <= want and len({w for *_, w in want}) == 4
