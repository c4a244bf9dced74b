"""The closeness report and the band join against plain numpy."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from test_resampling import spearman

from ranklane.operators import closeness, keymap, profiles
from ranklane.operators import statistics as stats


def vector(d, g):
    d, g = np.array(d), np.array(g)
    big = (np.abs(g) >= np.quantile(np.abs(g), 0.8)) & (g != 0)
    return {
        "progress": d @ g / (g @ g), "cosine": d @ g / math.sqrt((d @ d) * (g @ g)) if d.any() else None, "spearman": spearman(d, g),
        "distance_closed": 1 - np.linalg.norm(g - d) / np.linalg.norm(g), "toward_goal": float(np.mean(np.sign(d[big]) == np.sign(g[big]))),
    }


@pytest.fixture(scope="module")
def study(spark):
    r = random.Random(4)
    start = {t: round(r.random(), 2) for t in range(90)}
    goal = {t: round(min(1.0, max(0.0, s + r.gauss(0, 0.2))), 2) for t, s in start.items()}
    delta = {c: {t: round(0.3 * k * (goal[t] - start[t]) + r.gauss(0, 0.1), 2) for t in start} for k, c in enumerate(("p1", "p2", "configured"))}
    sets = [("L", f"T{k}", f"g{t}") for k in range(6) for t in start if r.random() < 0.3] + [("L", "small", "g1"), ("M", "M1", "G2")] + [("M", "M2", f"g{t}") for t in range(0, 90, 2)]
    table = spark.createDataFrame([(t, start[t], goal[t], delta["configured"][t]) for t in start], "token int, start_rank double, goal_rank double, delta_spec double")
    placebos = spark.createDataFrame([(s, c, t, delta[c][t] + 0.1 * s) for s in (-1, 1) for c in ("p1", "p2") for t in start], "seed int, chain string, token int, d double")
    frames = table, placebos, spark.createDataFrame(sets, "library string, term string, symbol string"), spark.createDataFrame([(t, f"g{t}") for t in start if t != 7], "token int, symbol string")
    return start, goal, delta, sets, frames


def test_report(spark, study, tmp_path):
    start, goal, delta, sets, frames = study
    seeds = spark.createDataFrame([(s, t, delta["configured"][t] * s) for s in (1, 2) for t in start], "seed int, token int, d double")
    values, summary = closeness.report(*frames, seeds=seeds, fraction=0.2, fdr=0.5)
    got = {(r.level, r.metric, r.chain): r.value for r in values.collect()}
    g = {t: goal[t] - start[t] for t in start}
    members = {}
    for lib, term, symbol in sets:
        members.setdefault((lib, term), set()).add(symbol.upper())
    name = {t: f"G{t}" if t != 7 else "7" for t in start}
    for chain in delta:
        want = vector([delta[chain][t] for t in start], list(g.values()))
        for metric, x in want.items():
            assert math.isclose(got["gene", metric, chain], x, abs_tol=1e-9), (metric, chain)
        for lib in "L":
            terms = [[t for t in start if name[t] in m] for (one, _), m in members.items() if one == lib]
            terms = [m for m in terms if len(m) >= 10]
            want = vector([np.mean([delta[chain][t] for t in m]) for m in terms], [np.mean([g[t] for t in m]) for m in terms])
            assert all(math.isclose(got[lib, k, chain], x, abs_tol=1e-9) for k, x in want.items())
        k = math.ceil(0.1 * len(g))
        order = sorted(g, key=lambda t: (g[t], t))
        low, high = [delta[chain][t] for t in order[:k]], [delta[chain][t] for t in order[-k:]]
        assert math.isclose(got["gene", "auc_goal_gain", chain], sum((a < b) + (a == b) / 2 for a in low for b in high) / k**2, abs_tol=1e-9)
    # enrichment of the configured chain's list, by the single-list operator
    top = lambda score: [name[t] for t in sorted(start, key=lambda t: (score[t], t))[:18]]
    listed = lambda xs: spark.createDataFrame([(x,) for x in xs], "symbol string")
    lib = frames[2].where("library = 'L'").select("term", "symbol")
    enriched = lambda score: stats.bh_adjust(stats.over_representation(listed(top(score)), listed(name.values()), lib), "p", tie="term")
    own, ref = enriched({t: start[t] + delta["configured"][t] for t in start}), enriched(goal)
    one = stats.profile_metrics(own, ref, 0.5).first()
    assert got["ora:L", "isp_sig_shared", "configured"] == one.sig_shared and math.isclose(got["ora:L", "isp_cosine", "configured"], one.cosine, abs_tol=1e-9)
    rows = {(r.level, r.metric): r for r in summary.collect()}
    cos = rows["gene", "cosine"]
    nul = [got["gene", "cosine", c] for c in ("p1", "p2")]
    assert cos.n_placebos == 2 and math.isclose(cos.z, (cos.value - np.mean(nul)) / np.std(nul, ddof=1)) and cos.p_empirical == (1 + sum(v >= cos.value for v in nul)) / 3
    assert math.isclose(cos.by_seed["1"], cos.by_seed["2"]) and math.isclose(cos.by_seed["1"], cos.value)
    closeness.write_report(values, summary, frames[1], str(tmp_path))
    assert spark.read.csv(f"{tmp_path}/closeness_values", header=True).count() == len(got) and spark.read.csv(f"{tmp_path}/closeness_summary", header=True).count() == len(rows)


def test_undefined(spark):
    flat = spark.createDataFrame([("x", 0.0, 0.0), ("x", 0.0, 0.0), ("y", 0.0, 1.0), ("y", 0.0, -1.0)], "k string, d double, g double")
    got = {r.k: r for r in closeness.vector_metrics(flat, "k").collect()}
    assert (got["x"].progress, got["x"].cosine, got["x"].toward_goal) == (None, None, None)
    assert (got["y"].progress, got["y"].cosine, got["y"].spearman, got["y"].distance_closed) == (0.0, None, None, 0.0)
    one = spark.createDataFrame([("x", 1, 0.5, 1.0)], "k string, t int, d double, g double")
    assert closeness.auc_goal_gain(one, "t", "k").first().auc_goal_gain == 0.5


def test_band_join(spark):
    r = random.Random(8)
    pop = [(t, round(r.random() ** 2, 3), round(r.random(), 2)) for t in range(400)] + [(900, 0.0, 0.5), (901, 1.0, 1.0)]
    df = spark.createDataFrame(pop, "token int, detection double, rank double")
    want = set()
    for t, d, x in pop:
        near = [(u, abs(y - x)) for u, e, y in pop if d > 0 and e > 0 and d / 2 <= e <= d * 2 and u != t]
        for w in (0.1, 0.2, 0.3, math.inf):
            found = [u for u, gap in near if gap <= w]
            if len(found) >= 40 or w == math.inf:
                want |= {(t, u, w) for u in found}
                break
    got = [tuple(x) for x in profiles.stratum(df, df, 40).collect()]
    assert len(got) == len(set(got)) and set(got) == want and {w for *_, w in want} == {0.1, 0.2, 0.3, math.inf}


def test_best_source(spark):
    """The source of highest median over all cells, zeros included, ties by name."""
    r = random.Random(2)
    counts = [(c, f"s{s}", float(r.randrange(0, 4))) for c in range(31) for s in range(9) if r.random() < 0.7]
    table = [(f"s{s}", f"t{s % 3}") for s in range(9)]
    best = {}
    for source, target in table:
        m = float(np.median([x for c, s, x in counts if s == source and x > 0] + [0.0] * (31 - sum(s == source and x > 0 for _, s, x in counts))))
        best[target] = max(best.get(target, (-1.0, "")), (m, source), key=lambda y: (y[0], [-ord(ch) for ch in y[1]]))
    got = keymap.collapse_best(spark.createDataFrame(counts, "cell int, gene string, cnt double"), spark.createDataFrame(table, "source string, target string"), 31)
    assert sorted(map(tuple, got.collect())) == sorted((c, t, x) for c, s, x in counts for t in best if best[t][1] == s and x > 0)
