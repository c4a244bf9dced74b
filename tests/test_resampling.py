"""Ranks and quantiles over ranges, bootstraps and the comparison of methods, against plain numpy."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ranklane.operators import ranking, resampling
from ranklane.operators import statistics as stats


def ranks(x):
    x = np.asarray(x, float)
    order = np.sort(x)
    return (np.searchsorted(order, x, "left") + np.searchsorted(order, x, "right") + 1) / 2


def spearman(a, b):
    a, b = ranks(a), ranks(b)
    return float(np.corrcoef(a, b)[0, 1]) if a.std() and b.std() else math.nan


def partial(p, t, bins):
    p, t = ranks(p), ranks(t)
    for b in np.unique(bins):
        p[bins == b] -= p[bins == b].mean()
        t[bins == b] -= t[bins == b].mean()
    return float(np.corrcoef(p, t)[0, 1])


def times(seed, draw, key):
    if draw == 0:
        return 1
    u = int(hashlib.md5(f"{seed}:{draw}:{key}".encode()).hexdigest()[:8], 16) / 2**32
    return sum(u >= s for s in resampling.poisson_steps())


@pytest.fixture(scope="module")
def rows():
    """Cells of different level and size, ties, and rows that are left out."""
    r = random.Random(3)
    out = []
    for cell in range(14):
        for token in range(r.randrange(5, 60)):
            base = r.random()
            target = round(base + cell / 3 + r.gauss(0, 0.6), 1)
            out.append((cell, token, round(target + r.gauss(0, 1), 1), float(r.randrange(5)), target, base))
    return out


COLUMNS = "cell int, token int, a double, b double, target double, base double"


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame([*rows, (1, 90, None, 1.0, 1.0, 0.5), (1, 91, math.nan, 1.0, 1.0, 0.5), (None, 92, 1.0, 1.0, 1.0, 0.5)], COLUMNS).repartition(5)


@pytest.fixture(scope="module")
def clean(spark, rows):
    return spark.createDataFrame(rows, COLUMNS).repartition(5)


def drawn(rows, seed, draw):
    return np.array([x[2:] for x in rows for _ in range(times(seed, draw, x[0]))])


@pytest.mark.parametrize("together", [250, 7])
def test_delta_rho(df, rows, monkeypatch, together):
    """Every draw ranks its own rows; the bounds are whole places of the sorted draws."""
    monkeypatch.setattr(resampling, "TOGETHER", together)
    sums = resampling.resampled_sums(df, ["a", "b"], "target", "cell", 30, 11)
    got = {(r.draw, r.method): r.rho for r in resampling.pooled(sums).collect()}
    found = []
    for draw in range(31):
        x = drawn(rows, 11, draw)
        for method, column in (("a", 0), ("b", 1)):
            assert math.isclose(got[draw, method], spearman(x[:, column], x[:, 2]), abs_tol=1e-9)
        found.append(spearman(x[:, 0], x[:, 2]) - spearman(x[:, 1], x[:, 2]))
    one = resampling.bootstrap_delta_rho(df, "a", "b", "target", "cell", 30, 11).first()
    draws = sorted(found[1:])
    assert math.isclose(one.delta_rho, found[0], abs_tol=1e-9) and one.n_boot == 30
    assert math.isclose(one.ci_low, draws[0], abs_tol=1e-9) and math.isclose(one.ci_high, draws[29], abs_tol=1e-9)
    assert one.excludes_zero == (draws[0] > 0 or draws[29] < 0)


def test_like_plain_resampling(clean, rows):
    """The interval is about that of drawing cells with replacement."""
    r = np.random.default_rng(0)
    cells = sorted({x[0] for x in rows})
    by = {c: np.array([x[2:] for x in rows if x[0] == c]) for c in cells}
    plain = []
    for _ in range(600):
        x = np.concatenate([by[c] for c in r.choice(cells, len(cells))])
        plain.append(spearman(x[:, 0], x[:, 2]) - spearman(x[:, 1], x[:, 2]))
    one = resampling.bootstrap_delta_rho(clean, "a", "b", "target", "cell", 400, 2).first()
    spread = np.std(plain)
    assert abs(one.ci_low - np.quantile(plain, 0.025)) < 0.8 * spread and abs(one.ci_high - np.quantile(plain, 0.975)) < 0.8 * spread


def test_partial_interval(clean, rows):
    edges = np.quantile([x[5] for x in rows], [i / 20 for i in range(1, 20)])
    found, other = [], []
    for draw in range(26):
        x = drawn(rows, 4, draw)
        bins = np.searchsorted(edges, x[:, 3], side="right")
        found.append(partial(x[:, 0], x[:, 2], bins))
        other.append(partial(x[:, 1], x[:, 2], bins))
    one = resampling.bootstrap_partial(clean, "a", "target", "base", "cell", 25, 4).first()
    low, high = np.quantile(found[1:], [0.025, 0.975])
    assert np.allclose([one.partial, one.ci_low, one.ci_high], [found[0], low, high], atol=1e-9) and one.excludes_zero == (low > 0 or high < 0)
    diff = np.array(found) - np.array(other)
    two = resampling.bootstrap_partial_diff(clean, "a", "b", "target", "base", "cell", 25, 4).first()
    assert np.allclose([two.diff, two.ci_low, two.ci_high], [diff[0], *np.quantile(diff[1:], [0.025, 0.975])], atol=1e-9)


def test_undefined_intervals(spark):
    one = spark.createDataFrame([(1, 1, float(i), float(-i), float(i), 0.1) for i in range(5)], COLUMNS)
    r = resampling.bootstrap_delta_rho(one, "a", "b", "target", "cell", 10).first()
    assert (r.delta_rho, r.ci_low, r.ci_high, r.n_boot, r.excludes_zero) == (2.0, None, None, 0, None)
    flat = spark.createDataFrame([(i, 1, 1.0, float(i), float(i), 0.1) for i in range(5)], COLUMNS)
    r = resampling.bootstrap_delta_rho(flat, "a", "b", "target", "cell", 10).first()
    assert (r.delta_rho, r.n_boot, r.excludes_zero) == (None, 0, None)


def test_specific_gain(spark):
    r = np.random.default_rng(5)
    conf, rand = r.normal(1.0, 0.5, 40), r.normal(0.2, 0.5, (5, 40)) + r.normal(0, 0.3, (5, 1))
    gains = [("c", i, float(x)) for i, x in enumerate(conf)] + [(f"r{k}", i, float(x)) for k in range(5) for i, x in enumerate(rand[k])]
    df = spark.createDataFrame(gains, "chain string, cell int, gain double").repartition(3)
    one = resampling.specific_gain(df, "c", 200, 3).first()
    means, diff = rand.mean(axis=1), conf - rand.mean(axis=0)
    pseudo = np.array([means[k] - np.delete(means, k).mean() for k in range(5)])
    want = {
        "n_cells": 40, "n_random_chains": 5, "configured_gain_mean": conf.mean(), "random_gain_mean": rand.mean(), "random_gain_sd_chains": means.std(ddof=1), "random_gain_se_chains": means.std(ddof=1) / math.sqrt(5),
        "specific_gain_mean": diff.mean(), "specific_gain_median": np.median(diff), "specific_fraction": diff.mean() / conf.mean(), "frac_cells_positive": (diff > 0).mean(), "rank_among_random": 1 + (means >= conf.mean()).sum(),
        "frac_cells_above_all_random": (conf > rand.max(axis=0)).mean(), "z_vs_random": (conf.mean() - means.mean()) / means.std(ddof=1), "null_sd": pseudo.std(ddof=1), "null_max": pseudo.max(), "null_empirical_p": (1 + (pseudo >= diff.mean()).sum()) / 6,
    }
    for name, x in want.items():
        assert math.isclose(one[name], x, rel_tol=1e-9, abs_tol=1e-12), name
    boot = []
    for d in range(1, 201):
        w, v = np.array([times(3, d, i) for i in range(40)]), np.array([times(4, d, f"r{k}") for k in range(5)])
        if w.sum() and v.sum():
            boot.append((w @ conf) / w.sum() - (v @ (rand @ w)) / (v.sum() * w.sum()))
    assert np.allclose([one.specific_gain_ci_low, one.specific_gain_ci_high], np.quantile(boot, [0.025, 0.975]))
    alone = resampling.specific_gain(df.where("chain IN ('c', 'r0')"), "c", 50, 3).first()
    assert alone.null_sd is None and alone.z_vs_random is None and alone.random_gain_sd_chains is None and alone.specific_gain_ci_low < alone.specific_gain_ci_high


def test_contrasts_and_verdict(clean, rows):
    sums = resampling.resampled_sums(clean, ["a", "b", "base"], "target", "cell", 40, 1)
    found = resampling.contrasts(sums, clean, "a", ("b", "base"), "target", "cell", flips=200)
    got = {r.baseline: r for r in found.collect()}
    cells = [c for c in sorted({x[0] for x in rows}) if sum(x[0] == c for x in rows) >= 10]
    of = lambda c, k: spearman([x[k] for x in rows if x[0] == c], [x[4] for x in rows if x[0] == c])
    diffs = [of(c, 2) - of(c, 3) for c in cells]
    assert got["b"].n == len(cells) and math.isclose(got["b"].mean_diff, np.mean(diffs), abs_tol=1e-9) and 0 < got["b"].p_value <= 1
    assert math.isclose(got["base"].delta_rho, spearman([x[2] for x in rows], [x[4] for x in rows]) - spearman([x[5] for x in rows], [x[4] for x in rows]), abs_tol=1e-9)
    own = resampling.bootstrap_partial(clean, "a", "target", "base", "cell", 40, 1)
    one = resampling.direction_verdict(found, own, ("b", "absent")).first()
    assert got["b"].excludes_zero and one.beats_required_baselines and one.adds_beyond_base_rank and one.passed and "b" in one.beats
    assert not resampling.direction_verdict(found, own, ("absent",)).first().passed  # nothing required was compared
    turned = found.withColumn("delta_rho", -F.col("delta_rho"))
    assert resampling.direction_verdict(turned, own, ("b",)).first().does_not_beat == ["b", "base"]


def test_method_scores(clean, rows):
    one = resampling.method_scores(clean, ["a"], "target", "cell", "token", "base", ks=(5,)).first()
    a, t, base = (np.array([x[k] for x in rows]) for k in (2, 4, 5))
    edges = np.quantile(base, [i / 20 for i in range(1, 20)])
    assert one.n_samples == len(rows) and math.isclose(one.pooled_spearman, spearman(a, t), abs_tol=1e-9)
    assert math.isclose(one.partial_spearman_given_base, partial(a, t, np.searchsorted(edges, base, side="right")), abs_tol=1e-9)
    rhos = [spearman([x[2] for x in rows if x[0] == c], [x[4] for x in rows if x[0] == c]) for c in {x[0] for x in rows} if sum(x[0] == c for x in rows) >= 10]
    assert one.n_cells_scored == len(rhos) and np.allclose([one.cellwise_spearman_q25, one.cellwise_spearman_median, one.cellwise_spearman_q75], np.quantile(rhos, [0.25, 0.5, 0.75]))
    assert one.n_genes_scored == len({x[1] for x in rows}) and -1 <= one.calibration_monotonicity <= 1


def test_base_control(clean, rows):
    got = {(r.method, r.stratum): r for r in resampling.base_control(clean, ["a"], "target", "token", "base").collect()}
    base, a, t = (np.array([x[k] for x in rows]) for k in (5, 2, 4))
    strata = np.searchsorted(np.quantile(base, [0.2, 0.4, 0.6, 0.8]), base, side="right")
    for s in range(5):
        assert got["a", s].n == (strata == s).sum() and math.isclose(got["a", s].spearman, spearman(a[strata == s], t[strata == s]), abs_tol=1e-9) and math.isclose(got["a", s].target_mean, t[strata == s].mean())
    assert math.isclose(got["base_rank", None].spearman, spearman(base, t), abs_tol=1e-9) and ("base_only", None) in got


def test_ranges(spark):
    """Ranks, numbers and quantiles over several ranges, with a value that a third of all rows have."""
    r = random.Random(1)
    xs = [0.0 if i % 3 == 0 else round(r.gauss(0, 1), 2) for i in range(2000)]
    df = spark.createDataFrame([(i, x, "uv"[i % 7 == 0]) for i, x in enumerate(xs)], "i int, x double, g string").repartition(6)
    want = dict(zip(xs, ranks(xs), strict=True))
    got = {r.value: (r["rank"], r.n) for r in ranking.average_ranks(df, "x").collect()}
    assert {k: v[0] for k, v in got.items()} == want and got[0.0][1] == xs.count(0.0)
    order = [r.i for r in ranking.numbered(df, F.desc("x"), "i").orderBy("position").collect()]
    assert order == sorted(range(2000), key=lambda i: (-xs[i], i))
    shares = [0.0, 0.05, 0.5, 0.77, 1.0]
    assert np.allclose(ranking.quantiles(df, "x", shares).first().quantiles, np.quantile(xs, shares))
    by = {r.g: r.quantiles for r in ranking.quantiles(df, "x", shares, "g").collect()}
    assert all(np.allclose(by[g], np.quantile([x for i, x in enumerate(xs) if "uv"[i % 7 == 0] == g], shares)) for g in "uv")
    assert ranking.quantiles(df.limit(0), "x", shares).collect() == []
    one = spark.createDataFrame([(1, 2.5, "a"), (2, None, "a"), (3, math.nan, "a"), (4, None, "b")], df.schema)
    assert [tuple(r) for r in ranking.quantiles(one, "x", [0.5], "g").collect()] == [("a", [2.5])]


def test_no_window_over_all_rows(spark, clean):
    """Windows without a partition see sums of ranges, not rows."""
    for made in (ranking.average_ranks(clean, "a"), ranking.numbered(clean, "a", "cell", "token"), ranking.partial_spearman(clean, "a", "target", "base"), stats.closeness(clean, "a", "target")):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        windows = [line for line in plan.splitlines() if "Window [" in line]
        assert all("_range" in w and ("[_range" in w.split("], [")[-1] or "_range" in w.split("],")[-2]) for w in windows), plan


def test_the_targets_ranks_are_counted_in_its_order_not_joined(spark, monkeypatch):
    rows = [(c, float((c * 7 + i * i) % 13), float((c + 5 * i) % 31) / 4, i % 3) for c in range(12) for i in range(40)]
    df = spark.createDataFrame(rows, "cell long, a double, target double, b int").repartition(5)
    ranked, whole = [], resampling.weighted_ranks
    monkeypatch.setattr(resampling, "weighted_ranks", lambda d, c: ranked.append(c) or whole(d, c))
    tell = lambda: {(r.draw, r.bin): r for r in resampling.resampled_sums(df, ["a"], "target", "cell", 3, 1, "b").collect()}
    plain = tell()
    assert ranked == ["_c0"]
    monkeypatch.setattr(resampling, "FEW", 2)  # the method's ranks are joined
    monkeypatch.setattr(resampling, "A_RANGE", 30)
    for k, r in tell().items():
        assert list(r)[3:] == pytest.approx(list(plain[k])[3:])
    rank = lambda xs: [sum(y < x for y in xs) + (xs.count(x) + 1) / 2 for x in xs]
    p, t = rank([r[1] for r in rows]), rank([r[2] for r in rows])
    for b in range(3):
        at = [i for i, r in enumerate(rows) if r[3] == b]
        want = [len(at), sum(p[i] for i in at), sum(t[i] for i in at), sum(p[i] ** 2 for i in at), sum(t[i] ** 2 for i in at), sum(p[i] * t[i] for i in at)]
        r = plain[0, b]
        assert [r.n, r.p, r.t, r.pp, r.tt, r.pt] == pytest.approx(want)
