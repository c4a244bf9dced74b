"""Reordering and goal shifts against plain Python; fits and projections against numpy."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ranklane.operators import chains, encode, ranking, rerank, vectors
from ranklane.operators import statistics as stats


@pytest.fixture(scope="module")
def study(spark):
    r = np.random.default_rng(7)
    cells = [(c, [int(x) for x in r.permutation(30)[: 3 + 4 * c]]) for c in range(6)] + [(9, [5])]
    vec = lambda: [float(x) for x in r.normal(size=3)]
    pert = {(c, t): vec() for c, ids in cells for t in ids}
    ctrl = {k: vec() for k in pert if k[1] % 6}
    frame = lambda d: spark.createDataFrame([(*k, v) for k, v in d.items()], "cell int, token bigint, vec array<double>")
    encoded = encode.from_lists(spark.createDataFrame(cells, "cell int, ids array<bigint>")).repartition(4)
    return cells, pert, ctrl, encoded, frame(pert), frame(ctrl)


def ordered(ids, shift, grid):
    base = [i / max(len(ids) - 1, 1) for i in range(len(ids))]
    p = [b + s for b, s in zip(base, shift, strict=True)]
    p = [round(x / grid) * grid for x in p] if grid else p  # halves to even
    return [ids[i] for i in sorted(range(len(ids)), key=lambda i: (p[i], i))]


def z(xs):
    sd = np.std(xs)
    return [0.0] * len(xs) if sd == 0 else [float((x - np.mean(xs)) / sd) for x in xs]


def clamped(xs, bound):
    return [max(-bound, min(bound, x)) for x in xs]


@pytest.mark.parametrize("grid", [0.0, 0.05])
def test_rules(study, spark, grid):
    cells, pert, ctrl, encoded, p, c = study
    w = [0.5, -1.0, 0.25]
    rows = rerank.state_changes(encoded, p, c)
    logit = lambda df: df.select("cell", "token", F.col("vec")[1].alias("logit"))
    delta = {t: (t % 7 - 3) / 5 for t in range(0, 30, 2)}
    tables = {
        "norm": rows, "linear": rows, "delta_mlm": rerank.logit_changes(encoded, logit(p), logit(c)), "contrast": rows.withColumn("contrast", F.transform("delta_h", lambda x: x / 2)),
        "teacher": rerank.with_teacher(encoded, spark.createDataFrame(list(delta.items()), "token bigint, delta double")),
    }
    for kind, table in tables.items():
        got = {r.cell: r for r in rerank.reorder(table, rerank.shift_of(kind, 0.3, 0.2, w), grid).collect()}
        for cell, ids in cells:
            dh = [np.array(pert[cell, t]) - np.array(ctrl[cell, t]) if (cell, t) in ctrl else np.zeros(3) for t in ids]
            dn = [float(np.linalg.norm(pert[cell, t]) - np.linalg.norm(ctrl[cell, t])) if (cell, t) in ctrl else 0.0 for t in ids]
            shift = {
                "norm": clamped([-0.3 * x for x in z(dn)], 0.2), "linear": [0.2 * math.tanh(float(d @ w)) for d in dh], "contrast": [0.2 * math.tanh(float(d @ w) / 2) for d in dh],
                "delta_mlm": clamped([-0.3 * x for x in z([float(d[1]) for d in dh])], 0.2), "teacher": clamped([delta.get(t, 0.0) for t in ids], 0.2),
            }[kind]
            want = ordered(ids, shift, grid)
            assert got[cell].before == ids and got[cell].after == want, (kind, cell)
            assert got[cell].moves == [j - ids.index(t) for j, t in enumerate(want)]
    with pytest.raises(ValueError, match="no rule"):
        rerank.shift_of("best", 1.0, 0.1)


def test_diagnostics(study):
    cells, _, _, encoded, p, c = study
    moved = rerank.reorder(rerank.state_changes(encoded, p, c), rerank.shift_of("norm", 0.5, 0.4))
    one, rows = rerank.diagnostics(moved, 5).first(), moved.collect()
    rho, d, f, j = [], [], [], []
    for r in rows:
        pos = [r.after.index(t) for t in r.before]
        n = len(pos)
        if n > 1:
            rho.append(np.corrcoef(range(n), pos)[0, 1])
        d.append(np.mean([abs(a - i) for i, a in enumerate(pos)]))
        f.append(np.mean([a != i for i, a in enumerate(pos)]))
        x, y = set(r.before[:5]), set(r.after[:5])
        j.append(len(x & y) / len(x | y))
    assert np.allclose([one.n_cells, one.spearman, one.mean_abs_displacement, one.frac_moved, one.top_jaccard], [len(cells), np.mean(rho), np.mean(d), np.mean(f), np.mean(j)])


def test_pool_lengths(spark):
    df = spark.createDataFrame([(10, 8)], "o int, p int")
    of = lambda *a, **k: tuple(df.select(*rerank.pool_lengths(*a, F.col("o"), F.col("p"), **k)).first())
    assert of("oe", 2) == (8, 6) and of("delete", 2) == (8, 8) and of("oe", 2, legacy=True) == (10, 8)


def test_goal_shifts(study, spark):
    """By place, with the edited keys taken out and the tail cut, the same as by key."""
    cells, pert, ctrl, *_ = study
    r = np.random.default_rng(1)
    tokens, goal = (4, 77), [1.0, -0.5, 0.25]
    cos = lambda a: float(a @ goal / (np.linalg.norm(a) * np.linalg.norm(goal)))
    vec = {k: [float(x) for x in r.normal(size=3)] for k in pert}
    schema, g = "cell int, token bigint, vec array<double>", spark.createDataFrame([(goal,)], "vec array<double>")
    lists = spark.createDataFrame(cells, "cell int, ids array<bigint>")
    original = spark.createDataFrame([(*k, v) for k, v in vec.items()], schema)
    for kind in ("oe", "kd"):
        after = {c: ([*tokens, *[t for t in ids if t not in tokens]][: len(ids)] if kind == "oe" else [t for t in ids if t not in tokens]) for c, ids in cells}
        new = {(c, t): [float(x) for x in r.normal(size=3)] for c, ids in after.items() for t in ids}
        got = {x.cell: x.goal_state_shift for x in rerank.aligned_goal_shift(lists, original, spark.createDataFrame([(*k, v) for k, v in new.items()], schema), g, tokens, kind).collect()}
        for c, ids in cells:
            old, rest = [t for t in ids if t not in tokens][: len(ids) - 2], after[c][2:] if kind == "oe" else after[c]
            if len(ids) > 2 and old and rest:
                want = cos(np.mean([new[c, t] for t in rest], axis=0)) - cos(np.mean([vec[c, t] for t in old], axis=0))
                assert math.isclose(got[c], want, abs_tol=1e-9), (kind, c)
        placed = lambda lists_of, values: spark.createDataFrame([(c, j, len(ids), values[c, t]) for c, ids in lists_of for j, t in enumerate(ids)], "cell int, pos int, len int, vec array<double>")
        got = {x.cell: x.goal_state_shift for x in rerank.mean_goal_shift(placed(cells, vec), placed(after.items(), new), g, 2).collect()}
        for c, ids in cells:
            if len(after[c]) > 2:
                assert math.isclose(got[c], cos(np.mean([new[c, t] for t in after[c][2:]], axis=0)) - cos(np.mean([vec[c, t] for t in ids], axis=0)), abs_tol=1e-9)


# operators that SQL cannot express

def test_projection(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(200, 6)) @ r.normal(size=(6, 6))
    rows = spark.createDataFrame([(i, [float(y) for y in v]) for i, v in enumerate(x)], "i int, v array<double>")
    got = np.array([r.pca for r in vectors.project(rows, "v", 2).orderBy("i").collect()])
    _, axes = np.linalg.eigh(np.cov(x.T))
    for k in range(2):
        want = x @ axes[:, -1 - k]
        assert min(np.abs(got[:, k] - want).max(), np.abs(got[:, k] + want).max()) < 1e-6


def test_clusters(spark):
    r = np.random.default_rng(4)
    centres = np.array([[0, 0], [20, 0], [0, 20]])
    rows = spark.createDataFrame([(i, [float(y) for y in centres[i % 3] + r.normal(size=2)]) for i in range(90)], "i int, v array<double>")
    got = {x.i: x.cluster for x in vectors.cluster(rows, "v", 2, 5).collect()}
    assert len(set(got.values())) == 3 and all(got[i] == got[i % 3] for i in got)


def test_signature(spark):
    rows = spark.createDataFrame([("a", [0.12345, -0.0001, 2.0]), ("b", [0.1236, 0.0, 1.0])], "state string, vec array<double>")
    got = {r.state: r.signature for r in vectors.signature(rows).collect()}
    assert got == {s: hashlib.sha256(f"{s}|{told}".encode()).hexdigest() for s, told in (("a", "0.123,0.000,2.000"), ("b", "0.124,0.000,1.000"))}


def test_mixture(spark):
    r = np.random.default_rng(5)
    v = np.concatenate([r.normal(-2, 0.5, 300), r.normal(3, 1.0, 700)])
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    means, variances, weights = stats.mixture(df, "v")
    assert np.allclose(means, [-2, 3], atol=0.15) and np.allclose(np.sqrt(variances), [0.5, 1.0], atol=0.1) and np.allclose(weights, [0.3, 0.7], atol=0.03)
    told = {round(x.v): x.i for x in df.withColumn("i", stats.impact(F.col("v"), means, variances, weights)).collect()}
    assert told[-2] == 1 and told[3] == 0 and told[-3] == 1


def test_decoder(spark):
    """Descends to about the least squares that a grid of weights finds."""
    r = np.random.default_rng(6)
    x = r.normal(size=(300, 2))
    y = 0.3 * np.tanh(x @ [1.5, -0.7])
    df = spark.createDataFrame([([float(a) for a in v], float(t)) for v, t in zip(x, y, strict=True)], "delta_h array<double>, target double")
    w = chains.fit_decoder(df, 2, 0.3, 60, 20.0, smooth=0.0)
    assert np.allclose(w, [1.5, -0.7], atol=0.05)


def test_significance(spark):
    df = spark.createDataFrame([(g, z) for g, z in enumerate((0.0, 1.0, -2.5, 6.0, 38.0))], "gene int, z double")
    got = {r.gene: r for r in stats.with_significance(df).collect()}
    p = {g: math.erfc(abs(z) / math.sqrt(2)) for g, z in enumerate((0.0, 1.0, -2.5, 6.0, 38.0))}
    order = sorted(p, key=p.get)
    for rank, g in enumerate(order, 1):
        assert math.isclose(got[g].p, p[g], rel_tol=1e-12, abs_tol=0) and math.isclose(got[g].fdr, min(1.0, min(p[h] * 5 / k for k, h in enumerate(order, 1) if k >= rank)), rel_tol=1e-9)


def test_quota_sample(spark):
    rows = spark.createDataFrame([(i, "abc"[i % 3]) for i in range(60)], "k int, grp string")
    quotas = spark.createDataFrame([("a", 20, 4), ("b", 20, 0), ("c", 20, 20)], "grp string, size int, quota int")
    got = {(r.grp, r.k) for r in ranking.stratified_sample(rows.repartition(5), quotas, "k", 8).collect()}
    key = lambda i: (hashlib.md5(f"8:{i}".encode()).hexdigest(), i)
    assert got == {("a", i) for i in sorted(range(0, 60, 3), key=key)[:4]} | {("c", i) for i in range(2, 60, 3)}
