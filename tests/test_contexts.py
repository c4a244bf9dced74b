"""Sketches, placebo counterfactuals and contexts against plain Python."""

from __future__ import annotations

import hashlib
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from ranklane.operators import counterfactuals as cf
from ranklane.operators import encode, profiles, sketches
from ranklane.sources.shared import kept


@pytest.fixture(scope="module")
def vectors():
    """Two groups of skewed, tied and ragged vectors with nulls and non-finite numbers."""
    r = np.random.default_rng(2)
    rows = []
    for i in range(6000):
        v = [float(r.normal()), float(r.lognormal(sigma=2)), float(r.integers(0, 3)), -float(i)]
        v = v[:3] if i % 5 == 0 else v
        if i % 11 == 0:
            v[0] = (None, math.nan, math.inf, -math.inf)[i // 11 % 4]
        rows.append((i, "ab"[i % 3 == 0], v))
    return [*rows, (6001, "a", None), (6002, "b", []), (6003, None, [1.0, 2.0])]


def exact(rows, group, i):
    return np.array([v[i] for _, g, v in rows if g == group and v and len(v) > i and v[i] is not None and math.isfinite(v[i])])


@pytest.mark.parametrize(("pending", "held"), [(1 << 18, 4_000_000), (500, 600)])
def test_digests(spark, vectors, monkeypatch, pending, held):
    monkeypatch.setattr(sketches, "PENDING", pending)
    monkeypatch.setattr(sketches, "HELD", held)
    df = spark.createDataFrame(vectors, "id int, g string, v array<double>").repartition(5)
    found = sketches.digests(df, "v", "g").withColumn("t", sketches.trimmed_mean("means", "weights", F.lit(0.1), F.lit(0.9))).collect()
    assert {(r.g, r.i) for r in found} == {(g, i) for g in "ab" for i in range(4)} | {(None, 0), (None, 1)}
    for r in found:
        x = exact(vectors, r.g, r.i)
        assert (r.n, r.low, r.high) == (len(x), x.min(), x.max()) and math.isclose(r.total, x.sum(), rel_tol=1e-9, abs_tol=1e-9)
        assert len(r.means) <= 201 and math.isclose(sum(r.weights), len(x))
        for q in (0.01, 0.25, 0.5, 0.75, 0.99):
            got = sketches.value_at(np.array(r.means), np.array(r.weights), r.low, r.high, q)
            assert (x < got - 1e-9).mean() - 0.01 <= q <= (x <= got + 1e-9).mean() + 0.01 + 1 / len(x), (r.g, r.i, q)
        if len(x) > 100 and r.i != 1:
            inner = np.sort(x)[round(0.1 * len(x)) : round(0.9 * len(x))]
            assert abs(r.t - inner.mean()) <= 0.01 * (x.max() - x.min())


def test_summaries(spark, vectors):
    df = spark.createDataFrame(vectors, "id int, g string, v array<double>").where("g = 'a'")
    mean, = sketches.summarise_vectors(df, "v", "mean").collect()
    assert np.allclose(mean.vec, [exact(vectors, "a", i).mean() for i in range(4)])
    one = spark.createDataFrame([("x", [1.0, 5.0]), ("x", [3.0, None]), ("x", [2.0, 7.0])], "g string, v array<float>")
    assert [tuple(r) for r in sketches.summarise_vectors(one, "v", "median", "g").collect()] == [("x", [2.0, 6.0])]
    assert sketches.digests(df.limit(0), "v", "g").collect() == []
    with pytest.raises(ValueError, match="mean"):
        sketches.summarise_vectors(df, "v", "mode")


def test_bottom_k(spark):
    rows = [(f"s{i % 7 if i % 2 else 0}", i) for i in range(3000)] + [(None, 1), ("s1", None)]
    want = {}
    for s, c in rows:
        if s and c is not None:
            want.setdefault(s, []).append((hashlib.md5(f"9:{c}".encode()).hexdigest(), c))
    want = sorted((s, c) for s, found in want.items() for _, c in sorted(found)[:250])
    for parts in (1, 9):
        df = spark.createDataFrame(rows, "s string, c bigint").repartition(parts)
        assert sorted(map(tuple, sketches.bottom_k(df, "s", "c", 250, 9).collect())) == want
    sizes = {s: sum(s == t for t, _ in want) for s, _ in want}
    assert sizes["s0"] == 250 and 0 < sizes["s3"] < 250  # one group is cut, another is whole


def test_positions_are_written(spark, tmp_path):
    e = encode.from_lists(spark.createDataFrame([(c, [10 + c % 3, 11 + c % 5, 40]) for c in range(30)], "cell bigint, ids array<bigint>"))
    cells = spark.createDataFrame([(c, "up" if c < 8 else "down") for c in range(40)], "cell bigint, state string")
    profiles.write_positions(e, cells, spark.createDataFrame([(10, "A"), (11, "B")], "token bigint, symbol string"), str(tmp_path), 10, {"up": "start", "down": "goal"})
    read = lambda name: spark.read.csv(f"{tmp_path}/{name}", header=True, inferSchema=True)
    by_state = {name: {r.token: r.n_cells for r in read(f"{name}_positions").collect()} for name in ("start", "goal")}
    assert by_state["start"][40] == 8 and by_state["goal"][40] == 10 and read("genes").count() == 2


def undo(ids, start, sub):
    oe, ko = dict(sub.oe), dict(sub.ko)
    held = {c: p for c, p in ko.items() if c in start}
    if any(p not in ids for p in held.values()):
        return None, None
    active = {c: p for c, p in oe.items() if c in ids}
    new = [active.get(x, x) for x in ids if x in active or x not in active.values()]
    front = next((i for i, x in enumerate(new) if x not in active.values()), len(new))
    for c in sorted(held, key=start.index):
        if c in new:
            continue
        before = [a for a in start[: start.index(c)] if a in new and a not in oe.values() and a not in ko.values()]
        new.insert(new.index(before[-1]) + 1 if before else front, c)
    return [x for x in new if x not in held.values()], sorted({*active, *active.values(), *held.values()})


def test_undo_delete_redo(spark):
    r = random.Random(6)
    sub = cf.Substitution({1: 21, 2: 22}, {3: 23, 4: 24, 5: 25})
    rows = []
    for cell in range(400):
        start = r.sample(range(1, 30), r.randrange(0, 26))
        ids = [x for x in ([1, 2, *[x for x in start if x not in (1, 2)]][: len(start)] if r.random() < 0.7 else r.sample(start, len(start))) if x not in (3, 4, 5) or r.random() < 0.2]
        rows.append((cell, ids, start))
    df = spark.createDataFrame(rows, "cell int, ids array<bigint>, start array<bigint>")
    new, excluded = cf.undo_delete_redo(F.col("ids"), F.col("start"), sub)
    got = {x.cell: (x.new, x.excluded and sorted(x.excluded)) for x in df.select("cell", new.alias("new"), excluded.alias("excluded")).collect()}
    nulls = 0
    for cell, ids, start in rows:
        want = undo(ids, start, sub)
        nulls += want[0] is None
        assert got[cell][0] == want[0] and (want[0] is None or got[cell][1] == want[1]), (ids, start)
    assert 20 < nulls < 380
    cut = df.select(cf.undo_delete_redo(F.col("ids"), F.col("start"), sub, 5)[0].alias("n")).where("n IS NOT NULL").collect()
    assert max(len(x.n) for x in cut) == 5


def test_restored_before_any_rerank(spark):
    """Undoing a deletion gives back the start list without the placebo's key; an absent placebo key gives nothing."""
    start = [5, 6, 7, 8, 9]
    df = spark.createDataFrame([(start, [5, 6, 8, 9])], "start array<bigint>, ids array<bigint>")
    one = lambda ko: df.select(*cf.undo_delete_redo(F.col("ids"), F.col("start"), cf.Substitution({}, ko))).first()
    assert one({7: 9})[0] == [5, 6, 7, 8] and one({7: 99})[0] is None and one({70: 99})[0] == [5, 6, 8, 9]


def test_substitutions(spark):
    steps = [("OE", (1, 2)), ("knockout", (3,))]
    subs = cf.substitutions(steps, [[(11, 12), (13,)], [(11, 3), (13,)]])
    assert subs == [cf.Substitution({1: 11, 2: 12}, {3: 13})]
    with pytest.raises(ValueError, match="shares"):
        cf.substitutions(steps, [[(1, 12), (13,)]])
    with pytest.raises(ValueError, match="2 keys"):
        cf.substitutions(steps, [[(11, 12), ()]])
    df = spark.createDataFrame([([3, 13],), ([3],), ([7],)], "s array<bigint>")
    assert [x[0] for x in df.select(cf.usable_placebos(F.col("s"), subs)).collect()] == [1, 0, 1]


def test_placebo_mediator(spark):
    r = np.random.default_rng(8)
    vec = lambda: [float(x) for x in r.normal(size=3)]
    pert = [(c, t, vec()) for c in range(4) for t in range(6)]
    ctrl = [(c, t, vec()) for c, t, _ in pert if t != 5] + [(0, 77, vec())]
    edits = [(p, c, (p + c) % 3 != 0, [] if c == 3 or (p, c) == (1, 1) else [p, 90]) for p in range(3) for c in range(4)]
    states = [(p, c, t, vec()) for p in range(3) for c in range(3) for t in range(5) if (p + t) % 4]
    frames = [spark.createDataFrame(pert, "cell int, token int, vec array<double>"), spark.createDataFrame(ctrl, "cell int, token int, vec array<double>"), spark.createDataFrame(edits, "placebo int, cell int, usable boolean, excluded array<int>"), spark.createDataFrame(states, "placebo int, cell int, token int, vec array<double>")]
    out = cf.placebo_mediator(*frames)
    got = {(x.cell, x.token): (x.mediator, x.n_placebos) for x in out.collect()}
    control, state = {(c, t): np.array(v) for c, t, v in ctrl}, {(p, c, t): np.array(v) for p, c, t, v in states}
    contrast = {(x.cell, x.token): (x.contrast, x.valid) for x in cf.placebo_contrast(frames[0], frames[1], out).collect()}
    assert set(got) == {(c, t) for c, t, _ in pert}
    for c, t, v in pert:
        found = []
        for p, cell, usable, excluded in edits:
            if cell != c or not usable or (c, t) not in control:
                continue
            if not excluded:
                found.append(np.array(v) - control[c, t])
            elif t not in excluded and (p, c, t) in state:
                found.append(state[p, c, t] - control[c, t])
        want = np.mean(found, axis=0) if found else np.zeros(3)
        assert got[c, t][1] == len(found) and np.allclose(got[c, t][0], want)
        valid = (c, t) in control
        assert contrast[c, t][1] == valid and np.allclose(contrast[c, t][0], np.array(v) - control[c, t] - want if valid else np.zeros(3))
    assert {n for _, n in got.values()} >= {0, 1, 2}


def test_context_cosines(spark):
    """By position, as lists of rows with the edited keys taken out, the same as by key."""
    r = np.random.default_rng(1)
    vec = lambda: [float(x) for x in r.normal(size=4)]
    tokens = (3, 50)
    cells = [(c, [int(x) for x in r.permutation(9)[: 4 + c]]) for c in range(5)]
    after_ids = {c: [*tokens, *[x for x in ids if x not in tokens]][: len(ids)] for c, ids in cells}
    before, after = [(c, t, vec()) for c, ids in cells for t in ids], [(c, t, vec()) for c, ids in after_ids.items() for t in ids]
    before[0] = (*before[0][:2], [0.0] * 4)
    schema = "cell int, token bigint, vec array<double>"
    found = cf.context_cosines(spark.createDataFrame(cells, "cell int, ids array<bigint>"), spark.createDataFrame(before, schema), spark.createDataFrame(after, schema), tokens)
    got = {(x.cell, x.token): x.cos for x in found.collect()}
    va, vb = {(c, t): np.array(v) for c, t, v in before}, {(c, t): np.array(v) for c, t, v in after}
    want = {}
    for c, ids in cells:
        old = [x for x in ids if x not in tokens]
        new = after_ids[c][2:]
        for j in range(len(ids) - 2):
            if j < len(old) and j < len(new):
                assert old[j] == new[j]
                a, b = va[c, old[j]], vb[c, new[j]]
                want[c, old[j]] = float(a @ b / np.sqrt((a @ a) * (b @ b))) if (a @ a) else 0.0
    assert set(got) == set(want) and all(math.isclose(got[k], want[k], abs_tol=1e-12) for k in want)
    scores = {x.cell: (x.n, x.score) for x in cf.context_scores(found).collect()}
    assert scores[4][0] == sum(c == 4 for c, _ in want) and math.isclose(scores[4][1], np.mean([v for (c, _), v in want.items() if c == 4]))
    assert {x.token: x.n for x in cf.key_scores(found).collect()} == {t: sum(k[1] == t for k in want) for t in {k[1] for k in want}}


def test_sampled_keys(spark):
    cells = [(c, list(range(c, c + 12))) for c in range(6)]
    e = encode.from_lists(spark.createDataFrame(cells, "cell bigint, ids array<bigint>"))
    targets = spark.createDataFrame([(t, t / 10) for t in range(0, 20, 2)], "token bigint, target double")
    keep = spark.createDataFrame([(t,) for t in range(10)], "token bigint")
    for most, kept in ((3, None), (0, None), (2, keep)):
        want = set()
        for c, ids in cells:
            usable = [(hashlib.md5(f"4:{c}:{j}".encode()).hexdigest(), j, t) for j, t in enumerate(ids) if t % 2 == 0 and t < 20 and (kept is None or t < 10)]
            want |= {(c, j, t, j / 11, t / 10) for _, j, t in sorted(usable)[: most or None]}
        got = cf.sampled_keys(e.repartition(3), targets, most, 4, kept).collect()
        assert {tuple(x) for x in got} == want and len(got) == len(want)
    state = lambda scale: e.select("cell", "token", F.array(F.col("token") * scale, F.lit(1.0)).alias("vec"))
    rows = cf.training_samples(e, targets, state(2.0), state(1.0).where("token <> 4"), max_cells=2).collect()
    assert {x.token for x in rows} == {0, 2, 4, 6, 8, 10, 12} and all(x.delta_h == ([0.0, 0.0] if x.token == 4 else [float(x.token), 0.0]) for x in rows)


def test_swapped_keys_are_found_once_a_row(spark):
    """Not once for each key: 40 lists of 4,000 keys take about as long as 400 of 400, not ten times as long."""
    subs = [cf.Substitution({1: 5_001, 2: 5_002}, {3: 7, 4: 8})]

    def seconds(size: int, many: int) -> float:
        cells = kept(spark.range(many, numPartitions=1).select(F.col("id").alias("cell"), F.sequence(F.lit(1), F.lit(size)).cast("array<bigint>").alias("start")).withColumn("ids", F.col("start")))
        began = time.perf_counter()
        assert cf.counterfactual_lists(cells, subs).agg(F.sum(F.size("ids"))).first()[0] == many * (size - 2)
        return time.perf_counter() - began

    seconds(400, 10)  # code is loaded
    assert seconds(4_000, 40) < 4 * max(seconds(400, 400), 0.5)
