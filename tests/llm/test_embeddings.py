from __future__ import annotations

import itertools
import math

import numpy as np
import pytest
from test_simhash import smallest

from ranklane.llm import embeddings


def brute(rows, threshold=0.95):
    def unit(v):
        if not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        a = np.array(v, float)
        a = a / np.abs(a).max()
        return a / np.linalg.norm(a)

    u = [unit(v) for _, v in rows]
    pairs = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if u[i] is not None and u[j] is not None and len(u[i]) == len(u[j]) and u[i] @ u[j] >= threshold]
    n = [0] * len(rows)
    for i, j in pairs:
        n[i] += 1
        n[j] += 1
    root = smallest(len(rows), pairs)
    return [(rows[i][0], n[i], rows[root[i]][0], rows[root[i]][0] == rows[i][0]) for i in range(len(rows))]


@pytest.mark.parametrize("tile", [2048, 7])
def test_against_brute_force(spark, scratch, monkeypatch, tile):
    monkeypatch.setattr(embeddings, "TILE", tile)
    monkeypatch.setattr(embeddings, "PAIRS", 10_000)
    r = np.random.default_rng(1)
    vectors = [r.normal(size=24) for _ in range(40)]
    vectors += [vectors[0] + 0.2 * r.normal(size=24) * np.linalg.norm(vectors[0]) / 5 for _ in range(30)]  # about the threshold
    vectors += [vectors[1]] * 5 + [3 * vectors[2], 1e-30 * vectors[2], 1e30 * vectors[2], np.zeros(24)]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    n = len(rows)
    rows += [(n, None), (n + 1, []), (n + 2, [float("nan")] * 24), (n + 3, [float("inf"), *rows[3][1][1:]]), (n + 4, [None, *rows[3][1][1:]]), (n + 5, [1.0]), (n + 6, [2.0]), (n + 7, [1.0, 2.0]), (n + 8, [1.0, 2.01])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3)
    got = sorted(map(tuple, embeddings.link(df, scratch).collect()))
    assert got == brute(rows)


def test_empty(spark, scratch):
    assert embeddings.link(spark.createDataFrame([], "vec_id bigint, embedding array<float>"), scratch).count() == 0


def test_null_and_repeated_ids(spark, scratch):
    rows = [(1, [1.0, 0.0], 0), (None, [1.0, 0.0], 1), (None, [1.0, 0.01], 2), (2, [1.0, 0.02], 3), (7, [0.0, 1.0], 4), (7, [-1.0, 0.0], 5), (None, [-1.0, 0.01], 6), (None, [5.0, -5.0], 7), (None, None, 8)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, node bigint").repartition(2)
    got = sorted(map(tuple, embeddings.link(df, scratch).collect()), key=repr)
    want = [(1, 3, 1, True), (None, 3, 1, False), (None, 3, 1, False), (2, 3, 1, False), (7, 0, 7, True), (7, 1, 7, True), (None, 1, 7, False), (None, 0, None, True), (None, 0, None, True)]
    assert got == sorted(want, key=repr)


def test_forest_connects_what_links_do():
    r = np.random.default_rng(5)
    for size in (3, 40, 300):
        left, right = np.nonzero(r.random((60, 50)) < size / 3000)
        some = embeddings._forest(left, right)
        assert len(some[0]) <= 110
        whole, few = (smallest(110, [(a, 60 + b) for a, b in zip(*x, strict=True)]) for x in ((left.tolist(), right.tolist()), (some[0].tolist(), some[1].tolist())))
        assert whole == few
