from __future__ import annotations

import math

import numpy as np
import pytest

from ranklane.llm import topk


def brute(rows, every=50, k=5, bound=2**28 - 1):
    q = []
    for i, v in rows:
        fine = v and all(x is not None and math.isfinite(x) for x in v)
        q.append([max(-bound, min(bound, math.floor(256 * x))) for x in v] if fine else None)
    out = []
    for a, (i, _) in enumerate(rows):
        if q[a] is None or i is None or i % every:
            continue
        found = [(-sum(x * y for x, y in zip(q[a], q[b])), math.inf if rows[b][0] is None else rows[b][0]) for b in range(len(rows)) if b != a and q[b] is not None and len(q[b]) == len(q[a])]
        out += [(i, r, None if c == math.inf else c, -s) for r, (s, c) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def got(df):
    assert df.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("block", [2048, 37])
def test_against_brute_force(spark, scratch, monkeypatch, block):
    """Ties and copies across blocks, repeated and null ids, odd vectors, other lengths, few candidates, clashing columns."""
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "BLOCKS", 10_000)
    monkeypatch.setattr(topk, "CHUNK", 3 if block < 100 else 32768)
    r = np.random.default_rng(3)
    vectors = [[float(x) for x in r.normal(size=20) / 4] for _ in range(200)]
    vectors += [vectors[50]] * 60 + [[round(x, 1) for x in v] for v in vectors[:40]] + [[0.0] * 20, [-1.0] * 20, [1e30] * 20, [-1e30] + [0.0] * 19]
    vectors += [None, [], [None] * 20, [math.nan] * 20, [math.inf] * 20, [0.5, -0.25], [1.0, 2.0], [3.0]]
    rows = [*enumerate(vectors), (50, vectors[7]), (50, vectors[50]), (None, vectors[50]), (None, vectors[8]), (-100, vectors[9]), (300_000, [0.125, 0.5]), (350_000, [-3.0])]
    df = spark.createDataFrame([(i, v, 1, 2, "b") for i, v in rows], "vec_id bigint, embedding array<double>, row int, q int, block string").repartition(3)
    bound = {20: 2**28 - 1, 2: 2**30 - 1, 1: 2**31 - 1}
    want = [x for dims in bound for x in brute([p for p in rows if p[1] and len(p[1]) == dims], bound=bound[dims])]
    assert got(topk.nearest(df, scratch)) == sorted(want, key=str)


def test_wide_scores():
    """Many binary digits, one component, fewer rows than k, all scores equal."""
    r = np.random.default_rng(4)
    for rows, dims, most in ((130, 3, 2**28), (64, 1, 5), (3, 4, 100), (70, 2, 1), (200, 64, 130)):
        v = r.integers(-most, most, (rows, dims))
        bitmaps, depth = topk.slices_of(v)
        for j, places, scores in topk.search_block(bitmaps, depth, rows, v, np.arange(rows), 5):
            s = v @ v[j]
            best = [i for i in np.lexsort((np.arange(rows), -s)) if i != j][:5]
            assert sorted(zip(-scores, places)) == [(-s[i], i) for i in best]


def test_empty(spark, scratch):
    df = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert got(topk.nearest(df, scratch)) == []
    assert got(topk.nearest(spark.createDataFrame([(3, [1.0])], df.schema), scratch)) == []
    assert got(topk.nearest(spark.createDataFrame([(0, [1.0])], df.schema), scratch)) == []


def test_own_queries(spark, scratch):
    """The index serves queries that are not rows of it."""
    rows = topk.numbered(spark.createDataFrame([(i, [float(i), 1.0]) for i in range(10)], "vec_id bigint, embedding array<double>"), scratch)
    index, blocks = topk.build_index(rows, scratch)
    asked = spark.createDataFrame([(-1, 77, [1, 0])], "query bigint, query_id bigint, q array<int>")
    assert [tuple(r) for r in topk.search(index, blocks, asked, 2).orderBy("rank").collect()] == [(-1, 77, 1, 9, 2304), (-1, 77, 2, 8, 2048)]
