from __future__ import annotations

import itertools
import re

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ranklane.llm import simhash
from ranklane.llm.common import components

LOWER = {i: i + 32 for i in range(65, 91)}


def plain(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def smallest(n, pairs):
    p = list(range(n))

    def find(x):
        while p[x] != x:
            x = p[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        p[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_masks_cover_every_pair_within_the_radius():
    masks = simhash.covering_masks()
    assert len(masks) == 7 and all(32 <= m.bit_count() <= 40 for m in masks)
    for a, b in itertools.combinations(range(64), 2):
        assert any(not (m >> a & 1) and not (m >> b & 1) for m in masks)


def test_against_brute_force(spark, docs, scratch, fixture_rows):
    prints = [plain(r[1]) for r in fixture_rows]
    ids = [r[0] for r in fixture_rows]
    root = smallest(len(ids), [(i, j) for i, j in itertools.combinations(range(len(ids)), 2) if (prints[i] ^ prints[j]).bit_count() <= 2])
    best = {}
    for i, r in enumerate(root):
        best[r] = min((x for x in (best.get(r), ids[i]) if x is not None), default=None)
    want = sorted((repr(ids[i]), format(prints[i], "016x"), best[root[i]]) for i in range(len(ids)))
    got = sorted((repr(r.doc_id), r.fingerprint, r.component_id) for r in simhash.digest(simhash.near_duplicates(docs, scratch)).collect())
    assert got == want
    kept = {r.doc_id for r in simhash.keep_first(docs, scratch).collect()}
    assert kept == {x for x in best.values()}
    assert simhash.keep_first(docs, scratch).columns == docs.columns


def test_many_close_fingerprints(spark, scratch):
    r = np.random.default_rng(3)
    centre = int(r.integers(1 << 62))
    values = {centre ^ (1 << int(a)) ^ (1 << int(b)) for a, b in r.integers(0, 62, (400, 2))} | {int(x) for x in r.integers(0, 1 << 62, 100)}
    values = sorted(values)
    root = smallest(len(values), [(i, j) for i, j in itertools.combinations(range(len(values)), 2) if (values[i] ^ values[j]).bit_count() <= 2])
    edges = simhash.links(spark.createDataFrame([(v,) for v in values], "fp bigint"))
    got = {r.node: r.component for r in components(edges, scratch).collect()}
    assert all(got.get(v, v) == values[root[i]] for i, v in enumerate(values))


def test_chain_of_links(spark, scratch):
    edges = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.component for r in components(edges, scratch).collect()} == {0}


def test_empty(no_docs, scratch):
    assert simhash.near_duplicates(no_docs, scratch).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60))
def test_fingerprint_of_any_text(text):
    text = text.encode("utf-8", "ignore").decode()
    assert simhash.fingerprint(text) & ((1 << 64) - 1) == plain(text)
