from __future__ import annotations

import itertools
import random
import re

import numpy as np

from ranklane.llm import simhash
from tests.llm.test_simhash import LOWER, smallest


def plain(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def near(a, b):
    return not (a or b) or len(a & b) * 5 >= 4 * len(a | b)


def kept(rows):
    sets = [plain(t) for _, t in rows]
    root = smallest(len(rows), [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if near(sets[i], sets[j])])
    best = {}
    for (key, _), r in zip(rows, root, strict=True):
        best[r] = min((x for x in (best.get(r), key) if x is not None), default=None)
    return set(best.values())


def test_stage_drops_what_five_words_say(spark, scratch):
    r = random.Random(8)
    rows, far = [], 0
    for family in range(40):
        text = [f"w{r.randrange(900)}" for _ in range(r.randrange(8, 300))]
        passage = ["licensed", "under", "the", "same", "terms", "as", "all", "others", "here"]
        for _ in range(r.randrange(1, 9)):
            copy = list(text)
            for _ in range(r.randrange(0, max(2, len(text) // 25))):
                copy[r.randrange(len(copy))] = f"x{r.randrange(900)}"
            rows.append((len(rows), " ".join(copy + passage * (family % 2))))
    rows += [(500, None), (501, " "), (502, "one two"), (503, "One  two"), (504, "one two three")]
    sets, prints = [plain(t) for _, t in rows], [simhash.fingerprint(t) for _, t in rows]
    for i, j in itertools.combinations(range(len(rows)), 2):
        far += near(sets[i], sets[j]) and (prints[i] ^ prints[j]).bit_count() > simhash.RADIUS
    assert far > 20  # pairs that op1's radius does not reach
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = simhash.keep_similar(docs, scratch)
    assert got.columns == docs.columns and {x.doc_id for x in got.collect()} == kept(rows)


def test_fixture_against_brute_force(docs, no_docs, scratch, fixture_rows):
    got = simhash.keep_similar(docs, scratch)
    assert got.columns == docs.columns and {x.doc_id for x in got.collect()} == kept([(x[0], x[1]) for x in fixture_rows])
    assert simhash.keep_similar(no_docs, scratch).count() == 0


def test_sketches_never_tell_too_much():
    r = random.Random(2)
    for _ in range(200):
        a = {r.randrange(-(1 << 63), 1 << 63) for _ in range(r.randrange(1, 300))}
        b = set(r.sample(sorted(a), r.randrange(len(a)))) | {r.randrange(-(1 << 63), 1 << 63) for _ in range(r.randrange(1, 60))}
        odd = [np.bincount(np.array(sorted(x), np.int64) & (64 * simhash.PARTS - 1), minlength=64 * simhash.PARTS) & 1 for x in (a, b)]
        assert (odd[0] != odd[1]).sum() <= len(a ^ b)


def test_rows_of_one_id(spark, scratch):
    rows = [(1, "a b c d e f"), (1, "p q r s t u"), (0, "p q r s t u"), (None, "a b c d e f"), (None, "x y z x y w"), (None, "x y z x y w")]
    got = simhash.keep_similar(spark.createDataFrame(rows, "doc_id bigint, text string"), scratch).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in got) == [(False, 0, rows[2][1]), (False, 1, rows[0][1]), (True, 0, rows[4][1]), (True, 0, rows[4][1])]
