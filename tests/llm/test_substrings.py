from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from ranklane.llm import substrings


def brute(rows):
    first, out = {}, []
    big = (1 << 63) - 1
    for key, text, *_ in rows:
        w = (text or "").encode().split()
        for i in range(len(w) - 49):
            k = tuple(w[i : i + 50])
            first[k] = min(first.get(k, big), big if key is None else key)
    for key, text, *_ in rows:
        w = (text or "").encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - 49):
            if first[tuple(w[i : i + 50])] < (big if key is None else key):
                gone[i : i + 50] = [True] * 50
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out.append((repr(key), len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize(("room", "shard"), [(25_000, 100_000), (300, 300), (0, 1000)])
def test_against_brute_force(docs, scratch, fixture_rows, monkeypatch, room, shard):
    """Whole segments, some cut again by longer anchors, and all of them down to single windows."""
    monkeypatch.setattr(substrings, "ROOM", room)
    monkeypatch.setattr(substrings, "SHARD_WORDS", shard)
    got = sorted((repr(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in substrings.remove_repeats(docs, scratch).collect())
    want = brute(fixture_rows)
    assert got == want and sum(w[2] for w in want) > 500


def depths(monkeypatch):
    """The depths of the contents that the index gets."""
    seen, index = [], substrings._index

    def spy(contents, shards):
        seen.append({r.depth: r.n for r in contents.groupBy("depth").count().withColumnRenamed("count", "n").collect()})
        return index(contents, shards)

    monkeypatch.setattr(substrings, "_index", spy)
    return seen


def test_a_line_in_many_copied_documents(spark, scratch, monkeypatch):
    """A line shorter than a window anchors segments of very many documents, each of which has a copy."""
    seen = depths(monkeypatch)
    r = random.Random(2)
    line = [f"l{i}" for i in range(36)]
    texts = [" ".join([*[f"w{r.randrange(9999)}" for _ in range(25)], *line, *[f"w{r.randrange(9999)}" for _ in range(25)]]) for _ in range(700)]
    rows = [(i, t) for i, t in zip(r.sample(range(9000), 1400), texts * 2, strict=True)]
    got = sorted((repr(x.doc_id), x.n_words, x.n_removed, x.kept_sha256) for x in substrings.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), scratch).collect())
    assert got == brute(rows) and sum(w[2] for w in got) == 700 * 86 and max(seen[0]) >= 1


def test_an_anchor_of_very_many_segments(spark, scratch, monkeypatch):
    """Over a thousand different segments of one anchor, all searched in the index, where windows inside the passage meet."""
    seen = depths(monkeypatch)
    r = random.Random(9)
    passage = [f"p{i}" for i in range(58)]
    rows = [(i, " ".join([f"w{r.randrange(9999)}" for _ in range(9)] + passage[r.randrange(3) :][: r.randrange(50, 60)] + [f"w{r.randrange(9999)}" for _ in range(9)])) for i in r.sample(range(5000), 1300)]
    got = sorted((repr(x.doc_id), x.n_words, x.n_removed, x.kept_sha256) for x in substrings.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), scratch).collect())
    assert got == brute(rows) and max(seen[0]) >= 1


def test_segments_cover_all_windows():
    r = random.Random(1)
    words = [str(r.randrange(60)).encode() for _ in range(400)]
    for gram in substrings.GRAMS:
        _, _, start, n = substrings.segments(words, gram)
        assert start[0] == 0 and (start[1:] == (start + n)[:-1]).all() and start[-1] + n[-1] == len(words) - 49 and n.max() <= 51 - gram


def test_texts_and_empty(docs, no_docs, scratch):
    for r in substrings.remove_repeats(docs, scratch, texts=True).collect():
        assert hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256
    assert substrings.remove_repeats(no_docs, scratch).count() == 0


def test_first_starts():
    r = random.Random(3)
    for _ in range(5):
        base = [str(r.randrange(50)).encode() for _ in range(300)]
        texts = []
        for _ in range(40):
            a = r.randrange(200)
            t = base[a : a + r.randrange(50, 93)]
            if r.random() < 0.5:
                t = [*t[: r.randrange(len(t))], b"x%d" % r.randrange(3), *t[r.randrange(len(t)) :]]
            texts.append(b" ".join([*t, *[b"y"] * 50][:max(50, min(92, len(t)))]))
        docs = np.array([r.randrange(1000) for _ in texts])
        first = {}
        for t, d in zip(texts, docs.tolist(), strict=True):
            w = t.split()
            for i in range(len(w) - 49):
                first[tuple(w[i : i + 50])] = min(first.get(tuple(w[i : i + 50]), 1 << 60), d)
        for t, got in zip(texts, substrings.first_starts(texts, docs), strict=True):
            w = t.split()
            assert got.tolist() == [first[tuple(w[i : i + 50])] for i in range(len(w) - 49)]
