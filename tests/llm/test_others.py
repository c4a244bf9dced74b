"""Mixing, language ID, toxicity, URL filters and multiset hashes."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from ranklane.llm import langid, mixing, multisethash, toxicity, urlfilter


# mixing

def water(sizes, weights=(5, 2, 1), most=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    total, full, target = sum(sizes.values()), set(), {}
    while True:
        left = total - sum(most * sizes[s] for s in full)
        share = sum(w[s] for s in order if s not in full)
        target = {s: most * sizes[s] if s in full else left * w[s] / share for s in order}
        over = {s for s in order if s not in full and target[s] > most * sizes[s]}
        if not over:
            return target
        full |= over


def test_mix_meets_its_targets(spark, scratch):
    r = random.Random(4)
    rows = [(i, " ".join(["w"] * r.choice([0, 3, 10, 40, 200])), r.choice(["hot"] * 6 + ["a", "b", None, "tiny"])) for i in range(2000)]
    rows = [x for x in rows if x[2] != "tiny"] + [(9000, "one two", "tiny")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(5)
    got = mixing.plan_mix(df, scratch).select("row.doc_id", "row.source", "_mix.*").collect()
    sizes, taken = defaultdict(int), defaultdict(int)
    for x in got:
        sizes[x.source] += x.size
        taken[x.source] += x.size * x.copies
        assert 0 <= x.copies <= 3
    want = water(dict(sizes))
    for x in got:
        assert x.source_size == sizes[x.source] and abs(x.target - want[x.source]) < 1e-6
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(3, 0.001 * want[s])
    again = mixing.plan_mix(df.repartition(2), scratch).select("row.doc_id", "_mix.copies").collect()
    assert sorted(map(tuple, again)) == sorted((x.doc_id, x.copies) for x in got)
    mixed = mixing.mix(df, scratch)
    assert mixed.columns == df.columns and mixed.count() == sum(x.copies for x in got)


def test_inclusion_follows_the_weights(spark, scratch):
    r = random.Random(12)
    rows = [(i, "w " * r.choice([5, 20, 80]), f"s{i % 3}", float(r.choice([1, 2, 4]))) for i in range(6000)] + [(9000, "a b", "s0", None), (9001, "a b", "s0", -1.0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, weight double").repartition(4)
    got = mixing.plan_mix(df, scratch, weight_col="weight", share=0.35).select("row.doc_id", "row.weight", "row.source", "_mix.*").collect()
    assert all(int(x.expected) <= x.copies <= int(x.expected) + 1 and x.copies <= 3 for x in got)
    assert {x.copies for x in got if x.doc_id >= 9000} == {0}
    groups, taken = defaultdict(list), defaultdict(int)
    for x in got:
        groups[x.source, x.weight, x.size].append(x)
        taken[x.source, x.target] += x.size * x.copies
    assert all(abs(n - target) <= 80 for (_, target), n in taken.items())
    off = []
    for (_, weight, _), members in groups.items():
        want, n = members[0].expected, len(members)
        assert weight is None or weight < 0 or any(abs(want / m.expected - weight / m.weight) < 1e-6 for m in got if m.source == members[0].source and m.weight == 1.0)
        off.append((sum(m.copies for m in members) - n * want) / max(1.0, (n * (want % 1) * (1 - want % 1)) ** 0.5))
    assert max(map(abs, off)) < 4 and abs(sum(off) / len(off)) < 0.5  # drawn as intended, short and long ones alike


def test_pareto_keys(spark):
    from pyspark.sql import functions as F

    got = spark.createDataFrame([(0.3, 0.3), (0.2, 0.5), (0.5, 0.2), (1e-12, 1.0), (0.999999, 0.0)], "u double, p double").select(mixing.pareto_rank(F.col("u"), F.col("p")).alias("k")).collect()
    odds = lambda x: x / (1 - x)
    assert [round(x.k / (1 - x.k), 9) for x in got[:3]] == [round(odds(u) / odds(p), 9) for u, p in ((0.3, 0.3), (0.2, 0.5), (0.5, 0.2))]
    assert got[3].k < 1e-15 and 0.999 < got[4].k < 1


def test_mix_edges(docs, no_docs, scratch, fixture_rows):
    assert mixing.plan_mix(docs, scratch).count() == len(fixture_rows)
    assert mixing.plan_mix(no_docs, scratch).count() == 0
    assert mixing.mix(docs, scratch).columns == docs.columns


# language ID

SYLLABLES = {"aa": "ka mo ti ru se".split(), "bb": "schw pf ung ich tz".split(), "cc": "é çon ê eau où".split()}


def test_held_out_accuracy(spark):
    r = random.Random(2)
    rows = [(i, " ".join("".join(r.choices(SYLLABLES[lang], k=3)) for _ in range(r.randrange(3, 60))), lang) for i in range(600) for lang in [r.choice(list(SYLLABLES))]]
    rows += [(1000, None, "aa"), (1001, "", "aa"), (1002, "12 34 !?", "bb"), (1003, "ung " * 200_000, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = {x.row.doc_id: x for x in langid.identify(df).collect()}
    held = [x for x in got.values() if x.held_out and x.row.doc_id < 1000]
    assert held and all(zlib.crc32(str(x.row.doc_id).encode()) % 4 == 2 for x in held)
    assert sum(x.lang_pred == x.row.lang for x in held) >= 0.98 * len(held)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 and got[i].rejected for i in (1000, 1001, 1002))
    assert got[1003].lang_pred == "bb" and all(0 <= x.score <= 1 for x in got.values())


def test_language_edges(docs, no_docs, fixture_rows):
    assert langid.identify(docs).count() == len(fixture_rows)
    assert langid.identify(no_docs).count() == 0


def test_texts_of_two_languages_are_rejected(spark):
    r = random.Random(3)
    word = lambda lang: "".join(r.choices(SYLLABLES[lang], k=3))
    rows = [(i, " ".join(word(lang) for _ in range(r.randrange(20, 60))), lang) for i in range(900) for lang in [r.choice(list(SYLLABLES))]]
    mixed = [(5000 + i, " ".join(word(lang) for lang in r.sample(sorted(SYLLABLES), 2) for _ in range(30)), None) for i in range(100)]
    got = langid.identify(spark.createDataFrame(rows + mixed, "doc_id bigint, text string, lang string")).collect()
    clean, two = [[x for x in got if (x.row.doc_id >= 5000) == side] for side in (False, True)]
    assert sum(x.rejected for x in clean) <= 0.005 * len(clean)
    assert sum(x.rejected for x in two) >= 0.3 * len(two)  # halves by words are seldom halves by n-grams


def test_the_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE", 40)
    seen = []
    monkeypatch.setattr(langid, "fit", lambda rows: seen.append(rows))
    langid.learn(spark.range(2000).selectExpr("id AS doc_id", "concat('text ', id) AS text", "concat('l', id % 10) AS lang"), mixing.F.lit(True))
    assert 10 < len(seen[0]) < 90


def test_counts_do_not_depend_on_blocks(monkeypatch):
    text = "some text é " * 50
    whole = langid.counts(text)
    monkeypatch.setattr(langid, "BLOCK", 37)
    assert (langid.counts(text) == whole).all()


# toxicity

def test_toxic_words_are_found(spark, scratch):
    r = random.Random(6)
    vocab = ["".join(r.choices("abcdefghij", k=r.randrange(3, 8))) for _ in range(500)]
    bad = ["zworthless", "xidiotic", "qpathetic"]
    rows, labels = [], []
    for i in range(900):
        w = r.choices(vocab, k=r.randrange(20, 200))
        toxic = int(i % 4 == 0)
        for _ in range(3 * toxic):
            w.insert(r.randrange(len(w)), r.choice(bad))
        rows.append((i, " ".join(w)))
        labels.append((i, toxic))
    rows += [(2000, None), (2001, ""), (2002, "word " * 100_000)]
    got = {x.doc_id: x for x in toxicity.classify(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame([*labels, labels[0], (5000, 1), (7, None)], "doc_id bigint, toxic int"), scratch).collect()}
    held = [(got[i], y) for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(x.held_out for x, _ in held)
    assert sum(x.predicted == y for x, y in held) >= 0.95 * len(held)
    assert all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5) for x in got.values())
    assert got[2001].predicted == got[2000].predicted == 0


def test_toxicity_of_copies(spark, scratch):
    """Equal texts with both labels count once, as toxic, so the model is the same however the table is partitioned."""
    r = random.Random(9)
    texts = [" ".join(r.choice(("vile", "filth", "scum") if i % 3 == 0 and r.random() < 0.4 else ("tree", "house", "river", "cloud")) for _ in range(60)) for i in range(300)]
    rows = [(i + 1000 * copy, t) for i, t in enumerate(texts) for copy in (0, 1)]
    labels = spark.createDataFrame([(i + 1000 * copy, int(i % 3 == 0 and copy == 1)) for i in range(300) for copy in (0, 1)], "doc_id bigint, toxic int")
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    one, seven = ({x.doc_id: x.score for x in toxicity.classify(docs.repartition(n), labels, scratch).collect()} for n in (1, 7))
    assert one == seven and max(one.values()) > 0.5 > min(one.values())


def test_toxicity_without_labels(docs, no_docs, spark, scratch, fixture_rows):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert {x.score for x in toxicity.classify(docs, none, scratch).collect()} == {0.0}
    assert toxicity.classify(no_docs, none, scratch).count() == 0


# URL filters

def rule(host, path):
    best = None
    for h, p, _ in urlfilter.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best)):
            best = h + p
    return best


URLS = [
    "http://Tionsh.EXAMPLE.net/de/1?x=/en/#a", "https://example.net/en/7", "http://xexample.net/en/", "http://a.example.com/de/q", "http://example.com/de", "https://b.org/fr/x", "http://org/fr/", "http://net", "http://net/",
    None, "no scheme", "http://", "a://b://c/d", "http://h?q/de/", "http://h#f/x", "http://best-casino-win.example.com/en/1", "http://spamfarm.example.com/x", "http://gardenbooks.example.com/en/2", "http://xn--é.org/FR/",
]


def test_urls(spark):
    rows = [(i, u) for i, u in enumerate(URLS * 2)]
    df = spark.createDataFrame(rows, "page_id bigint, url string")
    for x in urlfilter.judge(df).collect():
        u = URLS[x.page_id % len(URLS)] or ""
        rest = u.split("://", 1)[1] if "://" in u else ""
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host) :]).group()
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        assert (x.host, x.path, x.rule) == (host, path, rule(host, path)), u
        if x.rule:
            assert x.verdict == {h + p: v for h, p, v in urlfilter.RULES}[x.rule]
        elif not host:
            assert x.verdict == "allow"
    got = {x.url: x.verdict for x in urlfilter.judge(df).collect()}
    assert got[URLS[15]] == got[URLS[16]] == "block" and got[URLS[17]] == "allow"
    assert urlfilter.judge(df.limit(0)).count() == 0


def test_segmentation():
    import numpy as np

    counts = np.zeros(urlfilter.CELLS)
    for w, n in (("garden", 50), ("books", 40), ("book", 30), ("s", 1)):
        counts[urlfilter.cell(w)] = n
    assert urlfilter.Unigrams(counts, counts.sum()).segment("gardenbooks") == ["garden", "books"]


# multiset hashes

@pytest.mark.parametrize("parts", ["1", "4"])
def test_edits_against_brute_force(spark, docs, no_docs, fixture_rows, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        unique = list({r[0]: r for r in fixture_rows if r[0] is not None}.values())
        df = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
        order = sorted(unique, key=lambda r: -r[0])
        got = {r.doc_id: r for r in multisethash.compare_edits(df).collect()}
        assert len(got) == len(order)
        for i, row in enumerate(order):
            text, nxt = row[1] or "", order[(i + 1) % len(order)][1] or ""
            half = len(text) // 2
            edited = text[: len(text) - half] + nxt[:half]
            r = got[row[0]]
            own, changed = multisethash.fingerprint(text), multisethash.fingerprint(edited)
            assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
            assert (r.fingerprint, r.edited_fingerprint) == (own.hex(), changed.hex())
            assert r.near_edited == own.likeness(changed) and r.near_next == own.likeness(multisethash.fingerprint(nxt))
        assert multisethash.compare_edits(docs).count() == len(fixture_rows)
        assert multisethash.compare_edits(no_docs).count() == 0
        lone = multisethash.compare_edits(df.where("doc_id = 0")).collect()
        assert len(lone) == 1 and lone[0].near_next == 1.0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_sums_are_homomorphic():
    a, b = "One is here. Two are\nthere and more", "Three come by"
    both = multisethash.Fingerprint().add(b).add(a)
    assert both.hex() == multisethash.fingerprint(f"{a}\n\n  {b} ").hex() == multisethash.fingerprint(f"{b}\n{a}").hex()
    assert both.add(b, -1).hex() == multisethash.fingerprint(a).hex()
    assert multisethash.Fingerprint.parse(both.hex()).hex() == both.hex()
    assert multisethash.Fingerprint().likeness(both) == 0.0 and both.likeness(both) == 1.0
    # one paragraph more or less is told apart, whatever its passages are
    assert multisethash.fingerprint(f"{a} {b}").wide.tolist() != both.wide.tolist()


def test_lanes_hold_very_many_equal_passages():
    of = lambda n: multisethash.fingerprint("a " * n)
    assert of(40_000).likeness(of(20_000)) > 0.999 and of(65_536).likeness(of(65_535)) > 0.999
    assert multisethash.Fingerprint.parse(of(40_000).hex()).likeness(of(40_000)) == 1.0


def test_slots_follow_the_bytes(spark, monkeypatch):
    df = spark.range(0, 400).selectExpr("id * 7 % 401 AS doc_id", "concat('text ', id) AS text")
    whole = sorted(map(tuple, multisethash.compare_edits(df).collect()))
    monkeypatch.setattr(multisethash, "SLOT_BYTES", 100)
    assert multisethash.in_id_order(df, "doc_id", "text").select("slot").distinct().count() > 30
    assert sorted(map(tuple, multisethash.compare_edits(df).collect())) == whole
