from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from ranklane.llm import prefixtrie

COLUMNS = "conv_id bigint, turn bigint, role string, text string, key string, base int, seq string"


def brute(rows):
    """The nodes by walking every beginning of every rebuilt conversation; turn numbers must differ within one."""
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(own.get(c - int(c % 5 if c >= 0 else -(-c % 5)), [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    figures = {}
    for node in sorted(members, key=len, reverse=True):
        below = [figures[x] for x in children[node]]
        saved = (len(members[node]) - 1) * (len(node[-1][1].encode()) if node else 0) + sum(s for _, s in below)
        figures[node] = (sum(n for n, _ in below) or 1, saved)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return [
        (min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(children[n]), *figures[n], sha(",".join(str(c) for c in sorted(m) if len(built[c]) == len(n)))) for n, m in members.items()
    ]


def nodes(df):
    return [(r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect()]


def conversations():
    """Common first turns, copies, long shared chains, nulls, empty texts, negative and lone ids."""
    r = random.Random(5)
    rows, said = [], [("user", "hello"), ("assistant", "yes ☃"), (None, "go on"), ("user", None), ("user", "")]
    for c in range(120):
        for t in range(r.randrange(1, 7)):
            rows.append((c, t, *(said[0] if t == 0 and c % 3 else r.choice(said))))
    for c in range(300, 360):  # copies and long common beginnings
        rows += [(c, t, "user", f"chain {t}") for t in range(40 if c % 2 else 43)]
        rows.append((c, None, "system", "first"))
    rows += [(c, 100, "user", f"own {c % 4}") for c in range(300, 360) if c % 3 == 0]
    rows += [(-3, 0, "user", "below"), (-5, 0, "user", "zero"), (-5, 1, "a", "x" * 50_000), (1_000_003, 0, "user", "alone"), (10**15, 7, None, None)]
    rows += [(c, 0, "user", "only one turn") for c in range(2000, 2400, 7)]
    r.shuffle(rows)
    return [(*x, "k", 1, "s") for x in rows] + [(None, 1, "user", "nobody's", "k", 1, "s")]


@pytest.mark.parametrize(("largest", "sent"), [(4096, 2000), (40, 2000), (8, 0)])
def test_against_brute_force(spark, scratch, monkeypatch, largest, sent):
    """Whole tries, split ones, and splits that are joined instead of sent."""
    monkeypatch.setattr(prefixtrie, "SENT", sent)
    rows = conversations()
    df = spark.createDataFrame(rows, COLUMNS).repartition(5)
    out = prefixtrie.prefix_trie(prefixtrie.rebuilt(df), scratch, largest)
    assert sorted(nodes(out), key=str) == sorted(brute(rows), key=str)


def test_empty_and_turnless(spark, scratch):
    empty = spark.createDataFrame([], COLUMNS)
    out = prefixtrie.prefix_trie(prefixtrie.rebuilt(empty), scratch)
    assert out.collect() == [] and out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    # conversations without a base whose own turns all fall away: members of the root only
    ids = [c for c in range(1, 200) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 1]
    rows = [(c, 0, "user", "x", "k", 1, "s") for c in ids]
    out = prefixtrie.prefix_trie(prefixtrie.rebuilt(spark.createDataFrame(rows, COLUMNS)), scratch)
    assert nodes(out) == [(ids[0], 0, None, len(ids), 0, 1, 0, hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())]


def test_repeated_turns_and_partitions(spark, scratch):
    """Rows of one turn number stand in an order of their own, whatever the partitions; a repeated row is a turn of its own."""
    rows = [(5, 1, "user", t, "k", 1, "s") for t in ("b", "a", "c", "a")] * 3
    once, again = (nodes(prefixtrie.prefix_trie(prefixtrie.turn_lists(spark.createDataFrame(x, COLUMNS).repartition(n)).select("conv_id", "turns"), scratch)) for x, n in ((rows, 1), (rows[::-1], 6)))
    assert sorted(once, key=str) == sorted(again, key=str) and max(r[1] for r in once) == 12


def test_ends_of_many_ids(spark, scratch, monkeypatch):
    monkeypatch.setattr(prefixtrie, "ID_BITS", 4)
    ids = [*range(-500, 700, 3), 10**12]
    rows = spark.createDataFrame([(c, b"q" if c % 2 else b"r") for c in ids], "conv_id bigint, seq binary").repartition(7)
    found = {bytes(r.seq): r.ends_sha256 for r in prefixtrie.ends(rows).collect()}
    for seq, odd in ((b"q", 1), (b"r", 0)):
        assert found[seq] == hashlib.sha256(",".join(str(c) for c in ids if c % 2 == odd).encode()).hexdigest()
