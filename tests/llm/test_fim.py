from __future__ import annotations

import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from ranklane.llm import fim

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.DOTALL)
SENTINELS = ("<P>", "<S>", "<M>")


def brute(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    digest = hashlib.sha256(("1:" + ("" if doc_id is None else str(doc_id))).encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(s in text for s in SENTINELS) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    if h4 % 100 < 20:
        return doc_id, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


pieces = st.lists(st.sampled_from(["a", "PSM", "Z", "<", ">", "<P", "S>", "<M>", " ", "\n", "\0", "é", "日本", "😀", "9", "_", "@[`{"]), max_size=30).map("".join)


@settings(max_examples=400, deadline=None)
@given(pieces | st.text(max_size=40))
def test_units(text):
    units, found = UNIT.findall(text), fim.Units(text)
    assert (found.n, found.marked) == (len(units), any(s in text for s in SENTINELS))
    assert [found.place(k) for k in range(len(units) + 1)] == [len("".join(units[:k])) for k in range(len(units) + 1)]


def test_against_brute_force(spark, docs, fixture_rows):
    extra = [(50_000 + i, t, None, None, None, None, None, None, None) for i, t in enumerate(["<P>", "a<P", "x <S>y", "P><M", "<<<", "mit Umlaut äöü und <", "ab" * 30_000 + "é"] * 20)]
    table = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    want = sorted((brute(r[0], r[1]) for r in [*fixture_rows, *extra]), key=str)
    out = fim.transform(table)
    assert sorted((tuple(r) for r in out.collect()), key=str) == want
    assert out.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    texts = sorted((str(r[0]), sha(r[1] or "")) for r in [*fixture_rows, *extra])
    digest = fim.digest(out)
    assert sorted((str(r.doc_id), r.restored_sha256) for r in digest.collect()) == texts
    assert sorted((str(r.doc_id), r.output_sha256) for r in digest.collect()) == sorted((str(w[0]), sha(w[5])) for w in want)
    assert {w[2] for w in want} == {"plain", "psm", "spm"}


def test_parts_that_end_like_sentinels(spark):
    """What stands beside a sentinel cannot make another one with it."""
    rows = [(f"<P>{p}<S>{s}<M>{m}", "psm", p + m + s) for p in ("a<", "<P", ">", "") for s in ("<M", "M>", "") for m in ("<S", "S>", "")]
    rows += [(f"<S>{s}<P>{p}<M>{m}", "spm", p + m + s) for p in ("a<", "<M", "P>", "") for s in ("<P", ">", "") for m in ("<", "")]
    df = spark.createDataFrame(rows, "output string, form string, want string")
    assert df.where(~fim.restore(df["output"], df["form"]).eqNullSafe(df["want"])).collect() == []


def test_empty_table_and_other_ids(spark, no_docs):
    assert fim.digest(fim.transform(no_docs)).collect() == []
    named = spark.createDataFrame([("d-1", "some words here")], "name string, body string")
    assert [tuple(r) for r in fim.transform(named, id_col="name", text_col="body").collect()] == [brute("d-1", "some words here")]
