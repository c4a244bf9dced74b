from __future__ import annotations

import random

import pytest

from ranklane.llm.common import Scratch

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, fp string, starts int, row string, _text string"


def words(r: random.Random, n: int, pool: int = 400) -> list[str]:
    return [f"w{r.randrange(pool)}" for _ in range(n)]


@pytest.fixture(scope="session")
def scratch(spark):
    return Scratch(spark)


@pytest.fixture(scope="session")
def fixture_rows():
    """Copies, near copies, shared passages, nulls, empty, very long and repeated rows, ties; clashing column names."""
    r = random.Random(11)
    base = words(r, 260)
    passage = words(r, 70)
    texts = [" ".join(base), " ".join(base), " ".join([*base[:130], "CHANGED", *base[131:]]), "", None, "   \n\t ", "one", "one two", "One  TWO"]
    texts += [" ".join([*words(r, 30), *passage[: 50 + i], *words(r, 20)]) for i in range(12)]
    texts += [" ".join(words(r, 6000, 3000)), " ".join(["same"] * 900), " ".join(["same"] * 400), "x" * 40_000]
    texts += ["Mail jo.81@mail7.example.com or +1 (017) 555-7713, card 4111 1111 1111 1111 from 10.0.0.255.", "a@b.c%d@e.f 1.2.3.4.5 300.1.1.1 +12 3 4111111111111112", "Zoë ☃ jo at mail dot example dot com; 日本語 a@b.co"]
    rows = [(i, t, ("en", "de", None)[i % 3], ("b", "a", None, "c")[i % 4], None if t is None else len(t), "f", i, "r", "t") for i, t in enumerate(texts)]
    return [*rows, rows[0], rows[0], (None, "one two", None, None, None, None, None, None, None), (10_000, " ".join(passage), "en", "a", 1, "f", 1, "r", "t")]


@pytest.fixture(scope="session")
def docs(spark, fixture_rows):
    return spark.createDataFrame(fixture_rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
