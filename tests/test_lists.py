"""Rank edits on small lists."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ranklane.functions import lists as L


def one(spark, ids, expr):
    return spark.createDataFrame([(ids,)], "ids array<bigint>").select(expr(F.col("ids")).alias("x")).first().x


CASES = [
    ([10, 11, 12, 13], lambda i: L.overexpress(i, L.keys([12])), [12, 10, 11, 13]),
    ([10, 11, 12, 13], lambda i: L.overexpress(i, L.keys([99])), [99, 10, 11, 12]),
    ([10, 20, 30, 40], lambda i: L.delete(i, L.keys([20, 40])), [10, 30]),
    ([10, 20, 30, 40], lambda i: L.delete(i, L.keys([])), [10, 20, 30, 40]),
    ([1, 2, 3], lambda i: L.apply_steps(i, [("oe", [2]), ("overexpress", [3])]), [3, 2, 1]),
    ([5, 6, 7], lambda i: L.positions_of(i, L.keys([7, 9])), [2]),
    ([5, 6, 7], lambda i: L.positions_of(i, L.keys([9])), [-100]),
    ([5, 6, 7, 8], lambda i: L.remaining(i, F.array(F.lit(0), F.lit(2))), [6, 8]),
    ([9, 1, 2, 7, 3], lambda i: L.swap(i, L.keys([9]), L.keys([7]), 10), [7, 1, 2, 3]),
    ([1, 2, 3], lambda i: L.swap(i, L.keys([9]), L.keys([2])), [1, 2, 3]),
    ([1, 2, 3], lambda i: L.pad(i, 5), [1, 2, 3, 0, 0]),
    ([1, 2, 3], lambda i: L.attention(i, 5), [1, 1, 1, 0, 0]),
    ([1, 2, 3, 4], lambda i: L.keep_tail(i, L.keys([3, 1, 2])), [3, 1, 2, 4]),
    ([1, 2, 3, 4], lambda i: L.keep_tail(i, L.keys([3, 1, 9])), [3, 1, 9]),
    ([1, 2, 3], lambda i: L.to_front(i, F.lit(2)), [3, 1, 2]),
    ([4, 5, 6], lambda i: L.by_priority(i, F.array(F.lit(0.31), F.lit(0.30), F.lit(0.1)), 0.1), [6, 4, 5]),
    ([1, 2, 3, 4], lambda i: L.alignment_positions(F.array(F.lit(3)), F.size(i), F.lit(2)), [3, 2]),
    ([1, 2, 3, 4], lambda i: L.alignment_positions(F.array(F.lit(-100)), F.size(i), F.lit(2)), [3, 2]),
    ([], lambda i: L.overexpress(i, L.keys([1])), []),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_edit(spark, case):
    ids, expr, want = CASES[case]
    assert one(spark, ids, expr) == want


def test_unimplemented_edits_are_refused():
    for name in ("inhibit", "activate"):
        with pytest.raises(ValueError):
            L.step_name(name)


def test_final_overexpressed():
    assert L.final_overexpressed([("oe", [1, 2]), ("kd", [1]), ("oe", [3])]) == [2, 3]
