"""Queries of several parts read their lists and samples once, and write what the parts share."""

from __future__ import annotations

import pytest

from ranklane.operators import profiles, ranking
from ranklane.plans import contexts, encoding, inputs, resampling

SF = "/root/testdata/sf0.001"


def counted(spark, monkeypatch, module, name):
    """An accumulator of the rows that a module's source of rows gives."""
    rows, source = spark.sparkContext.accumulator(0), getattr(module, name)

    def seen(*args):
        df = source(*args)

        def run(batches):
            for b in batches:
                rows.add(b.num_rows)
                yield b

        return df.mapInArrow(run, df.schema)

    monkeypatch.setattr(module, name, seen)
    return rows, source(spark, SF).count()


@pytest.mark.parametrize("run", [contexts.closeness_values, contexts.closeness_summary, encoding.rank_table])
def test_lists_are_read_once(spark, monkeypatch, run):
    rows, n = counted(spark, monkeypatch, inputs, "encoded")
    run(spark, SF).collect()
    assert rows.value == n


@pytest.mark.parametrize("run", [resampling.method_scores, resampling.base_rank_control])
def test_samples_are_read_once(spark, monkeypatch, run):
    rows, n = counted(spark, monkeypatch, resampling, "samples")
    run(spark, SF).collect()
    assert rows.value == n


def test_state_ranks(spark):
    """As from position sums and distinct cells, a cell being in one group."""
    e = spark.createDataFrame([("u", 1, 0, 7, 2), ("u", 1, 1, 8, 2), ("u", 2, 0, 8, 1), ("v", 3, 0, 7, 1)], "s string, cell int, pos int, token int, len int")
    want = profiles.pseudobulk(profiles.position_sums(e, "s"), profiles.cells_per(e, "s"), "s")
    assert sorted(profiles.state_ranks(e, "s").collect()) == sorted(want.collect()) and profiles.state_ranks(e).count() == 2


def test_calibration_bins(spark):
    """Values and ties that lie across bins' ends, and nulls, as in one sorted list."""
    rows = [(None if i % 50 == 7 else float(i * 7 % 3), i * 13 % 5, i, None if i % 40 == 3 else float(i * 11 % 17)) for i in range(331)]
    got = {r.bin: r for r in ranking.calibration_bins(spark.createDataFrame(rows, "p double, a int, b int, o double"), "p", "o", 10, "a", "b").collect()}
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0.0, r[1], r[2]))
    mean = lambda x: sum(x) / len(x) if x else None
    for b in range(10):
        own = [r for i, r in enumerate(rows) if ((i + 1) * 10 - 1) // len(rows) == b]
        assert got[b].n == len(own) and got[b].pred_mean == pytest.approx(mean([r[0] for r in own if r[0] is not None])) and got[b].obs_mean == pytest.approx(mean([r[3] for r in own if r[3] is not None]))


def test_match_reads_lists_once(spark, monkeypatch):
    rows, n = counted(spark, monkeypatch, inputs, "encoded")
    encoding.stratum_band_match(spark, SF)
    assert rows.value == n
