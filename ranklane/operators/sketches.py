"""Mergeable summaries: quantile digests of vectors' coordinates, and the k rows of smallest hash of each group.

Both are built partially in each task, from batches, and merged in a tree, so neither sorts nor gathers the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Values that wait in a task before they are folded into its digests, and digests' centroids that a task holds before it hands them on.
PENDING, HELD = 1 << 18, 4_000_000
#: Groups of partial results between the tasks and the final one.
SLOTS = 32

_DIGEST = "i int, n bigint, low double, high double, total double, means array<double>, weights array<double>"


def compress(means: np.ndarray, weights: np.ndarray, compression: int) -> tuple[np.ndarray, np.ndarray]:
    """At most compression + 1 centroids, narrow towards both ends (a t-digest with the arcsine scale).

    Values in order fall into cells of equal width on the scale of asin(2q - 1), q being the share of weight before
    a value's middle. At the median a cell holds about pi / (2 compression) of the weight, at the ends single values.
    """
    order = np.argsort(means, kind="stable")
    means, weights = means[order], weights[order]
    q = (np.cumsum(weights) - weights / 2) / weights.sum()
    cell = np.floor(compression * (np.arcsin(2 * q - 1) / np.pi + 0.5))
    first = np.flatnonzero(np.concatenate(([True], np.diff(cell) > 0)))
    total = np.add.reduceat(weights, first)
    return np.add.reduceat(means * weights, first) / total, total


def value_at(means: np.ndarray, weights: np.ndarray, low: float, high: float, q: float) -> float:
    """The q-quantile, interpolated between the centroids' middles and the smallest and largest value."""
    middle = np.cumsum(weights) - np.asarray(weights) / 2
    return float(np.interp(q * np.sum(weights), np.concatenate(([0.0], middle, [np.sum(weights)])), np.concatenate(([low], means, [high]))))


def trimmed_mean_of(means: np.ndarray, weights: np.ndarray, low: float, high: float) -> float:
    """The mean of the weight between two quantiles; a centroid counts with its share of it."""
    end = np.cumsum(weights)
    share = np.maximum(0.0, np.minimum(end, high * end[-1]) - np.maximum(end - weights, low * end[-1]))
    return float((share * means).sum() / share.sum()) if share.sum() else float("nan")


class _Held:
    """One group's digests in a task: a list entry for each coordinate."""

    def __init__(self) -> None:
        self.at: list[np.ndarray] = []
        self.values: list[np.ndarray] = []
        self.waiting = 0
        self.done: dict[int, list] = {}  # coordinate -> n, low, high, total, means, weights

    def add(self, at: np.ndarray, values: np.ndarray, compression: int) -> None:
        fine = np.isfinite(values)
        self.at.append(at[fine])
        self.values.append(values[fine])
        self.waiting += len(self.at[-1])
        if self.waiting >= PENDING:
            self.fold(compression)

    def fold(self, compression: int) -> None:
        if not self.waiting:
            return
        at, values = np.concatenate(self.at), np.concatenate(self.values)
        order = np.argsort(at, kind="stable")
        at, values = at[order], values[order]
        starts = np.flatnonzero(np.concatenate(([True], np.diff(at) > 0)))
        for i, part in zip(at[starts], np.split(values, starts[1:]), strict=True):
            have = self.done.setdefault(int(i), [0, np.inf, -np.inf, 0.0, np.zeros(0), np.zeros(0)])
            have[0] += len(part)
            have[1], have[2], have[3] = min(have[1], part.min()), max(have[2], part.max()), have[3] + part.sum()
            have[4], have[5] = compress(np.concatenate((have[4], part)), np.concatenate((have[5], np.ones(len(part)))), compression)
        self.at, self.values, self.waiting = [], [], 0


def digests(rows: DataFrame, vector: str, by: str | None = None, compression: int = 200) -> DataFrame:
    """(by, i, n, low, high, total, means, weights): a digest of each coordinate's values, for each group or for all rows.

    vector is an array of numbers; arrays may differ in length, and null, NaN and infinite components (and null
    arrays) count nowhere. The rank of a quantile is off by less than 2 / compression of the values. A task holds
    HELD centroids at most and hands on what it has when there are more; no row is shuffled, only digests are.
    """
    group = F.col(by) if by else F.lit(0)
    x = rows.where(F.col(vector).isNotNull()).select(group.alias("_by"), F.col(vector).cast("array<double>").alias("_v"))
    schema = T.StructType([x.schema["_by"], T.StructField("_slot", T.IntegerType()), *T.StructType.fromDDL(_DIGEST).fields])
    names = schema.names[2:]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[object, _Held] = {}
        slot = TaskContext.get().partitionId() % SLOTS
        kind = None

        def out() -> pa.RecordBatch:
            found = []
            for g, h in held.items():
                h.fold(compression)
                found += [(g, i, *d) for i, d in h.done.items()]
            held.clear()
            arrays = [pa.array([r[0] for r in found], kind), pa.array([slot] * len(found), pa.int32()), pa.array([r[1] for r in found], pa.int32()), pa.array([r[2] for r in found], pa.int64())]
            arrays += [pa.array([r[c] for r in found], pa.float64()) for c in (3, 4, 5)] + [pa.array([r[c] for r in found], pa.list_(pa.float64())) for c in (6, 7)]
            return pa.RecordBatch.from_arrays(arrays, names=schema.names)

        for batch in batches:
            kind = batch.schema.field(0).type
            codes = batch.column(0).dictionary_encode(null_encoding="encode")
            code, lists = codes.indices.to_numpy(), batch.column(1)
            lengths = np.diff(lists.offsets.to_numpy())
            first = lists.offsets.to_numpy()[:-1]
            row = np.repeat(np.arange(len(lengths)), lengths)
            flat = np.arange(lengths.sum()) + np.repeat(first - np.concatenate(([0], lengths.cumsum()[:-1])), lengths)
            values = lists.values.to_numpy(zero_copy_only=False)[flat].astype(np.float64)
            at = flat - np.repeat(first, lengths)
            for c, g in enumerate(codes.dictionary.to_pylist()):
                mine = code[row] == c
                held.setdefault(g, _Held()).add(at[mine], values[mine], compression)
            if sum(len(h.done) for h in held.values()) * compression > HELD:
                yield out()
        if held:
            yield out()

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        flat = lambda c: table[c].combine_chunks().flatten().to_numpy()
        means, weights = compress(flat("means"), flat("weights"), compression)
        total = {"n": sum(table["n"].to_pylist()), "low": min(table["low"].to_pylist()), "high": max(table["high"].to_pylist()), "total": sum(table["total"].to_pylist()), "means": means, "weights": weights}
        own = {c: table[c].slice(0, 1) for c in table.column_names if c not in total}
        return pa.table({c: own[c] if c in own else pa.array([total[c]], table.schema.field(c).type) for c in table.column_names})

    parts = x.mapInArrow(partial, schema)
    inner = parts.groupBy("_by", "_slot", "i").applyInArrow(merge, schema)
    final = inner.groupBy("_by", "i").applyInArrow(merge, schema)
    return final.select(*([F.col("_by").alias(by)] if by else []), *names)


@F.pandas_udf(T.DoubleType())
def quantile(means: pd.Series, weights: pd.Series, low: pd.Series, high: pd.Series, q: pd.Series) -> pd.Series:
    """value_at() of digest rows."""
    return pd.Series([value_at(*x) for x in zip(means, weights, low, high, q, strict=True)], dtype=float)


@F.pandas_udf(T.DoubleType())
def trimmed_mean(means: pd.Series, weights: pd.Series, low: pd.Series, high: pd.Series) -> pd.Series:
    """trimmed_mean_of() of digest rows between two quantiles."""
    return pd.Series([trimmed_mean_of(*x) for x in zip(means, weights, low, high, strict=True)], dtype=float)


def summarise_vectors(rows: DataFrame, vector: str, stat: str, by: str | None = None, compression: int = 200) -> DataFrame:
    """(by, vec): the mean or median vector of each group (or of all rows) from digests; coordinates without a value are null."""
    if stat not in ("mean", "median"):
        raise ValueError("a summary is 'mean' or 'median'")
    d = digests(rows, vector, by, compression)
    value = trimmed_mean("means", "weights", F.lit(0.0), F.lit(1.0)) if stat == "mean" else quantile("means", "weights", "low", "high", F.lit(0.5))
    told = d.select(*([by] if by else []), "i", value.alias("x"))
    dims = told.groupBy(*([by] if by else [])).agg(F.map_from_entries(F.collect_list(F.struct("i", "x"))).alias("m"), F.max("i").alias("last"))
    return dims.select(*([by] if by else []), F.transform(F.sequence(F.lit(0), F.col("last")), lambda i: F.try_element_at("m", i)).alias("vec"))


def bottom_k(rows: DataFrame, by: str, key: str, k: int, seed: int = 0) -> DataFrame:
    """(by, key): the k rows of each group (all, if fewer) of smallest md5 of seed and key, equal ones by key; keys are unique in a group.

    A task keeps k rows for each group that it meets, however many it reads, and so does each merge; rows are told apart
    by their hash alone, so the sample does not depend on partitions or order. Null groups and keys take no part.
    """
    drawn = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))
    x = rows.where(F.col(by).isNotNull() & F.col(key).isNotNull()).select(F.col(by), F.col(key), drawn.alias("_h"))
    schema = T.StructType([*x.schema.fields, T.StructField("_slot", T.IntegerType())])

    def lowest(frame: pd.DataFrame) -> pd.DataFrame:
        return frame.sort_values([by, "_h", key], kind="stable").groupby(by, sort=False).head(k)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            held = lowest(batch if held is None else pd.concat((held, batch)))
        if held is not None:
            yield held.assign(_slot=TaskContext.get().partitionId() % SLOTS)

    merged = x.mapInPandas(partial, schema).groupBy(by, "_slot").applyInPandas(lowest, schema)
    return merged.groupBy(by).applyInPandas(lowest, schema).select(by, key)
