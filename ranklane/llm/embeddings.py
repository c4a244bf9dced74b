"""Embedding near-duplicates by PCA-ordered tiled comparison.

Unit vectors are turned so that their leading coordinates hold the most variance, and cut into tiles. Two
tiles are compared block by block: the leading coordinates' products are summed first, the norms of what is
left of both vectors bound the rest of the sum, and a pair goes no further once that bound is under the
threshold. What is left is decided by the whole sum in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ranklane.llm.common import Scratch, components

#: Vectors in a tile: at least, at most (about); between them a vector goes to PAIRS tiles.
TILE, LARGEST, PAIRS = 4096, 32768, 64
#: Rows of a tile that are compared at once, and leading coordinates after which bounds are looked at.
ROWS, STEPS = 256, (16, 32)
#: How far rounding may move a bound of single precision.
SLACK = 1e-4


def _fine(v: Column) -> Column:
    """Whether a vector can link: null and empty vectors, those with null or non-finite components and those of norm zero cannot."""
    limit = F.lit(float("inf"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < limit)) & F.exists(v, lambda x: x != 0)
    return v.isNotNull() & F.coalesce(fine, F.lit(False))


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(v, n, first, node): the distinct vectors that can link, how many rows have each, their smallest id (null only
    if all are), and a number that names the vector once the table is written."""
    v = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").alias("v"))
    return v.where(_fine(F.col("v"))).groupBy("v").agg(F.min("id").alias("first"), F.count("*").alias("n")).withColumn("node", F.monotonically_increasing_id())


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, safely for very large and very small components."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def principal_axes(distinct: DataFrame, dims: int) -> np.ndarray:
    """Columns by falling variance; the second moments, dims x dims numbers from each task, are summed on executors."""

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((dims, dims))
        for batch in batches:
            rows = [x for x in batch["v"] if len(x) == dims]
            if rows:
                u = unit(np.stack(rows).astype(np.float64))
                total += u.T @ u
        yield pd.DataFrame({"at": np.arange(dims * dims), "x": total.ravel()})

    flat = np.zeros(dims * dims)
    for r in distinct.select("v").mapInPandas(moments, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).collect():
        flat[r["at"]] = r["x"]
    _, axes = np.linalg.eigh(flat.reshape(dims, dims))
    return axes[:, ::-1]


def _close(a: np.ndarray, b: np.ndarray, heads: list[tuple[np.ndarray, np.ndarray]], threshold: float, own: bool, offset: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of the pairs of at least the threshold; own: b is the tile that a is a part of, from offset on."""
    first_a, first_b = heads[0]
    left, right = np.nonzero(first_a @ first_b.T >= threshold - SLACK)
    if own:
        upper = right > left + offset
        left, right = left[upper], right[upper]
    for head_a, head_b in heads[1:]:
        if not len(left):
            return left, right
        if len(left) * 8 > a.shape[0] * b.shape[0]:
            break  # a dense block is decided faster as a whole
        alive = np.concatenate([np.einsum("ij,ij->i", head_a[left[s : s + 65536]], head_b[right[s : s + 65536]]) for s in range(0, len(left), 65536)]) >= threshold - SLACK
        left, right = left[alive], right[alive]
    if len(left) * 8 > a.shape[0] * b.shape[0]:
        sure = (a @ b.T)[left, right] >= threshold
    else:
        sure = np.concatenate([np.einsum("ij,ij->i", a[left[s : s + 65536]], b[right[s : s + 65536]]) for s in range(0, len(left), 65536)] or [np.zeros(0)]) >= threshold
    return left[sure], right[sure]


def _headed(x: np.ndarray, steps: tuple[int, ...]) -> list[np.ndarray]:
    """For each step the leading coordinates and, last, the norm of the others: products of such rows are bounds."""
    return [np.column_stack([x[:, :k], np.sqrt(np.maximum(0.0, (x[:, k:] ** 2).sum(axis=1)))]).astype(np.float32) for k in steps if k < x.shape[1]]


def compare_tiles(a: np.ndarray, b: np.ndarray, own: bool, threshold: float, ids_a: np.ndarray, ids_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, links, root) of every row of both tiles that has a link between them.

    links counts the other side's rows with their copies; root is the smallest id that links within these
    two tiles reach. So a tile pair returns two rows a vector at most, however many pairs are close.
    """
    steps = tuple(k for k in STEPS if k < a.shape[1]) or (max(1, a.shape[1] - 1),)
    heads_a, heads_b = _headed(a, steps), _headed(b, steps)
    if not heads_a:  # one coordinate
        heads_a, heads_b = [a.astype(np.float32)], [b.astype(np.float32)]
    count_a, count_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    root_a, root_b = ids_a.copy(), (ids_b.copy() if not own else None)
    label_b = root_a if own else root_b
    kept: list[tuple[np.ndarray, np.ndarray]] = []
    for s in range(0, len(a), ROWS):
        left, right = _close(a[s : s + ROWS], b, [(h[s : s + ROWS], g) for h, g in zip(heads_a, heads_b, strict=True)], threshold, own, s)
        if not len(left):
            continue
        left = left + s
        np.add.at(count_a, left, n_b[right])
        np.add.at(count_a if own else count_b, right, n_a[left])
        # a dense block's links would fill memory; a spanning forest carries labels as well
        kept.append(_forest(left, right) if len(left) > 4 * (len(a) + len(b)) else (left, right))
    if kept:
        left, right = np.concatenate([k[0] for k in kept]), np.concatenate([k[1] for k in kept])
        while True:
            low = np.minimum(root_a[left], label_b[right])
            before = (root_a.copy(), label_b.copy())
            np.minimum.at(root_a, left, low)
            np.minimum.at(label_b, right, low)
            if (before[0] == root_a).all() and (before[1] == label_b).all():
                break
    if own:
        linked = count_a > 0
        return ids_a[linked], count_a[linked], root_a[linked]
    la, lb = count_a > 0, count_b > 0
    return np.concatenate([ids_a[la], ids_b[lb]]), np.concatenate([count_a[la], count_b[lb]]), np.concatenate([root_a[la], root_b[lb]])


def _forest(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Few pairs that connect what all these links connect: each row with its first column, and each column with its
    component's first row. Components come from label propagation, with no step of Python for a link."""
    rows, first, at = np.unique(left, return_index=True, return_inverse=True)
    columns, to = np.unique(right, return_inverse=True)
    label = np.arange(len(rows))
    while True:
        low = np.full(len(columns), len(rows))
        np.minimum.at(low, to, label[at])
        fresh = label.copy()
        np.minimum.at(fresh, at, low[to])
        if (fresh == label).all():
            return np.concatenate((left[first], rows[low])), np.concatenate((right[first], columns))
        label = fresh


def link(vectors: DataFrame, scratch: Scratch, *, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95) -> DataFrame:
    """(id, n_links, component_id, kept) for every row, links being pairs of cosine >= threshold.

    Equal vectors are compared once and count with their copies. Vectors of different lengths do not link;
    each length has its own axes and tiles. Vectors that cannot link have no links and are their own
    component. Rows are vectors of their own whatever their ids: rows of a repeated id each count in n_links, and so
    do those of a null id, whose component_id is the smallest id that they reach, or null. An empty table gives an
    empty one.
    """
    distinct = scratch.keep(usable(vectors, id_col, vector_col))
    found = None
    for dims, many in sorted((r["d"], r["n"]) for r in distinct.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect()):
        same = distinct.where(F.size("v") == dims)
        some = scratch.keep(_compare(same, dims, many, principal_axes(same, dims), threshold))
        found = some if found is None else found.unionByName(some)
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").alias("v"))
    out = rows.where(~_fine(F.col("v"))).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    if found is not None:
        counts = found.groupBy("node").agg(F.sum("links").alias("links"))
        roots = components(found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).distinct(), scratch)
        classes = scratch.keep(
            distinct.join(counts, "node", "left").join(roots, "node", "left")
            .select("v", "first", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "node").alias("root"))
        )
        smallest = classes.groupBy("root").agg(F.min("first").alias("component_id"))
        linked = rows.where(_fine(F.col("v"))).join(classes.join(smallest, "root").select("v", "n_links", "component_id"), "v")
        out = out.unionByName(linked.select("id", "n_links", "component_id"))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def _compare(distinct: DataFrame, dims: int, many: int, axes: np.ndarray, threshold: float) -> DataFrame:
    """(node, links, root) from every pair of tiles: a vector goes to each pair that its tile takes part in."""
    tiles = max(1, -(-many // min(LARGEST, max(TILE, many // PAIRS))))
    n_pairs = tiles * (tiles + 1) // 2
    tile = F.pmod(F.xxhash64("node"), F.lit(tiles)).cast("int")
    # pair (i, j), i <= j, has the number j (j + 1) / 2 + i
    others = F.transform(F.sequence(F.lit(0), F.lit(tiles - 1)), lambda o: F.struct((F.greatest(o, F.col("tile")) * (F.greatest(o, F.col("tile")) + 1) / 2).cast("long").alias("base"), F.least(o, F.col("tile")).cast("long").alias("low")))
    turned = distinct.select("node", "n", "v", tile.alias("tile"))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        pair = key[0].as_py()
        j = int((np.sqrt(8 * pair + 1) - 1) // 2)
        while j * (j + 1) // 2 > pair:
            j -= 1
        while (j + 1) * (j + 2) // 2 <= pair:
            j += 1
        i = pair - j * (j + 1) // 2
        which, ids, n = table["tile"].to_numpy(), table["node"].to_numpy(), table["n"].to_numpy()
        x = table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), dims).astype(np.float64)
        x = unit(x) @ axes
        a = which == i
        if i == j:
            out = compare_tiles(x, x, True, threshold, ids, ids, n, n)
        else:
            out = compare_tiles(x[a], x[~a], False, threshold, ids[a], ids[~a], n[a], n[~a]) if a.any() and not a.all() else (ids[:0], n[:0], ids[:0])
        return pa.table({"node": pa.array(out[0], pa.int64()), "links": pa.array(out[1], pa.int64()), "root": pa.array(out[2], pa.int64())})

    spread = turned.select("node", "n", "v", "tile", F.explode(others).alias("p")).select("node", "n", "v", "tile", (F.col("p.base") + F.col("p.low")).alias("pair"))
    slots = max(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(n_pairs, 2000))
    return spread.repartition(slots, "pair").groupBy("pair").applyInArrow(run, "node bigint, links bigint, root bigint")
