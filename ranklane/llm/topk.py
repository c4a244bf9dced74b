"""Exact top-k search by integer inner product over a bit-sliced index.

Components are quantised to floor(256 x). A block of the index holds, for each component, one bitmap over the
block's rows for each binary digit (two's complement). A query's scores are themselves kept as slices: for each
component the slices of its multiple by the query's component are added with bitmap arithmetic, for many
queries and all rows of the block at once. The highest rows are then selected from the most significant slice
downward; rows that are still equal after the last slice have the same score, and the smallest ids among them fill
what is left. Nothing is approximate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ranklane.llm.common import Scratch

#: Rows of a block: at least, at most (about); between them the index has BLOCKS blocks. Queries that meet a block at once, at most.
BLOCK, LARGEST, BLOCKS, CHUNK = 2048, 65536, 64, 32768
#: 64-bit words of a bitmap over (query, row) that are added at once: a few such bitmaps stay in a core's cache.
WORDS = 4096
#: Binary digits of a query's component that are multiplied at once.
DIGITS = 4
ONES = np.uint64(0xFFFF_FFFF_FFFF_FFFF)


def quantised(v: Column, scale: int = 256) -> Column:
    """floor(scale x) of every component; null for vectors that are null or empty or hold a null or non-finite component.

    What is beyond the number of bits at which every score fits a long counts as that bound: about 2**20 in x for
    up to 64 components.
    """
    x = v.cast("array<double>")
    bits = F.floor((F.lit(62) - F.ceil(F.log2(F.greatest(F.size(x), F.lit(1)).cast("double")))) / 2)
    most = F.pow(F.lit(2.0), bits) - 1
    fine = (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.when(fine, F.transform(x, lambda c: F.floor(F.greatest(-most, F.least(most, F.floor(c * scale)))).cast("long")))


def slices_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bitmaps, depth) of rows x components: depth[i] bitmaps for component i, least significant first, the last being the sign."""
    rows, dims = values.shape
    words = -(-rows // 64)
    low, high = values.min(axis=0), values.max(axis=0)
    depth = np.array([max(int(h).bit_length(), int(-lo - 1).bit_length() if lo < 0 else 0) + 1 for lo, h in zip(low, high, strict=True)], np.int32)
    out = np.zeros((int(depth.sum()), words * 8), np.uint8)
    at = 0
    for i in range(dims):
        for b in range(depth[i]):
            packed = np.packbits((values[:, i] >> b & 1).astype(np.uint8), bitorder="little")
            out[at, : len(packed)] = packed
            at += 1
    return out.view(np.uint64), depth


def _add(total: np.ndarray, other: list[np.ndarray], shift: int, levels: int, flip: np.ndarray | None) -> None:
    """total[0:levels] += other << shift, slice by slice; other's last slice is its sign and goes on to the end.

    flip: all ones where other is to be subtracted instead (its complement is added, and one more).
    """
    # the complement of what lies under the shift is ones, through which the one more runs up to the shift
    carry = None if flip is None else np.broadcast_to(flip, total.shape[1:])
    for level in range(shift, levels):
        x = other[min(level - shift, len(other) - 1)]
        if flip is not None:
            x = x ^ flip
        t = total[level]
        more = t & x
        t ^= x
        if carry is not None:
            more |= t & carry
            t ^= carry
        carry = more


def _multiples(slices: np.ndarray, bits: int) -> list[np.ndarray]:
    """Slices of 0, 1, ... 2**bits - 1 times a component: a list of (multiple, word) bitmaps, the last one the sign."""
    depth, words = slices.shape
    levels = depth + bits
    table = np.zeros((levels, 1 << bits, words), np.uint64)
    own = list(slices)
    for b in range(bits):
        # multiples from 2**b on are those below it plus the component, 2**b times
        table[:, 1 << b : 2 << b] = table[:, : 1 << b]
        _add(table[:, 1 << b : 2 << b], [np.broadcast_to(s, (1 << b, words)) for s in own], b, levels, None)
    return list(table)


def add_scores(components: list[np.ndarray], depth: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """(level, query, word) slices of every query's score with every row, two's complement.

    components: each one's slices over the block's rows.
    """
    size, flip = np.abs(queries), np.where(queries < 0, ONES, np.uint64(0))[:, :, None]
    most = (size.max(axis=0).astype(object) * np.array([1 << int(d - 1) for d in depth], object)).cumsum()
    total = np.zeros((int(most[-1]).bit_length() + 1, len(queries), components[0].shape[1]), np.uint64)
    have = 1
    for i, slices in enumerate(components):
        need = int(most[i]).bit_length() + 1
        total[have:need] = total[have - 1]  # the sum so far, its sign in the new levels
        have = max(have, need)
        bits = int(size[:, i].max()).bit_length()
        if not bits:
            continue
        multiples = _multiples(slices, min(bits, DIGITS))
        for shift in range(0, bits, DIGITS):
            digit = size[:, i] >> shift & ((1 << DIGITS) - 1)
            _add(total, [m[digit] for m in multiples], shift, have, flip[:, i] if flip[:, i].any() else None)
    return total


def select(total: np.ndarray, valid: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(surely, equal): (query, word) bitmaps of the rows above the k-th score, and of those that have it.

    From the most significant slice downward: rows with the bit set go first where more than k of them are left,
    else they are all in and the search goes on among the others.
    """
    surely, equal = np.zeros_like(valid), valid.copy()
    for level in range(total.shape[0] - 1, -1, -1):
        bit = ~total[level] if level == total.shape[0] - 1 else total[level]
        first = equal & bit
        many = np.bitwise_count(surely | first).sum(axis=1, dtype=np.int64) > k
        surely |= np.where(many[:, None], np.uint64(0), first)
        equal &= bit ^ np.where(many, np.uint64(0), ONES)[:, None]
    return surely, equal


def _set_bits(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def search_block(bitmaps: np.ndarray, depth: np.ndarray, rows: int, queries: np.ndarray, own: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, places, scores) of each query's k highest rows of a block, equal scores in order of place.

    own: each query's own place in the block, which is left out, or -1.
    """
    words = bitmaps.shape[1]
    ends = np.concatenate(([0], depth.cumsum()))
    everything = np.zeros(words * 8, np.uint8)
    everything[: -(-rows // 8)] = np.packbits(np.ones(rows, np.uint8), bitorder="little")
    step = max(16, WORDS // words)
    for start in range(0, len(queries), step):
        q, mine = queries[start : start + step], own[start : start + step]
        total = add_scores([bitmaps[ends[i] : ends[i + 1]] for i in range(len(depth))], depth, q)
        valid = np.broadcast_to(everything.view(np.uint64), (len(q), words)).copy()
        here = np.flatnonzero(mine >= 0)
        valid[here, mine[here] >> 6] &= ~(np.uint64(1) << (mine[here] & 63).astype(np.uint64))
        surely, equal = select(total, valid, k)
        weight = np.array([1 << b for b in range(len(total))], np.int64)
        weight[-1] = -weight[-1]
        for j in range(len(q)):
            chosen = _set_bits(surely[j])
            chosen = np.concatenate((chosen, _set_bits(equal[j])[: k - len(chosen)]))
            bits = total[:, j, chosen >> 6] >> (chosen & 63).astype(np.uint64) & np.uint64(1)
            yield start + j, chosen, (bits.astype(np.int64) * weight[:, None]).sum(axis=0)


def _build(key: tuple, table: pa.Table) -> pa.Table:
    null = table["id"].combine_chunks().is_null().to_numpy(zero_copy_only=False)
    ids, rows = table["id"].combine_chunks().fill_null(0).to_numpy(), table["row"].to_numpy()
    order = np.lexsort((rows, ids, null))
    values = table["q"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1).astype(np.int64)[order]
    bitmaps, depth = slices_of(values)
    return pa.table({
        "dims": pa.array([values.shape[1]], pa.int32()), "block": pa.array([key[1].as_py()], pa.int32()), "ids": pa.array([pa.array(ids[order], mask=null[order])], pa.list_(pa.int64())),
        "rows": pa.array([rows[order]], pa.list_(pa.int64())), "depth": pa.array([depth], pa.list_(pa.int32())), "bitmaps": pa.array([bitmaps.tobytes()], pa.binary()),
    })


def _searcher(k: int):
    def run(key: tuple, index: pa.Table, queries: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query": [], "query_id": [], "row": [], "id": [], "score": []}
        for block in index.to_pylist() if queries.num_rows else ():
            rows = np.array(block["rows"], np.int64)
            depth = np.array(block["depth"], np.int64)
            bitmaps = np.frombuffer(block["bitmaps"], np.uint64).reshape(int(depth.sum()), -1)
            by_row = np.argsort(rows)
            named = queries["query"].to_numpy()
            at = np.minimum(np.searchsorted(rows, named, sorter=by_row), len(rows) - 1)
            own = np.where(rows[by_row[at]] == named, by_row[at], -1)
            q = queries["q"].combine_chunks().flatten().to_numpy().reshape(len(named), -1).astype(np.int64)
            ids = queries["query_id"].to_pylist()
            for j, places, scores in search_block(bitmaps, depth, len(rows), q, own, k):
                out["query"] += [named[j]] * len(places)
                out["query_id"] += [ids[j]] * len(places)
                out["row"] += rows[places].tolist()
                out["id"] += [block["ids"][p] for p in places]
                out["score"] += scores.tolist()
        return pa.table({c: pa.array(v, pa.int64()) for c, v in out.items()})

    return run


def numbered(vectors: DataFrame, scratch: Scratch, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(row, id, q): the vectors that take part, quantised, each row with a number of its own; written to the shared folder."""
    x = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), quantised(F.col(f"`{vector_col}`")).cast("array<int>").alias("q"))
    return scratch.keep(x.where("q IS NOT NULL").select(F.monotonically_increasing_id().alias("row"), "id", "q"))


def build_index(rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """The index and its number of blocks: (dims, block, ids, rows, depth, bitmaps), a row for each block of vectors of one length.

    rows: as numbered() returns them. Within a block rows stand in order of their ids (null last), so that
    their places decide between equal scores.
    """
    many = rows.count()
    blocks = max(1, -(-many // min(LARGEST, max(BLOCK, many // BLOCKS))))
    dealt = rows.select(F.size("q").alias("dims"), F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block"), "row", "id", "q")
    slots = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(blocks, 2000))
    made = dealt.repartition(slots, "dims", "block").groupBy("dims", "block").applyInArrow(_build, "dims int, block int, ids array<bigint>, rows array<bigint>, depth array<int>, bitmaps binary")
    return scratch.keep(made), blocks


def search(index: DataFrame, blocks: int, queries: DataFrame, k: int) -> DataFrame:
    """(query, query_id, rank, id, score): the k rows of the index with the highest inner products, ties to smaller ids (null last).

    queries: (query, query_id, q); a row of the index whose number is `query` is left out. Only vectors of one length
    meet. A query meets each block in one task, with up to CHUNK others; a block's own k rows are all it returns.
    """
    chunks = max(1, -(-queries.count() // CHUNK))
    slots = max(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(blocks * chunks, 2000))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    key = ("dims", "block", "chunk")
    left = index.withColumn("chunk", numbers(chunks)).repartition(slots, *key).groupBy(*key)
    asked = queries.select(F.size("q").alias("dims"), numbers(blocks).alias("block"), F.pmod(F.xxhash64("query"), F.lit(chunks)).cast("int").alias("chunk"), "query", "query_id", "q")
    found = left.cogroup(asked.repartition(slots, *key).groupBy(*key)).applyInArrow(_searcher(k), "query bigint, query_id bigint, row bigint, id bigint, score bigint")
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query", "query_id", "rank", "id", "score")


def nearest(vectors: DataFrame, scratch: Scratch, *, every: int = 50, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id_col, score) for every row whose id is divisible by `every`, against all other rows.

    Vectors that are null or empty or hold a null or non-finite component take no part. Rows of a repeated id are vectors of
    their own: each asks and is found; a row of null id is found, after others of its score, but does not ask. Ids
    are integers. An empty table, or one without queries, gives an empty one; other columns are not read.
    """
    rows = numbered(vectors, scratch, id_col, vector_col)
    index, blocks = build_index(rows, scratch)
    asked = rows.where(F.col("id") % every == 0).select(F.col("row").alias("query"), F.col("id").alias("query_id"), "q")
    return search(index, blocks, asked, k).select("query_id", "rank", F.col("id").alias(id_col), "score")
