"""SimHash near-duplicates by covering locality-sensitive hashing.

Each bit position of a fingerprint gets a nonzero vector of RADIUS + 1 bits; the table of a nonzero vector v
keeps the positions whose vectors have an odd inner product with v. Any RADIUS positions leave some v
orthogonal to all of theirs, so a pair that differs in no more than them agrees on everything that v's table
keeps: every pair within the radius meets in some table, for certain (Pagh 2016). With radius 2 there are
7 tables of about 36 kept bits.

A bucket may hold very many fingerprints, so its pairs are never listed. Within a bucket two fingerprints
differ only in positions that the table drops, and they are within distance 2 if and only if they have a
common neighbour at distance 1 or less among these: each fingerprint sends its neighbours' names, and those
that meet in a name (one more than the dropped positions at most) are linked to the smallest of them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ranklane.llm.common import Scratch, components, slices

BITS, RADIUS, WORDS, SEED = 64, 2, 3, 42
#: What keep_similar goes by.
SIMILAR_WORDS, SIMILARITY = 5, Fraction(4, 5)
#: Documents (about) and shingles of theirs that the prefix filter's order is taken from; it decides what is compared, not what is found.
SAMPLED, ORDERED = 8_000, 100_000
#: Numbers of 64 bits in a set's parity sketch, and bits of a large set's wide and fine ones at most.
PARTS, WIDEST, FINEST = 16, 1 << 20, 1 << 22
#: Bits a shingle (at least) of a fine sketch, which only sets that are looked up have.
FINE = 4
#: Cells of the map of shingles that several sets have; it is as large for any input, and decides only what is shuffled.
CELLS = 1 << 25
#: Rows of 40 bytes (about) that may be broadcast.
FEW = 500_000
#: Rounds that join groups by comparing with one member for each shingle, before pairs are listed.
STARS = 2
#: Shingles that are counted at once, so that a very long text needs no more memory than a short one.
AT_ONCE = 1 << 15


def shingle_hashes(text: str, size: int = WORDS) -> Iterator[np.ndarray]:
    """XXH64 of every shingle of size words, repeats included, in blocks of AT_ONCE rows of 8 bytes, most significant first."""
    words = text.encode("utf-8").translate(_LOWER).split()
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(len(words) - size + 1, 1) if words else 0
    last = ends[size - 1 :] if len(words) >= size else ends[-1:]
    digest = xxhash.xxh64_digest
    for at in range(0, n, AT_ONCE):
        block = [digest(joined[s:e], SEED) for s, e in zip(starts[at : min(at + AT_ONCE, n)].tolist(), last[at : at + AT_ONCE].tolist(), strict=True)]
        yield np.frombuffer(b"".join(block), np.uint8).reshape(-1, 8)


_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def _print(blocks: Iterable[np.ndarray]) -> int:
    ones, n = np.zeros(BITS, np.int64), 0
    for block in blocks:
        ones += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int32)
        n += len(block)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def fingerprint(text: str | None) -> int:
    """The fingerprint as a signed 64-bit number: a bit is 1 if set in over half of the shingles' hashes."""
    return _print(shingle_hashes(text or ""))


def fingerprints(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and fp, the fingerprint as bigint; a null text has no words and the fingerprint zero."""
    kept = docs.select(*keep, docs[text_col].alias("_text"))
    schema = T.StructType([*kept.schema.fields[:-1], T.StructField("fp", T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [fingerprint(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.int64())], names=schema.names)

    return kept.mapInArrow(run, schema)


def covering_masks(bits: int = BITS, radius: int = RADIUS) -> list[int]:
    """The tables' masks, one for each nonzero vector of radius + 1 bits; positions take such vectors in turn."""
    vectors = range(1, 1 << (radius + 1))
    own = [vectors[i % len(vectors)] for i in range(bits)]
    return [sum(1 << i for i in range(bits) if (own[i] & v).bit_count() % 2) for v in vectors]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def links(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) that connect just what pairs of fingerprints within RADIUS connect.

    distinct: fp, one row for each value. Buckets of one fingerprint end after the first, partially
    aggregated count; the rest meet by neighbours' names.
    """
    masks = [_signed(m) for m in covering_masks()]
    tables = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)])
    members = distinct.select("fp", F.explode(tables).alias("m")).select("fp", "m.*")
    shared = members.groupBy("t", "key").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low < high").select("t", "key")
    met = members.join(shared, ["t", "key"])
    dropped = F.lit(None).cast("array<bigint>")
    for i, m in enumerate(masks):
        dropped = F.when(F.col("t") == i, F.array(F.lit(0).cast("bigint"), *[F.lit(_signed(1 << b)) for b in range(BITS) if not m >> b & 1])).otherwise(dropped)
    named = met.select("fp", F.explode(dropped).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("name")).distinct()
    least = named.groupBy("name").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a < b").select("name", "a")
    return named.join(least, "name").where("fp <> a").select("a", F.col("fp").alias("b")).distinct()


def near_duplicates(docs: DataFrame, scratch: Scratch, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id) for every row: the smallest id reachable by links, the row's own included.

    Equal fingerprints (copies, and all texts without words) are one node whatever their number, so links
    are searched between different ones only. Rows of a null id are linked like others; a component of
    null ids alone has a null component_id. Repeated rows repeat in the result. An empty table gives an
    empty one.
    """
    prints = scratch.keep(fingerprints(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", ("id",)))
    classes = scratch.keep(prints.groupBy("fp").agg(F.min("id").alias("id")))
    joined = components(links(classes.select("fp")), scratch)
    # the component's smallest id; a fingerprint without links is alone
    own = classes.join(joined.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "id", F.coalesce("component", "fp").alias("root"))
    least = own.groupBy("root").agg(F.min("id").alias("component_id"))
    of_print = own.join(least, "root").select("fp", "component_id")
    return prints.join(of_print, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The fingerprint as 16 lowercase hex digits."""
    return found.select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, scratch: Scratch, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group, with the columns of docs: that whose id is the component's.

    Rows that repeat an id are all kept or all dropped with it; rows of a null id are kept only where their
    component has no other.
    """
    found = near_duplicates(docs, scratch, id_col=id_col, text_col=text_col)
    ids = found.where(F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias("id")).distinct()
    return docs.alias("d").join(ids.alias("i"), F.col(f"d.`{id_col}`").eqNullSafe(F.col("i.id")), "left_semi")


def shingle_set(blocks: Iterable[np.ndarray]) -> np.ndarray:
    """The different shingles by their hashes, ascending; a short text is one shingle, one without words has none."""
    found = [np.ascontiguousarray(b).view(">i8").ravel().astype(np.int64) for b in blocks]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def _node(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.tobytes()) - (1 << 63)


def _parity(cells: np.ndarray, bits: int) -> np.ndarray:
    """The bits, packed, that an odd number of cells (modulo bits, a power of two) falls on."""
    return np.packbits(np.bincount(cells & (bits - 1), minlength=bits) & 1)


def _sets(texts: DataFrame, words: int) -> DataFrame:
    """(node, n, fine, shingles) of every row of a text column: the n shingles and a sketch of FINE bits a shingle or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                found = shingle_set(shingle_hashes(text, words))
                n = len(found)
                fine = _parity(found >> 20, min(FINEST, max(64 * PARTS, FINE << (n - 1).bit_length()))).tobytes()
                arrays = [pa.array([_node(found)], pa.int64()), pa.array([n], pa.int64()), pa.array([fine], pa.binary()), pa.array([found], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(arrays, names=["node", "n", "fine", "shingles"])

    return texts.mapInArrow(run, "node bigint, n bigint, fine binary, shingles array<bigint>")


def _common(rows: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that a sample of the documents has more than once, ascending, and how often."""
    rate = min(1.0, SAMPLED / max(1, rows.count()))
    draw = F.pmod(F.xxhash64(F.lit(5), "text"), F.lit(1 << 20)) < int(rate * (1 << 20))
    seen = _sets(rows.where(draw).select("text"), words).select(F.explode("shingles").alias("s")).groupBy("s").agg(F.count("*").alias("n")).where("n > 1")
    top = sorted((r.s, r.n) for r in seen.orderBy(F.desc("n"), "s").limit(ORDERED).collect())
    return np.array([s for s, _ in top], np.int64), np.array([n for _, n in top], np.int64)


_SKETCH = [f"k{i}" for i in range(PARTS)]


def _measured(rows: DataFrame, similarity: Fraction, words: int) -> DataFrame:
    """(id, tk, node, fp, n, the sketch, the wide sketch, prefix) of every row of (id, tk, text).

    node names the set of n shingles. A sketch bit is the parity of the shingles that fall on it, so two sketches
    differ in no more bits than their sets have shingles that are not common; a wide one has at least a bit a shingle,
    and folded it is the sketch. prefix: the shingles of which
    sets of this similarity share one, those that many documents have last.
    """
    common, often = _common(rows, words)
    top, whole = similarity.numerator, similarity.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            told: list[list] = [[] for _ in range(6)]
            for text in batch.column(2).to_pylist():
                blocks = list(shingle_hashes(text, words))
                found = shingle_set(blocks)
                rank = np.zeros(len(found), np.int64)
                if len(common) and len(found):
                    at = np.minimum(np.searchsorted(common, found), len(common) - 1)
                    rank = np.where(common[at] == found, often[at], 0)
                n = len(found)
                bits = min(WIDEST, max(64 * PARTS, 1 << (n - 1).bit_length()))
                wide = _parity(found, bits)
                odd = np.bitwise_xor.reduce(wide.view(np.int64).reshape(-1, PARTS))
                prefix = found[np.lexsort((found, rank))][: n + top * -n // whole + 1] if n else found
                for column, x in zip(told, (_node(found), _print(blocks), n, odd, prefix, wide.tobytes()), strict=True):
                    column.append(x)
            sketch = np.stack(told[3]) if told[3] else np.zeros((0, PARTS), np.int64)
            arrays = [pa.array(c, pa.int64()) for c in told[:3]] + [pa.array(sketch[:, i]) for i in range(PARTS)] + [pa.array(told[5], pa.binary()), pa.array(told[4], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], names=["id", "tk", "node", "fp", "n", *_SKETCH, "wide", "prefix"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "tk", "text").mapInArrow(run, f"id {kind}, tk bigint, node bigint, fp bigint, n bigint, {', '.join(k + ' bigint' for k in _SKETCH)}, wide binary, prefix array<bigint>")


def _may(a: Column, b: Column, similarity: Fraction) -> Column:
    """Whether the sets of two structs (n and the sketch) can be similar enough: by their sizes, and what sketches differ in is not common."""
    top, whole = similarity.numerator, similarity.denominator
    apart = sum((F.bit_count(a[k].bitwiseXOR(b[k])) for k in _SKETCH), F.lit(0))
    sized = F.least(a["n"], b["n"]) * whole >= F.greatest(a["n"], b["n"]) * top
    return sized & (apart * (whole + top) <= (whole - top) * (a["n"] + b["n"]))


def _wide_may(pairs: DataFrame, similarity: Fraction) -> DataFrame:
    """(a, b) of the pairs (a, b, sizes, wide or fine sketches) whose sketches say that they can be similar enough; the wider one is folded."""
    top, whole = similarity.numerator, similarity.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keep = []
            for n, m, x, y in zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                size = min(len(x), len(y))
                x, y = (np.bitwise_xor.reduce(z.reshape(-1, size)) for z in (x, y))
                keep.append(int(np.bitwise_count(x ^ y).sum()) * (whole + top) <= (whole - top) * (n + m))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.mapInArrow(run, "a bigint, b bigint")


def _sized(keys: DataFrame) -> DataFrame:
    """Keys that texts are looked up by, broadcast if they are few; else Spark shuffles both sides."""
    return F.broadcast(keys) if keys.count() <= FEW else keys


def _mapped(one: DataFrame, shared: DataFrame) -> DataFrame:
    """(token, node) of the prefixes' shingles, without most of those that are not shared: a map of bits tells them."""
    cell = F.pmod(F.col("token"), F.lit(CELLS))
    told = shared.select(F.floor(cell / 64).cast("int").alias("word"), F.expr("shiftleft(1L, CAST(pmod(token, 64) AS INT))").alias("bit"))
    words = told.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(CELLS // 64, np.int64)
    bits[words["word"].to_numpy()] = words["bits"].to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefix = batch.column(1)
            token = prefix.flatten().to_numpy()
            node = np.repeat(batch.column(0).to_numpy(), prefix.value_lengths().fill_null(0).to_numpy())
            at = token & (CELLS - 1)
            may = bits[at >> 6] >> (at & 63) & 1 == 1
            yield pa.RecordBatch.from_arrays([pa.array(token[may]), pa.array(node[may])], names=["token", "node"])

    return one.select("node", "prefix").mapInArrow(run, "token bigint, node bigint")


def _confirmed(pairs: DataFrame, rows: DataFrame, info: DataFrame, similarity: Fraction, words: int, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are similar enough: by their sketches first, then by the sets themselves.

    A set goes with each pair that it is compared in, so the fine sketches, which tell nearly all that sets would at a
    tenth of their bytes, leave few pairs to the sets.
    """
    of = lambda c: info.select(F.col("node").alias(c), F.col("m").alias(f"m_{c}"))
    pairs = pairs.distinct().join(of("a"), "a").join(of("b"), "b").where(_may(F.col("m_a"), F.col("m_b"), similarity)).select("a", "b", F.greatest("m_a.n", "m_b.n").alias("n"))
    pairs = scratch.keep(pairs)
    large = pairs.where(F.col("n") > 64 * PARTS)
    of = lambda c: info.where(F.col("m.n") > 32 * PARTS).select(F.col("node").alias(c), F.col("m.n").alias(f"n_{c}"), F.col("wide").alias(f"w_{c}"))
    large = _wide_may(large.join(of("a"), "a").join(of("b"), "b").select("a", "b", "n_a", "n_b", "w_a", "w_b"), similarity)
    pairs = scratch.keep(pairs.where(F.col("n") <= 64 * PARTS).select("a", "b").union(large))
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = _sized(scratch.keep(info.join(ends, "node").select("at.*")))
    texts = rows.alias("r").join(wanted.alias("w"), F.expr("r.tk = w.tk AND r.id <=> w.id"), "left_semi")
    sets, place = scratch.write(_sets(texts.select("text"), words).dropDuplicates(["node"]))
    of = lambda c: sets.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("fine").alias(f"w_{c}"))
    pairs = scratch.keep(_wide_may(pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "n_a", "n_b", "w_a", "w_b"), similarity))
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    enough = shared * (similarity.numerator + similarity.denominator) >= similarity.numerator * (F.size("x") + F.size("y"))
    found = scratch.keep(both.where(enough).select("a", "b"))
    scratch.drop(place)
    return found


def keep_similar(docs: DataFrame, scratch: Scratch, *, id_col: str = "doc_id", text_col: str = "text", similarity: Fraction = SIMILARITY, words: int = SIMILAR_WORDS) -> DataFrame:
    """One document of each group that pairs of this similarity or more connect, with the columns of docs: that of the smallest id.

    Similarity is that of the sets of shingles; texts without words are one group. Every row is judged by itself: rows
    that repeat an id stay where their group has no smaller one, those of a null id where it has no other. An empty
    table gives an empty one.

    Candidates are texts that fingerprints link and texts that share a shingle of their prefixes. Of the latter each is
    compared with one for each shingle first, in rounds that each take another; that joins large groups without listing
    their pairs. Then those that share one and are still apart are compared with each other; sketches keep what is
    surely less similar from being listed, and a pair is listed once for each run of shingles that it shares.
    """
    key = F.col(f"`{id_col}`")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(key.alias("id"), text.alias("text")).withColumn("tk", F.xxhash64("text"))
    prints, prints_path = scratch.write(_measured(rows, similarity, words))
    at = F.min(F.struct("tk", "id")).alias("at")
    one, one_path = scratch.write(prints.groupBy("node").agg(F.min("id").alias("id"), at, *[F.first(c).alias(c) for c in ("fp", "n", *_SKETCH, "wide", "prefix")]))
    of_row = scratch.keep(prints.select("id", "tk", "node"))
    scratch.drop(prints_path)
    info = scratch.keep(one.select("node", "id", "at", "fp", F.struct("n", *_SKETCH).alias("m"), "wide"))
    token = one.select(F.explode("prefix").alias("token"))
    shared = scratch.keep(token.groupBy("token").agg(F.count("*").alias("n")).where("n > 1").select("token"))
    left, left_path = scratch.write(_mapped(one, shared).join(shared, "token").select("token", "node", F.col("node").alias("c")))
    scratch.drop(one_path)

    classes = scratch.keep(info.groupBy("fp").agg(F.min("node").alias("node")))
    equal = info.join(classes.withColumnRenamed("node", "a"), "fp").where("node <> a").select("a", F.col("node").alias("b"))
    of = lambda c: classes.select(F.col("fp").alias(f"fp_{c}"), F.col("node").alias(c))
    linked = links(classes.select("fp")).select(F.col("a").alias("fp_a"), F.col("b").alias("fp_b")).join(of("a"), "fp_a").join(of("b"), "fp_b").select("a", "b")
    edges, pairs = None, equal.union(linked)
    for turn in range(STARS):
        centre = left.groupBy("token").agg(F.min(F.struct(F.xxhash64(F.lit(turn), "node").alias("turn"), "node", "c")).alias("o"))
        star = left.join(centre, "token").where("c <> o.c").select(F.col("o.node").alias("a"), F.col("node").alias("b"))
        found = _confirmed(star if turn else pairs.union(star), rows, info, similarity, words, scratch)
        edges = found if edges is None else edges.union(found)
        label = components(edges, scratch)
        named = left.select("token", "node").join(label, "node", "left").select("token", "node", F.coalesce("component", "node").alias("c"))
        mixed = named.groupBy("token").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("token")
        still, still_path = scratch.write(named.join(mixed, "token"))
        scratch.drop(left_path)
        left, left_path = still, still_path
    # who meets at the shingle before as well need not be listed again
    before = F.lag("token").over(Window.partitionBy("node").orderBy("token"))
    member = F.struct("node", "c", "before", "m.*")
    met = left.join(info.select("node", "m"), "node").withColumn("before", before).select("token", member.alias("x"))
    other = met.select("token", F.col("x").alias("y"))
    fresh = ~F.coalesce(F.col("x.before") == F.col("y.before"), F.lit(False))
    listed = met.join(other, "token").where((F.col("x.node") < F.col("y.node")) & (F.col("x.c") != F.col("y.c")) & fresh & _may(F.col("x"), F.col("y"), similarity))
    edges = edges.union(_confirmed(listed.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")), rows, info, similarity, words, scratch))
    scratch.drop(left_path)
    groups = info.select("node", "id").join(components(edges, scratch), "node", "left").select("node", "id", F.coalesce("component", "node").alias("root"))
    smallest = groups.groupBy("root").agg(F.min("id").alias("smallest"))
    of_node = groups.join(smallest, "root").select("node", "smallest")
    dropped = _sized(scratch.keep(of_row.join(of_node, "node").where(~F.col("id").eqNullSafe(F.col("smallest"))).select("id", "tk").distinct()))
    return docs.alias("d").join(dropped.alias("x"), F.col(f"d.`{id_col}`").eqNullSafe(F.col("x.id")) & (F.xxhash64(F.coalesce(F.col(f"d.`{text_col}`"), F.lit(""))) == F.col("x.tk")), "left_anti")
