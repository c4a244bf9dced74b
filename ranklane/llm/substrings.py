"""Substring dedup: matching statistics from compressed FM-indexes.

A window is WINDOW consecutive words. It can repeat only where its smallest GRAM-word hash (its anchor)
does, so documents are cut into segments, runs of windows that share an anchor, and segments go to shards by
anchor: all equal windows meet in one shard. A shard indexes its distinct segments once each: suffix order,
Burrows-Wheeler transform, wavelet matrix over packed bits. The segments are then streamed against it:
backward search extends every window word by word to the left, giving up where only the window itself is
left, and reports the suffix interval of those that reach WINDOW words; the smallest document in the
interval is where the window starts first.

An anchor that very many different segments share (a line that many documents quote) would fill its shard. Its
segments are cut again by longer anchors, GRAMS one after another, until what an anchor holds fits: equal windows
share these as well, and windows whose anchor is in one document only are out. The longest anchor is the window. What is found for the pieces
is put together for the segments they were cut from.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ranklane.llm.common import Scratch

WINDOW = 50
#: Words of an anchor: at first, and where one holds too much.
GRAMS = (8, 30, 44, WINDOW)
#: Documents whose results are sent on at once.
DOCS = 64
#: Words in a shard (about), and different words in order that an anchor may hold there.
SHARD_WORDS, ROOM = 100_000, 25_000
NO_ID = (1 << 63) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


@lru_cache(maxsize=None)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        return tuple(np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(size, b, np.uint64)))) for b in (_BASE, _INVERSE))


class WordHashes:
    """Hashes of any run of a text's words, from one pass of prefix sums."""

    def __init__(self, words: list[bytes]) -> None:
        w = np.frombuffer(b"".join(map(xxhash.xxh64_digest, words)), ">u8").astype(np.uint64)
        size = 1 << max(12, len(words).bit_length())
        up, self.down = _powers(size)
        self.prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(w * up[: len(w)], dtype=np.uint64)))

    def of(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        h = (self.prefix[start + length] - self.prefix[start]) * self.down[start]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        return h


def segments(words: list[bytes], gram: int = GRAMS[0]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, content hash, first word, windows) of each segment of a text of WINDOW words or more."""
    hashes, run = WordHashes(words), WINDOW - gram + 1  # windows in a segment at most
    low = hashes.of(np.arange(len(words) - gram + 1), gram)
    width = 1
    while 2 * width <= run:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    rest = run - width
    low = np.minimum(low[: len(low) - rest], low[rest:])
    fresh = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
    sizes = np.diff(np.append(fresh, len(low)))
    if (sizes > run).any():  # a gram that repeats in the text makes long runs
        pieces = -(-sizes // run)
        fresh = np.concatenate([f + run * np.arange(p) for f, p in zip(fresh.tolist(), pieces.tolist(), strict=True)])
        sizes = np.minimum(np.diff(np.append(fresh, len(low))), run)
    return low[fresh].view(np.int64), hashes.of(fresh, sizes + WINDOW - 1).view(np.int64), fresh.astype(np.int32), sizes.astype(np.int32)


class FMIndex:
    """A compressed full-text index of word sequences: backward search over a wavelet matrix of packed bits."""

    def __init__(self, texts: list[np.ndarray], symbols: int) -> None:
        """texts: word numbers from 1 on, under symbols; 0 ends each text."""
        self.text = np.concatenate([x for t in texts for x in (t, np.zeros(1, t.dtype))]).astype(np.int64)
        n = len(self.text)
        rank = self.text.copy()
        width = 1
        while True:
            behind = np.zeros(n, np.int64)
            behind[: n - width] = rank[width:] + 1
            key = rank * (int(rank.max()) + 2) + behind
            order = np.argsort(key, kind="stable")
            sorted_key = key[order]
            fresh = np.concatenate(([0], np.cumsum(sorted_key[1:] != sorted_key[:-1])))
            rank = np.empty(n, np.int64)
            rank[order] = fresh
            width *= 2
            if width > WINDOW or fresh[-1] == n - 1:  # deeper order is never asked for
                break
        self.order = order
        bwt = self.text[order - 1]
        counts = np.bincount(self.text, minlength=symbols)
        self.first = np.concatenate(([0], np.cumsum(counts)))
        self.levels = max(1, (symbols - 1).bit_length())
        self.bits, self.blocks, self.zeros = [], [], []
        at = np.zeros(symbols, np.int64)  # where each symbol's rows begin after the last level
        at_symbols = np.arange(symbols)
        for level in reversed(range(self.levels)):
            bit = (bwt >> level) & 1
            packed = np.packbits(bit.astype(np.uint8), bitorder="little")
            words = np.zeros(n // 64 + 1, np.uint64)
            words.view(np.uint8)[: len(packed)] = packed
            blocks = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))
            self.bits.append(words)
            self.blocks.append(blocks)
            self.zeros.append(n - int(blocks[-1]))
            bwt = np.concatenate((bwt[bit == 0], bwt[bit == 1]))
            ones = self._ones(len(self.bits) - 1, at)
            at = np.where((at_symbols >> level) & 1 == 1, self.zeros[-1] + ones, at - ones)
        self.shift = self.first[:symbols] - at

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        mask = (np.uint64(1) << bit) - np.uint64(1)
        return self.blocks[level][word] + np.bitwise_count(self.bits[level][word] & mask).astype(np.int64)

    def step(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the interval bound `at` goes when the pattern grows by a symbol to the left."""
        to = at
        for i, level in enumerate(reversed(range(self.levels))):
            ones = self._ones(i, to)
            to = np.where((symbol >> level) & 1 == 1, self.zeros[i] + ones, to - ones)
        return to + self.shift[symbol]

    def search(self, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which, low, high): the patterns of this length in the indexed text, given by their last positions,
        whose suffix interval holds more than themselves. The others stop at the first word that tells them apart."""
        which = np.arange(len(ends))
        symbol = self.text[ends]
        low, high = self.first[symbol], self.first[symbol + 1]
        for back in range(1, length):
            more = high - low > 1
            which, low, high = which[more], low[more], high[more]
            if not len(which):
                break
            symbol = self.text[ends[which] - back]
            low, high = self.step(symbol, low), self.step(symbol, high)
        more = high - low > 1
        return which[more], low[more], high[more]


def first_starts(contents: list[bytes], docs: np.ndarray) -> list[np.ndarray]:
    """For each text its windows' smallest document: of the text's own and of all texts of the shard that hold the window."""
    names: dict[bytes, int] = {}
    texts = [np.array([names.setdefault(w, len(names) + 1) for w in c.split()], np.int64) for c in contents]
    index = FMIndex(texts, len(names) + 1)
    sizes = np.array([len(t) for t in texts])
    begins = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    windows = sizes - WINDOW + 1
    own = np.repeat(np.arange(len(texts)), windows)
    inside = np.arange(len(own)) - np.repeat(np.cumsum(windows) - windows, windows)
    best = docs[own].copy()
    which, low, high = index.search(begins[own] + inside + WINDOW - 1, WINDOW)
    if len(which):
        doc_of = np.append(docs[np.searchsorted(begins, index.order, side="right") - 1], NO_ID)
        starts, back = np.unique(low, return_inverse=True)
        ends = np.zeros(len(starts), np.int64)
        ends[back] = high
        least = np.minimum.reduceat(doc_of, np.column_stack((starts, ends)).ravel())[::2]
        best[which] = least[back]
    return np.split(best, np.cumsum(windows)[:-1])


def _ranges(starts: np.ndarray) -> list[dict[str, int]]:
    """Runs of windows with the same smallest document: from, to (inclusive), doc."""
    cuts = np.flatnonzero(np.concatenate(([True], starts[1:] != starts[:-1])))
    ends = np.append(cuts[1:], len(starts)) - 1
    return [{"from": a, "to": b, "doc": d} for a, b, d in zip(cuts.tolist(), ends.tolist(), starts[cuts].tolist(), strict=True)]


_RANGES = "array<struct<`from`:int,to:int,doc:bigint>>"


def _cut_out(texts: DataFrame, wanted: DataFrame, *on: str) -> DataFrame:
    """(mz, key, lo, hi, n, content): the words of the wanted parts of texts, joined by one space.

    texts: the columns `on` and text; wanted: the same and parts, an array of (mz, key, lo, hi, start, n).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, DOCS) for b in batches for at in range(0, b.num_rows, DOCS)):
            rows = []
            for text, parts in zip(batch["text"].to_pylist(), batch["parts"].to_pylist(), strict=True):
                words = text.split()
                rows += [(p["mz"], p["key"], p["lo"], p["hi"], p["n"], b" ".join(words[p["start"] : p["start"] + p["n"] + WINDOW - 1])) for p in parts]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(_CUT.values())], names=list(_CUT))

    joined = texts.join(wanted, list(on)).select(F.col("text").cast("binary").alias("text"), "parts")
    return joined.mapInArrow(run, "mz bigint, key bigint, lo bigint, hi bigint, n int, content binary")


_CUT = {"mz": pa.int64(), "key": pa.int64(), "lo": pa.int64(), "hi": pa.int64(), "n": pa.int32(), "content": pa.binary()}


def _cut_again(contents: DataFrame, gram: int) -> DataFrame:
    """(mz0, key0, mz, key, lo, hi, start, n): the segments of contents (mz, key, lo, hi, content) by anchors of gram words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, DOCS) for b in batches for at in range(0, b.num_rows, DOCS)):
            cut = [segments(c.split(), gram) for c in batch["content"].to_pylist()]
            many = [len(c[0]) for c in cut]
            of = lambda name: pa.array(np.repeat(batch[name].to_numpy(), many))  # noqa: B023, E731
            own = [pa.array(np.concatenate([c[i] for c in cut])) for i in range(4)]
            yield pa.RecordBatch.from_arrays([of("mz"), of("key"), own[0], own[1], of("lo"), of("hi"), own[2], own[3]], names=["mz0", "key0", "mz", "key", "lo", "hi", "start", "n"])

    return contents.select("mz", "key", "lo", "hi", "content").mapInArrow(run, "mz0 bigint, key0 bigint, mz bigint, key bigint, lo bigint, hi bigint, start int, n int")


def _index(contents: DataFrame, shards: int) -> DataFrame:
    """(depth, mz, key, found): each content's windows' smallest documents, shard by shard."""

    def run(table: pa.Table) -> pa.Table:
        found = first_starts(table["content"].to_pylist(), table["lo"].to_numpy())
        kind = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32()), ("doc", pa.int64())]))
        return pa.table({"depth": table["depth"], "mz": table["mz"], "key": table["key"], "found": pa.array([_ranges(f) for f in found], kind)})

    dealt = contents.select("depth", "mz", "key", "lo", "content", F.pmod(F.xxhash64("mz"), F.lit(shards)).cast("int").alias("shard"))
    slots = max(int(contents.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(shards, 4000))
    return dealt.repartition(slots, "shard").groupBy("shard").applyInArrow(run, f"depth int, mz bigint, key bigint, found {_RANGES}").distinct()


def _shared(parts: DataFrame, low: str, high: str) -> DataFrame:
    """(mz): anchors of more than one document."""
    return parts.groupBy("mz").agg(F.min(low).alias("lo"), F.max(high).alias("hi")).where("lo < hi").select("mz")


def repeated_windows(docs: DataFrame, scratch: Scratch, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, th, starts): for each document the ranges (from, to) of first words of windows that also start in a document of smaller id.

    doc is the id (NO_ID for null) and th a hash of the text, which tell rows apart. Joins are left to Spark, so
    every size of input runs by the same plan: each text moves once, to the list of its repeated parts.
    """
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), F.col(text_col).alias("text")).where(F.col("text").isNotNull()).withColumn("th", F.xxhash64("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, DOCS) for b in batches for at in range(0, b.num_rows, DOCS)):
            found = []
            for doc, th, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = text.encode("utf-8").split()
                if len(words) >= WINDOW:
                    mz, key, start, n = segments(words)
                    found.append((mz, key, np.full(len(mz), doc, np.int64), np.full(len(mz), th, np.int64), start, n))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], names=["mz", "key", "doc", "th", "start", "n"])

    cut_rows, cut_path = scratch.write(texts.select("doc", "th", "text").mapInArrow(cut, "mz bigint, key bigint, doc bigint, th bigint, start int, n int"))
    # anchors of one document only are out
    parts, parts_path = scratch.write(cut_rows.join(scratch.keep(_shared(cut_rows, "doc", "doc")), "mz"))
    scratch.drop(cut_path)
    part = F.struct("mz", "key", "lo", "hi", F.col("at.start").alias("start"), "n")
    kinds = parts.groupBy("mz", "key").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.min(F.struct("doc", "th", "start")).alias("at"), F.min("n").alias("n"))
    wanted = kinds.groupBy(F.col("at.doc").alias("doc"), F.col("at.th").alias("th")).agg(F.collect_list(part).alias("parts"))
    level = scratch.keep(_cut_out(texts, wanted, "doc", "th"))
    contents, cuts = [], []
    for depth, longer in enumerate((*GRAMS[1:], None)):
        crowded = None
        if longer:
            crowded = scratch.keep(level.groupBy("mz").agg(F.sum(F.col("n") + WINDOW - 1).alias("words")).where(F.col("words") > ROOM).select("mz"))
        if not longer or crowded.isEmpty():
            contents.append(level.withColumn("depth", F.lit(depth)))
            break
        contents.append(level.join(crowded, "mz", "left_anti").withColumn("depth", F.lit(depth)))
        above = scratch.keep(level.join(crowded, "mz", "left_semi").dropDuplicates(["mz", "key"]))
        cut = scratch.keep(_cut_again(above, longer))
        cut = scratch.keep(cut.join(scratch.keep(_shared(cut, "lo", "hi")), "mz"))
        cuts.append(cut)
        kinds = cut.groupBy("mz", "key").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min(F.struct("mz0", "key0", "start")).alias("at"), F.min("n").alias("n"))
        wanted = kinds.groupBy(F.col("at.mz0").alias("mz0"), F.col("at.key0").alias("key0")).agg(F.collect_list(part).alias("parts"))
        level = scratch.keep(_cut_out(above.select(F.col("mz").alias("mz0"), F.col("key").alias("key0"), F.col("content").alias("text")), wanted, "mz0", "key0"))
    every = contents[0]
    for more in contents[1:]:
        every = every.unionByName(more)
    every = scratch.keep(every)
    words = every.agg(F.sum(F.col("n") + WINDOW - 1)).first()[0] or 0
    # rows of equal id and text cut out the same part more than once, so results are made distinct
    found = scratch.keep(_index(every, max(1, -(-words // SHARD_WORDS))))
    results = found.where(F.col("depth") == len(cuts)).select("mz", "key", "found")
    for depth in reversed(range(len(cuts))):
        moved = F.transform("found", lambda r: F.struct((r["from"] + F.col("start")).alias("from"), (r["to"] + F.col("start")).alias("to"), r["doc"].alias("doc")))
        pieces = cuts[depth].select("mz0", "key0", "mz", "key", "start").join(results, ["mz", "key"]).select(F.col("mz0").alias("mz"), F.col("key0").alias("key"), moved.alias("found"))
        together = pieces.groupBy("mz", "key").agg(F.array_sort(F.flatten(F.collect_list("found"))).alias("found"))
        results = scratch.keep(found.where(F.col("depth") == depth).select("mz", "key", "found").unionByName(together))
    # a part's windows that start earlier elsewhere, at their places in each document that has the part
    hit = parts.join(results, ["mz", "key"]).select("doc", "th", "start", F.filter("found", lambda r: r["doc"] < F.col("doc")).alias("hit")).where(F.size("hit") > 0)
    hit = hit.select("doc", "th", F.transform("hit", lambda r: F.struct((F.col("start") + r["from"]).alias("from"), (F.col("start") + r["to"]).alias("to"))).alias("starts"))
    out = scratch.keep(hit.groupBy("doc", "th").agg(F.flatten(F.collect_list("starts")).alias("starts")))
    scratch.drop(parts_path)
    return out


def remove_repeats(docs: DataFrame, scratch: Scratch, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), texts: bool = False) -> DataFrame:
    """The kept columns, n_words, n_removed and kept_sha256; with texts=True the kept words, joined by one space, as kept_text.

    A word goes if a window that covers it also starts in a document of smaller id. Windows are judged on the
    input. A null or short text loses nothing; a null id counts as larger than all, so such rows lose what
    others have and take nothing from them. Rows of equal id are one document's: none is smaller than the
    other. An empty table gives an empty one.
    """
    starts = repeated_windows(docs, scratch, id_col=id_col, text_col=text_col)
    rows = docs.select(F.struct(*keep).alias("kept"), F.col(text_col).alias("_text"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(F.col(text_col)).alias("th"))
    joined = rows.join(starts, ["doc", "th"], "left").select("kept", "_text", "starts")
    fields = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())]
    fields += [T.StructField("kept_text", T.StringType())] if texts else []
    schema = T.StructType([joined.schema["kept"], *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for text, ranges in zip(batch["_text"].to_pylist(), batch["starts"].to_pylist(), strict=True):
                words = (text or "").encode("utf-8").split()
                left = words
                if ranges:
                    edge = np.zeros(len(words) + 1, np.int64)
                    for r in ranges:
                        edge[r["from"]] += 1
                        edge[r["to"] + WINDOW] -= 1
                    left = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
                kept = b" ".join(left)
                out[0].append(len(words))
                out[1].append(len(words) - len(left))
                out[2].append(hashlib.sha256(kept).hexdigest())
                if texts:
                    out[3].append(kept.decode("utf-8"))
            arrays = [batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays + ([pa.array(out[3], pa.string())] if texts else []), names=schema.names)

    return joined.mapInArrow(run, schema).select("kept.*", *[f.name for f in fields])
