"""Document fingerprints by a homomorphic multiset hash.

A text is a multiset of paragraphs, its lines that are not blank. Each is hashed to a wide vector, and the sum of
these vectors modulo 2**64, in WIDE lanes, tells whether two texts have the same paragraphs. An edit within a
paragraph would change all that it gives, so likeness is read from further lanes: paragraphs are cut into
passages behind words that their last byte marks, so that the cuts depend on the content alone and an edit
changes the passages it touches and no others, and each passage adds a vector of LANES lanes of +1 and -1,
modulo 2**32, which no text of less than 2**31 passages fills. Sums do not depend on order, and a paragraph is
added or taken away by adding or subtracting its vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ranklane.operators.ranking import running
from ranklane.sources.shared import kept

LANES, WIDE = 128, 4
#: Vectors that are summed at once, so that a very long text needs no more memory than a short one.
AT_ONCE = 1 << 14
#: Bytes of text in a slot (about); it is less where that leaves fewer slots than twice the shuffle partitions.
SLOT_BYTES = 64 << 20


def paragraphs(text: str) -> list[bytes]:
    """The lines of a whole text without white space around them; blank ones are none."""
    return [p for p in (line.strip() for line in text.encode("utf-8").split(b"\n")) if p]


def passages(text: str) -> list[bytes]:
    """The passages of a whole text, without white space around them; none for an empty text."""
    raw = text.encode("utf-8")
    a = np.frombuffer(raw, np.uint8)
    space = (a == 32) | ((a >= 9) & (a <= 13))
    before = np.concatenate(([0], a[:-1])) if len(a) else a
    cuts = np.flatnonzero((a == 10) | (space & (before & 3 == 1))).tolist()
    parts = (raw[s:e].strip() for s, e in zip([0, *cuts], [*cuts, len(raw)], strict=True))
    return [p for p in parts if p]


class Fingerprint:
    """A sum of the vectors of paragraphs (wide) and of their passages (narrow)."""

    __slots__ = ("narrow", "wide")

    def __init__(self, narrow: np.ndarray | None = None, wide: np.ndarray | None = None) -> None:
        self.narrow = np.zeros(LANES, np.int32) if narrow is None else narrow
        self.wide = np.zeros(WIDE, np.uint64) if wide is None else wide

    def add(self, text: str, sign: int = 1) -> Fingerprint:
        """With a text's paragraphs added, or taken away for sign -1."""
        narrow, wide = self.narrow.copy(), self.wide.copy()
        for some in _blocks(paragraphs(text)):
            lanes = _digests(some, 8 * WIDE).view("<u8").sum(axis=0, dtype=np.uint64)
            wide = wide + lanes if sign > 0 else wide - lanes
        for some in _blocks(passages(text)):
            ones = np.unpackbits(_digests(some, LANES // 8), axis=1).sum(axis=0, dtype=np.int32)
            narrow += (sign * (2 * ones - len(some))).astype(np.int32)
        return Fingerprint(narrow, wide)

    def hex(self) -> str:
        return self.wide.astype(">u8").tobytes().hex() + self.narrow.astype(">i4").tobytes().hex()

    @classmethod
    def parse(cls, told: str) -> Fingerprint:
        raw = bytes.fromhex(told)
        return cls(np.frombuffer(raw[8 * WIDE :], ">i4").astype(np.int32), np.frombuffer(raw[: 8 * WIDE], ">u8").astype(np.uint64))

    def likeness(self, other: Fingerprint) -> float:
        """1 for equal multisets, else about the cosine of their counts, from 0 to 1; 0 if one of them is empty."""
        if (self.wide == other.wide).all() and (self.narrow == other.narrow).all():
            return 1.0
        a, b = self.narrow.astype(np.float64), other.narrow.astype(np.float64)
        size = float(np.sqrt((a @ a) * (b @ b)))
        return min(1.0, max(0.0, float(a @ b) / size)) if size else 0.0


def _blocks(parts: list[bytes]) -> Iterator[list[bytes]]:
    return (parts[start : start + AT_ONCE] for start in range(0, len(parts), AT_ONCE))


def _digests(parts: list[bytes], size: int) -> np.ndarray:
    """One row of size bytes for each part."""
    return np.frombuffer(b"".join([hashlib.blake2b(p, digest_size=size).digest() for p in parts]), np.uint8).reshape(len(parts), size)


def fingerprint(text: str) -> Fingerprint:
    return Fingerprint().add(text)


def in_id_order(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(slot, carry, id, text), partitioned by slot and sorted by falling id; every slot ends with carry rows.

    Rows are put in order by id and their text's hash alone, null ids last, and cut into slots of like numbers of bytes; each slot also
    gets the row that follows its last one, the first row of the next slot (behind the last slot, that of the first
    one), marked as carry. So every row meets its successor in its own partition and one shuffle moves each text once. Where slots
    begin is a table of a row for each, which every task gets: it grows with the bytes, not the plan.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    # the complement falls as ids rise, and exists for every id
    rows = rows.withColumn("o", F.struct(F.col("id").isNull().alias("n"), F.bitwise_not(F.coalesce("id", F.lit(0))).alias("k"), F.xxhash64("text").alias("tie")))
    light = kept(rows.groupBy("o").agg(F.sum(F.octet_length("text").cast("long") + 64).alias("bytes")))
    held = light.agg(F.sum("bytes")).first()[0] or 0
    size = max(1, min(SLOT_BYTES, held // (2 * int(spark.conf.get("spark.sql.shuffle.partitions")))))
    firsts = kept(running(light, F.col("bytes"), "o").groupBy(F.floor(F.col("before") / size).alias("s")).agg(F.min("o").alias("o")))
    number = F.row_number().over(Window.orderBy("o")) - 1  # of slots
    goes = firsts.select("o", number.alias("at")).withColumn("to", F.when(F.col("at") > 0, F.col("at") - 1).otherwise(F.max("at").over(Window.partitionBy())))
    bounds = firsts.agg(F.array_sort(F.collect_list("o")).alias("bounds")).withColumn("width", F.greatest(F.lit(1), F.round(F.sqrt(F.size("bounds"))).cast("int")))
    bounds = bounds.withColumn("coarse", F.filter("bounds", lambda b, i: i % F.col("width") == 0))
    # how many slots begin at a row or before it: first among every width-th, then among those between two of these
    before = lambda some: F.size(F.filter(some, lambda b: b <= F.col("o")))
    coarse = F.greatest(before(F.col("coarse")) - 1, F.lit(0)) * F.col("width")
    slot = coarse + before(F.slice("bounds", coarse + 1, F.col("width"))) - 1
    dealt = rows.crossJoin(F.broadcast(bounds)).withColumn("slot", slot).drop("bounds", "width", "coarse").join(F.broadcast(goes.select("o", "to")), "o", "left")
    targets = F.array_compact(F.array(F.struct("slot", F.lit(0).alias("carry")), F.when(F.col("to").isNotNull(), F.struct(F.col("to").alias("slot"), F.lit(1).alias("carry")))))
    spread = dealt.select(F.explode(targets).alias("at"), "id", "text", "o").select("at.*", "id", "text", "o")
    slots = max(1, -(-held // size))
    return spread.repartition(slots, "slot").sortWithinPartitions("slot", "carry", "o").select("slot", "carry", "id", "text")


def compare_edits(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint, that of its edited text, and the likeness of its own to both that and the next one's.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many (or all) of the
    next document in falling id order; behind the last comes the first, and a lone document follows itself.
    A null text is empty; its fingerprint is zero. Ids are whole numbers; rows of one id, or of none, are in the order of their texts' hashes. An empty
    table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row that waits for its successor
        for batch in batches:
            out: list[tuple] = []
            for slot, carry, key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if carry and (held is None or held[0] != slot):
                    continue  # a second copy of the carried row
                own = fingerprint(text)
                if held is not None and held[0] == slot:
                    _, h_key, h_text, h_own = held
                    half = len(h_text) // 2
                    edited = h_text[: len(h_text) - half] + text[:half]
                    changed = fingerprint(edited)
                    out.append((h_key, len(h_text), hashlib.sha256(edited.encode("utf-8")).hexdigest(), h_own.hex(), changed.hex(), h_own.likeness(changed), h_own.likeness(own)))
                held = None if carry else (slot, key, text, own)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)

    names = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = ["bigint", "bigint", "string", "string", "string", "double", "double"]
    return in_id_order(docs, id_col, text_col).mapInArrow(run, ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds, strict=True)))
