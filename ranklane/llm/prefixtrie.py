"""Prefix trie of conversations: every distinct beginning is a node, with figures of its members and its subtree.

Turns are known by digests. Equal conversations are one sequence with a count before anything is grouped. Sequences are
dealt by the digest of their first turn; each deal builds pointer dictionary tries in applyInPandas and sums subtrees in
one walk without recursion. A first turn with too many turns behind it is split before: its sequences
are dealt again by the next turn after what they all share, as often as needed, and the nodes above are summed from
the tries below.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ranklane.llm.common import Scratch

#: Turns of distinct sequences that are built in one trie, and turns in a deal (about).
LARGEST = 4096
#: Split subtries of one round that are sent to all tasks (about 100 bytes and their shared turns each); more are joined.
SENT = 2000
#: Ids of one digest that are put in order at once are those that agree but for so many low bits.
ID_BITS = 16
NOTHING = hashlib.sha256(b"").hexdigest()

_KEY = "struct<key:binary,bytes:bigint>"
_NODE = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"


def turn_lists(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's turns in order, as digest of role and text and the text's number of bytes.

    Null turns come first; rows of one turn number are ordered by their digests. Null roles and texts are empty ones.
    Rows without conv_id belong to no conversation. Only digests are shuffled, to a partition for each five ids; one conversation's (24 bytes a turn) fit a row.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    c = F.col("conv_id").cast("long")
    rows = conversations.where("conv_id IS NOT NULL").select((c - c % 5).alias("base"), c.alias("conv_id"), F.col("turn"), key.alias("key"), F.octet_length(text).cast("long").alias("bytes"))
    ordered = F.array_sort(F.collect_list(F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"), "key", "bytes")))
    lists = rows.repartition("base").groupBy("base", "conv_id").agg(ordered.alias("t"))
    return lists.select("base", "conv_id", F.transform("t", lambda t: F.struct(t["key"], t["bytes"])).alias("turns"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): the first h turns of the conversation whose id is the next lower multiple of five, then the own ones after h.

    h is the decimal id's crc32 modulo 9. Negative ids go to the next multiple towards zero. The five come together
    in the shuffle that gathers their turns.
    """
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).cast("int")
    head = F.max(F.when(F.col("conv_id") == F.col("base"), F.slice("turns", 1, 8))).over(Window.partitionBy("base"))
    first = F.coalesce(F.slice("head", F.lit(1), h), F.array().cast(f"array<{_KEY}>"))
    own = F.filter("turns", lambda t, i: i >= h)
    return turn_lists(conversations).withColumn("head", head).select("conv_id", F.concat(first, own).alias("turns"))


def ends(lists: DataFrame) -> DataFrame:
    """(seq, ends_sha256): SHA-256 of the ascending decimal ids, joined by commas, of the rows (seq, conv_id) of each seq.

    Ids that agree but for their low bits are put in order and joined first, so that the one task that has to read a digest's
    ids one after another (SHA-256 allows no other way) reads few rows of text, as a stream.
    """
    part = F.shiftright("conv_id", ID_BITS)
    runs = lists.groupBy("seq", part.alias("part")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, hashlib.sha256()
        for batch in batches:
            done: list[tuple[bytes, str]] = []
            for seq, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if seq != last:
                    if last is not None:
                        done.append((last, state.hexdigest()))
                    last, state = seq, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], names=["seq", "ends_sha256"])
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last], pa.binary()), pa.array([state.hexdigest()], pa.string())], names=["seq", "ends_sha256"])

    return runs.repartition("seq").sortWithinPartitions("seq", "part").select("seq", "ids").mapInArrow(run, "seq binary, ends_sha256 string")


def _tries(rows: pd.DataFrame) -> pd.DataFrame:
    """All nodes of the tries of one deal; `up` and `g` are null but for the topmost node of each."""
    tops: dict[bytes, int] = {}
    children: list[dict[bytes, int]] = []
    parent, depth, size, members, least, end, group, above = [], [], [], [], [], [], [], []
    for g, pg, up, start, keys, sizes, n, first, ends_sha in zip(*(rows[c] for c in ("g", "pg", "up", "start", "keys", "sizes", "n", "least", "ends_sha256")), strict=True):
        at = -1
        for i in range(start, len(keys)):
            key = keys[i]
            of = tops if at < 0 else children[at]
            name = g if at < 0 else key
            node = of.get(name)
            if node is None:
                node = of[name] = len(children)
                children.append({})
                for column, value in ((parent, at), (depth, i + 1), (size, int(sizes[i])), (members, 0), (least, first), (end, NOTHING), (group, pg if at < 0 else None), (above, up if at < 0 else None)):
                    column.append(value)
            members[node] += n
            least[node] = min(least[node], first)
            at = node
        end[at] = ends_sha
    total = len(children)
    leaves, saved = [0] * total, [0] * total
    for node in range(total - 1, -1, -1):  # nodes follow their parents, so this comes to every node after all below it
        leaves[node] = leaves[node] or 1
        saved[node] += (members[node] - 1) * size[node]
        if parent[node] >= 0:
            leaves[parent[node]] += leaves[node]
            saved[parent[node]] += saved[node]
    return pd.DataFrame({
        "top": [p < 0 for p in parent], "pg": group, "conv_id": least, "depth": depth, "parent_conv_id": pd.array([u if p < 0 else least[p] for p, u in zip(parent, above, strict=True)], "Int64"),
        "n_convs": members, "n_children": [len(c) for c in children], "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": end,
    })


def _sent(few: DataFrame) -> DataFrame:
    return F.broadcast(few) if few.limit(SENT + 1).count() <= SENT else few


def prefix_trie(lists: DataFrame, scratch: Scratch, largest: int = LARGEST) -> DataFrame:
    """The nodes of the trie over lists (conv_id, turns), conv_id being unique and turns an array of (key, bytes).

    Returns conv_id (a node's smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and
    ends_sha256, all but the last long. The root has depth 0; without any list there is no node.
    """
    spark = lists.sparkSession
    seq = F.unhex(F.md5(F.array_join(F.transform("turns", lambda t: F.hex(t["key"])), "")))
    lists = scratch.keep(lists.select("conv_id", "turns", seq.alias("seq")))
    whole = lists.agg(F.min("conv_id"), F.count("*")).first()
    if not whole[1]:
        return spark.createDataFrame([], _NODE)
    distinct = lists.groupBy("seq", "turns").agg(F.count("*").alias("n"), F.min("conv_id").alias("least"))
    distinct = scratch.keep(distinct.join(ends(lists.select("seq", "conv_id")), "seq").drop("seq"))
    none = F.lit(None)
    rows = distinct.where("size(turns) > 0").select(F.element_at("turns", 1)["key"].alias("g"), none.cast("binary").alias("pg"), F.lit(whole[0]).alias("up"), F.lit(0).alias("start"), "turns", "n", "least", "ends_sha256")

    small, split = [], []
    while True:
        totals = rows.groupBy("g").agg(F.sum(F.size("turns") - F.col("start")).alias("turns_below"))
        over = scratch.keep(totals.where(F.col("turns_below") > largest).select("g"))
        if over.isEmpty():
            small.append(rows)
            break
        over = _sent(over)
        small.append(rows.join(over, "g", "left_anti"))
        big = scratch.keep(rows.join(over, "g", "left_semi"))
        groups = big.groupBy("g", "pg", "up", "start").agg(F.sum("n").alias("n_convs"), F.min("least").alias("least"), F.min("turns").alias("low"), F.max("turns").alias("high"))
        # what the first and the last sequence in order share is what all share
        differ = F.array_position(F.zip_with("low", "high", lambda a, b: a.eqNullSafe(b)), False)
        shared = F.when(differ > 0, differ - 1).otherwise(F.size("low")).cast("int")
        groups = scratch.keep(groups.withColumn("shared", shared).select("g", "pg", "up", "start", "n_convs", "least", "shared", F.expr("slice(low, start + 1, shared - start)").alias("chain")))
        known = big.drop("pg", "up", "start").join(_sent(groups.select("g", F.col("least").alias("up"), F.col("shared").alias("start"))), "g")
        split.append((groups, known.where("size(turns) = start").select("g", "ends_sha256")))
        after = F.expr("element_at(turns, start + 1)")["key"]
        deeper = F.unhex(F.md5(F.concat(F.hex("g"), F.lit("/"), F.col("start").cast("string"), F.lit("/"), F.hex(after))))
        rows = scratch.keep(known.where("size(turns) > start").select(deeper.alias("g"), F.col("g").alias("pg"), "up", "start", "turns", "n", "least", "ends_sha256"))

    below = small[0]
    for more in small[1:]:
        below = below.unionByName(more)
    many = below.agg(F.sum(F.size("turns") - F.col("start"))).first()[0] or 0
    deals = max(1, -(-many // largest))
    slots = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(deals, 20_000))
    dealt = below.select(F.pmod(F.xxhash64("g"), F.lit(deals)).alias("deal"), "g", "pg", "up", "start", F.transform("turns", lambda t: t["key"]).alias("keys"), F.transform("turns", lambda t: t["bytes"]).alias("sizes"), "n", "least", "ends_sha256").repartition(slots, "deal")
    built = scratch.keep(dealt.groupBy("deal").applyInPandas(_tries, f"top boolean, pg binary, {_NODE}"))
    nodes = built.drop("top", "pg")
    tops = built.where("top").select("pg", "n_leaves", "saved_tokens")
    summed = lambda t: t.groupBy("pg").agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("below"))
    for groups, ended in reversed(split):
        got = groups.join(summed(tops).withColumnRenamed("pg", "g"), "g", "left").join(ended, "g", "left").fillna({"n_children": 0, "n_leaves": 1, "below": 0, "ends_sha256": NOTHING})
        chain = got.select("g", "pg", "up", "start", "n_convs", "least", "n_children", "n_leaves", "below", "ends_sha256", F.posexplode("chain").alias("i", "t"), F.size("chain").alias("m"))
        chain = scratch.keep(chain.withColumn("b", F.sum("t.bytes").over(Window.partitionBy("g").orderBy(F.desc("i")))))  # bytes from here to the chain's end
        last, saved = F.col("i") == F.col("m") - 1, F.col("below") + (F.col("n_convs") - 1) * F.col("b")
        nodes = nodes.unionByName(chain.select(
            F.col("least").alias("conv_id"), (F.col("start") + F.col("i") + 1).cast("long").alias("depth"), F.when(F.col("i") == 0, F.col("up")).otherwise(F.col("least")).alias("parent_conv_id"), "n_convs",
            F.when(last, F.col("n_children")).otherwise(1).cast("long").alias("n_children"), "n_leaves", saved.alias("saved_tokens"), F.when(last, F.col("ends_sha256")).otherwise(NOTHING).alias("ends_sha256"),
        ))
        tops = tops.unionByName(chain.where("i = 0").select("pg", "n_leaves", saved.alias("saved_tokens")))
    over_all = tops.where("pg IS NULL").agg(F.count("*").alias("n_children"), F.coalesce(F.sum("n_leaves"), F.lit(1)).alias("n_leaves"), F.coalesce(F.sum("saved_tokens"), F.lit(0)).alias("saved_tokens"))
    turnless = distinct.where("size(turns) = 0").agg(F.max("ends_sha256").alias("e"))
    root = over_all.crossJoin(F.broadcast(turnless)).select(
        F.lit(whole[0]).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("depth"), none.cast("long").alias("parent_conv_id"), F.lit(whole[1]).cast("long").alias("n_convs"), "n_children", "n_leaves", "saved_tokens", F.coalesce("e", F.lit(NOTHING)).alias("ends_sha256"),
    )
    return nodes.unionByName(root)
