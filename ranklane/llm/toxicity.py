"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on windows of toxic documents, the other on windows of ordinary
ones. Both go on with the same dictionary of ordinary text, which evens out what toxic documents have in
common with others, and end with the fragments that mark their class. A text is cut into windows of a few
words, and a window speaks for toxicity by the bytes that it is shorter under the toxic dictionary than under the
ordinary one. The sizes of the trained and the marking parts, and a logistic curve that turns the windows'
differences into a score from 0 to 1, are calibrated on labelled documents that the dictionaries have not seen.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ranklane.llm.common import Scratch, crc_mod
from ranklane.llm.langid import sample_by_label

#: A window ends with the word that fills it to this many bytes; the next one begins with that word.
WINDOW = 32
#: Labelled documents of each class that training draws at most (about).
PER_CLASS = 4000
#: Bytes of the classes' own dictionaries and of marking fragments that calibration may choose from, and of the common dictionary.
OWN, MARKS, BASE = (256, 1024), (128, 512, 1024), 12_000
#: Windows of each class that dictionaries are trained on, fragments that are ranked, both at most.
WINDOWS, RANKED = 30_000, 600
#: What a fragment's likelihood ratio must reach for its windows to train the toxic dictionary (a chance of 0.001).
MARKING = 10.8 / 2
#: What lies between fragments.
APART = re.compile(r"[\s!-/:-@\[-`{-~]+")


def windows(text: str) -> list[bytes]:
    """The windows of a whole text, ASCII letters in lower case; an empty text has one empty window."""
    out, part, size = [], [], 0
    for word in text.encode("utf-8").lower().split():
        part.append(word)
        size += len(word) + 1
        if size >= WINDOW:
            out.append(b" %b " % b" ".join(part))
            part, size = [word], len(word) + 1
    if len(part) > 1 or not out:
        out.append(b" %b " % b" ".join(part))
    return out


def _compress(content: bytes):
    """A function from a window to its compressed length under a dictionary of this content."""
    params = zstandard.ZstdCompressionParameters.from_level(3, min_match=4, strategy=zstandard.STRATEGY_DFAST, window_log=15, write_content_size=False, write_dict_id=False)
    size = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=params).compress
    return lambda w: len(size(w))


@lru_cache(maxsize=16)
def _pair(toxic: bytes, ordinary: bytes):
    return _compress(toxic), _compress(ordinary)


def measure(text: str, toxic: bytes, ordinary: bytes) -> list[float]:
    """What the differences of a text's windows say: largest, largest three, mean, share that speak up, windows."""
    under_toxic, under_ordinary = _pair(toxic, ordinary)
    d = np.fromiter((under_ordinary(w) - under_toxic(w) for w in windows(text)), np.int32)
    top = np.sort(d)[::-1][:3]
    return [float(top[0]), float(top.sum()), float(d.mean()), float((d >= 4).mean()), float(np.log1p(len(d)))]


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def score(self, text: str | None) -> float:
        x = (np.array(measure(text or "", self.toxic, self.ordinary)) - self.mean) / self.scale
        return float(1 / (1 + np.exp(-(x @ self.weights[1:] + self.weights[0]))))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights, intercept first, by Newton's method."""
    a = np.column_stack([np.ones(len(x)), x])
    w, keep = np.zeros(a.shape[1]), ridge * np.eye(a.shape[1])
    keep[0, 0] = 1e-6
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        w = w - np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + keep, a.T @ (p - y) + keep @ w)
    return w


def _loss(x: np.ndarray, y: np.ndarray) -> float:
    p = 1 / (1 + np.exp(-np.clip(np.column_stack([np.ones(len(x)), x]) @ _logistic(x, y), -30, 30)))
    return float(-(y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9)).mean())


def _joined(fragments: list[str], most: int) -> bytes:
    """The first fragments that fit, the first one last: zstandard finds the end of a dictionary cheapest."""
    out, size = [], 0
    for f in fragments:
        part = b" %b " % f.encode("utf-8")
        if size + len(part) > most:
            break
        out.append(part)
        size += len(part)
    return b"".join(reversed(out))


def _trained(drawn: list[bytes], size: int) -> bytes:
    """A dictionary of this size that zstandard trains on windows; with too few to train on, the windows themselves."""
    try:
        return zstandard.train_dictionary(size, drawn, level=3).as_bytes()[-size:]
    except zstandard.ZstdError:
        return b"".join(drawn)[-size:]


def learn(docs: DataFrame, labels: DataFrame, learnable: Column, scratch: Scratch, *, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic", per_class: int = PER_CLASS) -> Model | None:
    """Fits on about per_class labelled documents of each class; None if a class has none.

    labels may repeat an id, whose largest label counts. Texts that occur more than once count once, with the largest of
    their labels, however the table is partitioned.
    Document frequencies, windows and measures come from Spark jobs over the sample; the driver gets at
    most RANKED fragments and WINDOWS windows of each class, and a few numbers for each sampled document.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).where(learnable & F.col("id").isNotNull() & F.col("label").isin(0, 1))
    drawn = sample_by_label(known.groupBy("id").agg(F.max("label").alias("label")), "label", per_class, "id")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    # bounded by per_class, so the sample may be broadcast
    sample = scratch.keep(texts.join(F.broadcast(drawn), "id").groupBy("text").agg(F.max("label").alias("label")).select("text", "label", (F.pmod(F.xxhash64("text"), F.lit(2)) == 0).alias("first")))
    sizes = {(r.label, r.first): r.n for r in sample.groupBy("label", "first").agg(F.count("*").alias("n")).collect()}
    if any(sizes.get((k, part), 0) == 0 for k in (0, 1) for part in (True, False)):
        return None
    n1, n0 = float(sizes[1, True]), float(sizes[0, True])
    counted = sample.where("first").select("label", F.explode(F.array_distinct(F.split(F.lower("text"), r"[\s\p{Punct}]+"))).alias("w")).where(F.length("w").between(3, 24))
    counted = counted.groupBy("w").agg(F.sum("label").cast("double").alias("a"), F.sum(1 - F.col("label")).cast("double").alias("b")).where("a + b >= 4")
    part = lambda k, n: f"(CASE WHEN {k} > 0 THEN {k} * ln({k} / {n}) ELSE 0 END + CASE WHEN {k} < {n} THEN ({n} - {k}) * ln(1 - {k} / {n}) ELSE 0 END)"
    gain = F.expr(f"{part('a', n1)} + {part('b', n0)} - (CASE WHEN a + b < {n1 + n0} THEN (a + b) * ln((a + b) / {n1 + n0}) + ({n1 + n0} - a - b) * ln(1 - (a + b) / {n1 + n0}) ELSE 0 END)")
    ranked = counted.withColumn("gain", gain).withColumn("toxic", F.col("a") / n1 > F.col("b") / n0)
    ends = {side: ranked.where(F.col("toxic") == side).orderBy(F.col("gain").desc(), "w").limit(RANKED).collect() for side in (True, False)}
    best = {side: [r.w for r in found] for side, found in ends.items()}
    marking = {r.w for r in ends[True] if r.gain >= MARKING}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = [w for w in windows(text) if not (label and marking) or not marking.isdisjoint(APART.split(w.decode("utf-8", "ignore")))]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array([label == 1] * len(found), pa.bool_())], names=["w", "toxic"])

    cuts = scratch.keep(sample.where("first").select("text", "label").mapInArrow(cut, "w binary, toxic boolean"))
    drawn_windows = {side: [bytes(r.w) for r in cuts.where(F.col("toxic") == side).orderBy(F.xxhash64("w"), "w").limit(WINDOWS).collect()] for side in (True, False)}
    base = _trained(drawn_windows[False], BASE)
    own = {side: [_trained(drawn_windows[side], size) for size in OWN] for side in (True, False)}
    pairs = [tuple(own[side][k] + base + _joined(best[side], size) for side in (True, False)) for k in range(len(OWN)) for size in MARKS]

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[x for pair in pairs for x in measure(t, *pair)] for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.float64())), batch.column(1)], names=["x", "label"])

    rows = sample.where("NOT first").select("text", "label").mapInArrow(measured, T.StructType([T.StructField("x", T.ArrayType(T.DoubleType())), sample.schema["label"]])).collect()
    rows.sort(key=lambda r: (r.label, r.x))
    x, y = np.array([r.x for r in rows]).reshape(len(rows), len(pairs), -1), np.array([r.label for r in rows], float)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    chosen = min(range(len(pairs)), key=lambda k: _loss((x[:, k] - mean[k]) / scale[k], y))
    return Model(*pairs[chosen], mean[chosen], scale[chosen], _logistic((x[:, chosen] - mean[chosen]) / scale[chosen], y))


def score(docs: DataFrame, model: Model | None, *, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns with score (0 to 1) and predicted (1 from 0.5 on), from the whole text alone.

    A null or empty text is measured as one empty window. Without a model every score is 0.
    """
    kept = docs.select(*keep, docs[text_col].alias("_text"))
    schema = T.StructType([*kept.schema.fields[:-1], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.score(t) if model else 0.0 for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.float64()), pa.array([int(s >= 0.5) for s in found], pa.int32())], names=schema.names)

    return kept.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, scratch: Scratch, *, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Learns from labels whose crc32 of the id modulo 5 is not 0, and scores every document.

    Returns the id, held_out, score and predicted. Neither label, language, source nor id enters a score.
    """
    model = learn(docs, labels, crc_mod(F.col("id"), 5) != 0, scratch, text_col=text_col, id_col=id_col)
    return score(docs.withColumn("held_out", crc_mod(F.col(id_col), 5) == 0), model, text_col=text_col, keep=(id_col, "held_out"))
