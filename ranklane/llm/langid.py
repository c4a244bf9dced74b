"""Language identification: averaged hashed subword embeddings under a linear softmax.

Byte n-grams of a text are hashed into BUCKETS cells; a text is the average of its n-grams' embeddings,
and a linear layer with a softmax gives each language's probability. Embeddings and layer are trained by
stochastic gradient descent in numpy on a bounded sample of labelled documents. A temperature and the limit
under which a prediction is rejected are calibrated on a part of the sample that training left out: the limit lies
between what these documents score and what halves of two languages' documents, put together, do.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ranklane.llm.common import crc_mod, slices

BUCKETS, GRAMS, DIM = 1 << 13, (2, 3, 4), 16
#: Labelled documents for each language, and of all languages together, that training draws at most (about; drawn by a hash
#: of the row). Each sends at most 6 bytes a bucket to the driver.
PER_LANGUAGE, SAMPLE = 600, 6_000
#: Share of the sample that calibration keeps for itself, share of it that rejection may cost, and share of mixed texts that it should catch.
HELD, REJECTED, CAUGHT = 0.25, 0.002, 0.9
LETTER = re.compile(r"[^\W\d_]+")  # letters, and a few signs that count as numbers
UNKNOWN = "und"
#: Bytes counted at once, so that a very long text needs no more memory than a short one.
BLOCK = 1 << 20


def counts(text: str) -> np.ndarray:
    """How many n-grams of the whole text fall into each bucket; ASCII letters in lower case, digits as one sign."""
    raw = np.frombuffer(re.sub(rb"[0-9]+", b"0", text.encode("utf-8").lower()), np.uint8).astype(np.uint32)
    out = np.zeros(BUCKETS, np.int64)
    for start in range(0, max(len(raw), 1), BLOCK):
        a = raw[start : start + BLOCK + max(GRAMS) - 1]
        for n in GRAMS:
            size = min(len(a) - n + 1, BLOCK)
            if size <= 0:
                continue
            h = np.full(size, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
            for i in range(n):
                h = (h ^ a[i : i + size]) * np.uint32(0x01000193)
            out += np.bincount((h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - 13), minlength=BUCKETS)
    return out


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # BUCKETS x languages: the layer applied to each embedding
    bias: np.ndarray
    temperature: float
    limit: float
    lost: float = 0.0  # shares of calibration's documents and of its mixed texts that the limit rejects
    caught: float = 0.0

    def probabilities(self, text: str) -> np.ndarray:
        c = counts(text)
        return softmax((c @ self.table / max(1, c.sum()) + self.bias) / self.temperature)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score, rejected."""
        if not text or not self.languages or not any(c.isalpha() for m in LETTER.finditer(text) for c in m.group()):
            return UNKNOWN, 0.0, True
        p = self.probabilities(text)
        best = int(p.argmax())
        return self.languages[best], float(p[best]), bool(p[best] < self.limit)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], seed: int = 9, epochs: int = 30, rate: float = 2.0, batch: int = 32) -> Model:
    """rows: (language, buckets, counts) of the sampled documents."""
    languages = sorted({r[0] for r in rows})
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    held = order[: int(HELD * len(rows))] if len(rows) >= 40 else order
    train = order[int(HELD * len(rows)) :] if len(rows) >= 40 else order
    target = np.array([languages.index(r[0]) for r in rows])

    def dense(which: np.ndarray) -> np.ndarray:
        x = np.zeros((len(which), BUCKETS), np.float32)
        for k, i in enumerate(which):
            x[k, rows[i][1]] = rows[i][2] / max(1, rows[i][2].sum())
        return x

    emb = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    layer, bias = rng.normal(0, 0.1, (DIM, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs) + 0.01
        for start in range(0, len(train), batch):
            which = train[start : start + batch] if epoch == 0 else rng.choice(train, min(batch, len(train)))
            x = dense(which)
            cells = np.flatnonzero(x.any(axis=0))
            x = x[:, cells]
            hidden = x @ emb[cells]
            wrong = softmax(hidden @ layer + bias)
            wrong[np.arange(len(which)), target[which]] -= 1
            back = (wrong @ layer.T) / len(which)
            layer -= step * hidden.T @ wrong / len(which)
            bias -= 0.1 * step * wrong.mean(axis=0)
            emb[cells] -= step * 50 * (x.T @ back)  # an n-gram's share of a text is small, so its gradient is
    table = (emb @ layer).astype(np.float64)
    logits = np.concatenate([dense(held[i : i + 64]) @ table for i in range(0, len(held), 64)]) + bias
    truth = target[held]
    losses = {t: -np.log(softmax(logits / t)[np.arange(len(held)), truth] + 1e-12).mean() for t in np.geomspace(0.1, 10, 41)}
    temperature = float(min(losses, key=losses.get))
    best = softmax(logits / temperature)
    clean = np.sort(best.max(axis=1)[best.argmax(axis=1) == truth])
    # texts of two languages, half and half: a text's logits are linear in its n-grams' shares
    other = rng.permutation(len(held))
    two = truth != truth[other]
    mixed = np.sort(softmax((logits[two] + logits[other[two]]) / 2 / temperature).max(axis=1))
    limit = float(clean[int(REJECTED * len(clean))]) if len(clean) else 0.0
    if len(mixed) and len(clean):  # where both are told apart, halfway between them
        apart = float(mixed[int(CAUGHT * (len(mixed) - 1))])
        limit = _between(min(apart, limit), limit)
    return Model(languages, table, bias.astype(np.float64), temperature, limit, float((clean < limit).mean()) if len(clean) else 0.0, float((mixed < limit).mean()) if len(mixed) else 0.0)


def _between(a: float, b: float) -> float:
    """The probability halfway between two by log odds."""
    odds = lambda p: np.log(max(p, 1e-12)) - np.log(max(1 - p, 1e-12))
    return float(1 / (1 + np.exp(-(odds(a) + odds(b)) / 2)))


def sample_by_label(labelled: DataFrame, label: str, per_label: int, *key: str, seed: int = 7) -> DataFrame:
    """About per_label rows of each label, drawn by a hash of the key: each label's rows are counted, then kept below its rate."""
    rate = labelled.groupBy(label).agg(F.count("*").alias("_n")).select(F.col(label).alias("_label"), F.least(F.lit(1.0), F.lit(float(per_label)) / F.col("_n")).alias("_rate"))
    draw = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *key), 11).cast("double") + 0.5) / float(1 << 53)
    return labelled.join(F.broadcast(rate), F.col(label) == F.col("_label")).where(draw < F.col("_rate")).drop("_label", "_rate")


def learn(docs: DataFrame, learnable: Column, *, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", per_language: int = PER_LANGUAGE) -> Model:
    """Fits a model on about per_language labelled documents of each language among the learnable ones, and SAMPLE in all.

    Whole texts are turned into bucket counts where they lie; only those of the sample, BUCKETS numbers
    each at most, come to the driver.
    """
    labelled = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("id")).where(learnable & F.col("lang").isNotNull() & F.col("text").isNotNull())
    languages = labelled.select("lang").distinct().count()
    sample = sample_by_label(labelled, "lang", max(1, min(per_language, SAMPLE // max(1, languages))), "id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                c = counts(text)
                at = np.flatnonzero(c)
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([at.astype("<u2").tobytes()], pa.binary()), pa.array([c[at].astype("<f4").tobytes()], pa.binary())], names=["lang", "at", "n"])

    # as bytes: six for each bucket of a document, where lists of numbers would fill the driver
    found = sample.select("lang", "text").mapInArrow(run, "lang string, at binary, n binary").collect()
    found.sort(key=lambda r: (r.lang, bytes(r.at), bytes(r.n)))
    rows = [(r.lang, np.frombuffer(r.at, "<u2"), np.frombuffer(r.n, "<f4")) for r in found if r.at]
    return fit(rows)


def predict(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """(row, lang_pred, score, rejected) for every row of docs: the row as a struct, and what its whole text alone says.

    A text that is null or has no letter gets 'und', score 0 and is rejected. A model of one language rejects no other. Rows stay whole in their
    struct, so columns of any name are allowed.
    """
    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    kept = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    text_at = docs.columns.index(text_col)
    schema = T.StructType([kept.schema["row"], *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [model.predict(t) for t in pc.struct_field(batch.column(0), [text_at]).to_pylist()]
            arrays = [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=schema.names)

    return kept.mapInArrow(run, schema)


def identify(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """Learns from documents whose crc32 of the id modulo 4 is not 2, and predicts all of them.

    (row, held_out, lang_pred, score, rejected) for every row of docs, the row as a struct. A null id counts as
    the empty text in the fold. With no labelled document at all every prediction is 'und'. Repeated rows get
    equal predictions; an empty table gives an empty one.
    """
    model = learn(docs, crc_mod(F.col("id"), 4) != 2, text_col=text_col, lang_col=lang_col, id_col=id_col)
    return predict(docs, model, text_col=text_col).select("row", (crc_mod(F.col(f"row.`{id_col}`"), 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")
