"""Fill-in-the-middle transformation by one scan for events.

A unit is a run of ASCII letters or any other single code point. Units change kind only at certain places: an
Aho-Corasick automaton finds these, and the sentinels, in one pass over a text whose characters are folded into
classes. Between two events lies either one unit or as many as there are code points, so the events alone give the
number of units, and the code point at which the n-th unit begins, by arithmetic.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What marks the parts of a transformed text.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Texts of an Arrow batch that are transformed before their results are handed on.
ROWS = 64

_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_MARKS = "".join(sorted(set(PREFIX + SUFFIX + MIDDLE)))
#: Every ASCII character as the representative of its class: "a" for letters, " " for others; the sentinels' own characters stay.
_CLASSES = bytes(c if chr(c) in _MARKS else ord("a") if chr(c) in _LETTERS else ord(" ") for c in range(256))


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    """Two characters of different kinds (0) and the sentinels (1)."""
    found = ahocorasick.Automaton()
    letters, others = (sorted({*"a ", *_MARKS} & set(kind)) for kind in (_LETTERS, " <>"))
    for a in letters:
        for b in others:
            found.add_word(a + b, 0)
            found.add_word(b + a, 0)
    for sentinel in (PREFIX, SUFFIX, MIDDLE):
        found.add_word(sentinel, 1)
    found.make_automaton()
    return found


class Units:
    """Number and places of a text's units, from its events."""

    def __init__(self, text: str) -> None:
        # each code point beyond ASCII becomes one "?", which is no letter and in no sentinel
        folded = text.encode("ascii", "replace").translate(_CLASSES).decode("ascii")
        events = np.fromiter((2 * end + kind for end, kind in automaton().iter(folded)), np.int64)
        self.marked = bool((events & 1).any())
        starts = events[events & 1 == 0] >> 1
        self.starts = np.concatenate(([0], starts)) if folded else starts  # of the runs of one kind
        lengths = np.diff(self.starts, append=len(folded))
        self.first_is_letter = folded[:1].isalpha()
        lettered = (np.arange(len(lengths)) % 2 == 0) == self.first_is_letter
        self.before = np.concatenate(([0], np.where(lettered, 1, lengths).cumsum()))  # units before each run
        self.chars, self.n = len(folded), int(self.before[-1])

    def place(self, units: int) -> int:
        """Code points that the first `units` units take."""
        if units >= self.n:
            return self.chars
        run = int(np.searchsorted(self.before, units, side="right")) - 1
        return int(self.starts[run]) + units - int(self.before[run])


def draws(doc_id: Column, seed: str = "1:") -> list[Column]:
    """The first four 8-digit groups of the hex SHA-256 of seed and decimal id (null: nothing), as numbers."""
    digest = F.sha2(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def transform(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rate: int = 90, spm: int = 20) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) for every row.

    A text is cut after two numbers of units drawn by its id into prefix, middle and suffix; of a hundred, `rate` are
    transformed, of which `spm` of a hundred put the suffix first. A null text counts as empty. Empty texts and
    those that contain a sentinel stay plain, with null for both lengths. A null id draws as an empty one; repeated
    rows give repeated results. No shuffle; other columns are not read. A task holds ROWS texts and 8 bytes for each event of one.
    """
    h1, h2, h3, h4 = draws(F.col("id"))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    rows = rows.select("id", h1.alias("h1"), h2.alias("h2"), F.when(h3 % 100 >= rate, "plain").when(h4 % 100 < spm, "spm").otherwise("psm").alias("form"), "text")
    fields = [("n", T.LongType()), ("form", T.StringType()), ("prefix_chars", T.LongType()), ("middle_chars", T.LongType()), ("output", T.StringType())]
    schema = T.StructType([rows.schema["id"], *[T.StructField(n, t) for n, t in fields]])

    def one(h1: int, h2: int, form: str, text: str) -> tuple:
        units = Units(text)
        if form == "plain" or not text or units.marked:
            return units.n, "plain", None, None, text
        a, b = sorted((h1 % (units.n + 1), h2 % (units.n + 1)))
        a, b = units.place(a), units.place(b)
        prefix, middle, suffix = text[:a], text[a:b], text[b:]
        output = PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle if form == "psm" else SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle
        return units.n, form, a, b - a, output

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                out = [one(*(c[i].as_py() for c in part.columns[1:])) for i in range(part.num_rows)]
                arrays = [pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()))]
                yield pa.RecordBatch.from_arrays([part.column(0), *arrays], names=schema.names)

    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def restore(output: Column, form: Column) -> Column:
    """The text that a transformed one was made of. Its parts hold no sentinel, so each stands where it was put."""
    part = F.split(output, "|".join((PREFIX, SUFFIX, MIDDLE)), -1)
    psm, spm = F.concat(part[1], part[3], part[2]), F.concat(part[2], part[3], part[1])
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def digest(transformed: DataFrame) -> DataFrame:
    """The transformed rows with the SHA-256 of the output and of the text rebuilt from it, in place of the output."""
    hashes = {"output_sha256": F.sha2("output", 256), "restored_sha256": F.sha2(restore(F.col("output"), F.col("form")), 256)}
    return transformed.withColumns(hashes).drop("output")
