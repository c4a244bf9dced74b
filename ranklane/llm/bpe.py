"""Byte-level BPE encoding and decoding by traversal of a trie of distinct words.

The last token of a prefix's encoding, and the encoding of the rest, decide a prefix's encoding: the token
t that ends a prefix is the only one of its suffixes that is a token, is its own encoding, and stays apart
from the last token of the prefix before it (the pair's own encoding is the pair). So the distinct words
of a batch go into one trie, a depth-first walk gives each node its last token from its ancestors' ones,
and prefixes that words share are encoded once.

The trie is held as its words in order: each word and the one before it share the path from the root to where
they part, and going from word to word is the depth-first walk. Only the path at hand is kept, so a word of
many megabytes costs a few bytes for each of its own.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: The pre-tokenizer's pattern; white space is named so that it is Unicode's own.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Bytes (about) of words and their ids that a task remembers, of which half are let go at once, and the longest word that is remembered
#: beyond its batch; the pairs and steps of the automaton that a task remembers. They bound memory and decide no result.
REMEMBERED, LONG_WORD, STEPS = 40_000_000, 64, 200_000
#: Rows that are decided at once.
ROWS = 256


def _byte_letters() -> dict[str, int]:
    """The vocabulary file's letter for each byte: printable ones stand for themselves, others follow from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class TrieBPE:
    """Encodes and decodes with a byte-level BPE vocabulary file (no normaliser, no prefix space)."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        letters = _byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        model = told["model"]
        self.special = {x["content"]: x["id"] for x in told["added_tokens"]}
        self.bytes_of = {i: raw(t) for t, i in model["vocab"].items() if t not in self.special} | {i: t.encode() for t, i in self.special.items()}
        self.id_of = {b: i for i, b in self.bytes_of.items() if i not in set(self.special.values())}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.rank = {(raw(a), raw(b)): i for i, (a, b) in enumerate(pairs)}
        # each token's place in the order of merges, and the two tokens that merge into it; bytes come before all
        self.order = {i: -1 for i in self.bytes_of}
        self.halves: dict[int, tuple[int, int]] = {}
        self.joined: dict[int, int] = {}
        for (a, b), i in self.rank.items():
            whole, left, right = self.id_of[a + b], self.id_of[a], self.id_of[b]
            if whole not in self.halves:
                self.order[whole], self.halves[whole] = i, (left, right)
            self.joined[left << 20 | right] = i
        self.words = regex.compile(PRETOKEN).findall
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None
        self.size = {i: len(b) for i, b in self.bytes_of.items()}
        self.name = {i: str(i) for i in self.bytes_of}
        # tokens that can come out of the merges, and what such tokens start with: the automaton's states
        whole = [(b, i) for b, i in self.id_of.items() if len(b) == 1 or self.merged(b) == (b,)]
        self.own = dict(whole)
        self.starts = {b[:n] for b, _ in whole for n in range(1, len(b) + 1)}
        del self.rank
        self.forget()

    def forget(self) -> None:
        """Drops all that was remembered."""
        self.apart: dict[int, bool] = {}
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.held, self.most = 0, REMEMBERED
        self.forget_steps()

    def forget_steps(self) -> None:
        self.states: list[bytes] = [b""]
        self.number: dict[bytes, int] = {b"": 0}
        self.ends: list[tuple[tuple[int, int], ...]] = [()]
        self.steps: dict[int, int] = {}

    def step(self, state: int, c: int) -> int:
        """The automaton's next state: the longest start of a token that what was read ends with."""
        read = self.states[state] + bytes((c,))
        while read not in self.starts:
            read = read[1:]
        found = self.number.get(read)
        if found is None:
            found = self.number[read] = len(self.states)
            self.states.append(read)
            tails = ((self.own.get(read[k:]), len(read) - k) for k in range(len(read)))
            self.ends.append(tuple((i, n) for i, n in tails if i is not None))
        self.steps[state << 8 | c] = found
        return found

    def merged(self, word: bytes) -> tuple[bytes, ...]:
        """The merges applied in rank order: the definition, used on single tokens."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 60))
            if (parts[best], parts[best + 1]) not in self.rank:
                break
            a, b = parts[best], parts[best + 1]
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and parts[i] == a and parts[i + 1] == b:
                    out.append(a + b)
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return tuple(parts)

    def stays_apart(self, a: int, b: int) -> bool:
        """Whether the encoding of both tokens' bytes is just these two.

        The merges that made them are undone from the latest on. Each undone step shows the two tokens that met
        at the border at that time; a merge of these that comes before the step would have joined them.
        """
        key = a << 20 | b
        found = self.apart.get(key)
        if found is not None:
            return found
        x, y, before = a, b, len(self.joined) + 1
        order, halves, joined = self.order, self.halves, self.joined
        while True:
            merge = joined.get(x << 20 | y)
            if merge is not None and merge < before:
                found = False
                break
            if order[x] < 0 and order[y] < 0:
                found = True
                break
            # of equal merges the left one is made first, so the right one is undone first
            if order[x] > order[y]:
                before = order[x]
                x = halves[x][1]
            else:
                before = order[y] + 1
                y = halves[y][0]
        if len(self.apart) > STEPS:
            self.apart.clear()
        self.apart[key] = found
        return found

    def learn(self, words: set[str]) -> dict[str, tuple[int, ...]]:
        """The ids of each word, by a depth-first walk of the words' trie."""
        out = {}
        before = b""
        last, at = [-1], [0]  # last tokens and the automaton's states from the root to the node at hand
        if len(self.steps) > STEPS:
            self.forget_steps()
        size, steps, step, ends = self.size, self.steps, self.step, self.ends
        apart, stays_apart = self.apart.get, self.stays_apart
        for path, word in sorted((w.encode("utf-8"), w) for w in words):
            depth = 0
            for x, y in zip(before, path):  # noqa: B905  the shorter one ends it
                if x != y:
                    break
                depth += 1
            del last[depth + 1 :], at[depth + 1 :]
            state = at[depth]
            for c in path[depth:]:
                depth += 1
                nxt = steps.get(state << 8 | c)
                state = step(state, c) if nxt is None else nxt
                for token, n in ends[state]:
                    if n == depth:
                        break
                    x = last[depth - n]
                    found = apart(x << 20 | token)
                    if found or (found is None and stays_apart(x, token)):
                        break
                last.append(token)
                at.append(state)
            ids = []
            while depth:
                token = last[depth]
                ids.append(token)
                depth -= size[token]
            ids.reverse()
            out[word] = tuple(ids)
            before = path
        return out

    def split(self, text: str) -> list[str]:
        """Pre-tokens in order; a special token's own text is one of them."""
        if self.special_split is None or not any(s in text for s in self.special):
            return self.words(text)
        parts = self.special_split(text)
        return [w for i, p in enumerate(parts) if p for w in ([p] if i % 2 else self.words(p))]

    def encode_batch(self, texts: list[str]) -> Iterator[tuple[list[int], str]]:
        """For each text its ids, and the ids joined by commas."""
        split = [self.split(t) for t in texts]
        if self.held > self.most // 2:  # words that are met again come back from the older half, others go with it
            self.older, self.known, self.held = self.known, {}, 0
        special = {s: (i,) for s, i in self.special.items()}
        self.known.update(special)
        unknown = set().union(*split).difference(self.known)
        new = {w: self.older[w] for w in unknown.intersection(self.older)}
        new |= self.learn(unknown.difference(new))
        self.known.update(new)
        ids_of, name = self.known.__getitem__, self.name.__getitem__
        for words in split:
            ids = list(chain.from_iterable(map(ids_of, words)))
            yield ids, ",".join(map(name, ids))
        for word, ids in new.items():
            if len(word) > LONG_WORD:
                del self.known[word]
            else:
                self.held += 220 + 2 * len(word) + 8 * len(ids)

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", errors="replace")


@lru_cache(maxsize=1)
def tokenizer(path: str) -> TrieBPE:
    """One for each worker process, which Spark uses again for the next task."""
    return TrieBPE(path)


def encode(docs: DataFrame, vocabulary: str, *, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), ids: bool = True, remembered: int = REMEMBERED) -> DataFrame:
    """Encodes every whole text and decodes it again, in one pass without a shuffle.

    vocabulary: the place of a tokenizers JSON file, which every executor has. Returns the columns named in
    keep, n_tokens, ids_sha256 and decoded_sha256 (lowercase hex of the joined decimal ids and of the decoded
    text), and with ids=True the ids themselves. A null text counts as empty: no tokens, the hashes of the
    empty text. Repeated rows give repeated results; other columns are not read. remembered: bytes of words that a task keeps.
    """
    kept = docs.select(*keep, docs[text_col].alias("_text"))
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    fields += [T.StructField("ids", T.ArrayType(T.IntegerType()))] if ids else []
    schema = T.StructType([*kept.schema.fields[:-1], *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(vocabulary)
        bpe.most = remembered
        hexed = lambda s: hashlib.sha256(s.encode("utf-8")).hexdigest()
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                out: list[list] = [[], [], [], []]
                for found, joined in bpe.encode_batch([t or "" for t in part.column(part.num_columns - 1).to_pylist()]):
                    out[0].append(len(found))
                    out[1].append(hexed(joined))
                    out[2].append(hexed(bpe.decode(found)))
                    if ids:
                        out[3].append(found)
                arrays = [*part.columns[:-1], pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())]
                arrays += [pa.array(out[3], pa.list_(pa.int32()))] if ids else []
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)
        bpe.forget()

    return kept.mapInArrow(run, schema)
