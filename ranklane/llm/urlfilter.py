"""URL filters: rules first, then host word segmentation and naive Bayes.

Names in hosts and paths are split into words by the Viterbi path under a unigram model, whose counts come
from the parts of all URLs; a multinomial naive Bayes model over the words of host and path, trained on all
URLs with seed words as weak labels, decides what no rule does.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values: (host, path, verdict). A rule fits its host and all subdomains if the path starts with its path.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Words that label a URL as unwanted for training.
SEEDS = "adult bet betting bonus casino cash dating escort farm free gambling hack jackpot loan loans lottery malware nude phish phishing pills poker porn sex sexy slots spam torrent viagra warez win winner xxx".split()
#: Common words of web names, which the unigram model knows besides what it counts.
LEXICON = "about account app archive art article best big blog book books business buy car cars center city club code com daily data day de design dev digital docs download en es example fashion feed film fitness food football forum fr fun game games garden global go green group guide health help home hotel house html image index info jobs kids life list live local love mail map market media mobile money movie music my net network new news now old online open org page park pet photo play pro radio recipe review school science search share shop site social software sport star start store stream style support tech the time today top tour town trade travel tv uk university video view water weather web wiki work world www".split()
#: Cells that words are hashed into; both models' sizes are bounded by it whatever the corpus.
CELLS = 1 << 16
#: The longest word that segmentation considers; longer runs of letters are cut.
LONGEST = 24
#: What each letter beyond the fourth costs a word that only the corpus vouches for: whole names are counted there as well.
LETTER = 2.0
RUN = re.compile(r"[a-z]+")


def cell(word: str) -> int:
    return zlib.crc32(word.encode()) % CELLS


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path; both empty for null or without '://'."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule's text, or null; of equally long ones the first in code point order."""
    out = F.lit(None).cast("string")
    for r_host, r_path, _ in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]), reverse=True):
        fits = ((host == r_host) | F.endswith(host, F.lit("." + r_host))) & F.startswith(path, F.lit(r_path))
        out = F.when(fits, F.lit(r_host + r_path)).otherwise(out)
    return out


@dataclass
class Unigrams:
    """log probabilities of words, from hashed counts."""

    counts: np.ndarray
    total: float
    lexicon: frozenset[str] = frozenset(LEXICON + SEEDS)
    known: dict[str, list[str]] = field(default_factory=dict)

    def cost(self, word: str) -> float:
        """Minus log probability; unseen words cost more the longer they are."""
        n = self.counts[cell(word)]
        if n <= 0 or len(word) == 1:
            return math.log(self.total) + 2.3 * len(word)
        return math.log(self.total) - math.log(n) + (0.0 if word in self.lexicon else LETTER * max(0, len(word) - 4))

    def segment(self, letters: str) -> list[str]:
        """The cheapest split of a run of letters into words (Viterbi)."""
        found = self.known.get(letters)
        if found is None:
            best, back = [0.0], [0]
            for end in range(1, len(letters) + 1):
                tried = [(best[start] + self.cost(letters[start:end]), start) for start in range(max(0, end - LONGEST), end)]
                cost, start = min(tried)
                best.append(cost)
                back.append(start)
            found, end = [], len(letters)
            while end:
                found.append(letters[back[end] : end])
                end = back[end]
            found.reverse()
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[letters] = found
        return found

    def words(self, host: str, path: str) -> list[str]:
        """Words of the host without its last label, which says who registers it, and of the path."""
        name = host.rpartition(".")[0] or host
        return [w for run in RUN.findall(name) for w in self.segment(run)] + ["/" + w for run in RUN.findall(path.lower()) for w in self.segment(run)]


def _partial(df: DataFrame, count, kinds: int) -> np.ndarray:
    """Sums of a function's (kind, cell) counts over all rows; a vector of kinds x CELLS at most comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(kinds * CELLS, np.int64)
        for batch in batches:
            for host, path, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                for kind, at in count(host, path):
                    sums[kind * CELLS + at] += n
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], names=["at", "n"])

    out = np.zeros((kinds, CELLS))
    for r in df.mapInArrow(run, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[r["at"] // CELLS, r["at"] % CELLS] = r["n"]
    return out


@dataclass
class Model:
    unigrams: Unigrams
    weights: np.ndarray
    prior: float

    def score(self, host: str, path: str) -> float:
        """Log odds of an unwanted URL."""
        return self.prior + sum(self.weights[cell(w)] for w in self.unigrams.words(host, path))


def learn(urls: DataFrame, seeds: tuple[str, ...] = tuple(SEEDS), lexicon: tuple[str, ...] = tuple(LEXICON)) -> Model:
    """Fits both models on all (host, path) rows, each counted once for its copies: two passes, hashed partial sums."""
    distinct = urls.groupBy("host", F.regexp_replace("path", r"[0-9]+", "0").alias("path")).agg(F.count("*").alias("n"))
    # a name counts once however many pages it has, else one large site would make its name a word
    names = distinct.select("host", F.lit("").alias("path")).unionByName(distinct.select(F.lit("").alias("host"), "path")).distinct().withColumn("n", F.lit(1))

    def parts(host: str, path: str) -> list[tuple[int, int]]:
        return [(0, cell(run[i : i + LONGEST])) for run in RUN.findall((host.rpartition(".")[0] or host) + " " + path.lower()) for i in range(0, len(run), LONGEST)]

    counts = _partial(names, parts, 1)[0]
    floor = max(1.0, counts.sum() / 200)
    for w in {*lexicon, *seeds}:
        counts[cell(w)] = max(counts[cell(w)], floor)
    unigrams = Unigrams(counts, max(2.0, counts.sum()), frozenset({*lexicon, *seeds}))
    bad = set(seeds)

    def tokens(host: str, path: str) -> list[tuple[int, int]]:
        words = unigrams.words(host, path)
        kind = int(any(w.removeprefix("/") in bad for w in words))
        return [(kind, cell(w)) for w in words]

    both = _partial(distinct, tokens, 2) + 0.5
    share = both.sum(axis=1)
    weights = np.log(both[1] / share[1]) - np.log(both[0] / share[0])
    weights[both.sum(axis=0) == 1.0] = 0.0  # never seen: says nothing
    return Model(unigrams, weights, 0.0)  # equal priors: unwanted URLs are rare, and the seeds miss some


def judge(pages: DataFrame, *, url_col: str = "url", rules=RULES) -> DataFrame:
    """pages with host, path, rule, verdict and log_odds (replacing columns of these names).

    The longest fitting rule decides; without one the model does. A null URL or one without '://' has an
    empty host and path, no words, and is allowed unless the prior odds say otherwise.
    Repeated rows are judged alike; an empty table gives an empty one.
    """
    host, path = split_url(F.col(url_col))
    added = ["host", "path", "rule", "verdict", "log_odds"]
    others = [f"`{c}`" for c in pages.columns if c.lower() not in added]
    urls = pages.select(host.alias("host"), path.alias("path"))
    model = learn(urls)
    ruled = pages.select(*others, host.alias("host"), path.alias("path")).withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    schema = T.StructType([*ruled.schema.fields, T.StructField("verdict", T.StringType()), T.StructField("log_odds", T.DoubleType())])
    verdicts = {h + p: v for h, p, v in rules}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_columns
            odds = [model.score(h, p) for h, p in zip(batch.column(n - 3).to_pylist(), batch.column(n - 2).to_pylist(), strict=True)]
            found = [verdicts[r] if r is not None else ("block" if o > 0 else "allow") for r, o in zip(batch.column(n - 1).to_pylist(), odds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string()), pa.array(odds, pa.float64())], names=schema.names)

    return ruled.mapInArrow(run, schema)
