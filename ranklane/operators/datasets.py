"""Selecting, labelling and splitting cells, and looking keys up."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ranklane.operators.ranking import numbered


def keep_listed(rows: DataFrame, wanted: Mapping[str, Sequence]) -> DataFrame:
    """Rows whose every named column has one of its listed values."""
    for column, values in wanted.items():
        rows = rows.where(F.col(column).isin(*values))
    return rows


def hash_order(seed: int, *keys: str) -> Column:
    """A number that orders rows as a seeded shuffle would, the same on every run and partitioning."""
    return F.xxhash64(F.lit(seed), *keys)


def apply_metadata(rows: DataFrame, rename: Mapping[str, str] | None = None, add: Mapping[str, str] | None = None, derive: Mapping[str, tuple[str, Mapping[str, str]]] | None = None) -> DataFrame:
    """Renames columns that exist, adds constants that are absent, and derives columns by a value map with the identity as default."""
    rows = rows.withColumnsRenamed({a: b for a, b in (rename or {}).items() if a in rows.columns})
    for name, value in (add or {}).items():
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(value))
    for name, (source, mapping) in (derive or {}).items():
        out = F.col(source)
        for a, b in mapping.items():
            out = F.when(F.col(source) == a, F.lit(b)).otherwise(out)
        rows = rows.withColumn(name, out)
    return rows


def train_eval_split(rows: DataFrame, key: str, label: str, train_share: float, order: Column) -> DataFrame:
    """rows with part: the first round(n * share) in the given order are 'train'; others 'eval' if train has their label, else they go.

    order must tell all rows apart. Rows are numbered by ranges of it, so the cut is exact and no task sorts them all.
    """
    many = rows.agg(F.round(F.count("*") * F.lit(train_share)).alias("_cut"))
    placed = numbered(rows.withColumn("_o", order), "_o").crossJoin(F.broadcast(many))
    parted = placed.withColumn("part", F.when(F.col("position") < F.col("_cut"), "train").otherwise("eval")).drop("_o", "_cut", "position")
    known = parted.where("part = 'train'").select(F.col(label).alias("_label")).distinct()
    evals = parted.where("part = 'eval'").join(known, F.col(label) == F.col("_label"), "left_semi")
    return parted.where("part = 'train'").unionByName(evals)


def longest_first(cells: DataFrame, most: int | None, cap_first: bool) -> DataFrame:
    """cells with ord: by falling length; a cap takes the first ones before (cap_first) or after the sort.

    cells: (cell, length). The cap is a bound of the caller, so what is ordered in one task is at most that.
    """
    by_length = [F.desc("length"), F.asc("cell")]
    if most is not None:
        cells = cells.orderBy("cell").limit(most) if cap_first else cells.orderBy(*by_length).limit(most)
    return cells.withColumn("ord", F.row_number().over(Window.orderBy(*by_length)) - 1)


def invert_first(pairs: DataFrame) -> DataFrame:
    """(token, symbol) from (symbol, token, ord): the first symbol of each token."""
    return pairs.groupBy("token").agg(F.min_by("symbol", "ord").alias("symbol"))


def token_symbols(vocab: DataFrame, symbols: DataFrame) -> DataFrame:
    """(token, symbol) of real tokens: the id's symbol, or the id itself. vocab: (gene, token); symbols: (symbol, gene, ord)."""
    first = symbols.groupBy("gene").agg(F.min_by("symbol", "ord").alias("symbol"))
    return vocab.where(~F.startswith("gene", F.lit("<"))).join(first, "gene", "left").select("token", F.coalesce("symbol", "gene").alias("symbol"))


def names_to_tokens(names: DataFrame, vocab: DataFrame, resolved: DataFrame) -> DataFrame:
    """(name, token): by the vocabulary directly, else by what the name resolves to; null where neither knows it."""
    direct = vocab.select(F.col("gene").alias("name"), F.col("token").alias("t0"))
    by_target = resolved.join(vocab, F.col("target") == F.col("gene")).select(F.col("key").alias("name"), F.col("token").alias("t1"))
    return names.select("name").distinct().join(direct, "name", "left").join(by_target, "name", "left").select("name", F.coalesce("t0", "t1").alias("token"))


def brief_functions(keys: DataFrame, main: DataFrame, curated: DataFrame) -> DataFrame:
    """(key, text): the curated text before the main one, by id before upper-case symbol. Tables: (id, symbol, text)."""
    k = keys.select("key").distinct().withColumn("upper", F.upper("key"))
    out, told = k, []
    for n, (table, column) in enumerate(((curated, "id"), (main, "id"), (curated, "symbol"), (main, "symbol"))):
        by = "key" if column == "id" else "upper"
        look = table.where(F.col(column).isNotNull()).groupBy((F.col(column) if column == "id" else F.upper(column)).alias(by)).agg(F.max("text").alias(f"t{n}"))
        out = out.join(look, by, "left")
        told.append(f"t{n}")
    return out.select("key", F.coalesce(*told).alias("text"))


def forbidden_in_overlay(overlay: DataFrame, forbidden: DataFrame) -> DataFrame:
    """Overlay rows that have a forbidden id on either side. forbidden: (id)."""
    both = overlay.select("source", "target", F.explode(F.array("source", "target")).alias("id"))
    return both.join(forbidden, "id", "left_semi").select("source", "target").distinct()
