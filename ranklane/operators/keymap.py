"""Mapping keys between vocabularies: relations (source, target, kind, ord) under explicit policies.

A relation's rows carry their order (ord), since two policies depend on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ranklane.functions.text import is_primary, normal_id, spellings

#: Kinds of relation that count as one to one.
ONE2ONE = ("ortholog_one2one", "one2one")


def last_wins(rows: DataFrame) -> DataFrame:
    """(source, target): the last row of each source."""
    return rows.groupBy("source").agg(F.max_by("target", "ord").alias("target"))


def smallest_target(rows: DataFrame) -> DataFrame:
    """(source, target): the first target of each source in code point order."""
    return rows.groupBy("source").agg(F.min("target").alias("target"))


def one2one(rows: DataFrame) -> DataFrame:
    """(source, target): pairs in which neither side has another partner.

    If rows of a one-to-one kind exist, only those count. Primary ids need a single target and a target with a
    single primary source; symbols keep their first target.
    """
    typed = rows.agg(F.coalesce(F.max(F.col("kind").isin(*ONE2ONE).cast("int")), F.lit(0)).alias("typed"))
    c = rows.crossJoin(F.broadcast(typed)).where((F.col("typed") == 0) | F.col("kind").isin(*ONE2ONE)).withColumn("primary", is_primary(F.col("source")))
    primary = c.where("primary").select("source", "target").distinct()
    per_source = primary.groupBy("source").agg(F.min("target").alias("target"), F.count("*").alias("n")).where("n = 1")
    per_target = primary.groupBy("target").agg(F.count("*").alias("n")).where("n = 1").select("target")
    symbols = c.where("NOT primary").groupBy("source").agg(F.min_by("target", "ord").alias("target"))
    return per_source.select("source", "target").join(per_target, "target").select("source", "target").unionByName(symbols)


def override(table: DataFrame, curated: DataFrame) -> DataFrame:
    """The table with the curated rows' targets where they have the source; of several the last."""
    by_hand = curated.groupBy("source").agg(F.max_by("target", "ord").alias("curated"))
    return table.join(by_hand, "source", "full").select("source", F.coalesce("curated", "target").alias("target"))


def drop_collisions(table: DataFrame, preferred: DataFrame) -> DataFrame:
    """Primary sources that share a target: the single preferred one stays, or none. Other rows stay."""
    t = table.withColumn("primary", is_primary(F.col("source"))).join(preferred.select("source", F.lit(1).alias("mark")).distinct(), "source", "left")
    per = Window.partitionBy("target", "primary")
    n, marked = F.count("*").over(per), F.count("mark").over(per)
    kept = ~F.col("primary") | (F.col("n") == 1) | ((F.col("marked") == 1) & F.col("mark").isNotNull())
    return t.withColumns({"n": n, "marked": marked}).where(kept).select("source", "target")


def load(main: DataFrame, curated: DataFrame, policy: str) -> DataFrame:
    """The table of a policy: one2one, best_of_n or legacy_sum, with curated rows on top."""
    collapse = {"one2one": one2one, "best_of_n": smallest_target, "legacy_sum": last_wins}
    if policy not in collapse:
        raise ValueError(f"unknown policy {policy!r}")
    out = override(collapse[policy](main), curated)
    return drop_collisions(out, curated.where(is_primary(F.col("source")))) if policy == "one2one" else out


def lookup_symbols(names: DataFrame, symbols: DataFrame) -> DataFrame:
    """(name, id): the first of a name's spellings that the table (symbol, id) has."""
    tried = names.select("name", F.posexplode(spellings(F.col("name"))).alias("at", "symbol"))
    return tried.join(symbols, "symbol").groupBy("name").agg(F.min_by("id", "at").alias("id"))


def resolve(keys: DataFrame, table: DataFrame, symbols: DataFrame, native_prefix: str) -> DataFrame:
    """(key, target, via): by the table directly, by symbol and table, or as an id that is native already."""
    k = keys.select(F.col("key"), F.trim("key").alias("t")).where("t <> ''").distinct()
    direct = F.when(F.startswith(F.col("t"), F.lit("ENS")), normal_id(F.col("t"))).otherwise(F.col("t"))
    t = table.select("source", normal_id(F.col("target")).alias("target"))
    raw = t.withColumnsRenamed({"source": "t", "target": "raw"})
    norm = t.withColumnsRenamed({"source": "norm", "target": "by_norm"})
    named = lookup_symbols(k.where(~F.startswith(F.col("t"), F.lit("ENS"))).select(F.col("t").alias("name")), symbols).join(t.withColumnRenamed("source", "id"), "id").select(F.col("name").alias("t"), F.col("target").alias("by_symbol"))
    j = k.withColumn("norm", direct).join(raw, "t", "left").join(norm, "norm", "left").join(named, "t", "left")
    native = F.when(F.startswith(F.col("norm"), F.lit(native_prefix)), F.col("norm"))
    first = F.coalesce("raw", "by_norm")
    return j.select("key", F.coalesce(first, "by_symbol", native).alias("target"), F.when(first.isNotNull(), "table").when(F.col("by_symbol").isNotNull(), "symbol").when(native.isNotNull(), "native").otherwise("unmapped").alias("via"))


def convert_ordered(keys: DataFrame, resolved: DataFrame) -> DataFrame:
    """(ord, key, target) in which each target stays with its first key; later keys of it have no target."""
    j = keys.join(resolved.select("key", "target"), "key", "left")
    rn = F.row_number().over(Window.partitionBy("target").orderBy("ord"))
    return j.select("ord", "key", F.when(F.col("target").isNotNull() & (rn == 1), F.col("target")).alias("target"))


def collapse_sum(counts: DataFrame, table: DataFrame) -> DataFrame:
    """(cell, gene, cnt): counts of sources that share a target added up; unmapped ones go."""
    return counts.join(table, counts["gene"] == table["source"]).groupBy("cell", "target").agg(F.sum("cnt").alias("cnt")).withColumnRenamed("target", "gene")


def collapse_best(counts: DataFrame, table: DataFrame, n_cells: Column | int) -> DataFrame:
    """(cell, gene, cnt): of the sources of a target, the one of highest median over all cells, zeros included; ties by id.

    The median over n cells of a sparse column follows from its values and the number of zeros: the mean of
    the two middle values, each 0 if it lies among the zeros.
    """
    n = F.lit(n_cells) if isinstance(n_cells, int) else n_cells
    ranked = counts.where("cnt > 0").join(table, counts["gene"] == table["source"]).select("cell", "source", "target", "cnt")
    # distinct values of a source with their cells, so that no source's cells are sorted
    values = ranked.groupBy("target", "source", "cnt").agg(F.count("*").alias("_n"))
    per = Window.partitionBy("source")
    upto = n - F.sum("_n").over(per) + F.sum("_n").over(per.orderBy("cnt"))
    placed = values.withColumn("upto", upto)
    middle = lambda k: F.sum(F.when((k <= F.col("upto")) & (k > F.col("upto") - F.col("_n")), F.col("cnt")).otherwise(0.0)) / 2
    med = placed.groupBy("target", "source").agg((middle(F.floor((n + 1) / 2)) + middle(F.floor((n + 2) / 2))).alias("m"))
    best = med.withColumn("_rn", F.row_number().over(Window.partitionBy("target").orderBy(F.desc("m"), "source"))).where("_rn = 1").select("target", "source")
    return ranked.join(best, ["target", "source"]).select("cell", F.col("target").alias("gene"), "cnt")


def inspect(keys: DataFrame, main: DataFrame, curated: DataFrame, table: DataFrame, policy: str = "one2one") -> DataFrame:
    """(key, candidates, kinds, target, status, curated): what the relation offers for each key and what became of it."""
    k = keys.select(F.trim("key").alias("key")).where("key <> ''").distinct().withColumn("norm", normal_id(F.col("key")))
    both = main.select("source", "target", "kind").withColumn("hand", F.lit(0)).unionByName(curated.select("source", "target", "kind").withColumn("hand", F.lit(1)))
    indexed = both.select(F.explode(F.array_distinct(F.array(F.col("source"), normal_id(F.col("source"))))).alias("norm"), "target", "kind", "hand")
    found = k.join(indexed, "norm", "left").groupBy("key", "norm").agg(F.array_join(F.sort_array(F.collect_set("target")), ",").alias("candidates"), F.array_join(F.sort_array(F.collect_set(F.nullif(F.col("kind"), F.lit("")))), ",").alias("kinds"), F.coalesce(F.max("hand"), F.lit(0)).alias("curated"))
    out = found.join(table.select(F.col("source").alias("norm"), F.col("target")), "norm", "left")
    kinds = F.lower("kinds")
    lost = F.when(F.rlike(kinds, F.lit("one2many|one_to_many")), "ortholog_one2many").when(F.rlike(kinds, F.lit("many2many|many_to_many")), "ortholog_many2many").when(kinds != "", "dropped_ambiguous").otherwise("no_ortholog")
    status = F.when(F.col("target").isNotNull() & (F.col("curated") == 1), "curated_bridge").when(F.col("target").isNotNull(), "mapped_one2one" if policy == "one2one" else "mapped").otherwise(lost)
    return out.select("key", "candidates", "kinds", "target", status.alias("status"), "curated")


def conversion_report(keys: DataFrame, resolved: DataFrame, vocab: DataFrame) -> DataFrame:
    """Per file and over all files (file null): keys, mapped, unmapped, percent mapped, targets, shared targets, in the vocabulary.

    keys: (file, key). Both levels come from one pass by grouping sets.
    """
    j = keys.distinct().join(resolved.select("key", "target"), "key", "left").join(vocab.select(F.col("gene").alias("target"), F.lit(1).alias("known")), "target", "left")
    per_key = j.groupingSets([["file", "key"], ["key"]], "file", "key").agg(F.max("target").alias("target"), F.max("known").alias("known"), F.grouping("file").alias("merged"))
    per_target = per_key.groupBy("merged", "file", "target").agg(F.count("*").alias("n"), F.max("known").alias("known"))
    mapped = F.sum(F.when(F.col("target").isNotNull(), F.col("n")).otherwise(0))
    return per_target.groupBy("merged", "file").agg(
        F.sum("n").alias("n_input"), mapped.alias("n_mapped"), (F.sum("n") - mapped).alias("n_unmapped"), F.round(100.0 * mapped / F.sum("n"), 2).alias("pct_mapped"),
        F.count("target").alias("n_targets"), F.count_if(F.col("target").isNotNull() & (F.col("n") > 1)).alias("n_many_to_one"), F.count("known").alias("n_in_vocab"),
    ).drop("merged")


def loss_gate(critical: DataFrame, present: DataFrame, inspected: DataFrame, warn_on: tuple[str, ...]) -> DataFrame:
    """(critical_set, n, n_present, n_lost, verdict): block if a present key of the set is lost, warn if only for the listed reasons.

    critical: (critical_set, key); present: (key); inspected: (key, target, status).
    """
    j = critical.distinct().join(present.select("key", F.lit(1).alias("here")).distinct(), "key", "left").join(inspected.select("key", "target", "status"), "key", "left")
    lost = F.col("here").isNotNull() & F.col("target").isNull()
    mild = F.coalesce(F.col("status"), F.lit("no_ortholog")).isin(*warn_on)
    out = j.groupBy("critical_set").agg(F.count("*").alias("n"), F.count("here").alias("n_present"), F.count_if(lost).alias("n_lost"), F.count_if(lost & ~mild).alias("n_block"))
    verdict = F.when(F.col("n_present") == 0, "not_applicable").when(F.col("n_block") > 0, "block").when(F.col("n_lost") > 0, "warn").otherwise("pass")
    return out.select("critical_set", "n", "n_present", "n_lost", verdict.alias("verdict"))
