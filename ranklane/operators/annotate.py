"""Labels from marker panels: panel rows (label, role, gene) with roles core, support and anti; counts (cell, gene, cnt)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Panel defaults.
MIN_SCORE, MIN_MARGIN, MIN_CORE, SUPPORT, ANTI = 0.2, 0.05, 2, 0.35, 0.75
DOUBLET, CROSS, SURE = 0.6, 0.5, 0.5


def log_normalise(counts: DataFrame, target: float = 1e4) -> DataFrame:
    """(cell, gene, x): log1p of a count's share of its cell, times the target; over all genes."""
    return counts.select("cell", "gene", F.log1p(F.col("cnt") / F.sum("cnt").over(Window.partitionBy("cell")) * target).alias("x"))


def marker_scores(logged: DataFrame, panel: DataFrame, n_genes: int) -> DataFrame:
    """(cell, label, role, score, hits): mean over the markers minus mean over all other genes, absent genes counting 0.

    The others' mean is the cell's sum minus the markers', so every gene is read once, not once a label.
    """
    sizes = panel.groupBy("label", "role").agg(F.count("*").alias("m"))
    sums = logged.groupBy("cell").agg(F.sum("x").alias("all_x"))
    inside = logged.join(panel, "gene").groupBy("cell", "label", "role").agg(F.sum("x").alias("in_x"), F.count_if(F.col("x") > 0).alias("hits"))
    every = sums.crossJoin(F.broadcast(sizes))  # panels are small: a row for each cell and label
    j = every.join(inside, ["cell", "label", "role"], "left").withColumn("in_x", F.coalesce("in_x", F.lit(0.0)))
    rest = (F.col("all_x") - F.col("in_x")) / F.nullif(F.lit(n_genes) - F.col("m"), F.lit(0))
    return j.select("cell", "label", "role", (F.col("in_x") / F.col("m") - F.coalesce(rest, F.lit(0.0))).alias("score"), F.coalesce("hits", F.lit(0)).alias("hits"))


def compose(scores: DataFrame, least: int = MIN_CORE, support: float = SUPPORT, anti: float = ANTI) -> DataFrame:
    """(cell, label, core, hits, score): core plus support minus anti, null below the least number of core hits."""
    of = lambda role, c: F.max(F.when(F.col("role") == role, F.col(c)))
    g = scores.groupBy("cell", "label").agg(of("core", "score").alias("core"), of("core", "hits").alias("hits"), of("support", "score").alias("s"), of("anti", "score").alias("a"))
    total = F.col("core") + support * F.greatest(F.coalesce("s", F.lit(0.0)), F.lit(0.0)) - anti * F.greatest(F.coalesce("a", F.lit(0.0)), F.lit(0.0))
    return g.select("cell", "label", "core", "hits", F.when(F.col("hits") >= least, total).alias("score"))


def decide(scored: DataFrame, same_group: Column | None = None, min_score: float = MIN_SCORE, min_margin: float = MIN_MARGIN) -> DataFrame:
    """(cell, label, runner_up, score, margin, doublet): the ladder of rules over a cell's best two labels.

    Ambiguous below min_score; two labels whose cores are both high are a doublet or cross; so are two close
    totals; a small margin under a low score is ambiguous; else the best label. same_group: whether labels
    l0 and l1 belong together and may be close. Ties by label.
    """
    low = F.lit(float("-inf"))
    s = F.coalesce("score", low)
    per = Window.partitionBy("cell")
    r = scored.withColumns({"_r": F.row_number().over(per.orderBy(s.desc(), "label")), "_ok": (F.col("score").isNotNull() & (F.col("core") >= min_score)).cast("int")})
    r = r.withColumn("_c", F.row_number().over(per.orderBy(F.desc("_ok"), F.desc("core"), "label")))
    at = lambda n, c: F.max(F.when(F.col("_r") == n, F.col(c)))
    core = lambda n, c: F.max(F.when((F.col("_c") == n) & (F.col("_ok") == 1), F.col(c)))
    g = r.groupBy("cell").agg(at(1, "label").alias("l0"), at(2, "label").alias("l1"), at(1, "score").alias("s0"), at(2, "score").alias("s1"), core(1, "label").alias("c0"), core(2, "label").alias("c1"), core(1, "core").alias("k0"), core(2, "core").alias("k1"))
    apart = F.lit(True) if same_group is None else ~same_group
    has_cores = F.col("k1").isNotNull() & (F.col("k0") > 0) & apart
    rival = F.col("s1").isNotNull() & (F.col("s1") >= min_score) & apart
    cores, totals = F.concat_ws("|", "c0", "c1"), F.concat_ws("|", "l0", "l1")
    rules = [
        (F.col("s0").isNull() | (F.col("s0") < min_score), "Ambiguous", F.when(F.col("s1").isNotNull(), F.col("l1")).otherwise("")),
        (has_cores & (F.col("k1") >= DOUBLET * F.col("k0")), "Doublet_suspected", cores),
        (has_cores & (F.col("k1") >= CROSS * F.col("k0")), "ambiguous_cross_compartment", cores),
        (rival & (F.col("s1") >= DOUBLET * F.col("s0")), "Doublet_suspected", totals),
        (rival & (F.col("s1") >= CROSS * F.col("s0")), "ambiguous_cross_compartment", totals),
        (F.col("s1").isNotNull() & (F.col("s0") - F.col("s1") < min_margin) & (F.col("s0") < SURE), "Ambiguous", F.col("l1")),
    ]
    label, runner = F.col("l0"), F.when(F.col("s1").isNotNull(), F.col("l1")).otherwise("")
    for test, name, second in reversed(rules):
        label, runner = F.when(test, name).otherwise(label), F.when(test, second).otherwise(runner)
    by_core = has_cores & (F.col("k1") >= CROSS * F.col("k0")) & (F.col("s0") >= min_score)
    margin = F.when(F.col("s0").isNull(), 0.0).when(by_core, F.col("k0") - F.col("k1")).when(F.col("s1").isNotNull(), F.col("s0") - F.col("s1")).otherwise(F.col("s0"))
    return g.select("cell", label.alias("label"), runner.alias("runner_up"), F.coalesce("s0", F.lit(0.0)).alias("score"), margin.alias("margin")).withColumn("doublet", (F.col("label") == "Doublet_suspected").cast("int"))


def sub_state(labels: DataFrame, hits: DataFrame, parent: str, least: int = 2, name: str = "fiber_program") -> DataFrame:
    """(cell, state): for cells of the parent label, the one program with enough hits, mixed for several, unresolved for none. hits: (cell, program, n)."""
    on = hits.where(F.col("n") >= least).groupBy("cell").agg(F.count("*").alias("k"), F.min("program").alias("p"))
    j = labels.where(F.col("label") == parent).join(on, "cell", "left")
    return j.select("cell", F.concat(F.lit(f"{name}="), F.when(F.col("k") >= 2, "mixed").when(F.col("k") == 1, F.col("p")).otherwise("unresolved")).alias("state"))


def low_vocabulary(panel: DataFrame, vocab: DataFrame) -> DataFrame:
    """(label, known, registered, low): labels whose core markers are at least half outside the vocabulary."""
    j = panel.where(F.col("role") == "core").join(vocab.select("gene", F.lit(1).alias("known")).distinct(), "gene", "left")
    return j.groupBy("label").agg(F.count("known").alias("known"), F.count("*").alias("registered")).withColumn("low", F.col("known") * 2 <= F.col("registered"))


def prefer_metadata(rule: str, own: Column, meta: Column, annotator: Column, prefix: str) -> Column:
    """The label in the metadata always, never, or (auto) only where the platform's own annotator wrote it."""
    has = F.coalesce(F.trim(meta), F.lit("")) != ""
    use = {"always": has, "never": F.lit(False), "auto": has & F.startswith(F.coalesce(annotator, F.lit("")), F.lit(prefix))}
    if rule not in use:
        raise ValueError("rule is always, never or auto")
    return F.when(use[rule], meta).otherwise(own)
