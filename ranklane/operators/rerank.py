"""Reordering a perturbed list by what the perturbation did to its keys' states, and scoring the cell against a goal state.

Every rule gives a key its place in the list as it stands plus a bounded shift; keys are then put in order of the sum. States and
logits are rows by (cell, token), so contexts are aligned by key, whoever computed them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ranklane.functions import lists
from ranklane.operators import chains
from ranklane.operators.counterfactuals import compared_keys
from ranklane.operators.profiles import norm_pos
from ranklane.operators.vectors import cosine, norm


def state_changes(encoded: DataFrame, perturbed: DataFrame, control: DataFrame) -> DataFrame:
    """encoded (cell, pos, token, len) with delta_h, delta_norm and valid; zeros where the control lacks the key.

    perturbed and control: (cell, token, vec).
    """
    p, c = (df.select("cell", "token", F.col("vec").alias(name)) for df, name in ((perturbed, "_p"), (control, "_c")))
    rows = encoded.join(p, ["cell", "token"]).join(c, ["cell", "token"], "left").withColumn("valid", F.col("_c").isNotNull())
    zeros = F.transform("_p", lambda x: F.lit(0.0))
    delta = F.when(F.col("valid"), F.zip_with("_p", "_c", lambda x, y: x.cast("double") - y.cast("double"))).otherwise(zeros)
    return rows.withColumns({"delta_h": delta, "delta_norm": F.when(F.col("valid"), norm(F.col("_p")) - norm(F.col("_c"))).otherwise(0.0)}).drop("_p", "_c")


def logit_changes(encoded: DataFrame, perturbed: DataFrame, control: DataFrame) -> DataFrame:
    """encoded with delta_logit: a key's own logit after minus before; 0 where either side lacks it. perturbed and control: (cell, token, logit)."""
    p, c = (df.select("cell", "token", F.col("logit").cast("double").alias(name)) for df, name in ((perturbed, "_p"), (control, "_c")))
    rows = encoded.join(p, ["cell", "token"], "left").join(c, ["cell", "token"], "left")
    return rows.withColumn("delta_logit", F.coalesce(F.col("_p") - F.col("_c"), F.lit(0.0))).drop("_p", "_c")


def standardised(value: str) -> Column:
    """z-scores within a cell, by the population's deviation; 0 where nothing varies."""
    per = Window.partitionBy("cell")
    sd = F.stddev_pop(value).over(per)
    return F.when(sd > 0, (F.col(value) - F.avg(value).over(per)) / sd).otherwise(0.0)


def shift_of(kind: str, alpha: float, bound: float, weights: Sequence[float] = ()) -> Column:
    """The shift that a rule adds to a key's place.

    norm and delta_mlm: what grew most goes left, by -alpha z, within the bound; linear and contrast: the decoder's reading of delta_h or of
    the contrast with placebos, which its tanh keeps within the bound; teacher: the observed change (delta, none counting 0), within the bound.
    """
    rules = {
        "norm": lambda: lists.clamp(-alpha * standardised("delta_norm"), bound), "delta_mlm": lambda: lists.clamp(-alpha * standardised("delta_logit"), bound),
        "linear": lambda: chains.decode(F.col("delta_h"), weights, bound), "contrast": lambda: chains.decode(F.col("contrast"), weights, bound),
        "teacher": lambda: lists.clamp(F.coalesce("delta", F.lit(0.0)), bound),
    }
    if kind not in rules:
        raise ValueError(f"no rule {kind!r}; there are {', '.join(rules)}")
    return rules[kind]()


def with_teacher(encoded: DataFrame, delta: DataFrame) -> DataFrame:
    """encoded with the teacher's delta of each key (token, delta); null where it has none."""
    return encoded.join(delta.select("token", "delta"), "token", "left")


def reorder(rows: DataFrame, shift: Column, grid: float = 0.0) -> DataFrame:
    """(cell, before, after, moves): each cell's keys as they stood and in order of place plus shift.

    rows: (cell, pos, token, len) and what the shift reads. Sums are snapped to a grid before they are compared, and equal ones keep
    their order, so that small differences move nothing. moves: how far the key at each new place went. A cell's keys are one array.
    """
    scored = rows.select("cell", "pos", "token", lists.quantize(norm_pos() + shift, grid).alias("p"))
    ordered = F.array_sort(F.collect_list(F.struct("p", F.col("pos").cast("int").alias("i"), "token")))
    by_place = F.array_sort(F.collect_list(F.struct(F.col("pos").cast("int").alias("i"), "token")))
    g = scored.groupBy("cell").agg(ordered.alias("s"), by_place.alias("b"))
    # places are counted from the list's first key, whatever its pos
    return g.select("cell", F.transform("b", lambda x: x["token"]).alias("before"), F.transform("s", lambda x: x["token"]).alias("after"), F.transform("s", lambda x, j: j - x["i"]).alias("moves"))


def diagnostics(reordered: DataFrame, k: int = 100) -> DataFrame:
    """(n_cells, spearman, mean_abs_displacement, frac_moved, top_jaccard): means over cells of what a reordering did; lists of one have no correlation."""
    n = F.size("moves").cast("double")
    squares = F.aggregate("moves", F.lit(0.0), lambda s, m: s + m.cast("double") * m)
    x = reordered.where(F.size("moves") > 0).select(
        F.when(n > 1, 1 - 6 * squares / (n * (n * n - 1))).alias("rho"), (F.aggregate("moves", F.lit(0.0), lambda s, m: s + F.abs(m)) / n).alias("d"), (F.size(F.filter("moves", lambda m: m != 0)) / n).alias("f"), lists.topk_jaccard(F.col("before"), F.col("after"), k).alias("j"),
    )
    return x.agg(F.count("*").alias("n_cells"), F.avg("rho").alias("spearman"), F.avg("d").alias("mean_abs_displacement"), F.avg("f").alias("frac_moved"), F.avg("j").alias("top_jaccard"))


def pool_lengths(kind: str, k: int, original: Column, perturbed: Column, legacy: bool = False) -> tuple[Column, Column]:
    """How many leading places of the original and of the perturbed list are pooled for a group edit of k keys.

    The original loses k places; an overexpressed list was stripped of its k leading ones, a deleted one has its own length already.
    legacy keeps the lists' lengths.
    """
    if legacy or lists.step_name(kind) not in ("overexpress", "delete"):
        return original, perturbed
    return original - k, perturbed - k if lists.step_name(kind) == "overexpress" else perturbed


def _means(rows: DataFrame, name: str) -> DataFrame:
    x = rows.select("cell", F.posexplode(F.col("vec").cast("array<double>")).alias("i", "x")).groupBy("cell", "i").agg(F.avg("x").alias("x"))
    return x.groupBy("cell").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias(name))


def _shift(original: DataFrame, perturbed: DataFrame, goal: DataFrame) -> DataFrame:
    j = _means(original, "_o").join(_means(perturbed, "_p"), "cell").crossJoin(F.broadcast(goal.select(F.col("vec").alias("_g"))))  # one row
    near = lambda c: F.coalesce(cosine(F.col(c), F.col("_g")), F.lit(0.0))
    return j.select("cell", (near("_p") - near("_o")).alias("goal_state_shift"))


def aligned_goal_shift(cells: DataFrame, original: DataFrame, perturbed: DataFrame, goal: DataFrame, tokens: Sequence[int], kind: str) -> DataFrame:
    """(cell, goal_state_shift): how much closer a group edit brings a cell's mean state to the goal's, by cosine, over the keys that both contexts have.

    cells: (cell, ids), the original lists; original and perturbed: (cell, token, vec); goal: one row (vec). After a deletion the
    perturbed side is pooled over all keys that are left.
    """
    keys = cells.select("cell", F.explode(compared_keys(F.col("ids"), tokens)).alias("token"))
    after = perturbed.join(keys, ["cell", "token"], "left_semi") if lists.step_name(kind) == "overexpress" else perturbed
    return _shift(original.join(keys, ["cell", "token"], "left_semi"), after, goal)


def mean_goal_shift(original: DataFrame, perturbed: DataFrame, goal: DataFrame, strip: int = 0) -> DataFrame:
    """(cell, goal_state_shift) of mixed edits, over whole lists without aligning them; the perturbed one's first `strip` places are left out.

    original and perturbed: (cell, pos, len, vec). A list that is no longer than what is stripped keeps one place behind it, if it has one.
    """
    inside = perturbed.where((F.col("pos") >= strip) & (F.col("pos") < F.greatest(F.col("len"), F.lit(strip + 1))))
    return _shift(original.where(F.col("pos") < F.col("len")), inside, goal)
