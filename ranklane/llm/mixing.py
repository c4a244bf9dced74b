"""Mixing sources to target weights by Pareto order sampling.

A document's expected copies are its source's target over the source's size, times its weight over the source's
mean one. Their whole part is certain; the rest is the document's inclusion probability in a Pareto sample
(Rosén 1997): it draws U, its key is the odds of U over the odds of inclusion, and the documents of smallest
key are in until the source's fixed size, counted in words, is reached. That is a threshold on the key for each
source. Thresholds come from histograms, so no source is ever sorted or gathered in one task, and each document
decides by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ranklane.llm.common import Scratch, word_count

#: What inclusion probabilities are kept from 0 and 1 by where odds are formed.
EDGE = 1e-9
#: Histogram cells for each level of the search for a threshold, and levels: 2**24 cells are told apart.
CELLS, LEVELS = 4096, 2
#: Passes that fill what the last document of a pass left open.
PASSES = 3


def source_targets(sources: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most_copies: int = 3, share: float = 1.0) -> DataFrame:
    """Adds target to (source, source_size): water-filling with a cap of most_copies times the size.

    sources has one row for each source. Sources in code point order, null last, take the weights in
    turn. Targets at their cap leave their excess to the others by weight; the level at which this ends
    is found in closed form from running sums in order of cap over weight.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    filling = Window.orderBy("fills", F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    return (
        sources.withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * float(most_copies))
        .withColumn("fills", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything) * float(share))
        .withColumn("capped", F.coalesce(F.sum("cap").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(filling.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("capped")) / F.col("open"))
        .withColumn("end", F.max(F.when(F.col("fills") > F.col("level"), F.col("level"))).over(everything))
        .withColumn("target", F.least("cap", F.coalesce(F.col("end") * F.col("weight"), F.col("cap"))))
        .select("source", "source_size", "target")
    )


def uniform(seed: int, *columns: str) -> Column:
    """A number in (0, 1) that follows from the row alone, so that reruns and retried tasks agree."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11).cast("double") + 0.5) / float(1 << 53)


def _fill(rows: DataFrame, needs: DataFrame, scratch: Scratch) -> DataFrame:
    """(source, upto, filled): the largest U such that the rows up to it hold at most `need` words.

    rows: source, u, size; needs: source, need. Level by level, the histogram cell in which the running
    sum passes the need is found and then divided again; in the last one single values of U are summed.
    Rows with equal U are equal rows and stay together.
    """
    same = F.expr("rows.source <=> cells.source")
    cells = needs.select("source", "need", F.lit(0.0).alias("low"), F.lit(1.0).alias("width"), F.lit(0).cast("double").alias("filled"))
    for level in range(LEVELS + 1):
        last = level == LEVELS
        inside = rows.alias("rows").join(cells.alias("cells"), same).where("u >= low AND u < low + width")
        key = F.col("u") if last else F.least(F.floor((F.col("u") - F.col("low")) / F.col("width") * CELLS), F.lit(CELLS - 1)).cast("double")
        sums = inside.groupBy("cells.source", "need", "low", "width", "filled", key.alias("cell")).agg(F.sum("size").cast("double").alias("size"))
        run = Window.partitionBy("source").orderBy("cell")
        sums = sums.withColumn("upto", F.col("filled") + F.sum("size").over(run))
        if last:
            fits = F.col("upto") <= F.col("need")
            return sums.groupBy("source").agg(F.max(F.when(fits, F.col("cell"))).alias("upto"), F.max(F.when(fits, F.col("upto"))).alias("sum"), F.first("filled").alias("before"), F.first("low").alias("low"))
        crossing = sums.where(F.col("upto") > F.col("need")).groupBy("source").agg(F.min_by(F.struct("need", "low", "width", "cell", (F.col("upto") - F.col("size")).alias("filled")), "cell").alias("c"))
        cells = scratch.keep(
            crossing.select("source", "c.need", (F.col("c.low") + F.col("c.width") / CELLS * F.col("c.cell")).alias("low"), (F.col("c.width") / CELLS).alias("width"), "c.filled")
        )
    raise AssertionError


def pareto_rank(u: Column, p: Column) -> Column:
    """The Pareto key q, odds of u over odds of the inclusion probability p, as q / (1 + q), which ranks alike within (0, 1)."""
    p = F.greatest(F.lit(EDGE), F.least(p, F.lit(1 - EDGE)))
    q = (u / (1 - u)) / (p / (1 - p))
    return F.least(q / (1 + q), F.lit(1 - 2.0**-53))


def plan_mix(
    docs: DataFrame, scratch: Scratch, *, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id", weight_col: str | None = None,
    weights: tuple[float, ...] = (5, 2, 1), most_copies: int = 3, share: float = 1.0, seed: int = 20,
) -> DataFrame:
    """(row, _mix) for every row of docs: the row as a struct, and a struct of size, source_size, target, expected and copies.

    size counts words; a null or empty text has none, is never taken and has no copies. An empty table
    gives an empty one. Repeated rows count as often as they occur and are taken together. A null source
    is a source. Rows stay whole in their struct, so columns of any name are allowed.

    weight_col: how much likelier than others of its source a document is; null or negative counts as 0, and a
    document's expected copies stop at most_copies. Without it all documents of a source are as likely.

    The first pass takes the longest start of the Pareto order that fits the rest of the target. The next
    ones go on behind it with documents that fit what is left, so a source misses its target by less than
    the shortest of its documents that were passed over.
    """
    weight = F.greatest(F.coalesce(F.col(f"`{weight_col}`").cast("double"), F.lit(0.0)), F.lit(0.0)) if weight_col else F.lit(1.0)
    told = F.struct(F.col(f"`{source_col}`").alias("source"), word_count(F.col(f"`{text_col}`")).alias("size"), uniform(seed, f"`{id_col}`", f"`{text_col}`", f"`{source_col}`").alias("u"), weight.alias("weight"))
    measured = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), told.alias("_mix"))
    drawn = scratch.keep(measured.select("_mix.*"))
    by_source = drawn.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("weight")).alias("weighed"))
    targets = source_targets(by_source.select("source", "source_size"), weights, most_copies, share)
    # expected copies of a document of weight 1
    targets = targets.join(by_source.select(F.col("source").alias("_source"), "weighed"), F.expr("source <=> _source")).withColumn("rate", F.when(F.col("weighed") > 0, F.col("target") / F.col("weighed")).otherwise(0.0))

    def expected(w: Column, rate: Column) -> Column:
        e = F.least(w * rate, F.lit(float(most_copies)))
        return F.when(F.abs(e - F.round(e)) < 1e-9, F.round(e)).otherwise(e)

    def ranked(u: Column, e: Column) -> Column:
        return pareto_rank(u, e - F.floor(e))

    e = expected(F.col("weight"), F.col("rate"))
    dealt = drawn.alias("s").join(targets.select(F.col("source").alias("_source"), "rate"), F.expr("s.source <=> _source"))
    slim = scratch.keep(dealt.select("source", "size", ranked(F.col("u"), e).alias("u"), F.floor(e).alias("sure"), (e > F.floor(e)).alias("open")))
    sure = slim.groupBy("source").agg(F.sum(F.col("size") * F.col("sure")).cast("double").alias("taken"))
    state = scratch.keep(
        targets.join(sure.withColumnRenamed("source", "_source2"), F.expr("source <=> _source2"), "left")
        .select("source", "source_size", "target", "rate", (F.col("target") - F.coalesce("taken", F.lit(0.0))).alias("need"))
        .withColumn("behind", F.lit(-1.0)).withColumn("rules", F.array().cast("array<struct<behind:double,upto:double,most:double>>"))
    )
    for _ in range(PASSES):
        rows = slim.alias("s").join(state.select("source", "need", "behind").alias("t"), F.expr("s.source <=> t.source")).where("s.open AND s.size > 0 AND s.u > t.behind AND s.size <= t.need")
        found = _fill(rows.select("s.source", "u", "size"), state.select("source", "need"), scratch)
        # no crossing: every row fits, and the start ends behind the last one
        all_fit = rows.groupBy("s.source").agg(F.sum("size").cast("double").alias("all_size"))
        step = (
            state.alias("t")
            .join(found.alias("f"), F.expr("t.source <=> f.source"), "left")
            .join(all_fit.alias("a"), F.expr("t.source <=> a.source"), "left")
            .select(
                "t.source", "source_size", "target", "rate", "need", "behind", "rules",
                F.coalesce(F.when(F.col("all_size") <= F.col("need"), F.lit(1.0)), F.col("f.upto"), F.col("f.low"), F.col("behind")).alias("upto"),
                F.coalesce(F.when(F.col("all_size") <= F.col("need"), F.col("all_size")), F.col("f.sum"), F.col("f.before"), F.lit(0.0)).alias("got"),
            )
        )
        state = scratch.keep(
            step.select(
                "source", "source_size", "target", "rate", (F.col("need") - F.col("got")).alias("need"), F.col("upto").alias("behind"),
                F.concat("rules", F.array(F.struct("behind", "upto", F.col("need").alias("most")))).alias("rules"),
            )
        )
    e = expected(F.col("_mix.weight"), F.col("t.rate"))
    joined = measured.alias("d").join(state.select("source", "source_size", "target", "rate", "rules").alias("t"), F.expr("_mix.source <=> t.source"))
    joined = joined.select("row", "_mix", "t.*", e.alias("_e"), ranked(F.col("_mix.u"), e).alias("_rank"))
    chosen = F.expr("_e > floor(_e) AND exists(rules, r -> _rank > r.behind AND _rank <= r.upto AND _mix.size <= r.most)")
    copies = F.when(F.col("_mix.size") > 0, F.floor("_e") + chosen.cast("int")).otherwise(0)
    return joined.select("row", F.struct("_mix.size", "source_size", "target", F.col("_e").alias("expected"), copies.cast("int").alias("copies")).alias("_mix"))


def mix(docs: DataFrame, scratch: Scratch, **how) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the columns of docs."""
    planned = plan_mix(docs, scratch, **how)
    return planned.withColumn("copy", F.explode(F.when(F.col("_mix.copies") > 0, F.sequence(F.lit(1), F.col("_mix.copies"))))).select("row.*")
