"""From counts to ranked lists: counts (cell, gene, cnt) and vocabulary (gene, token, med) to (cell, pos, token, len).

Long rows, one for each entry of a list; windows are partitioned by cell, whose entries are bounded by the
vocabulary, and the vocabulary side is as small as there are genes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def medians(counts: DataFrame) -> DataFrame:
    """(gene, med): the median of a gene's counts over the cells that have it."""
    return counts.where("cnt > 0").groupBy("gene").agg(F.percentile("cnt", F.lit(0.5)).alias("med"))


def vocabulary(tokens: DataFrame, medians: DataFrame) -> DataFrame:
    """Genes that have both a token and a median."""
    return tokens.join(medians, "gene").select("gene", "token", "med")


def normalise(counts: DataFrame, vocab: DataFrame, target: float = 10_000.0, parts: int | None = None) -> DataFrame:
    """(cell, token, w): a count over its cell's sum of counts in the vocabulary, times the target, over the gene's median.

    Cells without such counts give no rows; counts outside the vocabulary do not enter the sum.
    parts: into how many parts cells are dealt, once for this and for rank().
    """
    known = counts.join(vocab, "gene")
    known = known.repartition(parts, "cell") if parts else known
    total = F.sum("cnt").over(Window.partitionBy("cell"))
    return known.select("cell", "token", (F.col("cnt") / total * target / F.col("med")).alias("w"))


def rank(weights: DataFrame, most: int = 2048) -> DataFrame:
    """(cell, pos, token, len): positive weights in falling order, equal ones by token, at most `most` of a cell."""
    w = Window.partitionBy("cell")
    ranked = weights.where("w > 0").select("cell", "token", F.row_number().over(w.orderBy(F.desc("w"), "token")).alias("rn"), F.count("*").over(w).alias("n"))
    return ranked.where(F.col("rn") <= most).select("cell", (F.col("rn") - 1).alias("pos"), "token", F.least("n", F.lit(most)).cast("bigint").alias("len"))


def to_lists(encoded: DataFrame) -> DataFrame:
    """(cell, ids): each cell's keys as one array, best first."""
    return encoded.groupBy("cell").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]).alias("ids"))


def from_lists(lists: DataFrame) -> DataFrame:
    """(cell, pos, token, len) from (cell, ids)."""
    return lists.select("cell", F.size("ids").cast("bigint").alias("len"), F.posexplode("ids").alias("pos", "token")).select("cell", "pos", "token", "len")


def cap_per_file(cells: DataFrame, most: int) -> DataFrame:
    """The first `most` passing cells of each file, in their order; files keep their own count."""
    passing = cells.where(F.col("filter_pass") == 1) if "filter_pass" in cells.columns else cells
    return passing.withColumn("_rn", F.row_number().over(Window.partitionBy("file").orderBy("cell_ord"))).where(F.col("_rn") <= most).drop("_rn")


def shard_numbers(file_counts: list[tuple[str, int]], most: int) -> dict[str, int]:
    """Each file's shard: a new one begins with the file after which the running count has reached `most`.

    One entry for each input file, on the driver.
    """
    out, shard, running = {}, 0, 0
    for name, n in file_counts:
        out[name] = shard
        running += n
        if running >= most:
            shard, running = shard + 1, 0
    return out
