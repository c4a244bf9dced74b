"""Readers of the formats that studies come in, as DataFrames, and their writers.

All go through Spark's own readers, so paths may lie in any store.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ranklane.operators.digests import lines_digest

#: Names a manifest may have in a study's folder, header spellings, and names that are taken.
MANIFESTS = ("metadata.tsv", "sample-metadata.tsv", "manifest.tsv")
ID_HEADERS = ("sample_id", "sampleid")
PATH_HEADERS = ("filepath", "absolute_filepath")
RESERVED = ("n_counts", "ensembl_id", "input_ids", "length", "cell_id")
#: Small files whose content always counts.
KEY_FILES = ("config.json", "dataset_info.json", "state.json", "tokenizer_config.json", "generation_config.json", "special_tokens_map.json")


class ManifestError(ValueError):
    """A manifest whose header breaks a rule; rows are checked by operators.contracts.manifest_faults."""


def manifest_header(names: list[str]) -> list[str]:
    """Header names in lower case with underscores; sample-id first, state (or disease, renamed) and species present."""
    out = []
    for raw in names:
        key = raw.strip().lstrip("﻿").lower().replace("-", "_").replace(" ", "_")
        key = "sample_id" if key in ID_HEADERS else key
        if not key or not (key[0].isalpha() or key[0] == "_") or not key.replace("_", "a").isalnum() or not key.isascii():
            raise ManifestError(f"column name {raw!r} is not made of letters, digits and underscores")
        if key in RESERVED:
            raise ManifestError(f"column {key!r} is reserved")
        if key in out:
            raise ManifestError(f"column {key!r} occurs twice")
        out.append(key)
    if out[0] != "sample_id":
        raise ManifestError("the first column must be sample-id")
    if "state" not in out:
        if "disease" not in out:
            raise ManifestError("a state column is needed")
        out[out.index("disease")] = "state"
    if "species" not in out:
        raise ManifestError("a species column is needed")
    return out


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A sample manifest, TSV or CSV: comment lines and a #q2:types row skipped, species in lower case, paths left out."""
    sep = "," if path.endswith(".csv") else "\t"
    raw = spark.read.csv(path, sep=sep, header=True, comment="#", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    named = raw.toDF(*manifest_header(raw.columns)).fillna("")
    kept = [c for c in named.columns if c not in PATH_HEADERS]
    first = [c for c in ("sample_id", "state", "species") if c in kept]
    return named.withColumn("species", F.lower("species")).select(*first, *[c for c in kept if c not in first])


def write_manifest(manifest: DataFrame, path: str) -> None:
    """As TSV, sample_id, state and species first."""
    first = ["sample_id", "state", "species"]
    manifest.select(*first, *[c for c in manifest.columns if c not in first]).write.mode("overwrite").csv(path, sep="\t", header=True)


def read_mtx(spark: SparkSession, path: str) -> DataFrame:
    """(row, col, value) of a MatrixMarket coordinate file, 1-based; the size line and comments skipped.

    The size line is the first one that is no comment, so it is told by its place in the file.
    """
    lines = spark.read.text(path).withColumn("at", F.monotonically_increasing_id()).where(~F.startswith("value", F.lit("%")) & (F.trim("value") != ""))
    size = lines.agg(F.min("at").alias("size_at"))
    parts = F.split(F.trim("value"), r"\s+")
    return lines.crossJoin(F.broadcast(size)).where("at > size_at").select(parts[0].cast("bigint").alias("row"), parts[1].cast("bigint").alias("col"), F.coalesce(F.try_element_at(parts, F.lit(3)), F.lit("1")).cast("double").alias("value"))


def entries_per_cell(mtx: DataFrame, n_cells: int) -> DataFrame:
    """(col, n): entries of each column, columns without one included."""
    cells = mtx.sparkSession.range(1, n_cells + 1).withColumnRenamed("id", "col")
    return cells.join(mtx.groupBy("col").agg(F.count("*").alias("n")), "col", "left").fillna(0, ["n"])


def read_numbered(spark: SparkSession, path: str) -> DataFrame:
    """(at, fields): the lines of a headerless TSV with their 1-based number, for barcodes and features.

    Numbers follow from counts of the lines of each part, not from one sorted task.
    """
    lines = spark.read.text(path).withColumns({"part": F.spark_partition_id(), "id": F.monotonically_increasing_id()})
    sizes = lines.groupBy("part").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    at = F.col("before") + F.col("id").bitwiseAND((1 << 33) - 1) + 1
    return lines.join(F.broadcast(sizes), "part").select(at.alias("at"), F.split("value", "\t").alias("fields"))


def read_10x(spark: SparkSession, folder: str, sample_id: str, ext: str = "") -> DataFrame:
    """(sample_id, cell, gene, cnt) of a folder's matrix, barcodes and features; gene ids lose their version."""
    m = read_mtx(spark, f"{folder}/matrix.mtx{ext}")
    genes = read_numbered(spark, f"{folder}/features.tsv{ext}").select(F.col("at").alias("row"), F.substring_index(F.col("fields")[0], ".", 1).alias("gene"))
    cells = read_numbered(spark, f"{folder}/barcodes.tsv{ext}").select(F.col("at").alias("col"), F.col("fields")[0].alias("barcode"))
    j = m.join(genes, "row").join(cells, "col")
    return j.select(F.lit(sample_id).alias("sample_id"), F.concat_ws("_", F.lit(sample_id), "barcode").alias("cell"), "gene", F.col("value").alias("cnt"))


def read_gmt(spark: SparkSession, path: str) -> DataFrame:
    """(term, symbol) of a gene-set library: upper case, weights behind a comma cut off, repeated terms united."""
    parts = F.split("value", "\t")
    rows = spark.read.text(path).where((F.size(parts) >= 3) & (parts[0] != "")).select(parts[0].alias("term"), F.explode(F.slice(parts, F.lit(3), F.size(parts))).alias("g"))
    symbol = F.upper(F.trim(F.split("g", ",")[0]))
    return rows.where(F.trim("g") != "").select("term", symbol.alias("symbol")).distinct()


def read_relation(spark: SparkSession, path: str) -> DataFrame:
    """(source, target, kind, ord) of an ortholog table: ids trimmed and without version, kinds in lower case, blank rows dropped."""
    from ranklane.functions.text import normal_id

    raw = spark.read.csv(path, sep="\t", header=True, comment="#").withColumn("ord", F.monotonically_increasing_id())
    kind = next((c for c in ("orthology_type", "homology_type") if c in raw.columns), None)
    k = F.lower(F.trim(F.coalesce(F.col(kind), F.lit("")))) if kind else F.lit("")
    return raw.select(normal_id(F.col("source_id")).alias("source"), normal_id(F.col("target_id")).alias("target"), k.alias("kind"), "ord").where("source <> '' AND target <> ''")


def read_panel(spark: SparkSession, path: str, organism: str) -> DataFrame:
    """(label, role, gene) of a marker panel in JSON; flat lists are core markers, gates (assign false) are left out."""
    told = json.loads("\n".join(r[0] for r in spark.read.text(path).collect()))  # a panel is one small document
    rows = []
    for label, spec in told.get("types", {}).items():
        if spec.get("assign", True) is False:
            continue
        block = spec.get(organism, spec.get("mouse")) or []
        block = {"core": block} if isinstance(block, list) else {r: block.get(r) or (block.get("anti_markers") if r == "anti" else None) or [] for r in ("core", "support", "anti")}
        rows += [(label, role, str(g)) for role, genes in block.items() for g in genes]
    return spark.createDataFrame(rows, "label string, role string, gene string").distinct()


def with_missing(frames: list[DataFrame], columns: list[str]) -> DataFrame:
    """Inputs put together; text columns that one lacks are empty there."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    for c in columns:
        out = out.withColumn(c, F.coalesce(F.col(c).cast("string"), F.lit(""))) if c in out.columns else out.withColumn(c, F.lit(""))
    return out


def content_fingerprint(spark: SparkSession, path: str, fast: bool = False) -> dict[str, object]:
    """kind, file_count and content_fingerprint_sha256 of a file or a tree.

    A tree's is the SHA-256 of a line for each file in order of the paths within the tree: the path, a zero byte and the content's
    SHA-256. fast: sizes and times stand for the contents of all but KEY_FILES, which are then not read. Lines are sorted and
    joined in parts (digests.lines_digest); a file's content is one row, of 2 GB at most.
    """
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(where):
        raise FileNotFoundError(path)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    if fs.getFileStatus(where).isFile():
        return {"kind": "file", "file_count": 1, "content_fingerprint_sha256": files.select(F.sha2("content", 256).alias("h")).first().h}
    root = fs.makeQualified(where).toString().rstrip("/") + "/"
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    named = files.withColumn("rel", F.substring(plain("path"), len(re.sub("^file:/+", "/", root)) + 1, 1 << 20))
    digest = F.sha2("content", 256)
    told = lambda df, key, h: df.select(F.concat(key, F.lit("\0"), h).alias("line"))
    if fast:
        key = F.concat_ws("|", "rel", F.col("length").cast("string"), F.col("modificationTime").cast("double").cast("string"))
        is_key = F.lower(F.substring_index("rel", "/", -1)).isin(*KEY_FILES)
        lines = told(named.where(is_key), key, digest).unionByName(told(named.where(~is_key), key, F.lit("metadata_only")))
    else:
        lines = told(named, F.col("rel"), digest)
    return {"kind": "directory", "file_count": named.select("rel").count(), "fingerprint_mode": "fast" if fast else "full", "content_fingerprint_sha256": lines_digest(lines, F.col("line"))}


def write_conversion_report(report: DataFrame, unmapped: DataFrame, folder: str, most: int = 50_000) -> None:
    """conversion_report (JSON lines and text, a row for each file and one for all) and conversion_unmapped_genes (TSV).

    report: of keymap.conversion_report(); unmapped: (source_id, symbol, drop_reason, brief_function), of which the first `most` by id are
    written; without any there is no such file.
    """
    report.coalesce(1).write.mode("overwrite").json(f"{folder}/conversion_report.json")
    named = F.coalesce(F.col("file").cast("string"), F.lit("all files"))
    told = F.format_string("%s: %d keys, %d mapped (%.2f %%), %d unmapped, %d targets, %d of them from several keys, %d in the vocabulary", named, "n_input", "n_mapped", "pct_mapped", "n_unmapped", "n_targets", "n_many_to_one", "n_in_vocab")
    report.orderBy(F.col("file").asc_nulls_first()).select(told.alias("value")).coalesce(1).write.mode("overwrite").text(f"{folder}/conversion_report.txt")
    if not unmapped.isEmpty():
        columns = ("source_id", "symbol", "drop_reason", "brief_function")
        kept_rows = unmapped.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in columns]).orderBy("source_id").limit(most)
        kept_rows.coalesce(1).write.mode("overwrite").csv(f"{folder}/conversion_unmapped_genes.tsv", sep="\t", header=True, emptyValue="")


@dataclass(frozen=True)
class Libraries:
    """What a gene-set folder's libraries.json says: labels by name, and the names that a species takes by default."""

    labels: dict[str, str]
    defaults: dict[str, list[str]]

    def default(self, species: str) -> list[str]:
        """Mouse data take the mouse libraries, all others the human ones."""
        return list(self.defaults["mouse" if species.lower().startswith("mouse") else "human"])

    def label(self, name: str) -> str:
        """The library's label, or its name with spaces."""
        return self.labels.get(name) or name.replace("_", " ")


def read_libraries(spark: SparkSession, folder: str) -> Libraries:
    """The libraries.json of a folder; one small document."""
    told = json.loads("\n".join(r[0] for r in spark.read.text(f"{folder}/libraries.json").collect()))
    return Libraries({k: str(v.get("label") or "") for k, v in told.get("libraries", {}).items()}, told["default_by_species"])


def read_default_sets(spark: SparkSession, folder: str, species: str) -> DataFrame:
    """(library, term, symbol) of the libraries that a species takes by default, each a GMT file of its name."""
    out = None
    for name in read_libraries(spark, folder).default(species):
        some = read_gmt(spark, f"{folder}/{name}.gmt").select(F.lit(name).alias("library"), "term", "symbol")
        out = some if out is None else out.unionByName(some)
    if out is None:
        raise ValueError(f"no default library for {species!r}")
    return out


def write_stats(stats: DataFrame, folder: str, top: int = 100) -> None:
    """The statistics table as Parquet and CSV, its significant rows, and its highest and lowest shifts."""
    stats.write.mode("overwrite").parquet(f"{folder}/stats.parquet")
    saved = stats.sparkSession.read.parquet(f"{folder}/stats.parquet")
    out = lambda df, name: df.coalesce(1).write.mode("overwrite").csv(f"{folder}/{name}", header=True)
    out(saved.orderBy(F.desc("sig"), F.desc("mean_shift"), "fdr"), "stats.csv")
    out(saved.where("sig = 1").orderBy(F.desc("mean_shift"), "gene"), "significant.csv")
    out(saved.orderBy(F.desc("mean_shift"), "gene").limit(top), "top_positive.csv")
    out(saved.orderBy("mean_shift", "gene").limit(top), "top_negative.csv")
