"""Finding a study's sample folders and manifest by listing, on any store that Hadoop's file systems reach.

Listings go two levels down at most and no file is opened, so a study costs one listing for each of its folders.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ranklane.sources.readers import MANIFESTS, ManifestError, read_manifest

#: What the files of a sample may be called, and the folder that may hold them.
MATRIX = ("matrix.mtx.gz", "matrix.mtx")
BARCODES = ("barcodes.tsv.gz", "barcodes.tsv", "barcode.tsv.gz", "barcode.tsv")
FEATURES = ("features.tsv.gz", "features.tsv", "feature.tsv.gz", "feature.tsv")
FILTERED = "filtered_feature_bc_matrix"
#: Columns that a sample folder's name gives.
FROM_FOLDERS = ("state", "genotype", "time", "replicate", "sample_id")
#: Sample names of at least three parts (time, condition, replicate) are regular.
REGULAR = re.compile(r"[^/\\]+-[^/\\]+-[^/\\]+")
SAMPLES = "sample string, label string, path string, matrix string, barcodes string, features string, regular boolean"


@dataclass(frozen=True)
class Entry:
    name: str
    path: str
    folder: bool


def entries(spark: SparkSession, path: str) -> list[Entry]:
    """What a folder holds, by name; nothing if it does not exist or is a file."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(where) or not fs.getFileStatus(where).isDirectory():
        return []
    # the name as listed, not where a link leads
    found = [Entry(s.getPath().getName(), f"{path.rstrip('/')}/{s.getPath().getName()}", s.isDirectory()) for s in fs.listStatus(where)]
    return sorted(found, key=lambda e: e.name)


def folders(spark: SparkSession, path: str, exclude: str | None = None) -> list[Entry]:
    """The folders in a folder, without hidden ones and the excluded one."""
    return [e for e in entries(spark, path) if e.folder and not e.name.startswith(".") and (exclude is None or e.path != exclude.rstrip("/"))]


def sample_files(spark: SparkSession, path: str) -> dict[str, str | None] | None:
    """Where a sample folder's matrix, barcodes and features are; None if it is no sample folder.

    The filtered folder inside decides where it has a matrix; a matrix alone makes a sample.
    """
    here = entries(spark, path)
    inner = next((e for e in here if e.folder and e.name == FILTERED), None)
    for held in ([entries(spark, inner.path)] if inner else [here]):
        files = {e.name: e.path for e in held if not e.folder}
        first = {kind: next((files[n] for n in names if n in files), None) for kind, names in (("matrix", MATRIX), ("barcodes", BARCODES), ("features", FEATURES))}
        if first["matrix"]:
            return first
    return None


def sample_folders(spark: SparkSession, root: str, exclude: str | None = None) -> list[tuple[str, dict[str, str | None]]]:
    """(path, files) of the samples of a study: folders in the root, else folders of those (experiments), else the root itself."""
    root = root.rstrip("/")
    if exclude and exclude.rstrip("/") == root:
        return []

    def inside(path: str) -> list[tuple[str, dict[str, str | None]]]:
        return [(e.path, f) for e in folders(spark, path, exclude) if (f := sample_files(spark, e.path))]

    direct = inside(root)
    if direct:
        return direct
    nested = [s for e in folders(spark, root, exclude) for s in inside(e.path)]
    if nested:
        return nested
    own = sample_files(spark, root)
    return [(root, own)] if own else []


def sample_label(path: str, root: str) -> str:
    """A sample's name, its experiment's before it where there is one between root and sample."""
    path, root = path.rstrip("/"), root.rstrip("/")
    if path.startswith(root + "/"):
        return path[len(root) + 1 :].replace("/", "-")
    return path.rsplit("/", 1)[-1]


def sample_table(spark: SparkSession, root: str, exclude: str | None = None) -> DataFrame:
    """(sample, label, path, matrix, barcodes, features, regular): a row for each sample folder."""
    rows = [(p.rsplit("/", 1)[-1], sample_label(p, root), p, f["matrix"], f["barcodes"], f["features"], bool(REGULAR.match(p.rsplit("/", 1)[-1]))) for p, f in sample_folders(spark, root, exclude)]
    return spark.createDataFrame(rows, SAMPLES)


def study_root(spark: SparkSession, path: str, exclude: str | None = None) -> str:
    """The folder whose study a path means: itself, if it is or directly holds samples; else what its samples' paths share."""
    path = path.rstrip("/")
    found = [p for p, _ in sample_folders(spark, path, exclude)]
    if not found or found == [path] or any(p.rsplit("/", 1)[0] == path for p in found):
        return path
    if len(found) == 1:
        return found[0].rsplit("/", 1)[0]
    shared = []
    for parts in zip(*(p.split("/") for p in found)):
        if len(set(parts)) > 1:
            break
        shared.append(parts[0])
    return "/".join(shared)


def find_manifest(spark: SparkSession, root: str, explicit: str | None = None) -> str | None:
    """The manifest's path: the explicit one, which must exist, or the only one of MANIFESTS in the root; None without one."""
    if explicit is not None and explicit.strip().lower() not in ("", "none", "null"):
        where = spark._jvm.org.apache.hadoop.fs.Path(explicit)
        fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(where) or not fs.getFileStatus(where).isFile():
            raise ManifestError(f"no manifest at {explicit}")
        return explicit
    here = {e.name: e.path for e in entries(spark, root) if not e.folder}
    found = [here[name] for name in MANIFESTS if name in here]
    if len(found) > 1:
        raise ManifestError(f"more than one manifest in {root}: {', '.join(p.rsplit('/', 1)[-1] for p in found)}")
    return found[0] if found else None


def study_manifest(spark: SparkSession, root: str, explicit: str | None = None) -> DataFrame | None:
    """The study's manifest, read; None without one."""
    path = find_manifest(spark, root, explicit)
    return read_manifest(spark, path) if path else None


def label_columns(spark: SparkSession, root: str | None, extra: Sequence[str] = ()) -> list[str]:
    """Columns that may hold a study's labels, in order and once each: the extra ones, the manifest's, those that folders' names give where
    there are samples, and two usual ones. A manifest that cannot be read gives none."""
    names = [str(x).strip() for x in extra]
    if root is not None:
        try:
            manifest = study_manifest(spark, root)
            names += manifest.columns if manifest is not None else []
        except ManifestError:
            pass
        names += FROM_FOLDERS if sample_folders(spark, root) else ()
    return list(dict.fromkeys(n for n in (*names, "cell_type", "state") if n))


@dataclass(frozen=True)
class Layout:
    root: str
    samples: tuple[str, ...]
    kind: str  # experiment: samples in the root; study: in experiments' folders; sample: the root is one; none
    manifest: str | None
    manifest_error: str | None
    irregular: tuple[str, ...]  # names that say nothing by themselves; they matter without a manifest

    def told(self, shown: int = 8) -> str:
        """One line for people."""
        if not self.samples:
            return "no samples found"
        hint = f"; manifest error: {self.manifest_error}" if self.manifest_error else f"; manifest {self.manifest}" if self.manifest else f"; name folders time-condition-replicate ({self.irregular[0]})" if self.irregular else ""
        return f"{len(self.samples)} sample(s) in one {self.kind}: {', '.join(self.samples[:shown])}{', …' if len(self.samples) > shown else ''}{hint}"


def layout(spark: SparkSession, path: str, exclude: str | None = None) -> Layout:
    """What lies under a path: the study's root, its samples and its manifest."""
    root = study_root(spark, path, exclude)
    found = [p for p, _ in sample_folders(spark, root, exclude)]
    names = tuple(p.rsplit("/", 1)[-1] for p in found)
    kind = "none" if not found else "sample" if found == [root] else "experiment" if all(p.rsplit("/", 1)[0] == root for p in found) else "study"
    manifest, error = None, None
    try:
        manifest = find_manifest(spark, root)
    except ManifestError as e:
        error = str(e)
    return Layout(root, names, kind, manifest and manifest.rsplit("/", 1)[-1], error, tuple(n for n in names if not REGULAR.match(n)))
