"""Studies' folders, raw results, digests and approvals by value."""

from __future__ import annotations

import gzip
import hashlib
import os
import pickle
import subprocess  # noqa: S403  a class that a raw file must not reach
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ranklane.operators import digests
from ranklane.sources import rawshifts, readers, runs, studies


def sample(folder, matrix="matrix.mtx", more=("barcodes.tsv", "features.tsv")):
    folder.mkdir(parents=True)
    for name in (matrix, *more):
        (folder / name).write_text("")
    return str(folder)


def test_samples_in_the_root(spark, tmp_path):
    a, b = sample(tmp_path / "1w-Ctrl-R1"), sample(tmp_path / "2w-Dis-R1", "matrix.mtx.gz", ())
    (tmp_path / ".hidden").mkdir()
    sample(tmp_path / "loom")
    sample(tmp_path / "exp" / "deeper")  # samples in the root go before those in experiments
    rows = studies.sample_table(spark, str(tmp_path), exclude=f"{tmp_path}/loom").orderBy("path").collect()
    assert [(r.sample, r.label, r.path, r.matrix, r.barcodes) for r in rows] == [("1w-Ctrl-R1", "1w-Ctrl-R1", a, f"{a}/matrix.mtx", f"{a}/barcodes.tsv"), ("2w-Dis-R1", "2w-Dis-R1", b, f"{b}/matrix.mtx.gz", None)]
    assert studies.study_root(spark, f"{tmp_path}/") == str(tmp_path)
    assert studies.layout(spark, str(tmp_path), f"{tmp_path}/loom").kind == "experiment"


def test_samples_in_experiments(spark, tmp_path):
    sample(tmp_path / "A" / "1w-Ctrl-R1")
    sample(tmp_path / "B" / "odd" / studies.FILTERED)
    (tmp_path / "B" / "empty" / studies.FILTERED).mkdir(parents=True)
    (tmp_path / "B" / "empty" / "matrix.mtx").write_text("")  # the filtered folder decides
    rows = {r.label: (r.sample, r.matrix, r.regular) for r in studies.sample_table(spark, str(tmp_path)).collect()}
    assert rows == {"A-1w-Ctrl-R1": ("1w-Ctrl-R1", f"{tmp_path}/A/1w-Ctrl-R1/matrix.mtx", True), "B-odd": ("odd", f"{tmp_path}/B/odd/{studies.FILTERED}/matrix.mtx", False)}
    told = studies.layout(spark, str(tmp_path))
    assert (told.root, told.kind, told.manifest, told.irregular) == (str(tmp_path), "study", None, ("odd",))
    assert told.told() == "2 sample(s) in one study: 1w-Ctrl-R1, odd; name folders time-condition-replicate (odd)"
    # a folder above a single experiment means the experiment
    assert studies.study_root(spark, f"{tmp_path}/A") == f"{tmp_path}/A" and studies.sample_label(f"{tmp_path}/A", f"{tmp_path}/A/") == "A"


def test_root_is_a_sample_or_nothing(spark, tmp_path):
    own = sample(tmp_path / "one")
    assert [p for p, _ in studies.sample_folders(spark, own)] == [own] and studies.layout(spark, own).kind == "sample"
    assert studies.sample_folders(spark, own, exclude=own) == [] and studies.sample_folders(spark, f"{tmp_path}/none") == []
    (tmp_path / "bare").mkdir()
    assert studies.layout(spark, f"{tmp_path}/bare").told() == "no samples found"
    outer = tmp_path / "outer"
    sample(outer / "x" / "1w-C-1")
    assert studies.study_root(spark, str(outer)) == f"{outer}/x"


def test_links_keep_their_names(spark, tmp_path):
    sample(tmp_path / "full" / "1w-Ctrl-R1")
    (tmp_path / "view").mkdir()
    os.symlink(tmp_path / "full" / "1w-Ctrl-R1", tmp_path / "view" / "linked")
    assert studies.study_root(spark, f"{tmp_path}/view") == f"{tmp_path}/view"
    assert [r.path for r in studies.sample_table(spark, f"{tmp_path}/view").collect()] == [f"{tmp_path}/view/linked"]


def test_manifest(spark, tmp_path):
    assert studies.find_manifest(spark, str(tmp_path)) is None and studies.study_manifest(spark, str(tmp_path)) is None
    (tmp_path / "manifest.tsv").write_text("sample-id\tdisease\tspecies\ns1\tctrl\tHuman\n")
    assert studies.find_manifest(spark, str(tmp_path), "none") == f"{tmp_path}/manifest.tsv"
    assert [tuple(r) for r in studies.study_manifest(spark, str(tmp_path)).collect()] == [("s1", "ctrl", "human")]
    (tmp_path / "metadata.tsv").write_text("x")
    with pytest.raises(readers.ManifestError, match="more than one"):
        studies.find_manifest(spark, str(tmp_path))
    assert "more than one" in studies.layout(spark, str(tmp_path)).manifest_error
    assert studies.find_manifest(spark, str(tmp_path), f"{tmp_path}/manifest.tsv").endswith("manifest.tsv")
    with pytest.raises(readers.ManifestError, match="no manifest"):
        studies.find_manifest(spark, str(tmp_path), f"{tmp_path}/absent.tsv")


def test_label_columns(spark, tmp_path):
    assert studies.label_columns(spark, None, (" a ", "", "state", "a")) == ["a", "state", "cell_type"]
    sample(tmp_path / "1w-Ctrl-R1")
    assert studies.label_columns(spark, str(tmp_path)) == ["state", "genotype", "time", "replicate", "sample_id", "cell_type"]
    (tmp_path / "manifest.tsv").write_text("sample-id\tdisease\tspecies\tdonor\ns1\tctrl\tHuman\td\n")
    assert studies.label_columns(spark, str(tmp_path), ("x",)) == ["x", "sample_id", "state", "species", "donor", "genotype", "time", "replicate", "cell_type"]
    (tmp_path / "manifest.tsv").write_text("wrong\n")
    assert studies.label_columns(spark, str(tmp_path))[0] == "state"


def test_runs(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        runs.read_seed_positions(spark, str(tmp_path))
    for seed in (3, 12):
        (tmp_path / f"seed{seed}").mkdir()
        with gzip.open(tmp_path / f"seed{seed}" / runs.POSITIONS, "wt") as f:
            f.write(f"chain,token,sum_norm_pos,n_cells\nc,1,0.5,{seed}\np1,2,0.25,4\n")
    (tmp_path / "seedless").mkdir()
    assert sorted(map(tuple, runs.read_seed_positions(spark, str(tmp_path)).collect())) == [(3, "c", 1, 0.5, 3), (3, "p1", 2, 0.25, 4), (12, "c", 1, 0.5, 12), (12, "p1", 2, 0.25, 4)]
    assert runs.chain_roles({"configured": "c", "chain_tokens": {"c": [1], "p1": [2], "p2": [3]}}) == ("c", ["p1", "p2"])
    assert runs.chain_roles({"configured": "c", "placebos": [], "chain_tokens": {"c": [1], "p1": [2]}}) == ("c", [])
    assert runs.read_statistics(spark, str(tmp_path)) is None
    (tmp_path / runs.STATISTICS).mkdir()
    (tmp_path / runs.STATISTICS / "a.csv").write_text("Cell,Shift\n1,2\n")
    assert runs.read_statistics(spark, str(tmp_path)) is None
    (tmp_path / runs.STATISTICS / "b.csv").write_text("Gene,Gene_name,Shift_to_goal_end\n7,A,0.5\n")
    assert [tuple(r) for r in runs.read_statistics(spark, f"{tmp_path}/").collect()] == [(7, "A", 0.5)]


def test_columns():
    assert runs.toward_column(["x", "shift_toward_NF", "shift_toward_Ctrl"]) == "shift_toward_Ctrl"
    assert runs.toward_column(["shift_toward_NF", "shift_toward_A"]) == "shift_toward_NF"
    assert runs.group_column(["a", "b"], "b", ("a",)) == "b" and runs.group_column(["a", "b"], None, ("c", "b", "a")) == "b"
    for wrong in (lambda: runs.toward_column(["shift"]), lambda: runs.group_column(["a"], "z", ("a",)), lambda: runs.group_column(["a"], None, ("z",))):
        with pytest.raises(ValueError):
            wrong()


def test_raw_results(spark, tmp_path):
    first = defaultdict(list, {((5, 7), rawshifts.CELL): [0.5, -0.25], ((5, 7), 9): [1.0], (5, rawshifts.CELL): [(0.1, 0.2, 0.3)], (8, 9): []})
    (tmp_path / "b_raw.pickle").write_bytes(pickle.dumps(first))
    (tmp_path / "a_raw.pickle").write_bytes(pickle.dumps({(5, 6): [0.75], ((6,), 5): [2.0], (5, rawshifts.CELL): [1.5]}))
    (tmp_path / "notes.txt").write_text("no")
    cell = rawshifts.read_raw(spark, str(tmp_path))
    assert cell.rdd.getNumPartitions() == 2
    assert sorted(map(tuple, cell.collect())) == [("a_raw.pickle", [5], rawshifts.CELL, 0, [1.5]), ("b_raw.pickle", [5], rawshifts.CELL, 0, [0.1, 0.2, 0.3]), ("b_raw.pickle", [5, 7], rawshifts.CELL, 0, [0.5]), ("b_raw.pickle", [5, 7], rawshifts.CELL, 1, [-0.25])]
    anchored = rawshifts.read_raw(spark, str(tmp_path), "gene", 5)
    assert sorted(map(tuple, anchored.collect())) == [("a_raw.pickle", [5], "6", 0, [0.75]), ("a_raw.pickle", [5], rawshifts.CELL, 0, [1.5]), ("b_raw.pickle", [5], rawshifts.CELL, 0, [0.1, 0.2, 0.3])]
    assert rawshifts.read_raw(spark, str(tmp_path), "gene").count() == 7
    with pytest.raises(ValueError, match="measured"):
        rawshifts.read_raw(spark, str(tmp_path), "both")


def test_raw_results_refuse_classes(spark, tmp_path):
    (tmp_path / "x_raw.pickle").write_bytes(pickle.dumps({(5, rawshifts.CELL): [subprocess.run]}))
    with pytest.raises(Exception, match=r"may not hold subprocess\.run"):
        rawshifts.read_raw(spark, str(tmp_path)).collect()
    (tmp_path / "none").mkdir()
    with pytest.raises(Exception, match="no file ending"):
        rawshifts.read_raw(spark, f"{tmp_path}/none").collect()


def test_digests_of_sets(spark, monkeypatch):
    lines = sorted({f"gene {i * 7919 % 5000}" for i in range(3000)} | {"é", "日本"})
    want = hashlib.sha256("".join(f"{x}\n" for x in sorted(lines, key=str.encode)).encode()).hexdigest()
    monkeypatch.setattr(digests, "RUN", 500)
    trees = set()
    for parts, rows in ((1, lines), (7, lines[::-1] + lines[:50] + [None])):
        df = spark.createDataFrame([(x,) for x in rows], "x string").repartition(parts)
        assert digests.lines_digest(df, F.col("x")) == want
        trees |= {digests.tree_digest(df, F.col("x")), digests.tree_digest(df, F.col("x"), 8)}
    assert len(trees) == 2  # one for each width
    assert digests.tree_digest(df.where("x <> 'é'"), F.col("x")) not in trees
    none = df.limit(0)
    assert digests.lines_digest(none, F.col("x")) == digests.tree_digest(none, F.col("x")) == hashlib.sha256().hexdigest()


def test_feature_digest(spark):
    df = spark.createDataFrame([(" ENSG01.3 ",), ("ENSG01",), ("",), ("  ",), (None,), ("tp53.1",)], "g string")
    assert digests.feature_digest(df, "g") == hashlib.sha256(b"ENSG01\ntp53.1\n").hexdigest()


RUN = {"direction": "mouse_to_human", "input_feature_sha256": "f", "manifest_sha256": "m", "converter_git_commit": "c0", "mapping_source_sha256": "s", "critical_gene_audit_sha256": "a", "overlay_sha256": "o", "model": "human"}
DROPPED = [{"gene": "Pou5f1", "source_feature": "ENSM1", "mapping_status": "many2many", "candidates": ("ENSG1", "ENSG2"), "kinds": ["x"], "critical_set": "oskm"}]


def test_approval():
    request = digests.approval_request(RUN, DROPPED, [{"gene": "Klf4", "critical_set": "oskm"}])
    text = '{"converter_git_commit":"c0","critical_gene_audit_sha256":"a","direction":"mouse_to_human","input_feature_sha256":"f","manifest_sha256":"m","mapping_source_sha256":"s"}'
    assert request["request_id"] == "sha256:" + hashlib.sha256(text.encode()).hexdigest() == digests.request_id({**dict(reversed(RUN.items())), "model": "other"})
    assert request["blocked_genes"][0]["candidate_target_id"] == "ENSG1" and request["status"] == "pending"
    for told, kind in (("D", "mark_non_critical"), ("sensitivity", "sensitivity_best_of_n"), ("STOP", "stop"), ("B", "curated_bridge")):
        record = digests.decided(request, told, "jo", "because", overlay_sha256="o")
        assert digests.approved(record, RUN) == kind
        assert digests.approved(record, {**RUN, "converter_git_commit": "c1"}) == kind  # told in the id, not compared
        for key in digests.COMPARED:
            with pytest.raises(digests.ApprovalError, match=key):
                digests.approved(record, {**RUN, key: "other"})
    assert record["approved_bridge"]["target_id"] == "ENSG1"
    with pytest.raises(digests.ApprovalError, match="overlay"):
        digests.approved(record, RUN, overlay_sha256="changed")
    for key in digests.IDENTITY:  # a record whose run was altered
        with pytest.raises(digests.ApprovalError, match="id"):
            digests.approved({**record, "blocked_run": {**record["blocked_run"], key: "x"}}, RUN)


def test_refused_approvals():
    request = digests.approval_request(RUN, DROPPED)
    with pytest.raises(digests.ApprovalError, match="pending"):
        digests.approved(request, RUN)
    with pytest.raises(digests.ApprovalError, match="rejected"):
        digests.approved(digests.decided(request, "reject", "jo", "no"), RUN)
    for how, why in (({"approved_by": " "}, "name"), ({"reason": ""}, "reason"), ({"user": "al"}, "user"), ({"decision": "maybe"}, "unknown"), ({"decision": "B"}, "overlay")):
        with pytest.raises(digests.ApprovalError, match=why):
            digests.decided(request, **{"decision": "stop", "approved_by": "jo", "reason": "r", **how})
    with pytest.raises(digests.ApprovalError, match="target"):
        digests.decided(digests.approval_request(RUN, []), "B", "jo", "r", overlay_sha256="o")
    with pytest.raises(digests.ApprovalError, match="blocked_run"):
        digests.checked_request({"status": "pending"})
    with pytest.raises(digests.ApprovalError, match="id"):
        digests.checked_request({**request, "request_id": "sha256:0"})
    record = digests.decided(request, "stop", "jo", "r")
    with pytest.raises(digests.ApprovalError, match="unknown"):
        digests.approved({**record, "decision": "perhaps"}, RUN)
    with pytest.raises(digests.ApprovalError, match="blocked_run"):
        digests.approved({k: v for k, v in record.items() if k != "blocked_run"}, RUN)
