"""Digests of sets of any size, the same whatever the order and the partitions, and the approvals that rest on them."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Mapping, Sequence
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ranklane.functions.text import normal_id

#: Bytes of text that a run hands on in one row.
RUN = 1 << 20
#: An approval's decisions, and their other names.
DECISIONS = ("stop", "curated_bridge", "sensitivity_best_of_n", "mark_non_critical")
OTHER_NAMES = {"a": "stop", "b": "curated_bridge", "c": "sensitivity_best_of_n", "sensitivity": "sensitivity_best_of_n", "d": "mark_non_critical"}
#: What makes a request's id, and what of it must equal the current run.
IDENTITY = ("direction", "input_feature_sha256", "manifest_sha256", "converter_git_commit", "mapping_source_sha256", "critical_gene_audit_sha256")
COMPARED = ("direction", "input_feature_sha256", "manifest_sha256", "mapping_source_sha256")


class ApprovalError(ValueError):
    """An approval that does not hold for the run; whatever is missing or differs refuses it."""


def lines_digest(rows: DataFrame, line: Column) -> str:
    """SHA-256 of the distinct lines in byte order, each ended by a newline; nulls are left out, no line gives the empty text's.

    Ranges of lines are sorted apart and joined into rows of RUN bytes; the one task that has to read them one after
    another (SHA-256 allows no other way) streams these.
    """
    lines = rows.select(line.cast("binary").alias("line")).where(F.col("line").isNotNull()).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([b"".join(held)], pa.binary())], names=["part", "number", "text"])

        for batch in batches:
            for x in batch.column(0).to_pylist():
                held.append(x + b"\n")
                size += len(x) + 1
                if size >= RUN:
                    yield out()
                    number, held, size = number + 1, [], 0
        if held:
            yield out()

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = hashlib.sha256()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                state.update(text)
        yield pa.RecordBatch.from_arrays([pa.array([state.hexdigest()])], names=["digest"])

    runs = lines.repartitionByRange("line").sortWithinPartitions("line").mapInArrow(run, "part int, number int, text binary")
    found = runs.repartition(1).sortWithinPartitions("part", "number").select("text").mapInArrow(chain, "digest string").first()
    return found.digest if found else hashlib.sha256().hexdigest()


def tree_digest(rows: DataFrame, line: Column, bits: int = 16) -> str:
    """SHA-256 over a tree of digests of the distinct lines: all work but the last few thousand digests is spread.

    A line belongs to the leaf that the first `bits` bits of its own SHA-256 name; a leaf is the SHA-256 of its lines in
    order, joined by newlines, and 256 leaves that follow each other make one digest of the level above, until one is left.
    Empty leaves are absent, with their numbers told. So adding a line changes one leaf and the digests above it.
    """
    lines = rows.select(line.cast("binary").alias("line")).where(F.col("line").isNotNull()).distinct()
    leaf = F.shiftright(F.conv(F.substring(F.sha2("line", 256), 1, 8), 16, 10).cast("bigint"), 32 - bits)
    level = lines.withColumn("at", leaf).groupBy("at").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("line")), lambda x: F.hex(x)), "\n"), 256).alias("digest"))
    for _ in range(-(-bits // 8)):
        told = F.concat_ws(":", F.col("at").cast("string"), "digest")
        level = level.groupBy(F.shiftright("at", 8).alias("up")).agg(F.array_agg(F.struct("at", told.alias("t"))).alias("ts")).select(F.col("up").alias("at"), F.sha2(F.array_join(F.transform(F.array_sort("ts"), lambda x: x["t"]), "\n"), 256).alias("digest"))
    found = level.first()
    return found.digest if found else hashlib.sha256().hexdigest()


def feature_digest(genes: DataFrame, gene: str) -> str:
    """SHA-256 of a run's distinct input ids: blank ones left out, versions of known kinds of ids cut off."""
    named = genes.select(F.trim(F.col(gene)).alias("g")).where("g <> ''")
    return lines_digest(named, normal_id(F.col("g")))


def canonical(value: Any) -> str:
    """JSON with sorted keys and without spaces: equal values give equal texts."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def request_id(run: Mapping[str, Any]) -> str:
    """The name of a blocked run: a digest of what identifies it; its other fields do not count."""
    return "sha256:" + hashlib.sha256(canonical({k: run.get(k) for k in IDENTITY}).encode()).hexdigest()


def decision_of(record: Mapping[str, Any]) -> str | None:
    told = str(record.get("decision") or record.get("choice") or "").strip().lower()
    return OTHER_NAMES.get(told, told) or None


def approval_request(run: Mapping[str, Any], dropped: Sequence[Mapping[str, Any]], absent: Sequence[Mapping[str, Any]] = (), policy: str | None = None) -> dict[str, Any]:
    """A pending request for a run that lost critical genes; it approves nothing itself.

    dropped: rows of the audit with gene, source_feature, mapping_status, candidates, kinds and critical_set.
    """
    own = {k: run.get(k) for k in IDENTITY} | {"critical_gene_audit_sha256": run.get("critical_gene_audit_sha256") or ""}
    genes = [
        {
            "source_id": r.get("source_feature") or "", "source_symbol": r.get("gene"), "mapping_status": r.get("mapping_status"), "candidate_target_ids": list(r.get("candidates") or ()),
            "candidate_target_id": next(iter(r.get("candidates") or ()), ""), "orthology_types": list(r.get("kinds") or ()), "critical_set": r.get("critical_set"),
        }
        for r in dropped
    ]
    return {"status": "pending", "request_id": request_id(own), "blocked_run": own, "blocked_genes": genes, "critical_gene_not_in_raw_input": [{"gene": r.get("gene"), "critical_set": r.get("critical_set")} for r in absent], "policy": policy}


def checked_request(request: Mapping[str, Any]) -> Mapping[str, Any]:
    """The blocked run of a pending request whose id is that of its run; anything else is refused."""
    if str(request.get("status") or "").strip().lower() != "pending":
        raise ApprovalError(f"a request must be pending, not {request.get('status')!r}")
    run = request.get("blocked_run")
    if not isinstance(run, Mapping):
        raise ApprovalError("the request has no blocked_run")
    if str(request.get("request_id") or "").strip() != request_id(run):
        raise ApprovalError("the request's id is not that of its run")
    return run


def decided(request: Mapping[str, Any], decision: str, approved_by: str, reason: str, overlay_sha256: str | None = None, bridge: Mapping[str, str] | None = None, excluded: Sequence[str] = (), user: str | None = None) -> dict[str, Any]:
    """The record of a decision on a pending request; a rejection is a record that no run accepts.

    A curated bridge needs the overlay's digest and a pair of ids, its own or the first blocked gene's first candidate.
    """
    run = checked_request(request)
    who, why = (approved_by or "").strip(), (reason or "").strip()
    if not who or not why:
        raise ApprovalError("a decision needs a name and a reason")
    if user and user.strip() != who:
        raise ApprovalError(f"{who!r} is not the user {user!r}")
    kind = decision_of({"decision": decision})
    genes = list(request.get("blocked_genes") or ())
    record = {"request_id": request_id(run), "approved_by": who, "reason": why, "blocked_run": dict(run), "blocked_genes": genes}
    if kind == "reject":
        return record | {"status": "rejected", "decision": "reject"}
    if kind not in DECISIONS:
        raise ApprovalError(f"unknown decision {decision!r}")
    record |= {"status": "approved", "decision": kind, "explicitly_excluded": [x.strip() for x in excluded if x.strip()]}
    if kind == "curated_bridge":
        first = genes[0] if genes else {}
        pair = dict(bridge or {"source_id": first.get("source_id") or "", "source_symbol": first.get("source_symbol") or "", "target_id": first.get("candidate_target_id") or ""})
        if not overlay_sha256:
            raise ApprovalError("a curated bridge needs its overlay's digest")
        if not pair.get("source_id") or not pair.get("target_id"):
            raise ApprovalError("a curated bridge needs a source and a target id")
        record |= {"curated_overlay": {"sha256": overlay_sha256}, "approved_bridge": {k: str(pair.get(k) or "") for k in ("source_id", "target_id", "source_symbol", "target_symbol")}}
    return record


def approved(record: Mapping[str, Any], run: Mapping[str, Any], overlay_sha256: str | None = None) -> str:
    """The decision of an approved record that holds for the current run; whatever differs is an error."""
    if str(record.get("status") or "").strip().lower() != "approved":
        raise ApprovalError(f"the record is {record.get('status')!r}, not approved")
    blocked = record.get("blocked_run")
    if not isinstance(blocked, Mapping):
        raise ApprovalError("the record has no blocked_run")
    if str(record.get("request_id") or "").strip() != request_id(blocked):
        raise ApprovalError("the record's id is not that of its run")
    for key in COMPARED:
        if blocked.get(key) != run.get(key):
            raise ApprovalError(f"{key} differs: {blocked.get(key)!r} was approved, the run has {run.get(key)!r}")
    kind = decision_of(record)
    if kind not in DECISIONS:
        raise ApprovalError(f"unknown decision {kind!r}")
    if kind == "curated_bridge":
        told = str((record.get("curated_overlay") or {}).get("sha256") or "").strip()
        current = str(overlay_sha256 or run.get("overlay_sha256") or "").strip()
        if not told or told != current:
            raise ApprovalError("the overlay is not the approved one")
    return kind
