"""Run documents and observer transcripts as JSON, with closed schemas."""

from __future__ import annotations

import argparse
import json
import re
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from strataline.sources.workloads import KINDS

# Schema versions and field names of the documents
RUN_VERSION, TRANSCRIPT_VERSION = "g1e-1", "g2a-1"
TOP = {"schema_version", "source_schema_version", "equality_channel", "run_metadata", "operations", "summary"}
OPERATION = {"index", "class", "events", "read_count", "write_count"}
LABEL = "query_equality_class"
EVENT = {"seq", "operation", "slot_id"}
METADATA, CONFIG = {"family", "seed", "config"}, {"block_capacity", "pgm_epsilon"}
SUMMARY = {"operation_count", "query_count", "merge_count", "total_reads", "total_writes", "distinct_slots"}
FORBIDDEN = {"keys", "values", "key", "value", "item_rank", "hit_item_rank", "hit_block_rank", "block_rank", "physical_block_offset", "placement", "permutation", "prp", "slot_of", "locate", "probe", "probes", "target", "oracle", "truth", "script", "result", "verification", "region_start", "backing_store", "level_keys"}


class ContractError(ValueError):
    pass


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise ContractError(what)


def _count(x: object) -> bool:
    return isinstance(x, int) and not isinstance(x, bool) and x >= 0


def load(path: str) -> dict:
    """Reads a document; what is wrong with it is said in one ContractError."""
    try:
        found = json.loads(Path(path).read_text())
    except OSError as e:
        raise ContractError(f"can't read {path}: {e}") from e
    except ValueError as e:
        raise ContractError(f"{path} is no JSON: {e}") from e
    _need(isinstance(found, dict), f"{path} holds no object")
    return found


def dumps(document: dict) -> str:
    return json.dumps(document, indent=2) + "\n"


def write(document: dict, path: str) -> None:
    Path(path).write_text(dumps(document))


def _check_events(op: dict, where: str) -> None:
    _need(isinstance(op["events"], list), f"{where}: events must be a list")
    for i, e in enumerate(op["events"]):
        _need(isinstance(e, dict) and set(e) == EVENT, f"{where}: event {i} must have {sorted(EVENT)}")
        _need(_count(e["seq"]) and e["seq"] == i, f"{where}: event {i} is numbered {e['seq']!r}")
        _need(e["operation"] in ("READ", "WRITE") and _count(e["slot_id"]), f"{where}: event {i} is malformed")
    for name, kind in (("read_count", "READ"), ("write_count", "WRITE")):
        _need(_count(op[name]) and op[name] == sum(e["operation"] == kind for e in op["events"]), f"{where}: {name} differs from the events")


def check_run(doc: dict) -> None:
    """A run document that a transcript may be taken from."""
    _need(doc.get("schema_version") == RUN_VERSION, "not a run document")
    _need(isinstance(doc.get("final"), dict) and doc["final"].get("correctness_ok") is True, "the run is not verified")
    _need(isinstance(doc.get("operations"), list), "no operations")
    for i, op in enumerate(doc["operations"]):
        where = f"operation {i}"
        _need(isinstance(op, dict) and {"index", "kind", "events", "read_count", "write_count"} <= set(op), f"{where} lacks a field")
        _need("class" not in op and op["kind"] in KINDS, f"{where}: no such kind")
        _need(_count(op["index"]) and op["index"] == i, f"{where} is numbered {op['index']!r}")
        _check_events({k: op[k] for k in ("events", "read_count", "write_count")}, where)


def summarise(operations: list[dict]) -> dict:
    slots = {e["slot_id"] for o in operations for e in o["events"]}
    return {
        "operation_count": len(operations), "query_count": sum(o["class"] == "QUERY" for o in operations), "merge_count": sum(o["class"] == "MERGE" for o in operations),
        "total_reads": sum(o["read_count"] for o in operations), "total_writes": sum(o["write_count"] for o in operations), "distinct_slots": len(slots),
    }


def transcript(run: dict) -> dict:
    """Only what an observer sees, field by field; keys, values and answers are never copied."""
    check_run(run)
    operations = [{"index": o["index"], "class": o["kind"], "events": [{k: e[k] for k in ("seq", "operation", "slot_id")} for e in o["events"]], "read_count": o["read_count"], "write_count": o["write_count"]} for o in run["operations"]]
    config = {k: run["config"][k] for k in sorted(CONFIG)}
    return {"schema_version": TRANSCRIPT_VERSION, "source_schema_version": run["schema_version"], "equality_channel": "M0", "run_metadata": {"family": run["family"], "seed": run["seed"], "config": config}, "operations": operations, "summary": summarise(operations)}


def check_transcript(doc: dict) -> None:
    """The closed schema: no field more or less, labels on all queries (M1) or on none (M0), a true summary."""
    _need(set(doc) == TOP, f"a transcript has {sorted(TOP)}")
    _need(doc["schema_version"] == TRANSCRIPT_VERSION and doc["equality_channel"] in ("M0", "M1"), "no such version or channel")
    _need(isinstance(doc["run_metadata"], dict) and set(doc["run_metadata"]) == METADATA and set(doc["run_metadata"]["config"]) == CONFIG, "run metadata is malformed")
    for i, op in enumerate(doc["operations"]):
        where = f"operation {i}"
        _need(isinstance(op, dict) and set(op) - {LABEL} == OPERATION, f"{where} must have {sorted(OPERATION)}")
        _need(_count(op["index"]) and op["index"] == i and op["class"] in KINDS, f"{where} is malformed")
        _check_events(op, where)
        wanted = doc["equality_channel"] == "M1" and op["class"] == "QUERY"
        _need((LABEL in op) == wanted, f"{where}: a label is missing or out of place")
        _need(not wanted or (isinstance(op[LABEL], str) and re.fullmatch("QClass[0-9]+", op[LABEL]) is not None), f"{where}: a label must be opaque")
    _need(doc["summary"] == summarise(doc["operations"]) and all(_count(x) for x in doc["summary"].values()), "the summary differs from the operations")


def label(doc: dict, labels: dict[int, str]) -> dict:
    """The transcript with equality labels; they must cover its queries, and nothing else."""
    check_transcript(doc)
    _need(set(labels) == {o["index"] for o in doc["operations"] if o["class"] == "QUERY"}, "labels must cover all queries and only them")
    out = doc | {"equality_channel": "M1", "operations": [o | ({LABEL: labels[o["index"]]} if o["index"] in labels else {}) for o in doc["operations"]]}
    check_transcript(out)
    return out


def forbidden_fields(document: object) -> list[str]:
    """Field names at any depth that no observer's document may have."""
    allowed = TOP | OPERATION | {LABEL} | EVENT | METADATA | CONFIG | SUMMARY
    found: set[str] = set()

    def walk(x: object) -> None:
        if isinstance(x, dict):
            found.update(x)
            for v in x.values():
                walk(v)
        elif isinstance(x, list):
            for v in x:
                walk(v)

    walk(document)
    return sorted(n for n in found if n in FORBIDDEN or n not in allowed)


def tables(spark: SparkSession, doc: dict) -> tuple[DataFrame, DataFrame]:
    """operations and events of a transcript, as ``operators.observe`` takes them."""
    check_transcript(doc)
    ops = [(o["index"], o["class"], o["read_count"], o["write_count"]) for o in doc["operations"]]
    events = [(o["index"], o["class"], e["seq"], e["operation"], e["slot_id"]) for o in doc["operations"] for e in o["events"]]
    return spark.createDataFrame(ops, "op_index long, class string, read_count long, write_count long"), spark.createDataFrame(events, "op_index long, class string, seq long, operation string, slot_id long")


def metrics(spark: SparkSession, doc: dict) -> dict:
    """The metrics document; labels never change a number."""
    from strataline.operators import observe

    ops, events = tables(spark, doc)
    queries = ops.where("class = 'QUERY'")
    asked = events.where("class = 'QUERY'")
    rows = lambda df, *by: [r.asDict() for r in df.orderBy(*by).collect()]
    per = observe.operation_metrics(ops, events)
    return {
        "source_schema_version": doc["source_schema_version"], "equality_channel": "M0", "summary": doc["summary"], "operations": rows(per, "op_index"),
        "slots": rows(observe.slot_lists(ops, events), "op_index"), "distinct_slot_histogram": rows(observe.histogram(per.where("class = 'QUERY'"), "distinct_slots"), "key"),
        "operation_kinds": rows(observe.class_counts(ops), "class"), "hotness_histogram": rows(observe.histogram(observe.hotness(asked), "query_count"), "key"),
        "adjacency_histogram": rows(observe.histogram(observe.steps(asked), "diff"), "key"),
        "trace_length_histogram": rows(observe.histogram(per.where("class = 'QUERY'"), "event_count"), "key"),
        "pairs": observe.pair_summary(queries, asked).first().asDict(), "hotness": rows(observe.hotness(asked), "slot_id"),
        "adjacency": rows(observe.adjacency(asked), "op_index"), "merges": rows(observe.merge_metrics(ops, events), "op_index"),
    }


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description="Take the transcript of a run document, and its metrics.")
    p.add_argument("run")
    p.add_argument("--transcript")
    p.add_argument("--metrics")
    a = p.parse_args(argv)
    try:
        doc = transcript(load(a.run))
    except ContractError as e:
        print(e, file=sys.stderr)
        return 2
    if a.transcript:
        write(doc, a.transcript)
    if a.metrics:
        write(metrics(SparkSession.builder.getOrCreate(), doc), a.metrics)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
