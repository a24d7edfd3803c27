"""Counts, manifest and report of a plan."""

from __future__ import annotations

import json
import os
import tempfile
from dataclasses import asdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.policy import Policy
from ..schema import Outcome
from ..storage import small_batches
from .planner import ORDER

TOOL = "siltworks"


def counts(plan: DataFrame) -> DataFrame:
    """(kind, key, n): rows by status, by group and by reason, in one pass; rows without a reason have none to count."""
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("key")) for k, c in (("status", F.col("status")), ("group", F.col("detection.group")), ("reason", F.col("reason")))])
    return plan.select(F.explode(pairs).alias("x")).where("x.key is not null").groupBy("x.kind", "x.key").agg(F.count("*").alias("n"))


def outcome(plan: DataFrame) -> DataFrame:
    return plan.agg(F.when(F.coalesce(F.bool_or(F.col("status") == "unprocessed"), F.lit(False)), "partial").otherwise("complete").alias("outcome"))


def accounting(plan: DataFrame, containers: DataFrame) -> tuple[int, int]:
    """Logical members and bytes of the run: copies count each time, and so do opened containers' own bytes."""
    a = plan.where("size is not null").agg(F.count("*").alias("n"), F.sum("size").alias("b")).first()
    b = containers.where("status = 'expanded'").agg(F.count("*").alias("n")).first()
    return a["n"] + b["n"], a["b"] or 0


def dump(value: dict) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"))


def records(rows: DataFrame, kind: str | None, order: tuple[str, ...] = (), hidden: tuple[str, ...] = ("sort_key_json", "depth")) -> DataFrame:
    """``rows`` with only ``order`` and ``line``, the manifest line of each, made where the rows are."""
    names = [c for c in rows.columns if c not in hidden]
    arrow = pa.schema([*[(c, pa.string()) for c in order], ("line", pa.string())])
    packed = rows.select(*[F.col(c).cast("string").alias(f"o{i}") for i, c in enumerate(order)], *[F.col(c).alias(f"v{i}") for i, c in enumerate(names)])

    def run(batches):
        head = {} if kind is None else {"record_type": kind}
        for batch in batches:
            columns = [batch.column(f"v{i}").to_pylist(maps_as_pydicts="strict") for i in range(len(names))]
            lines = [dump(head | dict(zip(names, values))) for values in zip(*columns)]
            yield pa.RecordBatch.from_arrays([*[batch.column(f"o{i}") for i in range(len(order))], pa.array(lines, pa.string())], schema=arrow)

    return packed.mapInArrow(run, ", ".join([*[f"`{c}` string" for c in order], "line string"]))


def lines(plan: DataFrame, containers: DataFrame, policy: Policy, source: dict[str, str]):
    """Manifest lines: the run, containers, occurrences, each with sorted keys. Made and sorted by the executors, and streamed."""
    yield dump({"record_type": "run", "schema_version": 1, "tool": TOOL, "source": source, "policy": asdict(policy)})
    for kind, rows, order in (("container", containers, ("sort_key_json", "container_id")), ("occurrence", plan, ORDER)):
        for r in records(rows, kind, order).orderBy(*order).select("line").toLocalIterator():
            yield r["line"]


def write_parts(plan: DataFrame, containers: DataFrame, path: str) -> None:
    """The same records as text files in ``path``/container and ``path``/occurrence, whose order is that of the manifest."""
    for kind, rows, order in (("container", containers, ("sort_key_json", "container_id")), ("occurrence", plan, ORDER)):
        with small_batches(rows.sparkSession):
            records(rows, kind, order).orderBy(*order).select("line").write.text(f"{path}/{kind}")


def write_atomically(path: str, parts) -> None:
    """All of ``parts`` under a temporary name beside ``path``, then renamed."""
    handle, temporary = tempfile.mkstemp(dir=os.path.dirname(path))
    try:
        with os.fdopen(handle, "w", encoding="utf-8", newline="\n") as f:
            for p in parts:
                f.write(p)
            f.flush()
            os.fsync(f.fileno())
        os.replace(temporary, path)
    except BaseException:
        os.unlink(temporary)
        raise


def text(plan: DataFrame, containers: DataFrame, policy: Policy) -> tuple[str, Outcome]:
    tally: dict[str, list[tuple[str, int]]] = {"status": [], "group": [], "reason": []}
    for r in counts(plan).collect():  # closed vocabularies: a few dozen rows
        tally[r["kind"]].append((r["key"], r["n"]))
    done = outcome(plan).first()["outcome"]
    members, size = accounting(plan, containers)
    block = lambda k: [f"  {key}: {n}" for key, n in sorted(tally[k])] or ["  none: 0"]
    out = [f"{TOOL} report", f"outcome: {done}", f"layout: {policy.layout}", f"pdf_only: {'true' if policy.pdf_only else 'false'}", f"logical_members: {members}", f"logical_expanded_bytes: {size}"]
    for k in tally:
        out += ["", f"{k} counts:", *block(k)]
    out += ["", "limits:"]
    for label in ("depth", "members_per_container", "members_run", "member_bytes", "container_bytes", "run_bytes"):
        out.append(f"  {label}: {getattr(policy, 'max_' + label)}")
    out.append(f"  expansion_ratio: {policy.max_expansion_ratio:g}")
    return "\n".join(out) + "\n", Outcome.PARTIAL if done == "partial" else Outcome.COMPLETE
