"""A whole run with phases that survive interruption, and its command line."""

from __future__ import annotations

import argparse
import json
import logging
import logging.handlers
import os
import shutil
import sys
import time

from pyspark.sql import SparkSession

from ..operators.expand import recover
from ..operators.policy import Policy
from ..schema import Outcome
from ..sources import directory
from . import planner, publish, report

VERSION = "0.1.0"
STATE = ".siltworks"
_LOG = logging.getLogger("siltworks")


def _save(path: str, value: dict) -> None:
    report.write_atomically(path, [json.dumps(value, sort_keys=True)])


def run(spark: SparkSession, source: str, destination: str, policy: Policy = Policy()) -> Outcome:
    """Recover ``source`` into ``destination``: discovery, plan, publication, report. A second run resumes or repeats the first.

    Each phase's tables are written whole before the phase counts as done, under the destination's private folder. A saved
    run of another source, policy or version is a conflict.
    """
    directory.admit(source, destination)
    policy.validate()
    state = os.path.join(os.path.abspath(destination), STATE)
    os.makedirs(state, exist_ok=True)
    root_name = os.path.basename(os.path.abspath(source))
    identity = {"fingerprint": directory.fingerprint(spark, source), "kind": "mbox" if os.path.isfile(source) else "directory", "root_name": root_name}
    key = {"source": identity, "policy": policy.fingerprint(), "version": VERSION, "schema": 1}
    meta = os.path.join(state, "run.json")
    saved = json.load(open(meta)) if os.path.exists(meta) else None
    if saved and {k: saved[k] for k in key} != key:
        raise publish.Conflict("the destination holds a run of another source, policy or version")
    phase = saved["phase"] if saved else "discovery"
    table = lambda name: "file://" + os.path.join(state, name)
    if phase == "discovery":
        _save(meta, key | {"phase": "discovery"})
        for name in ("occurrences", "containers", "blobs", "plan"):
            shutil.rmtree(os.path.join(state, name), ignore_errors=True)
        _LOG.info("discovery")
        found = recover(directory.nodes(directory.inventory(spark, source), most=None if os.path.isfile(source) else policy.max_member_bytes), policy, root_name)
        for name, df in zip(("occurrences", "containers", "blobs"), found):
            df.write.parquet(table(name))
        _LOG.info("plan")
        plan = planner.make_plan(spark.read.parquet(table("occurrences")), policy)
        plan.write.parquet(table("plan"))
        if not planner.clashes(spark.read.parquet(table("plan"))).isEmpty():
            raise publish.Conflict("two contents would have one path")
        _save(meta, key | {"phase": "frozen"})
    elif planner.differs(spark.read.parquet(table("plan")), planner.make_plan(spark.read.parquet(table("occurrences")), policy)):
        raise publish.Conflict("the saved plan isn't what its occurrences give")
    if saved:
        publish.sweep(os.path.abspath(destination))
    plan, containers, blobs = (spark.read.parquet(table(n)) for n in ("plan", "containers", "blobs"))
    _LOG.info("publish")
    done = publish.publish(plan, blobs, os.path.abspath(destination))
    bad = done.where("result = 'conflict'").select("canonical_path").limit(5).collect()
    if bad:
        raise publish.Conflict("not overwritten: " + ", ".join(r["canonical_path"] for r in bad))
    _LOG.info("report")
    report.write_atomically(os.path.join(destination, "manifest.jsonl"), (x + "\n" for x in report.lines(plan, containers, policy, identity)))
    text, outcome = report.text(plan, containers, policy)
    report.write_atomically(os.path.join(destination, "report.txt"), [text])
    _save(meta, key | {"phase": "complete"})
    return outcome


def logger(path: str | None, verbose: bool) -> None:
    handler = logging.handlers.RotatingFileHandler(path, maxBytes=5 << 20, backupCount=3, encoding="utf-8") if path else logging.StreamHandler(sys.stderr)
    handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
    _LOG.handlers[:] = [handler]
    _LOG.setLevel(logging.DEBUG if verbose else logging.INFO if path else logging.WARNING)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser("siltworks", description="Recover nested content into a deterministic tree with a manifest.")
    p.add_argument("source")
    p.add_argument("destination")
    p.add_argument("--flatten", action="store_true")
    p.add_argument("--pdf-only", action="store_true")
    limits = ("max_depth", "max_members_per_container", "max_members_run", "max_member_bytes", "max_container_bytes", "max_run_bytes", "max_expansion_ratio")
    for name in limits:
        default = getattr(Policy, name)
        p.add_argument("--" + name.replace("_", "-"), type=type(default), default=default)
    p.add_argument("--log-file", default=os.environ.get("SILTWORKS_LOG_FILE"))
    p.add_argument("-v", "--verbose", action="store_true")
    p.add_argument("--version", action="version", version=VERSION)
    a = p.parse_args(argv)
    logger(a.log_file, a.verbose)
    policy = Policy("flatten" if a.flatten else "hierarchy", a.pdf_only, *[getattr(a, n) for n in limits])
    began = time.time()
    try:
        policy.validate()
        directory.admit(a.source, a.destination)
    except ValueError as e:
        print(e, file=sys.stderr)
        return Outcome.USAGE
    try:
        spark = SparkSession.builder.appName("siltworks").getOrCreate()
        outcome = run(spark, a.source, a.destination, policy)
    except publish.Conflict as e:
        print(e, file=sys.stderr)
        return Outcome.CONFLICT
    except KeyboardInterrupt:
        return Outcome.INTERRUPTED
    except Exception:
        _LOG.exception("the run failed")
        return Outcome.FAILED
    _LOG.info("done in %.0f s", time.time() - began)
    for key, value in (("destination", a.destination), ("manifest", os.path.join(a.destination, "manifest.jsonl")), ("report", os.path.join(a.destination, "report.txt")), ("outcome", "partial" if outcome else "complete")):
        print(f"{key}={value}")
    return int(outcome)
