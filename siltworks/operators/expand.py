"""Recursive expansion: one job a level, until no container is left.

A level reads its nodes, identifies each, and writes records (what the node is) and children (what it held) to the shared folder; the
children are the next level. A lost executor costs tasks of one level. Limits that belong to one container are checked while it is
read. Those of a subtree are applied before each level: what the next containers say they hold is added to what their ancestors
already hold, a subtree that would be too large fails unread, and the others read no more than their ancestors have room for.
What is left to judge, and the run's limits, are relational, after the last level, and take whole subtrees out again.
"""

from __future__ import annotations

import hashlib
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.identify import Kind, identify
from ..functions.text import canonical_name, compact, sort_key, stable_id
from ..schema import DETECTION, NODE
from ..sources import archives, mail
from ..storage import if_small, small_batches, written
from . import budgets
from .policy import Policy

_RECORD = f"{NODE}, row string, sort_key array<string>, sort_key_json string, occurrence_id string, container_id string, generated_name string, detection {DETECTION}, status string, digest string, size long, member_count long, may_expand boolean, blamed string"
_FAILED_GROUP = "archives/unprocessed"


def _suffix(name: str) -> str:
    return PurePosixPath(name).suffix or ".bin"


def _describe(node: dict, kind: Kind, status: str, reason: str | None) -> dict:
    """The record of a leaf or of a container that failed."""
    key = sort_key(node["source_path"], node["ancestry"], node["name"])
    name, why = canonical_name(node["name"], kind.extension)
    about = dict(node["metadata"] or {})
    if why:
        about["name_normalization_reasons"] = ",".join(why)
    early = node["payload"] is None
    return node | {
        "row": "leaf", "sort_key": key, "sort_key_json": compact(key), "occurrence_id": stable_id("occurrence", *key, *([reason] if early else [])), "generated_name": name,
        "detection": kind._asdict(), "status": status, "reason": reason, "metadata": list(about.items()),
    }


def _kind_of(node: dict, raw: bytes) -> Kind:
    if node["atomic"]:
        return Kind("message/rfc822", "email", ".eml", "parser")
    if mail.is_mbox(raw):
        return Kind("application/mbox", "email", ".mbox", "parser", container="mbox")
    if mail.is_message(raw):
        return Kind("message/rfc822", "email", ".eml", "parser", container="message")
    return identify(raw, node["name"])


def _children(node: dict, kind: Kind, cid: str, digest: str, policy: Policy):
    """Child nodes of a container; raises ``archives.Failed``."""
    raw, here = node["payload"], node["ancestry"]
    base = {"room": None, "room_owner": None, "parents": [*node["parents"], cid], "digests": [*node["digests"], digest], "source_path": node["source_path"]}
    if kind.container in ("mbox", "message"):
        leaves = mail.mbox_leaves(raw, here) if kind.container == "mbox" else mail.message_leaves(raw, [*here, {"kind": "message", "identifier": "message-000001", "original_name": node["name"]}])
        out = []
        for k, leaf in enumerate(leaves):
            if k == policy.max_members_per_container:
                raise archives.Failed("member_count_limit")
            if leaf["payload"] is not None and len(leaf["payload"]) > policy.max_member_bytes:
                raise archives.Failed("member_size_limit")
            out.append(base | leaf | {"visit": [*node["visit"], k], "mail_leaf": True, "metadata": dict(node["metadata"] or {}) | leaf["metadata"], "diagnostics": [*(node["diagnostics"] or []), *leaf["diagnostics"]], "depth": sum(a["kind"] in ("archive", "message") for a in leaf["ancestry"])})
        return out
    out = []
    for k, m in enumerate(archives.members(kind.container, raw, policy, node["room"], node["room_owner"])):
        path = PurePosixPath(m.name.replace("\\", "/"))
        up = [*here, {"kind": "archive", "identifier": node["name"], "original_name": node["name"]}]
        up += [{"kind": "archive_path", "identifier": p, "original_name": p} for p in path.parent.parts if p not in ("", ".")]
        up.append({"kind": "archive_member_index", "identifier": f"member-{m.index:06d}", "original_name": None})
        about = {"archive_member_name": m.name, "archive_member_index": str(m.index), "archive_declared_size": str(m.declared), "archive_compressed_size": "" if m.packed is None else str(m.packed)}
        out.append(base | {"visit": [*node["visit"], k], "name": path.name, "ancestry": up, "metadata": about, "diagnostics": [], "atomic": False, "mail_leaf": False, "payload": m.payload, "reason": None, "depth": node["depth"] + 1})
    return out


def leaf_status(kind: Kind, policy: Policy) -> tuple[str, str | None]:
    """Status and reason of what isn't a container."""
    if kind.reason is not None:
        return "unprocessed", kind.reason
    return ("skipped", "policy_non_pdf") if policy.pdf_only and kind.group != "pdf" else ("eligible", None)


def refusal(depth: int, digest: str, above: list[str], policy: Policy, free: bool = False) -> str | None:
    """Why a container isn't opened, before anything of it is read."""
    if not free and depth >= policy.max_depth:
        return "depth_limit"
    return "cycle" if digest in above else None


def _examine(node: dict, policy: Policy):
    """Records and children of one node."""
    raw = node["payload"]
    node["metadata"] = dict(node["metadata"] or {})
    reason = node["reason"]
    if reason is None and raw is None:
        reason = "unreadable"
    if reason is None and len(raw) > policy.max_member_bytes:
        reason = "member_size_limit"
    if node["mail_leaf"] and node["depth"] > policy.max_depth:
        reason = "depth_limit"
    if reason is not None:
        node["payload"] = None
        yield _describe(node, Kind("application/octet-stream", _FAILED_GROUP, _suffix(node["name"]), "unknown", reason=reason), "unprocessed", reason)
        return
    digest = hashlib.sha256(raw).hexdigest()
    known = {"digest": digest, "size": len(raw)}
    kind = _kind_of(node, raw)
    if kind.container is None:
        yield _describe(node, kind, *leaf_status(kind, policy)) | known
        return
    key = sort_key(node["source_path"], node["ancestry"], node["name"])
    cid = stable_id("container", *key, digest)
    # a mailbox at the top is the source itself: it has no record, no limits and no place among its leaves' ancestors
    top_mbox = kind.container == "mbox" and not node["parents"] and node["depth"] == 0
    try:
        why = refusal(node["depth"], digest, node["digests"], policy, top_mbox)
        if why is not None:
            raise archives.Failed(why)
        found = _children(node, kind, cid, digest, policy)
    except archives.Failed as e:
        bare = node | {"metadata": {}, "diagnostics": []}
        yield _describe(bare, kind._replace(group=_FAILED_GROUP, reason=e.reason), "unprocessed", e.reason) | known | {"row": "failed", "container_id": cid, "blamed": e.owner}
        return
    if top_mbox:
        found = [c | {"parents": [], "digests": []} for c in found]
    else:
        # as it would be recorded if a limit took it out again
        yield _describe(node | {"metadata": {}, "diagnostics": []}, kind._replace(group=_FAILED_GROUP), "unprocessed", None) | known | {"row": "container", "container_id": cid, "member_count": len(found)}
    for c in found:
        raw = c["payload"]
        yield c | {"row": "child", "metadata": list(c["metadata"].items()), "size": None if raw is None else len(raw), "may_expand": raw is not None and archives.may_expand(raw, c["name"])}


def _level(nodes: DataFrame, policy: Policy) -> DataFrame:
    arrow = to_arrow_schema(StructType.fromDDL(_RECORD))

    def run(batches):
        for batch in batches:
            held, size = [], 0
            for node in batch.to_pylist():  # of a batch of bounded size; row by row it takes several times as long
                for row in _examine(node, policy):
                    held.append(row)
                    size += len(row["payload"] or b"") + 500
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(held, arrow)
                        held, size = [], 0
            if held:
                yield pa.RecordBatch.from_pylist(held, arrow)

    with small_batches(nodes.sparkSession):
        return written(nodes.mapInArrow(run, _RECORD), "level")


def _within_budgets(levels: list[DataFrame], level: DataFrame, policy: Policy) -> tuple[DataFrame, DataFrame]:
    """``level`` without the subtrees that would be too large, and with the room that is left to each archive; and what failed."""
    seen = levels[0].where("row = 'child'").select("parents", "size")
    for x in levels[1:]:
        seen = seen.unionByName(x.where("row = 'child'").select("parents", "size"))
    spent = written(budgets.container_rollup(seen).select("container_id", "expanded_bytes"), "spent")
    packed = level.where("may_expand")

    def expect(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                due = archives.declared_bytes(batch.column("payload")[i].as_py(), batch.column("name")[i].as_py())
                yield pa.RecordBatch.from_arrays([batch.column("parents").slice(i, 1), pa.array([due])], ["parents", "due"])

    due = packed.select("parents", "name", "payload").mapInArrow(expect, "parents array<string>, due long")
    due = due.select(F.explode("parents").alias("c"), "due").groupBy("c").agg(F.sum("due").alias("due"))
    over = spent.join(due, F.col("container_id") == F.col("c")).where(F.col("expanded_bytes") + F.col("due") > policy.max_container_bytes)
    with small_batches(level.sparkSession):
        over = written(over.select("container_id", F.lit("container_size_limit").alias("reason")), "over")
    if not over.isEmpty():
        level = budgets.surviving(level, over, stored=True)
    left = packed.select("visit", F.explode("parents").alias("c")).join(if_small(spent), F.col("c") == F.col("container_id"))
    left = left.groupBy("visit").agg(F.min(F.struct((F.lit(policy.max_container_bytes) - F.col("expanded_bytes")).alias("room"), F.col("c").alias("owner"))).alias("x"))
    left = if_small(written(left.select(F.col("visit").alias("at"), "x.room", "x.owner"), "rooms"))
    fields = [c for c in level.columns if c not in ("room", "room_owner")]
    return level.select(*fields).join(left, F.col("visit") == F.col("at"), "left").select(*fields, "room", F.col("owner").alias("room_owner")), over


def as_nodes(rows: DataFrame) -> DataFrame:
    """Level-0 nodes from (visit, name, source_path, payload), and ancestry and reason if there are such columns."""
    have = set(rows.columns)
    fill = {"parents": "array()", "digests": "array()", "depth": "0", "ancestry": "array()", "metadata": "map()", "diagnostics": "array()", "atomic": "false", "mail_leaf": "false", "reason": "null", "room": "null", "room_owner": "null"}
    fields = StructType.fromDDL(NODE).fields
    return rows.select(*[(F.col(f.name) if f.name in have else F.expr(fill[f.name])).cast(f.dataType).alias(f.name) for f in fields])


def recover(rows: DataFrame, policy: Policy = Policy(), source_root: str = "source") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(occurrences, containers, blobs) of everything found in ``rows`` (see ``as_nodes``)."""
    policy.validate()
    level, levels, early, held = as_nodes(rows), [], None, 0
    while True:
        levels.append(_level(level, policy))
        found = levels[-1].where("row = 'child'")
        sums = found.agg(F.count("*").alias("n"), F.sum("size").alias("all"), F.sum(F.when(F.col("may_expand"), F.col("size"))).alias("packed")).first()
        if not sums["n"]:
            break
        held += sums["all"] or 0
        level = found.select(*StructType.fromDDL(NODE).fieldNames(), "may_expand")
        if sums["packed"] and held + sums["packed"] * policy.max_expansion_ratio > min(policy.max_container_bytes, policy.max_run_bytes):
            level, over = _within_budgets(levels, level, policy)
            early = over if early is None else early.unionByName(over)
        level = level.drop("may_expand")
    all_rows = levels[0]
    for x in levels[1:]:
        all_rows = all_rows.unionByName(x)
    light = all_rows.where("row != 'child'").drop("payload", "digests", "room", "room_owner", "may_expand")
    record = written(light, "records")
    # every member and mail leaf charges its ancestors
    charged = record.where("size is not null").select("visit", "parents", "size")
    rollup = written(budgets.container_rollup(record.select("parents", "size")), "rollup")
    opened = record.where("row = 'container'")
    over = budgets.over_budget(rollup, opened.select("container_id", "parents"), policy)
    blamed = record.where("blamed is not null").select(F.col("blamed").alias("container_id"), F.lit("container_size_limit").alias("reason"))
    over = over.unionByName(blamed) if early is None else over.unionByName(blamed).unionByName(early)
    tops = charged.where("size(parents) = 0 ").select("visit", F.lit(0).alias("step"), F.lit(None).cast("string").alias("container_id"), "parents", F.lit(1).cast("long").alias("members"), F.col("size").alias("bytes"))
    leaves = record.where("size is not null and mail_leaf and size(parents) > 0").select("visit", F.lit(0).alias("step"), F.lit(None).cast("string").alias("container_id"), "parents", F.lit(1).cast("long").alias("members"), F.col("size").alias("bytes"))
    direct = record.where("size is not null and not mail_leaf and size(parents) > 0").groupBy(F.element_at("parents", -1).alias("container_id")).agg(F.count("*").alias("members"), F.sum("size").alias("bytes"))
    opens = opened.select("container_id", "visit", "parents").join(direct, "container_id").select("visit", F.lit(1).alias("step"), "container_id", "parents", "members", "bytes")
    events = written(tops.unionByName(leaves).unionByName(opens), "charges")
    run = written(budgets.run_limits(events, policy), "run-limits")
    failed = written(over.unionByName(run.where("container_id is not null").select("container_id", "reason")).dropDuplicates(["container_id"]), "failed")
    lone = run.where("container_id is null").select(F.col("visit").alias("__v"), F.col("reason").alias("__why"))
    if not failed.isEmpty():
        record = written(budgets.surviving(record, failed, stored=True), "survivors")
    why = if_small(failed.select(F.col("container_id").alias("__c"), F.col("reason").alias("__reason")))
    record = record.join(why, F.col("container_id") == F.col("__c"), "left").join(lone, F.col("visit") == F.col("__v"), "left")
    cause = F.coalesce("__reason", "__why", "reason")
    record = record.withColumn("reason", cause).withColumn("detection", F.col("detection").withField("reason", F.coalesce("__reason", "detection.reason")))
    record = record.withColumn("row", F.when(F.col("__reason").isNotNull(), "failed").otherwise(F.col("row")))
    record = record.withColumn("status", F.when(F.col("__why").isNotNull(), "unprocessed").otherwise(F.col("status")))
    record = written(record.drop("__c", "__reason", "__v", "__why"), "kept")
    occurrences = record.where("row != 'container'").select("occurrence_id", "sort_key", "sort_key_json", "source_path", F.lit(source_root).alias("source_root"), "ancestry", F.col("name").alias("original_name"), "generated_name", "detection", "status", "digest", "size", "reason", "diagnostics", "metadata", "depth")
    final = budgets.container_rollup(record.select("parents", "size")).select(F.col("container_id").alias("__c"), "expanded_bytes")
    found = record.where("container_id is not null").join(final, F.col("container_id") == F.col("__c"), "left")
    ok = F.col("row") == "container"
    containers = found.select("container_id", "sort_key", "sort_key_json", F.col("detection.container").alias("kind"), "digest", "source_path", "ancestry", F.when(ok, "expanded").otherwise("unprocessed").alias("status"), F.when(~ok, F.col("reason")).alias("reason"), F.when(ok, F.coalesce("member_count", F.lit(0))).otherwise(0).cast("long").alias("member_count"), F.when(ok, F.coalesce("expanded_bytes", F.lit(0))).otherwise(0).cast("long").alias("expanded_bytes"))
    blobs = all_rows.where("row != 'child' and digest is not null").select("digest", "payload")
    return occurrences, containers, blobs
