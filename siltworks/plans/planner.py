"""The plan: a total order, the first copy of each content, and portable paths without collisions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bounded_path_of, family_of, fold, fold_of, numbered, numbered_of, safe_name_of
from ..operators.policy import Policy
from ..storage import if_small, small_batches, written

ORDER = ("sort_key_json", "occurrence_id")


def publishable(policy: Policy) -> Column:
    wanted = F.col("status").isin("eligible") if policy.pdf_only else F.col("status").isin("eligible", "unprocessed")
    return F.col("digest").isNotNull() & wanted


def canonical(rows: DataFrame, policy: Policy, order: tuple[str, ...] = ORDER) -> DataFrame:
    """(digest, first): the first publishable row of each content. An aggregate with map-side combining, not a window."""
    return rows.where(publishable(policy)).groupBy("digest").agg(F.min(F.struct(*order)).alias("first"))


def assign_directories(paths: DataFrame) -> DataFrame:
    """(parts, resolved) for distinct (parts, first): components that meet on some file system get numbers by appearance.

    Resolved level by level, over distinct folders only: a folder's files aren't seen here.
    """
    spark = paths.sparkSession
    state = written(paths.select("parts", "first", F.array().cast("array<string>").alias("resolved")), "folders")
    depth = state.agg(F.max(F.size("parts"))).first()[0] or 0
    kind = state.schema["first"].dataType.simpleString()

    def number(group: pd.DataFrame) -> pd.DataFrame:
        taken, out = set(), []
        for raw, safe in group.sort_values("rank")[["raw", "safe"]].itertuples(index=False):
            n, name = 0, safe
            while fold(name) in taken:
                n += 1
                name = numbered(safe, n)
            taken.add(fold(name))
            out.append((group["parent"].iloc[0], raw, name))
        return pd.DataFrame(out, columns=["parent", "raw", "name"])

    for k in range(depth):
        here = state.where(F.size("parts") > k).select(F.array_join("resolved", "/").alias("parent"), F.get("parts", F.lit(k)).alias("raw"), "first")
        seen = here.groupBy("parent", "raw").agg(F.min("first").alias("first")).withColumn("safe", safe_name_of(F.col("raw"))["name"])
        seen = seen.withColumn("parent_key", fold_of(F.col("parent"))).withColumn("family", family_of(F.col("safe")))
        many = Window.partitionBy("parent_key", "family")
        seen = written(seen.withColumn("n", F.count("*").over(many)).withColumn("rank", F.row_number().over(many.orderBy("first"))), "components")
        clash = seen.where("n > 1").select("parent_key", "family", "parent", "raw", "safe", "rank").groupBy("parent_key", "family").applyInPandas(number, "parent string, raw string, name string")
        names = written(seen.where("n = 1").select("parent", "raw", F.col("safe").alias("name")).unionByName(clash), "names").select(F.col("parent").alias("__p"), F.col("raw").alias("__r"), "name")
        names = if_small(names)
        joined = state.join(names, (F.array_join("resolved", "/") == F.col("__p")) & (F.get("parts", F.lit(k)) == F.col("__r")), "left")
        state = written(joined.select("parts", "first", F.when(F.col("name").isNotNull(), F.concat("resolved", F.array("name"))).otherwise(F.col("resolved")).alias("resolved")), "folders")
    return state.select("parts", "resolved") if depth else spark.createDataFrame([], f"parts array<string>, first {kind}, resolved array<string>").select("parts", "resolved")


def assign_names(files: DataFrame, order: tuple[str, ...] = ORDER) -> DataFrame:
    """``files`` (folder_key, requested, and the order's columns) with ``chosen``: names that meet in a folder get numbers.

    Trying ``a_1``, ``a_2``, ... never leaves the family of names that differ by numeric tails alone, so families are independent.
    A family with one name, and that without a numeric tail, is numbered by a window; only others are folded in order.
    """
    marked = files.withColumn("__family", family_of(F.col("requested"))).withColumn("__key", fold_of(F.col("requested")))
    own = Window.partitionBy("folder_key", "__family")
    bare = F.regexp_replace("__family", "\0", "")
    marked = marked.withColumn("__simple", (F.min("__key").over(own) == F.max("__key").over(own)) & (F.min("__key").over(own) == F.min(bare).over(own)))
    marked = written(marked, "names-asked")
    simple = marked.where("__simple").withColumn("__n", F.row_number().over(own.orderBy(*order)) - 1).withColumn("chosen", numbered_of(F.col("requested"), F.col("__n"))).drop("__n")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in marked.schema.fields) + ", chosen string"

    def in_turn(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(list(order))
        taken, last, chosen = set(), {}, []
        for name in group["requested"]:
            n = last.get(name, 0)
            got = numbered(name, n) if n else name
            while fold(got) in taken:
                n += 1
                got = numbered(name, n)
            taken.add(fold(got))
            last[name] = n
            chosen.append(got)
        return group.assign(chosen=chosen)

    hard = marked.where("not __simple").groupBy("folder_key", "__family").applyInPandas(in_turn, schema)
    return simple.unionByName(hard).drop("__family", "__key", "__simple")


def folder_parts(policy: Policy) -> Column:
    """Components above a file: its group, and in the hierarchy layout the source and the named steps of the ancestry."""
    group = F.split("detection.group", "/")
    if policy.layout == "flatten":
        return group
    steps = F.filter("ancestry", lambda a: a["kind"] != "archive_member_index")
    names = F.transform(steps, lambda a: F.split(F.replace(F.coalesce(F.nullif(a["original_name"], F.lit("")), a["identifier"]), F.lit("\\"), F.lit("/")), "/"))
    names = F.filter(F.flatten(names), lambda p: ~p.isin("", ".") & (p != F.col("requested")))
    return F.concat(group, F.array("source_root"), names)


def _canonical_paths(rows: DataFrame, policy: Policy) -> DataFrame:
    """(__d, canonical_occurrence_id, canonical_path, __moved) of each content that is published."""
    firsts = canonical(rows, policy)
    head = written(rows.join(firsts.select(F.col("first.occurrence_id").alias("__o"), F.col("digest").alias("__d")), (F.col("occurrence_id") == F.col("__o")) & (F.col("digest") == F.col("__d")), "left_semi").select(*ORDER, "digest", "detection", "ancestry", "source_root", safe_name_of(F.col("generated_name"), "file.bin")["name"].alias("requested")).withColumn("parts", folder_parts(policy)), "canonical")
    folders = assign_directories(head.groupBy("parts").agg(F.min(F.struct(*ORDER)).alias("first")))
    folders = if_small(written(folders, "resolved"))
    placed = head.join(folders, "parts").withColumn("folder_key", fold_of(F.array_join("resolved", "/")))
    named = assign_names(placed.select(*ORDER, "digest", "requested", "resolved", "folder_key", F.size(F.split("detection.group", "/")).alias("protected")))
    path = bounded_path_of(F.concat("resolved", F.array("chosen")), F.col("protected"))
    return written(named.select(F.col("digest").alias("__d"), F.col("occurrence_id").alias("canonical_occurrence_id"), path.alias("canonical_path"), (F.col("chosen") != F.col("requested")).alias("__moved")), "canonical-paths")


def make_plan(rows: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Occurrences with final ``status``, ``canonical_occurrence_id`` and ``canonical_path``.

    The first publishable row of a content in the global order is canonical and gets a path; later ones become "duplicate" and
    point to it; all others stay as they are.
    """
    # names reach Python in small batches, whatever a task's share is
    with small_batches(rows.sparkSession):
        known = _canonical_paths(rows, policy)
    joined = rows.withColumn("__can", F.coalesce(publishable(policy), F.lit(False))).join(known, F.col("__can") & (F.col("digest") == F.col("__d")), "left")
    own = F.col("occurrence_id") == F.col("canonical_occurrence_id")
    status = F.when(F.col("canonical_occurrence_id").isNull(), F.col("status")).when(~own, "duplicate").when(F.col("status") == "eligible", "published").otherwise(F.col("status"))
    before = F.try_element_at("metadata", F.lit("path_adjustments"))
    told = F.map_concat(F.map_filter("metadata", lambda k, _: k != "path_adjustments"), F.create_map(F.lit("path_adjustments"), F.concat_ws(",", F.array_distinct(F.concat(F.filter(F.split(F.coalesce(before, F.lit("")), ","), lambda x: x != ""), F.array(F.lit("name_collision_suffix")))))))
    return joined.withColumn("metadata", F.when(own & F.col("__moved"), told).otherwise(F.col("metadata"))).withColumn("status", status).drop("__can", "__d", "__moved")


def clashes(plan: DataFrame) -> DataFrame:
    """Canonical paths that more than one content has: none, or the plan can't be published."""
    return plan.where("occurrence_id = canonical_occurrence_id").groupBy("canonical_path").agg(F.countDistinct("digest").alias("n")).where("n > 1")


def differs(frozen: DataFrame, again: DataFrame) -> bool:
    """Whether a plan made anew has rows that the frozen one lacks, or lacks some."""
    a, b = (x.select(F.sha2(F.to_json(F.struct(*sorted(x.columns))), 256).alias("row")) for x in (frozen, again))
    # either way at once: rows are made and compared a single time
    both = a.select("row", F.lit(1).alias("n")).unionByName(b.select("row", F.lit(-1).alias("n")))
    with small_batches(frozen.sparkSession):
        return not both.groupBy("row").agg(F.sum("n").alias("n")).where("n != 0").isEmpty()
