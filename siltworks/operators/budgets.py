"""Safety limits as relational predicates: no limit depends on how tasks are scheduled."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written
from .policy import Policy


#: Failed containers that are looked up in a set.
FEW = 1000


def running_total(rows: DataFrame, size: str, order: list[str], parts: int = 256) -> DataFrame:
    """``rows`` with ``running``, the sum of ``size`` up to each row in a total order.

    Rows are ranged into ``parts`` slices; within a slice a window sums, and a slice starts from the sums of those before,
    a table of ``parts`` rows. No task sees all rows.
    """
    ranged = rows.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id())
    ranged = written(ranged, "running")
    sums = ranged.groupBy("__part").agg(F.sum(size).alias("__sum"))
    before = sums.select("__part", (F.sum("__sum").over(Window.orderBy("__part")) - F.col("__sum")).alias("__before"))
    own = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return ranged.withColumn("running", F.sum(size).over(own)).join(F.broadcast(before), "__part").withColumn("running", F.col("running") + F.coalesce("__before", F.lit(0))).drop("__part", "__before")


def container_rollup(members: DataFrame, parents: str = "parents", size: str = "size") -> DataFrame:
    """(container_id, member_count, expanded_bytes): direct members, and bytes of the whole subtree."""
    direct = F.element_at(parents, -1)
    each = members.where(F.size(parents) > 0).select(F.explode(parents).alias("container_id"), direct.alias("d"), F.col(size).alias("s"))
    return each.groupBy("container_id").agg(F.sum((F.col("d") == F.col("container_id")).cast("long")).alias("member_count"), F.sum(F.coalesce("s", F.lit(0))).alias("expanded_bytes"))


def over_budget(rollup: DataFrame, containers: DataFrame, policy: Policy) -> DataFrame:
    """(container_id, reason) of the outermost containers whose subtree is too large. containers: (container_id, parents)."""
    over = rollup.where(F.col("expanded_bytes") > policy.max_container_bytes).select("container_id")
    near = over.join(containers, "container_id").select("container_id", F.explode_outer("parents").alias("p"))
    inner = near.join(over.select(F.col("container_id").alias("p")), "p", "left_semi").select("container_id").distinct()
    return over.join(inner, "container_id", "left_anti").withColumn("reason", F.lit("container_size_limit"))


def surviving(rows: DataFrame, failed: DataFrame, parents: str = "parents", stored: bool = False) -> DataFrame:
    """``rows`` with no failed container above them; failed: (container_id), a table that was ``stored`` or one still to be made."""
    few = failed.select("container_id").distinct().limit(FEW + 1).collect() if stored else None
    if few is not None and len(few) <= FEW:  # looked up in a set, without a shuffle
        names = [r["container_id"] for r in few]
        return rows.where(~F.exists(parents, lambda p: p.isin(names))) if names else rows
    f = failed.select(F.col("container_id").alias("__f")).distinct()
    # rows without parents never meet a failed one; by their own names they spread over the tasks, of which one would get them all by their parents
    inner = F.coalesce(F.size(parents) > 0, F.lit(False))
    own = [F.col(c) for c in rows.columns if c in ("container_id", "visit")]
    below = F.xxhash64(*[F.to_json(F.struct(F.col(c))) if c == parents else F.col(c).cast("string") for c in rows.columns if c in (parents, "visit")])
    keyed = rows.withColumn("__inner", inner).withColumn("__row", F.when(inner, below).otherwise(F.xxhash64(*own) if own else F.lit(0).cast("long")))
    hit = keyed.where("__inner").select("__row", F.explode(parents).alias("__p")).join(f, F.col("__p") == F.col("__f"), "left_semi").select(F.lit(True).alias("__inner"), "__row").distinct()
    return keyed.join(hit, ["__inner", "__row"], "left_anti").drop("__inner", "__row")


def run_limits(events: DataFrame, policy: Policy) -> DataFrame:
    """(container_id, visit, reason) of what the run's limits refuse. events: (visit, step, container_id, parents, members, bytes).

    Charges are made in visit order, a refused container's subtree isn't visited, and nothing is given back. Up to the first refusal
    that is a running sum, which no task does alone; from there on it is sequential by nature, and done over light rows in one
    task.
    """
    spark = events.sparkSession
    schema = "container_id string, visit array<long>, reason string"
    total = events.agg(F.sum("members").alias("m"), F.sum("bytes").alias("b")).first()
    if (total["m"] or 0) <= policy.max_members_run and (total["b"] or 0) <= policy.max_run_bytes:
        return spark.createDataFrame([], schema)
    most, room = policy.max_members_run, policy.max_run_bytes
    order = ["visit", "step"]
    summed = running_total(running_total(events, "members", order).withColumnRenamed("running", "all_members"), "bytes", order)
    summed = written(summed.withColumn("at", F.struct(*order)), "charged")
    first = summed.where((F.col("all_members") > most) | (F.col("running") > room)).agg(F.min("at").alias("at"))
    marked = summed.join(F.broadcast(first.withColumnRenamed("at", "first")))
    before = marked.where(F.col("at") < F.col("first")).agg(F.sum("members").alias("m"), F.sum("bytes").alias("b")).first()
    spent = (before["m"] or 0, before["b"] or 0)

    def charge(rows: pd.DataFrame) -> pd.DataFrame:
        n, b = spent
        dead: set[str] = set()
        out = []
        rows = rows.assign(k=[(tuple(v), s) for v, s in zip(rows["visit"], rows["step"])]).sort_values("k")
        for r in rows.itertuples():
            if dead.intersection(r.parents):
                continue
            why = "global_count_limit" if n + r.members > most else "global_size_limit" if b + r.bytes > room else None
            if why:
                owner = r.container_id or (r.parents[-1] if len(r.parents) else None)
                if owner:
                    dead.add(owner)
                out.append((owner, list(r.visit), why))
            else:
                n, b = n + r.members, b + r.bytes
        return pd.DataFrame(out, columns=["container_id", "visit", "reason"])

    tail = marked.where(F.col("at") >= F.col("first")).select(*events.columns)
    return tail.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(charge, schema)
