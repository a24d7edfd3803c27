"""Level-synchronous walk over container edges, with the depth and cycle rules of recursive expansion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import written


def walk(edges: DataFrame, roots: DataFrame, max_depth: int) -> DataFrame:
    """(node, depth, reason) of everything reached from ``roots`` (node) over ``edges`` (parent, child), one join a level.

    A child that is among its own ancestors is a "cycle", one that has children itself at ``max_depth`` or below a
    "depth_limit"; neither is opened. reason is null for the others.
    """
    edges = written(edges.where("parent is not null and child is not null"), "edges")
    parents = edges.select(F.col("parent").alias("__p")).distinct()
    level = roots.where("node is not null").select("node", F.lit(0).alias("depth"), F.array().cast(f"array<{roots.schema['node'].dataType.simpleString()}>").alias("above"))
    done = None
    while True:
        has = level.join(parents, level["node"] == parents["__p"], "left").withColumn("opens", F.col("__p").isNotNull())
        why = F.when(F.array_contains("above", F.col("node")), "cycle").when(F.col("opens") & (F.col("depth") >= max_depth), "depth_limit")
        level = written(has.select("node", "depth", "above", "opens", why.alias("reason")), "walk")
        here = level.select("node", "depth", "reason")
        done = here if done is None else done.unionByName(here)
        ahead = level.where("opens and reason is null").join(edges, F.col("node") == F.col("parent"))
        level = ahead.select(F.col("child").alias("node"), (F.col("depth") + 1).alias("depth"), F.concat("above", F.array("node")).alias("above"))
        if level.isEmpty():
            return done
