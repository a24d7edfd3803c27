"""Distributed connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def _least(pairs: DataFrame) -> DataFrame:
    """``pairs`` (u, v) with ``m``, the least of u and its neighbours. Minima are combined before the shuffle, and a hub's
    neighbours meet its one minimum in a join whose large partitions may be split: no task has to hold a neighbourhood."""
    low = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m")
    return pairs.join(low, F.col("u") == F.col("w")).select("u", "v", F.least("u", "m").alias("m"))


def _mark(edges: DataFrame):
    """Number of edges and the exact sum of their 64-bit hashes: equal for equal sets of edges."""
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.sum(F.xxhash64("v", "u").cast("decimal(20,0)"))).first()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns u, v of one orderable type); root is the component's least node.

    Each round rewires every neighbourhood to its least member: large-star for the greater neighbours, small-star for the
    others. The rounds are logarithmic in the longest path. Each round's edges are written to the shared folder, so that
    lineage stays short and a lost executor costs one round; those of the round before are deleted. Null ends and loops
    are ignored; repeated edges count once; no edges give no rows.
    """
    e = edges.where("u is not null and v is not null and u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = stored(e, "edges")
    mark = _mark(e)
    while mark[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        ends = F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        star = _least(down).select(F.explode(ends).alias("x")).select("x.u", "x.v").where("u != v").distinct()
        old, e = e, stored(star, "edges")
        discard(old)
        last, mark = mark, _mark(e)
        if last == mark:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
