"""Sharding by proportional stratified interleaving.

Within each source, rows are ranked in a seeded shuffle (by a hash of seed and id); a row's fractional rank
(2 * rank - 1) / (2 * rows of its source) puts all sources on one scale, on which each is spread evenly. Cut into equal
spans, the scale gives shards each of which has every source's share to within one row; sorting by fractional rank
within a shard interleaves the sources.

A source may hold most of the rows, so ranks are found in two steps: within (source, hash bucket), plus the counts of
the source's earlier buckets, as many as ``ROWS`` a bucket need; no task sees a whole source. A shard's order is a window over the shard, whose size is
set by the number of shards.

Defined cases: a null source is a source of its own; a null id hashes as the empty string; equal hashes are ordered by id, and
repeated rows take ranks of their own, in either order; an empty table gives no rows; more shards than rows leave
shards empty; extra columns don't matter.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, positional

SHARDS = 64
#: Rows that a bucket of a source holds on average.
ROWS = 250_000
SEED = 17


def assign_shards(rows: DataFrame, shards: int = SHARDS, seed: int = SEED, id_column: str = "doc_id", source_column: str = "source") -> DataFrame:
    """(id, source, shard, position) of every row; position counts from 0 in the shard's interleaved order."""
    light = pick(rows, id_column, source_column).toDF("id", "source")
    light = light.withColumn("h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string"))))
    digits = max(2, math.ceil(math.log(max(1, rows.count() / ROWS), 16)))
    light = light.withColumn("b", F.substring("h", 1, digits)).withColumn("stratum", F.concat(F.when(F.col("source").isNull(), "0").otherwise("1"), F.coalesce(F.col("source").cast("string"), F.lit(""))))
    counts = light.groupBy("stratum", "b").agg(F.count("*").alias("c"))
    own = Window.partitionBy("stratum")
    counts = counts.select("stratum", "b", (F.sum("c").over(own.orderBy("b")) - F.col("c")).alias("before"), F.sum("c").over(own).alias("n"))
    inner = Window.partitionBy("stratum", "b").orderBy("h", "id")
    ranked = light.withColumn("k", F.row_number().over(inner)).join(counts, ["stratum", "b"])
    odd = 2 * (F.col("before") + F.col("k")) - 1
    ranked = ranked.select("id", "source", "stratum", (F.expr("before + k")).alias("rank"), "n", odd.alias("odd"))
    # whole-number division, exact at any size
    ranked = ranked.withColumn("shard", F.expr(f"cast((cast(odd as decimal(38,0)) * {shards}) div (2 * n) as int)"))
    order = Window.partitionBy("shard").orderBy(F.expr("cast(odd as double) / (2 * n)"), "stratum", "rank")
    return ranked.select(F.col("id").alias(id_column), F.col("source").alias(source_column), "shard", (F.row_number().over(order) - 1).cast("long").alias("position"))


def write_shards(rows: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED, id_column: str = "doc_id", source_column: str = "source") -> None:
    """Write ``rows`` as one folder a shard, each sorted in its interleaved order. Repeated ids take their places in either order."""
    plain, (i, source) = positional(rows, id_column, source_column)
    # the k-th row of an id takes the k-th place of that id
    same = Window.partitionBy("i", "s").orderBy(F.monotonically_increasing_id())
    keyed = plain.withColumns({"i": i, "s": source}).withColumn("k", F.row_number().over(same))
    place = assign_shards(rows, shards, seed, id_column, source_column).toDF("p_i", "p_s", "shard", "position")
    place = place.withColumn("p_k", F.row_number().over(Window.partitionBy("p_i", "p_s").orderBy("shard", "position")))
    joined = keyed.join(place, F.col("i").eqNullSafe(F.col("p_i")) & F.col("s").eqNullSafe(F.col("p_s")) & (F.col("k") == F.col("p_k")))
    taken = {c.lower() for c in rows.columns}
    name = next(n for n in ("shard", "shard_of", *(f"shard_{x}" for x in range(len(taken) + 1))) if n not in taken)
    out = joined.repartition(shards, "shard").sortWithinPartitions("shard", "position").select(*plain.columns, "shard").toDF(*rows.columns, name)
    out.write.partitionBy(name).parquet(path)


def oracle(shards: int = SHARDS, seed: int = SEED) -> str:
    """The same as DuckDB SQL over ``documents``, whose ids are unique."""
    return f"""
WITH ranked AS (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(concat_ws(':', '{seed}', doc_id::VARCHAR)), doc_id) AS r, count(*) OVER (PARTITION BY source) AS n FROM documents),
placed AS (SELECT *, ((2 * r - 1) * {shards}) // (2 * n) AS shard FROM ranked)
SELECT doc_id, source, shard::INTEGER AS shard, row_number() OVER (PARTITION BY shard ORDER BY (2 * r - 1)::DOUBLE / (2 * n), source NULLS FIRST, r) - 1 AS position FROM placed
"""
