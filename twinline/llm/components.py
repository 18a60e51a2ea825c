"""Connected components of a distributed graph by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..session import written


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("low")).withColumn("low", F.least("u", "low"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("low"))
    moved = down.join(least, "u").filter("v > low").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return moved.unionByName(least.select("u", F.col("low").alias("v")))


def _stored(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """``edges``, written, and their number and a digest of them, taken while they are written."""
    seen = Observation()
    marked = edges.observe(seen, F.count(F.lit(1)).alias("rows"), F.bit_xor(F.xxhash64("u", "v")).alias("digest"))
    stored = written(marked, "edges")
    return stored, (seen.get.get("rows"), seen.get.get("digest"))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, root`` for every node of ``edges(u, v)``; a root is the smallest node of its component.

    Null ends and loops are left out. Each round keeps one row per edge at most and is written to the
    shared folder, so lineage stays short and no component ever meets in one task or on the driver.
    """
    edges, mark = _stored(
        edges.filter("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    for _ in range(max_rounds):
        # Of equal edges that the large star leaves the last step keeps one.
        edges, after = _stored(_small(_large(edges)).distinct())
        if after == mark:
            roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        mark = after
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
