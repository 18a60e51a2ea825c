"""Mixing sources to target weights: capped water-filling and seeded repetition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

WEIGHTS = (3, 1, 2)
# Rows of a source are ordered by a digest; its first hex digits deal them into so many buckets.
BUCKET_DIGITS = 3


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text, 0 for null: the places where a word begins."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def with_weights(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Give ``source, source_size`` rows the weights in turn, by code points of the name, null last.

    One row per source reaches the ranking task.
    """
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    return sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")))


def water_fill(sources: DataFrame, budget: float, max_epochs: float) -> DataFrame:
    """Add ``target``: shares of ``budget`` by weight, no source above ``max_epochs`` times its size.

    Each round clamps every source above its cap and shares the rest among the others by weight, until
    none is above. A round is one sum over the sources; a source stays clamped, as shares only grow.
    """
    sources = written(sources.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs))), "sources")
    level = None
    while True:
        held = F.lit(False) if level is None else F.col("cap") < level * F.col("weight")
        now = sources.agg(
            F.sum(F.when(held, F.col("cap")).otherwise(0.0)).alias("clamped"),
            F.sum(F.when(~held, F.col("weight")).otherwise(0)).alias("open"),
            F.count_if(held).alias("n"),
        ).first()
        if not now["open"]:
            return sources.withColumn("target", F.col("cap"))
        rest = (budget - now["clamped"], now["open"])
        if level is not None and rest[0] / rest[1] == level:
            share = F.lit(rest[0]) * F.col("weight") / F.lit(float(rest[1]))
            return sources.withColumn("target", F.least(share, F.col("cap")))
        level = rest[0] / rest[1]


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = 1.5,
    max_epochs: float = 2.0,
    seed: int = 7,
    key: str = "doc_id",
) -> DataFrame:
    """A row per document: ``doc_id, size, source_size, target, taken`` and its ``source``.

    The mix takes every document of a source ``floor(target / source_size)`` times whole. What is left
    of the target comes from the source's documents in a seeded order, each once more, and the last of
    them in part, so taken words add up to the whole part of the target. The order is an MD5 of seed
    and id; reruns agree. Null texts and empty ones have size 0 and take 0; a null source is one source;
    wholly equal rows take turns in any order; a table without words gets targets of 0.
    """
    sized = written(
        docs.select(
            F.col(key).alias("doc_id"),
            "source",
            # One key for joins and windows, null included.
            F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("origin"),
            word_count(F.col("text")).alias("size"),
            F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(key).cast("string"), F.lit("")))).alias("draw"),
        ),
        "sizes",
    )
    sources = sized.groupBy("source", "origin").agg(F.sum("size").alias("source_size"))
    total = sized.agg(F.sum("size")).first()[0] or 0
    filled = water_fill(with_weights(sources, weights), total * share, max_epochs).select(
        "origin",
        "source_size",
        "target",
        F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0)).alias("whole"),
    )
    filled = written(
        filled.withColumn("extra", F.floor("target").cast("long") - F.col("whole") * F.col("source_size")), "targets"
    )
    # Words before a document in its source's order: those of earlier buckets, then those in its bucket.
    bucketed = sized.withColumn("bucket", F.substring("draw", 1, BUCKET_DIGITS))
    before = Window.partitionBy("origin").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        bucketed.groupBy("origin", "bucket")
        .agg(F.sum("size").alias("words"))
        .withColumn("start", F.coalesce(F.sum("words").over(before), F.lit(0)))
    )
    plan = starts.join(filled, "origin").drop("words")
    within = (
        Window.partitionBy("origin", "bucket")
        .orderBy("draw", "doc_id", "size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    ranked = bucketed.withColumn("run", F.coalesce(F.sum("size").over(within), F.lit(0)))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("extra") - F.col("start") - F.col("run")))
    return ranked.join(plan, ["origin", "bucket"]).select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        (F.col("whole") * F.col("size") + part).cast("long").alias("taken"),
    )
