"""A global shuffle into shards in two passes, with SQL functions only.

First, seeded hashes scatter all records over buckets that fit in memory, one shuffle that Spark keeps on disk. Then
each bucket is put into the order of a Fisher-Yates permutation and written. The buckets in a row are one random order
of all records; shards are equal parts of it, so their counts are at most one apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_dir, written
from .decontaminate import free_name

SHARDS = 24
BUCKET_BYTES = 32 << 20
# Small tables are dealt into so many buckets all the same, for as many tasks.
LEAST_BUCKETS = 64
SEED = 13
# Permutations of so many neighbouring buckets are drawn in one task, in the buckets' order.
DRAWN_TOGETHER = 1024


def _permutations(cells: DataFrame, buckets: int, seed: int) -> DataFrame:
    """``bucket, start, order``: the rows of the buckets before, and a permutation of the numbers of its own rows.

    Spark's ``shuffle`` is Fisher-Yates; its generator is seeded per partition. Here partition and place follow from
    the bucket's number alone, so reruns draw the same permutations on any cluster.
    """
    counts = cells.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    # A row per bucket, 16 bytes each.
    earlier = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = written(counts.select("bucket", "n", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start")), "buckets")
    home = F.expr(f"int(bucket div {DRAWN_TOGETHER})")
    dealt = starts.repartitionById(buckets // DRAWN_TOGETHER + 1, home).sortWithinPartitions("bucket")
    return written(dealt.select("bucket", "start", F.shuffle(F.sequence(F.lit(0), F.col("n") - 1), seed).alias("order")), "orders")


def shuffle_to_shards(
    docs: DataFrame,
    text: str = "text",
    shards: int = SHARDS,
    place: Column | None = None,
    path: str | None = None,
    seed: int = SEED,
    bucket_bytes: int = BUCKET_BYTES,
) -> tuple[DataFrame, str, str]:
    """Write all rows of ``docs`` in a seeded random order as Parquet below ``path``, a folder per shard; returns the written
    table and the names of its columns for the shard, from 0, and the slot in it, gapless from 0.

    ``place`` tells all rows apart and is the same in every scan, as file and row number do. Without it the rows are
    written first and numbered there. Any column may be null, ids may repeat and rows may be equal: only the place decides
    where a row goes, so no key, text or source is hot. Counts of shards are at most one apart; with fewer rows than
    shards some stay empty, and an empty table gives an empty one. Files of a shard are in slot order each. Reruns over
    the same files agree.
    """
    spark = docs.sparkSession
    if place is None:
        docs = written(docs, "records")
        place = F.struct("_metadata.file_name", "_metadata.row_index")
    shard, slot = free_name(docs, "shard"), free_name(docs, "slot")
    cell, draw, at = free_name(docs, "bucket"), free_name(docs, "draw"), free_name(docs, "at")
    rows, size = docs.agg(F.count(F.lit(1)), F.sum(F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8)).first()
    buckets = max(LEAST_BUCKETS, -(-(size or 0) // bucket_bytes))
    bucket = F.pmod(F.xxhash64(F.lit(seed), place), F.lit(buckets))
    orders = _permutations(docs.select(bucket.alias("bucket")), buckets, seed)
    own, start, order = (free_name(docs, f"own_{c}") for c in orders.columns)
    orders = orders.toDF(own, start, order)
    scattered = docs.select("*", bucket.alias(cell), F.xxhash64(F.lit(seed + 1), place).alias(draw))
    drawn = scattered.withColumn(at, F.row_number().over(Window.partitionBy(cell).orderBy(draw)))
    # Both sides are dealt by bucket; a permutation is read in place, never copied to its rows.
    found = drawn.join(orders, F.col(cell) == F.col(own)).select(
        *docs.columns, (F.col(start) + F.element_at(order, F.col(at))).alias(at)
    )
    numbered = found.withColumn(shard, F.expr(f"int(`{at}` * {shards} div {max(rows, 1)})"))
    first = F.expr(f"(`{shard}` * {max(rows, 1)}L + {shards - 1}) div {shards}")
    numbered = numbered.withColumn(slot, F.col(at) - first).drop(at)
    path = path or shared_dir(spark, "shards")
    numbered.sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)
    return spark.read.schema(numbered.schema).parquet(path), shard, slot


def sharded(docs: DataFrame, place: Column | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every row, read from the written shards.

    The size is that of the text in UTF-8, null as none, plus 8; the checksum is that of the text, null as empty.
    """
    out, shard, slot = shuffle_to_shards(docs.select(key, text), text, place=place)
    whole = F.coalesce(F.col(text), F.lit(""))
    return out.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(whole).cast("long") + 8).alias("size"),
        F.crc32(whole.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col(shard).cast("int").alias("shard"),
        F.col(slot).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
