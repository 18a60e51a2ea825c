"""Exact duplicates through two passes of a Bloom filter: only rows that may repeat are shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .bits import cells, filter_bits, filter_words, may_hold

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def without_space(text: Column) -> Column:
    """Delete every character of ``[\\x20\\x09-\\x0D]``."""
    for char in SPACE:
        text = F.replace(text, F.lit(char), F.lit(""))
    return text


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when they are after deleting white space; null counts as empty. Of equal texts the
    longest original stays, then the smallest id (null last), then any one of wholly equal rows. Other
    columns are not read, and an empty table gives an empty one.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = written(
        docs.select(
            F.col(key).alias("doc_id"),
            F.char_length(whole).alias("chars"),
            F.sha2(without_space(whole), 256).alias("text_sha256"),
            # Stored with the row: another scan may be cut otherwise and would number anew.
            F.monotonically_increasing_id().alias("row"),
        ),
        "digests",
    )
    bits = filter_bits(rows.count())
    # First pass: the cells that more than one row hits.
    hit = rows.select(F.explode(F.array(*cells(bits, "text_sha256"))).alias("cell")).groupBy("cell").count()
    repeated = filter_words(hit.filter("count > 1").select("cell"), bits)
    # Second pass: a row whose cells are both hit again may have an equal.
    marked = rows.withColumn("maybe", may_hold(repeated, bits, "text_sha256"))
    once = marked.filter(~F.col("maybe")).select(
        "doc_id",
        F.col("doc_id").alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"),
        "text_sha256",
    )
    maybe = marked.filter("maybe").drop("maybe")
    order = F.struct(-F.col("chars"), F.col("doc_id").isNull(), "doc_id", "row")
    best = maybe.groupBy("text_sha256").agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("group_size"))
    # From a table of its own the join has a shuffle on either side, which adaptive execution may split.
    best = written(best, "groups")
    groups = maybe.join(best, "text_sha256").select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"),
        "text_sha256",
    )
    return once.unionByName(groups)
