"""Vocabularies: word counts with an index by first appearance or by frequency."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import exploded
from .position import total_order

# Leading entries of a frequency vocabulary.
FIELD_SPECIALS = ("<unk>", "<pad>", "<sos>", "<eos>")


def word_counts(df: DataFrame, tokens: str) -> DataFrame:
    """Occurrences per word; equal words are added up before the shuffle."""
    return exploded(df, [], tokens, "token").groupBy("token").agg(F.count(F.lit(1)).alias("count"))


def target_vocab_counts(tables: list[DataFrame], tokens: str) -> DataFrame:
    """Word counts over one token column of several tables."""
    merged = tables[0].select(tokens)
    for other in tables[1:]:
        merged = merged.unionByName(other.select(tokens))
    return word_counts(merged, tokens)


def vocab_by_first_seen(df: DataFrame, tokens: str, row_id: str = "row_id") -> DataFrame:
    """``token, index, count``; indexes follow the first appearance by row and place."""
    flat = exploded(df, [F.col(row_id).alias("__row")], tokens, "token", "__pos")
    # Row and place as one number: its minimum is kept in a hash table, that of a pair would need a sort.
    place = F.col("__row").cast("decimal(20,0)") * F.lit(2**31).cast("decimal(10,0)") + F.col("__pos")
    seen = flat.groupBy("token").agg(F.min(place).alias("__first"), F.count(F.lit(1)).alias("count"))
    ranked = total_order(seen, ["__first"], "index")
    return ranked.select("token", "index", "count")


def vocab_by_frequency(
    df: DataFrame, tokens: str, min_count: int = 2, specials: tuple[str, ...] = FIELD_SPECIALS, lower: bool = True
) -> DataFrame:
    """``token, index, count``; specials first, then words by falling count, equal counts by text."""
    words = exploded(df, [], tokens, "token")
    if lower:
        words = words.select(F.lower("token").alias("token"))
    counts = words.groupBy("token").agg(F.count(F.lit(1)).alias("count"))
    counts = counts.filter((F.col("count") >= min_count) & ~F.col("token").isin(*specials))
    counts = counts.withColumn("__falling", -F.col("count"))
    # Bounds are whole (count, word) pairs: words of one count and one beginning are dealt to many tasks as well.
    ranked = total_order(counts, ["__falling", "token"], "index")
    ranked = ranked.select("token", (F.col("index") + len(specials)).alias("index"), "count")
    if not specials:
        return ranked
    entries = [F.struct(F.lit(s).alias("token"), F.lit(i).cast("long").alias("index"), F.lit(0).cast("long").alias("count"))
               for i, s in enumerate(specials)]
    head = df.sparkSession.range(1).select(F.inline(F.array(*entries)))
    return head.unionByName(ranked)
