"""Joins: existence filters, positional zips and vocabulary lookups."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lists import Table, fill_nulls, in_slices, with_rest
from ..session import written
from .bits import cells, filter_bits, filter_words, may_hold
from .skew import BROADCAST_BYTES, FREQUENT, collect_small, frequent_values, lookup


def _digest(value: Column) -> Column:
    """128 bits that stand for a value; a missing one has its own."""
    return F.struct(*[F.xxhash64(F.lit(seed), value.isNull(), value).alias(f"d{seed}") for seed in (11, 12)])


def exclude_overlap(
    big: DataFrame, small: DataFrame, columns: tuple[str, ...] = ("input", "output"), is_broadcast: bool | None = None
) -> DataFrame:
    """Drop rows of ``big`` whose every column has its value somewhere in that column of ``small``.

    Columns are tested on their own, not as a pair, and a missing value matches a missing value.

    Values go by 128-bit digests. Rows that a Bloom filter of ``small`` tells apart pass straight through. The distinct
    values of the others, each once per task, are compared with the values of ``small``; the digests found are then
    looked up, so no sentence is ever broadcast or copied. ``is_broadcast`` fixes the kind of that look-up.
    """
    maybe, seen = F.lit(True), {}
    for column in columns:
        seen[column] = written(
            small.select(_digest(F.col(column)).alias("digest"), F.col(column).alias("value")).distinct(), "seen"
        )
        bits = filter_bits(seen[column].count())
        found = seen[column].select(F.explode(F.array(*cells(bits, "digest.d11", "digest.d12"))).alias("cell")).distinct()
        digest = _digest(F.col(column))
        maybe = maybe & may_hold(filter_words(found, bits), bits, digest["d11"], digest["d12"])
    # Read once for each column and once more for the rows themselves.
    some = written(big.filter(maybe), "candidates")
    flagged = some
    for column in columns:
        values = some.select(_digest(F.col(column)).alias("digest"), F.col(column).alias("own")).distinct()
        same = (values["digest"] == seen[column]["digest"]) & F.col("own").eqNullSafe(F.col("value"))
        held = values.join(seen[column], same, "left_semi").select(
            F.col("digest").alias(f"__held_{column}"), F.lit(True).alias(f"__in_{column}")
        )
        flagged = flagged.withColumn(f"__digest_{column}", _digest(F.col(column)))
        flagged = lookup(
            flagged, held, [(f"__digest_{column}", f"__held_{column}")], "left", spread=F.xxhash64(*big.columns), small=is_broadcast
        )
    both = F.lit(True)
    for column in columns:
        both = both & F.coalesce(F.col(f"__in_{column}"), F.lit(False))
    return big.filter(~maybe).unionByName(flagged.filter(~both).select(*big.columns))


def assign_split(
    df: DataFrame, heads: DataFrame, key: str = "doc_id", default: str = "test", small: bool | None = None
) -> DataFrame:
    """Give each row its document's split; documents not in ``heads(key, split)`` get ``default``."""
    joined = lookup(df, heads, [(key, key)], "left", spread=F.xxhash64(*df.columns), null_safe=True, small=small)
    return joined.withColumn("split", F.coalesce("split", F.lit(default)))


def exclude_ids(df: DataFrame, ids: DataFrame, key: str = "row_id") -> DataFrame:
    """Rows whose key is not in ``ids``."""
    return df.join(ids.select(key), key, "left_anti")


def zip_outer(left: DataFrame, right: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Columns side by side by row number, missing rows null."""
    return left.join(right, row_id, "full_outer")


def zip_inner(left: DataFrame, right: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Columns side by side by row number, up to the shorter side."""
    return left.join(right, row_id, "inner")


def tokens_to_ids(
    df: DataFrame,
    vocab: DataFrame,
    tokens: str,
    ids: str,
    key: list[str],
    unk_id: int,
    token: str = "token",
    index: str = "index",
    small: bool | None = None,
    frequent: int = FREQUENT,
    top: DataFrame | None = None,
    keep_tokens: bool = True,
) -> DataFrame:
    """Add the vocabulary index of every token; tokens outside the vocabulary get ``unk_id``.

    A vocabulary of checked small size is sent to the workers and no row moves. Of a larger one the workers get what the
    text uses most: a sketch names about ``frequent`` words, as many of them as a broadcast may hold, and these are
    coded in place, those outside of the vocabulary too. Only the other tokens are joined by word, with place and row
    number, and only rows that have such tokens move to meet their ids; no word among them is hot. ``key`` names the
    rows for the reader; they are matched by numbers of their own, so keys may repeat or be null. Where the frequent
    words are known, ``top(item, count)`` stands in for the sketch. ``keep_tokens`` false leaves ``tokens`` out of the rows.
    """
    kept = [c for c in df.columns if keep_tokens or c != tokens]
    spark = df.sparkSession
    coded = None if small is False else collect_small(vocab.select(F.col(token), F.col(index).cast("int")))
    if coded is not None:
        table = spark.sparkContext.broadcast(Table({r[0]: r[1] for r in coded}))
        return df.withColumn(ids, encode_with(table, unk_id)(F.col(tokens))).select(*dict.fromkeys([*kept, ids]))
    words = vocab.groupBy(F.col(token).alias("__token")).agg(F.min(F.col(index).cast("int")).alias("__id"))
    top = frequent_values(df, F.col(tokens), frequent) if top is None else top
    known = top.select(F.col("item").alias("__token"), "count").join(words, "__token", "left")
    known = written(known.withColumn("__id", F.coalesce("__id", F.lit(unk_id))), "frequent")
    sized = known.withColumn("__size", F.octet_length(F.to_json(F.struct("__token", "__id"))))
    # At most so many rows as the sketch gives, so one task may add up their sizes.
    fits = sized.withColumn("__sum", F.sum("__size").over(Window.orderBy(F.desc("count"), "__token")))
    table = {r[0]: r[1] for r in fits.filter(F.col("__sum") <= BROADCAST_BYTES).select("__token", "__id").collect()}
    table = spark.sparkContext.broadcast(Table({**table, None: unk_id}))
    # Rows are coded once and written with what is left to join. Numbers are stored too, so that every reader sees the same.
    rows = df.select(*kept, F.monotonically_increasing_id().alias("__row"), _encode_some(table)(F.col(tokens)).alias("__coded"))
    rows = written(rows, "coded")
    lacking = F.size("__coded.places") > 0
    rare = rows.filter(lacking).select("__row", F.explode(F.arrays_zip("__coded.places", "__coded.words")).alias("e"))
    rare = rare.select("__row", F.col("e.places").alias("__pos"), F.col("e.words").alias("__token"))
    each = rare.join(words, "__token", "left").select("__row", F.struct("__pos", F.coalesce("__id", F.lit(unk_id)).alias("id")).alias("e"))
    found = each.groupBy("__row").agg(F.transform(F.sort_array(F.collect_list("e")), lambda e: e["id"]).alias("__found"))
    whole = rows.select(*kept, "__row", F.col("__coded.ids").alias("__ids"), lacking.alias("__lacking"))
    filled = whole.filter("__lacking").join(found, "__row").withColumn("__ids", _filling()(F.col("__ids"), F.col("__found")))
    both = whole.filter("not __lacking").unionByName(filled.drop("__found"))
    return both.withColumn(ids, F.col("__ids")).select(*dict.fromkeys([*kept, ids]))


def encode_with(table, unk_id: int | None):
    """A column function from tokens to indexes over a shared ``Table``."""

    @F.arrow_udf("array<int>")
    def encode(tokens: pa.Array) -> pa.Array:
        return in_slices(tokens, lambda some: table.value.look_up(some, unk_id))

    return encode


def _encode_some(table):
    """A column function from tokens to indexes, null outside of the ``Table``, with places and words of those tokens."""

    @F.arrow_udf("ids array<int>, places array<int>, words array<string>")
    def encode(tokens: pa.Array) -> pa.Array:
        return in_slices(tokens, lambda some: with_rest(some, table.value.look_up(some, None)))

    return encode


def _filling():
    """A column function that puts a row's ids in place of the nulls of its list."""

    @F.arrow_udf("array<int>")
    def fill(lists: pa.Array, values: pa.Array) -> pa.Array:
        return fill_nulls(lists, values)

    return fill
