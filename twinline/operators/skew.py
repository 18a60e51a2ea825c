"""Key lookups that hold when one key carries a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written

# A side of at most so many bytes, as JSON, may be broadcast; larger sides go through a salted shuffle join.
BROADCAST_BYTES = 32 << 20
SALTS = 16
# A sketch of frequent values tracks twice as many as are taken; so many sketches are merged at a time.
FREQUENT, SKETCHES = 200_000, 64


def is_small(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether the rows of a table take at most ``max_bytes`` as JSON."""
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))).cast("long"))).first()[0]
    return (size or 0) <= max_bytes


def collect_small(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> list | None:
    """The rows of a table that ``is_small``; None for others."""
    df = written(df, "lookup")
    return df.collect() if is_small(df, max_bytes) else None


def frequent_values(df: DataFrame, values: Column, most: int = FREQUENT) -> DataFrame:
    """``item, count``: about the ``most`` most frequent elements of the lists ``values``, with estimated counts.

    One bounded sketch per task, so nothing is shuffled by value. Whatever it leaves out has, of all elements, a share
    of about ``1 / most`` at most.
    """
    flat = df.select(F.explode(values).alias("item")).filter("item is not null")
    # An element of no table's own, as a sketch of nothing can't be merged.
    some = flat.unionByName(df.sparkSession.range(1).select(F.lit("").alias("item")))
    group = F.pmod(F.spark_partition_id(), F.lit(SKETCHES)).alias("group")
    parts = some.groupBy(group).agg(F.expr(f"approx_top_k_accumulate(item, {2 * most})").alias("sketch"))
    whole = parts.agg(F.expr(f"approx_top_k_combine(sketch, {2 * most})").alias("sketch"))
    return whole.select(F.explode(F.expr(f"approx_top_k_estimate(sketch, {most})")).alias("top")).select("top.*")


def lookup(
    rows: DataFrame,
    table: DataFrame,
    on: list[tuple[str, str]],
    how: str = "left",
    spread: Column | None = None,
    null_safe: bool = False,
    salts: int = SALTS,
    small: bool | None = None,
) -> DataFrame:
    """Join ``rows`` with a ``table`` that has one row per key; the table's key columns are dropped.

    A table of checked small size is broadcast and the rows stay where they are. Otherwise the keys of
    the table are repeated ``salts`` times and every row picks one copy by a hash of ``spread``, so a
    hot key is shared by that many tasks.
    """
    if small is None:
        # Written once: counted from the file, then joined from the file.
        table = written(table, "lookup")
        small = is_small(table)
    renamed = table
    for _, right in on:
        renamed = renamed.withColumnRenamed(right, f"__key_{right}")

    def equal(left: str, right: str) -> Column:
        a, b = rows[left], F.col(f"__key_{right}")
        return a.eqNullSafe(b) if null_safe else a == b

    condition = F.lit(True)
    for left, right in on:
        condition = condition & equal(left, right)
    drops = [f"__key_{right}" for _, right in on]
    if small:
        return rows.join(F.broadcast(renamed), condition, how).drop(*drops)
    spread = F.xxhash64(*rows.columns) if spread is None else spread
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    copies = renamed.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    condition = F.col("__salt") == F.col("__copy")
    for left, right in on:
        a, b = salted[left], F.col(f"__key_{right}")
        condition = condition & (a.eqNullSafe(b) if null_safe else a == b)
    return salted.join(copies, condition, how).drop("__salt", "__copy", *drops)
