"""Set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_rows(df: DataFrame, row_id: str = "row_id", ignore: tuple[str, ...] = ()) -> DataFrame:
    """Distinct rows by all data columns; each keeps its least ``row_id``.

    An aggregation rather than ``dropDuplicates``: equal rows meet before the shuffle, and which one
    stays does not depend on the order of tasks.
    """
    data = [c for c in df.columns if c != row_id and c not in ignore]
    kept = df.groupBy(*data).agg(F.min(row_id).alias(row_id), *[F.min(c).alias(c) for c in ignore])
    return kept.select(*df.columns)


def union_splits(tables: dict[str, DataFrame]) -> DataFrame:
    """Stack tables under a ``split`` column."""
    parts = [df.select(F.lit(split).alias("split"), "*") for split, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def union_train(first: DataFrame, rest: DataFrame) -> DataFrame:
    return first.unionByName(rest)


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()
