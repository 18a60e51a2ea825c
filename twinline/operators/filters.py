"""Row filters and projections."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import ADJACENT_VERSIONS, EMPTY_MARKED, MAX_PIECES, UNK


def drop_adjacent_versions(df: DataFrame, steps: Iterable[tuple[str, str]] = tuple(ADJACENT_VERSIONS)) -> DataFrame:
    """Drop pairs that go one version down; rows with a missing version stay."""
    hit = F.lit(False)
    for source, target in steps:
        hit = hit | ((F.col("docv_input") == source) & (F.col("docv_output") == target))
    return df.filter(~F.coalesce(hit, F.lit(False)))


def drop_empty_pairs(df: DataFrame, columns: tuple[str, ...] = ("input", "output")) -> DataFrame:
    """Drop rows where a side holds nothing but markers; a missing side stays."""
    keep = F.lit(True)
    for column in columns:
        keep = keep & ~F.coalesce(F.col(column).isin(EMPTY_MARKED), F.lit(False))
    return df.filter(keep)


def drop_overlong(df: DataFrame, columns: tuple[str, ...], limit: int = MAX_PIECES) -> DataFrame:
    """Keep rows where all piece lists have at most ``limit`` pieces."""
    keep = F.lit(True)
    for column in columns:
        keep = keep & (F.size(column) <= limit)
    return df.filter(keep)


def drop_unknown(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Drop rows with an unknown piece on any side."""
    keep = F.lit(True)
    for column in columns:
        keep = keep & ~F.array_contains(column, UNK)
    return df.filter(keep)


def drop_first_labels(df: DataFrame, unknown_counts: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Positional form of the unknown filter: drop the rows labelled below the larger unknown count.

    ``unknown_counts`` has one row per side with a column ``n``.
    """
    limit = unknown_counts.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n")).scalar()
    return df.filter(F.col(row_id) >= limit)


def select_version_pair(df: DataFrame, source: str, target: str) -> DataFrame:
    return df.filter((F.col("docv_input") == source) & (F.col("docv_output") == target))


def select_target_version(df: DataFrame, target: str) -> DataFrame:
    return df.filter(F.col("docv_output") == target)


def select_language(df: DataFrame, language: str, column: str = "language") -> DataFrame:
    return df.filter(F.col(column) == language)


def select_versions_in(df: DataFrame, versions: list[int], column: str = "version") -> DataFrame:
    return df.filter(F.col(column).isin(versions))


def project_side(df: DataFrame, side: str, keep: tuple[str, ...] = ()) -> DataFrame:
    return df.select(*keep, side)


def head_n(df: DataFrame, n: int = 5, order: str = "row_id") -> DataFrame:
    """The first rows by row number; each task keeps only ``n`` rows."""
    return df.orderBy(order).limit(n)
