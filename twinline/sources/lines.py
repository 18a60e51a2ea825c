"""Readers of line files; lines pair up by their number in the file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clean import strip
from ..functions.tokens import split_fields, unescape_newlines
from ..operators.joins import zip_inner, zip_outer
from ..operators.position import number_scan
from ..operators.sets import union_splits
from ..schemas import ALIGNED, strings
from .tabular import _table


def read_column(spark: SparkSession, path: str, name: str, multiline: bool = True, sep: str = "\t") -> DataFrame:
    """One quoted column with ``row_id``."""
    return _table(spark, path, strings(name), sep, False, multiline)


def read_parallel_outer(
    spark: SparkSession, paths: dict[str, tuple[str, str]], multiline: bool = True
) -> DataFrame:
    """``{split: (source path, target path)}`` to ``split, row_id, input, output``.

    Rows pair by number; the shorter side is null at the end. Row numbers start again in each split,
    so the key is ``(split, row_id)``.
    """
    tables = {
        split: zip_outer(
            read_column(spark, src, "input", multiline), read_column(spark, dst, "output", multiline)
        )
        for split, (src, dst) in paths.items()
    }
    return union_splits(tables)


def read_parallel_lines(spark: SparkSession, src: str, dst: str) -> DataFrame:
    """Source and target lines by number up to the shorter file, stripped, both sides not empty."""

    def side(path: str, name: str) -> DataFrame:
        return number_scan(spark.read.text(path)).select("row_id", strip(F.col("value")).alias(name))

    pairs = zip_inner(side(src, "input"), side(dst, "output"))
    return pairs.filter((F.length("input") > 0) & (F.length("output") > 0))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """All lines, stripped, with ``row_id``."""
    return number_scan(spark.read.text(path)).select("row_id", strip(F.col("value")).alias("text"))


def read_raw_split(spark: SparkSession, path: str, unescape: bool = True, rest: str | None = None) -> DataFrame:
    """Whole lines cut at tabs into the five aligned columns; ``rest`` names a list of the fields after them."""
    value = F.col("value")
    lines = spark.read.text(path).filter(F.length(value) > 0)
    return lines.select(*split_fields(unescape_newlines(value) if unescape else value, ALIGNED.names, rest=rest))


def read_text_shards(spark: SparkSession, pattern: str) -> DataFrame:
    """Lines of many files: ``shard`` (the file's path), ``line`` (its number in the file), ``text``."""
    lines = number_scan(spark.read.text(pattern), "line", file="shard")
    return lines.select("shard", "line", F.col("value").alias("text"))
