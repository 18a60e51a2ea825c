"""Readers of tab- and comma-separated corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.filters import drop_empty_pairs
from ..operators.position import number_scan
from ..operators.sets import distinct_rows
from ..schemas import ALIGNED, NA_TOKENS, PAIRS, SCORED_PAIRS
from .quoted import read_quoted


def na_to_null(df: DataFrame) -> DataFrame:
    """Texts that mean "missing" become null in every string column."""
    cols = [
        F.when(~F.col(f.name).isin(NA_TOKENS), F.col(f.name)).alias(f.name)
        if isinstance(f.dataType, T.StringType)
        else F.col(f.name)
        for f in df.schema.fields
    ]
    return df.select(*cols)


def _table(
    spark: SparkSession, path: str, schema: T.StructType, sep: str, header: bool, multiline: bool, numbered: bool = True
) -> DataFrame:
    """The rows of a quoted table with ``row_id``. Large files are read by many tasks either way; ``multiline=False``
    saves the search for records where no field holds a line break."""
    if multiline:
        return na_to_null(read_quoted(spark, path, schema, sep, header))
    scan = (
        spark.read.schema(schema)
        .option("sep", sep)
        .option("header", header)
        .option("quote", '"')
        .option("escape", '"')
        .option("enforceSchema", True)
        .csv(path)
    )
    return na_to_null(number_scan(scan) if numbered else scan)


def read_aligned_pairs(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Headerless five-column file of aligned sentences, plus ``row_id``."""
    return _table(spark, path, ALIGNED, "\t", False, multiline)


def read_pairs(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Headerless two-column file, plus ``row_id``."""
    return _table(spark, path, PAIRS, "\t", False, multiline)


def read_scored_pairs(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Headerless three-column file without its score column, plus ``row_id``."""
    return _table(spark, path, SCORED_PAIRS, "\t", False, multiline).drop("matching")


def read_prepared_pairs(
    spark: SparkSession, path: str, schema: T.StructType = PAIRS, multiline: bool = True
) -> DataFrame:
    """Prepared file with a header: distinct rows, each with its first ``row_id``."""
    return distinct_rows(_table(spark, path, schema, "\t", True, multiline))


def read_prepared_aligned(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Prepared five-column file with a header, rows without content dropped; duplicates stay."""
    return drop_empty_pairs(_table(spark, path, ALIGNED, "\t", True, multiline))


def read_article_metadata(
    spark: SparkSession, path: str, schema: T.StructType, multiline: bool = True
) -> DataFrame:
    """Comma-separated article table with a header."""
    return _table(spark, path, schema, ",", True, multiline, numbered=False).select(*schema.names)
