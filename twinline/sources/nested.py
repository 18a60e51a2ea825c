"""Reader of nested article documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_nested_articles(
    spark: SparkSession, path: str, article: T.StructType, multiline: bool = False, keys: str = ""
) -> DataFrame:
    """Records ``language, articles[...]``; ``keys`` adds further top-level columns as a DDL string.

    ``multiline=True`` reads one JSON array per file; line-delimited records stay splittable.
    """
    schema = T.StructType([T.StructField("language", T.StringType()), T.StructField("articles", T.ArrayType(article))])
    if keys:
        schema = T.StructType(T.StructType.fromDDL(keys).fields + schema.fields)
    return spark.read.schema(schema).option("multiLine", multiline).json(path)


def flatten_articles(records: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One row per article of every record, its fields as columns."""
    keep = keep or []
    return records.select(*keep, F.explode("articles").alias("__a")).select(*keep, "__a.*")
