"""From prepared corpora to train/valid/test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import exclude_overlap
from ..operators.sets import union_train
from ..operators.split import document_split, random_split
from ..sinks import write_parallel


def split_aligned(df: DataFrame, n_train: int = 1070, n_valid: int = 30) -> DataFrame:
    """Aligned rows with the split of their document; held-out rows once per source sentence."""
    return document_split(df, n_train, n_valid)


def split_wiki(
    health: DataFrame, wiki: DataFrame, n_test: int = 500, n_valid: int = 300, seed: int = 0, shuffle: bool = True
) -> DataFrame:
    """Held-out rows from the small corpus only; train is its rest plus the large corpus without rows
    whose two sides both occur in the small one."""
    rest = exclude_overlap(wiki, health).withColumn("split", F.lit("train"))
    return union_train(random_split(health, n_test, n_valid, seed, shuffle=shuffle), rest)


def write_splits(table: DataFrame, path: str, order: str = "row_id", quoting: str = "none") -> None:
    """``<path>/<split>.src`` and ``.dst`` for each split."""
    for split in ("train", "valid", "test"):
        write_parallel(table.filter(F.col("split") == split), f"{path}/{split}", order, quoting)
