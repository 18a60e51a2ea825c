"""Train/valid/test splits, candidate ranking and batching orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .joins import assign_split
from .position import prefix_sum, squash


def random_key(col: Column, seed: int) -> Column:
    """A fixed pseudo-random number below 2^60 per value: reruns and retries shuffle the same way."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), col.cast("string")))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def first_appearance_rank(df: DataFrame, key: str = "doc_id", row_id: str = "row_id") -> DataFrame:
    """``key, first_row, rank``: documents ranked from 0 by their first row."""
    docs = df.groupBy(key).agg(F.min(row_id).alias("first_row"))
    return prefix_sum(docs, ["first_row"], F.col("first_row"), name="rank", store=True)


def _leading(ordered: DataFrame, key: str, order: list[str], score: Column, n1: int, n2: int, names) -> DataFrame:
    """``key, split`` of the first ``n1`` and next ``n2`` rows."""
    ranked = prefix_sum(ordered, order, score, name="rank", store=True).filter(F.col("rank") < n1 + n2)
    heads = ranked.select(key, F.when(F.col("rank") < n1, names[0]).otherwise(names[1]).alias("split"))
    # Written once: both the training and the held-out rows look documents up in it.
    return written(heads, "heads")


def last_per_group(df: DataFrame, keys: list[str], row_id: str = "row_id") -> DataFrame:
    """Per group the last value that is not missing of every other column, and the last ``row_id``.

    Rows with a missing key are dropped. Each task sends one row per group it saw.
    """
    present = df.filter(" AND ".join(f"{k} IS NOT NULL" for k in keys))
    rest = [c for c in df.columns if c not in keys and c != row_id]
    last = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(row_id))).alias(c) for c in rest]
    return present.groupBy(*keys).agg(*last, F.max(row_id).alias(row_id)).select(*df.columns)


def document_split(
    df: DataFrame, n_train: int = 1070, n_valid: int = 30, keep_last: bool = True, row_id: str = "row_id"
) -> DataFrame:
    """Whole documents to ``split``: the first to appear train, the next validate, the rest test.

    Outside of training only the last row per ``doc_id, docv_input, input`` stays (``keep_last``).
    """
    docs = df.groupBy("doc_id").agg(F.min(row_id).alias("first_row"))
    heads = _leading(docs, "doc_id", ["first_row"], F.col("first_row"), n_train, n_valid, ("train", "valid"))
    rows = assign_split(df, heads)
    if not keep_last:
        return rows
    held_out = last_per_group(rows.filter(F.col("split") != "train"), ["doc_id", "docv_input", "input"], row_id)
    return rows.filter(F.col("split") == "train").unionByName(held_out)


def random_split(
    df: DataFrame, n_test: int = 500, n_valid: int = 300, seed: int = 0, row_id: str = "row_id", shuffle: bool = True
) -> DataFrame:
    """Rows to ``split`` by a seeded order: first ``n_test`` test, next ``n_valid`` valid, rest train."""
    order = random_key(F.col(row_id), seed) if shuffle else F.col(row_id)
    keyed = df.select(row_id, order.alias("__key"))
    heads = _leading(
        keyed, row_id, ["__key", row_id], F.col("__key").cast("double"), n_test, n_valid, ("test", "valid")
    )
    return assign_split(df, heads, row_id, "train")


def shuffle_rows(df: DataFrame, row_id: str = "row_id", seed: int = 0, name: str = "position") -> DataFrame:
    """A seeded random permutation as a ``position`` column; sort by it to write in that order."""
    keyed = df.withColumn("__key", random_key(F.col(row_id), seed))
    return prefix_sum(keyed, ["__key", row_id], F.col("__key").cast("double"), name=name).drop("__key")


def rank_candidates(
    df: DataFrame,
    k: int = 1,
    source: str = "source_id",
    candidate: str = "candidate",
    score: str = "length_power",
    alpha: float = 0.7,
) -> DataFrame:
    """The ``k`` best candidates per source with ``score`` and ``rank`` (from 1).

    ``score`` is ``length_power`` (logp / length^alpha), ``mean`` (logp over length - 1) or ``raw``.
    Spark keeps only the ``k`` best rows per source in every task before the shuffle, so a source with
    very many candidates does not meet in one task.
    """
    logp, length = F.col("logp"), F.col("length")
    value = {
        "length_power": logp / F.pow(length.cast("double"), F.lit(alpha)),
        "mean": logp / (length - 1 + F.lit(1e-6)),
        "raw": logp,
    }[score]
    best = Window.partitionBy(source).orderBy(F.desc("score"), F.asc(candidate))
    scored = df.withColumn("score", value)
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def length_buckets(
    df: DataFrame, length: str, batch_size: int, row_id: str = "row_id", store: bool = False
) -> DataFrame:
    """Add ``batch``: rows in order of length, ``batch_size`` rows each."""
    score = F.col(length).cast("double") + squash(F.col(row_id))
    ranked = prefix_sum(df, [length, row_id], score, name="__rank", store=store)
    return ranked.withColumn("batch", F.floor(F.col("__rank") / batch_size).cast("long")).drop("__rank")
