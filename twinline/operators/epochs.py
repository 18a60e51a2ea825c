"""Training-log analytics: accuracy, epoch metrics and steps."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import PAD_ID
from .position import prefix_sum, squash


def row_accuracy(predicted: Column, target: Column) -> Column:
    """``struct(correct, total)`` of one row: equal ids and ids that are not padding."""
    at = F.arrays_zip(predicted.alias("p"), target.alias("t"))
    real = F.filter(at, lambda x: x["t"].isNotNull() & (x["t"] != PAD_ID))
    hits = F.filter(real, lambda x: F.coalesce(x["p"] == x["t"], F.lit(False)))
    return F.struct(F.size(hits).cast("long").alias("correct"), F.size(real).cast("long").alias("total"))


def token_accuracy(df: DataFrame, predicted: str, target: str) -> DataFrame:
    """``correct, total`` over all target places that are not padding."""
    counts = df.select(row_accuracy(F.col(predicted), F.col(target)).alias("a"))
    return counts.agg(F.sum("a.correct").alias("correct"), F.sum("a.total").alias("total"))


def perplexity(loss: Column) -> Column:
    return F.exp(loss)


def bits_per_char(loss: Column) -> Column:
    return loss / math.log(2)


def epoch_metrics(log: DataFrame) -> DataFrame:
    """Loss, accuracy and perplexity per ``epoch, mode`` of a batch log.

    ``loss`` holds batch sums: the epoch loss divides their sum by the token count.
    """
    count = F.sum("count")
    sums = log.groupBy("epoch", "mode").agg(
        (F.sum("loss") / count).alias("loss"), (F.sum("correct") / count).alias("accuracy")
    )
    return sums.withColumn("perplexity", perplexity(F.col("loss")))


def best_epoch(metrics: DataFrame, mode: str = "valid") -> DataFrame:
    """The epoch with the lowest perplexity of a mode; the earliest of equals."""
    picked = F.min_by(F.struct("epoch", "loss", "accuracy", "perplexity"), F.struct("perplexity", "epoch"))
    return metrics.filter(F.col("mode") == mode).agg(picked.alias("b")).select("b.*")


def best_over_rounds(rounds: DataFrame) -> DataFrame:
    """Best BLEU and best SARI, each over all rounds."""
    return rounds.agg(F.max("bleu").alias("best_bleu"), F.max("sari").alias("best_sari"))


def global_step(log: DataFrame, modes: list[str], batch: str = "batch") -> DataFrame:
    """Number the batches 1, 2, ... by epoch, by mode (in the given order) and batch."""
    place = F.array_position(F.array(*[F.lit(m) for m in modes]), F.col("mode"))
    ordered = log.withColumn("__mode", place)
    score = F.col("epoch") * (len(modes) + 1) + F.col("__mode") + squash(F.col(batch))
    numbered = prefix_sum(ordered, ["epoch", "__mode", batch], score, name="step")
    return numbered.withColumn("step", F.col("step") + 1).drop("__mode")
