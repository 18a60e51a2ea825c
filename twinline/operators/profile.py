"""Corpus profiles: piece statistics per side and counts over the version columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import exploded, word_starts
from ..schemas import CLS, MAX_PIECES, MIN_LENGTH_START, SEP, UNK


def sides(df: DataFrame, columns: dict[str, str], keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per sentence: ``side, pieces``; ``columns`` maps side names to piece columns."""
    entries = F.array(*[F.struct(F.lit(s).alias("side"), F.col(c).alias("pieces")) for s, c in columns.items()])
    return df.select(*keep, F.inline(entries))


def _measured(sentences: DataFrame, limit: int) -> DataFrame:
    return sentences.filter(F.size("pieces") <= limit)


def token_counts(sentences: DataFrame, limit: int = MAX_PIECES, by: tuple[str, ...] = ("side",)) -> DataFrame:
    """How often each piece occurs, markers left out; over sentences of at most ``limit`` pieces."""
    pieces = exploded(_measured(sentences, limit), [*by], "pieces", "token")
    return pieces.filter(~F.col("token").isin(CLS, SEP)).groupBy(*by, "token").agg(F.count(F.lit(1)).alias("count"))


def corpus_profile(
    sentences: DataFrame, counts: DataFrame | None = None, limit: int = MAX_PIECES, by: tuple[str, ...] = ("side",)
) -> DataFrame:
    """Per side: piece and distinct-piece counts, longest and shortest sentence in pieces and words."""
    counts = token_counts(sentences, limit, by) if counts is None else counts
    words = F.size(word_starts(F.col("pieces")))
    size = F.size("pieces")
    shortest = F.lit(MIN_LENGTH_START)
    lengths = _measured(sentences, limit).groupBy(*by).agg(
        F.max(size).cast("long").alias("max_length"),
        F.least(F.min(size), shortest).cast("long").alias("min_length"),
        F.max(words).cast("long").alias("max_length_words"),
        F.least(F.min(words), shortest).cast("long").alias("min_length_words"),
    )
    totals = counts.groupBy(*by).agg(
        F.sum("count").cast("long").alias("n_tokens"), F.count(F.lit(1)).cast("long").alias("n_distinct")
    )
    return lengths.join(totals, list(by), "left").fillna(0, ["n_tokens", "n_distinct"])


def prefix_counts(counts: DataFrame, prefixes: tuple[str, ...] = (UNK, "##", "#"), by: tuple[str, ...] = ("side",)) -> DataFrame:
    """Occurrences of pieces that start with each prefix."""
    wide = counts.groupBy(*by).agg(
        *[F.coalesce(F.sum(F.when(F.col("token").startswith(p), F.col("count"))), F.lit(0)).alias(f"p{i}")
          for i, p in enumerate(prefixes)]
    )
    entries = F.array(*[F.struct(F.lit(p).alias("prefix"), F.col(f"p{i}").alias("found")) for i, p in enumerate(prefixes)])
    return wide.select(*by, F.inline(entries))


def unknown_sentences(sentences: DataFrame, limit: int = MAX_PIECES) -> DataFrame:
    """Sentences of at most ``limit`` pieces that hold an unknown one."""
    return _measured(sentences, limit).filter(F.array_contains("pieces", UNK))


def version_pair_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("docv_input", "docv_output").agg(F.count(F.lit(1)).alias("n"))


def version_pair_totals(df: DataFrame) -> DataFrame:
    """Counts per version pair (``level`` 0), per source version (1) and overall (3)."""
    return df.rollup("docv_input", "docv_output").agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n"))


def target_version_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("docv_output").agg(F.count(F.lit(1)).alias("n"))


def distinct_documents(df: DataFrame, column: str = "doc_id", approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct(column) if approximate else F.countDistinct(column)
    return df.agg(count.alias("n_documents"))


def rows_by_version(df: DataFrame, versions: list[int], column: str = "version") -> DataFrame:
    """Row counts of the given versions and, with a missing version, their total."""
    return df.filter(F.col(column).isin(versions)).rollup(column).agg(F.count(F.lit(1)).alias("n"))


def rows_by_language(df: DataFrame, languages: list[str], column: str = "language") -> DataFrame:
    """One row: a count per language and the count of all rows."""
    return df.agg(
        *[F.count_if(F.col(column) == lang).alias(f"n_{lang}") for lang in languages], F.count(F.lit(1)).alias("n_all")
    )


def split_sizes(df: DataFrame, column: str = "split") -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def filter_sizes(df: DataFrame, condition: Column) -> DataFrame:
    """Row counts before and after a filter, in one pass."""
    return df.agg(F.count(F.lit(1)).alias("before"), F.count_if(condition).alias("after"))


def corpus_stats(profile: DataFrame, rows: DataFrame, model: str, normalized: bool) -> DataFrame:
    """The one-row statistics record: lengths per side, number of kept rows and the settings."""
    picks = []
    for side in ("input", "output"):
        here = F.col("side") == side
        for bound in ("max", "min"):
            for unit, column in (("tokens", f"{bound}_length"), ("words", f"{bound}_length_words")):
                picks.append(F.max(F.when(here, F.col(column))).alias(f"{bound}_length_{unit}_{side}"))
    size = rows.agg(F.count(F.lit(1)).alias("n")).scalar()
    return profile.agg(*picks).select(
        F.lit(model).alias("bert_model"), size.alias("length_dataset"), "*", F.lit(normalized).alias("dataset_normalized")
    )
