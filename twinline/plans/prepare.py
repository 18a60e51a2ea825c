"""Corpus preparation: clean, tokenize, profile, filter."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.clean import normalize_sentence
from ..functions.wordpiece import WordPiece
from ..operators import filters, profile
from ..operators.sets import distinct_rows
from ..schemas import MAX_PIECES
from ..session import written


@dataclass
class CleanRules:
    """Cleaning switches; only the input side is cleaned unless ``columns`` says more."""

    enabled: bool = True
    lower: bool = True
    drop_brackets: bool = True
    regex_rules: bool = False
    columns: tuple[str, ...] = ("input",)


@dataclass
class Prepared:
    """All results of a preparation; each is a lazy DataFrame over the tokenized table."""

    tokenized: DataFrame
    sentences: DataFrame
    rows: DataFrame
    model: str = ""
    normalized: bool = True
    by: tuple[str, ...] = ("side",)

    @property
    def counts(self) -> DataFrame:
        return profile.token_counts(self.sentences, by=self.by)

    @property
    def profile(self) -> DataFrame:
        return profile.corpus_profile(self.sentences, by=self.by)

    @property
    def prefixes(self) -> DataFrame:
        return profile.prefix_counts(self.counts, by=self.by)

    @property
    def unknown(self) -> DataFrame:
        return profile.unknown_sentences(self.sentences)

    @property
    def stats(self) -> DataFrame:
        return profile.corpus_stats(self.profile, self.rows, self.model, self.normalized)


def tokenize_pairs(df: DataFrame, wordpiece: WordPiece) -> DataFrame:
    return df.withColumn("input_pieces", wordpiece.tokenize(F.col("input"))).withColumn(
        "output_pieces", wordpiece.tokenize(F.col("output"))
    )


def clean(df: DataFrame, rules: CleanRules) -> DataFrame:
    if not rules.enabled:
        return df
    for column in rules.columns:
        df = df.withColumn(
            column, normalize_sentence(F.col(column), rules.lower, rules.drop_brackets, rules.regex_rules)
        )
    return df


def prepare(
    df: DataFrame,
    wordpiece: WordPiece,
    rules: CleanRules | None = None,
    model: str = "",
    store: bool = True,
    positional: bool = False,
    row_id: str = "row_id",
    ignore: tuple[str, ...] = (),
    keep: tuple[str, ...] = (),
) -> Prepared:
    """Distinct rows, cleaned and tokenized, with their profile and the rows that pass both filters.

    ``store`` writes the tokenized table once, so its many readers do not tokenize again. ``positional``
    drops rows by label below the unknown count instead of the rows that hold unknown pieces.
    """
    rules = rules or CleanRules()
    tokenized = tokenize_pairs(clean(distinct_rows(df, row_id, ignore), rules), wordpiece)
    if store:
        tokenized = written(tokenized, "tokenized")
    pieces = ("input_pieces", "output_pieces")
    sentences = profile.sides(tokenized, {"input": pieces[0], "output": pieces[1]}, keep=(*keep, row_id))
    trimmed = filters.drop_overlong(tokenized, pieces, MAX_PIECES)
    if positional:
        counts = profile.unknown_sentences(sentences).groupBy("side").agg(F.count(F.lit(1)).alias("n"))
        kept = filters.drop_first_labels(trimmed, counts, row_id)
    else:
        kept = filters.drop_unknown(trimmed, pieces)
    return Prepared(tokenized, sentences, kept.select(*df.columns), model, rules.enabled, (*keep, "side"))


def prepare_aligned(df: DataFrame, wordpiece: WordPiece, rules: CleanRules | None = None, **options) -> Prepared:
    """``prepare`` for an aligned corpus, without the pairs that go one version down."""
    return prepare(filters.drop_adjacent_versions(df), wordpiece, rules, **options)


def prepare_presplit(
    merged: DataFrame, wordpiece: WordPiece, rules: CleanRules | None = None, **options
) -> tuple[Prepared, dict[str, DataFrame]]:
    """Profile over the merged splits; the splits themselves stay as they were read."""
    prepared = prepare(merged, wordpiece, rules, ignore=("split",), **options)
    splits = {s: merged.filter(F.col("split") == s).drop("split") for s in ("train", "valid", "test")}
    return prepared, splits


def prepare_corpora(
    corpora: dict[str, DataFrame], wordpiece: WordPiece, rules: CleanRules | None = None, **options
) -> Prepared:
    """Several corpora in one plan, told apart by a ``corpus`` column; profiles are per corpus."""
    tagged = [df.withColumn("corpus", F.lit(name)) for name, df in corpora.items()]
    return prepare(reduce(lambda a, b: a.unionByName(b), tagged), wordpiece, rules, keep=("corpus",), **options)
