"""Writers; all of them write a folder of part files from the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_prepared(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Tab-separated with a header."""
    _csv(df, path, "\t", True, mode)


def write_headerless(df: DataFrame, path: str, sep: str = "\t", mode: str = "errorifexists") -> None:
    """Tab-separated without a header: the input form of the corpus readers."""
    _csv(df, path, sep, False, mode)


def _csv(df: DataFrame, path: str, sep: str, header: bool, mode: str) -> None:
    (
        df.write.mode(mode)
        .option("sep", sep)
        .option("header", header)
        .option("quote", '"')
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def write_parallel(
    df: DataFrame, path: str, order: str = "row_id", quoting: str = "none", mode: str = "errorifexists"
) -> None:
    """``<path>.src`` and ``<path>.dst``, one sentence per line in the order of ``order``.

    ``quoting='minimal'`` quotes sentences with commas, quotes or line breaks. ``'none'`` writes raw
    lines, so line breaks inside a sentence become blanks and a missing sentence an empty line.
    """
    # Both sides are sorted for themselves: rows that tie in all three are the same on either.
    ordered = df.orderBy(order, "input", "output")
    for column, suffix in (("input", "src"), ("output", "dst")):
        side = ordered.select(column)
        if quoting == "minimal":
            _csv(side, f"{path}.{suffix}", ",", False, mode)
        else:
            line = F.regexp_replace(F.coalesce(F.col(column), F.lit("")), r"[\r\n]+", " ")
            side.select(line.alias("value")).write.mode(mode).text(f"{path}.{suffix}")


def write_corpus_stats(stats: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The one-row statistics record as JSON."""
    stats.coalesce(1).write.mode(mode).json(path)


def write_unknowns(unknowns: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """``index`` and the pieces (as a JSON list) of sentences with unknown pieces."""
    table = unknowns.select(F.col("row_id").alias("index"), F.to_json("pieces").alias("text"))
    _csv(table, path, "\t", True, mode)


def sentence_score_lines(scores: DataFrame) -> DataFrame:
    """``bleu, meteor, origin, reference, |, hypothesis`` joined by tabs."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("bleu", "meteor", "origin", "reference")]
    tail = [F.lit("|"), F.coalesce(F.col("hypothesis"), F.lit(""))]
    return scores.select(F.concat_ws("\t", *parts, *tail).alias("value"))


def write_sentence_scores(
    scores: DataFrame, path: str, format: str = "parquet", mode: str = "errorifexists"
) -> None:
    """Scored sentences; ``format='text'`` writes the tab-joined lines."""
    if format == "text":
        sentence_score_lines(scores).write.mode(mode).text(path)
    else:
        scores.write.mode(mode).format(format).save(path)
