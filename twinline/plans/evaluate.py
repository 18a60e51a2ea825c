"""Prediction over a test table and its scores."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tokens import decode_pieces, field_encode, pieces_to_words, strip_markers
from ..functions.wordpiece import WordPiece
from ..operators.epochs import best_over_rounds
from ..operators.meteor import meteor
from ..operators.ngram_metrics import corpus_bleu, sentence_scores
from ..operators.predict import Predictor, batch_predict
from ..schemas import CLS, SEP
from ..session import written
from ..sinks import write_sentence_scores


@dataclass
class Evaluation:
    """Scores per sentence and over the corpus (``bleu_smoothed, bleu_strict, sari``)."""

    sentences: DataFrame

    @property
    def corpus(self) -> DataFrame:
        return corpus_bleu(self.sentences, sari=True)


def encode_field(df: DataFrame, column: str, wordpiece: WordPiece, max_len: int, double_specials: bool = True) -> DataFrame:
    """Replace a text column by its padded loader ids."""
    ids = wordpiece.encode(F.col(column))
    marks = wordpiece.id_of(CLS), wordpiece.id_of(SEP)
    return df.withColumn("__ids", ids).withColumn(
        column, field_encode(F.col("__ids"), max_len, *marks, double_specials)
    ).drop("__ids")


def decoded_fields(
    pairs: DataFrame,
    wordpiece: WordPiece,
    max_len: int = 512,
    double_specials: bool = True,
    strip_specials: bool = False,
    row_id: str = "row_id",
) -> DataFrame:
    """``row_id, origin, reference``: the sides of ``row_id, input, output`` as their encoding leaves them.

    Their markers count as tokens unless ``strip_specials``.
    """
    rows = pairs.select(row_id, F.col("input").alias("origin"), F.col("output").alias("reference"))
    for column in ("origin", "reference"):
        rows = encode_field(rows, column, wordpiece, max_len, double_specials)
        text = decode_pieces(wordpiece.to_pieces(F.col(column)))
        rows = rows.withColumn(column, strip_markers(text) if strip_specials else text)
    return rows


def _scored(
    fields: DataFrame, wordpiece: WordPiece, factory: Callable[[], Predictor], store: bool, row_id: str, stems: bool = True
) -> Evaluation:
    rows = batch_predict(fields, "origin", factory).drop("candidate")
    rows = rows.withColumn("meteor", meteor(F.col("hypothesis"), F.col("reference"), stems=stems))
    if store:
        rows = written(rows, "predicted")
    names = ("origin", "hypothesis", "reference")
    pieces = rows.select(row_id, *[wordpiece.pieces(F.col(c)).alias(c) for c in names])
    words = pieces.select(row_id, *[pieces_to_words(F.col(c)).alias(c) for c in names])
    scores = sentence_scores(words, [row_id])
    return Evaluation(scores.join(rows, row_id))


def evaluate(
    pairs: DataFrame,
    wordpiece: WordPiece,
    factory: Callable[[], Predictor],
    max_len: int = 512,
    double_specials: bool = True,
    strip_specials: bool = False,
    store: bool = True,
    row_id: str = "row_id",
) -> Evaluation:
    """Encode ``row_id, input, output``, predict from the decoded input, score against the output.

    Sources and targets are what the encoding leaves of them; their markers count as tokens unless
    ``strip_specials``.
    """
    fields = decoded_fields(pairs, wordpiece, max_len, double_specials, strip_specials, row_id)
    return _scored(fields, wordpiece, factory, store, row_id)


_MANIFEST = "round int, scores string, lines string"


class Rounds:
    """Scored rounds below a folder that all executors share.

    A round counts from the moment that its row is in the manifest; what a lost job has written of a round before that is
    never read.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        spark.createDataFrame([], _MANIFEST).write.mode("ignore").json(f"{self.folder}/manifest")

    @property
    def manifest(self) -> DataFrame:
        """``round, scores, lines``: the committed rounds and their paths, the first commit of each."""
        rows = self.spark.read.schema(_MANIFEST).json(f"{self.folder}/manifest")
        return rows.groupBy("round").agg(F.min(F.struct("scores", "lines")).alias("paths")).select("round", "paths.*")

    def paths(self) -> dict[int, str]:
        """The score tables of the committed rounds; there are as many as predictors."""
        return {row["round"]: row["scores"] for row in self.manifest.orderBy("round").collect()}

    def commit(self, number: int, sentences: DataFrame) -> None:
        """Write the scored sentences of a round as a table and as lines, then enter it into the manifest."""
        mark = uuid.uuid4().hex
        scores, lines = (f"{self.folder}/{kind}/round-{number}-{mark}" for kind in ("scores", "lines"))
        sentences.write.parquet(scores)
        write_sentence_scores(self.spark.read.parquet(scores), lines, "text")
        row = self.spark.createDataFrame([(number, scores, lines)], _MANIFEST)
        row.coalesce(1).write.mode("append").json(f"{self.folder}/manifest")

    @property
    def sentences(self) -> DataFrame:
        """The scored sentences of all rounds, with ``round``."""
        tables = [
            self.spark.read.parquet(path).withColumn("round", F.lit(number)) for number, path in self.paths().items()
        ]
        return reduce(DataFrame.unionByName, tables)

    @property
    def corpus(self) -> DataFrame:
        """``round, bleu_smoothed, bleu_strict, sari, meteor``: a row per round, each from one pass over its table."""
        rounds = []
        for number, path in self.paths().items():
            table = self.spark.read.parquet(path)
            scores = corpus_bleu(table, sari=True, also=[F.avg("meteor").alias("meteor")])
            rounds.append(scores.withColumn("round", F.lit(number)))
        return reduce(DataFrame.unionByName, rounds)

    @property
    def best(self) -> DataFrame:
        """The best corpus BLEU and the best SARI, each over all rounds."""
        return best_over_rounds(self.corpus.withColumnRenamed("bleu_smoothed", "bleu"))


def evaluate_rounds(
    pairs: DataFrame,
    wordpiece: WordPiece,
    factories: Sequence[Callable[[], Predictor]],
    folder: str,
    max_len: int = 512,
    double_specials: bool = True,
    strip_specials: bool = False,
    stems: bool = True,
    row_id: str = "row_id",
) -> Rounds:
    """Evaluate one predictor per round, with the scores and the score lines of each below ``folder``.

    Rounds that an earlier run has committed there are left as they are, so a lost job goes on at the first round
    without a manifest row. Both sides are encoded once for all rounds that are left.
    """
    rounds = Rounds(pairs.sparkSession, folder)
    done = rounds.paths()
    left = [(i, factory) for i, factory in enumerate(factories) if i not in done]
    if left:
        fields = written(decoded_fields(pairs, wordpiece, max_len, double_specials, strip_specials, row_id), "fields")
        for number, factory in left:
            rounds.commit(number, _scored(fields, wordpiece, factory, True, row_id, stems).sentences)
    return rounds


def predict_table(lines: DataFrame, factory: Callable[[], Predictor], k: int = 1) -> DataFrame:
    """``row_id, text`` to ``row_id, text, candidate, hypothesis``."""
    return batch_predict(lines, "text", factory, k)
