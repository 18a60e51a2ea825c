"""Applying a predictor to a whole table of sentences."""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.tokens import exploded, split_ws
from .skew import collect_small, lookup

# A predictor maps a list of texts to a list of candidate lists, best first.
Predictor = Callable[[list[str]], list[list[str]]]

# A scored predictor gives any number of candidates in any order, each with its log-probability and its length.
ScoredPredictor = Callable[[list[str]], list[Iterable[tuple[str, float, int]]]]

_BUILT: dict[str, Predictor | ScoredPredictor] = {}


def _once_per_worker(name: str, factory: Callable[[], Predictor]) -> Predictor:
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = factory()
    return _BUILT[name]


def batch_predict(df: DataFrame, text: str, factory: Callable[[], Predictor], k: int = 1) -> DataFrame:
    """Add ``candidate`` (from 1) and ``hypothesis``: up to ``k`` rows per input row.

    ``factory`` runs once per Python worker, so a model is loaded there and not per batch.
    """
    name = uuid.uuid4().hex
    schema = T.StructType(
        [*df.schema.fields, T.StructField("candidate", T.IntegerType()), T.StructField("hypothesis", T.StringType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = _once_per_worker(name, factory)
        for batch in batches:
            texts = [t or "" for t in batch.column(text).to_pylist()]
            found = [c[:k] for c in predict(texts)]
            rows = pa.array([i for i, c in enumerate(found) for _ in c], pa.int32())
            repeated = batch.take(rows)
            candidate = pa.array([i + 1 for c in found for i in range(len(c))], pa.int32())
            hypothesis = pa.array([h for c in found for h in c], pa.string())
            yield pa.RecordBatch.from_arrays(
                [*repeated.columns, candidate, hypothesis], [*batch.schema.names, "candidate", "hypothesis"]
            )

    return df.mapInArrow(run, schema)


def candidate_score(logp: float, length: int, score: str, alpha: float) -> float:
    """The scores of ``rank_candidates`` for one candidate."""
    if score == "length_power":
        return logp / length**alpha
    return logp / (length - 1 + 1e-6) if score == "mean" else logp


def scored_predict(
    df: DataFrame, text: str, factory: Callable[[], ScoredPredictor], k: int = 1, score: str = "length_power", alpha: float = 0.7
) -> DataFrame:
    """The ``k`` best candidates per input row, with ``rank`` (from 1), ``hypothesis``, ``logp``, ``length`` and ``score``.

    Candidates may come from a generator: at most ``k`` of a row are held, and no others leave the worker, so nothing is
    shuffled however many a beam gives. Of equal scores the earlier candidate is better, as in ``rank_candidates``. Null
    texts are predicted as empty ones; a row without candidates gives no row.
    """
    name = uuid.uuid4().hex
    if score not in ("length_power", "mean", "raw"):
        raise ValueError(f"unknown score {score}")
    added = "rank int, hypothesis string, logp double, length int, score double"
    fields = T.StructType.fromDDL(added).fields
    schema = T.StructType([*df.schema.fields, *fields])
    kinds = [pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.float64()]

    def best(candidates: Iterable[tuple[str, float, int]]) -> list[tuple]:
        scored = ((candidate_score(logp, length, score, alpha), -i, h, logp, length) for i, (h, logp, length) in enumerate(candidates))
        return heapq.nlargest(k, scored, key=lambda c: c[:2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = _once_per_worker(name, factory)
        for batch in batches:
            rows, columns = [], [[] for _ in fields]
            for i, candidates in enumerate(predict([t or "" for t in batch.column(text).to_pylist()])):
                for rank, (value, _, hypothesis, logp, length) in enumerate(best(candidates), 1):
                    rows.append(i)
                    for column, x in zip(columns, (rank, hypothesis, logp, length, value), strict=True):
                        column.append(x)
            repeated = batch.take(pa.array(rows, pa.int32()))
            arrays = [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*repeated.columns, *arrays], [*batch.schema.names, *(f.name for f in fields)])

    return df.mapInArrow(run, schema)


def without_a_word() -> ScoredPredictor:
    """Every text that leaves out one word, as a generator; an eighth of its length in code points is lost in log-probability."""

    def shorter(text: str) -> Iterator[tuple[str, float, int]]:
        words = text.split()
        for i, word in enumerate(words):
            yield " ".join(words[:i] + words[i + 1 :]), -len(word) / 8, len(words)

    return lambda texts: [shorter(t) for t in texts]


def identity() -> Predictor:
    """The input as its own and only candidate."""
    return lambda texts: [[t] for t in texts]


def substitute_words(table) -> Callable[[], Predictor]:
    """Replace every white-space token found in the shared dictionary."""

    def factory() -> Predictor:
        words = table.value
        return lambda texts: [[" ".join(words.get(w, w) for w in t.split())] for t in texts]

    return factory


def lexical_substitution(df: DataFrame, text: str, lexicon: DataFrame, key: list[str], small: bool | None = None) -> DataFrame:
    """Replace tokens by a table ``word, simple``; adds ``hypothesis``.

    A lexicon of checked small size goes to the workers; a larger one is joined by token with salted
    keys and the tokens are gathered again by row.
    """
    rows = None if small is False else collect_small(lexicon.select("word", "simple"))
    if rows is not None:
        table = df.sparkSession.sparkContext.broadcast({r[0]: r[1] for r in rows})
        return batch_predict(df, text, substitute_words(table)).drop("candidate")
    flat = exploded(df, key, split_ws(F.col(text)), "__word", "__pos")
    found = lookup(flat, lexicon.select("word", "simple"), [("__word", "word")], "left", F.xxhash64(*key, "__pos"), small=False)
    pairs = found.select(*key, F.struct("__pos", F.coalesce("simple", "__word").alias("w")).alias("e"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list("e")), lambda e: e["w"]), " ")
    texts = pairs.groupBy(*key).agg(joined.alias("hypothesis"))
    return df.join(texts, key, "left").withColumn("hypothesis", F.coalesce("hypothesis", F.lit("")))
