"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

A lexicon of words and word beginnings is learned from labelled documents by log-odds; the features are
its densities, how near its words stand to second-person words, and rates of capitals, punctuation and
obfuscation. Lexicon, trees and calibration are fitted on rows of their own.

Spark ML is imported by what fits and scores on the driver: workers read this module for its features only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written
from .decontaminate import free_name
from .words import SLICE_BYTES, Words, alphabet, word_slices

# At most so many labelled rows are used, picked by hash: about half for the lexicon, the rest for trees and calibration.
MAX_LABELLED = 40_000
HELD_OUT = 2
THRESHOLD = 0.3
# Bytes of a word's beginning that may be a lexicon entry of its own, besides the whole word.
BEGINNINGS = (5, 6, 7, 8, 10)
MIN_TOXIC_DOCS = 3
MAX_LEXICON = 20_000
NEAR = 8

# Second-person words in English, German, French and Spanish.
SECOND_PERSON = (
    "you your yours yourself u ur du dich dir dein deine deinen deiner ihr euch euer eure "
    "tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros"
).split()
# Characters that stand for letters in obfuscated words.
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}

FEATURES = (
    "strongest second_strongest hits hit_rate weight_rate near_rate second_rate capital_rate exclaim_rate "
    "punct_rate odd_rate mark_rate log_words word_length repeat_rate"
).split()


def _letters() -> np.ndarray:
    table = alphabet(lambda b: 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80 or b in b"@$")
    for sign, letter in LOOKALIKES.items():
        table[ord(sign)] = ord(letter)
    return table


_TABLE = _letters()
_IN = {
    "capital": alphabet(lambda b: 0x41 <= b <= 0x5A),
    "letter": alphabet(lambda b: 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A),
    "exclaim": alphabet(lambda b: b in b"!?"),
    "punct": alphabet(lambda b: b in b".,;:!?-_\"'()[]|/"),
    "odd": alphabet(lambda b: b in b"013457@$"),
    "mark": alphabet(lambda b: b in b"*#^~"),
}


def lower(text: Column) -> Column:
    """Lower case of all letters; null is empty."""
    return F.lower(F.coalesce(text, F.lit("")))


def _own_lower(text: Column) -> Column:
    """Lower case of texts with other than ASCII letters; null for the others, whose A-Z the table of words lowers."""
    return F.when(F.octet_length(text) > F.char_length(text), F.lower(text))


def _parts(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``SLICE_BYTES`` of text each, so that what is made of a batch doesn't follow its size."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes, dtype=np.int64) // SLICE_BYTES)) + 1
    for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
        yield batch.slice(low, high - low)


def _hash_words(texts: list[str]) -> np.ndarray:
    return np.concatenate([w.hashes for w in word_slices(pa.array(texts), _TABLE)])


def _entries(words: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Word numbers and hashes: the whole words, then each beginning."""
    yield np.arange(len(words.hashes)), words.hashes
    for size in BEGINNINGS:
        yield words.prefixes(size)


def _document_entries(docs: DataFrame) -> DataFrame:
    """``toxic, entry``: the distinct entries of each document of ``docs(lowered, toxic)``, counted per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = np.array(batch.column("toxic").to_pylist(), dtype=np.int64)
            for words in word_slices(batch.column("lowered"), _TABLE):
                doc_of = np.searchsorted(words.bounds, np.arange(len(words.hashes)), side="right") - 1
                docs_, found = [], []
                for number, hashes in _entries(words):
                    docs_.append(doc_of[number])
                    found.append(hashes)
                pair = np.unique(np.stack([np.concatenate(found), np.concatenate(docs_).astype(np.uint64)]), axis=1)
                is_toxic = toxic[words.first + pair[1].astype(np.int64)]
                entry, place = np.unique(pair[0], return_inverse=True)
                n_toxic = np.bincount(place, weights=is_toxic, minlength=len(entry)).astype(np.int64)
                n = np.bincount(place, minlength=len(entry)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(entry.view(np.int64)), pa.array(n_toxic), pa.array(n - n_toxic)], ["entry", "toxic", "clean"]
                )

    return docs.mapInArrow(run, "entry long, toxic long, clean long")


def learn_lexicon(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted entry hashes and their weights, from ``docs(lowered, toxic)``.

    A weight is the lower bound of an entry's log-odds of being in a toxic document rather than a clean one. At
    most ``MAX_LEXICON`` entries, the heaviest, reach the driver.
    """
    counts = _document_entries(docs).groupBy("entry").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    sizes = docs.agg(F.sum("toxic"), F.count(F.lit(1))).first()
    toxic, clean = sizes[0] or 0, sizes[1] - (sizes[0] or 0)
    t, c = F.col("t") + 0.5, F.col("c") + 0.5
    weight = F.log(t / (toxic + 1.0)) - F.log(c / (clean + 1.0)) - 1.64 * F.sqrt(1 / t + 1 / c)
    rows = (
        counts.filter(F.col("t") >= MIN_TOXIC_DOCS)
        .select("entry", weight.alias("weight"))
        .filter("weight > 1")
        .orderBy(F.desc("weight"), "entry")
        .limit(MAX_LEXICON)
        .toArrow()
    )
    entries = rows.column("entry").to_numpy().view(np.uint64)
    order = np.argsort(entries)
    return entries[order], rows.column("weight").to_numpy()[order]


def features(column: pa.Array, lowered: pa.Array, lexicon: tuple[np.ndarray, np.ndarray], second: np.ndarray) -> np.ndarray:
    """A row of ``FEATURES`` for each text."""
    out = []
    entries, weights = lexicon
    for words in word_slices(lowered, _TABLE):
        n, total = len(words), len(words.hashes)
        weight = np.zeros(total)
        for number, hashes in _entries(words) if len(entries) else ():
            at = np.minimum(np.searchsorted(entries, hashes), len(entries) - 1)
            np.maximum.at(weight, number, np.where(entries[at] == hashes, weights[at], 0.0))
        doc_of = np.searchsorted(words.bounds, np.arange(total), side="right") - 1
        hit, person = np.flatnonzero(weight > 0), np.flatnonzero(np.isin(words.hashes, second))
        near = np.zeros(len(hit), dtype=bool)
        if len(person):
            at = np.searchsorted(person, hit)
            for other in (np.minimum(at, len(person) - 1), np.maximum(at - 1, 0)):
                near |= (np.abs(person[other] - hit) <= NEAR) & (doc_of[person[other]] == doc_of[hit])

        def per_doc(places, weights=None, n=n, doc_of=doc_of):
            return np.bincount(doc_of[places], weights=weights, minlength=n)[:n]

        top = np.zeros((n, 2))
        # By text, heaviest first; an entry that repeats in a text is as good as two.
        order = hit[np.lexsort((-weight[hit], doc_of[hit]))]
        if len(order):
            owner = doc_of[order]
            start = np.searchsorted(owner, owner)
            rank = np.arange(len(order)) - start
            for k in (0, 1):
                top[owner[rank == k], k] = weight[order[rank == k]]
        same = np.flatnonzero((words.hashes[1:] == words.hashes[:-1]) & (doc_of[1:] == doc_of[:-1]))
        size = np.diff(words.bounds)
        per = np.maximum(size, 1)
        counts = _byte_counts(column.slice(words.first, n))
        letters, chars = np.maximum(counts["letter"], 1), np.maximum(counts["bytes"], 1)
        length = np.bincount(doc_of, weights=words.ends - words.starts, minlength=n)[:n]
        out.append(
            np.stack(
                [
                    top[:, 0],
                    top[:, 1],
                    per_doc(hit),
                    per_doc(hit) / per,
                    per_doc(hit, weight[hit]) / per,
                    per_doc(hit[near]) / per,
                    per_doc(person) / per,
                    counts["capital"] / letters,
                    counts["exclaim"] / chars,
                    counts["punct"] / chars,
                    counts["odd"] / chars,
                    counts["mark"] / chars,
                    np.log1p(size),
                    length / per,
                    per_doc(same) / per,
                ],
                axis=1,
            )
        )
    return np.concatenate(out) if out else np.zeros((0, len(FEATURES)))


def _byte_counts(column: pa.Array) -> dict[str, np.ndarray]:
    """How many bytes of each kind every text has."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    at = offsets - offsets[0]
    counts = {"bytes": np.diff(at)}
    for name, table in _IN.items():
        places = np.flatnonzero(table[data])
        counts[name] = np.diff(np.searchsorted(places, at))
    return counts


def add_features(docs: DataFrame, lexicon: tuple[np.ndarray, np.ndarray], text: str, keep: list[str]) -> tuple[DataFrame, str]:
    """The columns ``keep`` of ``docs`` with an array of features; and that column's name."""
    column, lowered, plain = (free_name(docs, c) for c in ("features", "lowered", "plain"))
    # A text that is kept anyway isn't sent twice.
    sent = [] if text in keep else [F.col(text).alias(plain)]
    plain = plain if sent else text
    shared = docs.sparkSession.sparkContext.broadcast((lexicon, _hash_words(SECOND_PERSON)))
    schema = T.StructType(
        [*[docs.schema[c] for c in keep], T.StructField(column, T.ArrayType(T.DoubleType(), False), False)]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, second = shared.value
        for batch in batches:
            for part in _parts(batch, plain):
                text = part.column(plain)
                found = features(text, pc.coalesce(part.column(lowered), text), lexicon, second)
                flat = pa.array(found.ravel())
                ends = pa.array(np.arange(len(found) + 1, dtype=np.int32) * len(FEATURES))
                rows = pa.ListArray.from_arrays(ends, flat)
                yield pa.RecordBatch.from_arrays([*map(part.column, keep), rows], [*keep, column])
            # What a batch took goes back before the next one comes, and before another stage uses this worker.
            del batch, part, text, found, flat, rows
            pa.default_memory_pool().release_unused()

    return docs.select(*keep, *sent, _own_lower(F.col(text)).alias(lowered)).mapInArrow(run, schema), column


@dataclass
class ToxicityModel:
    """``trees`` and ``curve`` are None when the labels have one class only; the score is then ``base``."""

    lexicon: tuple[np.ndarray, np.ndarray]
    trees: object
    curve: object
    base: float

    def score(self, docs: DataFrame, text: str, keep: list[str]) -> tuple[DataFrame, str]:
        """The columns ``keep`` of ``docs`` with a score from 0 to 1; and that column's name."""
        from pyspark.ml.functions import array_to_vector, vector_to_array

        name = free_name(docs, "toxicity")
        if self.trees is None:
            return docs.select(*keep, F.lit(self.base).alias(name)), name
        found, column = add_features(docs, self.lexicon, text, keep)
        x, margin, out, label, p, score = (free_name(docs, c) for c in ("x", "margin", "out", "class", "p", "score"))
        trees = self.trees.copy({self.trees.featuresCol: x, self.trees.rawPredictionCol: margin})
        trees = trees.copy({trees.probabilityCol: out, trees.predictionCol: label})
        raw = trees.transform(found.withColumn(x, array_to_vector(column))).withColumn(p, vector_to_array(out)[1])
        curve = self.curve.copy({self.curve.featuresCol: p, self.curve.predictionCol: score})
        return curve.transform(raw).select(*keep, F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)).alias(name)), name


def held_out(key: Column) -> Column:
    """Whether a row's label must not be learned from."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == HELD_OUT, F.lit(False))


def train(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", max_labelled: int = MAX_LABELLED
) -> ToxicityModel:
    """Fit on the labelled documents that aren't held out, ``max_labelled`` of them at most.

    Rows without an id or a label teach nothing; of several labels of one id the largest counts.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.regression import IsotonicRegression

    known = labels.filter(F.col(key).isNotNull() & F.col("toxic").isNotNull()).filter(~held_out(F.col(key)))
    known = known.groupBy(F.col(key).alias("__id")).agg(F.max("toxic").cast("long").alias("toxic"))
    n = known.count()
    draw = F.pmod(F.xxhash64(F.lit(10), "__id"), F.lit(1 << 20)) / float(1 << 20)
    known = known.filter(draw < max_labelled / max(n, 1))
    fold = F.pmod(F.xxhash64(F.lit(11), "__id"), F.lit(10))
    # The draw leaves about ``max_labelled`` ids at any size of the tables, two numbers each; no text is shuffled.
    rows = docs.select(F.col(key).alias("__id"), F.col(text).alias("text")).join(F.broadcast(known), "__id")
    rows = written(rows.select("text", lower(F.col("text")).alias("lowered"), "toxic", fold.alias("fold")), "labelled")
    base, classes = rows.agg(F.avg("toxic"), F.count_distinct("toxic")).first()
    if classes < 2:
        return ToxicityModel((np.zeros(0, np.uint64), np.zeros(0)), None, None, float(base or 0.0))
    lexicon = learn_lexicon(rows.filter("fold < 5").select("lowered", "toxic"))
    found, column = add_features(rows, lexicon, "text", ["toxic", "fold"])
    found = written(found.select("toxic", "fold", array_to_vector(column).alias("__x")), "features")
    fit, rest = found.filter("fold between 5 and 8"), found.filter("fold = 9")
    if fit.agg(F.count_distinct("toxic")).first()[0] < 2:
        fit = found
    trees = GBTClassifier(
        featuresCol="__x",
        labelCol="toxic",
        predictionCol="__class",
        maxDepth=3,
        maxIter=24,
        stepSize=0.25,
        seed=5,
    )
    trees = trees.setProbabilityCol("__out").setRawPredictionCol("__margin").fit(fit.select("__x", "toxic"))
    if rest.agg(F.count_distinct("toxic")).first()[0] < 2:
        rest = fit
    curve = IsotonicRegression(featuresCol="__p", labelCol="toxic", predictionCol="__score").fit(
        trees.transform(rest.select("__x", "toxic")).select("toxic", vector_to_array("__out")[1].alias("__p"))
    )
    return ToxicityModel(lexicon, trees, curve, float(base))


def toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    Null and empty texts get the score of a text without words; rows without an id are scored and not held
    out. Only ``key``, ``text`` and the labels are read.
    """
    model = train(docs, labels, key, text, **options)
    scored, name = model.score(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), "text", ["doc_id"])
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col(name).alias("score"),
        (F.col(name) >= THRESHOLD).cast("int").alias("predicted"),
    )
