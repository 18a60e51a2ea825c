"""Token totals by source, language and tokenizer version, kept up to date by signed batches.

A batch holds what changed: documents that came, documents that went, and counts that were revised. Its sums are
committed under the batch's name, and totals are the sums over all batches; a batch that is committed again
replaces itself, so repeated and retried commits count once.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_dir, written

TOKENIZER_FILE = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the public pattern that splits text before the merges of such files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
KEYS = ["source", "lang", "tokenizer"]
MEASURES = ["docs", "tokens"]
DELTAS = T.StructType(
    [T.StructField(k, T.StringType()) for k in KEYS] + [T.StructField(m, T.LongType()) for m in MEASURES]
)
_ENCODERS: dict[str, object] = {}


def _encoder(name: str, ranks: bytes):
    if name not in _ENCODERS:
        import tiktoken

        pairs = (line.split() for line in ranks.splitlines() if line)
        merges = {base64.b64decode(token): int(rank) for token, rank in pairs}
        _ENCODERS[name] = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})
    return _ENCODERS[name]


def count_tokens(docs: DataFrame, keep: list[str], text: str = "text", path: str = TOKENIZER_FILE) -> DataFrame:
    """The columns ``keep`` of ``docs`` with ``bpe_tokens``; a null text has none.

    The vocabulary file is read on the driver and sent to the tasks.
    """
    with open(path, "rb") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, shared.value)
        for batch in batches:
            texts = batch.column("__text")
            counts = [len(encoder.encode_ordinary(t.as_py() or "")) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [*map(batch.column, keep), pa.array(counts, pa.int64())], [*keep, "bpe_tokens"]
            )

    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField("bpe_tokens", T.LongType())])
    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)


def inserts(counted: DataFrame) -> DataFrame:
    """Deltas of new documents: ``counted`` has ``source, lang, tokenizer, tokens``, a row per document."""
    return counted.select(*KEYS, F.lit(1).cast("long").alias("docs"), F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"))


def deletes(counted: DataFrame) -> DataFrame:
    """Deltas of documents that went: their last counts with the other sign."""
    return inserts(counted).select(*KEYS, (-F.col("docs")).alias("docs"), (-F.col("tokens")).alias("tokens"))


def revisions(before: DataFrame, after: DataFrame) -> DataFrame:
    """Deltas of documents that were counted again: the old counts go, the new ones come, keys may change."""
    return deletes(before).unionByName(inserts(after))


class Rollup:
    """Committed batches below a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def commit(self, batch: str, deltas: DataFrame) -> None:
        """Add a batch; one committed before under this name is replaced.

        Sums are taken per task first, so a hot source costs each task one row. Files appear when the write has
        succeeded as a whole. A row that counts nothing makes a batch without deltas replace the earlier one too.
        """
        nothing = self.spark.range(1).select(
            *[F.lit(None).cast("string").alias(k) for k in KEYS], *[F.lit(0).cast("long").alias(m) for m in MEASURES]
        )
        sums = deltas.select(*KEYS, *MEASURES).unionByName(nothing).groupBy(*KEYS).agg(*[F.sum(m).alias(m) for m in MEASURES])
        (
            sums.withColumn("batch", F.lit(batch))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("batch")
            .parquet(self.folder)
        )

    def totals(self) -> DataFrame:
        """``source, lang, tokenizer, docs, tokens``; keys whose documents have all gone are left out."""
        schema = T.StructType([*DELTAS.fields, T.StructField("batch", T.StringType())])
        rows = self.spark.read.schema(schema).parquet(self.folder)
        sums = rows.groupBy(*KEYS).agg(*[F.sum(m).alias(m) for m in MEASURES])
        return sums.filter((F.col("docs") != 0) | (F.col("tokens") != 0))


def words(column: str):
    return F.coalesce(F.regexp_count(column, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def maintained_totals(docs: DataFrame, folder: str | None = None, batches: int = 4, path: str = TOKENIZER_FILE) -> DataFrame:
    """The life of a table of documents as batches; returns the totals at its end.

    Every document is inserted with its words (``words/1``) in one of ``batches`` batches, and one batch is
    committed twice. Then all counts are revised to byte-pair tokens (``bpe/1``) beside a second insert of words
    (``words/2``), and at last the whole of ``words/2`` is deleted again. Null sources, languages and texts are
    keys and empty texts of their own; equal rows count each; an empty table has no totals.
    """
    spark = docs.sparkSession
    rollup = Rollup(spark, folder or shared_dir(spark, "rollup"))
    counted = docs.select("source", "lang", words("text").alias("words"), F.xxhash64("doc_id").alias("draw"), "text")
    counted = written(count_tokens(counted, ["source", "lang", "words", "draw"], path=path), "token-counts")

    def version(tokenizer: str, tokens: str) -> DataFrame:
        return counted.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), F.col(tokens).alias("tokens"), "draw")

    first = version("words/1", "words")
    for number in [*range(batches), 0]:
        rollup.commit(f"insert-{number}", inserts(first.filter(F.pmod("draw", F.lit(batches)) == number)))
    rollup.commit("revise", revisions(first, version("bpe/1", "bpe_tokens")))
    rollup.commit("words-2", inserts(version("words/2", "words")))
    rollup.commit("words-2-gone", deletes(version("words/2", "words")))
    rollup.commit("words-1-again", inserts(first))
    return rollup.totals()
