"""Readers and writers: tables go out through a writer and come back through a reader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import sinks, sources
from ..functions.tokens import split_fields, split_ws
from ..operators.meteor import meteor
from ..operators.ngram_metrics import sentence_scores
from ..operators.skew import lookup
from ..operators.split import document_split
from ..session import shared_dir, written
from .metrics import BLEU, METEOR_OF_TOKENS, METEOR_SCORE, _smoothed_sql as smoothed_sql
from .registry import query
from .tables import ALIGNED, CORPORA, N_TRAIN, N_VALID, TRIPLES, aligned, next_turns, table, triples, wiki

_ROW = "doc_id, docv_input, docv_output, input, output"
_PLACE = "row_number() OVER (ORDER BY row_id) - 1 AS row_id"


@query("src_01_read_aligned_pairs", f"WITH {ALIGNED} SELECT {_PLACE}, {_ROW} FROM aligned")
def read_aligned_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "aligned")
    sinks.write_headerless(aligned(spark, sf_dir).orderBy("row_id").drop("row_id"), path)
    return sources.read_aligned_pairs(spark, path)


@query("src_02_read_pairs", f"WITH {CORPORA} SELECT {_PLACE}, input, output FROM wiki")
def read_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "pairs")
    sinks.write_headerless(wiki(spark, sf_dir).orderBy("row_id").drop("row_id"), path)
    return sources.read_pairs(spark, path)


@query("src_03_read_scored_pairs", f"WITH {CORPORA} SELECT {_PLACE}, input, output FROM next_turns")
def read_scored_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "scored")
    rows = next_turns(spark, sf_dir).orderBy("row_id").select("input", "output", F.col("role").alias("matching"))
    sinks.write_headerless(rows, path)
    return sources.read_scored_pairs(spark, path)


_TEXTS = "texts AS (SELECT doc_id AS row_id, lang AS input, text AS output FROM documents)"
_NUMBERED = "numbered AS (SELECT row_number() OVER (ORDER BY row_id) - 1 AS row_id, input, output FROM texts)"


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("row_id"), F.col("lang").alias("input"), F.col("text").alias("output")
    )


@query(
    "src_04_read_prepared_pairs",
    f"WITH {_TEXTS}, {_NUMBERED} SELECT min(row_id) AS row_id, input, output FROM numbered GROUP BY input, output",
)
def read_prepared_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "prepared-pairs")
    sinks.write_prepared(texts(spark, sf_dir).orderBy("row_id").drop("row_id"), path)
    return sources.read_prepared_pairs(spark, path)


@query(
    "src_05_read_prepared_aligned",
    f"WITH {ALIGNED}, marked AS (SELECT row_id * 2 AS row_id, {_ROW} FROM aligned UNION ALL "
    "SELECT row_id * 2 + 1, doc_id, docv_input, docv_output, input, '[CLS] [SEP]' FROM aligned WHERE docv_output = 'V1'), "
    f"placed AS (SELECT {_PLACE}, {_ROW} FROM marked) SELECT * FROM placed WHERE output <> '[CLS] [SEP]'",
)
def read_prepared_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "prepared")
    pairs = aligned(spark, sf_dir).withColumn("row_id", F.col("row_id") * 2)
    # Rows with the marks of an empty side are written between the others.
    empty = pairs.filter("docv_output = 'V1'").withColumn("output", F.lit("[CLS] [SEP]"))
    rows = pairs.unionByName(empty.withColumn("row_id", F.col("row_id") + 1))
    sinks.write_prepared(rows.orderBy("row_id").drop("row_id"), path)
    return sources.read_prepared_aligned(spark, path)


_HEADS = f"""docs AS (SELECT doc_id, row_number() OVER (ORDER BY min(row_id)) - 1 AS rank FROM aligned GROUP BY doc_id),
tagged AS (SELECT a.*, CASE WHEN rank < {N_TRAIN} THEN 'train' WHEN rank < {N_TRAIN + N_VALID} THEN 'valid'
  ELSE 'test' END AS split FROM aligned a JOIN docs USING (doc_id))"""
PRESPLIT = f"""{ALIGNED}, {_HEADS},
presplit AS (SELECT split, row_number() OVER (PARTITION BY split ORDER BY row_id) - 1 AS row_id,
  replace(input, chr(10), ' ') AS input, replace(output, chr(10), ' ') AS output FROM tagged)"""


def presplit_paths(spark: SparkSession, sf_dir: str) -> dict[str, tuple[str, str]]:
    """Parallel files of the aligned corpus by document split."""
    base = shared_dir(spark, "presplit")
    rows = document_split(aligned(spark, sf_dir), N_TRAIN, N_VALID, keep_last=False)
    for name in ("train", "valid", "test"):
        sinks.write_parallel(rows.filter(F.col("split") == name), f"{base}/{name}")
    return {name: (f"{base}/{name}.src", f"{base}/{name}.dst") for name in ("train", "valid", "test")}


@query("src_06_read_parallel_outer", f"WITH {PRESPLIT} SELECT * FROM presplit")
def read_parallel_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.read_parallel_outer(spark, presplit_paths(spark, sf_dir))


@query(
    "src_07_read_parallel_lines",
    f"WITH {CORPORA} SELECT {_PLACE}, trim(replace(input, chr(10), ' ')) AS input, "
    "trim(replace(output, chr(10), ' ')) AS output FROM wiki",
)
def read_parallel_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "lines")
    sinks.write_parallel(wiki(spark, sf_dir), path)
    return sources.read_parallel_lines(spark, f"{path}.src", f"{path}.dst")


_LINES = """lines AS (SELECT row_number() OVER (ORDER BY doc_id, p) - 1 AS row_id, trim(line) AS text FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS p FROM documents))"""


@query("src_08_read_lines", f"WITH {_LINES} SELECT * FROM lines")
def read_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "origins")
    table(spark, sf_dir, "documents").orderBy("doc_id").select("text").write.text(path)
    return sources.read_lines(spark, path)


@query(
    "src_09_read_raw_split",
    f"WITH {ALIGNED} SELECT doc_id, docv_input, docv_output, replace(input, chr(10), ' ') AS input, "
    "replace(output, chr(10), ' ') AS output, CASE docv_output WHEN 'V1' THEN docv_input || '|' || doc_id ELSE '' END AS rest FROM aligned",
)
def read_raw_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "raw")
    rows = aligned(spark, sf_dir)
    escaped = [F.replace(c, F.lit("\n"), F.lit("\\n")) for c in ("input", "output")]
    # Some lines have fields after the fifth.
    more = F.when(F.col("docv_output") == "V1", F.concat_ws("\t", "docv_input", "doc_id"))
    rows.select(F.concat_ws("\t", "doc_id", "docv_input", "docv_output", *escaped, more)).write.text(path)
    split = sources.read_raw_split(spark, path, rest="rest")
    return split.withColumn("rest", F.array_join("rest", "|"))


_METADATA = T.StructType(
    [T.StructField("slug", T.LongType()), T.StructField("version", T.IntegerType()), T.StructField("title", T.StringType())]
)


@query(
    "src_10_read_article_metadata",
    "SELECT conv_id AS slug, CAST(turn AS INTEGER) AS version, role AS title FROM conversations",
)
def read_article_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "metadata")
    rows = table(spark, sf_dir, "conversations")
    rows.select(F.col("conv_id").alias("slug"), F.col("turn").alias("version"), F.col("role").alias("title")).write.option(
        "header", True
    ).csv(path)
    return sources.read_article_metadata(spark, path, _METADATA)


_ARTICLE = T.StructType([T.StructField("line", T.IntegerType()), T.StructField("text", T.StringType())])


@query(
    "src_11_read_nested_articles",
    "SELECT doc_id, lang AS language, generate_subscripts(string_split(text, chr(10)), 1)::INTEGER AS line, "
    "unnest(string_split(text, chr(10))) AS text FROM documents",
)
def read_nested_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "articles")
    docs = table(spark, sf_dir, "documents")
    lines = F.transform(
        F.split("text", "\n"), lambda t, i: F.struct((i + 1).alias("line"), t.alias("text"))
    )
    docs.select("doc_id", F.col("lang").alias("language"), lines.alias("articles")).write.json(path)
    records = sources.read_nested_articles(spark, path, _ARTICLE, keys="doc_id BIGINT")
    return sources.flatten_articles(records, ["doc_id", "language"])


@query(
    "src_12_read_text_shards",
    "SELECT source AS shard, row_number() OVER (PARTITION BY source ORDER BY doc_id, p) - 1 AS line, text FROM ("
    "SELECT source, doc_id, unnest(string_split(text, chr(10))) AS text, "
    "generate_subscripts(string_split(text, chr(10)), 1) AS p FROM documents)",
)
def read_text_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "shards")
    docs = table(spark, sf_dir, "documents")
    # A source's documents follow one another by id, so the line numbers of its files can be told.
    parts = docs.repartitionByRange("source", "doc_id").sortWithinPartitions("source", "doc_id")
    parts.select("source", "text").write.partitionBy("source").text(path)
    lines = sources.read_text_shards(spark, f"{path}/source=*")
    source, part = (F.regexp_extract("shard", pattern, 1) for pattern in (r"source=([^/]+)/", r"/part-(\d+)-"))
    lines = written(lines.select(source.alias("source"), part.cast("int").alias("part"), "line", "text"), "lines")
    # A source may have several files: lines are numbered on from the files before, of which there are few.
    sizes = lines.groupBy("source", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("source", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    numbered = lookup(lines, starts, [("source", "source"), ("part", "part")], "inner")
    return numbered.select(F.col("source").alias("shard"), (F.col("line") + F.col("start")).alias("line"), "text")


# ---------------------------------------------------------------- writers


@query("snk_01_write_prepared", f"WITH {CORPORA} SELECT input, output FROM wiki")
def write_prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "snk01")
    sinks.write_prepared(wiki(spark, sf_dir).select("input", "output"), path)
    return sources.read_prepared_pairs(spark, path).drop("row_id")


@query(
    "snk_02_write_parallel",
    f"WITH {CORPORA} SELECT {_PLACE}, input, output FROM wiki",
)
def write_parallel(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "snk02")
    sinks.write_parallel(wiki(spark, sf_dir), path, quoting="minimal")
    left = sources.read_column(spark, f"{path}.src", "input", sep=",")
    return left.join(sources.read_column(spark, f"{path}.dst", "output", sep=","), "row_id")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = triples(spark, sf_dir)
    names = ("origin", "hypothesis", "reference")
    tokens = rows.select("conv_id", "turn", *[split_ws(F.col(n)).alias(n) for n in names])
    bleu = sentence_scores(tokens, ["conv_id", "turn"], sari=False, partitioned=True, unique=True).select("conv_id", "turn", "bleu")
    flat = [F.translate(n, "\n", " ").alias(n) for n in names]
    score = meteor(F.col("hypothesis"), F.col("reference"), stems=False).alias("meteor")
    return rows.select("conv_id", "turn", score, *flat).join(bleu, ["conv_id", "turn"])


@query(
    "snk_05_write_sentence_scores",
    f"WITH {BLEU}, {METEOR_OF_TOKENS} SELECT round({smoothed_sql('greatest(t{n}, 1)')}, 6) AS bleu, meteor, "
    "replace(origin, chr(10), ' ') AS origin, replace(reference, chr(10), ' ') AS reference, "
    "'|' AS mark, replace(hypothesis, chr(10), ' ') AS hypothesis FROM triples JOIN bleu_parts USING (conv_id, turn) "
    f"JOIN (SELECT conv_id, turn, round({METEOR_SCORE}, 6) AS meteor FROM q) USING (conv_id, turn)",
)
def write_sentence_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "snk05")
    sinks.write_sentence_scores(_scored(spark, sf_dir), path, "text")
    names = ["bleu", "meteor", "origin", "reference", "mark", "hypothesis"]
    lines = spark.read.text(path).select(*split_fields(F.col("value"), names))
    for name in ("bleu", "meteor"):
        lines = lines.withColumn(name, F.round(F.col(name).cast("double"), 6))
    return lines
