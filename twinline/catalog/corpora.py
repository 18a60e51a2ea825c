"""Filters, joins, sets, counts and splits over the pair corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import filters, joins, profile, sets, split
from ..operators.position import prefix_sum
from ..plans.splits import split_aligned, split_wiki
from ..session import shared_dir
from ..sinks import write_prepared
from ..sources import read_prepared_aligned
from .registry import query
from .tables import ALIGNED, CORPORA, N_TRAIN, N_VALID, aligned, hash_sql, health, table, wiki

_ROW = "doc_id, docv_input, docv_output, input, output"


def _rows(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "docv_input", "docv_output", "input", "output")


# ---------------------------------------------------------------- filters


@query(
    "fil_01_drop_adjacent_versions",
    f"WITH {ALIGNED} SELECT {_ROW} FROM aligned WHERE (docv_input, docv_output) NOT IN "
    "(('V0', 'V1'), ('V1', 'V2'), ('V2', 'V3'))",
)
def drop_adjacent_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(filters.drop_adjacent_versions(aligned(spark, sf_dir)))


# Rows with the marks of an empty side are added to the whole corpus.
_MARKED = """marked AS (
  SELECT row_id, input, output FROM wiki
  UNION ALL SELECT row_id, '[CLS] nan [SEP]', output FROM health
  UNION ALL SELECT row_id, input, '[CLS] [SEP]' FROM wiki)"""


@query(
    "fil_02_drop_empty_pairs",
    f"WITH {CORPORA}, {_MARKED} SELECT * FROM marked WHERE input NOT IN ('[CLS] nan [SEP]', '[CLS] [SEP]') "
    "AND output NOT IN ('[CLS] nan [SEP]', '[CLS] [SEP]')",
)
def drop_empty_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = wiki(spark, sf_dir)
    no_input = health(spark, sf_dir).withColumn("input", F.lit("[CLS] nan [SEP]"))
    no_output = pairs.withColumn("output", F.lit("[CLS] [SEP]"))
    return filters.drop_empty_pairs(pairs.unionByName(no_input).unionByName(no_output))


@query(
    "fil_05_select_version_pair",
    f"WITH {ALIGNED} SELECT {_ROW} FROM aligned WHERE docv_input = 'V0' AND docv_output = 'V3'",
)
def select_version_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(filters.select_version_pair(aligned(spark, sf_dir), "V0", "V3"))


@query("fil_06_select_target_version", f"WITH {ALIGNED} SELECT {_ROW} FROM aligned WHERE docv_output = 'V4'")
def select_target_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(filters.select_target_version(aligned(spark, sf_dir), "V4"))


@query("fil_07_select_language", "SELECT doc_id, lang, text FROM documents WHERE lang = 'en'")
def select_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.select_language(table(spark, sf_dir, "documents"), "en", "lang").select("doc_id", "lang", "text")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as article versions: ``slug, version``."""
    turns = table(spark, sf_dir, "conversations")
    return turns.select(F.col("conv_id").alias("slug"), F.col("turn").alias("version"))


@query(
    "fil_08_select_versions_in",
    "SELECT conv_id AS slug, turn AS version FROM conversations WHERE turn IN (0, 1, 2, 3, 4, 5, 6)",
)
def select_versions_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.select_versions_in(articles(spark, sf_dir), list(range(7)))


@query("fil_09_project_side", f"WITH {ALIGNED} SELECT output FROM aligned")
def project_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.project_side(aligned(spark, sf_dir), "output")


@query(
    "fil_10_head_n",
    "SELECT min(doc_id) AS row_id, text FROM documents GROUP BY text ORDER BY min(doc_id) LIMIT 5",
)
def head_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), "text")
    return filters.head_n(sets.distinct_rows(texts), 5)


# ---------------------------------------------------------------- joins


_REST = """rest AS (
  SELECT * FROM wiki WHERE NOT (input IN (SELECT input FROM health) AND output IN (SELECT output FROM health)))"""


@query("join_01_exclude_overlap", f"WITH {CORPORA}, {_REST} SELECT * FROM rest")
def exclude_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.exclude_overlap(wiki(spark, sf_dir), health(spark, sf_dir))


_HEADS = f"""firsts AS (SELECT doc_id, min(row_id) AS first_row FROM aligned GROUP BY doc_id),
ranks AS (SELECT doc_id, first_row, row_number() OVER (ORDER BY first_row) - 1 AS rank FROM firsts),
doc_splits AS (SELECT doc_id, CASE WHEN rank < {N_TRAIN} THEN 'train' WHEN rank < {N_TRAIN + N_VALID} THEN 'valid'
               ELSE 'test' END AS split FROM ranks)"""


@query("join_02_assign_split", f"WITH {ALIGNED}, {_HEADS} SELECT row_id, doc_id, split FROM aligned JOIN doc_splits USING (doc_id)")
def assign_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = aligned(spark, sf_dir)
    ranks = split.first_appearance_rank(rows)
    name = F.when(F.col("rank") < N_TRAIN, "train").when(F.col("rank") < N_TRAIN + N_VALID, "valid").otherwise("test")
    return joins.assign_split(rows, ranks.select("doc_id", name.alias("split"))).select("row_id", "doc_id", "split")


@query(
    "join_03_exclude_ids",
    "SELECT doc_id, lang, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)",
)
def exclude_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    toxic = table(spark, sf_dir, "labels").filter(F.col("toxic") == 1)
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return joins.exclude_ids(docs, toxic, "doc_id")


_SIDES = """src AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_id, text AS input FROM documents WHERE lang = 'en'),
dst AS (SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS row_id, text AS output FROM conversations)"""


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    english = table(spark, sf_dir, "documents").filter(F.col("lang") == "en").select("doc_id", F.col("text").alias("input"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("output"))
    left = prefix_sum(english, ["doc_id"], F.col("doc_id"), name="row_id").drop("doc_id")
    right = prefix_sum(turns, ["conv_id", "turn"], F.col("conv_id"), name="row_id").drop("conv_id", "turn")
    return left, right


@query("join_04_zip_outer", f"WITH {_SIDES} SELECT * FROM src FULL JOIN dst USING (row_id)")
def zip_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.zip_outer(*_sides(spark, sf_dir))


@query("join_05_zip_inner", f"WITH {_SIDES} SELECT * FROM src JOIN dst USING (row_id)")
def zip_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.zip_inner(*_sides(spark, sf_dir))


# ---------------------------------------------------------------- counts


@query("agg_05_version_pair_counts", f"WITH {ALIGNED} SELECT docv_input, docv_output, count(*) AS n FROM aligned GROUP BY ALL")
def version_pair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.version_pair_counts(aligned(spark, sf_dir))


@query(
    "agg_06_version_pair_totals",
    f"WITH {ALIGNED} SELECT docv_input, docv_output, GROUPING(docv_input, docv_output) AS level, count(*) AS n FROM aligned GROUP BY ROLLUP (docv_input, docv_output)",
)
def version_pair_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.version_pair_totals(aligned(spark, sf_dir))


@query("agg_07_target_version_counts", f"WITH {ALIGNED} SELECT docv_output, count(*) AS n FROM aligned GROUP BY ALL")
def target_version_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.target_version_counts(aligned(spark, sf_dir))


@query("agg_08_distinct_documents", f"WITH {ALIGNED} SELECT count(DISTINCT doc_id) AS n_documents FROM aligned")
def distinct_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.distinct_documents(aligned(spark, sf_dir))


@query(
    "agg_09_rows_by_version",
    "SELECT turn AS version, count(*) AS n FROM conversations WHERE turn BETWEEN 0 AND 6 GROUP BY ROLLUP (turn)",
)
def rows_by_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.rows_by_version(articles(spark, sf_dir), list(range(7)))


@query(
    "agg_10_rows_by_language",
    "SELECT count(*) FILTER (WHERE lang = 'en') AS n_en, count(*) FILTER (WHERE lang = 'es') AS n_es, "
    "count(*) AS n_all FROM documents",
)
def rows_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.rows_by_language(table(spark, sf_dir, "documents"), ["en", "es"], "lang")


# Every turn also has a row without an output, after those of its next turns.
_LAST = f"""{ALIGNED}, last_rows AS (
  SELECT doc_id, docv_input, input, output, row_id FROM aligned
  UNION ALL
  SELECT CAST(conv_id AS VARCHAR), 'V' || turn, text, NULL, conv_id * 17179869184 + turn * 4 + 4 FROM conversations)"""


@query(
    "agg_11_last_per_group",
    f"WITH {_LAST} SELECT doc_id, docv_input, input, max(row_id) AS row_id, "
    "arg_max(output, row_id) FILTER (WHERE output IS NOT NULL) AS output FROM last_rows "
    "WHERE input IS NOT NULL GROUP BY doc_id, docv_input, input",
)
def last_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = aligned(spark, sf_dir).select("doc_id", "docv_input", "input", "output", "row_id")
    unfinished = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("doc_id"),
        F.concat(F.lit("V"), "turn").alias("docv_input"),
        F.col("text").alias("input"),
        F.lit(None).cast("string").alias("output"),
        (F.shiftleft("conv_id", 34) + F.col("turn") * 4 + 4).alias("row_id"),
    )
    return split.last_per_group(rows.unionByName(unfinished), ["doc_id", "docv_input", "input"])


# ---------------------------------------------------------------- splits


_DOC_SPLIT = f"""{ALIGNED}, {_HEADS},
tagged AS (SELECT * FROM aligned JOIN doc_splits USING (doc_id)),
doc_split AS (
  SELECT row_id, {_ROW}, split FROM tagged WHERE split = 'train'
  UNION ALL
  SELECT max(row_id), doc_id, docv_input, arg_max(docv_output, row_id), input, arg_max(output, row_id), arg_max(split, row_id)
  FROM tagged WHERE split <> 'train' GROUP BY doc_id, docv_input, input)"""


@query("top_02_document_split", f"WITH {_DOC_SPLIT} SELECT * FROM doc_split")
def document_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.document_split(aligned(spark, sf_dir), N_TRAIN, N_VALID)


@query("agg_19_split_sizes", f"WITH {_DOC_SPLIT} SELECT split, count(*) AS n FROM doc_split GROUP BY split")
def split_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.split_sizes(split.document_split(aligned(spark, sf_dir), N_TRAIN, N_VALID))


@query(
    "agg_19_filter_sizes",
    "SELECT count(*) AS before, count(*) FILTER (WHERE length(text) <= 512) AS after FROM documents",
)
def filter_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.filter_sizes(table(spark, sf_dir, "documents"), F.length("text") <= 512)


@query("win_01_first_appearance_rank", f"WITH {ALIGNED}, {_HEADS} SELECT doc_id, first_row, rank FROM ranks")
def first_appearance_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.first_appearance_rank(aligned(spark, sf_dir))


N_TEST_ROWS, N_VALID_ROWS = 50, 30
_ROW_SPLIT = f"""row_ranks AS (
  SELECT *, row_number() OVER (ORDER BY {hash_sql('row_id', 7)}, row_id) - 1 AS rank FROM health),
row_split AS (SELECT row_id, input, output, CASE WHEN rank < {N_TEST_ROWS} THEN 'test'
  WHEN rank < {N_TEST_ROWS + N_VALID_ROWS} THEN 'valid' ELSE 'train' END AS split FROM row_ranks)"""


@query("top_01_random_split", f"WITH {CORPORA}, {_ROW_SPLIT} SELECT * FROM row_split")
def random_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.random_split(health(spark, sf_dir), N_TEST_ROWS, N_VALID_ROWS, seed=7)


@query(
    "top_04_length_buckets",
    f"WITH {CORPORA} SELECT row_id, length(input) AS len, "
    "(row_number() OVER (ORDER BY length(input), row_id) - 1) // 6 AS batch FROM wiki",
)
def length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = wiki(spark, sf_dir).select("row_id", F.length("input").alias("len"))
    return split.length_buckets(rows, "len", 6, store=True)


@query(
    "top_05_shuffle_rows",
    f"SELECT doc_id, source, row_number() OVER (ORDER BY {hash_sql('doc_id', 3)}, doc_id) - 1 AS position FROM documents",
)
def shuffle_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.shuffle_rows(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", 3)


# ---------------------------------------------------------------- sets


@query("set_01_distinct_rows", "SELECT min(doc_id) AS row_id, text, lang FROM documents GROUP BY text, lang")
def distinct_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), "text", "lang")
    return sets.distinct_rows(docs)


@query(
    "set_02_union_splits",
    "SELECT 'train' AS split, doc_id, text FROM documents UNION ALL SELECT 'valid', conv_id, text FROM conversations "
    "UNION ALL SELECT 'test', item_id, text FROM benchmark",
)
def union_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    def texts(name: str, key: str) -> DataFrame:
        return table(spark, sf_dir, name).select(F.col(key).alias("doc_id"), "text")

    return sets.union_splits(
        {"train": texts("documents", "doc_id"), "valid": texts("conversations", "conv_id"), "test": texts("benchmark", "item_id")}
    )


_UNION_TRAIN = f"{CORPORA}, {_REST}, {_ROW_SPLIT}"


@query(
    "set_03_union_train",
    f"WITH {_UNION_TRAIN} SELECT row_id, input, output FROM row_split WHERE split = 'train' UNION ALL SELECT * FROM rest",
)
def union_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    small = split.random_split(health(spark, sf_dir), N_TEST_ROWS, N_VALID_ROWS, seed=7)
    train = small.filter(F.col("split") == "train").drop("split")
    return sets.union_train(train, joins.exclude_overlap(wiki(spark, sf_dir), health(spark, sf_dir)))


@query("set_04_distinct_values", f"WITH {ALIGNED} SELECT DISTINCT doc_id FROM aligned")
def distinct_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.distinct_values(aligned(spark, sf_dir), "doc_id")


# ---------------------------------------------------------------- whole splits


@query("flow_04_split_aligned", f"WITH {_DOC_SPLIT} SELECT * FROM doc_split")
def aligned_to_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "prepared-aligned")
    write_prepared(aligned(spark, sf_dir).orderBy("row_id").drop("row_id"), path)
    numbered = read_prepared_aligned(spark, path)
    # Numbers in the file stand for the corpus keys: both order the rows alike.
    keys = prefix_sum(aligned(spark, sf_dir).select(F.col("row_id").alias("key")), ["key"], F.col("key"), name="row_id")
    placed = split_aligned(numbered, N_TRAIN, N_VALID).join(keys, "row_id")
    return placed.select(F.col("key").alias("row_id"), "doc_id", "docv_input", "docv_output", "input", "output", "split")


@query(
    "flow_05_split_wiki",
    f"WITH {_UNION_TRAIN} SELECT row_id, input, output, split FROM row_split UNION ALL SELECT *, 'train' FROM rest",
)
def wiki_to_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_wiki(health(spark, sf_dir), wiki(spark, sf_dir), N_TEST_ROWS, N_VALID_ROWS, seed=7)
