"""Language-model data over the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tokens import split_ws
from ..operators import lm
from ..operators.sets import union_splits
from ..operators.vocab import vocab_by_frequency
from .registry import query
from .tables import LINES, STREAM, WORDS, doc_lines, doc_stream, doc_words, hash_sql, table
from .text import _BY_COUNT

BSZ, BPTT = 8, 35


def _joined(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*keep, F.array_join("data", " ").alias("data"), F.array_join("target", " ").alias("target"))


_LANES = f"""{STREAM},
n AS (SELECT count(*) // {BSZ} AS n_step FROM stream),
laned AS (SELECT token, pos // n_step AS lane, pos % n_step AS step, n_step FROM stream, n WHERE pos < n_step * {BSZ}),
steps AS (SELECT *, lead(token) OVER (PARTITION BY lane ORDER BY step) AS target FROM laned)"""


@query(
    "lm_01_pack_contiguous",
    f"WITH {_LANES} SELECT lane, step // {BPTT} AS chunk, count(*) AS seq_len, string_agg(token, ' ' ORDER BY step) AS data, "
    "string_agg(target, ' ' ORDER BY step) AS target FROM steps WHERE target IS NOT NULL GROUP BY 1, 2",
)
def pack_contiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = lm.pack_contiguous(doc_stream(spark, sf_dir), "tokens", BSZ, BPTT)
    return _joined(packed, "lane", "chunk", "seq_len")


@query("win_04_next_token_target", f"WITH {_LANES} SELECT lane, step, token, target FROM steps WHERE target IS NOT NULL")
def next_token_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.next_token_target(doc_stream(spark, sf_dir), "tokens", BSZ)


EXT = 50


@query(
    "lm_05_context_overlap",
    f"WITH {_LANES}, reach AS (SELECT lane, step, token, unnest(range(step // {BPTT}, (step + {EXT}) // {BPTT} + 1)) AS chunk, "
    "n_step FROM laned WHERE step < n_step - 1), "
    f"main AS (SELECT lane, step // {BPTT} AS chunk, count(*) AS seq_len, string_agg(target, ' ' ORDER BY step) AS target "
    "FROM steps WHERE target IS NOT NULL GROUP BY 1, 2) "
    "SELECT lane, chunk, any_value(seq_len) AS seq_len, string_agg(token, ' ' ORDER BY step) AS data, "
    "any_value(target) AS target FROM reach JOIN main USING (lane, chunk) GROUP BY lane, chunk",
)
def context_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = lm.pack_contiguous(doc_stream(spark, sf_dir), "tokens", BSZ, BPTT, EXT)
    return _joined(packed, "lane", "chunk", "seq_len")


def _uniform_sql(column: str, seed: int) -> str:
    return f"(({hash_sql(column, seed)})::DOUBLE + 0.5) / 1152921504606846976.0"


_BORDERS = f"""
gen AS (SELECT unnest(range(0, n_step // 5 + 1)) AS chunk, n_step FROM n),
lens AS (SELECT chunk, n_step, least(50, greatest(5, trunc(
  CASE WHEN {_uniform_sql('chunk', 11)} < 0.95 THEN {float(BPTT)} ELSE {BPTT / 2} END
  + 5.0 * sqrt(-2 * ln({_uniform_sql('chunk', 12)})) * cos(2 * pi() * ({_uniform_sql('chunk', 13)})))::INT)) AS len FROM gen),
starts AS (SELECT chunk, n_step, len, coalesce(sum(len) OVER (ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
  ::BIGINT AS start FROM lens),
borders AS (SELECT chunk, start, least(len, n_step - 1 - start) AS seq_len FROM starts WHERE chunk = 0 OR start < n_step - 2)"""


@query(
    "lm_02_pack_variable",
    f"WITH {_LANES}, {_BORDERS} SELECT lane, chunk, start, seq_len, string_agg(token, ' ' ORDER BY step) AS data, "
    "string_agg(target, ' ' ORDER BY step) AS target FROM steps JOIN borders ON step >= start AND step < start + seq_len "
    "GROUP BY ALL",
)
def pack_variable(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = lm.pack_variable(doc_stream(spark, sf_dir), "tokens", BSZ, BPTT, seed=11)
    return _joined(packed, "lane", "chunk", "start", "seq_len")


def _sentences_sql(bsz: int, bptt: int, seed: int, shard: str) -> str:
    key = hash_sql("row_id", seed)
    return f"""WITH {LINES},
sents AS (SELECT {shard} AS shard, row_id, tokens, len(tokens) - 1 AS w, {key} AS key FROM doc_lines WHERE len(tokens) > 1),
placed AS (SELECT *, coalesce(sum(w) OVER (PARTITION BY shard ORDER BY key, row_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM sents),
batches AS (SELECT shard, sum(w)::BIGINT // {bsz} AS lane_len FROM sents GROUP BY shard),
stream AS (SELECT shard, off + p - 1 AS g, tokens[p] AS d, tokens[p + 1] AS t
  FROM (SELECT *, unnest(range(1, w + 1)) AS p FROM placed)),
pairs AS (SELECT shard, g // lane_len AS lane, g % lane_len AS q, lane_len // {bptt} AS n_batch, d, t
  FROM stream JOIN batches USING (shard) WHERE lane_len > 0 AND g < lane_len * {bsz}),
packed AS (SELECT shard, lane, q // {bptt} AS chunk, string_agg(d, ' ' ORDER BY q) AS data, string_agg(t, ' ' ORDER BY q) AS target
  FROM pairs WHERE q // {bptt} < n_batch GROUP BY ALL)"""


@query("lm_03_pack_sentences", _sentences_sql(BSZ, BPTT, 5, "''") + " SELECT lane, chunk, data, target FROM packed")
def pack_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = lm.pack_sentences(doc_lines(spark, sf_dir), "tokens", BSZ, BPTT, seed=5)
    return _joined(packed, F.col("lane").cast("long").alias("lane"), "chunk")


@query(
    "lm_04_pack_shards",
    _sentences_sql(4, 20, 5, "shard")
    + f" SELECT shard, lane, chunk, data, target, {hash_sql('shard', 5)} AS shard_order FROM packed",
)
def pack_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = lm.pack_shards(doc_lines(spark, sf_dir), "tokens", 4, 20, "shard", seed=5)
    return _joined(packed, "shard", F.col("lane").cast("long").alias("lane"), "chunk", "shard_order")


_SPLIT_TEXTS = r"""texts AS (
  SELECT 'train' AS split, doc_id AS row_id, text FROM documents
  UNION ALL SELECT 'valid', conv_id * 17179869184 + turn, text FROM conversations
  UNION ALL SELECT 'test', item_id, text FROM benchmark),
marked AS (SELECT split, row_id, list_append(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''), '<eos>') AS tokens
  FROM texts),
flat AS (SELECT split, row_id, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS p FROM marked),
voc AS (SELECT token, row_number() OVER (ORDER BY count(*) DESC, token) + 1 AS index FROM flat
  WHERE split = 'train' AND token NOT IN ('<eos>', '<unk>') GROUP BY token
  UNION ALL SELECT '<eos>', 0 UNION ALL SELECT '<unk>', 1)"""


@query(
    "lm_06_corpus_vocab_encode",
    f"WITH {_SPLIT_TEXTS} SELECT split, row_id, string_agg(coalesce(index, 1)::VARCHAR, ' ' ORDER BY p) AS ids "
    "FROM flat LEFT JOIN voc USING (token) GROUP BY split, row_id",
)
def corpus_vocab_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    def texts(name: str, key) -> DataFrame:
        return table(spark, sf_dir, name).select(key.alias("row_id"), split_ws(F.col("text")).alias("tokens"))

    merged = union_splits(
        {
            "train": texts("documents", F.col("doc_id")),
            "valid": texts("conversations", F.shiftleft("conv_id", 34) + F.col("turn")),
            "test": texts("benchmark", F.col("item_id")),
        }
    )
    _, coded = lm.corpus_vocab_encode(merged, "tokens", ["train"])
    return coded.select("split", "row_id", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))


_WEIGHTS = f"""{WORDS}, {_BY_COUNT},
p AS (SELECT token, index, (ln(index + 2.0) - ln(index + 1.0)) / ln((SELECT count(*) FROM freq) + 1.0) AS p FROM freq)"""
N_SAMPLE = 100


def _weights(spark: SparkSession, sf_dir: str, exact: bool) -> DataFrame:
    vocab = vocab_by_frequency(doc_words(spark, sf_dir), "tokens")
    size = vocab.agg(F.count(F.lit(1)).alias("n")).scalar()
    weighted = lm.sampling_weights(vocab, N_SAMPLE, size, exact=exact)
    # Weights are small: shown per million.
    return weighted.select("token", "index", F.round(F.col("p") * 1e6, 3).alias("p_million"), F.round("log_q", 4).alias("log_q"))


@query(
    "lm_07_sampling_weights",
    f"WITH {_WEIGHTS} SELECT token, index, round(p * 1e6, 3) AS p_million, "
    f"round(ln(1 - exp(-{2 * N_SAMPLE} * ln(1 + p))), 4) AS log_q FROM p",
)
def sampling_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weights(spark, sf_dir, False)


@query(
    "lm_07_sampling_weights_exact",
    f"WITH {_WEIGHTS} SELECT token, index, round(p * 1e6, 3) AS p_million, "
    f"round(ln(1 - exp({2 * N_SAMPLE} * ln(1 - p))), 4) AS log_q FROM p",
)
def sampling_weights_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weights(spark, sf_dir, True)


@query(
    "lm_08_negative_samples",
    f"WITH {WORDS}, {_BY_COUNT}, size AS (SELECT count(*) AS r FROM freq) SELECT DISTINCT "
    f"least(floor(exp({_uniform_sql('doc_id', 9)} * ln(r + 1.0)))::BIGINT - 1, r - 1) AS class FROM documents, size",
)
def negative_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocab = vocab_by_frequency(doc_words(spark, sf_dir), "tokens")
    size = vocab.agg(F.count(F.lit(1)).alias("n")).scalar()
    return lm.negative_samples(table(spark, sf_dir, "documents"), size, "doc_id", seed=9)
