"""Word pieces, encodings, profiles and whole preparations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sinks, sources
from ..functions import tokens
from ..operators import filters, profile
from ..operators.epochs import best_over_rounds
from ..operators.predict import identity
from ..operators.split import document_split
from ..operators.vocab import target_vocab_counts
from ..plans.evaluate import evaluate, evaluate_rounds, predict_table
from ..plans.prepare import CleanRules, prepare_aligned, prepare_corpora, prepare_presplit, tokenize_pairs
from ..schemas import CLS, SEP
from ..session import shared_dir, written
from .files import presplit_paths
from .metrics import BLEU_OF_TOKENS, METEOR_OF_TOKENS, METEOR_SCORE, SARI_OF_TOKENS, _POOL, _STRICT, _smoothed_sql
from .registry import query
from .tables import (
    ALIGNED,
    CORPORA,
    N_TRAIN,
    N_VALID,
    TURNS,
    aligned,
    clean_sql,
    health,
    pieces_sql,
    table,
    turns,
    wiki,
    wordpiece,
)

_TOK = f"{TURNS}, {pieces_sql('turns')}"
_IDS = (
    _TOK
    + """,
ids AS (SELECT k, list(index ORDER BY p) AS ids FROM (
  SELECT k, unnest(body) AS token, generate_subscripts(body, 1) AS p FROM tok) JOIN vocab USING (token) GROUP BY k)"""
)


def _words_sql(pieces: str) -> str:
    return f"string_split(replace(array_to_string({pieces}, ' '), ' ##', ''), ' ')"


def _text(values: Column, sep: str = " ") -> Column:
    return F.array_join(values.cast("array<string>"), sep)


def cut_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``k, text, pieces`` with markers."""
    return turns(spark, sf_dir).withColumn("pieces", wordpiece(spark, sf_dir).tokenize(F.col("text")))


def coded_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``k, ids`` without markers."""
    wp = wordpiece(spark, sf_dir)
    return turns(spark, sf_dir).select("k", wp.encode(F.col("text")).alias("ids"))


def _marks(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    wp = wordpiece(spark, sf_dir)
    return wp.id_of(CLS), wp.id_of(SEP)


@query("fn_11_wordpiece", f"WITH RECURSIVE {_TOK} SELECT k, array_to_string(pieces, ' ') AS pieces, len(pieces) AS n FROM tok")
def wordpieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cut_turns(spark, sf_dir)
    return rows.select("k", _text(F.col("pieces")).alias("pieces"), F.size("pieces").cast("long").alias("n"))


@query(
    "fn_12_pieces_to_words",
    f"WITH RECURSIVE {_TOK} SELECT k, replace(array_to_string(pieces, ' '), ' ##', '') AS words FROM tok",
)
def pieces_to_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_turns(spark, sf_dir).select("k", _text(tokens.pieces_to_words(F.col("pieces"))).alias("words"))


@query(
    "fn_13_pieces_per_word",
    f"WITH RECURSIVE {_TOK} SELECT k, replace(replace(replace(array_to_string(pieces, ' '), ' ##', chr(1) || '##'), "
    "' ', '|'), chr(1), ' ') AS words FROM tok",
)
def pieces_per_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.transform(tokens.pieces_per_word(F.col("pieces")), lambda w: F.array_join(w, " "))
    return cut_turns(spark, sf_dir).select("k", _text(words, "|").alias("words"))


@query(
    "win_05_word_groups",
    f"WITH RECURSIVE {_TOK}, flat AS (SELECT k, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS p FROM tok), "
    "numbered AS (SELECT k, p, sum(CASE WHEN piece LIKE '##%' THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY p) AS w "
    "FROM flat) SELECT k, string_agg(w::BIGINT::VARCHAR, ' ' ORDER BY p) AS numbers FROM numbered GROUP BY k",
)
def word_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_turns(spark, sf_dir).select("k", _text(tokens.word_numbers(F.col("pieces"))).alias("numbers"))


_FULL = "len(ids) + 2"
_LONGEST = "(SELECT max(len(ids)) + 2 FROM ids)"


def _padded_sql(body: str, length: str) -> str:
    return f"([2] || {body} || [3] || list_transform(range({length} - len({body}) - 2), lambda i: 0))"


@query(
    "fn_14_encode_pad",
    f"WITH RECURSIVE {_IDS}, padded AS (SELECT k, {_padded_sql('ids', _LONGEST)} AS v FROM ids) "
    "SELECT k, array_to_string(v, ' ') AS ids, list_sum(list_transform(v, lambda i: (i <> 0)::INT))::BIGINT AS mask_sum, "
    "len(v) AS n FROM padded",
)
def encode_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = coded_turns(spark, sf_dir)
    # Pads to the longest sentence of the corpus.
    longest = rows.agg((F.max(F.size("ids")) + 2).alias("n")).scalar()
    padded = rows.select("k", tokens.encode_pad(F.col("ids"), longest, *_marks(spark, sf_dir)).alias("v"))
    mask = F.aggregate(tokens.attention_mask(F.col("v")), F.lit(0), lambda a, x: a + x)
    return padded.select(
        "k", _text(F.col("v")).alias("ids"), mask.cast("long").alias("mask_sum"), F.size("v").cast("long").alias("n")
    )


@query(
    "fn_15_encode_word_pad",
    f"WITH RECURSIVE {_IDS}, flat AS (SELECT k, unnest(pieces) AS token, generate_subscripts(pieces, 1) AS p FROM tok), "
    "groups AS (SELECT k, string_agg(CASE WHEN p = 1 THEN '' WHEN token LIKE '##%' THEN ' ' ELSE '|' END || index, '' ORDER BY p) "
    "AS g, count(*) FILTER (WHERE token NOT LIKE '##%') AS n FROM flat JOIN vocab USING (token) GROUP BY k) "
    "SELECT k, g || repeat('|', greatest(600 - n, 0)::BIGINT) AS ids FROM groups",
)
def encode_word_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    wp = wordpiece(spark, sf_dir)
    rows = cut_turns(spark, sf_dir).withColumn("ids", wp.to_ids(F.col("pieces")))
    grouped = rows.select("k", tokens.group_by_word(F.col("ids"), F.col("pieces")).alias("g"))
    padded = F.transform(tokens.encode_word_pad(F.col("g"), 600), lambda g: F.array_join(g.cast("array<string>"), " "))
    return grouped.select("k", F.array_join(padded, "|").alias("ids"))


@query(
    "fn_16_truncate_ids",
    f"WITH RECURSIVE {_IDS} SELECT k, array_to_string(list_slice(ids, 1, 64), ' ') AS ids FROM ids",
)
def truncate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coded_turns(spark, sf_dir).select("k", _text(tokens.truncate_ids(F.col("ids"), 64)).alias("ids"))


def _field_sql(max_len: int) -> str:
    return _padded_sql(f"list_slice([2] || ids || [3], 1, {max_len - 2})", str(max_len))


@query("fn_17_field_encode", f"WITH RECURSIVE {_IDS} SELECT k, array_to_string({_field_sql(128)}, ' ') AS ids FROM ids")
def field_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = tokens.field_encode(F.col("ids"), 128, *_marks(spark, sf_dir))
    return coded_turns(spark, sf_dir).select("k", _text(encoded).alias("ids"))


_BLOCKS = "((len(ids) + 129) // 128 * 128)"


def _whole(spark: SparkSession, sf_dir: str) -> Column:
    """All indexes of a row with markers, padded to a multiple of 128."""
    blocks = F.floor((F.size("ids") + 129) / 128).cast("int") * 128
    return tokens.encode_pad(F.col("ids"), blocks, *_marks(spark, sf_dir))


@query(
    "fn_18_padding_mask",
    f"WITH RECURSIVE {_IDS}, padded AS (SELECT k, {_padded_sql('ids', _BLOCKS)} AS v FROM ids) "
    "SELECT k, array_to_string(list_transform(v, lambda i: (i = 0)::VARCHAR), ' ') AS mask FROM padded",
)
def padding_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = coded_turns(spark, sf_dir).select("k", _whole(spark, sf_dir).alias("v"))
    return rows.select("k", _text(tokens.padding_mask(F.col("v"))).alias("mask"))


_DECODED = "trim(replace(replace(array_to_string({p}, ' '), ' ##', ''), '[PAD]', ''))"


@query(
    "fn_19_decode_ids",
    f"WITH RECURSIVE {_TOK} SELECT k, {_DECODED.format(p='pieces')} AS text FROM tok",
)
def decode_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = _whole(spark, sf_dir)
    rows = coded_turns(spark, sf_dir).select("k", wordpiece(spark, sf_dir).to_pieces(encoded).alias("p"))
    return rows.select("k", tokens.decode_pieces(F.col("p")).alias("text"))


# ---------------------------------------------------------------- filters and profiles over pieces


_PAIRS = f"""{CORPORA}, {_TOK},
cut AS (SELECT w.row_id, w.input, w.output, a.pieces AS ip, b.pieces AS op
        FROM wiki w JOIN tok a ON a.k = w.row_id JOIN tok b ON b.k = w.row_id + 1),
sentences AS (SELECT row_id, 'input' AS side, ip AS pieces FROM cut UNION ALL SELECT row_id, 'output', op FROM cut)"""


def cut_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize_pairs(wiki(spark, sf_dir), wordpiece(spark, sf_dir))


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = {"input": "input_pieces", "output": "output_pieces"}
    return profile.sides(cut_pairs(spark, sf_dir), columns, keep=("row_id",))


PIECES = ("input_pieces", "output_pieces")


@query(
    "fil_03_drop_overlong",
    f"WITH RECURSIVE {_PAIRS} SELECT row_id, input, output FROM cut WHERE len(ip) <= 512 AND len(op) <= 512",
)
def drop_overlong(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.drop_overlong(cut_pairs(spark, sf_dir), PIECES).select("row_id", "input", "output")


@query(
    "fil_04_drop_unknown",
    f"WITH RECURSIVE {_PAIRS} SELECT row_id, input, output FROM cut "
    "WHERE NOT list_contains(ip, '[UNK]') AND NOT list_contains(op, '[UNK]')",
)
def drop_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.drop_unknown(cut_pairs(spark, sf_dir), PIECES).select("row_id", "input", "output")


_COUNTS = """kept AS (SELECT * FROM sentences WHERE len(pieces) <= 512),
counts AS (SELECT side, token, count(*) AS count FROM (SELECT side, unnest(pieces) AS token FROM kept)
           WHERE token NOT IN ('[CLS]', '[SEP]') GROUP BY ALL)"""


def _profile_sql(by: str = "side") -> str:
    size = "len(list_filter(pieces, lambda p: NOT starts_with(p, '##')))"
    return (
        f"SELECT l.*, t.n_tokens, t.n_distinct FROM (SELECT {by}, max(len(pieces)) AS max_length, "
        f"least(min(len(pieces)), 100) AS min_length, max({size}) AS max_length_words, "
        f"least(min({size}), 100) AS min_length_words FROM kept GROUP BY {by}) l JOIN "
        f"(SELECT {by}, sum(count)::BIGINT AS n_tokens, count(*) AS n_distinct FROM counts GROUP BY {by}) t USING ({by})"
    )


@query("agg_01_corpus_profile", f"WITH RECURSIVE {_PAIRS}, {_COUNTS} {_profile_sql()}")
def corpus_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.corpus_profile(sentences(spark, sf_dir))


@query("agg_02_token_counts", f"WITH RECURSIVE {_PAIRS}, {_COUNTS} SELECT * FROM counts")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.token_counts(sentences(spark, sf_dir))


@query(
    "agg_03_prefix_counts",
    f"WITH RECURSIVE {_PAIRS}, {_COUNTS} SELECT side, prefix, coalesce(sum(count) FILTER (WHERE starts_with(token, prefix)), 0)"
    "::BIGINT AS found FROM counts, (VALUES ('[UNK]'), ('##'), ('#')) p(prefix) GROUP BY side, prefix",
)
def prefix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.prefix_counts(profile.token_counts(sentences(spark, sf_dir)))


_UNKNOWN = "FROM sentences WHERE len(pieces) <= 512 AND list_contains(pieces, '[UNK]')"


@query(
    "agg_04_unknown_sentences",
    f"WITH RECURSIVE {_PAIRS} SELECT row_id, side, array_to_string(pieces, ' ') AS pieces {_UNKNOWN}",
)
def unknown_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = profile.unknown_sentences(sentences(spark, sf_dir))
    return found.select("row_id", "side", _text(F.col("pieces")).alias("pieces"))


_OUTPUT_WORDS = f"""{ALIGNED}, {_TOK},
words AS (SELECT unnest({_words_sql('b.pieces')}) AS token
          FROM conversations a JOIN conversations t ON a.conv_id = t.conv_id AND t.turn - a.turn BETWEEN 1 AND 4
          JOIN tok b ON b.k = t.conv_id * 17179869184 + t.turn)"""


@query(
    "agg_20_target_vocab_counts",
    f"WITH RECURSIVE {_OUTPUT_WORDS} SELECT token, count(*) AS count FROM words GROUP BY token",
)
def target_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = document_split(aligned(spark, sf_dir), N_TRAIN, N_VALID, keep_last=False)
    cut = rows.select("split", wordpiece(spark, sf_dir).tokenize(F.col("output")).alias("p"))
    words = cut.select("split", tokens.pieces_to_words(F.col("p")).alias("words"))
    parts = [words.filter(F.col("split") == s) for s in ("train", "valid", "test")]
    return target_vocab_counts(parts, "words")


# ---------------------------------------------------------------- whole preparations


def _clean_cut_sql(pairs: str) -> str:
    """``pairs(row_id, corpus, conv_id, t1, t2, ...)``: clean inputs and raw outputs in pieces."""
    return f"""{TURNS}, clean_turns AS (SELECT k, {clean_sql('text')} AS text FROM turns),
{pieces_sql('turns', 'tok_raw')}, {pieces_sql('clean_turns', 'tok_clean', vocab=False)},
pairs AS ({pairs}),
cut AS (SELECT p.*, c.text AS input, r.text AS output, a.pieces AS ip, b.pieces AS op FROM pairs p
  JOIN clean_turns c ON c.k = p.conv_id * 17179869184 + p.t1 JOIN turns r ON r.k = p.conv_id * 17179869184 + p.t2
  JOIN tok_clean a ON a.k = p.conv_id * 17179869184 + p.t1 JOIN tok_raw b ON b.k = p.conv_id * 17179869184 + p.t2),
passed AS (SELECT * FROM cut WHERE len(ip) <= 512 AND len(op) <= 512
  AND NOT list_contains(ip, '[UNK]') AND NOT list_contains(op, '[UNK]')),
sentences AS (SELECT row_id, corpus, 'input' AS side, ip AS pieces FROM cut
  UNION ALL SELECT row_id, corpus, 'output', op FROM cut)"""


_ALIGNED_PAIRS = """SELECT a.conv_id * 17179869184 + a.turn * 4 + (b.turn - a.turn) - 1 AS row_id, '' AS corpus, a.conv_id,
  a.turn AS t1, b.turn AS t2 FROM conversations a JOIN conversations b
  ON a.conv_id = b.conv_id AND b.turn - a.turn BETWEEN 1 AND 4"""
_FAR_PAIRS = _ALIGNED_PAIRS + " WHERE NOT (b.turn = a.turn + 1 AND a.turn IN (0, 1, 2))"
_CORPUS_PAIRS = """SELECT a.conv_id * 17179869184 + a.turn AS row_id, corpus, a.conv_id, a.turn AS t1, a.turn + 1 AS t2
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
  JOIN (VALUES ('health'), ('wiki')) c(corpus) ON corpus = 'wiki' OR a.role = 'user'"""


def _prepared_aligned(spark: SparkSession, sf_dir: str):
    return prepare_aligned(aligned(spark, sf_dir), wordpiece(spark, sf_dir), CleanRules(), model="own", store=False)


@query(
    "flow_01_prepare_aligned",
    f"WITH RECURSIVE {_clean_cut_sql(_FAR_PAIRS)} SELECT row_id, conv_id::VARCHAR AS doc_id, 'V' || t1 AS docv_input, "
    "'V' || t2 AS docv_output, input, output FROM passed",
)
def prepared_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prepared_aligned(spark, sf_dir).rows


@query("flow_01_prepare_aligned_profile", f"WITH RECURSIVE {_clean_cut_sql(_FAR_PAIRS)}, {_COUNTS} {_profile_sql()}")
def prepared_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prepared_aligned(spark, sf_dir).profile


def _stats_sql(rows: str) -> str:
    picks = []
    size = "len(list_filter(pieces, lambda p: NOT starts_with(p, '##')))"
    for side in ("input", "output"):
        where = f"FILTER (WHERE side = '{side}')"
        picks += [
            f"max(len(pieces)) {where} AS max_length_tokens_{side}",
            f"max({size}) {where} AS max_length_words_{side}",
            f"least(min(len(pieces)) {where}, 100) AS min_length_tokens_{side}",
            f"least(min({size}) {where}, 100) AS min_length_words_{side}",
        ]
    return f"SELECT {', '.join(picks)}, 'own' AS bert_model, (SELECT count(*) FROM {rows}) AS length_dataset, " \
           "true AS dataset_normalized FROM kept"


@query("snk_03_write_corpus_stats", f"WITH RECURSIVE {_clean_cut_sql(_FAR_PAIRS)}, {_COUNTS} {_stats_sql('passed')}")
def write_corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "stats")
    stats = prepare_aligned(aligned(spark, sf_dir), wordpiece(spark, sf_dir), CleanRules(), model="own").stats
    sinks.write_corpus_stats(stats, path)
    return spark.read.schema(stats.schema).json(path)


@query(
    "snk_04_write_unknowns",
    f"WITH RECURSIVE {_PAIRS} SELECT side, row_id AS index, array_to_string(pieces, ' ') AS text {_UNKNOWN}",
)
def write_unknowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "unknown")
    found = written(profile.unknown_sentences(sentences(spark, sf_dir)), "found")
    sides = []
    for side in ("input", "output"):
        sinks.write_unknowns(found.filter(F.col("side") == side), f"{path}/{side}")
        back = spark.read.schema("index BIGINT, text STRING").csv(f"{path}/{side}", sep="\t", header=True, quote='"', escape='"')
        text = F.array_join(F.from_json("text", "array<string>"), " ").alias("text")
        sides.append(back.select(F.lit(side).alias("side"), "index", text))
    return sides[0].unionByName(sides[1])


@query("flow_02_prepare_presplit", f"WITH RECURSIVE {_clean_cut_sql(_ALIGNED_PAIRS)}, {_COUNTS} {_profile_sql()}")
def prepared_presplit(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = sources.read_parallel_outer(spark, presplit_paths(spark, sf_dir))
    prepared, _ = prepare_presplit(merged, wordpiece(spark, sf_dir), CleanRules(), store=False)
    return prepared.profile


@query(
    "flow_03_prepare_wiki",
    f"WITH RECURSIVE {_clean_cut_sql(_CORPUS_PAIRS)} SELECT row_id, corpus, input, output FROM passed",
)
def prepared_corpora(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpora = {"health": health(spark, sf_dir), "wiki": wiki(spark, sf_dir)}
    return prepare_corpora(corpora, wordpiece(spark, sf_dir), CleanRules(), store=False).rows


@query(
    "flow_03_prepare_wiki_profile",
    f"WITH RECURSIVE {_clean_cut_sql(_CORPUS_PAIRS)}, kept AS (SELECT * FROM sentences WHERE len(pieces) <= 512), "
    "counts AS (SELECT corpus, side, token, count(*) AS count FROM (SELECT corpus, side, unnest(pieces) AS token FROM kept) "
    f"WHERE token NOT IN ('[CLS]', '[SEP]') GROUP BY ALL) {_profile_sql('corpus, side')}",
)
def prepared_corpora_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpora = {"health": health(spark, sf_dir), "wiki": wiki(spark, sf_dir)}
    return prepare_corpora(corpora, wordpiece(spark, sf_dir), CleanRules(), store=False).profile


# ---------------------------------------------------------------- evaluation


_FIELD = "['[CLS]'] || list_slice(['[CLS]'] || {t}.body || ['[SEP]'], 1, 510) || ['[SEP]']"
_EVAL_TOKENS = f"""{CORPORA}, {_TOK},
tokens AS (SELECT row_number() OVER (ORDER BY w.row_id) - 1 AS conv_id, 0 AS turn,
    {_words_sql(_FIELD.format(t='a'))} AS s, {_words_sql(_FIELD.format(t='a'))} AS c, {_words_sql(_FIELD.format(t='b'))} AS r
  FROM wiki w JOIN tok a ON a.k = w.row_id JOIN tok b ON b.k = w.row_id + 1)"""


def _test_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "test-lines")
    sinks.write_parallel(wiki(spark, sf_dir), path)
    return sources.read_parallel_lines(spark, f"{path}.src", f"{path}.dst")


def _evaluation(spark: SparkSession, sf_dir: str):
    return evaluate(_test_lines(spark, sf_dir), wordpiece(spark, sf_dir), identity)


@query(
    "flow_06_evaluate",
    f"WITH RECURSIVE {_EVAL_TOKENS}, {SARI_OF_TOKENS}, {BLEU_OF_TOKENS}, {_POOL} "
    "SELECT (SELECT round(avg((keep + delete + add) / 3), 6) FROM sari) AS sari, "
    f"(SELECT round({_smoothed_sql('t{n}')}, 6) FROM pool) AS bleu_smoothed, "
    f"(SELECT round({_STRICT}, 6) FROM pool) AS bleu_strict",
)
def evaluate_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = _evaluation(spark, sf_dir).corpus
    return scores.select(*[F.round(c, 6).alias(c) for c in ("sari", "bleu_smoothed", "bleu_strict")])


@query(
    "flow_06_evaluate_sentences",
    f"WITH RECURSIVE {_EVAL_TOKENS}, {SARI_OF_TOKENS}, {BLEU_OF_TOKENS} "
    "SELECT conv_id AS row_id, round((keep + delete + add) / 3, 6) AS sari, "
    f"round({_smoothed_sql('greatest(t{n}, 1)')}, 6) AS bleu FROM sari JOIN bleu_parts USING (conv_id, turn)",
)
def evaluate_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = _evaluation(spark, sf_dir).sentences
    return scores.select("row_id", F.round("sari", 6).alias("sari"), F.round("bleu", 6).alias("bleu"))


def without_ends():
    """The input without its first and last word."""
    return lambda texts: [[" ".join(t.split(" ")[1:-1])] for t in texts]


_ROUND_TOKENS = f"""{_EVAL_TOKENS.replace("tokens AS (", "encoded AS (")},
tokens AS (SELECT conv_id, 0 AS turn, s, c, r FROM encoded
  UNION ALL SELECT conv_id, 1, s, list_slice(c, 2, len(c) - 1), r FROM encoded)"""
_ROUND_POOL = _POOL.replace("SELECT ", "SELECT turn, ", 1).replace("FROM bleu_parts", "FROM bleu_parts GROUP BY turn")


@query(
    "flow_06_evaluate_rounds",
    f"WITH RECURSIVE {_ROUND_TOKENS}, {SARI_OF_TOKENS}, {BLEU_OF_TOKENS}, {_ROUND_POOL}, {METEOR_OF_TOKENS}, "
    "rounds AS (SELECT turn AS round, sari, bleu, strict, meteor FROM "
    "(SELECT turn, avg((keep + delete + add) / 3) AS sari FROM sari GROUP BY turn) "
    f"JOIN (SELECT turn, {_smoothed_sql('t{n}')} AS bleu, {_STRICT} AS strict FROM pool) USING (turn) "
    f"JOIN (SELECT turn, avg({METEOR_SCORE}) AS meteor FROM q GROUP BY turn) USING (turn)) "
    "SELECT round, round(sari, 6) AS sari, round(bleu, 6) AS bleu_smoothed, round(strict, 6) AS bleu_strict, "
    "round(meteor, 6) AS meteor, bleu = max(bleu) OVER () AS has_best_bleu, sari = max(sari) OVER () AS has_best_sari FROM rounds",
)
def rounds_of_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _test_lines(spark, sf_dir)
    folder = shared_dir(spark, "rounds")
    pieces = wordpiece(spark, sf_dir)
    evaluate_rounds(pairs, pieces, [identity], folder, stems=False)
    # The second run finds the first round committed.
    rounds = evaluate_rounds(pairs, pieces, [identity, without_ends], folder, stems=False)
    scores = written(rounds.corpus, "corpus")
    best = best_over_rounds(scores.withColumnRenamed("bleu_smoothed", "bleu")).first()
    return scores.select(
        "round",
        *[F.round(c, 6).alias(c) for c in ("sari", "bleu_smoothed", "bleu_strict", "meteor")],
        (F.col("bleu_smoothed") == best["best_bleu"]).alias("has_best_bleu"),
        (F.col("sari") == best["best_sari"]).alias("has_best_sari"),
    )


@query(
    "flow_07_predict_table",
    "SELECT row_number() OVER (ORDER BY item_id, p) - 1 AS row_id, trim(line) AS text, 1 AS candidate, trim(line) AS hypothesis "
    "FROM (SELECT item_id, unnest(string_split(text, chr(10))) AS line, "
    "generate_subscripts(string_split(text, chr(10)), 1) AS p FROM benchmark)",
)
def predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "origin-lines")
    table(spark, sf_dir, "benchmark").orderBy("item_id").select("text").write.text(path)
    return predict_table(sources.read_lines(spark, path), identity)


