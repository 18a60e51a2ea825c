"""Sentence and corpus scores, training-log analytics, candidate ranking and prediction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tokens import exploded, pad_right, split_ws
from ..operators import epochs
from ..operators.joins import tokens_to_ids
from ..operators.meteor import meteor
from ..operators.ngram_metrics import corpus_bleu, corpus_sari, sentence_scores
from ..operators.split import rank_candidates
from ..operators.predict import batch_predict, identity, lexical_substitution, scored_predict, without_a_word
from ..operators.vocab import vocab_by_frequency
from .registry import query
from .tables import REFERENCED, TRIPLES, referenced, table, token_triples, triples

KEY = ["conv_id", "turn"]


def _grams_sql(name: str, lower: bool) -> str:
    sides = []
    for side in "scr":
        tokens = f"list_transform({side}, lambda x: lower(x))" if lower else side
        for n in range(1, 5):
            sides.append(
                f"SELECT conv_id, turn, '{side}' AS side, {n} AS n, "
                f"unnest(list_transform(range(1, greatest(len({side}) - {n - 2}, 1)::BIGINT), "
                f"lambda i: array_to_string(list_slice({tokens}, i, i + {n - 1}), ' '))) AS gram FROM tokens"
            )
    return f"{name}_rows AS ({' UNION ALL '.join(sides)}),\n" + (
        f"{name} AS (SELECT conv_id, turn, n, gram, count(*) FILTER (WHERE side = 's') AS s, "
        "count(*) FILTER (WHERE side = 'c') AS c, count(*) FILTER (WHERE side = 'r') AS r "
        f"FROM {name}_rows GROUP BY ALL)"
    )


_F1 = "CASE WHEN {p} > 0 OR {r} > 0 THEN 2 * {p} * {r} / ({p} + {r}) ELSE 0 END"

SARI = (
    TRIPLES
    + ",\n"
    + _grams_sql("lgrams", True)
    + r""",
orders AS (
  SELECT conv_id, turn, n,
    coalesce(sum(least(s, c, r) / least(s, c)::DOUBLE) FILTER (WHERE least(s, c) > 0), 0)
      / greatest(count(*) FILTER (WHERE least(s, c) > 0), 1) AS kp,
    coalesce(sum(least(s, c, r) / least(s, r)::DOUBLE) FILTER (WHERE least(s, r) > 0), 0)
      / greatest(count(*) FILTER (WHERE least(s, r) > 0), 1) AS kr,
    coalesce(sum(greatest(greatest(s - c, 0) - r, 0) / (s - c)::DOUBLE) FILTER (WHERE s > c), 0) AS ds,
    count(*) FILTER (WHERE s > c) AS dn, count(*) FILTER (WHERE s > r) AS dan,
    count(*) FILTER (WHERE c > 0 AND s = 0 AND r > 0) AS ag,
    count(*) FILTER (WHERE c > 0 AND s = 0) AS an, count(*) FILTER (WHERE r > 0 AND s = 0) AS aan
  FROM lgrams GROUP BY ALL),
parts AS (
  SELECT *, CASE WHEN dn > 0 THEN ds / dn ELSE 0 END AS dp, CASE WHEN dan > 0 THEN ds / dan ELSE 0 END AS dr,
    CASE WHEN an > 0 THEN ag / an::DOUBLE ELSE 0 END AS ap, CASE WHEN aan > 0 THEN ag / aan::DOUBLE ELSE 0 END AS ar
  FROM orders),
sari AS (
  SELECT conv_id, turn, """
    + f"sum({_F1.format(p='kp', r='kr')}) / 4 AS keep, sum({_F1.format(p='dp', r='dr')}) / 4 AS delete, "
    + f"sum({_F1.format(p='ap', r='ar')}) / 4 AS add"
    + r"""
  FROM parts GROUP BY ALL)"""
)

BLEU = (
    TRIPLES
    + ",\n"
    + _grams_sql("grams", False)
    + r""",
bleu_orders AS (SELECT conv_id, turn, n, sum(least(c, r)) AS clip, sum(c) AS total FROM grams GROUP BY ALL),
bleu_parts AS (
  SELECT t.conv_id, t.turn, len(t.c) AS hyp, len(t.r) AS ref, """
    + ", ".join(
        f"coalesce(max(clip) FILTER (WHERE n = {n}), 0) AS c{n}, coalesce(max(total) FILTER (WHERE n = {n}), 0) AS t{n}"
        for n in range(1, 5)
    )
    + r"""
  FROM tokens t LEFT JOIN bleu_orders USING (conv_id, turn) GROUP BY ALL)"""
)


def _smoothed_sql(total: str) -> str:
    logs = []
    for n in range(1, 5):
        zeros = " + ".join(f"(c{i} = 0)::INT" for i in range(1, n + 1))
        t = total.format(n=n)
        logs.append(f"ln(CASE WHEN c{n} = 0 THEN 1 / (pow(2.0, {zeros}) * {t}) ELSE c{n} / ({t})::DOUBLE END) / 4")
    brevity = "CASE WHEN hyp > ref THEN 1.0 WHEN hyp = 0 THEN 0.0 ELSE exp(1 - ref / hyp::DOUBLE) END"
    return f"CASE WHEN c1 = 0 THEN 0.0 ELSE {brevity} * exp({' + '.join(logs)}) END"


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, F.round(c, 6))
    return df


@query(
    "met_01_sentence_sari",
    f"WITH {SARI} SELECT conv_id, turn, round(keep, 6) AS keep, round(delete, 6) AS delete, "
    "round(add, 6) AS add, round((keep + delete + add) / 3, 6) AS sari FROM sari",
)
def sentence_sari(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = sentence_scores(token_triples(spark, sf_dir), KEY, bleu=False, partitioned=True, unique=True)
    return _rounded(scores, "keep", "delete", "add", "sari")


@query(
    "met_02_sentence_bleu",
    f"WITH {BLEU} SELECT conv_id, turn, round({_smoothed_sql('greatest(t{n}, 1)')}, 6) AS bleu FROM bleu_parts",
)
def sentence_bleu(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = sentence_scores(token_triples(spark, sf_dir), KEY, sari=False, partitioned=True, unique=True)
    return _rounded(scores, "bleu").select("conv_id", "turn", "bleu")


def _reference_grams_sql(name: str, lower: bool) -> str:
    w = "list_transform(w, lambda x: lower(x))" if lower else "w"
    orders = " UNION ALL ".join(
        f"SELECT conv_id, turn, side, k, {n} AS n, unnest(list_transform(range(1, greatest(len(w) - {n - 2}, 1)::BIGINT), "
        f"lambda i: array_to_string(list_slice({w}, i, i + {n - 1}), ' '))) AS gram FROM sides"
        for n in range(1, 5)
    )
    return f"""{name}_each AS (SELECT conv_id, turn, side, k, n, gram, count(*) AS x FROM ({orders}) GROUP BY ALL),
{name} AS (SELECT conv_id, turn, n, gram, coalesce(sum(x) FILTER (side = 's'), 0) AS s, coalesce(sum(x) FILTER (side = 'c'), 0) AS c,
  coalesce(sum(x) FILTER (side = 'r'), 0) AS r, coalesce(max(x) FILTER (side = 'r'), 0) AS best FROM {name}_each GROUP BY ALL)"""


_REFERENCE_SQL = f"""WITH {REFERENCED},
sides AS (SELECT conv_id, turn, 's' AS side, 0 AS k, s AS w FROM pairs UNION ALL SELECT conv_id, turn, 'c', 0, c FROM pairs
  UNION ALL SELECT conv_id, turn, 'r', k, r FROM refs JOIN pairs USING (conv_id, turn)),
{_reference_grams_sql("low", True)},
{_reference_grams_sql("plain", False)},
shares AS (
  SELECT conv_id, turn, n, least(s, c) * m AS kept, least(least(s, c) * m, r) AS kept_good, least(s * m, r) AS kept_all,
    greatest(s - c, 0) * m AS gone, greatest(greatest(s - c, 0) * m - r, 0) AS gone_good, s * m > r AS gone_all,
    c > 0 AND s = 0 AS new, r > 0 AND s = 0 AS new_all, c > 0 AND s = 0 AND r > 0 AS new_good
  FROM low JOIN (SELECT conv_id, turn, m FROM pairs) USING (conv_id, turn)),
sums AS (
  SELECT conv_id, turn, n, sum(CASE WHEN kept > 0 THEN kept_good / kept::DOUBLE ELSE 0 END) AS kp,
    sum(CASE WHEN kept_all > 0 THEN kept_good / kept_all::DOUBLE ELSE 0 END) AS kr, count(*) FILTER (kept > 0) AS nk,
    count(*) FILTER (kept_all > 0) AS nka, sum(CASE WHEN gone > 0 THEN gone_good / gone::DOUBLE ELSE 0 END) AS ds,
    count(*) FILTER (gone > 0) AS nd, count(*) FILTER (gone_all) AS nda,
    count(*) FILTER (new_good) AS g, count(*) FILTER (new) AS nn, count(*) FILTER (new_all) AS nna
  FROM shares GROUP BY ALL),
ratios AS (
  SELECT conv_id, turn, CASE WHEN nk > 0 THEN kp / nk ELSE 0 END AS a, CASE WHEN nka > 0 THEN kr / nka ELSE 0 END AS b,
    CASE WHEN nd > 0 THEN ds / nd ELSE 0 END AS d, CASE WHEN nda > 0 THEN ds / nda ELSE 0 END AS e,
    CASE WHEN nn > 0 THEN g / nn::DOUBLE ELSE 0 END AS p, CASE WHEN nna > 0 THEN g / nna::DOUBLE ELSE 0 END AS q FROM sums),
sari AS (
  SELECT conv_id, turn, sum({_F1.format(p='a', r='b')}) / 4 AS keep, sum({_F1.format(p='d', r='e')}) / 4 AS delete,
    sum({_F1.format(p='p', r='q')}) / 4 AS add FROM ratios GROUP BY ALL),
orders AS (SELECT conv_id, turn, n, sum(least(c, best)) AS clip, sum(c) AS total FROM plain GROUP BY ALL),
bleu_parts AS (
  SELECT t.conv_id, t.turn, any_value(t.m) AS m, any_value(len(t.c)) AS hyp, coalesce(any_value((
      SELECT arg_min(len(r), abs(len(r) - len(t.c)) * 1000000 + len(r)) FROM refs f WHERE f.conv_id = t.conv_id AND f.turn = t.turn)), 0) AS ref,
    """ + ", ".join(
    f"coalesce(max(clip) FILTER (WHERE n = {n}), 0) AS c{n}, coalesce(max(total) FILTER (WHERE n = {n}), 0) AS t{n}"
    for n in range(1, 5)
) + f"""
  FROM pairs t LEFT JOIN orders USING (conv_id, turn) GROUP BY t.conv_id, t.turn)
SELECT conv_id, turn, m AS n_references, round(coalesce(keep, 0), 6) AS keep, round(coalesce(delete, 0), 6) AS delete,
  round(coalesce(add, 0), 6) AS add, round(coalesce(keep + delete + add, 0) / 3, 6) AS sari,
  round({_smoothed_sql('greatest(t{n}, 1)')}, 6) AS bleu
FROM bleu_parts LEFT JOIN sari USING (conv_id, turn)"""


@query("met_01_02_several_references", _REFERENCE_SQL)
def several_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = referenced(spark, sf_dir)
    tokens = rows.select(
        *KEY, *[split_ws(F.col(n)).alias(n) for n in ("origin", "hypothesis")], F.transform("references", split_ws).alias("references")
    )
    scores = sentence_scores(tokens.withColumn("n_references", F.size("references").cast("long")), [*KEY, "n_references"], references="references", partitioned=True, unique=True)
    return _rounded(scores, "keep", "delete", "add", "sari", "bleu").select(*KEY, "n_references", "keep", "delete", "add", "sari", "bleu")


@query("met_03_sentence_meteor")
def sentence_meteor(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = triples(spark, sf_dir)
    return rows.select("conv_id", "turn", F.round(meteor(F.col("hypothesis"), F.col("reference")), 6).alias("meteor"))


# Scores by words and positions, without stems, of ``tokens(conv_id, turn, c, r)``.
METEOR_OF_TOKENS = r"""h AS (SELECT conv_id, turn, w, p, row_number() OVER (PARTITION BY conv_id, turn, w ORDER BY p DESC) AS k FROM (
  SELECT conv_id, turn, lower(unnest(c)) AS w, generate_subscripts(c, 1) AS p FROM tokens)),
g AS (SELECT conv_id, turn, w, p, row_number() OVER (PARTITION BY conv_id, turn, w ORDER BY p DESC) AS k FROM (
  SELECT conv_id, turn, lower(unnest(r)) AS w, generate_subscripts(r, 1) AS p FROM tokens)),
m AS (SELECT conv_id, turn, h.p AS hp, g.p AS gp,
        lag(h.p) OVER (PARTITION BY conv_id, turn ORDER BY h.p) AS lh,
        lag(g.p) OVER (PARTITION BY conv_id, turn ORDER BY h.p) AS lg
      FROM h JOIN g USING (conv_id, turn, w, k)),
n AS (SELECT conv_id, turn, count(*) AS n, count(*) FILTER (WHERE lh IS NULL OR hp <> lh + 1 OR gp <> lg + 1) AS chunks
      FROM m GROUP BY ALL),
q AS (SELECT t.conv_id, t.turn, coalesce(n, 0) AS n, coalesce(chunks, 0) AS chunks, len(t.c) AS hyp, len(t.r) AS ref
      FROM tokens t LEFT JOIN n USING (conv_id, turn))"""
METEOR_SCORE = """CASE WHEN n = 0 THEN 0.0 ELSE
  (1 - 0.5 * pow(chunks / n::DOUBLE, 3)) * ((n / hyp::DOUBLE) * (n / ref::DOUBLE))
    / (0.9 * (n / hyp::DOUBLE) + 0.1 * (n / ref::DOUBLE)) END"""


@query(
    "met_03_sentence_meteor_exact",
    f"WITH {TRIPLES}, {METEOR_OF_TOKENS} SELECT conv_id, turn, round({METEOR_SCORE}, 6) AS meteor FROM q",
)
def sentence_meteor_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = triples(spark, sf_dir)
    score = meteor(F.col("hypothesis"), F.col("reference"), stems=False)
    return rows.select("conv_id", "turn", F.round(score, 6).alias("meteor"))


_LOG = """log AS (
  SELECT event_id AS batch, user_id % 30 AS epoch, event_type AS mode, value AS loss,
         CAST(json_extract(props, '$.k') AS BIGINT) + 1 AS count, CAST(floor(value) AS BIGINT) % 7 AS correct
  FROM events)"""


def batch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.select(
        F.col("event_id").alias("batch"),
        (F.col("user_id") % 30).alias("epoch"),
        F.col("event_type").alias("mode"),
        F.col("value").alias("loss"),
        (F.get_json_object("props", "$.k").cast("long") + 1).alias("count"),
        (F.floor("value").cast("long") % 7).alias("correct"),
    )


_VOCAB2 = """pair_vocab AS (
  SELECT token, row_number() OVER (ORDER BY count(*) DESC, token) + 3 AS index
  FROM (SELECT unnest(list_transform(r, lambda x: lower(x))) AS token FROM tokens) GROUP BY token HAVING count(*) >= 2)"""


@query(
    "agg_12_token_accuracy",
    f"WITH {TRIPLES}, {_VOCAB2}"
    """,
coded AS (
  SELECT conv_id, turn, p, coalesce(v.index, 0) AS target, coalesce(u.index, 0) AS predicted FROM (
    SELECT conv_id, turn, lower(unnest(r)) AS rt, generate_subscripts(r, 1) AS p FROM tokens) x
  LEFT JOIN (SELECT conv_id, turn, lower(unnest(c)) AS ct, generate_subscripts(c, 1) AS p FROM tokens) y USING (conv_id, turn, p)
  LEFT JOIN pair_vocab v ON v.token = rt LEFT JOIN pair_vocab u ON u.token = ct)
SELECT count(*) FILTER (WHERE target <> 0 AND target = predicted) AS correct,
       count(*) FILTER (WHERE target <> 0) AS total FROM coded""",
)
def token_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = token_triples(spark, sf_dir)
    for column in ("hypothesis", "reference"):
        rows = rows.withColumn(column, F.transform(column, F.lower))
    vocab = vocab_by_frequency(rows, "reference")
    # Unknown words take the padding id, so they are left out on the target side.
    for column in ("hypothesis", "reference"):
        rows = tokens_to_ids(rows, vocab, column, f"{column}_ids", KEY, unk_id=0)
    longest = F.greatest(F.size("hypothesis_ids"), F.size("reference_ids"))
    padded = rows.select(
        pad_right(F.col("hypothesis_ids"), longest).alias("p"), pad_right(F.col("reference_ids"), longest).alias("t")
    )
    return epochs.token_accuracy(padded, "p", "t")


_EPOCHS = f"""{_LOG},
epochs AS (SELECT epoch, mode, sum(loss) / sum(count) AS loss, sum(correct) / sum(count)::DOUBLE AS accuracy
           FROM log GROUP BY ALL)"""


@query(
    "agg_13_epoch_metrics",
    f"WITH {_EPOCHS} SELECT epoch, mode, round(loss, 6) AS loss, round(accuracy, 6) AS accuracy, "
    "round(exp(loss), 6) AS perplexity FROM epochs",
)
def epoch_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(epochs.epoch_metrics(batch_log(spark, sf_dir)), "loss", "accuracy", "perplexity")


@query(
    "met_04_perplexity",
    f"WITH {_EPOCHS} SELECT epoch, mode, round(exp(loss), 6) AS perplexity, "
    "round(loss / ln(2), 6) AS bits_per_char FROM epochs",
)
def perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    loss = epochs.epoch_metrics(batch_log(spark, sf_dir)).select("epoch", "mode", "loss")
    return loss.select(
        "epoch",
        "mode",
        F.round(epochs.perplexity(F.col("loss")), 6).alias("perplexity"),
        F.round(epochs.bits_per_char(F.col("loss")), 6).alias("bits_per_char"),
    )


@query(
    "agg_14_best_epoch",
    f"WITH {_EPOCHS} SELECT epoch, round(loss, 6) AS loss, round(accuracy, 6) AS accuracy, "
    "round(exp(loss), 6) AS perplexity FROM epochs WHERE mode = 'view' ORDER BY exp(epochs.loss), epoch LIMIT 1",
)
def best_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = epochs.best_epoch(epochs.epoch_metrics(batch_log(spark, sf_dir)), "view")
    return _rounded(best, "loss", "accuracy", "perplexity")


# The same without the token lists, for other sources of them.
SARI_OF_TOKENS = SARI[len(TRIPLES) + 2 :]
BLEU_OF_TOKENS = BLEU[len(TRIPLES) + 2 :]
_BOTH = SARI + ",\n" + BLEU[len(TRIPLES) + 2 :]


@query(
    "agg_15_best_over_rounds",
    f"WITH {_BOTH},"
    f"""
rounds AS (
  SELECT turn, avg((keep + delete + add) / 3) AS sari, avg(b) AS bleu FROM sari JOIN
    (SELECT conv_id, turn, {_smoothed_sql('greatest(t{n}, 1)')} AS b FROM bleu_parts) USING (conv_id, turn)
  GROUP BY turn)
SELECT round(max(bleu), 6) AS best_bleu, round(max(sari), 6) AS best_sari FROM rounds""",
)
def best_over_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = sentence_scores(token_triples(spark, sf_dir), KEY, partitioned=True, unique=True)
    rounds = scores.groupBy("turn").agg(F.avg("sari").alias("sari"), F.avg("bleu").alias("bleu"))
    return _rounded(epochs.best_over_rounds(rounds), "best_bleu", "best_sari")


@query("agg_16_corpus_sari", f"WITH {SARI} SELECT round(avg((keep + delete + add) / 3), 6) AS sari FROM sari")
def sari_of_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = sentence_scores(token_triples(spark, sf_dir), KEY, bleu=False, partitioned=True, unique=True)
    return _rounded(corpus_sari(scores), "sari")


_POOLED = ", ".join(
    f"sum(c{n}) AS c{n}, sum(greatest(t{n}, 1)) AS t{n}, sum(t{n}) AS p{n}" for n in range(1, 5)
)
_STRICT = (
    "CASE WHEN least(c1, c2, c3, c4) > 0 THEN exp(least(0.0, 1 - ref / hyp::DOUBLE)) * exp("
    + " + ".join(f"ln(c{n} / p{n}::DOUBLE) / 4" for n in range(1, 5))
    + ") ELSE 0.0 END"
)
_POOL = f"pool AS (SELECT {_POOLED}, sum(hyp) AS hyp, sum(ref) AS ref FROM bleu_parts)"


def _corpus_bleu(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = sentence_scores(token_triples(spark, sf_dir), KEY, sari=False, partitioned=True, unique=True)
    return _rounded(corpus_bleu(scores), "bleu_smoothed", "bleu_strict")


@query(
    "agg_17_corpus_bleu_smoothed",
    f"WITH {BLEU}, {_POOL} SELECT round({_smoothed_sql('t{n}')}, 6) AS bleu_smoothed FROM pool",
)
def corpus_bleu_smoothed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _corpus_bleu(spark, sf_dir).select("bleu_smoothed")


@query("agg_18_corpus_bleu_strict", f"WITH {BLEU}, {_POOL} SELECT round({_STRICT}, 6) AS bleu_strict FROM pool")
def corpus_bleu_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _corpus_bleu(spark, sf_dir).select("bleu_strict")


@query(
    "corpus_scores",
    f"WITH {_BOTH}, {_POOL} SELECT (SELECT round(avg((keep + delete + add) / 3), 6) FROM sari) AS sari, "
    f"(SELECT round({_smoothed_sql('t{n}')}, 6) FROM pool) AS bleu_smoothed, "
    f"(SELECT round({_STRICT}, 6) FROM pool) AS bleu_strict",
)
def corpus_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both corpus scores from one pass over the n-grams."""
    scores = sentence_scores(token_triples(spark, sf_dir), KEY, partitioned=True, unique=True)
    parts = [f"clip_{n}" for n in range(1, 5)] + [f"total_{n}" for n in range(1, 5)] + ["hyp_len", "ref_len"]
    one_pass = scores.select("sari", *parts)
    return _rounded(corpus_bleu(one_pass, sari=True), "bleu_smoothed", "bleu_strict", "sari")


_STEPS = "CASE mode WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 ELSE 5 END"


@query(
    "win_06_global_step",
    f"WITH {_LOG} SELECT batch, epoch, mode, row_number() OVER (ORDER BY epoch, {_STEPS}, batch) AS step FROM log",
)
def global_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    modes = ["click", "error", "purchase", "signup", "view"]
    return epochs.global_step(batch_log(spark, sf_dir), modes).select("batch", "epoch", "mode", "step")


_CANDIDATES = """cand AS (
  SELECT user_id AS source_id, event_id AS candidate, -value AS logp,
         CAST(json_extract(props, '$.k') AS BIGINT) + 1 AS length FROM events)"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("source_id"),
        F.col("event_id").alias("candidate"),
        (-F.col("value")).alias("logp"),
        (F.get_json_object("props", "$.k").cast("long") + 1).alias("length"),
    )


def _ranking(name: str, score: str, formula: str) -> None:
    sql = f"""WITH {_CANDIDATES}, scored AS (SELECT *, {formula} AS score FROM cand),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY score DESC, candidate) AS rank FROM scored)
SELECT source_id, candidate, round(score, 6) AS score, rank FROM ranked WHERE rank <= 4"""

    @query(name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ranked = rank_candidates(candidates(spark, sf_dir), 4, score=score)
        return ranked.select("source_id", "candidate", F.round("score", 6).alias("score"), F.col("rank").cast("long"))


_ranking("top_03_rank_candidates", "length_power", "logp / pow(length, 0.7)")
_ranking("top_03_rank_candidates_mean", "mean", "logp / (length - 1 + 1e-6)")
_ranking("top_03_rank_candidates_raw", "raw", "logp")


# ---------------------------------------------------------------- prediction


@query("inf_01_batch_predict", "SELECT item_id AS row_id, text, 1 AS candidate, text AS hypothesis FROM benchmark "
       "UNION ALL SELECT doc_id, text, 1, text FROM documents")
def batch_prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    origins = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("row_id"), "text")
    more = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), "text")
    return batch_predict(origins.unionByName(more), "text", identity)


@query(
    "inf_01_scored_candidates",
    r"""WITH words AS (
  SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM conversations
), cand AS (
  SELECT conv_id, turn, i, len(w) AS length, -length(w[i]) / 8.0::DOUBLE AS logp,
    array_to_string(list_concat(w[1:i - 1], w[i + 1:]), ' ') AS hypothesis
  FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM words)
), ranked AS (
  SELECT *, logp / pow(length, 0.7) AS score, row_number() OVER (PARTITION BY conv_id, turn ORDER BY logp DESC, i) AS rank FROM cand
) SELECT conv_id, turn, CAST(rank AS INTEGER) AS rank, hypothesis, logp, CAST(length AS INTEGER) AS length, round(score, 6) AS score
FROM ranked WHERE rank <= 4""",
)
def scored_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = scored_predict(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "text", without_a_word, 4)
    return _rounded(best.drop("text"), "score")


_LEXICON = r"""counts AS (
  SELECT w, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(text, '\s+')) AS w FROM documents)
  WHERE length(w) >= 6 GROUP BY w),
lexicon AS (
  SELECT w AS word, simple FROM (
    SELECT w, first_value(w) OVER (PARTITION BY substr(w, 1, 5) ORDER BY n DESC, w) AS simple FROM counts)
  WHERE w <> simple)"""


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per long word the most frequent word of the documents with the same first five letters."""
    words = exploded(table(spark, sf_dir, "documents"), [], split_ws(F.col("text")), "word")
    counts = words.filter(F.length("word") >= 6).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("head", F.substring("word", 1, 5))
    best = counts.groupBy("head").agg(
        F.min_by("word", F.struct(-F.col("n"), F.col("word"))).alias("simple")
    )
    return counts.join(best, "head").filter(F.col("word") != F.col("simple")).select("word", "simple")


@query(
    "inf_01_lexical_substitution",
    f"WITH {_LEXICON}"
    r""",
flat AS (SELECT conv_id, turn, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM (
  SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS ws FROM conversations))
SELECT conv_id, turn, string_agg(coalesce(simple, w), ' ' ORDER BY p) AS hypothesis
FROM flat LEFT JOIN lexicon ON word = w GROUP BY conv_id, turn""",
)
def substitution(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return lexical_substitution(turns, "text", lexicon(spark, sf_dir), KEY).select("conv_id", "turn", "hypothesis")
