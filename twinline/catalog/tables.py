"""Stand-ins for the corpora, derived from the given tables, and the same in SQL.

* aligned corpus: a turn of a conversation and each of the next four turns (document = conversation,
  version = turn),
* large pair corpus: every turn and its next turn; small pair corpus: those that start with the user,
* scored triples: three turns in a row as origin, hypothesis and reference,
* nested articles: a document's lines under its language,
* piece vocabulary: characters and frequent words of the conversations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.tokens import exploded, split_ws
from ..functions.wordpiece import WordPiece
from ..operators.lm import add_eos
from ..operators.vocab import word_counts
from ..schemas import SPECIALS
from ..session import spread

STEPS = 4
N_TRAIN, N_VALID = 80, 10
VOCAB_WORDS, MIN_CHAR_COUNT = 2000, 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    scan = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(scan) if name == "documents" else scan


# ---------------------------------------------------------------- aligned pairs


def aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``row_id, doc_id, docv_input, docv_output, input, output``; every turn meets four at most."""
    turns = table(spark, sf_dir, "conversations")
    steps = F.explode(F.array(*[F.lit(i) for i in range(1, STEPS + 1)]))
    left = turns.select("conv_id", "turn", F.col("text").alias("input"), steps.alias("step"))
    left = left.withColumn("to", F.col("turn") + F.col("step"))
    right = turns.select("conv_id", F.col("turn").alias("to"), F.col("text").alias("output"))
    return left.join(right, ["conv_id", "to"]).select(
        (F.shiftleft("conv_id", 34) + F.col("turn") * STEPS + F.col("step") - 1).alias("row_id"),
        F.col("conv_id").cast("string").alias("doc_id"),
        F.concat(F.lit("V"), "turn").alias("docv_input"),
        F.concat(F.lit("V"), "to").alias("docv_output"),
        "input",
        "output",
    )


ALIGNED = """aligned AS (
  SELECT a.conv_id * 17179869184 + a.turn * 4 + (b.turn - a.turn) - 1 AS row_id,
         CAST(a.conv_id AS VARCHAR) AS doc_id, 'V' || a.turn AS docv_input, 'V' || b.turn AS docv_output,
         a.text AS input, b.text AS output
  FROM conversations a JOIN conversations b
    ON a.conv_id = b.conv_id AND b.turn - a.turn BETWEEN 1 AND 4)"""


def next_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    left = turns.select("conv_id", "turn", "role", F.col("text").alias("input"), (F.col("turn") + 1).alias("to"))
    right = turns.select("conv_id", F.col("turn").alias("to"), F.col("text").alias("output"))
    return left.join(right, ["conv_id", "to"]).select(
        (F.shiftleft("conv_id", 34) + F.col("turn")).alias("row_id"), "role", "input", "output"
    )


def wiki(spark: SparkSession, sf_dir: str) -> DataFrame:
    return next_turns(spark, sf_dir).drop("role")


def health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return next_turns(spark, sf_dir).filter(F.col("role") == "user").drop("role")


CORPORA = """next_turns AS (
  SELECT a.conv_id * 17179869184 + a.turn AS row_id, a.role, a.text AS input, b.text AS output
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
wiki AS (SELECT row_id, input, output FROM next_turns),
health AS (SELECT row_id, input, output FROM next_turns WHERE role = 'user')"""


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conv_id, turn, origin, hypothesis, reference``, lying by ``(conv_id, turn)``.

    Each turn sends itself to the three triples it is part of, so one shuffle on a unique key does.
    """
    turns = table(spark, sf_dir, "conversations")
    slots = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))
    sent = turns.select("conv_id", "turn", "text", slots.alias("slot")).filter(F.col("turn") >= F.col("slot"))
    sent = sent.select("conv_id", (F.col("turn") - F.col("slot")).alias("turn"), "text", "slot")
    names = ("origin", "hypothesis", "reference")
    picked = [F.max(F.when(F.col("slot") == i, F.col("text"))).alias(n) for i, n in enumerate(names)]
    return sent.groupBy("conv_id", "turn").agg(*picked).filter(
        F.col("origin").isNotNull() & F.col("hypothesis").isNotNull() & F.col("reference").isNotNull()
    )


def token_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("origin", "hypothesis", "reference")
    return triples(spark, sf_dir).select("conv_id", "turn", *[split_ws(F.col(n)).alias(n) for n in names])


MOST_REFERENCES = 5


def referenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conv_id, turn, origin, hypothesis, references``: a turn, the next, and the texts of up to five after that."""
    turns = table(spark, sf_dir, "conversations")
    slots = F.explode(F.array(*[F.lit(i) for i in range(MOST_REFERENCES + 2)]))
    sent = turns.select("conv_id", "turn", "text", slots.alias("slot")).filter(F.col("turn") >= F.col("slot"))
    sent = sent.select("conv_id", (F.col("turn") - F.col("slot")).alias("turn"), "text", "slot")
    later = F.array_sort(F.collect_list(F.when(F.col("slot") > 1, F.struct("slot", "text"))))
    rows = sent.groupBy("conv_id", "turn").agg(
        *[F.max(F.when(F.col("slot") == i, F.col("text"))).alias(n) for i, n in enumerate(("origin", "hypothesis"))],
        F.transform(later, lambda x: x["text"]).alias("references"),
    )
    return rows.filter(F.col("origin").isNotNull() & F.col("hypothesis").isNotNull())


REFERENCED = r"""refs AS (
  SELECT a.conv_id, a.turn, c.turn AS k, list_filter(regexp_split_to_array(c.text, '\s+'), lambda x: x <> '') AS r
  FROM conversations a JOIN conversations c ON a.conv_id = c.conv_id AND c.turn BETWEEN a.turn + 2 AND a.turn + 6),
pairs AS (
  SELECT a.conv_id, a.turn, list_filter(regexp_split_to_array(a.text, '\s+'), lambda x: x <> '') AS s,
    list_filter(regexp_split_to_array(b.text, '\s+'), lambda x: x <> '') AS c,
    (SELECT count(*) FROM refs r WHERE r.conv_id = a.conv_id AND r.turn = a.turn) AS m
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"""


TRIPLES = r"""triples AS (
  SELECT a.conv_id, a.turn, a.text AS origin, b.text AS hypothesis, c.text AS reference
  FROM conversations a
  JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
  JOIN conversations c ON a.conv_id = c.conv_id AND c.turn = a.turn + 2),
tokens AS (
  SELECT conv_id, turn,
         list_filter(regexp_split_to_array(origin, '\s+'), lambda x: x <> '') AS s,
         list_filter(regexp_split_to_array(hypothesis, '\s+'), lambda x: x <> '') AS c,
         list_filter(regexp_split_to_array(reference, '\s+'), lambda x: x <> '') AS r
  FROM triples)"""


# ---------------------------------------------------------------- documents as token streams


def line_tokens(text, eos: str = "eos"):
    """Tokens of all lines of a text, each line with its end mark."""
    return F.flatten(F.transform(F.split(text, "\n"), lambda line: add_eos(split_ws(line), eos)))


def doc_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("row_id"), line_tokens(F.col("text")).alias("tokens"))


STREAM = r"""docs AS (
  SELECT doc_id AS row_id, flatten(list_transform(string_split(text, chr(10)),
    lambda l: list_append(list_filter(regexp_split_to_array(l, '\s+'), lambda x: x <> ''), '<eos>'))) AS tokens
  FROM documents),
stream AS (
  SELECT token, row_number() OVER (ORDER BY row_id, p) - 1 AS pos
  FROM (SELECT row_id, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS p FROM docs))"""


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``row_id, shard, tokens``: the lines of all documents as sentences with edge marks."""
    docs = table(spark, sf_dir, "documents")
    lines = exploded(docs, ["doc_id", "source"], F.split("text", "\n"), "line", "n")
    return lines.select(
        (F.shiftleft("doc_id", 24) + F.col("n")).alias("row_id"),
        F.col("source").alias("shard"),
        add_eos(split_ws(F.col("line")), "double").alias("tokens"),
    )


LINES = r"""doc_lines AS (
  SELECT doc_id * 16777216 + p - 1 AS row_id, source AS shard,
         ['<S>'] || list_filter(regexp_split_to_array(line, '\s+'), lambda x: x <> '') || ['<S>'] AS tokens
  FROM (SELECT doc_id, source, unnest(ls) AS line, generate_subscripts(ls, 1) AS p
        FROM (SELECT doc_id, source, string_split(text, chr(10)) AS ls FROM documents)))"""


def doc_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("row_id"), "lang", "source", split_ws(F.col("text")).alias("tokens"))


WORDS = r"""doc_words AS (
  SELECT doc_id AS row_id, lang, source, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS tokens
  FROM documents),
flat AS (SELECT row_id, unnest(tokens) AS token, generate_subscripts(tokens, 1) - 1 AS pos FROM doc_words)"""


def hash_sql(column: str, seed: int) -> str:
    """SQL of ``random_key``."""
    return f"('0x' || substr(md5('{seed}:' || {column}), 1, 15))::BIGINT"


# ---------------------------------------------------------------- word pieces


def piece_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``token, index``: markers, characters, frequent words, and both again as continuations."""
    texts = table(spark, sf_dir, "conversations").select(split_ws(F.col("text")).alias("chunks"))
    # Blank-free chunks are counted first; characters and words come from the distinct ones.
    chunks = word_counts(texts, "chunks").withColumnRenamed("token", "chunk")
    total = F.sum("count").alias("count")
    chars = exploded(chunks, ["count"], F.split("chunk", ""), "token").filter(F.length("token") > 0)
    chars = chars.groupBy("token").agg(total).filter(F.col("count") >= MIN_CHAR_COUNT)
    words = exploded(chunks, ["count"], F.regexp_extract_all("chunk", F.lit(r"\p{L}+"), F.lit(0)), "token")
    words = words.filter(F.length("token") >= 2).groupBy("token").agg(total)
    # The vocabulary's size is part of what it is: the most frequent words.
    words = words.orderBy(F.desc("count"), "token").limit(VOCAB_WORDS)
    base = chars.select(F.lit(1).alias("kind"), "token").unionByName(words.select(F.lit(3).alias("kind"), "token"))
    both = base.unionByName(base.select((F.col("kind") + 1).alias("kind"), F.concat(F.lit("##"), "token").alias("token")))
    ranked = both.withColumn("index", F.row_number().over(Window.orderBy("kind", "token")) + len(SPECIALS) - 1)
    marks = F.array(*[F.struct(F.lit(s).alias("token"), F.lit(i).alias("index")) for i, s in enumerate(SPECIALS)])
    return spark.range(1).select(F.inline(marks)).unionByName(ranked.select("token", "index"))


_WORDPIECES: dict[tuple[str, str], WordPiece] = {}


def wordpiece(spark: SparkSession, sf_dir: str) -> WordPiece:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _WORDPIECES:
        _WORDPIECES[key] = WordPiece(piece_vocab(spark, sf_dir))
    return _WORDPIECES[key]


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``k, text``: every turn under the row number it has as an input of the large pair corpus."""
    rows = table(spark, sf_dir, "conversations")
    return rows.select((F.shiftleft("conv_id", 34) + F.col("turn")).alias("k"), "text")


TURNS = "turns AS (SELECT conv_id * 17179869184 + turn AS k, text FROM conversations)"

VOCAB = r"""base AS (
  SELECT 1 AS kind, token FROM (
    SELECT unnest(string_split(regexp_replace(text, '\s', '', 'g'), '')) AS token FROM conversations)
  WHERE token <> '' GROUP BY token HAVING count(*) >= 20
  UNION ALL
  SELECT 3, token FROM (
    SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '\p{L}+')) AS token FROM conversations)
    WHERE length(token) >= 2 GROUP BY token ORDER BY n DESC, token LIMIT 2000)),
both_kinds AS (SELECT kind, token FROM base UNION ALL SELECT kind + 1, '##' || token FROM base),
vocab AS (
  SELECT token, i AS index FROM (VALUES ('[PAD]', 0), ('[UNK]', 1), ('[CLS]', 2), ('[SEP]', 3), ('[MASK]', 4)) t(token, i)
  UNION ALL
  SELECT token, row_number() OVER (ORDER BY kind, token) + 4 FROM both_kinds)"""


def pieces_sql(source: str, name: str = "tok", vocab: bool = True) -> str:
    """CTEs that cut ``source(k, text)`` into ``name(k, body, pieces)``, the latter with markers."""
    return (VOCAB + ",\n" if vocab else "") + rf"""w_{name} AS (
  SELECT k, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM (
    SELECT k, regexp_extract_all(text, '[!-/:-@\[-`{{-~]|\p{{P}}|[^\s!-/:-@\[-`{{-~\p{{P}}]+') AS ws FROM {source})),
d_{name} AS (SELECT DISTINCT w FROM w_{name}),
best_{name} AS (
  SELECT w, s, max(l) AS l FROM (
    SELECT w, s, unnest(range(1, length(w) - s + 2)) AS l FROM (SELECT w, unnest(range(1, length(w) + 1)) AS s FROM d_{name})) x
  JOIN vocab v ON v.token = CASE WHEN s > 1 THEN '##' ELSE '' END || substr(w, s, l)
  GROUP BY w, s),
walk_{name} AS (
  SELECT w, 1::BIGINT AS pos, []::VARCHAR[] AS ps FROM d_{name} WHERE length(w) <= 100
  UNION ALL
  SELECT r.w, r.pos + b.l, list_append(r.ps, CASE WHEN r.pos > 1 THEN '##' ELSE '' END || substr(r.w, r.pos, b.l))
  FROM walk_{name} r JOIN best_{name} b ON b.w = r.w AND b.s = r.pos),
known_{name} AS (
  SELECT d.w, coalesce(r.ps, ['[UNK]']) AS ps FROM d_{name} d
  LEFT JOIN walk_{name} r ON r.w = d.w AND r.pos = length(d.w) + 1),
body_{name} AS (
  SELECT k, flatten(list(ps ORDER BY p)) AS body FROM w_{name} JOIN known_{name} USING (w) GROUP BY k),
{name} AS (
  SELECT s.k, coalesce(body, []::VARCHAR[]) AS body,
         ['[CLS]'] || coalesce(body, []::VARCHAR[]) || ['[SEP]'] AS pieces
  FROM {source} s LEFT JOIN body_{name} USING (k))"""


# Lower case, no marks, spaced sentence ends, no brackets, plain characters, single blanks.
def clean_sql(column: str) -> str:
    text = f"strip_accents(trim(lower({column}), chr(9) || chr(10) || chr(13) || ' '))"
    text = rf"regexp_replace({text}, '([.!?])', ' \1', 'g')"
    text = rf"regexp_replace({text}, '[\(\[].*?[\)\]]', '', 'g')"
    text = f"regexp_replace({text}, '[^a-zA-Z0-9%,.!?]+', ' ', 'g')"
    return rf"trim(regexp_replace({text}, '\s+', ' ', 'g'))"
