"""Cleaning and token functions over the documents and turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clean, tokens
from ..operators import boundaries, vocab
from ..operators.joins import tokens_to_ids
from .registry import query
from .tables import TRIPLES, WORDS, clean_sql, doc_words, table, token_triples


def _documents(name: str, sql: str, expression) -> None:
    """Register a function of ``documents.text``."""

    @query(name, f"SELECT doc_id, {sql} AS result FROM documents")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, "documents").select("doc_id", expression(F.col("text")).alias("result"))


_BLANKS = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"
_documents("fn_01_lower_strip", f"trim(lower(text), {_BLANKS})", clean.lower_strip)
_documents("fn_02_strip_accents", "strip_accents(text)", clean.strip_accents)
_documents("fn_02_strip_accents_exact", "strip_accents(text)", clean.strip_accents_exact)
_documents("fn_03_space_punct", r"regexp_replace(text, '([.!?])', ' \1', 'g')", clean.space_punct)
_documents("fn_04_remove_brackets", r"regexp_replace(text, '[\(\[].*?[\)\]]', '', 'g')", clean.remove_brackets)
_documents("fn_05_keep_charset", "regexp_replace(text, '[^a-zA-Z0-9%,.!?]+', ' ', 'g')", clean.keep_charset)
_documents("fn_06_collapse_ws", r"trim(regexp_replace(text, '\s+', ' ', 'g'))", clean.collapse_ws)
_documents("fn_07_normalize_sentence", clean_sql("text"), clean.normalize_sentence)
_documents(
    "fn_07_normalize_cased",
    r"trim(regexp_replace(regexp_replace(regexp_replace(strip_accents(text), '([.!?])', ' \1', 'g'), "
    r"'[^a-zA-Z0-9%,.!?]+', ' ', 'g'), '\s+', ' ', 'g'))",
    lambda c: clean.normalize_sentence(c, lower=False, drop_brackets=False),
)


def _prenormalize_sql(column: str) -> str:
    """Look-around written as captured neighbours."""
    for short, following, replacement in clean.PRENORMALIZE:
        plain = following.replace("(", "(?:")
        column = rf"regexp_replace({column}, '(\W){short}\s({plain})', '\1{replacement}\2', 'g')"
    return rf"regexp_replace({column}, '\s', ' ', 'g')"


# The documents' own sentence ends put before their next word as abbreviations, so every rule has work.
_ABBREVIATED = r"regexp_replace(lower(text), '\.\s+([a-z])', ' {} \1', 'g')"
_ALL_SHORT = "ca. x e.g. x eg. x i.e. x ie. x approx. x no. x conf. x et al. x ref. x fig. x y.o. x yo. x p.o. x i.v. x b.i.3. x t.i.3. x q.i.3."


@query(
    "fn_08_prenormalize",
    f"SELECT doc_id, {_prenormalize_sql(_ABBREVIATED.format(_ALL_SHORT))} AS result FROM documents",
)
def prenormalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.regexp_replace(F.lower("text"), r"\.\s+([a-z])", f" {_ALL_SHORT} $1")
    # A step of its own: the rules look at the text more than once.
    texts = table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))
    return texts.select("doc_id", clean.prenormalize(F.col("text")).alias("result"))


_CASES = " ".join(f"WHEN regexp_matches(token, '{p}') THEN '{c}'" for p, c in clean.CONCEPTS)


@query(
    "fn_09_concept_class",
    f"WITH {WORDS}, counts AS (SELECT token, count(*) AS n FROM flat GROUP BY token) "
    f"SELECT CASE {_CASES} ELSE token END AS concept, sum(n)::BIGINT AS n FROM counts GROUP BY 1",
)
def concept_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Count first: each distinct token is matched once.
    counts = vocab.word_counts(doc_words(spark, sf_dir), "tokens")
    classes = counts.select(clean.concept_class(F.col("token")).alias("concept"), "count")
    return classes.groupBy("concept").agg(F.sum("count").alias("n"))


@query("fn_10_mark_text", "SELECT doc_id, '[CLS] ' || text || ' [SEP]' AS result FROM documents")
def mark_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tokens.mark_text(F.col("text")).alias("result"))


def _joined(name: Column) -> Column:
    return F.array_join(name, "|")


@query(
    "fn_20_ngrams",
    f"WITH {TRIPLES} SELECT conv_id, turn, "
    + ", ".join(
        f"array_to_string(list_transform(range(1, greatest(len(s) - {n - 2}, 1)::BIGINT), "
        f"lambda i: array_to_string(list_slice(s, i, i + {n - 1}), ' ')), '|') AS grams_{n}"
        for n in range(1, 5)
    )
    + " FROM tokens",
)
def ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = token_triples(spark, sf_dir)
    return rows.select(
        "conv_id", "turn", *[_joined(tokens.ngrams(F.col("origin"), n)).alias(f"grams_{n}") for n in range(1, 5)]
    )


_SENTENCES = r"""list_filter(string_split(regexp_replace(trim(text, chr(9) || chr(10) || chr(13) || ' '),
  '([.!?]+["'')\]]*)\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')"""


@query(
    "fn_21_sentence_split",
    f"SELECT doc_id, array_to_string({_SENTENCES}, '|') AS sentences, len({_SENTENCES}) AS n FROM documents",
)
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "documents").select("doc_id", tokens.sentence_split(F.col("text")).alias("s"))
    return parts.select("doc_id", _joined(F.col("s")).alias("sentences"), F.size("s").cast("long").alias("n"))


# Words with their final period, and what follows it.
_ENDS = r"""raw AS (
  SELECT doc_id, list_filter(string_split(translate(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     '), ' '), lambda t: t <> '') AS l
  FROM documents
), bare AS (
  SELECT doc_id, i, ltrim(rtrim(t, '"'')],;:'), '"''([') AS b
  FROM (SELECT doc_id, unnest(l) AS t, unnest(range(len(l))) AS i FROM raw)
), ends AS (
  SELECT doc_id, i, lower(CASE WHEN b LIKE '%.' THEN left(b, length(b) - 1) ELSE b END) AS word,
    b LIKE '%.' AS stop, b LIKE '%!' OR b LIKE '%?' AS hard FROM bare
), nexts AS (
  SELECT *, lead(word) OVER (PARTITION BY doc_id ORDER BY i) AS follower FROM ends
), sums AS (
  SELECT count(*) AS total, count(*) FILTER (stop) AS stops FROM ends
), words AS (
  SELECT word, count(*) AS every, count(*) FILTER (stop) AS n, length(replace(word, '.', '')) AS letters
  FROM ends WHERE regexp_matches(word, '^\p{L}[\p{L}.]*$') GROUP BY word
), short AS (
  SELECT word, n, 2 * (n * ln(0.99) + (every - n) * ln(1 - 0.99) - n * ln(stops / total) - (every - n) * ln(1 - stops / total))
    * exp(-letters) * (length(word) - letters + 1) * exp(-(every - n) * ln(letters)) AS score
  FROM words, sums WHERE n > 0
), abbreviations AS (
  SELECT * FROM short WHERE score >= 0.3
), breaks AS (
  SELECT follower FROM nexts WHERE hard OR (stop AND word NOT IN (SELECT word FROM abbreviations))
), heads AS (
  SELECT follower AS word, count(*) AS k FROM breaks WHERE regexp_matches(follower, '^\p{L}+$') GROUP BY 1
), four AS (
  SELECT word, k, m, e, t FROM heads JOIN (SELECT word, count(*) AS m FROM ends GROUP BY word) USING (word),
    (SELECT count(*) AS e FROM breaks), (SELECT total AS t FROM sums)
), likely AS (
  SELECT word, k AS n, t * k > m * e AS often, 2 * (
    CASE WHEN k = 0 THEN 0 ELSE k * ln(k / e) END + CASE WHEN e = k THEN 0 ELSE (e - k) * ln(1 - k / e) END
    + CASE WHEN m = k THEN 0 ELSE (m - k) * ln((m - k) / (t - e)) END
    + CASE WHEN t - e - m + k = 0 THEN 0 ELSE (t - e - m + k) * ln(1 - (m - k) / (t - e)) END
    - m * ln(m / t) - CASE WHEN t = m THEN 0 ELSE (t - m) * ln(1 - m / t) END) AS score
  FROM four
), starters AS (
  SELECT word, n, score FROM likely WHERE often AND score >= 30
)"""


@query(
    "fn_21_learned_boundaries",
    f"WITH {_ENDS} SELECT 'abbreviation' AS kind, word, n, round(score, 6) AS score FROM abbreviations "
    "UNION ALL SELECT 'starter', word, n, round(score, 6) FROM starters",
)
def learned_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    learned = boundaries.learn_boundaries(table(spark, sf_dir, "documents"))
    kinds = [("abbreviation", learned.abbreviations), ("starter", learned.starters)]
    short, heads = (t.select(F.lit(kind).alias("kind"), "word", "n", F.round("score", 6).alias("score")) for kind, t in kinds)
    return short.unionByName(heads)


_BARE = "ltrim(rtrim({}, '\"'')],;:'), '\"''([')"


@query(
    "fn_21_learned_sentences",
    f"""WITH {_ENDS}, cuts AS (
  SELECT doc_id, string_split(regexp_replace(trim(text, {_BLANKS}), '([.!?]+["'')\\]]*)(\\s+)', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS p
  FROM documents
), pieces AS (
  SELECT doc_id, unnest(p) AS piece, unnest(range(len(p))) AS k FROM cuts
), plain AS (
  SELECT doc_id, k, piece, translate(piece, chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     ') AS q FROM pieces
), sides AS (
  SELECT doc_id, k, piece, lag({_BARE.format("string_split(q, ' ')[-1]")}) OVER (PARTITION BY doc_id ORDER BY k) AS last,
    {_BARE.format("string_split(ltrim(q, ' '), ' ')[1]")} AS head FROM plain
), judged AS (
  SELECT doc_id, k, piece, coalesce(last LIKE '%.' AND lower(left(last, length(last) - 1)) IN (SELECT word FROM abbreviations), false)
    AND NOT (left(head, 1) <> lower(left(head, 1))
      AND lower(CASE WHEN head LIKE '%.' THEN left(head, length(head) - 1) ELSE head END) IN (SELECT word FROM starters)) AS joined
  FROM sides
), texts AS (
  SELECT doc_id, string_agg(CASE WHEN joined THEN '' ELSE chr(1) END || piece, '' ORDER BY k) AS g FROM judged GROUP BY doc_id
), lists AS (
  SELECT doc_id, list_filter(list_transform(string_split(g, chr(1)), lambda s: trim(s, {_BLANKS})), lambda s: s <> '') AS s FROM texts
) SELECT doc_id, array_to_string(s, '|') AS sentences, len(s) AS n FROM lists""",
)
def learned_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    parts = docs.select("doc_id", boundaries.learn_boundaries(docs).sentences(F.col("text")).alias("s"))
    return parts.select("doc_id", _joined(F.col("s")).alias("sentences"), F.size("s").cast("long").alias("n"))


@query("fn_22_word_tokenize")
def word_tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    words = tokens.word_tokenize(F.col("text"), F.col("lang"))
    return docs.select("doc_id", "lang", words.alias("w")).select(
        "doc_id", "lang", _joined(F.col("w")).alias("words"), F.size("w").cast("long").alias("n")
    )


@query(
    "fn_23_split_fields",
    "SELECT doc_id, f[1] AS a, f[2] AS b, f[3] AS c, array_to_string(f[4:], '|') AS rest, "
    "greatest(len(f) - 3, 0) AS n_rest FROM (SELECT doc_id, string_split(replace(text, chr(10), chr(9)), chr(9)) AS f FROM documents)",
)
def split_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.translate("text", "\n", "\t")
    fields = tokens.split_fields(line, ["a", "b", "c"], rest="more")
    rest = [F.array_join("more", "|").alias("rest"), F.size("more").cast("long").alias("n_rest")]
    return table(spark, sf_dir, "documents").select("doc_id", *fields).select("doc_id", "a", "b", "c", *rest)


@query("fn_24_unescape_newlines", "SELECT doc_id, replace(text, chr(10), ' ') AS result FROM documents")
def unescape_newlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    escaped = F.replace("text", F.lit("\n"), F.lit("\\n"))
    return table(spark, sf_dir, "documents").select("doc_id", tokens.unescape_newlines(escaped).alias("result"))


# ---------------------------------------------------------------- vocabularies


_BY_COUNT = """freq AS (
  SELECT token, row_number() OVER (ORDER BY n DESC, token) + 3 AS index, n AS count
  FROM (SELECT lower(token) AS token, count(*) AS n FROM flat GROUP BY 1) WHERE n >= 2
  UNION ALL
  SELECT token, index, 0 FROM (VALUES ('<unk>', 0), ('<pad>', 1), ('<sos>', 2), ('<eos>', 3)) s(token, index))"""


@query(
    "win_02_vocab_by_first_seen",
    f"WITH {WORDS}, firsts AS (SELECT token, min(row_id * 1000000 + pos) AS f, count(*) AS count FROM flat GROUP BY token) "
    "SELECT token, row_number() OVER (ORDER BY f) - 1 AS index, count FROM firsts",
)
def vocab_by_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocab.vocab_by_first_seen(doc_words(spark, sf_dir), "tokens")


@query("win_03_vocab_by_frequency", f"WITH {WORDS}, {_BY_COUNT} SELECT token, index, count FROM freq")
def vocab_by_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocab.vocab_by_frequency(doc_words(spark, sf_dir), "tokens")


@query(
    "join_06_tokens_to_ids",
    f"WITH {WORDS}, {_BY_COUNT} SELECT row_id, string_agg(coalesce(index, 0)::VARCHAR, ' ' ORDER BY pos) AS ids "
    "FROM flat LEFT JOIN freq USING (token) GROUP BY row_id",
)
def lookup_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = doc_words(spark, sf_dir)
    coded = tokens_to_ids(words, vocab.vocab_by_frequency(words, "tokens"), "tokens", "ids", ["row_id"], unk_id=0)
    return coded.select("row_id", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))
