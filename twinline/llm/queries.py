"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import contamination
from .exact_dedup import exact_groups
from .html_text import extract
from .jaccard_join import jaccard_groups
from .licenses import scan
from .line_dedup import dedup_lines
from .merkle import tampered_proofs
from .mixing import mix
from .sharding import sharded
from .spelling import spelling_groups
from .token_counts import maintained_totals
from .toxicity import toxicity
from .warc import archive_round_trip

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_CONTAMINATION_SQL = r"""
WITH ascii_lower AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), dw AS (
  SELECT doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM ascii_lower
), iw AS (
  SELECT item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, len(w) AS total, unnest(CASE WHEN len(w) < 13 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i + 12], ' ')) END) AS gram
  FROM iw WHERE len(w) > 0
), grams AS (
  SELECT item_id, least(total, 13) AS size, gram FROM windows
), sizes AS (SELECT DISTINCT size FROM grams),
runs AS (
  SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS gram
  FROM (SELECT doc_id, size, w, unnest(range(1, len(w) - size + 2)) AS i FROM dw, sizes WHERE len(w) >= size)
), hits AS (
  SELECT doc_id, i, r.size, item_id FROM runs r JOIN grams g ON r.gram = g.gram AND r.size = g.size
), places AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY 1
), found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hits) GROUP BY 1
)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN places USING (doc_id) LEFT JOIN found USING (doc_id)
"""


@_query("op4_benchmark_decontamination", _CONTAMINATION_SQL)
def op4(spark, sf_dir):
    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


_EXACT_SQL = r"""
WITH rows AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
    sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
  doc_id = first_value(doc_id) OVER w AS kept, text_sha256
FROM rows WINDOW w AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id)
"""


@_query("op6_exact_dedup", _EXACT_SQL)
def op6(spark, sf_dir):
    return exact_groups(_table(spark, sf_dir, "documents"))


_MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS draw
  FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 2.0::DOUBLE * sum(size) AS cap FROM sized GROUP BY 1
), weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3
    WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight
  FROM sources
), ranked AS (
  -- In order of cap per weight, the clamped sources come first.
  SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
    sum(weight) OVER (ORDER BY cap / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open,
    (SELECT 1.5::DOUBLE * sum(size) FROM sized) AS budget
  FROM weighed
), level AS (
  SELECT min_by(budget - below, cap / weight) AS rest, min_by(open, cap / weight) AS open
  FROM ranked WHERE cap * open >= (budget - below) * weight
), filled AS (
  SELECT source, source_size, least((SELECT rest FROM level) * weight / (SELECT CAST(open AS DOUBLE) FROM level), cap) AS target
  FROM weighed
), parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole,
    CAST(floor(target) AS BIGINT) AS goal FROM filled
), ordered AS (
  SELECT doc_id, s.source, size, source_size, target, whole, goal - whole * source_size AS extra,
    coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY draw, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run
  FROM sized s JOIN parts p ON s.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, source, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(whole * size + greatest(0, least(size, extra - run)) AS BIGINT) AS taken
FROM ordered
"""


@_query("op9_mixing", _MIX_SQL)
def op9(spark, sf_dir):
    return mix(_table(spark, sf_dir, "documents"))


_JACCARD_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
  FROM words WHERE len(w) > 0
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM shared JOIN sizes sx ON x = sx.doc_id JOIN sizes sy ON y = sy.doc_id WHERE 100 * c >= 75 * (sx.n + sy.n - c)
), reach AS (
  SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, y FROM reach JOIN links ON r = x
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY 1) USING (doc_id)
"""


@_query("op3_ngram_jaccard_join", _JACCARD_SQL)
def op3(spark, sf_dir):
    return jaccard_groups(_table(spark, sf_dir, "documents")).drop("class")


@_query("op5_line_dedup")
def op5(spark, sf_dir):
    return dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"), short_repeats=True)


@_query("op10_toxicity")
def op10(spark, sf_dir):
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query("op8_html_extraction")
def op8(spark, sf_dir):
    return extract(_table(spark, sf_dir, "pages"))


_WARC_SQL = r"""
WITH rows AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), latest AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS response FROM rows
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> response THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> response THEN response END AS refers_to
FROM latest
"""


@_query("op2_warc", _WARC_SQL)
def op2(spark, sf_dir):
    return archive_round_trip(_table(spark, sf_dir, "pages"))


@_query("op1_license_scan")
def op1(spark, sf_dir):
    return scan(_table(spark, sf_dir, "documents"))


@_query("op7_token_counts")
def op7(spark, sf_dir):
    return maintained_totals(_table(spark, sf_dir, "documents"))


# The table of CRC-32, and the checksum of a list of bytes by it.
_CRC_TABLE = """crc_table AS (
  SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda x, k: xor(x >> 1, (x & 1) * 3988292384), b)) AS t
)"""


def _crc(data: str) -> str:
    step = f"list_reduce({data}, lambda crc, b: xor(crc >> 8, t[(xor(crc, b) & 255) + 1]), 4294967295::BIGINT)"
    return f"xor({step}, 4294967295::BIGINT)"


_ASCII = "list_transform(string_split({0}, ''), lambda c: unicode(c)::BIGINT)"
_FIELDS = " || ".join(
    f"coalesce(CAST(octet_length(encode(CAST({c} AS VARCHAR))) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
    for c in ("doc_id", "source", "lang", "n_chars")
)
_MERKLE_SQL = f"""
WITH RECURSIVE {_CRC_TABLE}, leaves AS (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS r,
    sha256({_FIELDS} || coalesce(CAST(octet_length(encode(text)) AS VARCHAR) || ':' || text, '-')) AS leaf,
    sha256({_FIELDS} || coalesce(CAST(octet_length(encode(bare)) AS VARCHAR) || ':' || bare, '-')) AS changed
  FROM (
    SELECT *, CASE WHEN {_crc(_ASCII.format("CAST(doc_id AS VARCHAR)"))} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS bare
    FROM documents, crc_table
  )
), nodes AS (
  SELECT source, 0 AS level, r, leaf AS h, count(*) OVER (PARTITION BY source) AS n FROM leaves
  UNION ALL
  SELECT source, level + 1, r // 3, sha256(string_agg(h, '' ORDER BY r)), any_value((n + 2) // 3)
  FROM nodes WHERE n > 1 GROUP BY source, level, r // 3
), subroots AS (
  SELECT source, h AS subroot, row_number() OVER (ORDER BY source IS NOT NULL, encode(source)) - 1 AS r FROM nodes WHERE n = 1
), tops AS (
  SELECT 0 AS level, r, subroot AS h, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT level + 1, r // 3, sha256(string_agg(h, '' ORDER BY r)), any_value((n + 2) // 3) FROM tops WHERE n > 1 GROUP BY level, r // 3
), beside AS (
  SELECT a.source, a.level, a.r, coalesce(string_agg(b.h, '' ORDER BY b.r) FILTER (b.r < a.r), '') AS lefts,
    coalesce(string_agg(b.h, '' ORDER BY b.r) FILTER (b.r > a.r), '') AS rights
  FROM nodes a JOIN nodes b ON a.source IS NOT DISTINCT FROM b.source AND a.level = b.level AND a.r // 3 = b.r // 3
  WHERE a.n > 1 GROUP BY a.source, a.level, a.r
), beside_top AS (
  SELECT a.level, a.r, coalesce(string_agg(b.h, '' ORDER BY b.r) FILTER (b.r < a.r), '') AS lefts,
    coalesce(string_agg(b.h, '' ORDER BY b.r) FILTER (b.r > a.r), '') AS rights
  FROM tops a JOIN tops b ON a.level = b.level AND a.r // 3 = b.r // 3 WHERE a.n > 1 GROUP BY a.level, a.r
), climbed AS (
  SELECT doc_id, source, 0 AS level, r, changed AS h, '' AS proof FROM leaves
  UNION ALL
  SELECT doc_id, c.source, c.level + 1, c.r // 3, sha256(lefts || h || rights), proof || lefts || rights
  FROM climbed c JOIN beside b ON c.source IS NOT DISTINCT FROM b.source AND c.level = b.level AND c.r = b.r
), through AS (
  SELECT doc_id, 0 AS level, s.r, h, proof FROM subroots s
  JOIN (SELECT doc_id, source, arg_max(h, level) AS h, arg_max(proof, level) AS proof FROM climbed GROUP BY doc_id, source) c
    ON s.source IS NOT DISTINCT FROM c.source
  UNION ALL
  SELECT doc_id, t.level + 1, t.r // 3, sha256(lefts || h || rights), proof || lefts || rights
  FROM through t JOIN beside_top b ON t.level = b.level AND t.r = b.r
), folded AS (
  SELECT doc_id, arg_max(h, level) AS folded_root, arg_max(proof, level) AS proof FROM through GROUP BY doc_id
)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded_root, folded_root = root AS verified
FROM leaves JOIN folded USING (doc_id) JOIN subroots s ON leaves.source IS NOT DISTINCT FROM s.source,
  (SELECT h AS root FROM tops WHERE n = 1)
"""


@_query("op11_merkle_manifest", _MERKLE_SQL)
def op11(spark, sf_dir):
    return tampered_proofs(_table(spark, sf_dir, "documents"))


_BYTES = """flatten(list_transform(string_split({0}, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT]
  ELSE [192 + unicode(c)::BIGINT // 64, 128 + unicode(c)::BIGINT % 64] END))"""
_SPELLING_SQL = f"""
WITH RECURSIVE {_CRC_TABLE}, runs AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\u00C0-\u00FF]+')) AS run FROM documents
  ) GROUP BY 1, 2
), marked AS (
  SELECT run, n, {_crc(_BYTES.format("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run"))} AS crc FROM runs, crc_table
), cut AS (
  SELECT CASE WHEN crc % 97 = 0 THEN substr(run, 1, crc % length(run)) || substr(run, crc % length(run) + 2) ELSE run END AS word, n
  FROM marked
), words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM cut WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), skips AS (
  SELECT word, n, i, substr(word, 1, i) AS head, substr(word, i + 2) AS tail FROM (SELECT *, unnest(range(length(word))) AS i FROM words)
), replaced AS (
  SELECT a.word AS x, b.word AS y, b.n FROM skips a JOIN skips b ON a.head = b.head AND a.tail = b.tail AND a.word <> b.word
), missing AS (
  SELECT DISTINCT a.word AS longer, a.n AS n_longer, b.word AS shorter, b.n AS n_shorter FROM skips a JOIN words b ON b.word = a.head || a.tail
), near AS (
  SELECT x, y, n FROM replaced UNION ALL SELECT longer, shorter, n_shorter FROM missing UNION ALL SELECT shorter, longer, n_longer FROM missing
), ranked AS (
  SELECT x, y, n, count(*) OVER (PARTITION BY x) AS n_near, row_number() OVER (PARTITION BY x ORDER BY n DESC, encode(y)) AS place FROM near
), forms AS (
  SELECT word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN r.n >= 2 * w.n THEN y END AS form, CASE WHEN r.n >= 2 * w.n THEN r.n END AS form_n
  FROM words w LEFT JOIN ranked r ON word = x AND place = 1
), chains AS (
  SELECT word, word AS last, 0 AS step FROM forms
  UNION ALL
  SELECT c.word, f.form, step + 1 FROM chains c JOIN forms f ON c.last = f.word WHERE f.form IS NOT NULL
), roots AS (SELECT word, arg_max(last, step) AS root FROM chains GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN roots USING (word)
"""


@_query("op12_spelling_variants", _SPELLING_SQL)
def op12(spark, sf_dir):
    return spelling_groups(_table(spark, sf_dir, "documents"))


@_query("op13_sharding")
def op13(spark, sf_dir):
    # File and row number name each row, in every scan alike.
    return sharded(_table(spark, sf_dir, "documents"), F.struct("_metadata.file_name", "_metadata.row_index"))
