import hashlib
import re

from twinline.llm.bits import cells, filter_words, may_hold
from twinline.llm.exact_dedup import exact_groups


def brute(rows):
    groups = {}
    for key, text in rows:
        text = text or ""
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text), []).append((-len(text), key is None, key or 0, key))
    return {t: (min(g)[3], len(g)) for t, g in groups.items()}


def test_matches_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(["a b", "ab", " a  b ", "", None, "\t\n", "c", "é b", "éb", "d e", "de"] * 3)]
    want = brute(rows)
    got = exact_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        plain = re.sub(r"[\x20\x09-\x0D]", "", texts[r.doc_id] or "")
        assert (r.keep_id, r.group_size) == want[plain]
        assert r.kept == (r.keep_id == r.doc_id)
        assert r.text_sha256 == hashlib.sha256(plain.encode()).hexdigest()


def test_odd_rows(odd_docs, no_docs):
    got = exact_groups(odd_docs).collect()
    assert len(got) == odd_docs.count()
    twice = [r for r in got if r.doc_id == 3]
    assert sorted(r.kept for r in twice) == [False, True] and twice[0].group_size == 2
    # Four texts are empty; the longest original is the blank lines of document 4.
    empty = [r for r in got if r.text_sha256 == hashlib.sha256(b"").hexdigest()]
    assert len(empty) == 4 and {r.keep_id for r in empty} == {4}
    assert exact_groups(no_docs).count() == 0


def test_every_group_keeps_a_row_when_scans_are_cut_otherwise(spark):
    docs = spark.range(20_000).repartition(3).selectExpr("id as doc_id", "concat('text ', id % 900) as text")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        groups = exact_groups(docs)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "30k")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        kept = groups.filter("kept").groupBy("text_sha256").count().collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(kept) == 900 and {r["count"] for r in kept} == {1}


def test_filter_never_misses(spark):
    keys = spark.range(5000)
    words = filter_words(keys.selectExpr("id").select(*[c.alias("cell") for c in cells(1 << 16, "id")][:1]), 1 << 16)
    both = keys.select(*cells(1 << 16, "id")[1:]).toDF("cell")
    words = filter_words(both.union(keys.select(cells(1 << 16, "id")[0].alias("cell"))), 1 << 16)
    assert keys.filter(may_hold(words, 1 << 16, "id")).count() == 5000
    assert spark.range(10_000, 20_000).filter(may_hold(words, 1 << 16, "id")).count() < 1000


def test_no_python_in_plan(odd_docs):
    plan = exact_groups(odd_docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
