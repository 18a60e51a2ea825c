from pyspark.sql import functions as F

from twinline.llm.token_counts import Rollup, deletes, inserts, maintained_totals, revisions
from twinline.session import shared_dir


def frame(spark, rows):
    return spark.createDataFrame(rows, "source string, lang string, tokenizer string, tokens long")


def totals(rollup):
    return {(r.source, r.lang, r.tokenizer): (r.docs, r.tokens) for r in rollup.totals().collect()}


def test_batches_are_signed_and_idempotent(spark):
    rollup = Rollup(spark, shared_dir(spark, "rollup"))
    first = frame(spark, [("a", "en", "t/1", 5), ("a", "en", "t/1", 7), (None, None, "t/1", 3), ("b", "en", "t/1", None)])
    for _ in range(3):
        rollup.commit("one", inserts(first))
    assert totals(rollup) == {("a", "en", "t/1"): (2, 12), (None, None, "t/1"): (1, 3), ("b", "en", "t/1"): (1, 0)}
    rollup.commit("two", revisions(frame(spark, [("a", "en", "t/1", 5)]), frame(spark, [("a", "en", "t/2", 9)])))
    rollup.commit("three", deletes(frame(spark, [(None, None, "t/1", 3)])))
    rollup.commit("two", revisions(frame(spark, [("a", "en", "t/1", 5)]), frame(spark, [("a", "en", "t/2", 9)])))
    assert totals(rollup) == {("a", "en", "t/1"): (1, 7), ("a", "en", "t/2"): (1, 9), ("b", "en", "t/1"): (1, 0)}
    # A batch that is committed again without a row counts nothing.
    rollup.commit("two", inserts(first.limit(0)))
    assert totals(rollup) == {("a", "en", "t/1"): (2, 12), ("b", "en", "t/1"): (1, 0)}


def test_totals_match_a_direct_count(spark, sf_dir, odd_docs, no_docs):
    import base64

    import tiktoken

    from twinline.llm.token_counts import PATTERN, TOKENIZER_FILE

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lines = [line.split() for line in open(TOKENIZER_FILE, "rb").read().splitlines()]
    encoder = tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in lines}, special_tokens={})
    want = {}
    for r in docs.collect():
        for tokenizer, n in (("words/1", len((r.text or "").split())), ("bpe/1", len(encoder.encode_ordinary(r.text or "")))):
            old = want.get((r.source, r.lang, tokenizer), (0, 0))
            want[r.source, r.lang, tokenizer] = (old[0] + 1, old[1] + n)
    got = {(r.source, r.lang, r.tokenizer): (r.docs, r.tokens) for r in maintained_totals(docs).collect()}
    assert got == want
    assert maintained_totals(odd_docs).agg(F.sum("docs")).first()[0] == 2 * odd_docs.count()
    assert maintained_totals(no_docs).count() == 0
