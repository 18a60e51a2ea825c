"""Sentence scores against several references, held against plain loops."""

import collections
import math
import random

import pytest
from pyspark.sql import functions as F

from twinline.operators.meteor import meteor
from twinline.operators.ngram_metrics import corpus_bleu, sentence_scores


def grams(tokens, n):
    return collections.Counter(" ".join(tokens[i : i + n]) for i in range(len(tokens) - n + 1))


def f1(p, r):
    return 2 * p * r / (p + r) if p or r else 0.0


def sari(source, hyp, refs):
    keep = delete = add = 0.0
    m = len(refs)
    low = lambda words: [w.lower() for w in words]
    for n in range(1, 5):
        s, c = grams(low(source), n), grams(low(hyp), n)
        r = sum((grams(low(x), n) for x in refs), collections.Counter())
        sm, cm = (collections.Counter({g: k * m for g, k in x.items() if m}) for x in (s, c))
        kept, kept_all = sm & cm, sm & r
        good = kept & r
        p = sum(good[g] / kept[g] for g in good) / len(kept) if kept else 0
        q = sum(good[g] / kept_all[g] for g in good) / len(kept_all) if kept_all else 0
        keep += f1(p, q) / 4
        gone, gone_all = sm - cm, sm - r
        share = sum((gone - r)[g] / gone[g] for g in gone - r)
        delete += f1(share / len(gone) if gone else 0, share / len(gone_all) if gone_all else 0) / 4
        new, wanted = set(c) - set(s), set(r) - set(s)
        hit = len(new & set(r))
        add += f1(hit / len(new) if new else 0, hit / len(wanted) if wanted else 0) / 4
    return keep, delete, add


def bleu(hyp, refs):
    logs, zeros = 0.0, 0
    for n in range(1, 5):
        c = grams(hyp, n)
        best = collections.Counter()
        for x in refs:
            best |= grams(x, n)
        clip, total = sum((c & best).values()), max(1, sum(c.values()))
        if n == 1 and not clip:
            return 0.0
        zeros += not clip
        logs += math.log(clip / total if clip else 1 / (2**zeros * total)) / 4
    near = min((abs(len(x) - len(hyp)), len(x)) for x in refs)[1]
    return (1.0 if len(hyp) > near else math.exp(1 - near / len(hyp))) * math.exp(logs)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    sentence = lambda n: [rng.choice(["a", "B", "b", "c", "d", "e"]) for _ in range(n)]
    out = [(i, sentence(rng.randint(0, 9)), sentence(rng.randint(0, 9)), [sentence(rng.randint(0, 9)) for _ in range(i % 6)]) for i in range(60)]
    return out + [(60, ["x"], ["x"], None), (61, ["a", "b"], ["a", "b"], [["a", "b"]] * 3)]


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, "id int, origin array<string>, hypothesis array<string>, refs array<array<string>>")


def test_sentence_scores(table, rows):
    scores = sentence_scores(table, ["id"], references="refs").collect()
    assert len(scores) == len(rows)
    for row in scores:
        _, source, hyp, refs = rows[row.id]
        want = sari(source, hyp, refs or [])
        assert (row.keep, row.delete, row.add) == pytest.approx(want), row.id
        assert row.sari == pytest.approx(sum(want) / 3)
        assert row.bleu == pytest.approx(bleu(hyp, refs) if refs else 0.0), row.id


def test_one_reference_agrees_with_the_single_form(table):
    one = table.filter("size(refs) = 1").withColumn("reference", F.col("refs")[0])
    names = ["id", "keep", "delete", "add", "sari", "bleu", "ref_len", "hyp_len"]
    single = sorted(map(tuple, sentence_scores(one, ["id"]).select(*names).collect()))
    several = sorted(map(tuple, sentence_scores(one, ["id"], references="refs").select(*names).collect()))
    assert len(single) > 5
    for a, b in zip(single, several, strict=True):
        assert a == pytest.approx(b)


def test_one_shuffle(table):
    plan = sentence_scores(table, ["id"], references="refs")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_corpus_bleu_takes_the_first_of_equally_near_lengths(spark):
    hyp = "a b c d e f".split()
    # Lengths 8 and 4 are equally near: the first counts for the strict score, the shorter for the smoothed one.
    refs = ["a b c d e f g h".split(), "a b c d".split()]
    df = spark.createDataFrame([(1, hyp, hyp, refs)], "id int, origin array<string>, hypothesis array<string>, refs array<array<string>>")
    got = corpus_bleu(sentence_scores(df, ["id"], references="refs")).first()
    assert got.bleu_strict == pytest.approx(math.exp(1 - 8 / 6)) and got.bleu_smoothed == pytest.approx(1.0)


def test_meteor_takes_the_best_reference(spark):
    df = spark.createDataFrame(
        [(1, "the cat sat", ["a dog", "the cat sat down", None]), (2, "the cat", []), (3, "the cat", None), (4, None, ["x"])],
        "id int, h string, r array<string>",
    )
    got = {r.id: r.m for r in df.select("id", meteor(F.col("h"), F.col("r")).alias("m")).collect()}
    alone = spark.range(1).select(meteor(F.lit("the cat sat"), F.lit("the cat sat down")).alias("m")).first().m
    assert got == {1: alone, 2: 0.0, 3: 0.0, 4: 0.0} and alone > 0.5
