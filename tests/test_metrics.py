import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from twinline.functions.stem import stem
from twinline.functions.tokens import split_ws
from twinline.operators import epochs
from twinline.operators.meteor import meteor
from twinline.operators.ngram_metrics import corpus_bleu, gram_counts, sentence_scores
from twinline.operators.predict import batch_predict, lexical_substitution
from twinline.operators.split import rank_candidates

GOLDEN = [
    ("the cat sat on the mat", "the cat sat on the mat", "the cat sat on the mat", 1, 0, 0, 0.333333, 1.0),
    (
        "about 95 species are currently accepted .", "about 95 you now get in .", "about 95 species are currently known .",
        0.266667, 0.552381, 0, 0.273016, 0.145358,
    ),
    ("the the cat sat", "the cat sat", "the cat slept here", 0.366667, 0.583333, 0, 0.316667, 0.323730),
    ("a b c d", "", "a b", 0, 0.866667, 0, 0.288889, 0),
    ("the the the", "the", "", 0, 0.75, 0, 0.25, 0),
]


@pytest.fixture(scope="module")
def scores(spark):
    rows = spark.createDataFrame(
        [(i, *g[:3]) for i, g in enumerate(GOLDEN)], "id int, origin string, hypothesis string, reference string"
    )
    names = ("origin", "hypothesis", "reference")
    return sentence_scores(rows.select("id", *[split_ws(F.col(n)).alias(n) for n in names]), ["id"]).cache()


def test_golden_sari_and_bleu(scores):
    found = {r["id"]: r for r in scores.collect()}
    assert len(found) == len(GOLDEN)
    for i, (*_, keep, delete, add, sari, bleu) in enumerate(GOLDEN):
        got = found[i]
        for name, value in (("keep", keep), ("delete", delete), ("add", add), ("sari", sari), ("bleu", bleu)):
            assert got[name] == pytest.approx(value, abs=1e-6), (i, name)


def test_golden_corpus_bleu(scores):
    row = corpus_bleu(scores.filter("id < 3")).first()
    assert row["bleu_smoothed"] == pytest.approx(0.456022, abs=1e-6)
    assert row["bleu_strict"] == pytest.approx(0.471503, abs=1e-6)


def test_bleu_keeps_case_and_sari_does_not(spark):
    rows = spark.createDataFrame([(1, ["A", "b"], ["a", "B"], ["A", "b"])], "id int, origin array<string>, hypothesis array<string>, reference array<string>")
    row = sentence_scores(rows, ["id"]).first()
    assert row["bleu"] == 0 and row["keep"] == pytest.approx(0.5)


def test_sari_of_equal_long_texts_is_one_third(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").filter(F.size(split_ws(F.col("text"))) >= 4)
    t = split_ws(F.col("text"))
    rows = turns.select("conv_id", "turn", t.alias("origin"), t.alias("hypothesis"), t.alias("reference"))
    values = {round(r["sari"], 9) for r in sentence_scores(rows, ["conv_id", "turn"]).collect()}
    assert values == {round(1 / 3, 9)}


def test_gram_counts(spark):
    rows = spark.createDataFrame([(1, ["a", "b", "a"], ["A"])], "id int, x array<string>, y array<string>")
    found = {(r["n"], r["gram"]): (r["s"], r["r"]) for r in gram_counts(rows, ["id"], {"s": "x", "r": "y"}).collect()}
    assert found == {(1, "a"): (2, 1), (1, "b"): (1, 0), (2, "a b"): (1, 0), (2, "b a"): (1, 0), (3, "a b a"): (1, 0)}


def test_sentence_scores_shuffle_once(spark):
    rows = spark.createDataFrame([(1, ["a"], ["a"], ["a"])], "id int, origin array<string>, hypothesis array<string>, reference array<string>")
    plan = sentence_scores(rows, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


# ---------------------------------------------------------------- METEOR


def slow_meteor(hyp, ref, name):
    """Pairs by two loops from the end, as the metric is defined."""
    hyp, ref, pairs = list(enumerate(hyp)), list(enumerate(ref)), []
    n_hyp, n_ref = len(hyp), len(ref)
    for key in (lambda w: w, name):
        for i in range(len(hyp) - 1, -1, -1):
            for j in range(len(ref) - 1, -1, -1):
                if key(hyp[i][1]) == key(ref[j][1]):
                    pairs.append((hyp.pop(i)[0], ref.pop(j)[0]))
                    break
    if not pairs:
        return 0.0
    pairs.sort()
    chunks = 1 + sum(b != (a[0] + 1, a[1] + 1) for a, b in zip(pairs, pairs[1:]))
    p, r = len(pairs) / n_hyp, len(pairs) / n_ref
    return (1 - 0.5 * (chunks / len(pairs)) ** 3) * p * r / (0.9 * p + 0.1 * r)


def test_meteor(spark, sf_dir):
    pairs = [
        ("It is a guide to action which ensures that the military always obeys the commands of the party",
         "It is a guide to action that ensures that the military will forever heed Party commands"),
        ("running dogs jumped", "The dog runs and jumps"), ("", "a"), ("a", ""), ("b a b a a", "a b a a b a"),
        ("the the the", "the cat"),
    ]
    texts = [r[0] for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("text").collect()]
    pairs += list(zip(texts, texts[1:]))
    rows = spark.createDataFrame(pairs, "h string, r string").select("h", "r", meteor(F.col("h"), F.col("r")).alias("m"))
    for h, r, m in rows.collect():
        assert m == pytest.approx(slow_meteor(h.lower().split(), r.lower().split(), stem))


def test_meteor_synonyms(spark):
    table = spark.createDataFrame([("big", "large")], "word string, synonym string")
    rows = spark.createDataFrame([("a big dog", "a large dog")], "h string, r string")
    with_table = rows.select(meteor(F.col("h"), F.col("r"), synonyms=table)).first()[0]
    assert with_table == pytest.approx(1 - 0.5 / 27) and rows.select(meteor(F.col("h"), F.col("r"))).first()[0] < with_table


@pytest.mark.parametrize(
    "word, expected",
    [
        ("caresses", "caress"), ("ponies", "poni"), ("ties", "tie"), ("cats", "cat"), ("agreed", "agre"), ("plastered", "plaster"),
        ("motoring", "motor"), ("conflated", "conflat"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"),
        ("happy", "happi"), ("sky", "sky"), ("enjoy", "enjoy"), ("relational", "relat"), ("conditional", "condit"),
        ("digitizer", "digit"), ("operator", "oper"), ("hopefulness", "hope"), ("electrical", "electr"), ("adoption", "adopt"),
        ("probate", "probat"), ("rate", "rate"), ("controll", "control"), ("dying", "die"), ("died", "die"), ("spied", "spi"),
        ("generalizations", "gener"), ("by", "by"), ("apology", "apolog"),
    ],
)
def test_stem(word, expected):
    assert stem(word) == expected


# ---------------------------------------------------------------- logs, ranking, prediction


def test_token_accuracy_leaves_padding_out(spark):
    rows = spark.createDataFrame([([1, 2, 0, 0], [1, 3, 0, 4]), ([0], [0])], "p array<int>, t array<int>")
    assert epochs.token_accuracy(rows, "p", "t").first().asDict() == {"correct": 1, "total": 3}


def test_epoch_metrics_and_best(spark):
    log = spark.createDataFrame(
        [(1, "valid", 2.0, 2, 1), (1, "valid", 1.0, 1, 1), (2, "valid", 4.0, 4, 0), (3, "train", 0.0, 1, 1)],
        "epoch int, mode string, loss double, count int, correct int",
    )
    metrics = epochs.epoch_metrics(log)
    found = {(r["epoch"], r["mode"]): r for r in metrics.collect()}
    assert found[1, "valid"]["perplexity"] == pytest.approx(math.e) and found[1, "valid"]["accuracy"] == pytest.approx(2 / 3)
    # Equal perplexities: the earlier epoch.
    assert epochs.best_epoch(metrics).first()["epoch"] == 1


def test_rank_candidates(spark):
    rows = [(s, c, -float((s * 7 + c * 13) % 11), 1 + (c % 5)) for s in range(3) for c in range(40)]
    df = spark.createDataFrame(rows, "source_id int, candidate int, logp double, length int")
    formulas = {"length_power": lambda p, n: p / n**0.7, "mean": lambda p, n: p / (n - 1 + 1e-6), "raw": lambda p, n: p}
    for score, formula in formulas.items():
        found = rank_candidates(df, 3, score=score)
        expected = set()
        for s in range(3):
            best = sorted(((-formula(p, n), c) for q, c, p, n in rows if q == s))[:3]
            expected |= {(s, c, i + 1) for i, (_, c) in enumerate(best)}
        assert {(r["source_id"], r["candidate"], r["rank"]) for r in found.collect()} == expected
    plan = rank_candidates(df, 3)._jdf.queryExecution().executedPlan().toString()
    # Every task keeps its own best rows before the shuffle.
    assert plan.count("WindowGroupLimit") == 2


def test_batch_predict_several_candidates(spark):
    def factory():
        return lambda texts: [[t, t.upper(), t * 2][: len(t)] for t in texts]

    rows = spark.createDataFrame([(1, "ab"), (2, None), (3, "xyz")], "id int, text string")
    found = {(r["id"], r["candidate"], r["hypothesis"]) for r in batch_predict(rows, "text", factory, k=2).collect()}
    assert found == {(1, 1, "ab"), (1, 2, "AB"), (3, 1, "xyz"), (3, 2, "XYZ")}


def test_lexical_substitution_both_ways(spark):
    rows = spark.createDataFrame([(1, "use the utilise word"), (2, ""), (3, "utilise")], "id int, text string")
    lexicon = spark.createDataFrame([("utilise", "use")], "word string, simple string")
    for small in (True, False):
        found = lexical_substitution(rows, "text", lexicon, ["id"], small=small)
        assert {r["id"]: r["hypothesis"] for r in found.collect()} == {1: "use the use word", 2: "", 3: "use"}


def test_counter_form_of_sari_agrees(spark, sf_dir):
    """SARI from bags of grams, one sentence at a time."""

    def f1(p, r):
        return 2 * p * r / (p + r) if p + r else 0.0

    def mean(values, n):
        return sum(values) / n if n else 0.0

    def sari(s, c, r):
        total = 0.0
        for n in range(1, 5):
            S, C, R = (Counter(tuple(t[i : i + n]) for i in range(len(t) - n + 1)) for t in (s, c, r))
            keep, drop = S & C, S - C
            good, bad = keep & R, drop - R
            p = [bad[g] / drop[g] for g in bad]
            total += f1(mean([good[g] / keep[g] for g in good], len(keep)), mean([good[g] / (S & R)[g] for g in good], len(S & R)))
            total += f1(mean(p, len(drop)), mean(p, len(S - R)))
            new, wanted = set(C) - set(S), set(R) - set(S)
            total += f1(mean([1] * len(new & set(R)), len(new)), mean([1] * len(new & set(R)), len(wanted)))
        return total / 12

    from twinline.catalog.tables import token_triples

    rows = token_triples(spark, sf_dir)
    found = sentence_scores(rows, ["conv_id", "turn"], bleu=False).join(rows, ["conv_id", "turn"]).collect()
    for r in found:
        lists = ([t.lower() for t in r[n]] for n in ("origin", "hypothesis", "reference"))
        assert r["sari"] == pytest.approx(sari(*lists))


def test_scored_predict_keeps_the_best(spark):
    from twinline.operators.predict import scored_predict
    from twinline.operators.split import rank_candidates

    def beam():
        # Thousands of candidates per text, with ties.
        return lambda texts: [((f"{t}-{i}", -float(i * 7919 % 101), 1 + i % 5) for i in range(5000 * (t != "none"))) for t in texts]

    df = spark.createDataFrame([(1, "a"), (2, "none"), (3, None), (4, "b")], "id int, t string")
    for score in ("length_power", "mean", "raw"):
        got = sorted(map(tuple, scored_predict(df, "t", beam, 3, score).select("id", "rank", "hypothesis").collect()))
        every = [(i, f"{t}-{n}", n, -float(n * 7919 % 101), 1 + n % 5) for i, t in ((1, "a"), (3, ""), (4, "b")) for n in range(5000)]
        flat = spark.createDataFrame(every, "id int, hypothesis string, candidate int, logp double, length int")
        want = rank_candidates(flat, 3, source="id", score=score)
        assert got == sorted((r.id, r["rank"], r.hypothesis) for r in want.collect())
    plan = scored_predict(df, "t", beam, 3)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert scored_predict(df.limit(0), "t", beam).count() == 0


@pytest.mark.parametrize("several", [False, True])
def test_grams_never_become_rows(spark, several):
    rows = spark.createDataFrame([(1, ["a"], ["a"], ["a"])], "id int, origin array<string>, hypothesis array<string>, reference array<string>")
    if several:
        scores = sentence_scores(rows.withColumn("references", F.array("reference")), ["id"], references="references")
    else:
        scores = sentence_scores(rows, ["id"])
    plan = scores._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Expand" not in plan


def test_slices_repeated_keys_and_missing_tokens(spark, monkeypatch):
    rng = random.Random(3)
    words = ["a", "B", "b", "c c", "", None]
    made = [(i, *[rng.choices(words, k=rng.randrange(9)) for _ in range(3)]) for i in range(60)]
    schema = "id int, origin array<string>, hypothesis array<string>, reference array<string>"
    rows = spark.createDataFrame(made + [(None, None, None, None), (60, None, ["a"], ["a"])], schema)
    whole = sorted(sentence_scores(rows, ["id"]).collect(), key=str)
    monkeypatch.setattr("twinline.operators.ngram_metrics.SLICE_TOKENS", 7)
    assert sorted(sentence_scores(rows, ["id"], unique=True).collect(), key=str) == whole
    # Rows of one key are counted together: twice the same row has the shares of one.
    twice = {r["id"]: r for r in sentence_scores(rows.unionByName(rows), ["id"]).collect()}
    for r in whole:
        assert twice[r["id"]]["total_1"] == 2 * r["total_1"] and twice[r["id"]]["clip_2"] == 2 * r["clip_2"]
        assert twice[r["id"]]["keep"] == pytest.approx(r["keep"])
    by_id = {r["id"]: r for r in whole}
    assert by_id[60]["total_1"] == 1 and by_id[60]["sari"] == pytest.approx(by_id[60]["add"] / 3)
    # Grams are told apart as joined texts, a gram with a missing token is one of its own.
    one = spark.createDataFrame([(1, ["x"], ["a", "b c", None], ["a b", "c", None])], schema)
    row = sentence_scores(one, ["id"]).first()
    assert [row[f"clip_{n}"] for n in range(1, 5)] == [1, 2, 1, 0]
