"""Evaluation in rounds: what counts is in the manifest."""

import pytest

from twinline.functions.wordpiece import WordPiece
from twinline.operators.predict import identity
from twinline.plans.evaluate import Rounds, evaluate_rounds

WORDS = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "a", "b", "c", "d", "e", "."]


@pytest.fixture(scope="module")
def pieces(spark):
    return WordPiece(spark.createDataFrame([(w, i) for i, w in enumerate(WORDS)], "token string, index int"))


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame([(0, "a b c d", "a b c"), (1, "e d c .", "e d c ."), (2, "b", "a")], "row_id long, input string, output string")


def test_a_lost_job_goes_on_at_its_round(spark, pieces, pairs, tmp_path):
    def lost():
        raise RuntimeError("lost")

    def without_last():
        return lambda texts: [[" ".join(t.split()[:-2] + t.split()[-1:])] for t in texts]

    folder = str(tmp_path / "rounds")
    with pytest.raises(Exception, match="lost"):
        evaluate_rounds(pairs, pieces, [identity, lost, without_last], folder)
    first = Rounds(spark, folder).paths()
    assert list(first) == [0]
    rounds = evaluate_rounds(pairs, pieces, [lost, without_last, identity], folder)
    paths = rounds.paths()
    assert list(paths) == [0, 1, 2] and paths[0] == first[0]
    corpus = {r["round"]: r for r in rounds.corpus.collect()}
    # The third round predicts what the first does.
    names = ("bleu_smoothed", "bleu_strict", "sari", "meteor")
    assert [corpus[0][n] for n in names] == pytest.approx([corpus[2][n] for n in names])
    best = rounds.best.first()
    assert best["best_bleu"] == max(r["bleu_smoothed"] for r in corpus.values())
    assert best["best_sari"] == max(r["sari"] for r in corpus.values())
    assert sorted((r["round"], r["row_id"]) for r in rounds.sentences.collect()) == [(n, i) for n in range(3) for i in range(3)]
    for row in rounds.manifest.collect():
        lines = [r[0].split("\t") for r in spark.read.text(row["lines"]).collect()]
        assert len(lines) == 3 and all(len(fields) == 6 and fields[4] == "|" for fields in lines)


def test_scores_outside_of_the_manifest_are_not_read(spark, pieces, pairs, tmp_path):
    folder = str(tmp_path / "rounds")
    rounds = evaluate_rounds(pairs, pieces, [identity], folder)
    rounds.sentences.drop("round").write.parquet(f"{folder}/scores/round-1-left-behind")
    again = Rounds(spark, folder)
    assert list(again.paths()) == [0]
    # Of a round that is committed twice one commit counts.
    again.commit(0, rounds.sentences.drop("round"))
    assert again.sentences.count() == 3
