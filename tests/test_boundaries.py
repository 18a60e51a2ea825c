import re

import pytest
from pyspark.sql import functions as F

from twinline.functions.tokens import sentence_split
from twinline.operators.boundaries import learn_boundaries

NAMES = ["Miller", "Brown", "Keller", "Young", "Stone", "Field", "Marsh", "Wood"]


def texts():
    """Texts with abbreviations at known places; each sentence is one item of a list."""
    out = []
    for i in range(400):
        name, other = NAMES[i % 8], NAMES[(i * 3 + 1) % 8]
        out.append(
            [
                f"The old house of Dr. {name} stood on hill number {i}.",
                f"It was sold by Mrs. {other} for some e.g. small reasons and the town was glad!",
                f"We met Prof. {name} and went to river {other.lower()}{i}.",
                f"The matter was closed (see {name} etc.) in the year {i}.",
            ]
        )
    return out


@pytest.fixture(scope="module")
def learned(spark):
    rows = [(i, " ".join(s)) for i, s in enumerate(texts())] + [(900, None), (901, ""), (902, " . ! ")]
    df = spark.createDataFrame(rows, "id long, text string").repartition(3)
    return df, learn_boundaries(df)


def test_planted_abbreviations_are_learned(learned):
    _, found = learned
    assert {"dr", "mrs", "e.g"} <= {r.word for r in found.abbreviations.collect()}
    assert not {"house", "was", "the", "of"} & {r.word for r in found.abbreviations.collect()}
    assert {"the", "it", "we"} <= {r.word for r in found.starters.collect()}


def test_better_than_the_rule(learned):
    df, found = learned
    rows = df.select("id", found.sentences(F.col("text")).alias("s"), sentence_split(F.col("text")).alias("rule")).collect()
    want = dict(enumerate(texts()))
    right = {name: sum(r[name] == want[r.id] for r in rows if r.id in want) for name in ("s", "rule")}
    assert right["rule"] == 0 and right["s"] == 400


def test_starters_after_abbreviations_cut(spark, learned):
    _, found = learned
    text = 'He saw Dr. The end came.\nShe left "at" e.g. noon.  Dr. Miller said  so?) We went.'
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(found.sentences(F.col("t"))).first()[0] == [
        "He saw Dr.", "The end came.", 'She left "at" e.g. noon.', "Dr. Miller said  so?)", "We went.",
    ]


def test_odd_texts(spark, learned):
    df, found = learned
    got = {r.id: r.s for r in df.filter("id >= 900").select("id", found.sentences(F.col("text")).alias("s")).collect()}
    assert got == {900: None, 901: [], 902: [".", "!"]}
    none = learn_boundaries(spark.createDataFrame([], "text string"))
    assert none.abbreviations.count() == 0 and none.starters.count() == 0
    assert spark.createDataFrame([("Dr. No. Yes",)], "t string").select(none.sentences(F.col("t"))).first()[0] == ["Dr.", "No.", "Yes"]
    blank = learn_boundaries(spark.createDataFrame([(None,), ("",), (" \n",)], "text string"))
    assert blank.short == [] and blank.heads == []


def test_nothing_of_a_text_is_lost(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = learn_boundaries(docs)
    for text, parts in docs.select("text", found.sentences(F.col("text")).alias("s")).collect():
        assert re.sub(r"\s+", "", "".join(parts or [])) == re.sub(r"\s+", "", text or "")


def test_words_as_a_set_cut_like_words_of_the_text(spark, learned):
    learned = learned[1]
    import random

    rng = random.Random(5)
    words = [*learned.short[:3], "Dr", "The", "the", "x.y", "end", *[h.capitalize() for h in learned.heads[:3]]]
    glue = [". ", ".  ", ".\n", '." ', "! ", " ", ".\u00a0", "\x1c", ". ("]
    texts = ["".join(rng.choice(words) + rng.choice(glue[: 6 if k % 2 else 9]) for _ in range(9)) for k in range(600)] + ["", None]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    both = rows.select(learned.sentences(F.col("text")).alias("a"), learned._cut(F.col("text"), False).alias("b"))
    assert both.filter("not (a <=> b)").limit(3).collect() == []
