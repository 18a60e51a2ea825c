import unicodedata

import pytest
from pyspark.sql import functions as F

from twinline.functions import clean


def one(spark, text, expression):
    return spark.createDataFrame([(text,)], "t string").select(expression(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    "text, lowered, cased",
    [
        (
            "The U.S. GDP (est.) rose 3.14%, e.g. a lot!",
            "the u .s . gdp rose 3 .14%, e .g . a lot !",
            "The U .S . GDP est . rose 3 .14%, e .g . a lot !",
        ),
        ("Café [x (y) z] naïve", "cafe z naive", "Cafe x y z naive"),
        ("About 45 -> 50", "about 45 50", "About 45 50"),
        ("rivaroxaban vs. placebo (n=20).", "rivaroxaban vs . placebo .", "rivaroxaban vs . placebo n 20 ."),
    ],
)
def test_normalize(spark, text, lowered, cased):
    assert one(spark, text, clean.normalize_sentence) == lowered
    assert one(spark, text, lambda c: clean.normalize_sentence(c, False, False)) == cased


@pytest.mark.parametrize(
    "text, result",
    [
        ("x ca. 5", "x ca  5"), ("x e.g. a", "x e g  a"), ("x eg. a", "x e g a"), ("x no. V1", "x no  V1"),
        ("x b.i.3. a", "x b i d  a"), ("ca. 5", "ca. 5"), ("x J. Cell", "x J  Cell"), ("x\ty", "x y"),
    ],
)
def test_prenormalize(spark, text, result):
    assert one(spark, text, clean.prenormalize) == result


CLASSES = {
    "erlotinib": "_chemical_", "the drug erlotinib": "_chemical_", "->": "_replacement_", "p<0.05": "_p_val_",
    "45-year-old": "_age_", "y.o.": "_age_", "3-5": "_range_", "a <5": "_ineq_", "3-fold": "_n_fold_", "1/2": "_ratio_",
    "12:30": "_ratio_", "50%": "_percent_", "5mg": "_unit_", "mol": "_unit_", "rs123": "_mutation_", "R5a": "_mutation_",
    "V123": "_abbrev_", "Jan.": "_month_", "1999": "_year_", "twenty": "_num_", "1,000": "_num_", "3.14": "_num_",
    "Versus": "vs", "p.o.": "po", "in 1999": "in 1999", "5 mg": "5 mg", "twenty one": "twenty one",
}


def test_concept_class(spark):
    rows = spark.createDataFrame([(t,) for t in CLASSES], "t string")
    found = {r[0]: r[1] for r in rows.select("t", clean.concept_class(F.col("t"))).collect()}
    assert found == CLASSES


def test_normalize_is_stable_on_plain_text(spark):
    texts = [("a b, c",), ("x 1% y",), ("",)]
    rows = spark.createDataFrame(texts, "t string").select("t", clean.normalize_sentence(F.col("t")).alias("n"))
    assert all(r["t"] == r["n"] for r in rows.collect())


def test_strip_accents(spark):
    texts = ["Àé ñ ü Ώ ά й", "é", "한국", "plain", "ﬁ Å K"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    exact = [r[0] for r in rows.select(clean.strip_accents_exact("t")).collect()]
    assert exact == ["".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn") for t in texts]
    native = [r[0] for r in rows.select(clean.strip_accents(F.col("t"))).collect()]
    # Syllables that come apart into several characters stay composed in the native form.
    assert [n for n, t in zip(native, texts) if t != "한국"] == [e for e, t in zip(exact, texts) if t != "한국"]


def test_brackets_stop_at_line_breaks(spark):
    assert one(spark, "a (b\nc) d (e\rf) g", clean.remove_brackets) == "a (b\nc) d  g"


def test_strip_takes_all_white_space(spark):
    assert one(spark, " \x1f a b  \n", clean.strip) == "a b"


def test_rules_together_equal_rules_one_by_one(spark):
    import random

    from pyspark.sql import functions as F

    from twinline.functions import clean

    rng = random.Random(3)
    short = ["ca.", "Ca.", "e.g.", "e.G.", "E.g.", "eg.", "i.e.", "Ie.", "approx.", "no.", "No.", "conf.", "et al.", "Fig.", "ref.", "y.o.", "yo.",
             "p.o.", "P.o.", "i.v.", "b.i.3.", "T.i.3.", "q.i.\u0663.", "J.", "x", "7", "A7", "Cell", "Bio", ".", "z.", "\U0001d400", "\u00e9"]
    ends = [" ", " ", " ", "", "\n", "\u00a0", "\u2028", "\x1c", "  ", "("]
    texts = ["".join(rng.choice(short) + rng.choice(ends) for _ in range(rng.randrange(1, 9))) for _ in range(3000)]
    texts += [t.lower() for t in texts] + [chr(c) + "a" for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    plain = F.col("text")
    for first, following, replacement in clean.PRENORMALIZE:
        plain = F.regexp_replace(plain, rf"(?U)(?<=\W){first}[\s\x1c-\x1f](?={following})", replacement)
    plain = F.regexp_replace(plain, r"(?U)[\s\x1c-\x1f]", " ")
    rows = rows.withColumn("fast", ~F.col("text").rlike(clean._CAPITAL))
    found = rows.select("text", "fast", clean.prenormalize(F.col("text")).alias("a"), plain.alias("b"))
    assert found.filter("a <> b").limit(5).collect() == []
    assert found.filter("fast and a <> text").count() > 500 and found.filter("not fast").count() > 500
