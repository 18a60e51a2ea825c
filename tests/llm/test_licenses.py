import re

from pyspark.sql import functions as F

from twinline.llm import licenses
from twinline.llm.licenses import scan, train


def test_families_and_clean_text(spark, sf_dir, make_text, odd_docs, no_docs):
    background = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(background)
    cases = {
        1: ("Released under the MIT License.", "mit"),
        2: ("Licensed under the Apache License, Version 2.0.", "apache-2.0"),
        3: ("This work is licensed under the GNU General Public License, version 3.", "gpl"),
        4: ("Licensed under CC BY-NC 4.0.", "cc-by-nc"),
        5: ("All rights reserved.", "all-rights-reserved"),
        6: ("Note: this project is licensed under the terms of the MIT license (see below).", "mit"),
    }
    rows = [(k, make_text(k, 30) + "\n" + text + "\n" + make_text(k + 50, 30)) for k, (text, _) in cases.items()]
    rows += [(20 + i, make_text(200 + i, 80)) for i in range(20)] + [(50, "Licensed under the Foo Bar Community Agreement 7.")]
    got = scan(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    found = {r.doc_id: (r.place, r.family) for r in got if r.confirmed}
    assert found == {k: (1, family) for k, (_, family) in cases.items()}
    assert all(r.family == "unknown" for r in got if not r.confirmed)
    assert not any(20 <= r.doc_id < 50 for r in got)
    plan = scan(odd_docs, model)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan
    assert scan(odd_docs, model).count() == 0 and scan(no_docs, model).count() == 0


def test_every_word_of_the_templates_is_looked_for(spark, sf_dir, monkeypatch):
    words = [f"zq{i:03d}" for i in range(450)]
    notices = [" ".join(words[i : i + 30]) for i in range(0, len(words), 30)]
    monkeypatch.setitem(licenses.TEMPLATES, "mit", [*licenses.TEMPLATES["mit"], *notices])
    assert set(words) <= set(train(spark.read.parquet(f"{sf_dir}/documents.parquet")).anchors)


def test_paragraph_of_common_words_is_scored(spark, make_text):
    notice = (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met"
    )
    words = notice.replace(",", "").split(" ")
    # Every word of the notice stands in lines of the background too, always between other words.
    lines = [make_text(3 * i, 8) + f" {words[i % len(words)]} " + make_text(3 * i + 1, 8) for i in range(400)]
    docs = spark.createDataFrame([(i, line) for i, line in enumerate(lines)] + [(1000, "Some title\n" + notice)], "doc_id long, text string")
    got = scan(docs).filter("confirmed").select("doc_id", "place", "family").collect()
    assert [tuple(r) for r in got] == [(1000, 1, "bsd")]


def test_scan_finds_what_scores_of_all_paragraphs_say(spark, sf_dir, make_text):
    background = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(background)
    notices = [text for texts in licenses.TEMPLATES.values() for text in texts]
    cut = [" ".join(t.split(" ")[k : k + 5]) for t in notices for k in range(0, len(t.split(" ")), 2)]
    mixed = [make_text(i, 3) + " " + t.upper() + " " + make_text(i + 1, i % 30) for i, t in enumerate(cut)]
    rows = [(i, t) for i, t in enumerate(cut + mixed + ["the of to a and", "-", "  ", "", None])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(background.select("doc_id", "text").limit(200))
    lines = licenses.paragraphs(docs)
    grams = licenses.grams_of(licenses.words_of(F.col("paragraph")))
    judged = licenses._probabilities(lines.withColumn("grams", grams).distinct(), model).filter(F.col("family") != licenses.NONE)
    want = sorted((r.doc_id, r.place, round(r.probability, 5)) for r in judged.collect())
    got = sorted((r.doc_id, r.place, round(r.probability, 5)) for r in scan(docs, model).collect())
    assert [g[:2] for g in got] == [w[:2] for w in want] and len(got) > 50
    assert all(abs(g[2] - w[2]) < 1e-4 for g, w in zip(got, want))


def test_grams_are_the_distinct_runs(spark):
    texts = ["", "One", "a b", "a b a b c", "x " * 40, "Licensed under GPL-3.0, or later versions; under GPL-3.0"]
    docs = spark.createDataFrame([(t,) for t in texts], "t string")
    for row in docs.select("t", licenses.grams_of(licenses.words_of(F.col("t"))).alias("g")).collect():
        words = re.findall("[a-z0-9]+(?:[.-][a-z0-9]+)*", row.t.lower())
        runs = [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
        assert row.g == list(dict.fromkeys(runs))
