import json
import os

import pytest
from pyspark.sql import functions as F

from twinline import sinks, sources
from twinline.functions.wordpiece import WordPiece
from twinline.operators import filters, joins, profile, split
from twinline.operators.position import number_scan, prefix_sum, text_score
from twinline.operators.sets import distinct_rows
from twinline.operators.skew import lookup
from twinline.operators.vocab import vocab_by_first_seen, vocab_by_frequency
from twinline.plans.evaluate import evaluate
from twinline.plans.prepare import CleanRules, prepare, prepare_aligned, prepare_presplit
from twinline.plans.splits import split_wiki, write_splits
from twinline.operators.predict import identity


def rows_of(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


# ---------------------------------------------------------------- positions and skew


@pytest.mark.parametrize("buckets", [1, 3, 50])
def test_prefix_sum(spark, buckets):
    data = [(g, (i * 37) % 101, (i * 7) % 5) for g in "ab" for i in range(101)]
    df = spark.createDataFrame(data, "g string, k int, w int").repartition(7)
    found = prefix_sum(df, ["k"], F.col("k"), F.col("w"), ["g"], "off", "total", buckets)
    for row in found.collect():
        assert row["off"] == sum(w for g, k, w in data if g == row["g"] and k < row["k"])
        assert row["total"] == sum(w for g, _, w in data if g == row["g"])


def test_prefix_sum_of_nothing_and_one_hot_value(spark):
    empty = spark.createDataFrame([], "k int")
    assert prefix_sum(empty, ["k"], F.col("k")).count() == 0
    hot = spark.range(1000).select(F.col("id"), F.lit(1).alias("same"))
    found = prefix_sum(hot, ["same", "id"], F.col("same") + F.col("id") / 10000, name="n")
    assert all(r["id"] == r["n"] for r in found.collect())


def test_bounds_from_a_sample_change_nothing(spark, monkeypatch):
    from twinline.operators import position

    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("k"))
    monkeypatch.setattr(position, "SAMPLE", 5)
    found = prefix_sum(df, ["k"], F.col("k"), name="n", buckets=20).collect()
    places = {k: i for i, k in enumerate(sorted(r["k"] for r in found))}
    assert len(places) == 5000 and all(places[r["k"]] == r["n"] for r in found)


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    from twinline.catalog import QUERIES

    plan = QUERIES["fil_07_select_language"](spark, sf_dir).drop("text")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(lang,en)" in text and "ReadSchema: struct<doc_id:bigint,lang:string>" in text


def test_text_score_follows_text_order(spark):
    words = ["", "a", "aa", "ab", "abcdefg", "b", "é", "中", "\U0001f600", "Z", "~"]
    found = spark.createDataFrame([(w,) for w in words], "w string").select("w", text_score(F.col("w")).alias("s")).collect()
    scores = [r["s"] for r in sorted(found, key=lambda r: r["w"].encode())]
    assert scores == sorted(scores)


def test_number_scan_over_many_splits_and_files(spark, tmp_path):
    lines = [f"line {i} " + "x" * (i % 50) for i in range(3000)]
    os.makedirs(tmp_path / "in")
    for part, low in enumerate(range(0, 3000, 1000)):
        (tmp_path / "in" / f"part-{part}.txt").write_text("\n".join(lines[low : low + 1000]) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        scan = spark.read.text(str(tmp_path / "in"))
        assert scan.rdd.getNumPartitions() > 10
        assert rows_of(number_scan(scan), "row_id", "value") == list(enumerate(lines))
        shards = sources.read_text_shards(spark, str(tmp_path / "in" / "*.txt"))
        assert shards.groupBy("shard").agg(F.max("line").alias("m"), F.countDistinct("line").alias("c")).filter(
            "m <> 999 OR c <> 1000"
        ).count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_lookup_broadcast_and_salted_agree(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(200)] + [(900, None)], "id int, k string")
    table = spark.createDataFrame([("hot", 1), ("k3", 2), (None, 9)], "k string, v int")
    for null_safe in (False, True):
        small, salted = (
            rows_of(lookup(rows, table, [("k", "k")], "left", F.col("id"), null_safe, small=s).fillna(-1), "id", "v")
            for s in (True, False)
        )
        assert small == salted and len(small) == 201
        assert dict(small)[900] == (9 if null_safe else -1)


# ---------------------------------------------------------------- filters and joins


def test_filters_keep_missing_values(spark):
    df = spark.createDataFrame(
        [(1, "V0", "V1", "a", "b"), (2, "V3", "V4", "a", "b"), (3, None, "V1", "a", None), (4, "V0", "V2", "[CLS] [SEP]", "b")],
        "row_id int, docv_input string, docv_output string, input string, output string",
    )
    assert rows_of(filters.drop_adjacent_versions(df), "row_id") == [(2,), (3,), (4,)]
    assert rows_of(filters.drop_empty_pairs(df), "row_id") == [(1,), (2,), (3,)]


@pytest.mark.parametrize("small", [True, False])
def test_exclude_overlap_tests_columns_on_their_own(spark, small):
    wiki = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, "a", "q"), (4, None, "x"), (5, "z", "x"), (6, "a", "y")], "row_id int, input string, output string")
    health = spark.createDataFrame([("a", "x"), ("b", "w"), (None, "y")], "input string, output string")
    # Rows 2, 4 and 6 match both columns through different rows.
    assert rows_of(joins.exclude_overlap(wiki, health, is_broadcast=small), "row_id") == [(3,), (5,)]


def test_zips(spark):
    left = spark.createDataFrame([(0, "a"), (1, "b")], "row_id long, input string")
    right = spark.createDataFrame([(0, "x")], "row_id long, output string")
    assert joins.zip_outer(left, right).count() == 2 and joins.zip_inner(left, right).count() == 1


def test_last_per_group_takes_the_last_value_that_is_there(spark):
    df = spark.createDataFrame(
        [("d", "i", "x", 1, "p"), ("d", "i", None, 2, "q"), ("d", None, "z", 3, "r"), ("e", "i", None, 4, None)],
        "doc_id string, input string, output string, row_id int, other string",
    )
    found = split.last_per_group(df, ["doc_id", "input"])
    assert {tuple(r) for r in found.collect()} == {("d", "i", "x", 2, "q"), ("e", "i", None, 4, None)}


# ---------------------------------------------------------------- splits


def test_document_split_keeps_documents_whole(spark, sf_dir):
    from twinline.catalog.tables import aligned

    rows = aligned(spark, sf_dir)
    plain = split.document_split(rows, 8, 4)
    by_doc = plain.groupBy("doc_id").agg(F.countDistinct("split").alias("n"))
    assert by_doc.filter("n > 1").count() == 0
    sizes = {r["split"]: r["n"] for r in plain.groupBy("split").agg(F.countDistinct("doc_id").alias("n")).collect()}
    assert sizes["train"] == 8 and sizes["valid"] == 4
    first = [r["doc_id"] for r in rows.groupBy("doc_id").agg(F.min("row_id").alias("f")).orderBy("f").limit(12).collect()]
    splits = dict(rows_of(plain.select("doc_id", "split").distinct(), "doc_id", "split"))
    assert [splits[d] for d in first] == ["train"] * 8 + ["valid"] * 4


def test_random_split_is_fixed_by_its_seed(spark):
    rows = spark.range(500).select(F.col("id").alias("row_id"), F.lit("x").alias("input"))
    one, two, other = (rows_of(split.random_split(rows.repartition(n), 50, 30, seed=s), "row_id", "split") for n, s in ((3, 1), (9, 1), (3, 2)))
    assert one == two and one != other
    assert [sum(s == name for _, s in one) for name in ("test", "valid", "train")] == [50, 30, 420]
    ordered = dict(rows_of(split.random_split(rows, 5, 3, shuffle=False), "row_id", "split"))
    assert [i for i in range(500) if ordered[i] == "test"] == [0, 1, 2, 3, 4]


def test_shuffle_and_buckets(spark):
    rows = spark.range(300).select(F.col("id").alias("row_id"), (F.col("id") % 7 + 1).alias("len"))
    places = rows_of(split.shuffle_rows(rows, seed=4), "position", "row_id")
    assert [p for p, _ in places] == list(range(300)) and [i for _, i in places] != list(range(300))
    batches = split.length_buckets(rows, "len", 6).collect()
    expected = {r: i // 6 for i, (_, r) in enumerate(sorted((i % 7 + 1, i) for i in range(300)))}
    assert {r["row_id"]: r["batch"] for r in batches} == expected


def test_split_wiki_has_no_leak(spark, sf_dir):
    from twinline.catalog.tables import health, wiki

    table = split_wiki(health(spark, sf_dir), wiki(spark, sf_dir), 5, 3, seed=2)
    train = table.filter("split = 'train'")
    held = table.filter("split <> 'train'")
    assert held.count() == 8 and train.join(held, ["input", "output"]).count() == 0


# ---------------------------------------------------------------- vocabularies


def test_vocabularies(spark):
    df = spark.createDataFrame([(2, ["b", "A", "b"]), (1, ["c", "a"]), (3, ["a", "<eos>"])], "row_id int, t array<string>")
    first = rows_of(vocab_by_first_seen(df, "t"), "index", "token", "count")
    assert first == [(0, "c", 1), (1, "a", 2), (2, "b", 2), (3, "A", 1), (4, "<eos>", 1)]
    frequent = rows_of(vocab_by_frequency(df, "t"), "index", "token", "count")
    assert frequent == [(0, "<unk>", 0), (1, "<pad>", 0), (2, "<sos>", 0), (3, "<eos>", 0), (4, "a", 3), (5, "b", 2)]


# ---------------------------------------------------------------- files


AWKWARD = [("d1", "V0", "V2", 'say "hi"\tnow', "two\nlines"), ("d1", "V0", "V3", "NA", " padded "), ("d2", None, "V1", "x,y", "")]


def test_tables_round_trip(spark, tmp_path):
    df = spark.createDataFrame(AWKWARD, "doc_id string, docv_input string, docv_output string, input string, output string").coalesce(1)
    sinks.write_headerless(df, str(tmp_path / "raw"))
    back = sources.read_aligned_pairs(spark, str(tmp_path / "raw"))
    expected = [(i, *[None if v in ("NA", "") else v for v in row]) for i, row in enumerate(AWKWARD)]
    assert [tuple(r[n] for n in ("row_id", *df.columns)) for r in back.orderBy("row_id").collect()] == expected
    sinks.write_prepared(df, str(tmp_path / "prepared"))
    assert sources.read_prepared_aligned(spark, str(tmp_path / "prepared")).count() == 3


def test_python_csv_is_read_as_written(spark, tmp_path):
    pandas = pytest.importorskip("pandas")
    frame = pandas.DataFrame([r[3:] for r in AWKWARD] + [("a", "b"), ("a", "b")], columns=["input", "output"])
    frame.to_csv(tmp_path / "p.tsv", sep="\t", index=False)
    expected = pandas.read_csv(tmp_path / "p.tsv", sep="\t").drop_duplicates()
    found = sources.read_prepared_pairs(spark, str(tmp_path / "p.tsv")).orderBy("row_id").collect()
    missing = [tuple(None if pandas.isna(v) else v for v in row) for row in expected.itertuples(index=False)]
    assert [(r["input"], r["output"]) for r in found] == missing
    frame.assign(matching="0.9").to_csv(tmp_path / "s.tsv", sep="\t", index=False, header=False)
    scored = sources.read_scored_pairs(spark, str(tmp_path / "s.tsv"))
    assert scored.columns == ["input", "output", "row_id"] and scored.count() == 5


def test_parallel_files(spark, tmp_path):
    (tmp_path / "t.src").write_text("one\n two \n\nfour\nfive\n")
    (tmp_path / "t.dst").write_text("eins\nzwei\ndrei\n\n")
    src, dst = str(tmp_path / "t.src"), str(tmp_path / "t.dst")
    assert rows_of(sources.read_parallel_lines(spark, src, dst), "row_id", "input", "output") == [(0, "one", "eins"), (1, "two", "zwei")]
    outer = sources.read_parallel_outer(spark, {"train": (src, dst), "valid": (dst, src)})
    # Blank lines are skipped on each side before rows are numbered.
    assert [tuple(r) for r in outer.select("split", "row_id", "input", "output").orderBy("split", "row_id").collect()] == [
        ("train", 0, "one", "eins"), ("train", 1, " two ", "zwei"), ("train", 2, "four", "drei"), ("train", 3, "five", None),
        ("valid", 0, "eins", "one"), ("valid", 1, "zwei", " two "), ("valid", 2, "drei", "four"), ("valid", 3, None, "five"),
    ]


def test_write_parallel_quoting(spark, tmp_path):
    df = spark.createDataFrame([(1, "b, c", None), (0, "a", 'x "y"')], "row_id int, input string, output string")
    sinks.write_parallel(df, str(tmp_path / "q"), quoting="minimal")
    assert spark.read.text(str(tmp_path / "q.src")).coalesce(1).orderBy("value").collect()[0][0] == '"b, c"'
    write_splits(df.withColumn("split", F.lit("train")), str(tmp_path / "raw"))
    pairs = rows_of(sources.read_parallel_outer(spark, {"train": (str(tmp_path / "raw/train.src"), str(tmp_path / "raw/train.src"))}), "row_id", "input")
    assert pairs == [(0, "a"), (1, "b, c")]
    assert [r[0] for r in number_scan(spark.read.text(str(tmp_path / "raw/train.dst"))).orderBy("row_id").select("value").collect()] == ['x "y"', ""]


def test_nested_articles(spark, tmp_path):
    records = [{"language": "en", "articles": [{"v": 0, "t": "a"}, {"v": 1, "t": "b"}]}, {"language": "es", "articles": []}]
    (tmp_path / "a.json").write_text(json.dumps(records, indent=1))
    schema = spark.createDataFrame([], "v int, t string").schema
    table = sources.read_nested_articles(spark, str(tmp_path / "a.json"), schema, multiline=True)
    assert profile.rows_by_language(table, ["en", "es"]).first().asDict() == {"n_en": 1, "n_es": 1, "n_all": 2}
    assert rows_of(sources.flatten_articles(table), "v", "t") == [(0, "a"), (1, "b")]


# ---------------------------------------------------------------- preparations


@pytest.fixture(scope="module")
def wp(spark):
    names = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]", *"abcdefghijklmnopqrstuvwxyz.", *["##" + c for c in "abcdefghijklmnopqrstuvwxyz"]]
    return WordPiece(spark.createDataFrame([(t, i) for i, t in enumerate(names)], "token string, index int"))


PAIRS = [(0, "Good Day", "good"), (1, "fine", "7"), (2, "Good Day", "good"), (3, "x" * 40 + " " + "y " * 500, "long"), (4, "ok", "b")]


def test_prepare_flags(spark, wp):
    df = spark.createDataFrame(PAIRS, "row_id int, input string, output string")
    result = prepare(df, wp, CleanRules(), "m")
    # 1 holds an unknown piece, 2 repeats 0, 3 is too long.
    assert rows_of(result.rows, "row_id", "input") == [(0, "good day"), (4, "ok")]
    assert rows_of(result.unknown, "row_id", "side") == [(1, "output")]
    kept = {r["row_id"] for r in result.rows.collect()}
    assert not kept & {r["row_id"] for r in result.unknown.collect()}
    stats = result.stats.first()
    assert stats["length_dataset"] == 2 and stats["max_length_words_input"] == 4 and stats["min_length_tokens_output"] == 3
    # By position: one unknown sentence drops the row labelled 0.
    assert rows_of(prepare(df, wp, CleanRules(), positional=True).rows, "row_id") == [(1,), (4,)]
    raw = prepare(df, wp, CleanRules(enabled=False), store=False)
    assert rows_of(raw.unknown, "row_id", "side") == [(0, "input"), (1, "output")]


def test_long_sentences_count_on_their_other_side(spark, wp):
    df = spark.createDataFrame(PAIRS, "row_id int, input string, output string")
    found = {r["side"]: r for r in prepare(df, wp).profile.collect()}
    assert found["output"]["max_length"] == 6 and found["input"]["max_length"] < 512


def test_presplit_files_stay_unfiltered(spark, wp):
    merged = spark.createDataFrame([("train", 0, "a", "b"), ("test", 0, "a", "b"), ("valid", 0, "7", "b")], "split string, row_id int, input string, output string")
    prepared, splits = prepare_presplit(merged, wp, CleanRules(enabled=False))
    assert prepared.tokenized.count() == 2 and splits["valid"].count() == 1 and splits["test"].count() == 1


def test_distinct_rows_keep_the_first(spark):
    df = spark.createDataFrame([(5, "a"), (2, "a"), (9, None), (3, None)], "row_id int, t string")
    assert {tuple(r) for r in distinct_rows(df).collect()} == {(2, "a"), (3, None)}


def test_evaluate_flags(spark, wp):
    pairs = spark.createDataFrame([(0, "abc de", "abc de"), (1, "a b c d e", "a b x")], "row_id int, input string, output string")
    marked = evaluate(pairs, wp, identity, max_len=16)
    bare = evaluate(pairs, wp, identity, max_len=16, strip_specials=True)
    first = {r["row_id"]: r for r in marked.sentences.collect()}
    assert first[0]["origin"] == "[CLS] [CLS] abc de [SEP] [SEP]" and first[0]["bleu"] == pytest.approx(1)
    assert {r["row_id"]: r["origin"] for r in bare.sentences.collect()}[0] == "abc de"
    assert first[0]["meteor"] > 0.9 and 0 <= marked.corpus.first()["sari"] <= 1


def test_prepare_aligned_drops_adjacent_versions(spark, wp):
    df = spark.createDataFrame([(0, "d", "V0", "V1", "a", "b"), (1, "d", "V0", "V2", "a", "b")], "row_id int, doc_id string, docv_input string, docv_output string, input string, output string")
    assert rows_of(prepare_aligned(df, wp).rows, "row_id") == [(1,)]


def test_part_numbers_of_six_digits_follow_five(spark, tmp_path):
    for name, line in (("part-99999", "first"), ("part-100000", "second")):
        (tmp_path / name).write_text(line + "\n")
    from twinline.operators.position import number_scan

    rows = number_scan(spark.read.text(str(tmp_path))).collect()
    assert {r["value"]: r["row_id"] for r in rows} == {"first": 0, "second": 1}


def test_version_totals_tell_null_versions_from_totals(spark):
    from twinline.operators.profile import version_pair_totals

    rows = spark.createDataFrame([("V0", "V1"), ("V0", None), (None, None)], "docv_input string, docv_output string")
    got = {(r["docv_input"], r["docv_output"], r["level"]): r["n"] for r in version_pair_totals(rows).collect()}
    assert got["V0", None, 0] == 1 and got["V0", None, 1] == 2 and got[None, None, 0] == 1 and got[None, None, 3] == 3
