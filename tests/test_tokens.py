import pytest
from pyspark.sql import functions as F

from twinline.functions import tokens
from twinline.functions.wordpiece import WordPiece, match_pieces
from twinline.operators.joins import tokens_to_ids

VOCAB = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]", "un", "##aff", "##able", "aff", ",", "!", "the", "a", "##b", "##c", "中", "'"]


@pytest.fixture(scope="module")
def wp(spark):
    return WordPiece(spark.createDataFrame([(t, i) for i, t in enumerate(VOCAB)], "token string, index int"))


def run(spark, rows, schema, expression):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expression).collect()]


def test_wordpiece(spark, wp):
    texts = [
        ("unaffable, the!",), (None,), ("",), ("the [MASK]the zzz",), ("中the",), ("a\x00bc",), ("a the",), ("x" * 101,),
        ("the\x0bthe",),
    ]
    cut = run(spark, texts, "t string", wp.tokenize(F.col("t")))
    bodies = [
        ["un", "##aff", "##able", ",", "the", "!"], [], [], ["the", "[MASK]", "the", "[UNK]"], ["中", "the"], ["a", "##b", "##c"],
        ["a", "the"], ["[UNK]"], ["[UNK]"],
    ]
    assert cut == [["[CLS]", *b, "[SEP]"] for b in bodies]
    ids = run(spark, texts, "t string", wp.encode(F.col("t")))
    assert ids == [None if t[0] is None else [VOCAB.index(p) for p in b] for t, b in zip(texts, bodies)]


def test_wordpiece_matches_a_plain_loop(spark, wp, sf_dir):
    """Batches with many rows give what one word at a time gives."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("text")
    vocab = {c: i for i, c in enumerate(VOCAB + list("abcdefghinorst") + ["##" + c for c in "abcdefghilmnorstuvwy"])}
    own = WordPiece(spark.createDataFrame(list(vocab.items()), "token string, index int"))
    for text, pieces in rows.select("text", own.pieces(F.col("text"))).collect():
        expected = []
        for chunk in text.split():
            word = ""
            for char in chunk:
                if char.isalnum():
                    word += char
                else:
                    expected += (match_pieces(word, vocab) if word else []) + match_pieces(char, vocab)
                    word = ""
            expected += match_pieces(word, vocab) if word else []
        assert pieces == expected


def test_words_from_pieces(spark):
    rows = [(["a", "##b", "c", "##d", "##e"],), (["##x"],), ([],), (["a"],), (["##x", "##y"],)]
    schema = "p array<string>"
    assert run(spark, rows, schema, tokens.pieces_to_words(F.col("p"))) == [["ab", "cde"], ["##x"], [], ["a"], ["xy"]]
    assert run(spark, rows, schema, tokens.pieces_per_word(F.col("p")))[0] == [["a", "##b"], ["c", "##d", "##e"]]
    assert run(spark, rows, schema, tokens.word_numbers(F.col("p"))) == [[1, 1, 2, 2, 2], [1], [], [1], [1, 1]]


def test_padding(spark):
    rows = [([7, 8],), ([],), ([1, 2, 3, 4, 5, 6],)]
    schema = "i array<int>"
    assert run(spark, rows, schema, tokens.encode_pad(F.col("i"), 5, 2, 3)) == [
        [2, 7, 8, 3, 0], [2, 3, 0, 0, 0], [2, 1, 2, 3, 4, 5, 6, 3]
    ]
    assert run(spark, rows, schema, tokens.field_encode(F.col("i"), 6, 2, 3)) == [
        [2, 2, 7, 8, 3, 3], [2, 2, 3, 3, 0, 0], [2, 2, 1, 2, 3, 3]
    ]
    assert run(spark, rows, schema, tokens.field_encode(F.col("i"), 6, 2, 3, False))[0] == [2, 7, 8, 3, 0, 0]
    assert run(spark, [([1, 0, 2],)], schema, tokens.attention_mask(F.col("i"))) == [[1, 0, 1]]
    assert run(spark, [([1, 0, 2],)], schema, tokens.padding_mask(F.col("i"))) == [[False, True, False]]
    assert run(spark, [([[1], [2, 3]],)], "g array<array<int>>", tokens.encode_word_pad(F.col("g"), 4)) == [[[1], [2, 3], [], []]]


def test_decode(spark):
    rows = [(["[CLS]", "un", "##aff", "the", "[SEP]", "[PAD]", "[PAD]"],)]
    text = tokens.decode_pieces(F.col("p"))
    assert run(spark, rows, "p array<string>", text) == ["[CLS] unaff the [SEP]"]
    assert run(spark, rows, "p array<string>", tokens.strip_markers(text)) == ["unaff the"]


def test_ngrams(spark):
    rows = [(["a", "b", "c"],), (["a"],), ([],)]
    for n, expected in [(1, [["a", "b", "c"], ["a"], []]), (2, [["a b", "b c"], [], []]), (4, [[], [], []])]:
        assert run(spark, rows, "t array<string>", tokens.ngrams(F.col("t"), n)) == expected


def test_word_tokenize(spark):
    rows = [("L'ami dit: oui!", "fr"), ("I don't know it's", "en"), ("Das ist's, gut.", "de"), ("uno-dos tres", "es")]
    words = run(spark, rows, "t string, l string", tokens.word_tokenize(F.col("t"), F.col("l")))
    assert words == [
        ["L'", "ami", "dit", ":", "oui", "!"], ["I", "do", "n't", "know", "it", "'s"],
        ["Das", "ist'", "s", ",", "gut", "."], ["uno-dos", "tres"],
    ]


def test_word_tokenize_keeps_every_character(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "text", tokens.word_tokenize(F.col("text"), F.col("lang")).alias("w")
    )
    for text, words in docs.collect():
        assert "".join(words) == "".join(text.split())


def test_sentences(spark):
    rows = [('He left. "Why?" Nobody  knew!',), ("  ",), ("one",)]
    assert run(spark, rows, "t string", tokens.sentence_split(F.col("t"))) == [['He left.', '"Why?"', "Nobody  knew!"], [], ["one"]]


def test_ids_agree_for_small_and_large_vocabularies(spark):
    rows = spark.createDataFrame([(1, ["a", "x", "a"]), (2, []), (3, None), (4, ["b"])], "k int, t array<string>")
    vocab = spark.createDataFrame([("a", 5), ("b", 6)], "token string, index int")
    for small in (True, False):
        coded = tokens_to_ids(rows, vocab, "t", "ids", ["k"], 1, small=small)
        assert sorted((r["k"], r["ids"]) for r in coded.collect()) == [(1, [5, 1, 5]), (2, []), (3, None), (4, [6])]


def test_large_vocabulary_moves_rare_words_only(spark):
    from pyspark.sql import functions as F

    from twinline.operators.skew import frequent_values

    rows = [(i % 5 or None, [f"w{(i * j) % 97}" if j % 3 else "the" for j in range(i % 7)]) for i in range(200)]
    rows += [(7, None), (7, []), (7, [None, "w1", None]), (7, ["out", "w2", "out", "w2"])]
    df = spark.createDataFrame(rows, "k int, t array<string>").repartition(3)
    vocab = spark.createDataFrame([(f"w{i}", i + 2) for i in range(0, 97, 2)] + [("the", 99)], "token string, index int")
    table = {r["token"]: r["index"] for r in vocab.collect()}
    want = sorted(((k, t, None if t is None else [table.get(w, 1) for w in t]) for k, t in rows), key=str)
    for frequent in (1, 10, 1000):
        coded = tokens_to_ids(df, vocab, "t", "ids", ["k"], 1, small=False, frequent=frequent)
        assert coded.columns == ["k", "t", "ids"]
        assert sorted(((r.k, r.t, r.ids) for r in coded.collect()), key=str) == want
    empty = tokens_to_ids(df.limit(0), vocab, "t", "ids", ["k"], 1, small=False)
    assert empty.count() == 0
    assert frequent_values(df, F.col("t"), 5).orderBy(F.desc("count")).first()["item"] == "the"


def test_tokens_are_coded_once_for_a_large_vocabulary(spark):
    df = spark.createDataFrame([(i, ["a", f"w{i}", "a", None]) for i in range(9)], "k int, t array<string>")
    vocab = spark.createDataFrame([("a", 2), *[(f"w{i}", 3 + i) for i in range(0, 9, 2)]], "token string, index int")
    top = spark.createDataFrame([("a", 18)], "item string, count long")
    coded = tokens_to_ids(df, vocab, "t", "ids", ["k"], 1, small=False, top=top, keep_tokens=False)
    assert coded.columns == ["k", "ids"]
    assert sorted((r.k, r.ids) for r in coded.collect()) == [(i, [2, 1 if i % 2 else 3 + i, 2, 1]) for i in range(9)]
    # What reads the stored codes only fills them: before, each branch coded the tokens anew.
    coded = tokens_to_ids(df, vocab, "t", "ids", ["k"], 1, small=False)
    assert coded._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython [") <= 2
    assert "encode(" not in coded._jdf.queryExecution().optimizedPlan().toString()


def test_slices_and_tables_agree_with_dictionaries(monkeypatch):
    import pyarrow as pa

    from twinline.functions import lists

    rows = pa.array([["a", "b", None], None, [], ["c"] * 7, ["a"], ["b", "x"]], pa.list_(pa.string()))
    numbers = {"a": 5, "b": None, "c": 7, None: 1}
    for values in (1, 2, 3, 100):
        monkeypatch.setattr(lists, "SLICE_VALUES", values)
        for default in (0, None):
            want = lists.map_values(rows, numbers, default, pa.int32())
            assert lists.in_slices(rows, lambda some: lists.Table(numbers).look_up(some, default)).to_pylist() == want.to_pylist()
    assert lists.in_slices(rows.slice(0, 0), lambda some: lists.Table({}).look_up(some, 3)).to_pylist() == []
