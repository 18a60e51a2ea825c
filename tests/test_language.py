"""Token packing against plain loops over small streams."""

import random

import pytest
from pyspark.sql import functions as F

from twinline.operators import lm
from twinline.operators.vocab import vocab_by_frequency


@pytest.fixture(scope="module")
def docs(spark):
    random.seed(3)
    sizes = [0, 1, 7, 300, 0, 13, 2, 1, 95, 40] + [random.randint(0, 12) for _ in range(60)]
    data, n = [], 0
    for i, size in enumerate(sizes):
        data.append((i * 3, [f"t{n + j}" for j in range(size)]))
        n += size
    stream = [t for _, tokens in data for t in tokens]
    return spark.createDataFrame(data, "row_id long, tokens array<string>").repartition(5), stream


def lanes_of(stream, bsz):
    steps = len(stream) // bsz
    return [stream[i * steps : (i + 1) * steps] for i in range(bsz)]


@pytest.mark.parametrize("bsz, bptt, ext", [(4, 10, 0), (4, 10, 3), (3, 7, 25), (1, 1000, 0), (16, 1, 2)])
def test_pack_contiguous(docs, bsz, bptt, ext):
    df, stream = docs
    expected = {}
    for lane, steps in enumerate(lanes_of(stream, bsz)):
        for chunk, i in enumerate(range(0, len(steps) - 1, bptt)):
            n = min(bptt, len(steps) - 1 - i)
            expected[lane, chunk] = (n, steps[max(0, i - ext) : i + n], steps[i + 1 : i + 1 + n])
    found = lm.pack_contiguous(df, "tokens", bsz, bptt, ext)
    assert {(r["lane"], r["chunk"]): (r["seq_len"], r["data"], r["target"]) for r in found.collect()} == expected
    pairs = {(r["lane"], r["step"]): (r["token"], r["target"]) for r in lm.next_token_target(df, "tokens", bsz, block=6).collect()}
    assert pairs == {
        (lane, i): (a, b) for lane, s in enumerate(lanes_of(stream, bsz)) for i, (a, b) in enumerate(zip(s, s[1:]))
    }


@pytest.mark.parametrize("ext", [0, 4, 60])
def test_pack_variable(docs, ext):
    df, stream = docs
    found = lm.pack_variable(df, "tokens", 4, 12, ext, seed=5).collect()
    for lane, steps in enumerate(lanes_of(stream, 4)):
        chunks = sorted((r for r in found if r["lane"] == lane), key=lambda r: r["chunk"])
        place = 0
        for r in chunks:
            assert r["start"] == place and (5 <= r["seq_len"] <= 27 or r is chunks[-1])
            assert r["data"] == steps[max(0, place - ext) : place + r["seq_len"]]
            assert r["target"] == steps[place + 1 : place + 1 + r["seq_len"]]
            place += r["seq_len"]
        assert place >= len(steps) - 2
    assert len({r["seq_len"] for r in found}) > 3


@pytest.mark.parametrize("shuffle", [True, False])
def test_pack_sentences(docs, shuffle):
    df, _ = docs
    bsz, bptt, ext = 3, 8, 5
    lists = {r["row_id"]: r["tokens"] for r in df.collect()}
    keys = {r[0]: r[1] for r in df.select("row_id", lm.random_key(F.col("row_id"), 2)).collect()}
    ids = sorted(lists, key=(lambda i: (keys[i], i)) if shuffle else (lambda i: i))
    stream = [pair for i in ids for pair in zip(lists[i], lists[i][1:])]
    lanes = lanes_of(stream, bsz)
    n = len(lanes[0]) // bptt
    assert len(stream) - n * bptt * bsz <= bsz * bptt + bsz
    expected = {}
    for lane, pairs in enumerate(lanes):
        for c in range(n):
            data = [d for d, _ in pairs[max(0, c * bptt - ext) : (c + 1) * bptt]]
            expected[lane, c] = (data, [t for _, t in pairs[c * bptt : (c + 1) * bptt]])
    found = lm.pack_sentences(df, "tokens", bsz, bptt, ext, seed=2, shuffle=shuffle)
    assert n > 0 and {(r["lane"], r["chunk"]): (r["data"], r["target"]) for r in found.collect()} == expected


def test_pack_shards_restart_per_shard(docs):
    df, _ = docs
    sharded = df.withColumn("shard", F.when(F.col("row_id") < 30, "a").otherwise("b"))
    both = lm.pack_shards(sharded, "tokens", 2, 6, "shard", seed=1).collect()
    for shard in "ab":
        alone = lm.pack_sentences(sharded.filter(F.col("shard") == shard), "tokens", 2, 6, seed=1).collect()
        assert sorted((r["lane"], r["chunk"], r["data"]) for r in both if r["shard"] == shard) == sorted(
            (r["lane"], r["chunk"], r["data"]) for r in alone
        )
    assert len({r["shard_order"] for r in both}) == 2


def test_one_sentence_fills_all_lanes(spark):
    one = spark.createDataFrame([(1, ["a", "b", "c"])], "row_id long, tokens array<string>")
    found = lm.pack_sentences(one, "tokens", 2, 1).collect()
    assert {(r["lane"], r["chunk"], *r["data"], *r["target"]) for r in found} == {(0, 0, "a", "b"), (1, 0, "b", "c")}
    assert lm.pack_sentences(one, "tokens", 3, 1).count() == 0
    assert lm.pack_contiguous(one, "tokens", 8, 2).count() == 0


@pytest.mark.parametrize("eos, tail", [("eos", ["<eos>"]), ("none", [])])
def test_corpus_vocab_encode(spark, eos, tail):
    df = spark.createDataFrame([("train", 1, ["b", "a", "b"]), ("test", 1, ["c", "a"])], "split string, row_id int, tokens array<string>")
    vocab, coded = lm.corpus_vocab_encode(df, "tokens", ["train"], eos)
    index = {r["token"]: r["index"] for r in vocab.collect()}
    assert index == {"<eos>": 0, "<unk>": 1, "b": 2, "a": 3}
    found = {r["split"]: r["ids"] for r in coded.collect()}
    ends = [0] * len(tail)
    assert found == {"train": [2, 3, 2, *ends], "test": [1, 3, *ends]}
    _, edged = lm.corpus_vocab_encode(df, "tokens", ["train"], "double")
    assert {r["split"]: r["ids"] for r in edged.collect()}["test"] == [0, 1, 3, 0]


def test_corpus_vocab_encode_of_a_large_vocabulary(spark, monkeypatch):
    from twinline.operators import joins, skew

    rows = [("train", i, [f"w{i % 7}", f"r{i}", "all"]) for i in range(40)] + [("test", i, ["new", "all", f"r{i + 30}"]) for i in range(20)]
    df = spark.createDataFrame([*rows, ("test", None, None), (None, 1, ["w1"])], "split string, row_id int, tokens array<string>")

    def coded():
        vocab, found = lm.corpus_vocab_encode(df, "tokens", ["train"])
        return sorted(((r.split, r.row_id, r.ids) for r in found.collect()), key=str), vocab.count()

    want = coded()
    monkeypatch.setattr(joins, "collect_small", lambda *_: None)
    sketched = []
    monkeypatch.setattr(lm, "frequent_values", lambda rows, *a: sketched.append({r.split for r in rows.collect()}) or skew.frequent_values(rows, *a))
    assert coded() == want
    # Counts are at hand for the counted splits.
    assert sketched == [{"test", None}]
    monkeypatch.setattr(lm, "FREQUENT", 5)
    assert coded() == want


def test_sampling(spark):
    df = spark.createDataFrame([(i, ["a", "b", "c", "d"][: 1 + i % 4]) for i in range(40)], "row_id int, t array<string>")
    vocab = vocab_by_frequency(df, "t", 1, ())
    size = vocab.agg(F.count(F.lit(1)).alias("n")).scalar()
    weights = lm.sampling_weights(vocab, 5, size).collect()
    assert sum(r["p"] for r in weights) == pytest.approx(1)
    exact = {r["index"]: r for r in lm.sampling_weights(vocab, 5, size, exact=True).collect()}
    import math

    for r in weights:
        assert r["log_q"] == pytest.approx(math.log(1 - (1 + r["p"]) ** -10))
        assert exact[r["index"]]["log_q"] == pytest.approx(math.log(1 - (1 - r["p"]) ** 10))
    tries = spark.range(4000)
    classes = [r[0] for r in lm.negative_samples(tries, size, seed=1).collect()]
    assert sorted(classes) == [0, 1, 2, 3]


def test_draws_follow_their_weights(spark):
    top = 50
    drawn = spark.range(20000).select(
        (F.floor(F.exp(lm.uniform(F.col("id"), 3) * F.log(F.lit(top + 1.0)))) - 1).alias("c")
    )
    import math

    counts = {r["c"]: r["count"] for r in drawn.groupBy("c").count().collect()}
    for c in (0, 1, 5, 20):
        p = (math.log(c + 2) - math.log(c + 1)) / math.log(top + 1)
        assert counts[c] / 20000 == pytest.approx(p, abs=0.01)


def test_contexts_travel_once_for_a_run_of_chunks(docs):
    df, _ = docs
    plan = lm.pack_contiguous(df, "tokens", 4, 3, 5)._jdf.queryExecution().optimizedPlan().toString()
    # Cuts meet by lane and run; a chunk is put together from them without a shuffle of its own.
    assert "Aggregate [lane" in plan and "run#" in plan and "Aggregate [lane#, chunk" not in plan
    assert lm.CARRIED > 1
