import collections
import random
import re
import zlib

from pyspark.sql import functions as F

from twinline.llm import spelling
from twinline.llm.spelling import _numbered, spelling_groups

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(rows):
    counts = collections.Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(ASCII_LOWER)
            crc = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if crc % 97 == 0:
                run = run[: crc % len(run)] + run[crc % len(run) + 1 :]
            if len(run) >= 5:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 3}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    words = counted(rows)
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    best = {w: min(xs, key=lambda x: (-words[x], x)) if xs else None for w, xs in near.items()}
    form = {w: x if x and words[x] >= 2 * words[w] else None for w, x in best.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n, len(near[w]), words[form[w]] if form[w] else None) for w, n in words.items())


def found(docs):
    return sorted(tuple(r) for r in spelling_groups(docs).select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_matches_brute_force(spark):
    rng, rows = random.Random(4), []
    # Two letters, doubled ones and accents: most words have neighbours of every kind.
    vocabulary = ["".join(rng.choice("abé") for _ in range(rng.randint(4, 8))) for _ in range(400)]
    for i in range(300):
        rows.append((i, " ".join(rng.choice(vocabulary[: rng.choice([20, 80, 400])]) for _ in range(60))))
    rows += [(1000 + i, "Straße STRASSE strasse Strasze×÷ naïve naive NAÏVE naivé " * i) for i in range(5)]
    want = brute(rows)
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == want
    assert sum(r[1] is not None for r in want) > 50 and max(r[4] for r in want) > 8
    assert any(r[1] is not None and r[2] != r[1] for r in want)


def test_replaced_at_both_ends_and_doubled_letters(spark):
    text = "aabbcc " * 40 + "xabbcc " * 9 + "aabbcx " * 9 + "abbcc " * 4 + "aabbbcc " * 4 + "aabbccc " * 30 + "aabcc " * 3
    rows = [(None, text)]
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_nodes_agree_across_parts(spark):
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 9))) for _ in range(600)} | {"a" * 3000})
    df = spark.createDataFrame([(w,) for w in words], "word string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for key, text in ((F.col("word"), lambda w: w), (F.reverse("word"), lambda w: w[::-1])):
            rows = _numbered(df, key, "way").collect()
            nodes = {}
            for r in rows:
                assert len(r.way) == len(r.word) + 1 and r.way[0] == 0
                for depth, node in enumerate(r.way):
                    assert nodes.setdefault(text(r.word)[:depth], node) == node
            assert len(set(nodes.values())) == len(nodes) and len({r.way[-1] >> spelling.NODE_BITS for r in rows}) > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_odd_rows(odd_docs, no_docs, spark):
    rows = [tuple(r) for r in odd_docs.select("doc_id", "text").collect()]
    # The long text's word has four letters; a longer one and one very long run are counted whole.
    long = "wörter " * 20_000 + ("x" * 50_000 + " ") * 3
    rows += [(9, long), (9, long)]
    docs = odd_docs.unionByName(spark.createDataFrame(rows[-2:], "doc_id long, text string"), allowMissingColumns=True)
    assert found(docs) == brute(rows)
    assert spelling_groups(no_docs).count() == 0
