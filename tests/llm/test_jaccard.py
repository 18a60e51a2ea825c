import re

import numpy as np
import pytest

from twinline.llm import jaccard_join as J
from twinline.llm.words import NOT_SPACE, shingle_sets, word_slices

import pyarrow as pa


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(rows):
    sets = [(k, shingles(t)) for k, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, x) in enumerate(sets):
        for j, (_, y) in enumerate(sets[:i]):
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                parent[root(i)] = root(j)
    least = {}
    for i, (k, _) in enumerate(sets):
        least[root(i)] = min(least.get(root(i), k), k)
    return {k: (len(s), least[root(i)]) for i, (k, s) in enumerate(sets)}


def edited(text, places, seed):
    words = text.split()
    rng = np.random.default_rng(seed)
    for p in rng.choice(len(words), places, replace=False):
        words[p] = f"new{seed}{p}"
    return " ".join(words)


@pytest.mark.parametrize("light,frequent,block", [(8, 4, 20_000), (2, 2, 20_000), (2, 2, 3)])
def test_matches_brute_force(spark, make_text, monkeypatch, light, frequent, block):
    monkeypatch.setattr(J, "LIGHT_BUCKET", light)
    monkeypatch.setattr(J, "HUB_BLOCK", block)
    monkeypatch.setattr(J, "FREQUENT_IN", frequent)
    rows, passage = [], make_text(0, 60)
    for group in range(12):
        base = make_text(group + 1, 20 + 45 * group)
        rows += [base, base.upper(), base + "  \n"]
        rows += [edited(base, p, 100 * group + p) for p in range(1, min(8, len(base.split()) // 10) + 1)]
        rows += [passage + " " + base, base + " " + passage, passage + " " + make_text(500 + group, 25)]
    rows += ["one two", "ONE two", "one", "", None, "one two three four", "one two three four five"]
    rows = list(enumerate(rows))
    got = J.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute(rows)


def test_signatures_meet_for_every_similar_pair():
    rng = np.random.default_rng(3)
    frequent = np.sort(rng.integers(0, 2**63, 400, dtype=np.uint64))
    for size in [1, 2, 3, 4, 5, 7, 8, 12, 30, 48, 49, 64, 65, 86, 200, 257, 341, 900]:
        for trial in range(30):
            hot = rng.choice(frequent, min(len(frequent), size * (trial % 4) // 3), replace=False)
            x = np.union1d(hot, rng.integers(0, 2**63, size - len(hot), dtype=np.uint64))
            most = len(x) // 4
            gone = rng.integers(0, most + 1)
            y = np.delete(x, rng.choice(len(x), gone, replace=False))
            new = 0
            while J.linked(len(y), len(x), len(y) + new + 1):
                new += 1
            y = np.union1d(y, rng.integers(0, 2**63, new, dtype=np.uint64))
            if len(y) and J.linked(len(np.intersect1d(x, y)), len(x), len(y)):
                assert np.intersect1d(J.signatures(x, frequent)[0], J.signatures(y, frequent)[0]).size
                assert J.least_difference(J.bitmap(x), J.bitmap(y)) <= (len(x) + len(y)) // 7
                beside = [J.folded(J.bitmap(z), J.BESIDE_BITS) for z in (x, y)]
                assert np.bitwise_count(beside[0] ^ beside[1]).sum() <= (len(x) + len(y)) // 7


def test_bitmaps_tell_unlike_sets_apart():
    rng = np.random.default_rng(5)
    for size in (60, 200, 700, 3000):
        for share in (0.0, 0.3, 0.6):
            both = rng.integers(0, 2**63, int(size * share), dtype=np.uint64)
            x, y = (np.union1d(both, rng.integers(0, 2**63, size - len(both), dtype=np.uint64)) for _ in "xy")
            assert J.least_difference(J.bitmap(x), J.bitmap(y)) > (len(x) + len(y)) // 7


def test_odd_rows(odd_docs, no_docs):
    got = J.jaccard_groups(odd_docs).collect()
    assert len(got) == odd_docs.count()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id in (1, 2, 3, 4)} == {
        (1, 0, 1), (2, 0, 2), (3, 1, 3), (4, 0, 4),
    }
    assert all(r.component_id is None for r in got if r.doc_id is None)
    assert J.jaccard_groups(no_docs).count() == 0


def test_slices_do_not_change_words(make_text, monkeypatch):
    from twinline.llm import words as W

    texts = [make_text(i, i * 7 % 90) for i in range(40)] + ["", None, " x "]
    whole = [s.tolist() for w in word_slices(pa.array(texts), NOT_SPACE) for s in shingle_sets(w, 5)]
    monkeypatch.setattr(W, "SLICE_BYTES", 200)
    assert whole == [s.tolist() for w in word_slices(pa.array(texts), NOT_SPACE) for s in shingle_sets(w, 5)]
    assert [len(s) for s in whole] == [len(shingles(t)) for t in texts]


def test_hub_pairs_are_ruled_out_by_whole_bitmaps(spark):
    import numpy as np

    from twinline.llm import jaccard_join as j

    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)) for n in [2000] * 12 + [700, 1030, 400]]
    maps = [j.bitmap(t) for t in sets]
    for x in maps:
        assert j.least_differences(x, maps, 5).tolist() == [j.least_difference(x, y) for y in maps]
    # Folded to 512 bits, unlike sets of 2,000 can't be told apart: before, all 66 pairs of them became rows.
    rows = [(i, len(t), m) for i, (t, m) in enumerate(zip(sets, maps, strict=True))] + [(99, 2000, maps[0])]
    classes = spark.createDataFrame(rows, "class long, n_shingles long, bits binary")
    members = classes.selectExpr("-1L as u", "class as v", "class as root")
    for keep in ("nearest", "each", "all"):
        found = j._rest(members, classes.select("class"), classes, keep).collect()
        assert [(r.u, r.v) for r in found] == [(0, 99)]


def test_only_buckets_with_a_bare_class_stay_open(spark):
    from twinline.llm import jaccard_join as j

    members = spark.createDataFrame([(1, 1), (1, 2), (3, 3), (3, 4), (5, 5), (5, 6)], "u long, v long")
    roots = spark.createDataFrame([(6, 5), (5, 5)], "node long, root long")
    bare = spark.createDataFrame([(2,), (6,)], "class long")
    got = sorted((r.u, r.v, r.root) for r in j._open(members, roots, bare).collect())
    # The second has none, the third is one component.
    assert got == [(1, 1, 1), (1, 2, 2)]
