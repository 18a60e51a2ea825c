import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from twinline.llm import merkle
from twinline.llm.merkle import fold, leaf_digest, manifest, tampered_proofs


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(leaves):
    """The root and each leaf's siblings, level by level."""
    paths = [[] for _ in leaves]
    nodes = [(leaf, [i]) for i, leaf in enumerate(leaves)]
    while len(nodes) > 1:
        level = []
        for k in range(0, len(nodes), 3):
            run = nodes[k : k + 3]
            for j, (_, own) in enumerate(run):
                for i in own:
                    paths[i].append(("".join(x[0] for x in run[:j]), "".join(x[0] for x in run[j + 1 :])))
            level.append((h(*[x[0] for x in run]), [i for x in run for i in x[1]]))
        nodes = level
    return nodes[0][0], paths


def brute(rows):
    sources = {}
    for r in rows:
        sources.setdefault(r[1], []).append(r)
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for name in names:
        own = sorted(sources[name], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees.append((own, *tree([leaf_of(r) for r in own])))
    root, over = tree([t[1] for t in trees]) if trees else (None, [])
    out = []
    for (own, subroot, paths), more in zip(trees, over, strict=True):
        for r, path in zip(own, paths, strict=True):
            whole = path + more
            picked = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None
            node = leaf_of((*r[:4], r[4].replace("\n", ""))) if picked else leaf_of(r)
            for left, right in whole:
                node = h(left, node, right)
            out.append((r[0], leaf_of(r), subroot, root, h(*[a + b for a, b in whole]), node, node == root))
    return sorted(out, key=repr)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def rows_of(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


@pytest.mark.parametrize("sizes", [(1,), (3, 1), (4, 9, 10), (28, 2, 1, 1)])
def test_matches_brute_force(spark, sizes):
    rows, n = [], 0
    for s, size in enumerate(sizes):
        for _ in range(size):
            text = None if n % 7 == 3 else f"line é {n}\nmore\n" if n % 3 else f"no break {n}"
            rows.append((n * 37 % 1001, [None, "b", "a", "ä"][s], None if n % 5 == 0 else "en", n, text))
            n += 1
    got = rows_of(tampered_proofs(spark.createDataFrame(rows, SCHEMA)))
    assert got == brute(rows)
    assert len(rows) < 9 or {r[-1] for r in got} == {True, False}


def test_several_rounds_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BLOCK_LEVELS", 2)
    rows = [(i, "hot" if i < 250 else f"s{i % 31}", "en", i, f"text {i}\n") for i in range(300)]
    assert rows_of(tampered_proofs(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_odd_rows(odd_docs, no_docs):
    rows = [tuple(r) for r in odd_docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = rows_of(tampered_proofs(odd_docs))
    # Repeated rows have one leaf and a place each.
    assert got == brute(rows) and len(got) == odd_docs.count()
    assert tampered_proofs(no_docs).count() == 0


def test_clashing_names_and_other_columns(spark):
    rows = [(i, "s", f"{i}", i, i, i) for i in range(20)]
    leaves = spark.createDataFrame(rows, "id long, source string, leaf string, rank long, tree long, path long")
    renamed = leaves.withColumnRenamed("path", "digest")
    found = manifest(renamed, ["id"])
    assert found.columns == [*renamed.columns, "subroot", "root", "path"]
    assert found.filter(fold(F.col("leaf"), F.col("path")) == F.col("root")).count() == 20
    assert [r.rank for r in found.orderBy("id").collect()] == list(range(20))


def test_leaf_tells_null_from_text(spark):
    df = spark.createDataFrame([(None, "-"), ("-", None), ("", "")], "a string, b string")
    assert [r[0] for r in df.select(leaf_digest(F.col("a"), F.col("b"))).collect()] == [h("-", "1:-"), h("1:-", "-"), h("0:", "0:")]
