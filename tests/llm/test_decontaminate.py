import re

from twinline.llm.decontaminate import contamination, find_passages

SPLIT = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return SPLIT.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    out = {}
    for key, text in docs:
        w, hit, found = words(text), set(), set()
        for item, passage in items:
            p = words(passage)
            size = min(13, len(p))
            grams = {tuple(p[i : i + size]) for i in range(len(p) - size + 1)} if size else set()
            for i in range(len(w) - size + 1):
                if tuple(w[i : i + size]) in grams:
                    hit |= set(range(i, i + size))
                    found.add(str(item))
        out[key] = (len(w), len(hit), len(found), len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


def cases(make_text):
    items = [(i, make_text(i, n)) for i, n in enumerate([30, 13, 14, 12, 5, 2, 1, 0, 40])] + [(20, None), (3, make_text(77, 20))]
    items[6] = (6, "Einzig9")
    docs = [(i, make_text(100 + i, 50)) for i in range(10)]
    for i, (_, passage) in enumerate(items[:9]):
        docs.append((20 + i, make_text(200 + i, 30) + ", " + passage.upper() + "! " + make_text(300 + i, 200)))
        docs.append((40 + i, passage + " " + passage))
    docs += [(60, make_text(0, 30)[10:]), (61, ""), (62, None)]
    return docs, items


def test_matches_brute_force(spark, make_text):
    docs, items = cases(make_text)
    frames = [spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")]
    want = brute(docs, items)
    for options in ({}, {"block_bytes": 300}):
        got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.contaminated) for r in contamination(*frames, **options).collect()}
        assert got == want


def test_odd_rows(spark, odd_docs, no_docs, make_text):
    items = spark.createDataFrame([(None, "word word"), (1, make_text(1, 20))], "item_id long, text string")
    clashing = odd_docs.withColumnRenamed("row", "contamination")
    found, name = find_passages(clashing, items)
    assert name == "contamination_" and found.columns == [*clashing.columns, name]
    assert {r.doc_id for r in found.filter(f"{name}.n_hit > 0").collect()} == {3}
    assert contamination(no_docs, items).count() == 0
    assert contamination(odd_docs, items.limit(0)).filter("contaminated").count() == 0
