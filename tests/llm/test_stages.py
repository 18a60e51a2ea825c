"""The third stage of the pipeline row by row, and all stages on odd tables."""

import corpus_pipeline
from twinline.llm import stages
from twinline.session import written


def shingles(text):
    words = (text or "").split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def kept_rows(rows):
    """One row of each group, by comparing all pairs; rows that share id and text count as one member."""
    sets = [shingles(r[1]) for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 4 * len(sets[i] & sets[j]) >= 3 * len(sets[i] | sets[j]):
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    out, seen = [], set()
    for i in sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0)):
        if not sets[i] or group[i] not in seen:
            out.append(rows[i])
        seen.add(group[i])
    return out


def test_one_row_of_each_group_stays(spark, make_text):
    base, other = make_text(1, 60), make_text(2, 60)
    near = base.rsplit(" ", 1)[0] + " end"
    rows = [
        (5, base, "a", 1), (5, base, "a", 1), (3, near, "b", 2), (9, base, None, 3),
        # One id for a copy and for a text of its own.
        (9, other, "c", 4), (7, make_text(3, 40), "c", 5),
        (None, make_text(4, 30), "d", 6), (None, make_text(4, 30), "d", 6), (None, base, "d", 7),
        (11, None, "e", 8), (11, None, "e", 8), (12, "", "e", 9), (None, None, None, None), (13, "two words", "f", 1), (14, "two words", "f", 1),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, member string, stays int").repartition(3)
    got = [tuple(r) for r in stages.one_of_each_group(spark, written(docs, "docs"), "").collect()]
    assert sorted(got, key=str) == sorted(kept_rows(rows), key=str)
    assert (9, other, "c", 4) in got and (3, near, "b", 2) in got


def test_stages_take_odd_and_empty_tables(spark, sf_dir, odd_docs, no_docs):
    for table in (odd_docs, no_docs):
        docs = written(table.withColumnRenamed("row", "__text"), "odd")
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            docs = written(stage(spark, docs, sf_dir), name)
            if name != "mixing":
                assert docs.columns == columns
        if table is no_docs:
            assert docs.count() == 0
