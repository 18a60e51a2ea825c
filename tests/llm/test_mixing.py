import pytest

from twinline.llm.mixing import mix


def fill(sizes, weights, budget, epochs):
    caps, target, free = {s: n * epochs for s, n in sizes.items()}, {}, set(sizes)
    while free:
        rest = budget - sum(target.values())
        level = rest / sum(weights[s] for s in free)
        over = [s for s in free if caps[s] < level * weights[s]]
        if not over:
            return target | {s: level * weights[s] for s in free}
        for s in over:
            target[s] = caps[s]
            free.discard(s)
    return target


@pytest.mark.parametrize("sizes", [[5, 50, 500], [1, 1, 1000, 3, 200], [100, 100, 100], [10, 0, 400]])
def test_targets_and_shares(spark, make_text, sizes):
    rows, key = [], 0
    names = [None if i == len(sizes) - 1 else f"s{i}" for i in range(len(sizes))]
    for name, n in zip(names, sizes):
        left = n
        while left > 0:
            take = min(left, 1 + key % 17)
            rows.append((key, name, make_text(key, take)))
            key, left = key + 1, left - take
        rows += [(key, name, ""), (key + 1, name, None)]
        key += 2
    out = mix(spark.createDataFrame(rows, "doc_id long, source string, text string"))
    got = out.collect()
    assert len(got) == len(rows)
    weights = {name: (3, 1, 2)[i % 3] for i, name in enumerate(names)}
    want = fill(dict(zip(names, sizes)), weights, 1.5 * sum(sizes), 2.0)
    taken = {}
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 2 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for name in names:
        assert abs(taken[name] - want[name]) < 1.001
    assert sorted(map(str, got)) == sorted(map(str, out.collect()))


def test_odd_rows(odd_docs, no_docs):
    assert mix(odd_docs).count() == odd_docs.count()
    assert mix(no_docs).count() == 0
    assert mix(odd_docs.filter("text is null")).agg({"taken": "sum"}).first()[0] == 0
