"""Quoted tables cut into many splits, against Spark's own reader with one task per file."""

import random

import pytest
from pyspark.sql import functions as F

from twinline import sources
from twinline.operators import position
from twinline.operators.position import number_scan, total_order
from twinline.schemas import PAIRS, strings
from twinline.sources.quoted import quoted_records, read_quoted


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "100", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield keys
    for k, v in before.items():
        spark.conf.set(k, v)


def whole_file(spark, path, schema, sep, header=False):
    options = {"sep": sep, "header": header, "quote": '"', "escape": '"', "multiLine": True, "enforceSchema": True}
    return spark.read.schema(schema).options(**options).csv(path)


def field(rng, sep):
    kind = rng.randrange(7)
    text = "".join(rng.choice(["a", "bc", " ", "é", "7"]) for _ in range(rng.randrange(1, 9))).strip() or "x"
    if kind < 3:
        return text
    if kind == 3:
        # A quote that doesn't begin a field is a plain character.
        return text + '" of ' + text
    inner = text + rng.choice(["\n", "\n\n", sep, '""', f'{sep}""\n', f'\n{sep}"" x', ""]) + text
    return f'"{inner}"'


@pytest.mark.parametrize("sep", ["\t", ","])
@pytest.mark.parametrize("header", [False, True])
def test_equals_one_task_reading(spark, tmp_path, small_splits, sep, header):
    rng, folder = random.Random(sep + str(header)), tmp_path / "in"
    folder.mkdir()
    for n in range(3):
        rows = [sep.join(field(rng, sep) for _ in range(2)) for _ in range(120)]
        rows.insert(40, "")
        (folder / f"part-{n:05d}.tsv").write_text("\n".join(rows) + "\n")
    path = str(folder)
    scan = spark.read.option("lineSep", "\n").text(path)
    assert scan.rdd.getNumPartitions() > 30
    got = sorted(map(tuple, read_quoted(spark, path, PAIRS, sep, header).collect()), key=lambda r: r[2])
    want = []
    for n in range(3):
        want += [tuple(r) for r in whole_file(spark, f"{path}/part-{n:05d}.tsv", PAIRS, sep, header).collect()]
    assert [r[2] for r in got] == list(range(len(want)))
    assert [r[:2] for r in got] == want and len(want) > 330


def test_long_and_unclosed_records(spark, tmp_path, small_splits):
    long = "\n".join(f'line {i} ""q""\tand more' for i in range(300))
    (tmp_path / "a.tsv").write_text(f'first\tone\r\n"{long}"\ttwo\r\n\n\nthird\t"th\r\nree"\nopen\t"never\nclosed\nat all\n')
    got = quoted_records(spark, str(tmp_path / "a.tsv"), "\t").orderBy("row_id").collect()
    assert [r.row_id for r in got] == [0, 1, 2, 3]
    assert [r.value for r in got] == ["first\tone", f'"{long}"\ttwo', 'third\t"th\r\nree"', 'open\t"never\nclosed\nat all']
    table = read_quoted(spark, str(tmp_path / "a.tsv"), PAIRS, "\t").orderBy("row_id").collect()
    assert table[1].input == long.replace('""', '"') and table[1].output == "two"


def test_empty_files_and_columns(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("")
    (tmp_path / "b.tsv").write_text("\n\n")
    (tmp_path / "c.tsv").write_text("h\tk\n1\tNA\n")
    (tmp_path / "d.tsv").write_text('h\tk\n""\t2\n3\n')
    found = sources.read_column(spark, str(tmp_path / "[ab].tsv"), "x")
    assert found.columns == ["x", "row_id"] and found.count() == 0
    rows = read_quoted(spark, str(tmp_path), strings("input", "output"), "\t", header=True).orderBy("row_id").collect()
    assert [tuple(r) for r in rows] == [("1", "NA", 0), (None, "2", 1), ("3", None, 2)]


def test_splits_are_read_by_tasks_of_their_own(spark, tmp_path, small_splits):
    (tmp_path / "a.tsv").write_text("".join(f'{i}\t"x\ny"\n' for i in range(60)))
    records = quoted_records(spark, str(tmp_path / "a.tsv"), "\t")
    plan = records._jdf.queryExecution().executedPlan().toString()
    # Lines are dealt by split, and only those of records with several meet by number.
    assert "hashpartitioning(__file" in plan and "SinglePartition" in plan
    assert records.count() == 60


def test_numbers_stay_right_when_later_scans_are_cut_otherwise(spark, tmp_path, small_splits):
    lines = [f"line {i} " + "x" * (i % 50) for i in range(300)]
    (tmp_path / "a.txt").write_text("\n".join(lines[:200]))
    (tmp_path / "b.txt").write_text("\n".join(lines[200:]))
    numbered = number_scan(spark.read.text(str(tmp_path)))
    in_files = number_scan(spark.read.text(str(tmp_path)), "line", file="shard")
    for size in ("700", "5000", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        assert [r.value for r in numbered.orderBy("row_id").collect()] == lines
        assert [r.row_id for r in numbered.orderBy("row_id").collect()] == list(range(300))
    found = {(r.shard[-5:], r.line): r.value for r in in_files.collect()}
    assert found["a.txt", 0] == lines[0] and found["b.txt", 99] == lines[-1] and len(found) == 300


def test_total_order_deals_ties(spark, monkeypatch):
    tables, write = [], position.written
    monkeypatch.setattr(position, "written", lambda df, purpose: tables.append(write(df, purpose)) or tables[-1])
    rows = spark.range(30_000).select((F.col("id") % 2).alias("g"), F.lit(5).alias("n"), F.concat(F.lit("samebeginning"), F.col("id")).alias("w"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = total_order(rows, ["n", "w"], "rank", ["g"], "total")
        files = tables[0].groupBy("_metadata.file_name").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    # Rows with one count and one beginning are spread over all tasks.
    assert len(files) == 4 and max(r["count"] for r in files) < 12_000
    got = placed.collect()
    for g in (0, 1):
        own = sorted((r.w, r["rank"], r.total) for r in got if r.g == g)
        assert [(rank, total) for _, rank, total in own] == [(i, 15_000) for i in range(15_000)]


def test_total_order_of_equal_rows_and_nulls(spark):
    rows = spark.createDataFrame([(None, 1)] * 5 + [("a", None)] * 3 + [("a", 1)] * 2, "g string, v int")
    got = sorted((str(r.g), str(r.v), r["rank"], r.n) for r in total_order(rows, ["v"], by=["g"], total="n").collect())
    assert got == [("None", "1", i, 5) for i in range(5)] + [("a", "1", i, 5) for i in (3, 4)] + [("a", "None", i, 5) for i in range(3)]
    assert total_order(rows.limit(0), ["v"]).count() == 0


def test_overlap_sends_digests_only(spark):
    from twinline.operators.joins import exclude_overlap

    long = "a sentence that is long enough to be seen " * 5
    rows = [(i, f"{long}{i % 50}" if i % 7 else None, f"out {i % 3}") for i in range(300)]
    big = spark.createDataFrame(rows, "row_id int, input string, output string")
    small = spark.createDataFrame([(f"{long}{i}", f"out {i}") for i in range(0, 50, 2)] + [(None, None)], "input string, output string")
    ins, outs = {f"{long}{i}" for i in range(0, 50, 2)} | {None}, {f"out {i}" for i in range(0, 50, 2)} | {None}
    want = sorted(r[0] for r in rows if not (r[1] in ins and r[2] in outs))
    for kind in (None, True, False):
        out = exclude_overlap(big, small, is_broadcast=kind)
        assert sorted(r.row_id for r in out.collect()) == want
    plan = exclude_overlap(big, small, is_broadcast=True)._jdf.queryExecution().optimizedPlan().toString()
    sides = [line for line in plan.splitlines() if "ResolvedHint" in line or "broadcast" in line.lower()]
    assert sides and not any("input#" in line or "output#" in line for line in sides if "Join" not in line)
    assert exclude_overlap(big.limit(0), small).count() == 0 and exclude_overlap(big, small.limit(0)).count() == 300


def test_packing_ranks_keys_only(spark):
    from twinline.operators.lm import pack_contiguous

    rows = spark.range(200).select(F.col("id").alias("row_id"), F.transform(F.sequence(F.lit(1), F.col("id") % 7 + 1), lambda i: F.concat(F.lit("w"), i)).alias("t"))
    out = pack_contiguous(rows, "t", 4, 10)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Sort " not in plan
    stream = [w for r in rows.orderBy("row_id").collect() for w in r.t]
    step = len(stream) // 4
    got = sorted((r.lane, r.chunk, r.data, r.target) for r in out.collect())
    want = []
    for lane in range(4):
        own = stream[lane * step : (lane + 1) * step]
        for c, start in enumerate(range(0, step - 1, 10)):
            n = min(10, step - 1 - start)
            want.append((lane, c, own[start : start + n], own[start + 1 : start + n + 1]))
    assert got == want


@pytest.mark.parametrize("header", [False, True])
def test_splits_are_ranked_in_blocks(spark, tmp_path, monkeypatch, header):
    from twinline.sources import quoted

    rng = random.Random(4)
    for name in ("a.tsv", "b.tsv"):
        (tmp_path / name).write_text("".join("\t".join(field(rng, "\t") for _ in range(2)) + "\n" for _ in range(60)))
    monkeypatch.setattr(quoted, "BLOCK", 4)
    read = read_quoted(spark, str(tmp_path), PAIRS, "\t", header).orderBy("row_id").select("input", "output").collect()
    want = [r for n in ("a.tsv", "b.tsv") for r in whole_file(spark, str(tmp_path / n), PAIRS, "\t", header).collect()]
    assert read == want
