import collections
import zlib

from pyspark.sql import functions as F

from twinline.llm.sharding import sharded, shuffle_to_shards

PLACE = ("_metadata.file_name", "_metadata.row_index")


def check_slots(rows, shards):
    slots = collections.defaultdict(list)
    for shard, slot in rows:
        slots[shard].append(slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(shards))
    sizes = [len(slots[s]) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1


def test_all_rows_in_even_shards(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    got = sharded(docs, F.struct(*PLACE)).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    check_slots([(r.shard, r.slot) for r in got], 24)
    for r in got:
        data = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 8, zlib.crc32(data), "rows", None)


def test_reruns_agree_however_the_scan_is_cut(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    first = sorted(map(tuple, sharded(docs, F.struct(*PLACE)).collect()))
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.files.maxPartitionBytes")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
        assert sorted(map(tuple, sharded(docs, F.struct(*PLACE)).collect())) == first
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    other, _, _ = shuffle_to_shards(docs, seed=99)
    assert sorted((r.shard, r.slot) for r in other.collect()) == sorted((r[4], r[5]) for r in first)


def test_order_is_a_uniform_shuffle(spark):
    docs = spark.range(4800).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    rows = shuffle_to_shards(docs, shards=8)[0].collect()
    place = {r.doc_id: r.shard * 600 + r.slot for r in rows}
    # Neighbours are dealt apart: the mean distance of two places among n is n / 3.
    apart = sum(abs(place[i] - place[i + 1]) for i in range(4799)) / 4799
    assert 1500 < apart < 1700
    # Each shard draws evenly from all stretches of the table.
    deals = collections.Counter((i // 600, place[i] // 600) for i in range(4800))
    assert min(deals.values()) > 40 and max(deals.values()) < 115


def test_odd_rows(odd_docs, no_docs):
    rows, shard, slot = shuffle_to_shards(odd_docs.withColumnRenamed("row", "shard"), shards=3)
    assert (shard, slot) == ("shard_", "slot")
    got = rows.collect()
    check_slots([(r.shard_, r.slot) for r in got], 3)
    same = [tuple(map(str, r)) for r in odd_docs.collect()]
    assert sorted(same) == sorted(tuple(map(str, r))[: len(same[0])] for r in rows.select(*odd_docs.drop("row").columns, "shard").collect())
    assert sorted(r.size for r in sharded(odd_docs).collect() if r.doc_id in (1, 2)) == [8, 8]
    assert sharded(no_docs).count() == 0


def test_one_repeated_row_is_dealt_to_all_buckets(spark):
    docs = spark.range(6000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("equal").alias("text"))
    got = sharded(docs).collect()
    check_slots([(r.shard, r.slot) for r in got], 24)


def test_files_are_in_slot_order(spark, tmp_path):
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    shuffle_to_shards(docs, shards=2, path=str(tmp_path / "out"))
    for r in spark.read.parquet(str(tmp_path / "out")).select("slot", "_metadata.file_path", "_metadata.row_index").groupBy("file_path").agg(
        F.array_sort(F.collect_list(F.struct("row_index", "slot"))).alias("rows")
    ).collect():
        slots = [x.slot for x in r.rows]
        assert slots == sorted(slots)


def test_no_python_in_plan(odd_docs):
    plan = sharded(odd_docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
