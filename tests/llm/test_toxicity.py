import subprocess
import sys
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from twinline.llm import toxicity as module
from twinline.llm.toxicity import toxicity
from twinline.llm.words import SLICE_BYTES


def test_held_out_accuracy(spark, make_text):
    rows, labels = [], []
    for i in range(900):
        toxic = i % 5 == 0
        text = make_text(i, 30 + i % 50)
        if toxic:
            words = text.split()
            words[3], words[11] = "dummkopf" if i % 2 else "blockhead", "you"
            text = " ".join(words)
        rows.append((i, text))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert {r.doc_id for r in got if r.held_out} == {r.doc_id for r in held} and len(got) == 900
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert sum(r.predicted == (r.doc_id % 5 == 0) for r in held) / len(held) > 0.95


def test_held_out_labels_change_nothing(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 0), (5, 1), (None, 1), (4, None)], "doc_id long, toxic int")
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted(map(str, toxicity(odd_docs, x).collect())) for x in (labels, flipped))
    assert a == b and len(a) == odd_docs.count()
    assert toxicity(no_docs, labels).count() == 0
    assert toxicity(odd_docs, labels.limit(0)).filter("predicted = 1").count() == 0


def test_workers_import_no_ml():
    code = "import sys, twinline.llm.toxicity; print([m for m in sys.modules if m.startswith('pyspark.ml') or m == 'pandas'])"
    root = module.__file__.rsplit("/twinline/", 1)[0]
    assert subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True).stdout.strip() == "[]"


def test_batches_come_back_in_parts(spark, make_text):
    rows = [(i, make_text(i, 200) * 9) for i in range(300)] + [(300, None), (301, ""), (302, "DU \u00c4RGERST mich, du \u00c4RGER \u0130")]
    batch = pa.RecordBatch.from_arrays([pa.array([r[1] for r in rows])], ["t"])
    parts = list(module._parts(batch, "t"))
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch])) and len(parts) > 5
    assert all(p.num_rows == 1 or sum(len(t or "") for t in p["t"].to_pylist()) < 2 * SLICE_BYTES for p in parts)
    assert [p.num_rows for p in module._parts(batch.slice(0, 0), "t")] == [0]

    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sent = docs.select("doc_id", module._own_lower(F.col("text")).alias("own"), module.lower(F.col("text")).alias("lowered")).collect()
    assert {r.doc_id for r in sent if r.own is not None} == {302} and all(r.own in (None, r.lowered) for r in sent)
    lexicon = np.sort(np.unique(module._hash_words([rows[0][1].lower(), "\u00e4rgerst"]))), np.ones(len(np.unique(module._hash_words([rows[0][1].lower(), "\u00e4rgerst"]))))
    found, column = module.add_features(docs.coalesce(1), lexicon, "text", ["doc_id"])
    got = {r.doc_id: r[column] for r in found.collect()}
    # As all texts at once, lowered by Spark, before.
    texts = pa.array([r[1] for r in rows])
    lowered = pa.array([r.lowered for r in sorted(sent, key=lambda r: r.doc_id)])
    want = module.features(texts, lowered, lexicon, module._hash_words(module.SECOND_PERSON))
    assert np.array_equal(np.array([got[i] for i in range(len(rows))]), want)
