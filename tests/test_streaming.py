"""The column functions hold no state, so they run on a stream as they are."""

from pyspark.sql import functions as F

from twinline.functions.clean import normalize_sentence
from twinline.functions.tokens import ngrams, split_ws


def test_cleaning_runs_on_a_stream(spark, tmp_path, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs.write.parquet(str(tmp_path / "in"))

    def clean(df):
        text = df.select("doc_id", normalize_sentence(F.col("text")).alias("text"))
        return text.withColumn("n", F.size(ngrams(split_ws(F.col("text")), 2)))

    stream = clean(spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in")))
    sink = stream.writeStream.format("memory").queryName("cleaned").trigger(availableNow=True).start()
    assert sink.awaitTermination(120)
    found = spark.table("cleaned")
    assert found.count() == docs.count() and found.exceptAll(clean(docs)).count() == 0
