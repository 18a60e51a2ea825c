import pytest
from oracle import compare, connect

import __spark_entry__ as entry
import corpus_pipeline
from twinline.llm.queries import ORACLES, QUERIES
from twinline.session import written


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, sf_dir, name):
    rows, problem = compare(spark, connect(sf_dir), entry.queries()[name], ORACLES.get(name), sf_dir)
    assert problem is None and rows > 0


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
        counts.append(docs.count())
        if name != "mixing":
            assert docs.columns == columns
    assert counts == sorted(counts, reverse=True) and counts[-1] == counts[-2] < counts[0] > 0.5 * counts[0]
    assert {"doc_id", "taken", "target"} <= set(docs.columns)
    assert "pipeline" in entry.queries()
