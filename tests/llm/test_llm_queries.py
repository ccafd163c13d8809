"""The registered queries next to their SQL, and the pipeline against its stages, on the smallest tables."""

import os

import pytest

import __spark_entry__ as driver
import check
import corpus_pipeline
from meshloom.llm.queries import QUERIES
from meshloom.llm.shared import table

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


def test_one_query_per_operator():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 14)]
    assert set(QUERIES) | {"pipeline"} <= set(driver.queries())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    assert check.check(spark, SF_DIR, [name]) == 0


def test_pipeline(spark):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "line dedup", "near dedup", "source mix", "token packing"]
    docs = table(spark, SF_DIR, "documents")
    columns = docs.columns
    counts = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.cut_lineage(stage(spark, docs, SF_DIR))
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts[1] < counts[0] and counts[2] == counts[1] and counts[3] < counts[2]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR)
    whole = corpus_pipeline.run(spark, SF_DIR)
    assert sorted(r["doc_id"] for r in packed.select("doc_id").collect()) == sorted(r["doc_id"] for r in whole.select("doc_id").collect())
