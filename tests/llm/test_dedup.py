"""Names, nulls and repeats in the deduplications, and chunks of bounded size."""

import pytest
from pyspark.sql import functions as F

from quern.llm import common, exact_dedup, minhash_dedup
from quern.llm.exact_dedup import exact_groups
from quern.llm.minhash_dedup import near_components, near_dedup
from tests.llm.test_operators import brute_components

SMALL = "/root/testdata/sf0.001"
SAME = "one two three four five six seven eight"


def odd(spark):
    rows = [(None, SAME), (None, SAME + " nine"), (None, "quite another text"), (3, SAME), (3, SAME), (3, "something else that shares the id"), (2, SAME + "  "), (4, ""), (4, None), (5, None), (5, "")]
    return spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, __lost int, __T1 int, rep int")


def test_near_dedup_of_null_and_repeated_ids(spark):
    docs = odd(spark)
    kept = near_dedup(docs)
    # 2 names the group; rows of 3 with its text go together, so does the row without an id of the same text.
    want = [(2, SAME + "  "), (3, "something else that shares the id"), (4, ""), (4, None), (5, None), (5, ""), (None, "quite another text"), (None, SAME + " nine")]
    assert kept.columns == docs.columns and sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(want, key=str)
    assert near_dedup(docs, broadcast_rows=0).count() == len(want) and near_dedup(docs.limit(0)).count() == 0


def test_small_chunks_change_nothing(spark, monkeypatch):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    docs = docs.unionAll(docs.withColumn("doc_id", F.col("doc_id") + 500)).coalesce(2)
    want = brute_components([(r.doc_id, r.text) for r in docs.collect()], 4)
    groups = {(r.doc_id, r.keep_id, r.group_size) for r in exact_groups(docs).collect()}
    monkeypatch.setattr(minhash_dedup, "BROADCAST_ROWS", 0), monkeypatch.setattr(minhash_dedup, "STAR_ROWS", 50), monkeypatch.setattr(exact_dedup, "CHUNK", 40)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "30")
    try:
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_components(docs, words=4).collect()} == want
        assert {(r.doc_id, r.keep_id, r.group_size) for r in exact_groups(docs).collect()} == groups
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Elsewhere:
        master = "spark://somewhere:7077"
        sparkContext = property(lambda self: self)
        conf = property(lambda self: self)
        _jsc = property(lambda self: self)
        get = staticmethod(lambda *a: None)
        sc = getCheckpointDir = lambda self: self
        isEmpty = staticmethod(lambda: True)

    with pytest.raises(RuntimeError, match="checkpoint"):
        common.shared_folder(Elsewhere())
