import zlib

import brute
import pytest
from pyspark.sql import functions as F

from tidelake.llm import quality


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = {r.doc_id: r for r in quality.classify(docs, labels.select("doc_id", "quality"), sample=2000).select("doc_id", "score", "predicted").collect()}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    right = sum(got[i].predicted == truth[i] for i in held)
    assert right / len(held) > 0.95
    kept = [i for i in held if truth[i] == 1]
    assert sum(got[i].predicted for i in kept) / len(kept) > 0.97


def test_edge_rows(spark, documents, none):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (12, 0, 0), (4, 0, 1), (None, 1, 0), (3, None, 0), (12, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality.classify(documents.withColumnRenamed("n", "score"), labels).collect()
    assert len(rows) == 16
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    by_text = {}
    for r in rows:
        assert by_text.setdefault(r.text or "", r.score) == r.score
    assert quality.classify(none, labels).count() == 0
    flat = quality.classify(documents, labels.limit(0)).select("score").distinct().collect()
    assert [r.score for r in flat] == [pytest.approx(0.5)]


def test_scores_equal_a_dense_fit(spark):
    """The operator against plain loops over n-grams and a dense matrix of the same slots."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    got = {r.doc_id: r.score for r in quality.classify(docs, labels).collect()}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    want = brute.quality({r.doc_id: r.text for r in docs.collect()}, {i: y for i, y in truth.items() if zlib.crc32(str(i).encode()) % 5})
    assert got.keys() == want.keys()
    assert all(got[i] == pytest.approx(want[i], abs=1e-9) for i in got)


def test_sample_bounds_rows_and_ids_may_be_text(spark):
    rows = [(f"d{k % 40}", f"good words here {k % 40}" if k % 2 else f"bad bad bad {k % 40}") for k in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    labels = spark.createDataFrame([(f"d{k}", k % 2) for k in range(40)], "doc_id string, quality int")
    seen = []
    original = quality.fit
    try:
        quality.fit = lambda features, y, *a: (seen.append(len(features)), original(features, y, *a))[1]
        scored = quality.classify(docs, labels, sample=30)
    finally:
        quality.fit = original
    assert seen and seen[0] <= 30
    assert scored.agg(F.sum("predicted")).first()[0] == 2000
