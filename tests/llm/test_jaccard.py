import random

import brute
import pytest

from tidelake.llm import jaccard
from tidelake.llm.components import connected_components
from tidelake.session import Scratch


def as_dict(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


@pytest.mark.parametrize(("width", "percent"), [(3, 90)])
def test_sample_equals_brute_force(spark, scratch, width, percent):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    want = brute.jaccard([tuple(r) for r in docs.collect()], width, percent)
    assert as_dict(jaccard.link_components(docs, scratch, width, percent)) == want


def test_large_group_of_near_copies(spark, scratch):
    rng = random.Random(4)
    base = [f"b{k}" for k in range(60)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 6])):
            words[rng.randrange(60)] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert as_dict(jaccard.link_components(df, scratch, 5, 80)) == brute.jaccard(rows, 5, 80)


def test_edge_rows(spark, scratch, documents, none):
    rows = jaccard.link_components(documents, scratch, 3, 90).collect()
    assert len(rows) == 16
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in rows}
    want = brute.jaccard([(r.doc_id, r.text) for r in documents.collect() if r.doc_id is not None], 3, 90)
    assert {k: v for k, v in got.items() if k is not None} == want
    assert got[None] == (3, None) and got[5] == (0, 5) and got[6] == (0, 6)
    assert got[8][1] == got[7][1] == 7
    assert jaccard.link_components(none, Scratch(spark, "test"), 3, 90).count() == 0


def test_components(spark, scratch):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1040)] + [(5, 5), (None, 1)]
    u = brute.Union()
    for a, b in edges:
        if a is not None and a != b:
            u.join(a, b)
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), scratch, "c").collect()}
    assert got == {k: u.find(k) for k in got}
    assert set(got) == {x for a, b in edges if a is not None and a != b for x in (a, b)}


def test_levels_count_every_shingle(spark):
    """A passage that each task sees once counts as one that one task sees four times."""
    rows = [(k, "a passage that all texts share " + " ".join(f"w{k}x{i}" for i in range(20))) for k in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    thin, dense = (jaccard.frequency_levels(df.repartitionByRange(n, "doc_id"), 3) for n in (4, 1))
    assert (thin == dense).all() and (thin == 3).sum() == 4
