import re

import pytest
from pyspark.sql import functions as F

from tidelake.llm import mixing
from tidelake.session import Scratch

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes, most=3):
    """Shares by weight, what exceeds a cap being shared again among the others."""
    weight = {s: 1 + k % 3 for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, (s or "").encode())))}
    fixed, left = {}, set(sizes)
    total = sum(sizes.values())
    while True:
        rest, w = total - sum(fixed.values()), sum(weight[s] for s in left)
        over = [s for s in left if w and rest * weight[s] / w > most * sizes[s]]
        if not over:
            return fixed | {s: rest * weight[s] / w if w else 0.0 for s in left}
        for s in over:
            fixed[s] = most * sizes[s]
            left.discard(s)


def check(rows, whole_sources=True):
    sizes = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r._size
        assert r._size == len(WORDS.findall(r.text or ""))
        assert 0 <= r.taken <= 3 * r._size and (not r._size or r.taken % r._size == 0)
    want = targets(sizes)
    for s, size in sizes.items():
        own = [r for r in rows if r.source == s]
        assert {r.source_size for r in own} == {size}
        assert own[0].target == pytest.approx(want[s], rel=1e-9, abs=1e-9)
        if whole_sources:
            largest = max(r._size for r in own)
            assert abs(sum(r.taken for r in own) - want[s]) <= max(0.03 * want[s], 0.6 * largest)


def test_sample(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "source")
    first = mixing.taken(mixing.plan_mix(docs, Scratch(spark, "mix"), depth=3)).collect()
    check(first)
    again = mixing.taken(mixing.plan_mix(docs.repartition(5), Scratch(spark, "mix"), depth=3)).collect()
    key = lambda rows: sorted((r.doc_id, r.taken, str(r.draws)) for r in rows)
    assert key(first) == key(again)


def test_edge_rows(spark, documents, none):
    mix = mixing.plan_mix(documents, Scratch(spark, "mix"), depth=2)
    rows = mixing.taken(mix).collect()
    assert len(rows) == 16
    check(rows, whole_sources=False)
    out = mixing.mixed(mix, documents.columns)
    assert out.count() == sum(len(r.draws) for r in rows)
    shards = {r._shard: r.n for r in out.groupBy("_shard").agg(F.count("*").alias("n")).collect()}
    assert set(shards) <= set(range(4))
    assert mixing.taken(mixing.plan_mix(none, Scratch(spark, "mix"), depth=2)).count() == 0


def test_shards_follow_the_total(spark, documents, monkeypatch):
    """No part of a shard is far above SHARD_WORDS, and neither shards nor parts change what is taken."""
    docs = documents.select("doc_id", "text", "source")
    taken = lambda mix: sorted((str(r.doc_id), r.text or "", r.taken) for r in mixing.taken(mix).collect())
    one = mixing.plan_mix(docs, Scratch(spark, "mix"))
    assert one.parts == 1 and {r._shard for r in mixing.mixed(one, ["doc_id"]).collect()} == {0}
    monkeypatch.setattr(mixing, "SHARD_WORDS", 1 << 11)
    monkeypatch.setattr(mixing, "MOST_DEPTH", 2)
    many = mixing.plan_mix(docs, Scratch(spark, "mix"))
    assert taken(one) == taken(many)
    rows = mixing.mixed(many, ["doc_id", "text"]).collect()
    assert many.parts > 4 and {r._shard for r in rows} <= set(range(4)) and max(r._part for r in rows) < many.parts
    assert len(rows) == mixing.mixed(one, ["doc_id"]).count()


def test_tree_splits_quotas_exactly(spark):
    row = spark.createDataFrame([([700, 3, 0, 41],)], "quotas array<long>")
    leaves = mixing._shards(row, 5, 4).collect()
    assert len(leaves) == 16
    assert [sum(x) for x in zip(*(r.quotas for r in leaves), strict=True)] == [700, 3, 0, 41]
    assert max(sum(r.quotas) for r in leaves) - min(sum(r.quotas) for r in leaves) <= 1


def test_native_plan(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = mixing.taken(mixing.plan_mix(docs, Scratch(spark, "mix"), depth=2))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
