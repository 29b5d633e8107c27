import brute
import numpy as np
import pytest

from tidelake.llm import epsgrid, hnsw
from tidelake.session import Scratch

ROW = "vec_id long, embedding array<float>"


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(5)
    rows = []
    for k in range(30):
        center = rng.normal(size=24)
        for _ in range(rng.integers(1, 25)):
            rows.append((center + rng.normal(size=24) * rng.choice([0, 0.1, 0.2, 0.4, 0.6])).astype(np.float32))
    rows += [rows[0]] * 40 + [(rows[1] * 2).astype(np.float32)]
    return [(k, v.tolist()) for k, v in enumerate(rows)]


ODD = [
    (9001, None), (9002, []), (9003, [0.0] * 24), (9004, [float("nan")] * 24), (9005, [1.0] * 23 + [None]), (9006, [float("inf")] + [1.0] * 23), (9007, [1.0, 2.0]), (9008, [2.0, 4.0]), (None, [3.0, 5.0]),
]


def test_near_duplicates(spark, scratch, vectors):
    df = spark.createDataFrame(vectors + ODD, ROW).repartition(4)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in epsgrid.near_duplicates(df, scratch).collect()}
    s = brute.cosine([v for _, v in vectors])
    near = np.abs(s - 0.95) > 1e-9
    assert near.all()
    links = s >= 0.95
    np.fill_diagonal(links, False)
    u = brute.Union()
    for i, j in zip(*np.nonzero(links), strict=True):
        u.join(int(i), int(j))
    want = {k: (int(links[k].sum()), u.find(k), u.find(k) == k) for k in range(len(vectors))}
    want |= {i: (0, i, True) for i in range(9001, 9007)} | {9007: (2, 9007, True), 9008: (2, 9007, False), None: (2, 9007, False)}
    # (1, 2) and (2, 4) have cosine 1, (3, 5) 0.997 with both.
    assert got == want
    assert epsgrid.near_duplicates(spark.createDataFrame([], ROW), Scratch(spark, "test")).count() == 0


def test_many_blocks_and_shards(spark, vectors, monkeypatch):
    """Small blocks and shards give the links of large ones, and all but the same neighbours."""
    df = spark.createDataFrame(vectors + ODD, ROW).repartition(4)
    queries = df.where("vec_id % 10 = 0").withColumnRenamed("vec_id", "query_id")
    links = lambda: sorted(map(str, epsgrid.near_duplicates(df, Scratch(spark, "test")).collect()))
    found = lambda: {(r.query_id, r["rank"]): r.score for r in hnsw.nearest(df, queries, Scratch(spark, "test")).collect()}
    whole, best = links(), found()
    monkeypatch.setattr(epsgrid, "BLOCK", 40)
    monkeypatch.setattr(hnsw, "SHARD", 60)
    monkeypatch.setattr(hnsw, "QUERIES", 7)
    assert links() == whole
    again = found()
    assert again.keys() == best.keys()
    assert sum(again[k] >= best[k] - 1e-12 for k in best) >= 0.95 * len(best)


def test_blocks_and_recursion(monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 16))
    x[150:] = x[:150] + rng.normal(size=(150, 16)) * 0.08
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    order = np.argsort(x[:, 0])
    x = x[order]
    monkeypatch.setattr(epsgrid, "LEAF", 16)
    side = lambda part: epsgrid._Side(np.arange(len(part)).tobytes(), np.ones(len(part), np.int64).tobytes(), part[:, :6].copy().tobytes(), part.tobytes())
    e = np.sqrt(2 - 2 * 0.95)
    whole, s = side(x), x @ x.T >= 0.95
    pairs = {(int(i), int(j)) for a, b in epsgrid._join(whole, whole, True, 0.95, e) for i, j in zip(a, b, strict=True)}
    assert pairs == {(i, j) for i in range(300) for j in range(i + 1, 300) if s[i, j]}
    left, right = side(x[:140]), side(x[140:])
    pairs = {(int(i), int(j) + 140) for a, b in epsgrid._join(left, right, False, 0.95, e) for i, j in zip(a, b, strict=True)}
    assert pairs == {(i, j) for i in range(140) for j in range(140, 300) if s[i, j]}


def test_nearest(spark, scratch, vectors):
    df = spark.createDataFrame(vectors + ODD, ROW).repartition(4)
    queries = df.where("vec_id % 10 = 0").withColumnRenamed("vec_id", "query_id")
    got = {}
    for r in hnsw.nearest(df, queries, scratch).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    s, hits, total = brute.cosine([v for _, v in vectors]), 0, 0
    for k in range(0, len(vectors), 10):
        own = sorted(got[k])
        assert [r for r, _, _ in own] == [1, 2, 3, 4, 5]
        assert k not in [v for _, v, _ in own]
        for _, v, score in own:
            assert score == pytest.approx(s[k, v], abs=1e-12)
        assert own == sorted(own, key=lambda x: (-x[2], x[1]))
        want = [j for j in np.lexsort((np.arange(len(vectors)), -np.round(s[k], 12))) if j != k][:5]
        hits, total = hits + len(set(want) & {v for _, v, _ in own}), total + 5
    assert hits / total >= 0.95
    assert hnsw.nearest(spark.createDataFrame([], ROW), spark.createDataFrame([], "query_id long, embedding array<float>"), Scratch(spark, "test")).count() == 0


def test_graph_recall():
    rng = np.random.default_rng(11)
    x = rng.normal(size=(1500, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = hnsw.Graph.build(x, rng.integers(1, 2**62, 1500))
    hits = 0
    for k in range(0, 1500, 15):
        want = set(np.argsort(-(x @ x[k]))[:6].tolist())
        hits += len(want & {n for _, n in graph.search(x[k], hnsw.SEARCH)[:6]})
    assert hits / 600 >= 0.95


def test_nearest_of_one_direction(spark, scratch):
    """Proportional vectors tie; the smallest ids win, however many there are."""
    rows = [(300 - k, [float(k), 2.0 * k, 5.0 * k]) for k in range(1, 201)] + [(1000, [1.0, 2.0, 4.0])]
    df = spark.createDataFrame(rows, ROW).repartition(3)
    queries = df.where("vec_id in (150, 1000)").withColumnRenamed("vec_id", "query_id")
    got = {}
    for r in hnsw.nearest(df, queries, scratch).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {150: [100, 101, 102, 103, 104], 1000: [100, 101, 102, 103, 104]}
