"""Approximate nearest neighbours: a navigable small-world graph for each shard.

Vectors are dealt by hash into shards of about `SHARD`; those of one direction, which have
the same cosine with any other, are one node.  A
shard's graph is hierarchical: each node has a random top level, each level a flat array
of neighbours (n rows of a fixed width, -1 for none).  Graphs and blocks of queries are
rows; each pair of a shard and a block is searched by itself, and the shards' best are
merged by a ranked window, which keeps the best of each task before it shuffles.

Every vector is in the index, no matter how many there are; a shard's size and a block's
are fixed, so memory is too.  Each query goes to every shard and each graph to every block,
so shards and blocks are as large as a task can well hold: a search costs the logarithm
of a shard's size, and what is sent falls with both sizes.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelake.llm.vectors import cosines, keyed, matrix, units
from tidelake.session import Scratch

SHARD = 32768
QUERIES = 8192
WIDTH = 16
BUILD = 64
SEARCH = 512


class Graph:
    """levels[l] holds the neighbours of each node on level l, 2 * WIDTH on the lowest."""

    def __init__(self, unit: np.ndarray, levels: list[np.ndarray], entry: int):
        self.unit, self.levels, self.entry = unit, levels, entry

    def _layer(self, q: np.ndarray, entries: list[tuple[float, int]], ef: int, level: int) -> list[tuple[float, int]]:
        """The ef most similar nodes found on a level, as (similarity, node), best first."""
        neighbours, unit = self.levels[level], self.unit
        seen = {k for _, k in entries}
        todo = [(-s, k) for s, k in entries]
        best = list(entries)
        heapq.heapify(todo)
        heapq.heapify(best)
        while todo:
            s, k = heapq.heappop(todo)
            if -s < best[0][0] and len(best) >= ef:
                break
            fresh = [n for n in neighbours[k].tolist() if n >= 0 and n not in seen]
            if not fresh:
                continue
            seen.update(fresh)
            for sim, n in zip((unit[fresh] @ q).tolist(), fresh, strict=True):
                if len(best) < ef:
                    heapq.heappush(best, (sim, n))
                    heapq.heappush(todo, (-sim, n))
                elif sim > best[0][0]:
                    heapq.heapreplace(best, (sim, n))
                    heapq.heappush(todo, (-sim, n))
        return sorted(best, reverse=True)

    def search(self, q: np.ndarray, ef: int) -> list[tuple[float, int]]:
        found = [(float(self.unit[self.entry] @ q), self.entry)]
        for level in range(len(self.levels) - 1, 0, -1):
            found = self._layer(q, found, 1, level)[:1]
        return self._layer(q, found, ef, 0)

    def _diverse(self, found: list[tuple[float, int]], width: int) -> list[int]:
        """Of nodes, best first, those that are nearer to the new node than to any chosen one."""
        nodes = [k for _, k in found]
        among = self.unit[nodes] @ self.unit[nodes].T
        nearest = np.full(len(nodes), -np.inf)
        chosen: list[int] = []
        for at, (sim, _) in enumerate(found):
            if nearest[at] < sim:
                chosen.append(at)
                if len(chosen) == width:
                    break
                nearest = np.maximum(nearest, among[at])
        if len(chosen) < width:  # fill up with the nearest of the others
            have = set(chosen)
            chosen += [at for at in range(len(nodes)) if at not in have][: width - len(chosen)]
        return [nodes[at] for at in chosen]

    def _link(self, level: int, node: int, other: int) -> None:
        row = self.levels[level][node]
        free = np.flatnonzero(row < 0)
        if len(free):
            row[free[0]] = other
            return
        nodes = [*row.tolist(), other]
        sims = (self.unit[nodes] @ self.unit[node]).tolist()
        row[:] = self._diverse(sorted(zip(sims, nodes, strict=True), reverse=True), len(row))

    @classmethod
    def build(cls, unit: np.ndarray, keys: np.ndarray) -> Graph:
        """Insert the rows in order; a node's top level comes from its key."""
        n = len(unit)
        uniform = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(11)).astype(np.float64) + 1) / 2.0**53
        top = np.minimum(-np.log(uniform) / math.log(WIDTH), 12).astype(int)
        levels = [np.full((n, WIDTH * (2 if level == 0 else 1)), -1, np.int32) for level in range(int(top.max()) + 1)]
        graph = cls(unit, levels, 0)
        for k in range(1, n):
            q, found = unit[k], [(float(unit[graph.entry] @ unit[k]), graph.entry)]
            for level in range(int(top[graph.entry]), -1, -1):
                if level > top[k]:
                    found = graph._layer(q, found, 1, level)[:1]
                    continue
                found = graph._layer(q, found, BUILD, level)
                near = graph._diverse(found, WIDTH)
                levels[level][k, : len(near)] = near
                for other in near:
                    graph._link(level, other, k)
            if top[k] > top[graph.entry]:
                graph.entry = k
        return graph


_GRAPH = "shard int, n int, dim int, entry int, depth int, cids binary, vectors binary, neighbours binary"
_GRAPH_TYPE = pa.schema(
    [(c, pa.int32()) for c in ("shard", "n", "dim", "entry", "depth")] + [(c, pa.binary()) for c in ("cids", "vectors", "neighbours")]
)


def build_graphs(classes: DataFrame) -> DataFrame:
    """One row for each (shard, dim): its vectors and flat neighbour arrays, lowest level first."""

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("cid").combine_chunks()
        x = matrix(table.column("embedding").combine_chunks())
        cids = table.column("cid").to_numpy()
        graph = Graph.build(units(x), cids)
        row = {
            "shard": table.column("shard")[0].as_py(),
            "n": len(x),
            "dim": x.shape[1],
            "entry": graph.entry,
            "depth": len(graph.levels),
            "cids": cids.tobytes(),
            "vectors": x.tobytes(),
            "neighbours": b"".join(level.tobytes() for level in graph.levels),
        }
        return pa.Table.from_pylist([row], _GRAPH_TYPE)

    return classes.select("shard", "dim", "cid", "embedding").groupBy("shard", "dim").applyInArrow(build, _GRAPH)


def _search(graph: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    kind = pa.schema([("query_id", pa.int64()), ("cid", pa.int64()), ("score", pa.float64())])
    if not graph.num_rows or not queries.num_rows:
        return kind.empty_table()
    row = graph.to_pylist()[0]
    n, dim = row["n"], row["dim"]
    x = np.frombuffer(row["vectors"]).reshape(n, dim)
    flat, levels = np.frombuffer(row["neighbours"], np.int32), []
    for level in range(row["depth"]):
        width = WIDTH * (2 if level == 0 else 1)
        levels.append(flat[: n * width].reshape(n, width))
        flat = flat[n * width :]
    searcher = Graph(units(x), levels, row["entry"])
    cids = np.frombuffer(row["cids"], np.int64)
    wanted = matrix(queries.column("embedding").combine_chunks())
    names = queries.column("query_id").to_numpy()
    ids, found, scores = [], [], []
    for name, q, u in zip(names, wanted, units(wanted), strict=True):
        nodes = np.array([node for _, node in searcher.search(u, SEARCH)])
        score = cosines(x[nodes], np.broadcast_to(q, (len(nodes), dim)))
        if len(nodes) > k:  # all that tie with the k-th stay, as their smallest vec_id decides
            best = score >= np.partition(score, -k)[-k]
            nodes, score = nodes[best], score[best]
        ids.append(np.full(len(nodes), name))
        found.append(cids[nodes])
        scores.append(score)
    return pa.Table.from_arrays([pa.array(np.concatenate(a)) for a in (ids, found, scores)], schema=kind)


def nearest(embeddings: DataFrame, queries: DataFrame, scratch: Scratch, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of `queries` (query_id, embedding) the
    k vectors of largest cosine found, ties to the smaller vec_id.

    A query's own vec_id is no candidate of it.  Vectors that are null, empty, zero or hold
    null or non-finite components take no part, nor do rows without a vec_id; vectors of
    other lengths than the query's are no candidates.  A query with fewer candidates
    than k gets all that are found, one without candidates no rows."""
    rows = keyed(embeddings.where("vec_id is not null")).where("cid is not null")
    largest = F.array_max(F.transform("embedding", F.abs))
    # As units() does first; proportional vectors have the same quotients.
    rows = rows.withColumn("cid", F.xxhash64(F.size("embedding"), F.transform("embedding", lambda c: c / largest)))
    rows = scratch.write(rows, "rows")
    # The smallest k + 1 ids of one direction are all that can be among k results besides the query.
    same = Window.partitionBy("cid").orderBy("vec_id")
    lowest = rows.select("cid", "vec_id").distinct().withColumn("r", F.row_number().over(same)).where(F.col("r") <= k + 1)
    members = scratch.write(lowest.groupBy("cid").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "members")
    classes = rows.groupBy("cid").agg(F.first("embedding").alias("embedding"))
    classes = scratch.write(classes.withColumn("dim", F.size("embedding")), "classes")
    n = classes.count()
    shards = max(1, math.ceil(n / SHARD))
    dealt = classes.withColumn("shard", F.pmod(F.xxhash64(F.lit(3), "cid"), F.lit(shards)).cast("int"))
    graphs = scratch.write(build_graphs(dealt), "graphs")

    wanted = keyed(queries.select(F.col("query_id").alias("vec_id"), "embedding")).where("cid is not null and vec_id is not null")
    wanted = scratch.write(wanted.select(F.col("vec_id").alias("query_id"), "embedding", F.size("embedding").alias("dim")).dropDuplicates(), "queries")
    blocks = max(1, math.ceil(wanted.count() / QUERIES))
    asked = wanted.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    offered = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    key = ["shard", "dim", "block"]
    schema = "query_id long, cid long, score double"

    def search(graph: pa.Table, some: pa.Table) -> pa.Table:
        return _search(graph, some, k + 1)

    found = offered.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(search, schema)
    found = scratch.write(found, "found")
    found = found.join(members, "cid")
    found = found.select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id").distinct()
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")
