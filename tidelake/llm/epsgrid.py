"""Embedding near-duplicates by an epsilon grid order join.

On unit vectors, cosine >= t means a distance of at most e = sqrt(2 - 2t).  Vectors are
rotated to principal dimensions, put into grid cells of width e on the leading ones, and
sorted by cell; the sorted sequence is cut into blocks.  Two blocks can hold a link only
if their cells adjoin on the two leading dimensions and their bounding boxes are within
e; other pairs of blocks are never formed.  A pair of blocks is joined by halving the
larger interval again and again, and skipping halves whose boxes are farther than e.
Boxes span the leading dimensions and the norm of what is left, as two vectors are no
nearer than these norms differ.

A block's vectors are sent once for each pair that it is in.  Where vectors fill the
sphere evenly, no box is small in more than a few dimensions and most pairs of blocks
stay, so blocks are as large as a task can well hold: what is sent falls with their size.

The rotation is fitted on a sample of `FIT` vectors; it orders and skips, and being a
rotation it can lose no link.  Equal vectors are one class with a weight.  A pair of
blocks returns each vector's number of links and a spanning forest of the links, not the
links themselves, so a large group of copies stays linear in size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelake.llm.components import connected_components
from tidelake.llm.vectors import keyed, matrix, units
from tidelake.session import Scratch

FIT = 4096
LEADING = 12
BLOCK = 8192
LEAF = 96
_HELD = 1 << 18


def principal(classes: DataFrame, dimension: int) -> np.ndarray:
    """A rotation to principal dimensions, by the covariance of a sample in hash order."""
    rows = classes.where(F.col("dim") == dimension).select("cid", "embedding").orderBy("cid").limit(FIT)
    x = units(matrix(rows.toArrow().column("embedding").combine_chunks()))
    _, vectors = np.linalg.eigh(np.cov(x.T) if len(x) > 1 else np.eye(dimension))
    return vectors[:, ::-1]


def _order(classes: DataFrame, rotation: np.ndarray | None, main: int, e: float) -> DataFrame:
    """(dim, cells..., place, cid, n, unit, lead): the key of the epsilon grid order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim in np.unique(batch.column("dim").to_numpy()):
                part = batch.filter(pa.array(batch.column("dim").to_numpy() == dim))
                u = units(matrix(part.column("embedding")))
                turned = u @ rotation if dim == main and rotation is not None else u
                rest = np.sqrt((turned[:, LEADING:] ** 2).sum(axis=1, keepdims=True))
                lead = np.hstack([turned[:, :LEADING], rest])
                cells = np.zeros((len(u), 4), np.int32)
                cells[:, : min(4, int(dim))] = np.floor(turned[:, :4] / e)
                width = lead.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("dim"),
                        *[pa.array(cells[:, k]) for k in range(4)],
                        pa.array(np.ascontiguousarray(lead[:, 0])),
                        part.column("cid"),
                        part.column("n"),
                        pa.FixedSizeListArray.from_arrays(pa.array(u.ravel()), int(dim)).cast(pa.list_(pa.float64())),
                        pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(lead).ravel()), width).cast(pa.list_(pa.float64())),
                    ],
                    ["dim", "c0", "c1", "c2", "c3", "place", "cid", "n", "unit", "lead"],
                )

    schema = "dim int, c0 int, c1 int, c2 int, c3 int, place double, cid long, n long, unit array<double>, lead array<double>"
    return classes.select("dim", "cid", "n", "embedding").mapInArrow(run, schema)


def _blocks(ordered: DataFrame) -> DataFrame:
    """Cut each partition's sequence into blocks of at most `BLOCK` vectors of one dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        waiting: list[pa.RecordBatch] = []

        def cut(rows: pa.Table) -> pa.RecordBatch:
            nonlocal number
            lead = matrix(rows.column("lead").combine_chunks())
            cells = np.unique(np.stack([rows.column(c).to_numpy() for c in ("c0", "c1")], axis=1), axis=0)
            row = {
                "block": number,
                "dim": rows.column("dim")[0].as_py(),
                "cells": [{"c0": int(a), "c1": int(b)} for a, b in cells],
                "lo": lead.min(axis=0).tolist(),
                "hi": lead.max(axis=0).tolist(),
                "cids": rows.column("cid").to_numpy().tobytes(),
                "ns": rows.column("n").to_numpy().tobytes(),
                "lead": lead.tobytes(),
                "unit": matrix(rows.column("unit").combine_chunks()).tobytes(),
            }
            number += 1
            return pa.RecordBatch.from_pylist([row], _block_type())

        for batch in batches:
            waiting.append(batch)
            while waiting:
                rows = pa.Table.from_batches(waiting)
                dims = rows.column("dim").to_numpy()
                other = np.flatnonzero(dims != dims[0])
                end = int(other[0]) if len(other) else len(dims)
                if end >= BLOCK or end < len(dims):
                    size = min(end, BLOCK)
                    yield cut(rows.slice(0, size))
                    waiting = rows.slice(size).to_batches()
                else:
                    break
        if waiting:
            yield cut(pa.Table.from_batches(waiting))

    return ordered.mapInArrow(run, _BLOCK_SCHEMA)


_BLOCK_SCHEMA = (
    "block long, dim int, cells array<struct<c0:int,c1:int>>, lo array<double>, hi array<double>, "
    "cids binary, ns binary, lead binary, unit binary"
)


def _block_type() -> pa.Schema:
    cell = pa.struct([("c0", pa.int32()), ("c1", pa.int32())])
    doubles = pa.list_(pa.float64())
    return pa.schema(
        [("block", pa.int64()), ("dim", pa.int32()), ("cells", pa.list_(cell)), ("lo", doubles), ("hi", doubles)]
        + [(c, pa.binary()) for c in ("cids", "ns", "lead", "unit")]
    )


class _Side:
    def __init__(self, cids: bytes, ns: bytes, lead: bytes, unit: bytes):
        self.cids, self.ns = np.frombuffer(cids, np.int64), np.frombuffer(ns, np.int64)
        n = len(self.cids)
        self.lead, self.unit = np.frombuffer(lead).reshape(n, -1), np.frombuffer(unit).reshape(n, -1)


def _apart(a: np.ndarray, b: np.ndarray, e: float) -> bool:
    """The bounding boxes of two sets of points are farther apart than e (and a rounding's worth)."""
    gap = np.maximum(0, np.maximum(a.min(axis=0) - b.max(axis=0), b.min(axis=0) - a.max(axis=0)))
    return float(gap @ gap) > (e * e) * (1 + 1e-9) + 1e-12


def _join(x: _Side, y: _Side, same: bool, t: float, e: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (in x, in y) of linked pairs, each once; in one block, i < j."""
    todo = [((0, len(x.cids)), (0, len(y.cids)))]
    while todo:
        (a, b), (c, d) = todo.pop()
        if same and a >= d:
            continue
        if _apart(x.lead[a:b], y.lead[c:d], e):
            continue
        if max(b - a, d - c) > LEAF:
            if b - a >= d - c:
                mid = (a + b) // 2
                todo += [((a, mid), (c, d)), ((mid, b), (c, d))]
            else:
                mid = (c + d) // 2
                todo += [((a, b), (c, mid)), ((a, b), (mid, d))]
            continue
        i, j = np.nonzero(x.unit[a:b] @ y.unit[c:d].T >= t)
        i, j = i + a, j + c
        if same:
            i, j = i[i < j], j[i < j]
        if len(i):
            yield i, j


def _gathered(pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same pairs in arrays of at least `_HELD`, but for the last."""
    held, size = [], 0
    for i, j in pairs:
        held.append((i, j))
        size += len(i)
        if size >= _HELD:
            yield np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
            held, size = [], 0
    if held:
        yield np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest place reachable from each place."""
    root = np.arange(n)
    while True:
        before = root.copy()
        least = np.minimum(root[i], root[j])
        np.minimum.at(root, i, least)
        np.minimum.at(root, j, least)
        root = root[root]
        if (root == before).all():
            return root


def _linked(pairs: DataFrame, t: float, e: float) -> DataFrame:
    """(a, b, w): b null: w more links of a; else a link that keeps a and b in one component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                row = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                x = _Side(*(row[f"{c}_x"] for c in ("cids", "ns", "lead", "unit")))
                same = row["x"] == row["y"]
                y = x if same else _Side(*(row[f"{c}_y"] for c in ("cids", "ns", "lead", "unit")))
                n, m = len(x.cids), 0 if same else len(y.cids)
                ids, weights = (x.cids, x.ns) if same else (np.append(x.cids, y.cids), np.append(x.ns, y.ns))
                links, root = np.zeros(n + m, np.int64), np.arange(n + m)
                for i, j in _gathered(_join(x, y, same, t, e)):
                    j = j if same else j + n
                    for a, b in ((i, j), (j, i)):
                        links += np.bincount(a, weights[b], n + m).astype(np.int64)
                    root = _forest(n + m, np.concatenate([i, np.arange(n + m)]), np.concatenate([j, root]))
                have, child = np.flatnonzero(links), np.flatnonzero(root != np.arange(n + m))
                if len(have):
                    a = np.append(ids[have], ids[child])
                    b = pa.array(np.append(np.zeros(len(have), np.int64), ids[root[child]]), mask=np.arange(len(a)) < len(have))
                    w = np.append(links[have], np.zeros(len(child), np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(a), b, pa.array(w)], ["a", "b", "w"])

    return pairs.mapInArrow(run, "a long, b long, w long")


def near_duplicates(embeddings: DataFrame, scratch: Scratch, threshold: float = 0.95) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of `embeddings`.

    Vectors that are null, empty, zero or hold null or non-finite components link with
    nothing, nor do vectors of different lengths.  Equal vectors link with each other.
    component_id is the smallest vec_id reachable; kept says that it is the row's own.  Rows
    that repeat a vec_id are vectors of their own; a null vec_id is never the smallest,
    and kept is false for it."""
    e = math.sqrt(max(0.0, 2 - 2 * threshold))
    rows = scratch.write(keyed(embeddings), "rows")
    some = rows.where("cid is not null")
    classes = some.groupBy("cid").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("low"), F.first("embedding").alias("embedding"))
    classes = scratch.write(classes.withColumn("dim", F.size("embedding")), "classes")
    dims = classes.groupBy("dim").agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("k"), "dim").limit(1).collect()
    main = dims[0]["dim"] if dims else 0
    total = dims[0]["k"] if dims else 0
    rotation = principal(classes, main) if dims else None
    ordered = _order(classes, rotation, main, e)
    key = ["dim", "c0", "c1", "c2", "c3", "place", "cid"]
    parts = max(1, math.ceil(total / (2 * BLOCK)))
    ordered = scratch.write(ordered, "ordered").repartitionByRange(parts, *key).sortWithinPartitions(*key)
    # Neighbouring ranges together where there are more than asked for, as short blocks make many pairs.
    blocks = scratch.write(_blocks(ordered.coalesce(parts)), "blocks")

    # Pairs of blocks: cells that adjoin on two dimensions, and boxes within e.
    boxes = blocks.select("block", "dim", "cells", "lo", "hi")
    own = boxes.select(F.col("block").alias("x"), "dim", F.col("lo").alias("lo_x"), F.col("hi").alias("hi_x"), F.explode("cells").alias("c"))
    own = own.select("x", "dim", "lo_x", "hi_x", F.col("c.c0").alias("c0"), F.col("c.c1").alias("c1"))
    step = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    near = boxes.select(F.col("block").alias("y"), "dim", F.col("lo").alias("lo_y"), F.col("hi").alias("hi_y"), F.explode("cells").alias("c"))
    near = near.withColumn("d0", F.explode(step)).withColumn("d1", F.explode(step))
    near = near.select("y", "dim", "lo_y", "hi_y", (F.col("c.c0") + F.col("d0")).alias("c0"), (F.col("c.c1") + F.col("d1")).alias("c1")).distinct()
    gap = F.transform(
        F.arrays_zip("lo_x", "hi_x", "lo_y", "hi_y"),
        lambda b: F.greatest(F.lit(0.0), b["lo_x"] - b["hi_y"], b["lo_y"] - b["hi_x"]),
    )
    far = F.aggregate(gap, F.lit(0.0), lambda s, g: s + g * g) > e * e * (1 + 1e-9) + 1e-12
    pairs = own.join(near, ["dim", "c0", "c1"]).where(F.expr("x <= y") & ~far).select("x", "y").distinct()
    pairs = scratch.write(pairs, "pairs")
    held = ["cids", "ns", "lead", "unit"]
    left = blocks.select(F.col("block").alias("x"), *[F.col(c).alias(f"{c}_x") for c in held])
    right = blocks.select(F.col("block").alias("y"), *[F.col(c).alias(f"{c}_y") for c in held])
    linked = scratch.write(_linked(pairs.join(left, "x").join(right, "y"), threshold, e), "linked")

    found = connected_components(linked.where("b is not null").select("a", "b"), scratch, "components")
    counts = linked.where("b is null").groupBy("a").agg(F.sum("w").alias("w"))
    info = classes.select("cid", "n", "low")
    info = info.join(found, info["cid"] == found["id"], "left").join(counts, F.col("cid") == F.col("a"), "left")
    links = (F.coalesce("w", F.lit(0)) + F.col("n") - 1).cast("long")
    info = scratch.write(info.select("cid", "low", links.alias("n_links"), F.coalesce("component", "cid").alias("comp")), "info")
    lows = scratch.write(info.groupBy("comp").agg(F.min("low").alias("component_id")), "lows")
    info = scratch.write(info.join(lows, "comp").select("cid", "n_links", "component_id"), "named")
    alone = rows.where("cid is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = some.select("vec_id", "cid").join(info, "cid").select("vec_id", "n_links", "component_id").unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
