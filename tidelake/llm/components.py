"""Connected components by alternating large-star and small-star rounds.

Each round is two joins on the node; a node's smallest neighbour comes from an
aggregate with partial sums, and it is written before the join, so that both sides of
the join have plain exchanges and adaptive execution can split a hub.  Rounds are
written to the scratch folder, which keeps plans short and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelake.session import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(id, component) for every node of `edges` (a, b); component is the smallest
    id reachable.  Self-links, nulls and repeated links change nothing; without
    links the result is empty."""
    links = (
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    current = scratch.write(links, f"{name}-0")
    before, round_no = _fingerprint(current), 0
    while before[0]:
        round_no += 1
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.write(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"{name}-least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = scratch.write(large.where("u <> v").distinct(), f"{name}-large")
        least = scratch.write(large.groupBy("u").agg(F.min("v").alias("m")), f"{name}-small")
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        current = scratch.write(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), f"{name}-{round_no}")
        scratch.drop(f"{name}-{round_no - 1}")
        after = _fingerprint(current)
        if after == before:
            break
        before = after
    nodes = current.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return nodes.unionByName(current.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def _fingerprint(links: DataFrame) -> tuple[int, int]:
    row = links.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], int(row["h"] or 0)
