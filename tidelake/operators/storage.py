"""What a metrics store does with samples besides answering queries: admission, merging,
compaction, retention, deletion, and statistics about series."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_MS = 7_200_000

# -- admission --------------------------------------------------------------------------


def classify(samples: DataFrame, out_of_order_ms: int = 0, min_valid: int | None = None) -> DataFrame:
    """Samples (series_id, ts, f, arrival) with `verdict`: accepted, duplicate, conflict,
    out_of_order_accepted, out_of_order, too_old or out_of_bounds.

    Arrival order decides: a sample is compared with the newest one that its series had
    before; with a window, one that is late by no more than the window behind the newest
    of all series is accepted out of order, unless its time is taken already."""
    own = Window.partitionBy("series_id").orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1)
    head = _running_head(samples.groupBy("arrival").agg(F.max("ts").alias("m")))
    newest = F.max("ts").over(own)
    first_at = F.row_number().over(Window.partitionBy("series_id", "ts").orderBy("arrival"))
    first_value = F.first("f").over(Window.partitionBy("series_id", "ts").orderBy("arrival").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = samples.join(head, "arrival").withColumn("newest", newest).withColumn("n", first_at).withColumn("first_value", first_value)
    equal = (F.col("f") == F.col("first_value")) | (F.isnan("f") & F.isnan("first_value"))
    late = F.col("ts") < F.col("newest")
    bound = F.lit(min_valid) if min_valid is not None else F.lit(None).cast("long")
    verdict = (
        F.when(bound.isNotNull() & (F.col("ts") < bound) & (F.lit(out_of_order_ms) == 0), "out_of_bounds")
        .when((F.col("n") > 1) & equal, "duplicate")
        .when(F.col("n") > 1, "conflict")
        .when(~F.coalesce(late, F.lit(False)), "accepted")
        .when(F.lit(out_of_order_ms) == 0, "out_of_order")
        .when(F.col("ts") >= F.col("head") - out_of_order_ms, "out_of_order_accepted")
        .otherwise("too_old")
    )
    return rows.withColumn("verdict", verdict).drop("head", "newest", "n", "first_value")


def _running_head(each: DataFrame, ranges: int = 1024) -> DataFrame:
    """(arrival, head): the newest time before each arrival, from the newest of each (arrival, m).

    The running maximum is taken inside ranges of arrivals, which are tasks of their own, and
    what the ranges before have reached, a row for each range, is carried in."""
    low, high = each.agg(F.min(F.col("arrival").cast("double")), F.max(F.col("arrival").cast("double"))).first()
    width = max((high - low) / ranges, 1e-9) if low is not None else 1.0
    each = each.withColumn("_range", F.floor((F.col("arrival").cast("double") - (low or 0.0)) / width))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    reached = each.groupBy("_range").agg(F.max("m").alias("m"))
    carried = reached.select("_range", F.max("m").over(before(Window.orderBy("_range"))).alias("carried"))
    inside = F.max("m").over(before(Window.partitionBy("_range").orderBy("arrival")))
    return each.withColumn("inside", inside).join(carried, "_range").select("arrival", F.greatest("inside", "carried").alias("head"))


def min_valid_time(max_time: int, block_ms: int = BLOCK_MS, floor: int | None = None) -> int:
    """The oldest time that the newest, open block takes."""
    found = max_time - block_ms // 2
    return found if floor is None else max(found, floor)


def with_created(samples: DataFrame) -> DataFrame:
    """A zero at the creation time of counters (column created, ms), where that is before
    the sample and none of the series is at that time already."""
    zero = samples.where("created is not null and created < ts").select("series_id", F.col("created").alias("ts"), F.lit(0.0).alias("f")).distinct()
    zero = zero.join(samples.select("series_id", "ts"), ["series_id", "ts"], "left_anti")
    rest = samples.drop("created")
    return rest.unionByName(zero, allowMissingColumns=True)


def merge_sources(sources: list[DataFrame]) -> DataFrame:
    """One sample for each (series_id, ts); of several the first source's stands."""
    rows = None
    for priority, source in enumerate(sources):
        one = source.withColumn("_priority", F.lit(priority))
        rows = one if rows is None else rows.unionByName(one, allowMissingColumns=True)
    rest = [c for c in rows.columns if c not in ("series_id", "ts", "_priority")]
    # An aggregate, not a window: partial results shrink copies before the shuffle.
    picked = rows.groupBy("series_id", "ts").agg(F.min_by(F.struct(*rest), F.col("_priority")).alias("x"))
    return picked.select("series_id", "ts", *[F.col(f"x.{c}").alias(c) for c in rest])


def stale_markers(before: DataFrame, now: DataFrame, ts: int) -> DataFrame:
    """End markers for the series of the last round that the present one lacks."""
    gone = before.select("series_id").distinct().join(now.select("series_id").distinct(), "series_id", "left_anti")
    return gone.select("series_id", F.lit(ts).cast("long").alias("ts"), F.lit(None).cast("double").alias("f"), F.lit(True).alias("stale"))


def shard(df: DataFrame, index: int, of: int) -> DataFrame:
    """The rows of one of `of` shards of series."""
    return df.where(F.pmod(F.xxhash64("series_id"), F.lit(of)) == index)


# -- blocks -------------------------------------------------------------------------------


@dataclass(frozen=True)
class Block:
    """Data of start <= ts < end.  level: how often its data have been compacted."""

    start: int
    end: int
    level: int = 1
    n_bytes: int = 0
    n_series: int = 0
    n_deleted: int = 0
    name: str = ""


def block_ranges(first: int = BLOCK_MS, steps: int = 10, factor: int = 3) -> list[int]:
    return [first * factor**k for k in range(steps)]


def block_start(ts: Column, size: int = BLOCK_MS) -> Column:
    return (F.floor(ts / F.lit(float(size))) * size).cast("long")


def plan_compaction(blocks: list[Block], ranges: list[int]) -> list[Block]:
    """The blocks to merge next: overlapping ones first; else those that fill a span of the
    smallest larger range, the newest block left alone; else, from the newest of the others
    back, a block that is deleted as a whole, or one of at least the middle range of which
    more than a twentieth of the series have deletions."""
    blocks = sorted(blocks, key=lambda b: (b.start, b.end))
    if overlapping := _overlapping(blocks):
        return overlapping
    older = blocks[:-1]
    for size in ranges[1:]:
        spans: dict[int, list[Block]] = {}
        for b in older:
            at = b.start // size * size
            if b.end <= at + size:
                spans.setdefault(at, []).append(b)
        for at, found in sorted(spans.items()):
            whole = found[0].start == at and found[-1].end == at + size
            done = blocks[-1].start >= at + size  # no later data of this span to come
            if len(found) > 1 and (whole or done):
                return found
    for b in reversed(older):
        if b.n_series and b.n_deleted >= b.n_series:
            return [b]
        if b.end - b.start < ranges[len(ranges) // 2]:
            return []
        if b.n_deleted / (b.n_series + 1) > 0.05:
            return [b]
    return []


def _overlapping(blocks: list[Block]) -> list[Block]:
    found: list[Block] = []
    end = None
    for k, b in enumerate(blocks):
        if end is not None and b.start < end:
            if not found:
                found.append(blocks[k - 1])
            found.append(b)
        elif found:
            break
        end = b.end if end is None else max(end, b.end)
    return found


def compact(parts: list[DataFrame], tombstones: DataFrame | None = None) -> DataFrame:
    """The merged samples of blocks, without deleted ones, sorted by series and time.

    Quantized values (q) are merged as they are, never quantized anew, so errors do not add up."""
    merged = merge_sources(parts)
    if tombstones is not None:
        merged = without_deleted(merged, tombstones)
    return merged.repartition("series_id").sortWithinPartitions("series_id", "ts")


def chunk_size(level: int, base: int = 1000) -> int:
    """Samples a chunk: blocks of higher levels have longer chunks."""
    return base if level < 2 else (level - 1) * 3 * base


def beyond_retention(blocks: list[Block], keep_ms: int | None = None, keep_bytes: int | None = None) -> list[Block]:
    """Blocks to delete: those wholly older than the newest data minus `keep_ms`, and the
    oldest ones as far as the rest would exceed `keep_bytes`."""
    newest = sorted(blocks, key=lambda b: b.end, reverse=True)
    gone: list[Block] = []
    if keep_ms is not None and newest:
        gone += [b for b in newest if newest[0].end - b.end >= keep_ms and b is not newest[0]]
    if keep_bytes is not None:
        total = 0
        for b in newest:
            total += b.n_bytes
            if total > keep_bytes and b not in gone:
                gone.append(b)
    return sorted(gone, key=lambda b: b.start)


# -- deletion -------------------------------------------------------------------------------


def delete_range(tombstones: DataFrame, series: DataFrame, mint: int, maxt: int) -> DataFrame:
    """More tombstones (series_id, mint, maxt), for the given series."""
    new = series.select("series_id", F.lit(mint).cast("long").alias("mint"), F.lit(maxt).cast("long").alias("maxt"))
    return merge_intervals(tombstones.unionByName(new))


def merge_intervals(tombstones: DataFrame) -> DataFrame:
    """Intervals of a series that touch or overlap as one."""
    order = Window.partitionBy("series_id").orderBy("mint", "maxt")
    reach = F.max("maxt").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = tombstones.withColumn("_new", F.when(F.col("mint") <= reach + 1, 0).otherwise(1))
    rows = rows.withColumn("_group", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("series_id", "_group").agg(F.min("mint").alias("mint"), F.max("maxt").alias("maxt")).drop("_group")


def without_deleted(samples: DataFrame, tombstones: DataFrame) -> DataFrame:
    """An equi-join on the series with a range condition: no sample is compared with the
    intervals of other series."""
    gone = tombstones.withColumnRenamed("series_id", "_sid")
    hit = (F.col("series_id") == F.col("_sid")) & (F.col("ts") >= F.col("mint")) & (F.col("ts") <= F.col("maxt"))
    return samples.join(gone, hit, "left_anti")


# -- statistics -------------------------------------------------------------------------------


def cardinality(series: DataFrame, top: int = 10) -> DataFrame:
    """(kind, name, n): metrics, label names and label pairs with the most series, and label
    names with the most values."""
    pairs = series.select("metric", F.explode("labels").alias("k", "v"))
    kinds = [
        ("series_by_metric", series.groupBy(F.col("metric").alias("name")).agg(F.count(F.lit(1)).alias("n"))),
        ("series_by_label", pairs.groupBy(F.col("k").alias("name")).agg(F.count(F.lit(1)).alias("n"))),
        ("series_by_pair", pairs.groupBy(F.concat_ws("=", "k", "v").alias("name")).agg(F.count(F.lit(1)).alias("n"))),
        ("values_by_label", pairs.groupBy(F.col("k").alias("name")).agg(F.countDistinct("v").alias("n"))),
    ]
    out = None
    for kind, df in kinds:
        one = df.orderBy(F.desc("n"), "name").limit(top).select(F.lit(kind).alias("kind"), "name", "n")
        out = one if out is None else out.unionByName(one)
    return out


def churn(samples: DataFrame, size: int = BLOCK_MS) -> DataFrame:
    """(block, series, samples, new_series): how many series each block starts."""
    each = samples.groupBy("series_id", block_start(F.col("ts"), size).alias("block")).agg(F.count(F.lit(1)).alias("n"))
    first = F.row_number().over(Window.partitionBy("series_id").orderBy("block")) == 1
    each = each.withColumn("new", F.when(first, 1).otherwise(0))
    return each.groupBy("block").agg(F.count(F.lit(1)).alias("series"), F.sum("n").alias("samples"), F.sum("new").alias("new_series"))
