"""Stored blocks: samples as Parquet, partitioned by block start and metric, sorted by
series and time, with the series dimension and a table of blocks beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.model import Store
from tidelake.operators.storage import BLOCK_MS, Block, block_start


def write_blocks(store: Store, root: str, size: int = BLOCK_MS, level: int = 1, mode: str = "append") -> None:
    """Append a store's samples to the blocks at `root`.

    Rows are dealt by (block, series), so that a block's hot metric is many tasks, and sorted
    so that a series' points lie together in a file."""
    rows = store.samples.withColumn("block_start", block_start(F.col("ts"), size))
    rows = rows.repartition("block_start", "series_id").sortWithinPartitions("block_start", "metric", "series_id", "ts")
    rows.write.mode(mode).partitionBy("block_start", "metric").parquet(f"{root}/samples")
    series = store.series.select("series_id", "metric", F.to_json("labels").alias("key"))
    series.write.mode(mode).parquet(f"{root}/series")
    meta = store.samples.groupBy(block_start(F.col("ts"), size).alias("block_start"))
    meta = meta.agg(F.min("ts").alias("mint"), F.max("ts").alias("maxt"), F.count(F.lit(1)).alias("n_samples"), F.approx_count_distinct("series_id").alias("n_series"))
    meta.withColumn("block_end", F.col("block_start") + size).withColumn("level", F.lit(level)).write.mode(mode).parquet(f"{root}/meta")


def read_blocks(spark: SparkSession, root: str, mint: int | None = None, maxt: int | None = None, size: int = BLOCK_MS) -> Store:
    """The store of the blocks that a time range touches; other partitions are not read."""
    from tidelake.operators import labels as L

    rows = spark.read.parquet(f"{root}/samples")
    if mint is not None:
        rows = rows.where((F.col("block_start") >= mint // size * size) & (F.col("ts") >= mint))
    if maxt is not None:
        rows = rows.where((F.col("block_start") <= maxt) & (F.col("ts") <= maxt))
    series = spark.read.parquet(f"{root}/series").distinct()
    return Store(rows.drop("block_start"), series.select("series_id", "metric", L.from_key(F.col("key")).alias("labels")))


def list_blocks(spark: SparkSession, root: str) -> list[Block]:
    """One entry for each block start; blocks are few, so this table is for the driver."""
    rows = spark.read.parquet(f"{root}/meta").groupBy("block_start", "block_end").agg(F.max("level").alias("level"), F.sum("n_series").alias("n"))
    return sorted((Block(r.block_start, r.block_end, r.level, n_series=r.n) for r in rows.collect()), key=lambda b: b.start)


def snapshot(spark: SparkSession, root: str, target: str) -> None:
    """A copy of all blocks as they are."""
    for table in ("samples", "series", "meta"):
        df = spark.read.parquet(f"{root}/{table}")
        writer = df.write.mode("errorifexists")
        (writer.partitionBy("block_start", "metric") if table == "samples" else writer).parquet(f"{target}/{table}")


def backfill(spark: SparkSession, payloads: DataFrame, root: str, strict: bool = True, size: int = BLOCK_MS) -> DataFrame:
    """Write the samples of expositions (body, ts) as blocks; returns the payloads' errors."""
    from tidelake.model import store_of
    from tidelake.sources import exposition

    rows = exposition.read(payloads, strict)
    write_blocks(store_of(rows.where("error is null").select("metric", "labels", "ts", "f")), root, size)
    return rows.where("error is not null").select("error")
