"""The data model: samples of labelled series, and the frames that queries work on.

samples(series_id, metric, ts, f[, h][, stale]): one row for each point; ts in ms.
series(series_id, metric, labels): one row for each label set, a small dimension.
A vector frame has one row for each element and step: step, key, labels, metric, v[, h].
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HISTOGRAM = (
    "struct<hint:tinyint,schema:int,zero_threshold:double,zero_count:double,count:double,sum:double,"
    "pos:map<int,double>,neg:map<int,double>,custom:array<double>>"
)
LOOKBACK_MS = 300_000


@dataclass(frozen=True)
class Store:
    """What selectors read.  `stale` and `h` are optional columns of samples."""

    samples: DataFrame
    series: DataFrame
    exemplars: DataFrame | None = None
    metadata: DataFrame | None = None
    tombstones: DataFrame | None = None

    @property
    def spark(self) -> SparkSession:
        return self.samples.sparkSession

    @property
    def has_histograms(self) -> bool:
        return "h" in self.samples.columns

    @property
    def has_stale(self) -> bool:
        return "stale" in self.samples.columns


@dataclass(frozen=True)
class Grid:
    """Evaluation times start, start + step, ... up to end, in ms."""

    start: int
    end: int
    step: int

    def __post_init__(self):
        if self.end < self.start or self.step <= 0:
            raise ValueError("end must not be before start, and step must be positive")

    @property
    def n(self) -> int:
        return (self.end - self.start) // self.step + 1

    @property
    def last(self) -> int:
        return self.start + (self.n - 1) * self.step

    def shift(self, ms: int) -> Grid:
        return Grid(self.start + ms, self.last + ms, self.step)

    def steps(self, spark: SparkSession) -> DataFrame:
        return spark.range(self.n).select((F.lit(self.start) + F.col("id") * self.step).alias("step"))

    def every(self) -> Column:
        """All steps as an array."""
        return F.sequence(F.lit(self.start).cast("long"), F.lit(self.last).cast("long"), F.lit(self.step).cast("long"))


def series_id(metric: Column, labels: Column) -> Column:
    return F.xxhash64(metric, F.to_json(labels))


def store_of(rows: DataFrame) -> Store:
    """A store from rows (metric, labels, ts, f[, h][, stale]); labels may hold empty values."""
    from tidelake.operators import labels as L

    rows = rows.withColumn("labels", L.normal(F.col("labels"))).withColumn("series_id", series_id(F.col("metric"), F.col("labels")))
    key = rows.select("series_id", "metric", F.to_json("labels").alias("key")).distinct()
    series = key.select("series_id", "metric", L.from_key(F.col("key")).alias("labels"))
    return Store(rows.drop("labels"), series)
