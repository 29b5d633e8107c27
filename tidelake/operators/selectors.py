"""Series selection, and the samples that instant and range selectors see at each step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelake.model import Grid, Store
from tidelake.operators import labels as L
from tidelake.plans.ast import Matcher


def select_series(store: Store, matchers: tuple[Matcher, ...]) -> DataFrame:
    """(series_id, metric, labels) of the series that all matchers accept."""
    found = store.series
    for m in matchers:
        found = found.where(L.matches(m, F.col("metric"), F.col("labels")))
    return found


def select_samples(store: Store, matchers: tuple[Matcher, ...], after: int, until: int) -> DataFrame:
    """Samples with after < ts <= until of the matching series.

    Time and metric name go to the scan; other matchers go to the series dimension, whose
    ids then select samples by a semi join."""
    rows = store.samples.where((F.col("ts") > after) & (F.col("ts") <= until))
    names = [m for m in matchers if m.name == "__name__"]
    if "metric" in rows.columns:
        for m in names:
            rows = rows.where(L.matches(m, F.col("metric"), L.empty()))
    if len(names) < len(matchers) or "metric" not in rows.columns:
        ids = select_series(store, matchers).select("series_id")
        rows = rows.join(ids, "series_id", "left_semi")
    if store.tombstones is not None:
        gone = store.tombstones
        hit = (rows["series_id"] == gone["series_id"]) & (rows["ts"] >= gone["mint"]) & (rows["ts"] <= gone["maxt"])
        rows = rows.join(gone, hit, "left_anti")
    return rows


def _values(rows: DataFrame) -> list[str]:
    return [c for c in ("f", "h") if c in rows.columns]


def _ceil_step(grid: Grid, t: Column) -> Column:
    """Number of the first step at or after t, at least 0."""
    return F.greatest(F.lit(0).cast("long"), _div(t - grid.start + (grid.step - 1), grid.step))


def _div(a: Column, b: int) -> Column:
    return F.floor(a / F.lit(float(b))).cast("long")


def _step(grid: Grid, k: Column) -> Column:
    return F.lit(grid.start).cast("long") + k * grid.step


def instant(rows: DataFrame, grid: Grid, lookback: int, by: list[str]) -> DataFrame:
    """For each series and step the newest sample in (step - lookback, step], unless that
    is a stale marker: (by..., step, ts, f[, h]).

    Where windows do not overlap, a sample belongs to one step and an aggregate with
    partial results picks the newest.  Else each sample holds from its time until the
    next sample or the lookback ends it; no join, no second pass."""
    values = _values(rows)
    stale = F.col("stale") if "stale" in rows.columns else F.lit(False)
    if grid.n == 1 or lookback <= grid.step:
        k = _ceil_step(grid, F.col("ts"))
        rows = rows.withColumn("step", _step(grid, k)).where((k < grid.n) & (F.col("ts") > F.col("step") - lookback))
        newest = F.max_by(F.struct("ts", *values, stale.alias("stale")), "ts").alias("x")
        found = rows.groupBy(*by, "step").agg(newest).where("not x.stale")
        return found.select(*by, "step", F.col("x.ts").alias("ts"), *[F.col(f"x.{c}").alias(c) for c in values])
    order = Window.partitionBy(*by).orderBy("ts")
    until = F.least(F.lead("ts").over(order) - 1, F.col("ts") + (lookback - 1))
    rows = rows.withColumn("until", until).where(~stale if "stale" in rows.columns else F.lit(True))
    first, last = _ceil_step(grid, F.col("ts")), F.least(F.lit(grid.n - 1).cast("long"), _div(F.col("until") - grid.start, grid.step))
    rows = rows.withColumn("k0", first).withColumn("k1", last).where("k0 <= k1")
    rows = rows.withColumn("k", F.explode(F.sequence("k0", "k1")))
    return rows.select(*by, _step(grid, F.col("k")).alias("step"), "ts", *values)


def in_windows(rows: DataFrame, grid: Grid, length: int) -> DataFrame:
    """Each sample once for every step whose window (step - length, step] holds it."""
    first = _ceil_step(grid, F.col("ts"))
    last = F.least(F.lit(grid.n - 1).cast("long"), _div(F.col("ts") + (length - 1) - grid.start, grid.step))
    rows = rows.withColumn("k0", first).withColumn("k1", last).where("k0 <= k1")
    if length <= grid.step:  # one step at most
        return rows.withColumn("step", _step(grid, F.col("k0"))).drop("k0", "k1")
    rows = rows.withColumn("k", F.explode(F.sequence("k0", "k1")))
    return rows.withColumn("step", _step(grid, F.col("k"))).drop("k0", "k1", "k")
