"""Functions of range vectors as aggregates over (series, step).

Functions that can be put together from parts are computed in two rounds where windows
overlap much: samples are first aggregated into buckets of the greatest common divisor of
range and step, whose edges are the windows' edges, and only buckets are repeated for
the windows that hold them.  Stale markers are gone before; adjacent-sample terms
(resets, changes) come from one window over the series, and the first sample's own term,
which belongs to the pair that the window's edge cuts, is taken off again.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelake.functions import ieee
from tidelake.functions.ieee import NAN, num
from tidelake.model import Grid
from tidelake.operators.selectors import in_windows
from tidelake.plans.ast import QueryError

#: name -> (partial aggregate of samples, how partial results go together)
_PARTS = {
    "n": (lambda: F.count(F.lit(1)), F.sum),
    "total": (lambda: F.sum("f"), F.sum),
    "low": (lambda: F.min("f"), F.min),
    "high": (lambda: F.max(F.when(~F.isnan("f"), F.col("f"))), F.max),
    "first": (lambda: F.min(F.struct("ts", "f", "term")), F.min),
    "last": (lambda: F.max(F.struct("ts", "f", "term")), F.max),
    "terms": (lambda: F.sum("term"), F.sum),
    "newest": (lambda: F.max(F.struct("ts", "f", "before_ts", "before")), F.max),
}
_NEEDS = {
    "count_over_time": ["n"],
    "present_over_time": ["n"],
    "sum_over_time": ["total"],
    "avg_over_time": ["total", "n"],
    "min_over_time": ["low"],
    "max_over_time": ["high"],
    "last_over_time": ["last"],
    "rate": ["first", "last", "n", "terms"],
    "increase": ["first", "last", "n", "terms"],
    "delta": ["first", "last", "n"],
    "resets": ["first", "terms"],
    "changes": ["first", "terms"],
    "irate": ["newest"],
    "idelta": ["newest"],
}
BUCKET_FAN_OUT = 4


def _terms(name: str, rows: DataFrame, by: list[str]) -> DataFrame:
    order = Window.partitionBy(*by).orderBy("ts")
    before = F.lag("f").over(order)
    if name in ("rate", "increase"):
        return rows.withColumn("term", F.when(F.col("f") < before, before).otherwise(0.0))
    if name == "resets":
        return rows.withColumn("term", F.when(ieee.compare("<", F.col("f"), before), 1.0).otherwise(0.0))
    if name == "changes":
        changed = (F.col("f") != before) & ~(F.isnan("f") & F.isnan(before))
        return rows.withColumn("term", F.when(changed, 1.0).otherwise(0.0))
    if name in ("irate", "idelta"):
        return rows.withColumn("before", before).withColumn("before_ts", F.lag("ts").over(order))
    return rows.withColumn("term", num(0.0)) if {"first", "last"} & set(_NEEDS[name]) else rows


def _aggregated(rows: DataFrame, grid: Grid, length: int, by: list[str], needs: list[str]) -> DataFrame:
    size = math.gcd(length, grid.step)
    if length // grid.step >= BUCKET_FAN_OUT or (length > grid.step and size * 4 >= grid.step):
        bucket = F.ceil((F.col("ts") - grid.start) / F.lit(float(size))).cast("long")
        parts = rows.groupBy(*by, bucket.alias("b")).agg(*[_PARTS[n][0]().alias(n) for n in needs])
        # A bucket ends at start + b * size, and lies in the window of a step if its end does.
        parts = in_windows(parts.withColumn("ts", F.lit(grid.start) + F.col("b") * size), grid, length)
        return parts.groupBy(*by, "step").agg(*[_PARTS[n][1](n).alias(n) for n in needs])
    rows = in_windows(rows, grid, length)
    return rows.groupBy(*by, "step").agg(*[_PARTS[n][0]().alias(n) for n in needs])


def _extrapolated(name: str, length: int) -> Column:
    """From first, last, n and terms to the increase over the whole window, as if the
    series went on at its edges: up to the edge if that is near, else half an interval;
    a counter not below zero."""
    first, last = F.col("first"), F.col("last")
    change = last["f"] - first["f"]
    if name != "delta":
        change = change + F.col("terms") - first["term"]
    sampled = (last["ts"] - first["ts"]) / 1000.0
    each = sampled / (F.col("n") - 1)
    near = each * 1.1
    to_start = (first["ts"] - (F.col("step") - length)) / 1000.0
    to_end = (F.col("step") - last["ts"]) / 1000.0
    to_start = F.when(to_start >= near, each / 2).otherwise(to_start)
    if name != "delta":
        to_zero = sampled * ieee.divide(first["f"], change)
        counts = (change > 0) & ~F.isnan(change) & (first["f"] >= 0)
        to_start = F.when(counts & (to_zero < to_start), to_zero).otherwise(to_start)
    to_end = F.when(to_end >= near, each / 2).otherwise(to_end)
    factor = (sampled + to_start + to_end) / sampled
    return change * (factor / (length / 1000.0) if name == "rate" else factor)


def _from_parts(name: str, length: int) -> tuple[Column, Column]:
    """(condition, value) from the aggregated parts."""
    yes = F.lit(True)
    if name == "count_over_time":
        return yes, F.col("n").cast("double")
    if name == "present_over_time":
        return yes, num(1.0)
    if name == "sum_over_time":
        return yes, F.col("total")
    if name == "avg_over_time":
        return yes, F.col("total") / F.col("n")
    if name == "min_over_time":
        return yes, F.col("low")
    if name == "max_over_time":
        return yes, F.coalesce("high", num(NAN))
    if name == "last_over_time":
        return yes, F.col("last.f")
    if name in ("resets", "changes"):
        return yes, F.col("terms") - F.col("first.term")
    if name in ("irate", "idelta"):
        x = F.col("newest")
        fall = F.when(x["f"] < x["before"], x["f"]).otherwise(x["f"] - x["before"])
        value = fall / ((x["ts"] - x["before_ts"]) / 1000.0) if name == "irate" else x["f"] - x["before"]
        return x["before_ts"].isNotNull() & (x["before_ts"] > F.col("step") - length), value
    return F.col("n") > 1, _extrapolated(name, length)


def evaluate(name: str, rows: DataFrame, grid: Grid, length: int, by: list[str], params: list[Column]) -> DataFrame:
    """(by..., step, v) of a range function over samples (by..., ts, f).

    `params` are the scalar arguments, as columns of step alone."""
    if name in _NEEDS:
        found = _aggregated(_terms(name, rows, by), grid, length, by, _NEEDS[name])
        keep, value = _from_parts(name, length)
        return found.where(keep).select(*by, "step", value.alias("v"))
    rows = in_windows(rows, grid, length)
    grouped = rows.groupBy(*by, "step")
    if name in ("stddev_over_time", "stdvar_over_time"):
        function = F.stddev_pop if name[3] == "d" and name[:6] == "stddev" else F.var_pop
        special = F.max(F.when(F.isnan("f") | (F.abs("f") == float("inf")), 1).otherwise(0)) == 1
        found = grouped.agg(function("f").alias("x"), special.alias("special"))
        return found.select(*by, "step", F.when(F.col("special"), num(NAN)).otherwise(F.col("x")).alias("v"))
    if name == "quantile_over_time":
        found = grouped.agg(ieee.quantile(F.col("f"), F.first(params[0])).alias("v"))
        return found
    if name == "mad_over_time":
        found = grouped.agg(F.collect_list("f").alias("x")).withColumn("m", _median(F.col("x")))
        return found.select(*by, "step", _median(F.transform("x", lambda x: F.abs(x - F.col("m")))).alias("v"))
    if name in ("deriv", "predict_linear"):
        x = (F.col("ts") - F.col("step")) / 1000.0
        flat = F.min("f") == F.max("f")
        found = grouped.agg(
            F.count(F.lit(1)).alias("n"), F.regr_slope("f", x).alias("slope"), F.regr_intercept("f", x).alias("intercept"),
            flat.alias("flat"), F.min("f").alias("c"),
        ).where("n > 1")
        special = F.isnan("c") | (F.abs("c") == float("inf"))
        slope = F.when(F.col("flat"), F.when(special, num(NAN)).otherwise(num(0.0))).otherwise(F.col("slope"))
        if name == "deriv":
            return found.select(*by, "step", slope.alias("v"))
        intercept = F.when(F.col("flat"), F.when(special, num(NAN)).otherwise(F.col("c"))).otherwise(F.col("intercept"))
        return found.select(*by, "step", (slope * params[0] + intercept).alias("v"))
    if name == "double_exponential_smoothing":
        found = grouped.agg(F.array_sort(F.collect_list(F.struct("ts", "f"))).alias("x")).where(F.size("x") > 1)
        return found.select(*by, "step", _smoothed(params[0], params[1]).alias("v"))
    raise QueryError(f"unknown range function {name!r}")


def _median(values: Column) -> Column:
    ranked = F.array_sort(values)
    n = F.size(ranked)
    return (F.element_at(ranked, F.floor((n - 1) / 2.0).cast("int") + 1) + F.element_at(ranked, F.floor(n / 2.0).cast("int") + 1)) / 2


def _smoothed(sf: Column, tf: Column) -> Column:
    """Holt's linear smoothing of the ordered values: level s and trend b."""
    ok = (sf > 0) & (sf < 1) & (tf > 0) & (tf < 1)
    sf = F.when(ok, sf).otherwise(F.raise_error(F.lit("smoothing and trend factors must be between 0 and 1")).cast("double"))
    x = F.transform("x", lambda p: p["f"])
    start = F.struct(F.element_at(x, 1).alias("s"), (F.element_at(x, 2) - F.element_at(x, 1)).alias("b"), F.lit(0).alias("k"))

    def step(a: Column, v: Column) -> Column:
        # The trend changes from the second smoothed value on.
        s = sf * v + (1 - sf) * (a["s"] + a["b"])
        return F.struct(s.alias("s"), (tf * (s - a["s"]) + (1 - tf) * a["b"]).alias("b"), (a["k"] + 1).alias("k"))

    return F.aggregate(F.slice(x, 2, F.size(x)), start, step, lambda a: a["s"])
