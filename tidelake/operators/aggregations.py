"""Aggregations over the elements of a step, grouped by or without labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelake.functions import ieee
from tidelake.functions.ieee import NAN, num
from tidelake.operators import labels as L
from tidelake.plans.ast import QueryError


def grouped(df: DataFrame, grouping: tuple[str, ...], without: bool) -> DataFrame:
    """With `g`, the labels of each row's group, and `gkey`.  By __name__ means the metric."""
    if without:
        g = L.without(F.col("labels"), grouping)
    else:
        g = L.only(F.col("labels"), tuple(n for n in grouping if n != "__name__"))
    df = df.withColumn("g", g).withColumn("gkey", L.key(F.col("g")))
    by_name = not without and "__name__" in grouping
    return df.withColumn("gmetric", F.col("metric") if by_name else F.lit(None).cast("string"))


_GROUP = ["step", "gkey", "gmetric"]


def _special(v: Column) -> Column:
    return F.max(F.when(F.isnan(v) | (F.abs(v) == float("inf")), 1).otherwise(0)) == 1


def _deviation(function):
    def run(v: Column) -> Column:
        finite = F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)
        return F.when(_special(v), num(NAN)).otherwise(function(finite))

    return run


REDUCERS = {
    "sum": F.sum,
    "avg": F.avg,
    "count": lambda v: F.count(F.lit(1)).cast("double"),
    "min": F.min,
    "max": ieee.max_ignoring_nan,
    "group": lambda v: F.max(num(1.0)),
    "stddev": _deviation(F.stddev_pop),
    "stdvar": _deviation(F.var_pop),
}


def reduce(df: DataFrame, op: str, grouping: tuple[str, ...], without: bool, param: Column | None = None) -> DataFrame:
    """One row for each step and group: step, key, labels, metric, v.

    Partial aggregates come before the shuffle, so a group of all series costs each task
    one row a step (quantile needs the group's values)."""
    df = grouped(df, grouping, without)
    v = F.col("v")
    value = ieee.quantile(v, F.first(param)) if op == "quantile" else REDUCERS[op](v)
    out = df.groupBy(*_GROUP).agg(value.alias("v"))
    return _named(out)


def _named(out: DataFrame) -> DataFrame:
    return out.select("step", F.col("gkey").alias("key"), L.from_key(F.col("gkey")).alias("labels"), F.col("gmetric").alias("metric"), "v")


def count_values(df: DataFrame, label: str, grouping: tuple[str, ...], without: bool) -> DataFrame:
    """Count of each distinct value, which becomes a label."""
    df = grouped(df, tuple({*grouping, label}) if without else grouping, without)
    df = df.withColumn("text", ieee.format_value(F.col("v")))
    df = df.withColumn("g", L.put(F.col("g"), label, F.col("text"))).withColumn("gkey", L.key(F.col("g")))
    return _named(df.groupBy(*_GROUP).agg(F.count(F.lit(1)).cast("double").alias("v")))


def select_k(df: DataFrame, op: str, k: Column, grouping: tuple[str, ...], without: bool) -> DataFrame:
    """topk, bottomk (NaN last) and limitk (by label order): rows keep their labels.

    The ranked filter keeps k rows of each task and group before the shuffle."""
    df = grouped(df, grouping, without)
    v = F.col("v")
    ties = [F.col("key"), F.col("metric")]
    order = {
        "topk": [F.isnan(v), v.desc(), *ties],
        "bottomk": [F.isnan(v), v.asc(), *ties],
        "limitk": ties,
    }[op]
    rank = F.row_number().over(Window.partitionBy(*_GROUP).orderBy(*order))
    return df.withColumn("r", rank).where(F.col("r") <= F.floor(k)).drop("r", "g", "gkey", "gmetric")


def limit_ratio(df: DataFrame, ratio: Column) -> DataFrame:
    """A share of the series by a hash of their labels; a negative ratio keeps the others
    of its complement.  Ratios beyond 1 count as 1."""
    bad = F.raise_error(F.lit("ratio value is NaN")).cast("double")
    ratio = F.when(F.isnan(ratio), bad).otherwise(F.greatest(num(-1.0), F.least(num(1.0), ratio)))
    digits = F.substring(F.md5(F.concat(F.coalesce("metric", F.lit("")), "key")), 1, 13)
    place = F.conv(digits, 16, 10).cast("double") / 2.0**52
    return df.where(F.when(ratio >= 0, place < ratio).otherwise(place >= 1 + ratio))


def aggregate(df: DataFrame, op: str, grouping: tuple[str, ...], without: bool, param: Column | str | None) -> DataFrame:
    if op == "count_values":
        return count_values(df, param, grouping, without)
    if op in ("topk", "bottomk", "limitk"):
        return select_k(df, op, param, grouping, without)
    if op == "limit_ratio":
        return limit_ratio(df, param)
    if op in REDUCERS or op == "quantile":
        return reduce(df, op, grouping, without, param)
    raise QueryError(f"unknown aggregation {op!r}")
