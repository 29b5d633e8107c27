"""Quantiles of classic histograms: cumulative buckets with an upper bound in label le."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelake.functions.ieee import INF, NAN, num
from tidelake.operators import labels as L


def _monotonic(buckets: Column) -> Column:
    """Bounds once, in order, with counts that never fall; a fall of a relative 1e-12 is rounding."""

    def add(a: Column, x: Column) -> Column:
        last = F.element_at(a, -1)
        same = (F.size(a) > 0) & (F.try_element_at(a, F.lit(-1))["le"] == x["le"])
        merged = F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(x["le"].alias("le"), (last["c"] + x["c"]).alias("c"))))
        return F.when(same, merged).otherwise(F.concat(a, F.array(x)))

    merged = F.aggregate(buckets, F.array().cast("array<struct<le:double,c:double>>"), add)

    def raise_(a: Column, x: Column) -> Column:
        last = F.try_element_at(a, F.lit(-1))["c"]
        return F.concat(a, F.array(F.struct(x["le"].alias("le"), F.greatest(x["c"], F.coalesce(last, x["c"])).alias("c"))))

    return F.aggregate(merged, F.array().cast("array<struct<le:double,c:double>>"), raise_)


def quantile_of(q: Column, b: Column) -> Column:
    """Interpolated quantile of monotonic buckets `b`, an array of (le, c)."""
    n = F.size(b)
    total = F.element_at(b, -1)["c"]
    rank = q * total
    below = F.size(F.filter(F.slice(b, 1, F.greatest(n - 1, F.lit(0))), lambda x: x["c"] < rank))
    upper = F.element_at(b, below + 1)
    lower = F.try_element_at(b, F.when(below > 0, below).otherwise(F.lit(1)))
    start = F.when(below > 0, lower["le"]).otherwise(num(0.0))
    under = F.when(below > 0, lower["c"]).otherwise(num(0.0))
    inside = start + (upper["le"] - start) * ((rank - under) / (upper["c"] - under))
    value = (
        F.when(below == n - 1, F.element_at(b, n - 1)["le"])
        .when((below == 0) & (F.element_at(b, 1)["le"] <= 0), F.element_at(b, 1)["le"])
        .otherwise(inside)
    )
    return (
        F.when(F.isnan(q), num(NAN)).when(q < 0, num(-INF)).when(q > 1, num(INF))
        .when((n < 2) | (F.element_at(b, -1)["le"] != num(INF)) | (total == 0) | F.isnan(total), num(NAN))
        .otherwise(value)
    )


def histogram_quantile(df: DataFrame, q: Column) -> DataFrame:
    """One row for each step and label set without le.  Rows whose le is no number go."""
    le = F.expr("try_cast(element_at(labels, 'le') as double)")
    df = df.withColumn("le", le).where("le is not null").withColumn("g", L.without(F.col("labels"), ("le",)))
    df = df.withColumn("gkey", L.key(F.col("g"))).withColumn("q", q)
    pairs = F.array_sort(F.collect_list(F.struct("le", F.col("v").alias("c"))))
    out = df.groupBy("step", "gkey").agg(pairs.alias("b"), F.first("q").alias("q"))
    out = out.withColumn("b", _monotonic(F.col("b"))).withColumn("v", quantile_of(F.col("q"), F.col("b")))
    return out.select("step", F.col("gkey").alias("key"), L.from_key(F.col("gkey")).alias("labels"), F.lit(None).cast("string").alias("metric"), "v")
