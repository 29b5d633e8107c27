"""Binary operators between vectors: equi-joins on (step, signature of the labels)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelake.functions import ieee
from tidelake.functions.ieee import num
from tidelake.operators import labels as L
from tidelake.plans.ast import COMPARISONS, Matching


def signature(labels: Column, matching: Matching) -> Column:
    names = tuple(n for n in matching.labels if n != "__name__")
    return L.key(L.only(labels, names) if matching.on else L.without(labels, names))


def _signed(df: DataFrame, matching: Matching) -> DataFrame:
    sig = signature(F.col("labels"), matching)
    if matching.on and "__name__" in matching.labels:
        sig = F.concat(sig, F.coalesce("metric", F.lit("")))
    return df.withColumn("sig", sig)


def unique(df: DataFrame, keys: list[str], message: str) -> DataFrame:
    """Fail the query if two rows share `keys`; the rows are partitioned by these keys
    anyway, for the join that follows."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return df.withColumn("v", F.when(n > 1, F.raise_error(F.lit(message)).cast("double")).otherwise(F.col("v")))


def set_operation(op: str, left: DataFrame, right: DataFrame, matching: Matching) -> DataFrame:
    left, right = _signed(left, matching), _signed(right, matching)
    if op == "or":
        seen = left.select("step", "sig").distinct()
        more = right.join(seen, ["step", "sig"], "left_anti")
        return left.drop("sig").unionByName(more.drop("sig"))
    how = "left_semi" if op == "and" else "left_anti"
    return left.join(right.select("step", "sig"), ["step", "sig"], how).drop("sig")


def combine(op: str, left: DataFrame, right: DataFrame, matching: Matching, with_bool: bool) -> DataFrame:
    """Arithmetic and comparisons: step, key, labels, metric, v.

    The side of one (right, or left with group_right) must have one element a signature;
    without grouping so must the other side, where it matches."""
    swapped = matching.group == "right"
    many, one = _signed(right if swapped else left, matching), _signed(left if swapped else right, matching)
    side = "left" if swapped else "right"
    one = unique(one, ["step", "sig"], f"found duplicate series for the match group on the {side} side of the operation; many-to-many matching not allowed")
    one = one.select("step", "sig", F.col("v").alias("ov"), F.col("labels").alias("olabels"), F.col("metric").alias("ometric"))
    both = many.join(one, ["step", "sig"])
    a, b = (F.col("ov"), F.col("v")) if swapped else (F.col("v"), F.col("ov"))
    compares = op in COMPARISONS
    labels, metric = F.col("labels"), F.lit(None).cast("string")
    if compares and not with_bool:
        metric = F.col("metric")
    if matching.group is None:
        names = tuple(n for n in matching.labels if n != "__name__")
        labels = L.only(labels, names) if matching.on else L.without(labels, names)
        if compares and not with_bool and matching.on and "__name__" not in matching.labels:
            metric = F.lit(None).cast("string")
        both = unique(both, ["step", "sig"], "multiple matches for labels: many-to-one matching must be explicit (group_left/group_right)")
    else:
        for name in matching.include:
            if name == "__name__":
                metric = F.col("ometric")
            else:
                labels = L.put(labels, name, L.value(F.col("olabels"), name))
    if compares:
        test = ieee.compare(op, a, b)
        value = F.when(test, num(1.0)).otherwise(num(0.0)) if with_bool else F.col("v")
        if not with_bool:
            both = both.where(test)
            value = a
    else:
        value = ieee.arithmetic(op, a, b)
    out = both.select("step", labels.alias("labels"), metric.alias("metric"), value.alias("v"))
    out = out.withColumn("key", L.key(F.col("labels")))
    if matching.group is not None:
        out = unique(out, ["step", "key", "metric"], "multiple matches for labels: grouping labels must ensure unique matches")
    return out.select("step", "key", "labels", "metric", "v")
