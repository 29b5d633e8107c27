"""From an expression to one lazy DataFrame plan.

Each node becomes a frame over (step, element); nothing runs before the caller acts on
the result.  The planner derives each selector's time range, evaluates what does not
depend on the step once, tracks when metric names go, and asserts unique label sets
only where an operation can make them collide.  The rest is Catalyst's.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelake.functions import ieee
from tidelake.functions.ieee import NAN, num
from tidelake.model import LOOKBACK_MS, Grid, Store
from tidelake.operators import aggregations, classic, histograms, matching, ranges, selectors
from tidelake.operators import labels as L
from tidelake.operators.labels import java_regex
from tidelake.plans.ast import (
    COMPARISONS,
    MATRIX,
    SCALAR,
    SET_OPERATORS,
    STRING,
    VECTOR,
    Aggregate,
    At,
    Binary,
    Call,
    Expr,
    Matcher,
    Number,
    Paren,
    QueryError,
    Selector,
    String,
    Subquery,
    Unary,
    children,
)
from tidelake.plans.parser import matches_empty, parse

MAX_POINTS = 11_000
SUBQUERY_STEP_MS = 60_000
_FRAME = ["step", "key", "labels", "metric", "v"]


@dataclass(frozen=True)
class Scalar:
    """A number for each step: a column of `step`, or of a frame (step, name)."""

    column: Column
    frame: DataFrame | None = None

    def attach(self, df: DataFrame) -> DataFrame:
        return df if self.frame is None else df.join(self.frame, "step")


@dataclass(frozen=True)
class Vector:
    """A frame; `named`: all rows have the same metric name, so dropping it cannot make
    two label sets equal."""

    df: DataFrame
    named: bool = False


@dataclass(frozen=True)
class Range:
    """Samples (by..., ts, f) with how their series get back labels and metric."""

    rows: DataFrame
    by: list[str]
    label: Callable[[DataFrame], DataFrame]
    named: bool
    length: int
    grid: Grid


@dataclass(frozen=True)
class Options:
    lookback: int = LOOKBACK_MS
    subquery_step: int = SUBQUERY_STEP_MS
    max_points: int = MAX_POINTS
    experimental: bool = True
    keep_names: bool = False


class Engine:
    def __init__(self, store: Store, options: Options | None = None):
        self.store, self.options = store, options or Options()
        self.spark = store.spark
        self._names = 0

    # -- entry points -------------------------------------------------------------

    def range_query(self, text: str, start: int, end: int, step: int) -> DataFrame:
        """(step, metric, labels, v) of a vector or scalar expression at each step."""
        e = parse(text, self.options.experimental)
        if e.kind not in (VECTOR, SCALAR):
            raise QueryError(f"invalid expression type {e.kind!r} for range query, must be scalar or instant vector")
        grid = Grid(start, end, step)
        if grid.n > self.options.max_points:
            raise QueryError(f"exceeded maximum resolution of {self.options.max_points} points per timeseries")
        return self._result(e, grid)

    def instant_query(self, text: str, time: int) -> DataFrame:
        """As a range query of one step; a range vector gives its samples (metric, labels,
        ts, v), a string its value.  sort functions order the result."""
        e = parse(text, self.options.experimental)
        grid = Grid(time, time, 1)
        if e.kind == STRING:
            return self.spark.createDataFrame([(time, _strip(e).value)], "step long, v string")
        if e.kind == MATRIX:
            e = self._pin(e, grid)
            r = self._range(e, grid)
            after = (F.col("ts") > r.grid.start - r.length) & (F.col("ts") <= r.grid.start)
            return r.label(r.rows.where(after)).select("metric", "labels", "ts", F.col("f").alias("v"))
        out = self._result(e, grid)
        e = _strip(e)
        if isinstance(e, Call) and e.func.startswith("sort"):
            out = out.orderBy(*_order(e))
        return out

    def histogram_query(self, text: str, start: int, end: int, step: int) -> DataFrame:
        """(step, metric, labels, h) of an expression whose values are native histograms."""
        grid = Grid(start, end, step)
        e = self._pin(parse(text, self.options.experimental), grid)
        return self.histograms(e, grid).select("step", "metric", "labels", "h")

    def _result(self, e: Expr, grid: Grid) -> DataFrame:
        e = self._pin(e, grid)
        if e.kind == SCALAR:
            s = self.scalar(e, grid)
            out = s.attach(grid.steps(self.spark)).withColumn("v", s.column)
            return out.select("step", F.lit(None).cast("string").alias("metric"), L.empty().alias("labels"), "v")
        return self.vector(e, grid).df.select("step", "metric", "labels", "v")

    # -- rewriting ----------------------------------------------------------------

    def _pin(self, e: Expr, grid: Grid) -> Expr:
        """Put the query's start and end in place of @ start() and @ end()."""
        if isinstance(e, Selector | Subquery):
            if e.at and e.at.edge:
                e = replace(e, at=At(ms=grid.start if e.at.edge == "start" else grid.last))
            return replace(e, expr=self._pin(e.expr, grid)) if isinstance(e, Subquery) else e
        if isinstance(e, Paren | Unary):
            return replace(e, expr=self._pin(e.expr, grid))
        if isinstance(e, Binary):
            return replace(e, left=self._pin(e.left, grid), right=self._pin(e.right, grid))
        if isinstance(e, Aggregate):
            return replace(e, expr=self._pin(e.expr, grid), param=e.param and self._pin(e.param, grid))
        if isinstance(e, Call):
            return replace(e, args=tuple(self._pin(a, grid) for a in e.args))
        return e

    def _fixed(self, e: Expr) -> bool:
        """The value is the same at every step."""
        if isinstance(e, Selector | Subquery):
            return e.at is not None
        if isinstance(e, Number | String):
            return True
        if isinstance(e, Call):
            if e.func in ("time", "timestamp", "predict_linear") or (not e.args and e.func != "pi"):
                return False
            if e.func in ieee.CALENDAR and not e.args:
                return False
        return all(map(self._fixed, children(e)))

    # -- scalars --------------------------------------------------------------------

    def _name(self) -> str:
        self._names += 1
        return f"_s{self._names}"

    def scalar(self, e: Expr, grid: Grid) -> Scalar:
        if isinstance(e, Number):
            return Scalar(num(e.value))
        if isinstance(e, Paren):
            return self.scalar(e.expr, grid)
        if isinstance(e, Unary):
            s = self.scalar(e.expr, grid)
            return replace(s, column=-s.column) if e.op == "-" else s
        if isinstance(e, Binary):
            a, b = self.scalar(e.left, grid), self.scalar(e.right, grid)
            frame = a.frame if b.frame is None else b.frame if a.frame is None else a.frame.join(b.frame, "step")
            if e.op in COMPARISONS:
                return Scalar(F.when(ieee.compare(e.op, a.column, b.column), num(1.0)).otherwise(num(0.0)), frame)
            return Scalar(ieee.arithmetic(e.op, a.column, b.column), frame)
        if isinstance(e, Call) and e.func == "pi":
            return Scalar(F.pi())
        if isinstance(e, Call) and e.func == "time":
            return Scalar(F.col("step") / 1000.0)
        if isinstance(e, Call) and e.func == "scalar":
            name = self._name()
            df = self.vector(e.args[0], grid).df
            one = df.groupBy("step").agg(F.count(F.lit(1)).alias("n"), F.first("v").alias("x"))
            one = one.select("step", F.when(F.col("n") == 1, F.col("x")).otherwise(num(NAN)).alias(name))
            frame = grid.steps(self.spark).join(one, "step", "left")
            return Scalar(F.col(name), frame.select("step", F.coalesce(name, num(NAN)).alias(name)))
        raise QueryError(f"not a scalar: {e}")

    # -- vectors --------------------------------------------------------------------

    def vector(self, e: Expr, grid: Grid) -> Vector:
        if grid.n > 1 and not isinstance(e, Paren) and self._fixed(e):
            once = self.vector(e, Grid(grid.start, grid.start, grid.step))
            df = once.df.drop("step").withColumn("step", F.explode(grid.every()))
            return replace(once, df=df.select(_FRAME))
        if isinstance(e, Paren):
            return self.vector(e.expr, grid)
        if isinstance(e, Selector):
            return self._instant(e, grid)
        if isinstance(e, Unary):
            x = self.vector(e.expr, grid)
            return x if e.op == "+" else self._unnamed(x, x.df.withColumn("v", -F.col("v")))
        if isinstance(e, Binary):
            return self._binary(e, grid)
        if isinstance(e, Aggregate):
            return self._aggregate(e, grid)
        if isinstance(e, Call):
            return self._call(e, grid)
        raise QueryError(f"not a vector: {e}")

    def _at(self, e: Selector | Subquery, grid: Grid) -> Grid:
        grid = grid if e.at is None else Grid(e.at.ms, e.at.ms, grid.step)
        return grid.shift(-e.offset)

    def _labelled(self, e: Selector) -> Callable[[DataFrame], DataFrame]:
        series = selectors.select_series(self.store, e.matchers).select("series_id", "metric", "labels", L.key(F.col("labels")).alias("key"))
        return lambda df: df.join(series, "series_id")

    def _instant(self, e: Selector, grid: Grid, keep_time: bool = False) -> Vector:
        at = self._at(e, grid)
        lookback = self.options.lookback
        rows = selectors.select_samples(self.store, e.matchers, at.start - lookback, at.last)
        found = self._labelled(e)(selectors.instant(rows, at, lookback, ["series_id"]))
        found = found.withColumnRenamed("f", "v").where("v is not null")
        found = self._moved(found, e, grid)
        return Vector(found.select(*_FRAME, *(["ts"] if keep_time else [])), e.name is not None)

    def _moved(self, found: DataFrame, e: Selector | Subquery, grid: Grid) -> DataFrame:
        """From the times that a selector reads to the steps that ask for them."""
        if e.at is not None:
            return found.drop("step").withColumn("step", F.explode(grid.every()))
        return found.withColumn("step", F.col("step") + e.offset) if e.offset else found

    def _range(self, e: Expr, grid: Grid) -> Range:
        e = _strip(e)
        at = self._at(e, grid)
        if isinstance(e, Selector):
            rows = selectors.select_samples(self.store, e.matchers, at.start - e.range, at.last)
            if self.store.has_stale:
                rows = rows.where("not stale")
            rows = rows.where("f is not null").select("series_id", "ts", "f")
            return Range(rows, ["series_id"], self._labelled(e), e.name is not None, e.range, at)
        step = e.step or self.options.subquery_step
        first = (at.start - e.range) // step * step + step
        last = at.last // step * step
        none = last < first
        inner = Grid(first, max(first, last), step)
        x = self.vector(e.expr, inner) if e.expr.kind == VECTOR else self._from_scalar(e.expr, inner)
        rows = x.df.select("key", F.coalesce("metric", F.lit("")).alias("name"), F.col("step").alias("ts"), F.col("v").alias("f"))
        rows = rows.where(F.lit(False)) if none else rows

        def label(df: DataFrame) -> DataFrame:
            return df.withColumn("labels", L.from_key(F.col("key"))).withColumn("metric", F.when(F.col("name") != "", F.col("name")))

        return Range(rows, ["key", "name"], label, x.named, e.range, at)

    def _from_scalar(self, e: Expr, grid: Grid) -> Vector:
        s = self.scalar(e, grid)
        df = s.attach(grid.steps(self.spark)).withColumn("v", s.column.cast("double"))
        df = df.withColumn("labels", L.empty()).withColumn("key", F.lit("{}")).withColumn("metric", F.lit(None).cast("string"))
        return Vector(df.select(_FRAME), True)

    def _unnamed(self, x: Vector, df: DataFrame) -> Vector:
        """Without metric names; label sets that become equal are an error."""
        df = df.withColumn("metric", F.lit(None).cast("string")).select(_FRAME)
        if not x.named:
            df = matching.unique(df, ["step", "key"], "vector cannot contain metrics with the same labelset")
        return Vector(df, True)

    # -- operators ------------------------------------------------------------------

    def _binary(self, e: Binary, grid: Grid) -> Vector:
        if e.left.kind == VECTOR and e.right.kind == VECTOR:
            left, right = self.vector(e.left, grid), self.vector(e.right, grid)
            if e.op in SET_OPERATORS:
                return Vector(matching.set_operation(e.op, left.df, right.df, e.matching), e.op != "or" and left.named)
            df = matching.combine(e.op, left.df, right.df, e.matching, e.bool)
            return Vector(df, e.op not in COMPARISONS or e.bool or left.named)
        flipped = e.left.kind == SCALAR
        x, s = self.vector(e.right if flipped else e.left, grid), self.scalar(e.left if flipped else e.right, grid)
        df = s.attach(x.df)
        a, b = (s.column, F.col("v")) if flipped else (F.col("v"), s.column)
        if e.op in COMPARISONS:
            test = ieee.compare(e.op, a, b)
            if not e.bool:
                return Vector(df.where(test).select(_FRAME), x.named)
            return self._unnamed(x, df.withColumn("v", F.when(test, num(1.0)).otherwise(num(0.0))))
        return self._unnamed(x, df.withColumn("v", ieee.arithmetic(e.op, a, b)))

    def _aggregate(self, e: Aggregate, grid: Grid) -> Vector:
        x = self.vector(e.expr, grid)
        df, param = x.df, None
        if e.op == "count_values":
            param = _strip(e.param).value
        elif e.param is not None:
            s = self.scalar(e.param, grid)
            df, param = s.attach(df), s.column
        out = aggregations.aggregate(df, e.op, e.grouping, e.without, param)
        return Vector(out.select(_FRAME), x.named if e.op in ("topk", "bottomk", "limitk", "limit_ratio") else True)

    def _call(self, e: Call, grid: Grid) -> Vector:
        f, args = e.func, e.args
        if f == "absent_over_time":
            return self._absent_over_time(e, grid)
        if any(a.kind == MATRIX for a in args):
            return self._over_range(e, grid)
        if f in ieee.UNARY:
            x = self.vector(args[0], grid)
            return self._unnamed(x, x.df.withColumn("v", ieee.UNARY[f](F.col("v"))))
        if f in ieee.CALENDAR:
            x = self.vector(args[0], grid) if args else self._from_scalar(Call("time", (), SCALAR), grid)
            return self._unnamed(x, x.df.withColumn("v", ieee.calendar(f, F.col("v"))))
        if f in ("round", "clamp", "clamp_min", "clamp_max"):
            return self._with_scalars(e, grid)
        if f == "vector":
            return self._from_scalar(args[0], grid)
        if f == "timestamp":
            arg = _strip(args[0])
            if isinstance(arg, Selector):
                x = self._instant(arg, grid, keep_time=True)
                return self._unnamed(x, x.df.withColumn("v", F.col("ts") / 1000.0))
            x = self.vector(arg, grid)
            return self._unnamed(x, x.df.withColumn("v", F.col("step") / 1000.0))
        if f == "absent":
            return self._absent(self.vector(args[0], grid).df.select("step").distinct(), args[0], grid)
        if f.startswith("sort"):
            return self.vector(args[0], grid)
        if f == "label_replace":
            return self._label_replace(self.vector(args[0], grid), *(_strip(a).value for a in args[1:]))
        if f == "label_join":
            return self._label_join(self.vector(args[0], grid), *(_strip(a).value for a in args[1:]))
        if f == "histogram_quantile":
            s = self.scalar(args[0], grid)
            out = classic.histogram_quantile(s.attach(self.vector(args[1], grid).df), s.column)
            if self.store.has_histograms:
                native = s.attach(self.histograms(args[1], grid)).withColumn("v", histograms.quantile(F.col("h"), s.column))
                out = out.unionByName(native.withColumn("metric", F.lit(None).cast("string")).select(out.columns))
            return Vector(out, True)
        if f == "histogram_fraction":
            low, high = self.scalar(args[0], grid), self.scalar(args[1], grid)
            df = high.attach(low.attach(self.histograms(args[2], grid)))
            return self._unnamed(Vector(df), df.withColumn("v", histograms.fraction(F.col("h"), low.column, high.column)))
        if f in histograms.STATISTICS:
            df = self.histograms(args[0], grid)
            return self._unnamed(Vector(df), df.withColumn("v", histograms.STATISTICS[f](F.col("h"))))
        if f == "info":
            return self._info(e, grid)
        raise QueryError(f"function {f!r} needs native histograms, which the store does not hold")

    def histograms(self, e: Expr, grid: Grid) -> DataFrame:
        """(step, key, labels, metric, h) of an expression over native histograms; samples that
        are plain numbers take no part."""
        if not self.store.has_histograms:
            raise QueryError(f"{e}: the store holds no native histograms")
        frame = ["step", "key", "labels", "metric", "h"]
        unnamed = F.lit(None).cast("string")
        if isinstance(e, Paren):
            return self.histograms(e.expr, grid)
        if isinstance(e, Selector):
            at, lookback = self._at(e, grid), self.options.lookback
            rows = selectors.select_samples(self.store, e.matchers, at.start - lookback, at.last)
            found = self._labelled(e)(selectors.instant(rows, at, lookback, ["series_id"]))
            return self._moved(found.where("h is not null"), e, grid).select(frame)
        if isinstance(e, Unary):
            df = self.histograms(e.expr, grid)
            return df if e.op == "+" else df.withColumn("h", histograms.scale(F.col("h"), num(-1.0))).withColumn("metric", unnamed)
        if isinstance(e, Aggregate) and e.op in ("sum", "avg"):
            df = aggregations.grouped(self.histograms(e.expr, grid), e.grouping, e.without)
            out = histograms.sum_by(df.select("step", "gkey", "gmetric", "h"), ["step", "gkey", "gmetric"], e.op == "avg")
            return out.select("step", F.col("gkey").alias("key"), L.from_key(F.col("gkey")).alias("labels"), F.col("gmetric").alias("metric"), "h")
        if isinstance(e, Binary) and e.op in ("*", "/") and SCALAR in (e.left.kind, e.right.kind):
            flipped = e.left.kind == SCALAR
            if flipped and e.op == "/":
                raise QueryError("a number cannot be divided by a histogram")
            s = self.scalar(e.left if flipped else e.right, grid)
            df = s.attach(self.histograms(e.right if flipped else e.left, grid))
            h = (histograms.scale if e.op == "*" else histograms.divide_by)(F.col("h"), s.column)
            return df.withColumn("h", h).withColumn("metric", unnamed).select(frame)
        if isinstance(e, Binary) and e.op in ("+", "-") and e.matching.group is None:
            left, right = self.histograms(e.left, grid), self.histograms(e.right, grid)
            sig = lambda df: df.withColumn("sig", matching.signature(F.col("labels"), e.matching))
            right = sig(right).select("step", "sig", F.col("h").alias("other"))
            names = tuple(n for n in e.matching.labels if n != "__name__")
            both = sig(left).join(right, ["step", "sig"])
            labels = L.only(F.col("labels"), names) if e.matching.on else L.without(F.col("labels"), names)
            both = both.withColumn("h", histograms.combine(F.col("h"), F.col("other"), 1.0 if e.op == "+" else -1.0)).where("h is not null")
            return both.withColumn("labels", labels).withColumn("key", L.key(F.col("labels"))).withColumn("metric", unnamed).select(frame)
        if isinstance(e, Call) and e.func in ("rate", "increase", "delta") and isinstance(_strip(e.args[0]), Selector):
            return self._histogram_increase(e.func, _strip(e.args[0]), grid).select(frame)
        raise QueryError(f"not an expression over native histograms: {e}")

    def _histogram_increase(self, func: str, e: Selector, grid: Grid) -> DataFrame:
        """As for numbers: the change between the first and the last histogram of a window,
        extrapolated to its edges; the points of a window are an array, which the range bounds."""
        at = self._at(e, grid)
        rows = selectors.select_samples(self.store, e.matchers, at.start - e.range, at.last)
        rows = rows.where("not stale") if self.store.has_stale else rows
        plain = F.max(F.col("f").isNotNull() & F.col("h").isNull())
        found = selectors.in_windows(rows.select("series_id", "ts", "f", "h"), at, e.range).groupBy("series_id", "step")
        in_time = lambda x, y: F.when(x["ts"] < y["ts"], -1).when(x["ts"] > y["ts"], 1).otherwise(0)
        found = found.agg(F.array_sort(F.collect_list(F.struct("ts", "h")), in_time).alias("p"), plain.alias("mixed")).where("size(p) > 1 and not mixed")
        first, last = F.element_at("p", 1)["ts"], F.element_at("p", -1)["ts"]
        sampled = (last - first) / 1000.0
        each = sampled / (F.size("p") - 1)
        start, end = (first - (F.col("step") - e.range)) / 1000.0, (F.col("step") - last) / 1000.0
        reach = lambda gap: F.when(gap >= each * 1.1, each / 2).otherwise(gap)
        factor = (sampled + reach(start) + reach(end)) / sampled / (e.range / 1000.0 if func == "rate" else 1.0)
        found = found.withColumn("h", histograms.scale(histograms.increase(F.col("p"), func != "delta"), factor)).where("h is not null")
        return self._moved(self._labelled(e)(found), e, grid).withColumn("metric", F.lit(None).cast("string"))

    def _over_range(self, e: Call, grid: Grid) -> Vector:
        r = self._range(next(a for a in e.args if a.kind == MATRIX), grid)
        params = [self.scalar(a, r.grid) for a in e.args if a.kind == SCALAR]
        if any(p.frame is not None for p in params):
            raise QueryError(f"{e.func}: scalar arguments must not depend on series")
        df = ranges.evaluate(e.func, r.rows, r.grid, r.length, r.by, [p.column for p in params])
        df = self._moved(r.label(df), _strip(next(a for a in e.args if a.kind == MATRIX)), grid)
        x = Vector(df.select(_FRAME), r.named)
        return x if e.func == "last_over_time" else self._unnamed(x, x.df)

    def _with_scalars(self, e: Call, grid: Grid) -> Vector:
        x = self.vector(e.args[0], grid)
        df, columns = x.df, []
        for a in e.args[1:]:
            s = self.scalar(a, grid)
            df = s.attach(df)
            columns.append(s.column)
        v = F.col("v")
        if e.func == "round":
            value = ieee.round_to(v, columns[0] if columns else num(1.0))
        elif e.func == "clamp":
            low, high = columns
            df = df.where(~(high < low) | F.isnan(low) | F.isnan(high))
            value = ieee.highest(low, ieee.lowest(high, v))
        else:
            value = (ieee.highest if e.func == "clamp_min" else ieee.lowest)(columns[0], v)
        return self._unnamed(x, df.withColumn("v", value))

    def _absent(self, present: DataFrame, e: Expr, grid: Grid) -> Vector:
        """1 with the labels that the selector asks for by equality, where nothing is present."""
        e = _strip(e)
        found: dict[str, str] = {}
        if isinstance(e, Selector):
            names = [m.name for m in e.matchers]
            found = {m.name: m.value for m in e.matchers if m.op == "=" and names.count(m.name) == 1 and m.name != "__name__"}
        pairs = [x for name in sorted(found) for x in (F.lit(name), F.lit(found[name]))]
        df = grid.steps(self.spark).join(present, "step", "left_anti")
        df = df.withColumn("labels", L.normal(F.create_map(*pairs)) if pairs else L.empty()).withColumn("key", L.key(F.col("labels")))
        return Vector(df.withColumn("metric", F.lit(None).cast("string")).withColumn("v", num(1.0)).select(_FRAME), True)

    def _absent_over_time(self, e: Call, grid: Grid) -> Vector:
        arg = _strip(e.args[0])
        r = self._range(arg, grid)
        present = self._moved(selectors.in_windows(r.rows, r.grid, r.length).select("step").distinct(), arg, grid)
        return self._absent(present, arg, grid)

    def _label_replace(self, x: Vector, dst: str, replacement: str, src: str, pattern: str) -> Vector:
        regex = java_regex(pattern)
        value = F.coalesce("metric", F.lit("")) if src == "__name__" else L.value(F.col("labels"), src)
        new = F.regexp_replace(value, regex, java_replacement(replacement))
        return self._relabelled(x, dst, new, F.when(value.rlike(regex), F.lit(True)).otherwise(F.lit(False)))

    def _label_join(self, x: Vector, dst: str, separator: str, *sources: str) -> Vector:
        values = [F.coalesce("metric", F.lit("")) if s == "__name__" else L.value(F.col("labels"), s) for s in sources]
        return self._relabelled(x, dst, F.concat_ws(separator, *values) if values else F.lit(""), F.lit(True))

    def _relabelled(self, x: Vector, dst: str, value: Column, when: Column) -> Vector:
        df = x.df
        if dst == "__name__":
            df = df.withColumn("metric", F.when(when, F.nullif(value, F.lit(""))).otherwise(F.col("metric")))
        else:
            df = df.withColumn("labels", F.when(when, L.put(F.col("labels"), dst, value)).otherwise(F.col("labels")))
            df = df.withColumn("key", L.key(F.col("labels")))
        df = matching.unique(df, ["step", "key", "metric"], "vector cannot contain metrics with the same labelset")
        return Vector(df.select(_FRAME), x.named and dst != "__name__")

    def _info(self, e: Call, grid: Grid) -> Vector:
        """Add the labels of the newest info series with the same instance and job."""
        base = self.vector(e.args[0], grid)
        given = e.args[1].matchers if len(e.args) == 2 else ()
        names = [m for m in given if m.name == "__name__"] or [Matcher("__name__", "=", "target_info")]
        wanted = [m for m in given if m.name != "__name__"]
        identity = ("instance", "job")
        info = self._instant(Selector(tuple(names)), grid, keep_time=True).df
        for m in wanted:
            info = info.where(L.matches(m, F.col("metric"), F.col("labels")))
        extra = L.without(F.col("labels"), identity)
        if wanted:
            extra = L.only(extra, tuple(m.name for m in wanted))
        info = info.withColumn("sig", L.key(L.only(F.col("labels"), identity)))
        info = info.groupBy("step", "sig").agg(F.max(F.struct("ts", L.key(extra).alias("extra"))).alias("x")).select("step", "sig", "x.extra")
        df = base.df.withColumn("sig", L.key(L.only(F.col("labels"), identity)))
        own = F.lit(False)
        for m in names:
            own = own | L.matches(m, F.col("metric"), F.col("labels"))
        must = any(not matches_empty(m) for m in wanted)
        df = df.join(info, ["step", "sig"], "left").where(F.col("extra").isNotNull() | own) if must else df.join(info, ["step", "sig"], "left")
        have = F.col("labels")
        new = F.map_filter(L.from_key(F.col("extra")), lambda k, _: ~F.map_contains_key(have, k))
        labels = F.when(F.col("extra").isNotNull() & ~own, L.normal(F.map_concat(have, new))).otherwise(have)
        df = df.withColumn("labels", labels).withColumn("key", L.key(F.col("labels")))
        return Vector(df.select(_FRAME), base.named)


def _strip(e: Expr) -> Expr:
    while isinstance(e, Paren):
        e = e.expr
    return e


def java_replacement(text: str) -> str:
    """$1, ${1} and ${name} of the language in Java's form; other characters stand for themselves."""
    out, at = "", 0
    for m in re.finditer(r"\$(?:\$|\{(\w+)\}|(\w+))", text):
        out += text[at : m.start()].replace("\\", "\\\\").replace("$", "\\$")
        name = m[1] or m[2]
        if name is None:
            out += "\\$"
        elif name.isdigit():
            out += f"${name}"
        elif re.fullmatch(r"[a-zA-Z][a-zA-Z0-9]*", name):
            out += f"${{{name}}}"
        # Other names (as in $1_x) are of no group and stand for nothing.
        at = m.end()
    return out + text[at:].replace("\\", "\\\\").replace("$", "\\$")


def _order(e: Call) -> list[Column]:
    if e.func in ("sort", "sort_desc"):
        v = F.col("v")
        return [F.isnan(v), v.asc() if e.func == "sort" else v.desc()]
    down = e.func.endswith("desc")
    keys = [natural(L.value(F.col("labels"), _strip(a).value)) for a in e.args[1:]]
    keys.append(L.key(F.col("labels")))
    return [k.desc() if down else k.asc() for k in keys]


def natural(text: Column) -> Column:
    """A text that sorts as the given one, but its numbers by value (up to 20 digits)."""
    padded = F.regexp_replace(text, r"(\d+)", "00000000000000000000$1")
    return F.regexp_replace(padded, r"\d*(\d{20})(?!\d)", "$1")
