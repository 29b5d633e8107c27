"""A session over a store: queries, metadata, and texts of queries, without a server."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelake.model import Store
from tidelake.operators import labels as L
from tidelake.operators import selectors
from tidelake.plans import ast
from tidelake.plans.engine import Engine, Options
from tidelake.plans.parser import parse, parse_selector


@dataclass(frozen=True)
class Result:
    """Rows of a query with its type, and whether a limit has cut them."""

    kind: str
    rows: list[dict]
    truncated: bool
    seconds: float


class Session:
    def __init__(self, store: Store, options: Options | None = None):
        self.store, self.engine = store, Engine(store, options)

    # -- queries ------------------------------------------------------------------------

    def instant(self, text: str, time_ms: int) -> DataFrame:
        return self.engine.instant_query(text, time_ms)

    def range(self, text: str, start: int, end: int, step: int) -> DataFrame:
        """Rows ordered by label set and step, as results of range queries are."""
        return self.engine.range_query(text, start, end, step).orderBy("metric", F.to_json("labels"), "step")

    def fetch(self, df: DataFrame, kind: str, limit: int | None = None) -> Result:
        """Run a query; with a limit one row more is asked for, to know whether any is missing."""
        began = time.monotonic()
        rows = [r.asDict(recursive=True) for r in (df if limit is None else df.limit(limit + 1)).collect()]
        cut = limit is not None and len(rows) > limit
        return Result(kind, rows[:limit] if cut else rows, cut, time.monotonic() - began)

    def json(self, df: DataFrame) -> DataFrame:
        """One JSON text (value) for each series: its labels and its points in order."""
        points = F.array_sort(F.collect_list(F.struct((F.col("step") / 1000.0).alias("t"), F.col("v").cast("string").alias("v"))))
        named = F.when(F.col("metric").isNotNull(), F.map_concat(F.create_map(F.lit("__name__"), F.coalesce("metric", F.lit(""))), F.col("labels"))).otherwise(F.col("labels"))
        out = df.withColumn("key", F.to_json(named)).groupBy("key").agg(points.alias("values"))
        return out.select(F.to_json(F.struct(L.from_key(F.col("key")).alias("metric"), "values")).alias("value"))

    # -- metadata -------------------------------------------------------------------------

    def _active(self, matchers: list[str], start: int | None, end: int | None) -> DataFrame:
        """Series that any of the selectors takes, with samples in the time range if given."""
        found = None
        for text in matchers or [None]:
            one = self.store.series if text is None else selectors.select_series(self.store, parse_selector(text))
            found = one if found is None else found.unionByName(one)
        found = found.withColumn("key", F.to_json("labels")).dropDuplicates(["series_id"])
        if start is not None or end is not None:
            rows = self.store.samples
            if start is not None:
                rows = rows.where(F.col("ts") >= start)
            if end is not None:
                rows = rows.where(F.col("ts") <= end)
            found = found.join(rows.select("series_id").distinct(), "series_id", "left_semi")
        return found

    def series(self, matchers: list[str], start: int | None = None, end: int | None = None) -> DataFrame:
        return self._active(matchers, start, end).select("metric", L.from_key(F.col("key")).alias("labels"))

    def label_names(self, matchers: list[str] | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
        found = self._active(matchers or [], start, end)
        names = found.select(F.explode(F.concat(F.map_keys(L.from_key(F.col("key"))), F.array(F.lit("__name__")))).alias("name"))
        return names.distinct().orderBy("name")

    def label_values(self, name: str, matchers: list[str] | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
        found = self._active(matchers or [], start, end)
        value = F.col("metric") if name == "__name__" else F.element_at(L.from_key(F.col("key")), F.lit(name))
        return found.select(value.alias("value")).where("value is not null").distinct().orderBy("value")

    def exemplars(self, text: str, start: int, end: int) -> DataFrame:
        """Exemplars of all series that the expression's selectors take, in a time range."""
        found: list[ast.Selector] = []

        def walk(e: ast.Expr) -> None:
            if isinstance(e, ast.Selector):
                found.append(e)
            for c in ast.children(e):
                walk(c)

        walk(parse(text))
        ids = None
        for e in found:
            one = selectors.select_series(self.store, e.matchers).select("series_id", "metric", F.to_json("labels").alias("key"))
            ids = one if ids is None else ids.unionByName(one)
        rows = self.store.exemplars.where((F.col("ts") >= start) & (F.col("ts") <= end))
        return rows.join(ids.distinct(), "series_id").select("metric", L.from_key(F.col("key")).alias("labels"), "ts", "value", "ex_labels")

    def metadata(self, metric: str | None = None) -> DataFrame:
        found = self.store.metadata
        return found if metric is None else found.where(F.col("metric") == metric)

    # -- texts --------------------------------------------------------------------------------

    @staticmethod
    def format(text: str) -> str:
        return ast.pretty(parse(text))

    @staticmethod
    def tree(text: str) -> dict:
        return ast.to_tree(parse(text))

    @staticmethod
    def set_matcher(text: str, name: str, op: str, value: str) -> str:
        """The expression with a matcher put into each of its selectors."""
        return str(_each_selector(parse(text), lambda e: [m for m in e if m.name != name] + [ast.Matcher(name, op, value)]))

    @staticmethod
    def drop_matcher(text: str, name: str) -> str:
        return str(_each_selector(parse(text), lambda e: [m for m in e if m.name != name]))


def _each_selector(e: ast.Expr, change) -> ast.Expr:
    from dataclasses import replace

    if isinstance(e, ast.Selector):
        return replace(e, matchers=tuple(change(list(e.matchers))))
    if isinstance(e, ast.Paren | ast.Unary | ast.Subquery):
        return replace(e, expr=_each_selector(e.expr, change))
    if isinstance(e, ast.Binary):
        return replace(e, left=_each_selector(e.left, change), right=_each_selector(e.right, change))
    if isinstance(e, ast.Aggregate):
        return replace(e, expr=_each_selector(e.expr, change), param=e.param and _each_selector(e.param, change))
    if isinstance(e, ast.Call):
        return replace(e, args=tuple(_each_selector(a, change) for a in e.args))
    return e
