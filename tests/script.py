"""Short scripts of series for tests: one series a line, as `name{label="value"} points`.

Points: a number; `a+bxn` for a, a+b, ... (n more); `axn` for n+1 times a; `_` or `_xn` for
gaps; `stale` for an end marker.
"""

from __future__ import annotations

import math
import re

from tidelake.model import Store, store_of
from tidelake.plans.engine import Engine, Options
from tidelake.plans.parser import parse_duration, parse_selector

_STEP = re.compile(r"(-?[\d.]+|NaN|[+-]?Inf)(?:([+-][\d.]+))?(?:x(\d+))?\Z")
ROW = "metric string, labels map<string,string>, ts long, f double, stale boolean"


def points(text: str) -> list[float | None | str]:
    out: list = []
    for word in text.split():
        if word == "stale":
            out.append("stale")
        elif word.startswith("_"):
            out += [None] * int(word[2:] or 1)
        else:
            m = _STEP.match(word)
            first, by, n = float(m[1]), float(m[2] or 0), int(m[3] or 0)
            out += [first + by * k for k in range(n + 1)]
    return out


def load(spark, interval: str, text: str) -> Store:
    rows, step = [], parse_duration(interval)
    for line in filter(None, map(str.strip, text.splitlines())):
        name, rest = re.match(r"([^{\s]+(?:\{[^}]*\})?)\s+(.*)", line).groups()
        matchers = {m.name: m.value for m in parse_selector(name)}
        metric = matchers.pop("__name__")
        for k, p in enumerate(points(rest)):
            if p is not None:
                rows.append((metric, matchers, k * step, None if p == "stale" else p, p == "stale"))
    return store_of(spark.createDataFrame(rows, ROW))


def key(metric: str | None, labels: dict[str, str]) -> str:
    inner = ",".join(f"{k}={labels[k]}" for k in sorted(labels))
    return f"{metric or ''}{{{inner}}}"


def instant(store: Store, expr: str, at: str | int, **options) -> dict[str, float]:
    ms = parse_duration(at) if isinstance(at, str) else at
    rows = Engine(store, Options(**options)).instant_query(expr, ms).collect()
    return {key(r["metric"], r["labels"]): r["v"] for r in rows}


def over(store: Store, expr: str, start: str, end: str, step: str, **options) -> dict[str, dict[int, float]]:
    rows = Engine(store, Options(**options)).range_query(expr, *map(parse_duration, (start, end, step))).collect()
    out: dict[str, dict[int, float]] = {}
    for r in rows:
        out.setdefault(key(r["metric"], r["labels"]), {})[r["step"] // 1000] = r["v"]
    return out


def same(got: dict[str, float], want: dict[str, float]) -> None:
    assert set(got) == set(want), (got, want)
    for k, v in want.items():
        g = got[k]
        assert (math.isnan(g) and math.isnan(v)) or g == v or math.isclose(g, v, rel_tol=1e-6), (k, g, v)


def same_over(got: dict[str, dict[int, float]], want: dict[str, dict[int, float]]) -> None:
    assert set(got) == set(want), (got, want)
    for k in want:
        same({str(t): v for t, v in got[k].items()}, {str(t): v for t, v in want[k].items()})
