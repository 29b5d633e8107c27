"""Text formats of exposed metrics: the plain one and the stricter one with an end mark,
exemplars and creation times.

A payload is one exposition: its lines depend on each other (types, end mark), so one
row holds a whole payload and payloads are parsed in Arrow batches, in parallel.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NAME = r"[a-zA-Z_:][a-zA-Z0-9_:]*"
_LABELS = re.compile(r'\s*(?:("(?:\\.|[^"\\])*")|([a-zA-Z_][a-zA-Z0-9_.]*))\s*(?:=\s*"((?:\\.|[^"\\])*)")?\s*(?:,|(?=\}))')
_NUMBER = re.compile(r"[+-]?(?:inf(?:inity)?|nan|0x[0-9a-f]+|(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?)\Z", re.I)
TYPES = frozenset("counter gauge histogram summary untyped unknown info stateset gaugehistogram".split())


class FormatError(ValueError):
    """A payload that breaks the format, with the line where it does."""


@dataclass
class Parsed:
    """rows: (metric, labels, ts or None, value, exemplar or None); metadata: name -> (type, unit, help)."""

    rows: list[tuple[str, dict[str, str], int | None, float, tuple | None]] = field(default_factory=list)
    metadata: dict[str, list[str]] = field(default_factory=dict)
    created: dict[tuple, int] = field(default_factory=dict)


def _unescape(s: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"n": "\n"}.get(m[1], m[1]), s)


def _number(text: str) -> float:
    if not _NUMBER.match(text):
        raise FormatError(f"not a number: {text!r}")
    return float(int(text, 16)) if "0x" in text.lower() else float(text)


def _braces(line: str, at: int) -> tuple[str | None, dict[str, str], int]:
    """(quoted metric name, labels, end) of the braces that open at `at`."""
    name, labels = None, {}
    at += 1
    while True:
        rest = line[at:].lstrip()
        if rest.startswith("}"):
            return name, labels, len(line) - len(rest) + 1
        m = _LABELS.match(line, at)
        if not m:
            raise FormatError(f"bad labels: {line!r}")
        key = _unescape(m[1][1:-1]) if m[1] else m[2]
        if m[3] is None:
            if not m[1] or name is not None:
                raise FormatError(f"label without a value: {line!r}")
            name = key
        elif key in labels:
            raise FormatError(f"label {key!r} twice")
        else:
            labels[key] = _unescape(m[3])
        at = m.end()


def _sample(line: str, strict: bool) -> tuple[str, dict[str, str], float, int | None, tuple | None]:
    m = re.match(_NAME, line)
    name, at = (m[0], m.end()) if m else (None, 0)
    labels: dict[str, str] = {}
    rest = line[at:]
    if rest.lstrip().startswith("{"):
        quoted, labels, at = _braces(line, at + len(rest) - len(rest.lstrip()))
        name = name or quoted
    if not name:
        raise FormatError(f"no metric name: {line!r}")
    body, mark, extra = line[at:].partition(" # ")
    if mark and not strict:
        raise FormatError(f"exemplar in the plain format: {line!r}")
    parts = body.split()
    if not 1 <= len(parts) <= 2:
        raise FormatError(f"expected a value and perhaps a time: {line!r}")
    value, ts = _number(parts[0]), None
    if len(parts) == 2:
        ts = round(_number(parts[1]) * 1000) if strict else int(parts[1])
    exemplar = None
    if mark:
        extra = extra.strip()
        if not extra.startswith("{"):
            raise FormatError(f"bad exemplar: {line!r}")
        _, marked, end = _braces(extra, 0)
        values = extra[end:].split()
        if not 1 <= len(values) <= 2 or sum(len(k) + len(v) for k, v in marked.items()) > 128:
            raise FormatError(f"bad exemplar: {line!r}")
        exemplar = (marked, _number(values[0]), round(_number(values[1]) * 1000) if len(values) == 2 else ts)
    return name, labels, value, ts, exemplar


def parse(text: str, strict: bool = False) -> Parsed:
    """`strict` is the format that ends in `# EOF` and has times in seconds."""
    out, ended = Parsed(), False
    for number, line in enumerate(text.split("\n"), 1):
        try:
            if ended and line.strip():
                raise FormatError("data after the end mark")
            if not line.strip():
                if strict and line != "" and not ended:
                    raise FormatError("empty line")
                continue
            if line.lstrip().startswith("#"):
                words = line.strip().split(" ", 3)
                if strict and line == "# EOF":
                    ended = True
                elif len(words) >= 3 and words[1] in ("HELP", "TYPE", "UNIT"):
                    found = out.metadata.setdefault(words[2], ["unknown", "", ""])
                    value = words[3] if len(words) > 3 else ""
                    if words[1] == "TYPE" and value not in TYPES:
                        raise FormatError(f"unknown type {value!r}")
                    found[{"TYPE": 0, "UNIT": 1, "HELP": 2}[words[1]]] = _unescape(value) if words[1] == "HELP" else value
                continue
            name, labels, value, ts, exemplar = _sample(line.strip(), strict)
            if strict and name.endswith("_created") and out.metadata.get(name.removesuffix("_created"), [""])[0] in ("counter", "histogram", "summary"):
                out.created[name.removesuffix("_created"), tuple(sorted(labels.items()))] = round(value * 1000)
                continue
            out.rows.append((name, labels, ts, value, exemplar))
        except (FormatError, ValueError) as e:
            raise FormatError(f"line {number}: {e}") from e
    if strict and not ended:
        raise FormatError("no end mark")
    return out


_ROW = pa.schema(
    [
        ("metric", pa.string()), ("labels", pa.map_(pa.string(), pa.string())), ("ts", pa.int64()), ("f", pa.float64()), ("created", pa.int64()),
        ("exemplar", pa.struct([("labels", pa.map_(pa.string(), pa.string())), ("value", pa.float64()), ("ts", pa.int64())])), ("type", pa.string()), ("error", pa.string()),
    ]
)
_SCHEMA = "metric string, labels map<string,string>, ts long, f double, created long, exemplar struct<labels:map<string,string>,value:double,ts:long>, type string, error string"


def _family(name: str, metadata: dict) -> str:
    for suffix in ("", "_total", "_bucket", "_sum", "_count"):
        found = metadata.get(name.removesuffix(suffix)) if name.endswith(suffix) else None
        if found:
            return found[0]
    return "unknown"


def read(payloads: DataFrame, strict: bool = False) -> DataFrame:
    """Rows of all payloads (body string, ts long: the time for rows without one).  A payload
    that breaks the format gives one row with `error` and no samples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body, now in zip(batch.column("body").to_pylist(), batch.column("ts").to_pylist(), strict=True):
                try:
                    found = parse(body or "", strict)
                except FormatError as e:
                    yield pa.RecordBatch.from_pylist([{"error": str(e)}], _ROW)
                    continue
                rows = []
                for name, labels, ts, value, exemplar in found.rows:
                    base = re.sub(r"_(total|bucket|sum|count)\Z", "", name)
                    own = tuple(sorted((k, v) for k, v in labels.items() if k not in ("le", "quantile")))
                    rows.append(
                        {
                            "metric": name, "labels": list(labels.items()), "ts": now if ts is None else ts, "f": value, "created": found.created.get((base, own)),
                            "exemplar": exemplar and {"labels": list(exemplar[0].items()), "value": exemplar[1], "ts": now if exemplar[2] is None else exemplar[2]},
                            "type": _family(name, found.metadata),
                        }
                    )
                yield pa.RecordBatch.from_pylist(rows, _ROW)

    return payloads.select("body", "ts").mapInArrow(run, _SCHEMA)


# -- writing ------------------------------------------------------------------------------------------


def format_line(metric: Column, labels: Column, value: Column, ts: Column | None = None, seconds: bool = False) -> Column:
    """One line for a sample."""
    from tidelake.functions.ieee import format_value

    escaped = lambda v: F.regexp_replace(F.regexp_replace(F.regexp_replace(v, r"\\", r"\\\\"), '"', r'\\"'), "\n", r"\\n")
    pairs = F.transform(F.map_entries(labels), lambda e: F.concat(e["key"], F.lit('="'), escaped(e["value"]), F.lit('"')))
    body = F.when(F.size(pairs) > 0, F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))).otherwise(F.lit(""))
    parts = [F.concat(F.coalesce(metric, F.lit("")), body), format_value(value)]
    if ts is not None:
        parts.append((ts / 1000.0).cast("decimal(20,3)").cast("string") if seconds else ts.cast("string"))
    return F.concat_ws(" ", *parts)


def dump(store, mint: int, maxt: int, seconds: bool = False) -> DataFrame:
    """All samples of a time range as lines (value), to be written as text."""
    rows = store.samples.where((F.col("ts") >= mint) & (F.col("ts") <= maxt) & F.col("f").isNotNull()).select("series_id", "ts", "f")
    rows = rows.join(store.series.select("series_id", "metric", "labels"), "series_id")
    return rows.select(format_line(F.col("metric"), F.col("labels"), F.col("f"), F.col("ts"), seconds).alias("value"))


def federate(engine, selectors: list[str], now: int) -> DataFrame:
    """The newest sample in the lookback of every series that one of the selectors takes, as lines."""
    found = None
    for selector in selectors:
        one = engine.instant_query(f"{selector}", now)
        found = one if found is None else found.unionByName(one)
    found = found.withColumn("key", F.to_json("labels")).dropDuplicates(["metric", "key"])
    return found.orderBy("metric", "key").select(format_line(F.col("metric"), F.col("labels"), F.col("v"), F.lit(now)).alias("value"))
