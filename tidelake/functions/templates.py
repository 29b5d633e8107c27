"""Texts of alerts with {{ expressions }}: the value, labels, and functions over them."""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from datetime import UTC, datetime
from urllib.parse import quote

from tidelake.plans.ast import QueryError, format_number
from tidelake.plans.parser import parse_duration, python_regex


def _short(v: float) -> str:
    return f"{v:.4g}"


def humanize(v: float) -> str:
    if v == 0 or math.isnan(v) or math.isinf(v):
        return _short(v)
    prefixes = ["k", "M", "G", "T", "P", "E", "Z", "Y"] if abs(v) >= 1 else ["m", "u", "n", "p", "f", "a", "z", "y"]
    mark = ""
    for p in prefixes:
        if (abs(v) >= 1) if prefixes[0] == "m" else (abs(v) < 1000):
            break
        mark, v = p, v * 1000 if prefixes[0] == "m" else v / 1000
    return _short(v) + mark


def humanize1024(v: float) -> str:
    if abs(v) <= 1 or math.isnan(v) or math.isinf(v):
        return _short(v)
    mark = ""
    for p in ["ki", "Mi", "Gi", "Ti", "Pi", "Ei", "Zi", "Yi"]:
        if abs(v) < 1024:
            break
        mark, v = p, v / 1024
    return _short(v) + mark


def humanize_duration(v: float) -> str:
    if math.isnan(v) or math.isinf(v):
        return _short(v)
    if v == 0:
        return "0s"
    if abs(v) >= 1:
        sign, n = ("-" if v < 0 else ""), abs(v)
        seconds, minutes, hours, days = int(n) % 60, int(n) // 60 % 60, int(n) // 3600 % 24, int(n) // 86400
        if days:
            return f"{sign}{days}d {hours}h {minutes}m {seconds}s"
        if hours:
            return f"{sign}{hours}h {minutes}m {seconds}s"
        if minutes:
            return f"{sign}{minutes}m {seconds}s"
        return f"{sign}{n:.4g}s"
    for p in ["m", "u", "n", "p", "f", "a", "z", "y"]:
        v *= 1000
        if abs(v) >= 1:
            break
    return f"{_short(v)}{p}s"


def humanize_percentage(v: float) -> str:
    return f"{v * 100:.4g}%"


def humanize_timestamp(v: float) -> str:
    if math.isnan(v) or math.isinf(v):
        return _short(v)
    return datetime.fromtimestamp(v, UTC).strftime("%Y-%m-%d %H:%M:%S +0000 UTC")


def strip_port(host: str) -> str:
    return re.sub(r":\d+\Z", "", host) if not host.startswith("[") else host[1:].partition("]")[0]


def strip_domain(host: str) -> str:
    name, mark, port = host.partition(":")
    if re.fullmatch(r"[\d.]+", name):
        return host
    return name.partition(".")[0] + mark + port


class Template:
    """{{ $value }}, {{ $labels.name }}, {{ function argument... }} and pipelines with |."""

    def __init__(self, query: Callable[[str], list[tuple[dict, float]]] | None = None, external_url: str = "", path_prefix: str = ""):
        self.query, self.external_url, self.path_prefix = query, external_url, path_prefix
        self.functions: dict[str, Callable] = {
            "query": self._query, "first": self._first, "value": lambda s: s[1], "strvalue": lambda s: s[0].get("__value__", ""),
            "label": lambda name, s: s[0].get(name, ""), "humanize": lambda v: humanize(float(v)), "humanize1024": lambda v: humanize1024(float(v)),
            "humanizeDuration": lambda v: humanize_duration(float(v)), "humanizePercentage": lambda v: humanize_percentage(float(v)),
            "humanizeTimestamp": lambda v: humanize_timestamp(float(v)), "toTime": lambda v: datetime.fromtimestamp(float(v), UTC),
            "match": lambda p, s: bool(re.search(python_regex(p), s)), "title": lambda s: s.title(), "toUpper": lambda s: s.upper(), "toLower": lambda s: s.lower(),
            "reReplaceAll": lambda p, r, s: re.sub(python_regex(p), re.sub(r"\$\{?(\w+)\}?", r"\\g<\1>", r), s),
            "sortByLabel": lambda name, v: sorted(v, key=lambda s: s[0].get(name, "")), "stripPort": strip_port, "stripDomain": strip_domain,
            "parseDuration": lambda s: parse_duration(s) / 1000, "safeHtml": lambda s: s, "args": lambda *a: {f"arg{k}": v for k, v in enumerate(a)},
            "graphLink": lambda e: f"/graph?g0.expr={quote(e, safe='')}&g0.tab=0", "tableLink": lambda e: f"/graph?g0.expr={quote(e, safe='')}&g0.tab=1",
            "externalURL": lambda: self.external_url, "pathPrefix": lambda: self.path_prefix,
        }

    def _query(self, text: str):
        if self.query is None:
            raise QueryError("this template cannot query")
        return self.query(text)

    def _first(self, found):
        if not found:
            raise QueryError("first() called on vector with no elements")
        return found[0]

    def expand(self, text: str, labels: dict[str, str], value: float, external: dict[str, str] | None = None) -> str:
        scope = {"$labels": labels, "$value": value, "$externalLabels": external or {}}
        return re.sub(r"\{\{-?\s*(.*?)\s*-?\}\}", lambda m: self._text(self._pipeline(m[1], scope)), text, flags=re.S)

    @staticmethod
    def _text(v) -> str:
        return format_number(v) if isinstance(v, float) else str(v)

    def _pipeline(self, text: str, scope: dict):
        result, first = None, True
        for part in re.split(r"\|(?=(?:[^\"`]|\"[^\"]*\"|`[^`]*`)*\Z)", text):
            words = re.findall(r'"(?:\\.|[^"\\])*"|`[^`]*`|\S+', part.strip())
            if not words:
                raise QueryError(f"empty expression in template: {text!r}")
            values = [self._word(w, scope) for w in words[1:]] + ([] if first else [result])
            if words[0] in self.functions:
                result = self.functions[words[0]](*values)
            elif values:
                raise QueryError(f"function {words[0]!r} not defined")
            else:
                result = self._word(words[0], scope)
            first = False
        return result

    @staticmethod
    def _word(word: str, scope: dict):
        if word[0] in "\"`":
            return word[1:-1].replace('\\"', '"') if word[0] == '"' else word[1:-1]
        name, _, field = word.partition(".")
        if name in scope:
            return scope[name].get(field, "") if field else scope[name]
        try:
            return float(word)
        except ValueError as e:
            raise QueryError(f"cannot read {word!r} in template") from e
