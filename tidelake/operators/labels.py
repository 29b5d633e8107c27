"""Label sets: a map without empty values, in the order of names, and its key as text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidelake.plans.ast import Matcher


def normal(labels: Column) -> Column:
    """Sorted by name; an empty value is the same as no label."""
    entries = F.array_sort(F.filter(F.map_entries(labels), lambda e: F.coalesce(e["value"], F.lit("")) != ""))
    return F.map_from_entries(entries)


def key(labels: Column) -> Column:
    return F.to_json(labels)


def from_key(text: Column) -> Column:
    return F.from_json(text, "map<string,string>")


def empty() -> Column:
    return F.from_json(F.lit("{}"), "map<string,string>")


def of(names: list[str]) -> Column:
    """The label set of columns of these names."""
    pairs = [F.struct(F.lit(n).alias("key"), F.col(n).cast("string").alias("value")) for n in sorted(names)]
    if not pairs:
        return empty()
    return F.map_from_entries(F.filter(F.array(*pairs), lambda e: F.coalesce(e["value"], F.lit("")) != ""))


def only(labels: Column, names: tuple[str, ...]) -> Column:
    return F.map_filter(labels, lambda k, _: k.isin(*names)) if names else empty()


def without(labels: Column, names: tuple[str, ...]) -> Column:
    return F.map_filter(labels, lambda k, _: ~k.isin(*names)) if names else labels


def put(labels: Column, name: str, value: Column) -> Column:
    rest = F.filter(F.map_entries(labels), lambda e: e["key"] != name)
    new = F.array(F.struct(F.lit(name).alias("key"), value.alias("value")))
    return normal(F.map_from_entries(F.concat(rest, new)))


def value(labels: Column, name: str) -> Column:
    return F.coalesce(F.element_at(labels, F.lit(name)), F.lit(""))


_LITERAL = re.compile(r"[\w \-/:,@%&~\"'<>=#!;]*\Z")


def java_regex(pattern: str) -> str:
    """The pattern anchored on both sides, with Java's names for groups."""
    return r"\A(?s:" + re.sub(r"\(\?P<", "(?<", pattern) + r")\z"


def literals(pattern: str) -> list[str] | None:
    """The strings that an alternation of literals matches, or None."""
    parts = pattern.removeprefix("(?:").removesuffix(")").split("|") if pattern.startswith("(?:") and pattern.endswith(")") and pattern.count("(") == 1 else pattern.split("|")
    return parts if all(_LITERAL.match(p) for p in parts) else None


def regex_match(v: Column, pattern: str) -> Column:
    """Cheap forms of a regular expression where there is one."""
    if pattern in (".*", "(?s:.*)"):
        return F.lit(True)
    if pattern == ".+":
        return v != ""
    found = literals(pattern)
    if found is not None:
        return v.isin(*found)
    for prefix, suffix, form in ((".*", ".*", Column.contains), ("", ".*", Column.startswith), (".*", "", Column.endswith)):
        if pattern.startswith(prefix) and pattern.endswith(suffix):
            inner = pattern[len(prefix) : len(pattern) - len(suffix)]
            if inner and _LITERAL.match(inner):
                return form(v, inner)
    return v.rlike(java_regex(pattern))


def matches(matcher: Matcher, metric: Column, labels: Column) -> Column:
    v = F.coalesce(metric, F.lit("")) if matcher.name == "__name__" else value(labels, matcher.name)
    if matcher.op == "=":
        return v == matcher.value
    if matcher.op == "!=":
        return v != matcher.value
    found = regex_match(v, matcher.value)
    return found if matcher.op == "=~" else ~found
