"""Relabeling: rules that rewrite or drop label sets, one column expression each."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelake.operators import labels as L
from tidelake.plans.ast import QueryError
from tidelake.plans.engine import java_replacement
from tidelake.plans.parser import check_regex

ACTIONS = "replace keep drop keepequal dropequal hashmod labelmap labeldrop labelkeep lowercase uppercase".split()


@dataclass(frozen=True)
class Rule:
    action: str = "replace"
    source_labels: tuple[str, ...] = ()
    separator: str = ";"
    regex: str = "(.*)"
    target_label: str = ""
    replacement: str = "$1"
    modulus: int = 0

    def __post_init__(self):
        if self.action not in ACTIONS:
            raise QueryError(f"unknown relabel action {self.action!r}")
        if self.action in ("replace", "hashmod", "lowercase", "uppercase", "keepequal", "dropequal") and not self.target_label:
            raise QueryError(f"relabel action {self.action} needs a target label")
        if self.action == "hashmod" and self.modulus <= 0:
            raise QueryError("relabel action hashmod needs a modulus")
        check_regex(self.regex)


def hash_mod(value: Column, modulus: int) -> Column:
    """The last 8 bytes of the md5 sum, as an unsigned number, modulo `modulus`."""
    high = F.conv(F.substring(F.md5(value), 17, 8), 16, 10).cast("decimal(38,0)")
    low = F.conv(F.substring(F.md5(value), 25, 8), 16, 10).cast("decimal(38,0)")
    return F.pmod(high * F.lit(1 << 32).cast("decimal(38,0)") + low, F.lit(modulus).cast("decimal(38,0)")).cast("long")


def apply(df: DataFrame, rules: list[Rule], labels: str = "labels") -> DataFrame:
    """The rows whose label sets the rules keep, with the labels that they give.

    The metric name is the label __name__.  Empty values are no labels."""
    for rule in rules:
        df = _apply(df, rule, labels)
    return df.withColumn(labels, L.normal(F.col(labels)))


def _apply(df: DataFrame, rule: Rule, name: str) -> DataFrame:
    labels = F.col(name)
    value = F.concat_ws(rule.separator, *[L.value(labels, s) for s in rule.source_labels]) if rule.source_labels else F.lit("")
    regex = L.java_regex(rule.regex)
    replacement = java_replacement(rule.replacement)
    action = rule.action
    if action == "keep":
        return df.where(value.rlike(regex))
    if action == "drop":
        return df.where(~value.rlike(regex))
    if action == "keepequal":
        return df.where(value == L.value(labels, rule.target_label))
    if action == "dropequal":
        return df.where(value != L.value(labels, rule.target_label))
    if action == "replace":
        # The target may be made from the match too.
        new = F.regexp_replace(value, regex, replacement)
        if "$" in rule.target_label:
            target = F.regexp_replace(value, regex, java_replacement(rule.target_label))
            ok = value.rlike(regex) & target.rlike(r"\A[a-zA-Z_][a-zA-Z0-9_]*\z")
            rest = F.filter(F.map_entries(labels), lambda e: e["key"] != target)
            put = F.map_from_entries(F.concat(rest, F.array(F.struct(target.alias("key"), new.alias("value")))))
            return df.withColumn(name, F.when(ok, L.normal(put)).otherwise(labels))
        return df.withColumn(name, F.when(value.rlike(regex), L.put(labels, rule.target_label, new)).otherwise(labels))
    if action == "hashmod":
        return df.withColumn(name, L.put(labels, rule.target_label, hash_mod(value, rule.modulus).cast("string")))
    if action in ("lowercase", "uppercase"):
        return df.withColumn(name, L.put(labels, rule.target_label, F.lower(value) if action == "lowercase" else F.upper(value)))
    if action == "labelmap":
        entries = F.map_entries(labels)
        hit = F.filter(entries, lambda e: e["key"].rlike(regex))
        new = F.transform(hit, lambda e: F.struct(F.regexp_replace(e["key"], regex, replacement).alias("key"), e["value"].alias("value")))
        # Of labels mapped to one name the last in order stands.
        once = F.filter(F.transform(new, lambda e, i: F.struct(e.alias("e"), i.alias("i"))), lambda x: ~F.exists(F.slice(new, x["i"] + 2, F.size(new)), lambda o: o["key"] == x["e"]["key"]))
        new = F.transform(once, lambda x: x["e"])
        rest = F.filter(entries, lambda e: ~F.exists(new, lambda o: o["key"] == e["key"]))
        return df.withColumn(name, F.map_from_entries(F.concat(rest, new)))
    keep = action == "labelkeep"
    return df.withColumn(name, F.map_filter(labels, lambda k, _: k.rlike(regex) if keep else ~k.rlike(regex)))
