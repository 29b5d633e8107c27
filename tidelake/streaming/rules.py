"""Recording and alerting rules: replayed over a range, or kept up by a stream.

Replay evaluates each rule's expression as one range query.  An alert's life (inactive,
pending, firing, resolved) is a fold over the ordered evaluation times of one label set;
runs of activity are found with windows, so a rule over millions of label sets is
still one plan.  The streaming form keeps the same state for each label set.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelake.model import Store
from tidelake.operators import labels as L
from tidelake.plans.ast import QueryError, Selector, children
from tidelake.plans.engine import Engine, Options
from tidelake.plans.parser import parse

RESOLVED_MS = 15 * 60_000


@dataclass(frozen=True)
class RecordingRule:
    record: str
    expr: str
    labels: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class AlertRule:
    alert: str
    expr: str
    hold_ms: int = 0
    keep_firing_ms: int = 0
    labels: dict[str, str] = field(default_factory=dict)
    annotations: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Group:
    name: str
    rules: tuple
    interval_ms: int = 60_000
    limit: int | None = None
    offset_ms: int = 0


def _with_labels(labels: Column, extra: dict[str, str]) -> Column:
    for name in sorted(extra):
        labels = L.put(labels, name, F.lit(extra[name]))
    return labels


def depends_on(rule) -> set[str]:
    """Names of the metrics that a rule's expression selects; '' if it selects without a name."""
    found: set[str] = set()

    def walk(e) -> None:
        if isinstance(e, Selector):
            found.add(e.name or "")
        for c in children(e):
            walk(c)

    walk(parse(rule.expr))
    return found


def order(rules: tuple) -> list:
    """Rules so that each comes after the rules whose results it reads; a rule that reads its
    own or a later one's result sees what the round before left, so order in a cycle is as given."""
    names = {r.record: k for k, r in enumerate(rules) if isinstance(r, RecordingRule)}
    done: list[int] = []
    visiting: set[int] = set()

    def visit(k: int) -> None:
        if k in done or k in visiting:
            return
        visiting.add(k)
        for name in sorted(depends_on(rules[k])):
            if name in names:
                visit(names[name])
        visiting.discard(k)
        done.append(k)

    for k in range(len(rules)):
        visit(k)
    return [rules[k] for k in done]


def _limited(out: DataFrame, group: Group) -> DataFrame:
    if group.limit is None:
        return out
    n = F.count(F.lit(1)).over(Window.partitionBy("step"))
    message = F.lit(f"group {group.name}: exceeded limit of {group.limit} series")
    return out.withColumn("v", F.when(n > group.limit, F.raise_error(message).cast("double")).otherwise(F.col("v")))


def replay(store: Store, group: Group, start: int, end: int, options: Options | None = None) -> tuple[Store, DataFrame]:
    """(the store with what the recording rules wrote, alerts of all rules and rounds).

    A series that a rule gave in one round but not in the next gets an end marker."""
    alerts = None
    for rule in order(group.rules):
        if isinstance(rule, RecordingRule):
            store = add_samples(store, record(store, rule, group, start, end, options))
        else:
            one = alert(store, rule, group, start, end, options)
            alerts = one if alerts is None else alerts.unionByName(one)
    if alerts is not None:
        store = add_samples(store, alert_series(alerts))
    return store, alerts


def record(store: Store, rule: RecordingRule, group: Group, start: int, end: int, options: Options | None = None) -> DataFrame:
    """(metric, labels, ts, f, stale) of a recording rule at each round."""
    step = group.interval_ms
    out = Engine(store, options).range_query(rule.expr, start - group.offset_ms, end - group.offset_ms, step)
    out = _limited(out.withColumn("step", F.col("step") + group.offset_ms), group)
    out = out.withColumn("labels", _with_labels(F.col("labels"), rule.labels)).withColumn("key", L.key(F.col("labels")))
    rows = out.select(F.lit(rule.record).alias("metric"), "labels", "key", F.col("step").alias("ts"), F.col("v").alias("f"), F.lit(False).alias("stale"))
    after = F.lead("ts").over(Window.partitionBy("key").orderBy("ts"))
    last = start + (end - start) // step * step
    ends = rows.withColumn("after", after).where((F.coalesce("after", F.lit(last + step)) > F.col("ts") + step) & (F.col("ts") < last))
    ends = ends.select("metric", "labels", "key", (F.col("ts") + step).alias("ts"), F.lit(None).cast("double").alias("f"), F.lit(True).alias("stale"))
    return rows.unionByName(ends).drop("key")


def alert(store: Store, rule: AlertRule, group: Group, start: int, end: int, options: Options | None = None) -> DataFrame:
    """(alert, labels, step, state, active_at, v) for each round in which the alert is not
    inactive, and the round in which it is resolved.

    Active rounds in a row are a run.  A run pends until it has lasted hold_ms, then fires;
    a firing alert whose expression has gone keeps firing for keep_firing_ms from its last
    active round, and a run that comes back meanwhile goes on firing."""
    step = group.interval_ms
    out = Engine(store, options).range_query(rule.expr, start - group.offset_ms, end - group.offset_ms, step)
    out = _limited(out.withColumn("step", F.col("step") + group.offset_ms), group)
    labels = _with_labels(F.col("labels"), {**rule.labels, "alertname": rule.alert})
    out = out.withColumn("labels", labels).withColumn("key", L.key(F.col("labels"))).select("key", "step", "v")
    own = Window.partitionBy("key").orderBy("step")
    # Runs of active rounds.
    out = out.withColumn("fresh", F.when(F.col("step") - F.lag("step").over(own) <= step, 0).otherwise(1))
    out = out.withColumn("run", F.sum("fresh").over(own))
    runs = out.groupBy("key", "run").agg(F.min("step").alias("first"), F.max("step").alias("last"))
    # A run that comes while an earlier one still keeps firing belongs to the same life.
    fires = F.col("last") - F.col("first") >= rule.hold_ms
    over = F.when(fires, F.col("last") + rule.keep_firing_ms).otherwise(F.col("last"))
    by = Window.partitionBy("key").orderBy("first")
    runs = runs.withColumn("over", over).withColumn("joined", F.when((F.lag("over").over(by) >= F.col("first") - step) & (F.lag("over").over(by) > F.lag("last").over(by)), 0).otherwise(1))
    runs = runs.withColumn("life", F.sum("joined").over(by))
    lives = runs.groupBy("key", "life").agg(F.min_by("first", "first").alias("active_at"), F.max("last").alias("last"), F.min("first").alias("start"), F.max(F.col("last") - F.col("first")).alias("longest"))
    fired = F.col("longest") >= rule.hold_ms
    lives = lives.withColumn("until", F.when(fired, F.col("last") + rule.keep_firing_ms).otherwise(F.col("last")))
    final = start + (end - start) // step * step
    # The first round at which the expression has gone for longer than it may.
    resolved = F.col("last") + (F.floor((F.col("until") - F.col("last")) / step) + 1) * step
    lives = lives.withColumn("resolved", F.when(fired & (resolved <= final), resolved.cast("long")))
    rounds = F.sequence(F.col("start"), F.least(F.coalesce(F.col("resolved"), F.lit(final).cast("long")), (F.floor((F.col("until") - start) / step) * step + start).cast("long") + F.when(F.col("resolved").isNotNull(), step).otherwise(0)), F.lit(step).cast("long"))
    each = lives.withColumn("step", F.explode(rounds))
    state = F.when(F.col("step") == F.col("resolved"), "resolved").when(F.col("step") - F.col("active_at") >= rule.hold_ms, "firing").otherwise("pending")
    each = each.select("key", "step", "active_at", state.alias("state"))
    known = F.last("v", ignorenulls=True).over(own)
    each = each.join(out.select("key", "step", "v"), ["key", "step"], "left").withColumn("v", known)
    return each.select(F.lit(rule.alert).alias("alert"), L.from_key(F.col("key")).alias("labels"), "step", "state", "active_at", "v")


def alert_series(alerts: DataFrame) -> DataFrame:
    """The series ALERTS (1, with the state as a label) and ALERTS_FOR_STATE (active since, s)."""
    live = alerts.where("state <> 'resolved'")
    one = live.select(F.lit("ALERTS").alias("metric"), L.put(F.col("labels"), "alertstate", F.col("state")).alias("labels"), F.col("step").alias("ts"), F.lit(1.0).alias("f"))
    since = live.select(F.lit("ALERTS_FOR_STATE").alias("metric"), "labels", F.col("step").alias("ts"), (F.col("active_at") / 1000.0).alias("f"))
    return one.unionByName(since).withColumn("stale", F.lit(False))


def restored(alerts: DataFrame, for_state: DataFrame, now: int, hold_ms: int, grace_ms: int = 600_000) -> DataFrame:
    """Alerts (labels, active_at) after a restart, with the time that they were active before
    (labels, ts, f in seconds) counted: downtime does not, and at least `grace_ms` of the
    hold must be left unless it was over already."""
    key = lambda df: df.withColumn("key", L.key(F.col("labels")))
    last = key(for_state).groupBy("key").agg(F.max_by(F.struct("ts", "f"), "ts").alias("x"))
    rows = key(alerts).join(last, "key", "left")
    spent = F.col("x.ts") - F.col("x.f") * 1000
    left = hold_ms - spent
    back = F.when(left <= 0, (F.col("x.f") * 1000).cast("long")).when(left < grace_ms, F.lit(now) - hold_ms + grace_ms).otherwise((F.lit(now) - spent).cast("long"))
    return rows.withColumn("active_at", F.coalesce(back.cast("long"), "active_at")).drop("key", "x")


def due(alerts: DataFrame, sent: DataFrame, now: int, resend_ms: int = 60_000) -> DataFrame:
    """Alerts (key, state, resolved_at) to be sent: new ones, ones resolved since they were last
    sent (key, sent_at), and firing ones whose last message is older than `resend_ms`."""
    rows = alerts.join(sent, "key", "left")
    again = F.col("sent_at").isNull() | (F.col("sent_at") + resend_ms <= now)
    changed = (F.col("state") == "resolved") & (F.col("sent_at") < F.col("resolved_at"))
    fresh = F.when(F.col("state") == "resolved", F.col("sent_at").isNotNull() & (changed | again) & (F.col("resolved_at") >= now - RESOLVED_MS)).otherwise((F.col("state") == "firing") & again)
    return rows.where(fresh)


def add_samples(store: Store, rows: DataFrame) -> Store:
    """The store with rows (metric, labels, ts, f, stale) more."""
    from tidelake.model import store_of

    new = store_of(rows)
    stale = store.samples if store.has_stale else store.samples.withColumn("stale", F.lit(False))
    return replace(store, samples=stale.unionByName(new.samples, allowMissingColumns=True), series=store.series.unionByName(new.series))


# -- streams --------------------------------------------------------------------------------------------


def window_aggregate(stream: DataFrame, by: list[str], length_ms: int, step_ms: int, late_ms: int, aggregates: list[Column]) -> DataFrame:
    """A range function at each step over a stream (by..., at timestamp, f): the windows
    (step - length, step] of the query language, which is left-open, so times are moved by
    the smallest unit.  Samples later than `late_ms` behind the newest are dropped."""
    moved = stream.withColumn("at_", F.expr("at - interval 1 millisecond")).withWatermark("at_", f"{late_ms} milliseconds")
    span = F.window("at_", f"{length_ms} milliseconds", f"{step_ms} milliseconds")
    out = moved.groupBy(*by, span.alias("w")).agg(*aggregates)
    return out.select(*by, F.unix_millis("w.end").alias("step"), *[c for c in out.columns if c not in (*by, "w")])


def alert_stream(active: DataFrame, hold_ms: int, keep_firing_ms: int = 0) -> DataFrame:
    """(key, step, state, active_at) from a stream of rounds (key, step, active boolean), one
    row for each label set and round, with one small state for each label set."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        since, last, firing = state.get if state.exists else (None, None, False)
        out: list[tuple] = []
        rows = sorted((r for f in frames for r in f[["step", "active"]].itertuples(index=False)), key=lambda r: r.step)
        for step, is_active in rows:
            since, last, firing, name = advance(since, last, firing, int(step), bool(is_active), hold_ms, keep_firing_ms)
            if name:
                out.append((key[0], int(step), name[0], name[1]))
        if since is None:
            state.remove()
        else:
            state.update((since, last, firing))
        yield pd.DataFrame(out, columns=["key", "step", "state", "active_at"]).astype({"step": "int64", "active_at": "int64"})

    return active.groupBy("key").applyInPandasWithState(
        run, "key string, step long, state string, active_at long", "since long, last long, firing boolean", "append", "NoTimeout"
    )


def advance(since, last, firing, step, is_active, hold_ms, keep_firing_ms):
    """One round of an alert's life: (since, last active, firing, (state, active_at) or None)."""
    if is_active:
        since = step if since is None else since
        last = step
        firing = firing or step - since >= hold_ms
        return since, last, firing, ("firing" if firing else "pending", since)
    if since is None:
        return None, None, False, None
    if firing and step - last <= keep_firing_ms and keep_firing_ms:
        return since, last, True, ("firing", since)
    return None, None, False, ("resolved", since) if firing else None


def admission_stream(samples: DataFrame, out_of_order_ms: int = 0) -> DataFrame:
    """Samples (series_id, ts, f) with `verdict`, decided by the newest sample of each series."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        newest, value = state.get if state.exists else (None, None)
        for frame in frames:
            verdicts = []
            for ts, f in frame[["ts", "f"]].itertuples(index=False):
                if newest is None or ts > newest:
                    newest, value = int(ts), float(f)
                    verdicts.append("accepted")
                elif ts == newest:
                    verdicts.append("duplicate" if f == value or (f != f and value != value) else "conflict")
                elif not out_of_order_ms:
                    verdicts.append("out_of_order")
                else:
                    verdicts.append("out_of_order_accepted" if newest - ts <= out_of_order_ms else "too_old")
            yield frame[["ts", "f"]].assign(series_id=key[0], verdict=verdicts)[["series_id", "ts", "f", "verdict"]]
        state.update((newest, value))

    return samples.groupBy("series_id").applyInPandasWithState(
        run, "series_id long, ts long, f double, verdict string", "newest long, value double", "append", "NoTimeout"
    )


def record_batches(stream: DataFrame, write, group: Group, make_store, options: Options | None = None):
    """A streaming query that evaluates a group's recording rules after each batch: `make_store`
    gives the store with the batch, `write` takes each rule's rows."""

    def each(batch: DataFrame, _: int) -> None:
        store = make_store(batch)
        newest = batch.agg(F.max("ts")).first()[0]
        if newest is None:
            return
        at = newest // group.interval_ms * group.interval_ms
        for rule in order(group.rules):
            if not isinstance(rule, RecordingRule):
                raise QueryError("alert rules need alert_stream")
            rows = record(store, rule, group, at, at, options)
            write(rows)
            store = add_samples(store, rows)

    return stream.writeStream.foreachBatch(each)
