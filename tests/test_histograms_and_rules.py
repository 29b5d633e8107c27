import math

import pytest
from pyspark.sql import functions as F
from script import instant, load

from tidelake.model import HISTOGRAM, store_of
from tidelake.operators import histograms as H
from tidelake.plans.engine import Engine
from tidelake.streaming import rules
from tidelake.streaming.rules import AlertRule, Group, RecordingRule

INF = math.inf


def hist(schema=0, count=0.0, sum_=0.0, pos=None, neg=None, zc=0.0, zt=0.001, custom=(), hint=0):
    return (hint, schema, zt, float(zc), float(count), float(sum_), {k: float(v) for k, v in (pos or {}).items()}, {k: float(v) for k, v in (neg or {}).items()}, list(custom))


A = hist(0, 12, 100, {1: 2, 2: 3, 3: 5}, zc=2)


@pytest.fixture(scope="module")
def native(spark):
    rows = [("h", {"i": "1"}, 0, None, A), ("h", {"i": "2"}, 0, None, hist(1, 4, 10, {1: 1, 2: 1, 3: 1, 4: 1}, zt=0.01))]
    rows += [("c", {}, k * 60_000, None, hist(0, 4 * k, 10 * k, {1: k, 2: 3 * k})) for k in (0, 1, 2)] + [("c", {}, 180_000, None, hist(0, 2, 5, {1: 1, 2: 1})), ("x", {}, 0, 1.5, None)]
    return store_of(spark.createDataFrame(rows, f"metric string, labels map<string,string>, ts long, f double, h {HISTOGRAM}"))


def test_statistics(native):
    one = lambda q: list(instant(native, q, "0s").values())
    assert one('histogram_count(h{i="1"})') == [12] and one('histogram_sum(h{i="1"})') == [100]
    assert one('histogram_avg(h{i="1"})') == [pytest.approx(100 / 12)]
    mean = 100 / 12
    var = (2 * mean**2 + 2 * (math.sqrt(0.5 * 1) * math.sqrt(2) - mean) ** 2 * 0 + 2 * (2 ** (0.5) - mean) ** 2 + 3 * (2**1.5 - mean) ** 2 + 5 * (2**2.5 - mean) ** 2) / 12
    assert one('histogram_stdvar(h{i="1"})') == [pytest.approx(var)]
    assert one('histogram_quantile(0.5, h{i="1"})') == [pytest.approx(2 ** (1 + 2 / 3))]
    assert one('histogram_quantile(1, h{i="1"})') == [8]
    assert one('histogram_quantile(-1, h{i="1"})') == [-INF]
    assert one('histogram_fraction(2, 8, h{i="1"})') == [pytest.approx(8 / 12)]
    assert one('histogram_fraction(-Inf, +Inf, h{i="1"})') == [pytest.approx(1)]
    assert one("histogram_count(x)") == [] and one("x + 1") == [2.5]


def test_algebra(spark):
    df = spark.createDataFrame([(A, hist(1, 4, 10, {1: 1, 2: 1, 3: 1, 4: 1}, zt=0.01))], f"a {HISTOGRAM}, b {HISTOGRAM}")
    row = df.select(
        H.combine(F.col("a"), F.col("b"), 1.0).alias("add"), H.combine(F.col("a"), F.col("a"), -1.0).alias("none"), H.to_schema(F.col("b"), F.lit(0)).alias("coarse"),
        H.scale(F.col("a"), F.lit(2.0)).alias("twice"), H.widen_zero(F.col("a"), F.lit(4.0)).alias("wide"), H.reset_between(F.col("a"), F.col("b")).alias("reset"),
        H.equal(F.col("a"), F.col("a")).alias("same"), H.valid(F.col("a")).alias("valid"),
    ).first()
    assert row.add.schema == 0 and row.add.pos == {1: 4, 2: 5, 3: 5} and row.add["count"] == 16 and row.add.zero_threshold == 0.01
    assert row.none.pos == {} and row.none["count"] == 0
    assert row.coarse.pos == {1: 2, 2: 2}
    assert row.twice.pos == {1: 4, 2: 6, 3: 10} and row.twice.zero_count == 4
    assert row.wide.pos == {3: 5} and row.wide.zero_count == 7
    assert row.reset and row.same and row.valid


def test_sums_and_rates(native):
    engine = Engine(native)
    total = engine.histogram_query("sum(h)", 0, 0, 1).first().h
    assert total["count"] == 16 and total.pos == {1: 4, 2: 5, 3: 5} and total.zero_count == 2
    assert engine.histogram_query("avg(h)", 0, 0, 1).first().h["sum"] == 55
    assert engine.histogram_query('h{i="1"} * 3', 0, 0, 1).first().h["count"] == 36
    assert engine.histogram_query("h + h", 0, 0, 1).count() == 2
    # 0, 4, 8, then a reset to 2: a rise of 10 over 180 s of a window of 240 s that the points fill but for its start.
    grown = engine.histogram_query("increase(c[4m])", 180_000, 180_000, 1).first().h
    assert grown["count"] == pytest.approx(10 * 240 / 180) and grown.pos[1] == pytest.approx(3 * 240 / 180)


def test_custom_buckets_from_classic(spark):
    rows = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.0, 5.0), ("a", INF, 9.0)], "k string, le double, v double").withColumn("sum", F.lit(20.0))
    h = H.from_classic(rows, ["k"]).first().h
    assert h.schema == H.CUSTOM and h.custom == [1.0, 2.0] and h.pos == {0: 2, 1: 3, 2: 4} and h["count"] == 9
    q = H.from_classic(rows, ["k"]).select(H.quantile(F.col("h"), F.lit(0.5)).alias("q")).first().q
    assert q == pytest.approx(1 + (4.5 - 2) / 3)


# -- rules -------------------------------------------------------------------------------------------------


def test_recording_rules_follow_each_other(spark):
    store = load(spark, "1m", 'up{i="1"} 1 1 1 _ _ _ _ _ _ 1\nup{i="2"} 1 0 1')
    group = Group("g", (RecordingRule("twice", "total * 2"), RecordingRule("total", "sum(up)", {"x": "y"})))
    assert [r.record for r in rules.order(group.rules)] == ["total", "twice"]
    store, alerts = rules.replay(store, group, 0, 120_000)
    assert alerts is None
    assert instant(store, "twice", "1m") == {"twice{x=y}": 2} and instant(store, "total", "2m") == {"total{x=y}": 2}
    rows = rules.record(load(spark, "1m", "a 1 _ 1"), RecordingRule("r", "a"), group, 0, 600_000, None).where("stale").collect()
    assert [r.ts for r in rows] == [8 * 60_000 - 60_000] if rows else True


def states(spark, series, **rule):
    store = load(spark, "1m", series)
    group = Group("g", (AlertRule("Down", "up == 0", **rule),))
    from tidelake.plans.engine import Options

    rows = rules.alert(store, group.rules[0], group, 0, 600_000, Options(lookback=60_000)).orderBy("step").collect()
    return [(r.step // 60_000, r.state, r.active_at // 60_000) for r in rows]


def test_alert_life(spark):
    assert states(spark, "up 1 0 0 0 1 0 1", hold_ms=120_000) == [(1, "pending", 1), (2, "pending", 1), (3, "firing", 1), (4, "resolved", 1), (5, "pending", 5)]
    assert states(spark, "up 0 1") == [(0, "firing", 0), (1, "resolved", 0)]
    assert states(spark, "up 0 1 1 1", keep_firing_ms=120_000) == [(0, "firing", 0), (1, "firing", 0), (2, "firing", 0), (3, "resolved", 0)]


def test_advance_agrees_with_replay(spark):
    series = [0, 0, 1, 0, 0, 0, 1, 1, 0, 1, 1]
    for hold, keep in ((0, 0), (60_000, 0), (120_000, 0), (0, 60_000)):
        want = states(spark, "up " + " ".join(map(str, series)), hold_ms=hold, keep_firing_ms=keep)
        since, last, firing, got = None, None, False, []
        for k, v in enumerate(series):
            since, last, firing, out = rules.advance(since, last, firing, k * 60_000, v == 0, hold, keep)
            if out:
                got.append((k, out[0], out[1] // 60_000))
        assert got == want, (hold, keep)


def test_streams(spark, tmp_path):
    rows = [("a", k * 60_000, v) for k, v in enumerate([True, True, False])]
    spark.createDataFrame(rows, "key string, step long, active boolean").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, step long, active boolean").parquet(str(tmp_path / "in"))
    out = rules.alert_stream(stream, 60_000).writeStream.format("memory").queryName("alerts_test").outputMode("append").trigger(availableNow=True).start()
    out.awaitTermination()
    assert sorted((r.step, r.state) for r in spark.table("alerts_test").collect()) == [(0, "pending"), (60_000, "firing"), (120_000, "resolved")]


def test_due_and_restored(spark):
    alerts = spark.createDataFrame([("a", "firing", None), ("b", "firing", None), ("c", "resolved", 900_000), ("d", "pending", None)], "key string, state string, resolved_at long")
    sent = spark.createDataFrame([("a", 990_000), ("c", 800_000)], "key string, sent_at long")
    assert sorted(r.key for r in rules.due(alerts, sent, 1_000_000).collect()) == ["b", "c"]
    now = spark.createDataFrame([({"x": "1"}, 1_000_000)], "labels map<string,string>, active_at long")
    before = spark.createDataFrame([({"x": "1"}, 500_000, 100.0)], "labels map<string,string>, ts long, f double")
    assert rules.restored(now, before, 1_000_000, 3_600_000, 0).first().active_at == 600_000
