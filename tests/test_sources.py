import pytest
from pyspark.sql import functions as F
from script import instant, same

from tidelake.plans.annotations import annotate
from tidelake.plans.ast import QueryError
from tidelake.sources import blocks, notation
from tidelake.streaming.rules import AlertRule, Group, RecordingRule


def test_points():
    assert notation.points("1 2+3x2 _ _x2 5x1 stale -1.5-0.5x1") == [1, 2, 5, 8, None, None, None, 5, 5, "stale", -1.5, -2]
    with pytest.raises(QueryError):
        notation.points("1 two")


def test_blocks_round_trip(spark, tmp_path):
    root = str(tmp_path / "b")
    body = "# TYPE a counter\n" + "".join(f'a_total{{x="{k % 3}"}} {k} {k * 1800}\n' for k in range(12)) + "# EOF\n"
    payloads = spark.createDataFrame([(body, 0), ("broken", 0)], "body string, ts long")
    assert blocks.backfill(spark, payloads, root).count() == 1
    found = blocks.list_blocks(spark, root)
    assert [(b.start, b.end) for b in found] == [(0, 7_200_000), (7_200_000, 14_400_000), (14_400_000, 21_600_000)]
    store = blocks.read_blocks(spark, root, 7_200_000, 9_000_000)
    assert sorted(r.ts for r in store.samples.collect()) == [7_200_000, 9_000_000]
    plan = store.samples._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(block_start" in plan
    same(instant(blocks.read_blocks(spark, root), 'a_total{x="2"}', 19_800_000), {"a_total{x=2}": 11})
    blocks.snapshot(spark, root, str(tmp_path / "copy"))
    assert blocks.read_blocks(spark, str(tmp_path / "copy")).samples.count() == 12
    assert store.series.where(F.size("labels") == 1).count() == 3


def test_annotations():
    kinds = lambda q: [a.level for a in annotate(q)]
    assert kinds("sum(rate(x_total[5m]))") == []
    assert kinds("rate(memory[5m])") == ["info"]
    assert kinds("quantile(2, x)") == ["warning"] and kinds("quantile_over_time(-1, x[5m])") == ["warning"]
    assert kinds("histogram_quantile(0.9, sum by (job) (rate(x_bucket[5m])))") == ["warning"]
    assert kinds("limit_ratio(1.5, x)") == ["warning"] and kinds("sort(x)") == ["info"]


def test_rule_unit_tests(spark):
    group = Group("g", (RecordingRule("job:up:sum", "sum by (job) (up)"), AlertRule("Down", "job:up:sum == 0", hold_ms=120_000, labels={"severity": "page"})))
    case = {
        "interval": "1m", "input_series": {'up{job="a",i="1"}': "1 0 0 0 0", 'up{job="b",i="1"}': "1x4"},
        "queries": [{"expr": "job:up:sum", "eval_time": "1m", "samples": {'job:up:sum{job="a"}': 0, 'job:up:sum{job="b"}': 1}}],
        "alerts": [{"alertname": "Down", "eval_time": "2m", "alerts": []}, {"alertname": "Down", "eval_time": "3m", "alerts": [{"job": "a", "severity": "page"}]}],
    }
    assert notation.run_tests(spark, {"rules": group, "tests": [case]}) == []
    wrong = case | {"queries": [{"expr": "up", "eval_time": "0s", "samples": {}}]}
    assert len(notation.run_tests(spark, {"rules": group, "tests": [wrong]})) == 1
