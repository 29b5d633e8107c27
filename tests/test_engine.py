import math

import pytest
from script import instant, load, over, same, same_over

NAN, INF = math.nan, math.inf


@pytest.fixture(scope="module")
def requests(spark):
    return load(
        spark, "5m",
        """
        req{job="api",inst="0",group="prod"} 0+10x10
        req{job="api",inst="1",group="prod"} 0+20x10
        req{job="api",inst="0",group="canary"} 0+30x10
        req{job="app",inst="0",group="prod"} 0+50x10
        lim{job="api"} 1000x10
        lim{job="app"} 500x10
        """,
    )


@pytest.fixture(scope="module")
def mixed(spark):
    return load(
        spark, "10s",
        """
        m{a="x"} 0 1 stale 2
        c{a="x"} 1 3 2 5 1 4
        g{a="x"} 1 2 NaN 4 Inf
        flat{a="x"} 7x5
        up{a="x"} 0+2x5
        one 1
        neg{a="x"} -3 2 -1
        """,
    )


def test_instant_lookback_and_stale(mixed):
    same(instant(mixed, "m", "10s"), {"m{a=x}": 1})
    same(instant(mixed, "m", "20s"), {})
    same(instant(mixed, "m", "30s"), {"m{a=x}": 2})
    same(instant(mixed, "m", 329_999), {"m{a=x}": 2})
    same(instant(mixed, "m", 330_000), {})
    same_over(over(mixed, "m", "0s", "40s", "10s"), {"m{a=x}": {0: 0, 10: 1, 30: 2, 40: 2}})
    same_over(over(mixed, "m", "0s", "30s", "10s", lookback=10_000), {"m{a=x}": {0: 0, 10: 1, 30: 2}})


def test_windows_are_left_open(mixed):
    same(instant(mixed, "count_over_time(c[20s])", "20s"), {"{a=x}": 2})
    same(instant(mixed, "sum_over_time(m[30s])", "30s"), {"{a=x}": 3})
    same(instant(mixed, "last_over_time(c[10s])", "10s"), {"c{a=x}": 3})


def test_offset_and_at(mixed):
    same(instant(mixed, "c offset 10s", "20s"), {"c{a=x}": 3})
    same(instant(mixed, "c offset -10s", "10s"), {"c{a=x}": 2})
    same(instant(mixed, "c @ 30", "0s"), {"c{a=x}": 5})
    same_over(over(mixed, "c @ start()", "10s", "30s", "10s"), {"c{a=x}": {10: 3, 20: 3, 30: 3}})
    same_over(over(mixed, "sum(c @ end() offset 10s)", "10s", "30s", "10s"), {"{}": {10: 2, 20: 2, 30: 2}})


def test_rates(mixed, requests):
    same(instant(mixed, "resets(c[1m])", "50s"), {"{a=x}": 2})
    same(instant(mixed, "changes(c[1m])", "50s"), {"{a=x}": 5})
    same(instant(mixed, "changes(flat[1m])", "50s"), {"{a=x}": 0})
    same(instant(mixed, "idelta(c[30s])", "50s"), {"{a=x}": 3})
    same(instant(mixed, "irate(c[30s])", "40s"), {"{a=x}": 0.1})
    # 0, 2, ..., 10 in (−10 s, 50 s]: the counter starts at zero, so there is no rise before it.
    same(instant(mixed, "increase(up[1m])", "50s"), {"{a=x}": 10})
    same(instant(mixed, "delta(up[1m])", "50s"), {"{a=x}": 12})
    same(instant(requests, 'rate(req{group="canary"}[50m])', "50m"), {"{group=canary,inst=0,job=api}": 0.1})
    # Resets: 1 3 2 5 1 4 rises by 2 + 2 + 3 + 1 + 3 = 11 over 50 s of a minute; zero is 1/11 of that before the start.
    grown = 11 * (50 + min(10, 50 * 1 / 11) + 0) / 50
    same(instant(mixed, "increase(c[1m])", "50s"), {"{a=x}": grown})


def test_over_time(mixed):
    same(instant(mixed, "avg_over_time(c[1m])", "50s"), {"{a=x}": 16 / 6})
    same(instant(mixed, "min_over_time(g[1m])", "50s"), {"{a=x}": 1})
    same(instant(mixed, "max_over_time(g[30s])", "30s"), {"{a=x}": 4})
    same(instant(mixed, "stddev_over_time(c[1m])", "50s"), {"{a=x}": math.sqrt(sum((x - 16 / 6) ** 2 for x in (1, 3, 2, 5, 1, 4)) / 6)})
    same(instant(mixed, "quantile_over_time(0.5, c[1m])", "50s"), {"{a=x}": 2.5})
    same(instant(mixed, "quantile_over_time(2, c[1m])", "50s"), {"{a=x}": INF})
    same(instant(mixed, "quantile_over_time(0, g[1m])", "50s"), {"{a=x}": NAN})
    same(instant(mixed, "mad_over_time(c[1m])", "50s"), {"{a=x}": 1.5})
    same(instant(mixed, "present_over_time(c[1m])", "50s"), {"{a=x}": 1})
    same(instant(mixed, "absent_over_time(zz{b='c'}[1m])", "50s"), {"{b=c}": 1})
    same(instant(mixed, "absent_over_time(c[1m])", "50s"), {})
    same(instant(mixed, "deriv(up[1m])", "50s"), {"{a=x}": 0.2})
    same(instant(mixed, "deriv(flat[1m])", "50s"), {"{a=x}": 0})
    same(instant(mixed, "predict_linear(up[1m], 10)", "50s"), {"{a=x}": 12})
    same(instant(mixed, "double_exponential_smoothing(up[1m], 0.5, 0.5)", "50s"), {"{a=x}": 10})


def test_overlapping_windows_by_buckets(spark):
    store = load(spark, "10s", "w{a='1'} 5 3 _ 8 1 9 2 7 _ _ 4 6 0 2")
    values = {0: 5, 10: 3, 30: 8, 40: 1, 50: 9, 60: 2, 70: 7, 100: 4, 110: 6, 120: 0, 130: 2}
    for name, f in {"sum": sum, "max": max, "min": min, "count": len, "avg": lambda v: sum(v) / len(v)}.items():
        want = {t: f(v) for t in range(0, 140, 10) if (v := [x for s, x in values.items() if t - 60 < s <= t])}
        same_over(over(store, f"{name}_over_time(w[1m])", "0s", "2m10s", "10s"), {"{a=1}": want})
    both = over(store, "rate(w[1m])", "1m", "2m", "10s")["{a=1}"]
    for t in range(60, 130, 10):
        same({"": both[t]}, {"": list(instant(store, "rate(w[1m])", t * 1000).values())[0]})


def test_subqueries(mixed):
    same(instant(mixed, "max_over_time(c[40s:10s])", "50s"), {"{a=x}": 5})
    same(instant(mixed, "sum_over_time(vector(1)[1m:10s])", "60s"), {"{}": 6})
    same(instant(mixed, "count_over_time((c * 2)[30s:15s] offset 10s)", "50s"), {"{a=x}": 2})


def test_aggregations(requests):
    same(instant(requests, "sum by (group) (req)", "50m"), {"{group=prod}": 800, "{group=canary}": 300})
    same(instant(requests, "avg without (inst, group) (req)", "50m"), {"{job=api}": 200, "{job=app}": 500})
    same(instant(requests, "count(req)", "50m"), {"{}": 4})
    same(instant(requests, "min(req) or max(lim)", "50m"), {"{}": 100})
    same(instant(requests, "group by (job) (req)", "50m"), {"{job=api}": 1, "{job=app}": 1})
    same(instant(requests, "stddev(req)", "50m"), {"{}": math.sqrt(sum((x - 275) ** 2 for x in (100, 200, 300, 500)) / 4)})
    same(instant(requests, "stdvar(req)", "50m"), {"{}": sum((x - 275) ** 2 for x in (100, 200, 300, 500)) / 4})
    same(instant(requests, "quantile(0.5, req)", "50m"), {"{}": 250})
    same(instant(requests, "quantile(-1, req)", "50m"), {"{}": -INF})
    same(instant(requests, "topk(1, req)", "50m"), {"req{group=prod,inst=0,job=app}": 500})
    same(instant(requests, "bottomk by (job) (1, req)", "50m"), {"req{group=prod,inst=0,job=api}": 100, "req{group=prod,inst=0,job=app}": 500})
    same(instant(requests, "topk(0, req)", "50m"), {})
    same(instant(requests, "count(limitk(2, req))", "50m"), {"{}": 2})
    same(instant(requests, 'count_values("n", lim)', "50m"), {"{n=1000}": 1, "{n=500}": 1})
    same(instant(requests, "sum by (__name__) (req)", "50m"), {"req{}": 1100})
    both = instant(requests, "limit_ratio(0.5, req)", "50m") | instant(requests, "limit_ratio(-0.5, req)", "50m")
    same(both, instant(requests, "req", "50m"))


def test_nan_in_aggregations(spark):
    store = load(spark, "10s", 'n{a="1"} NaN\nn{a="2"} 5\nn{a="3"} 1')
    same(instant(store, "max(n)", "0s"), {"{}": 5})
    same(instant(store, "min(n)", "0s"), {"{}": 1})
    same(instant(store, "topk(2, n)", "0s"), {"n{a=2}": 5, "n{a=3}": 1})
    same(instant(store, "stddev(n)", "0s"), {"{}": NAN})
    same(instant(store, "n == n", "0s"), {"n{a=2}": 5, "n{a=3}": 1})
    same(instant(store, "n != bool n", "0s"), {"{a=1}": 1, "{a=2}": 0, "{a=3}": 0})


def test_arithmetic(mixed):
    for expr, want in {
        "1 / 0": INF, "-1 / 0": -INF, "0 / 0": NAN, "1 / -0": -INF, "5 % 3": 2, "-5 % 3": -2, "5 % 0": NAN, "2 ^ 3 ^ 2": 512, "-2 ^ 2": -4, "1 > bool 2": 0,
        "NaN == bool NaN": 0, "NaN != bool NaN": 1, "3 atan2 0": math.pi / 2, "pi()": math.pi, "time()": 20, "scalar(c)": 2, "scalar(zz)": NAN, "1 + 2 * 3": 7,
    }.items():
        same(instant(mixed, expr, "20s"), {"{}": want})
    same(instant(mixed, "c * 2 + 1", "20s"), {"{a=x}": 5})
    same(instant(mixed, "10 - c", "20s"), {"{a=x}": 8})
    same(instant(mixed, "c > 1", "20s"), {"c{a=x}": 2})
    same(instant(mixed, "1 < c", "20s"), {"c{a=x}": 2})
    same(instant(mixed, "c > bool 5", "20s"), {"{a=x}": 0})
    same(instant(mixed, "-c", "20s"), {"{a=x}": -2})


def test_matching(requests):
    same(instant(requests, 'sum by (job) (req) / lim', "50m"), {"{job=api}": 0.6, "{job=app}": 1})
    got = instant(requests, "req / on (job) group_left () lim", "50m")
    same(got, {"{group=prod,inst=0,job=api}": 0.1, "{group=prod,inst=1,job=api}": 0.2, "{group=canary,inst=0,job=api}": 0.3, "{group=prod,inst=0,job=app}": 1})
    same(instant(requests, "lim - on (job) group_right () req", "50m"), {k: {"api": 1000, "app": 500}[k[-4:-1]] - v * {"api": 1000, "app": 500}[k[-4:-1]] for k, v in got.items()})
    same(instant(requests, 'req and on (job) lim > 600', "50m"), {k: v for k, v in instant(requests, "req", "50m").items() if "api" in k})
    same(instant(requests, 'req unless on (job) lim > 600', "50m"), {"req{group=prod,inst=0,job=app}": 500})
    same(instant(requests, 'lim{job="api"} or lim', "50m"), {"lim{job=api}": 1000, "lim{job=app}": 500})
    same(instant(requests, "lim > ignoring (inst, group) sum by (job) (req)", "50m"), {"lim{job=api}": 1000})
    for bad in ("req / on (job) lim", "lim / on (job) req", "lim * on () group_left () lim"):
        with pytest.raises(Exception, match="many"):
            instant(requests, bad, "50m")


def test_duplicate_label_sets_fail(spark):
    store = load(spark, "10s", 'a{x="1"} 1\nb{x="1"} 2')
    with pytest.raises(Exception, match="same labelset"):
        instant(store, 'abs({x="1"})', "0s")
    same(instant(store, 'label_replace({x="1"}, "n", "$1", "__name__", "(.*)")', "0s"), {"a{n=a,x=1}": 1, "b{n=b,x=1}": 2})


def test_functions(mixed):
    for expr, want in {
        "abs(neg)": 3, "ceil(c / 2)": 1, "floor(neg / 2)": -2, "sgn(neg)": -1, "sqrt(neg)": NAN, "ln(neg)": NAN, "ln(c * 0)": -INF, "log2(c * 8)": 3, "exp(c - c)": 1,
        "round(c * 1.25)": 1, "round(c * 2.5)": 3, "round(c * 13, 5)": 15, "clamp(c, 3, 5)": 3, "clamp_max(c, 0)": 0, "clamp_min(c, 9)": 9, "deg(c * pi())": 180,
        "rad(c * 180)": math.pi, "acosh(c)": 0, "atanh(c)": INF, "asin(c * 2)": NAN, "timestamp(c)": 0, "vector(3)": 3, "minute(vector(130))": 2,
        "year(vector(0))": 1970, "days_in_month(vector(951782400))": 29, "day_of_week(vector(0))": 4, "hour(vector(7200))": 2, "day_of_year(vector(86400))": 2,
    }.items():
        got = instant(mixed, expr, "0s")
        same(got, {k: want for k in got})
        assert got
    same(instant(mixed, "clamp(c, 5, 3)", "0s"), {})
    same(instant(mixed, "absent(zz{b='c', d=~'e'})", "0s"), {"{b=c}": 1})
    same(instant(mixed, "absent(c)", "0s"), {})
    same(instant(mixed, 'label_replace(c, "b", "${1}y", "a", "(x)")', "0s"), {"c{a=x,b=xy}": 1})
    same(instant(mixed, 'label_replace(c, "b", "$1", "a", "no")', "0s"), {"c{a=x}": 1})
    same(instant(mixed, 'label_replace(c, "a", "", "a", ".*")', "0s"), {"c{}": 1})
    same(instant(mixed, 'label_join(c, "b", "-", "a", "zz", "a")', "0s"), {"c{a=x,b=x--x}": 1})


def test_sorting(spark):
    from tidelake.plans.engine import Engine

    store = load(spark, "10s", 's{i="2"} 3\ns{i="10"} 1\ns{i="1"} NaN')
    engine = Engine(store)
    labels = lambda q: [r["labels"]["i"] for r in engine.instant_query(q, 0).collect()]
    assert labels("sort(s)") == ["10", "2", "1"]
    assert labels("sort_desc(s)") == ["2", "10", "1"]
    assert labels('sort_by_label(s, "i")') == ["1", "2", "10"]
    assert labels('sort_by_label_desc(s, "i")') == ["10", "2", "1"]


def test_classic_histogram(spark):
    store = load(
        spark, "5m",
        """
        h{le="1",p="a"} 0+5x10
        h{le="2",p="a"} 0+7x10
        h{le="+Inf",p="a"} 0+10x10
        h{le="1",p="noinf"} 0+5x10
        h{le="0",p="n"} 0+2x10
        h{le="+Inf",p="n"} 0+4x10
        """,
    )
    q = lambda v: instant(store, f"histogram_quantile({v}, h)", "50m")
    same(q(0.5), {"{p=a}": 1, "{p=noinf}": NAN, "{p=n}": 0})
    same(q(0.6), {"{p=a}": 1.5, "{p=noinf}": NAN, "{p=n}": 0})
    same(q(0.99), {"{p=a}": 2, "{p=noinf}": NAN, "{p=n}": 0})
    same(q(2), {"{p=a}": INF, "{p=noinf}": INF, "{p=n}": INF})


def test_info(spark):
    store = load(
        spark, "5m",
        """
        m{instance="a",job="1",x="y"} 0 1
        m{instance="b",job="1"} 5 6
        target_info{instance="a",job="1",data="d1"} 1 1
        target_info{instance="a",job="1",data="d2"} _ 1
        """,
    )
    got = instant(store, "info(m)", "0s")
    same(got, {"m{data=d1,instance=a,job=1,x=y}": 0, "m{instance=b,job=1}": 5})
    same(instant(store, 'info(m, {data=~".+"})', "0s"), {"m{data=d1,instance=a,job=1,x=y}": 0})


@pytest.mark.parametrize(
    "expr", ["req", "sum by (job) (rate(req[15m]))", "req / on (job) group_left () lim", "max_over_time(req[20m])", "topk(2, req)", "sum(req) > 300", "absent(zz)"]
)
def test_instant_equals_last_step_of_a_range(requests, expr):
    at = instant(requests, expr, "50m")
    steps = over(requests, expr, "30m", "50m", "5m")
    same(at, {k: v[3000] for k, v in steps.items() if 3000 in v})


def test_fixed_parts_are_evaluated_once(requests):
    same_over(over(requests, "sum(req @ 3000) + 0 * sum(req)", "40m", "50m", "5m"), {"{}": {2400: 1100, 2700: 1100, 3000: 1100}})
    same_over(over(requests, "vector(1)", "0s", "10m", "5m"), {"{}": {0: 1, 300: 1, 600: 1}})
