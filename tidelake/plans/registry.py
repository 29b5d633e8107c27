"""The engine's queries over the driver's tables, and the same in DuckDB's SQL.

A query is an expression over a store with a time grid; its labels become columns and
its values are rounded to six places on both sides.

Every query that reads a table by a grid is registered twice: on EVENTS or ORDERS, steps
apart that see some of the rows, and as whole_..., where no step is further from the next
than its lookback or range and the grid spans the table, so that every row is in a window.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.plans.engine import Engine, Options
from tidelake.sources import tables

DAY, HOUR = 86_400_000, 3_600_000
JAN_2024 = 1_704_067_200_000
EVENTS = (JAN_2024 + 2 * DAY, JAN_2024 + 28 * DAY, 2 * DAY)
ORDERS = (852_076_800_000, 852_076_800_000 + 700 * DAY, 70 * DAY)  # from 1997-01-01 on
JAN_1995 = 788_918_400_000
WHOLE_EVENTS = (JAN_2024, JAN_2024 + 30 * DAY, 12 * HOUR)
WHOLE_ORDERS = (JAN_1995, JAN_1995 + 2430 * DAY, 30 * DAY)
WHOLE_LINES = (JAN_1995 + 100 * DAY, JAN_1995 + 2500 * DAY, 100 * DAY)

Grid = tuple[int, int, int]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

# -- the tables' series in SQL ----------------------------------------------------------
EVENT_VALUE = "SELECT event_type, CAST(user_id AS VARCHAR) AS user_id, epoch_us(ts) // 1000 AS t, max(value) AS f FROM events GROUP BY ALL"
EVENTS_TOTAL = (
    "SELECT event_type, user_id, t, CAST(row_number() OVER (PARTITION BY event_type, user_id, t // 604800000 ORDER BY t) AS DOUBLE) AS f "
    f"FROM ({EVENT_VALUE})"
)
_ORDER = "SELECT o_orderstatus AS status, o_orderpriority AS priority, epoch_ms(o_orderdate) AS t, {} AS f FROM orders GROUP BY ALL"
ORDER_PRICE, ORDER_COUNT = _ORDER.format("sum(o_totalprice)"), _ORDER.format("CAST(count(*) AS DOUBLE)")
LINE_QUANTITY = "SELECT l_returnflag AS returnflag, l_linestatus AS linestatus, epoch_ms(l_shipdate) AS t, sum(l_quantity) AS f FROM lineitem GROUP BY ALL"


def steps(grid: tuple[int, int, int]) -> str:
    return f"SELECT CAST(unnest(generate_series({grid[0]}, {grid[1]}, {grid[2]})) AS BIGINT) AS step"


def windows(source: str, labels: list[str], grid: tuple[int, int, int], length: int, value: str, having: str = "true", offset: int = 0) -> str:
    """An aggregate over each series' samples in (step - offset - length, step - offset]."""
    by = ", ".join(["step", *labels])
    return (
        f"SELECT {by}, {value} AS v FROM ({source}) s JOIN ({steps(grid)}) g "
        f"ON t > step - {offset + length} AND t <= step - {offset} GROUP BY {by} HAVING {having}"
    )


def instant(source: str, labels: list[str], grid: tuple[int, int, int], lookback: int = 12 * HOUR, offset: int = 0) -> str:
    return windows(source, labels, grid, lookback, "arg_max(f, t)", offset=offset)


def rate(source: str, labels: list[str], grid: tuple[int, int, int], length: int, name: str) -> str:
    """The extrapolated increase, its rate or the extrapolated difference."""
    by = ", ".join(labels)
    steps_by = ", ".join(["step", *labels])
    counter = name != "delta"
    terms = f"SELECT *, CASE WHEN f < lag(f) OVER (PARTITION BY {by} ORDER BY t) THEN lag(f) OVER (PARTITION BY {by} ORDER BY t) ELSE 0 END AS r FROM ({source})"
    change = "arg_max(f, t) - arg_min(f, t)" + (" + sum(r) - arg_min(r, t)" if counter else "")
    a = (
        f"SELECT {steps_by}, {change} AS c, arg_min(f, t) AS ff, (max(t) - min(t)) / 1000.0 AS span, count(*) AS n, "
        f"(min(t) - (step - {length})) / 1000.0 AS a0, (step - max(t)) / 1000.0 AS a1 FROM ({terms}) s JOIN ({steps(grid)}) g "
        f"ON t > step - {length} AND t <= step GROUP BY {steps_by} HAVING count(*) > 1"
    )
    b = f"SELECT *, span / (n - 1) AS each FROM ({a})"
    near = f"SELECT *, CASE WHEN a0 >= each * 1.1 THEN each / 2 ELSE a0 END AS b0, CASE WHEN a1 >= each * 1.1 THEN each / 2 ELSE a1 END AS b1 FROM ({b})"
    zero = "CASE WHEN c > 0 AND ff >= 0 AND span * ff / c < b0 THEN span * ff / c ELSE b0 END" if counter else "b0"
    per = f" / {length / 1000}" if name == "rate" else ""
    return f"SELECT {steps_by}, c * (span + {zero} + b1) / span{per} AS v FROM ({near})"


def aggregate(source: str, labels: list[str], value: str) -> str:
    by = ", ".join(["step", *labels])
    return f"SELECT {by}, {value} AS v FROM ({source}) GROUP BY {by}"


def add(
    name: str, store: Callable, expr: str, grid: tuple[int, int, int], labels: list[str], sql: str | None,
    lookback: int = 12 * HOUR, digits: int = 6,
) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = Engine(store(spark, sf_dir), Options(lookback=lookback)).range_query(expr, *grid)
        return out.select("step", *[F.element_at("labels", F.lit(n)).alias(n) for n in labels], F.round("v", digits).alias("v"))

    QUERIES[name] = query
    if sql is not None:
        ORACLE_SQL[name] = f"SELECT {', '.join(['step', *labels])}, round(v, {digits}) AS v FROM ({sql})"


_EL = ["event_type", "user_id"]
_OL = ["status", "priority"]


def _register(prefix: str, events: Grid, orders: Grid, lines: Grid, offsets: Grid, hours: Grid, resolution: int) -> None:
    """The queries that read a table by a grid: `lines` for line items, `offsets` for offsets of
    a day, `hours` for a lookback of an hour; `resolution` is the subquery's, in hours."""

    def _event(name: str, expr: str, labels: list[str], sql: str | None, **more) -> None:
        add(prefix + name, tables.events, expr, more.pop("grid", events), labels, sql, **more)

    def _order(name: str, expr: str, labels: list[str], sql: str | None, **more) -> None:
        add(prefix + name, tables.orders, expr, orders, labels, sql, lookback=more.pop("lookback", 40 * DAY), **more)

    _value = instant(EVENT_VALUE, _EL, events)
    _price = instant(ORDER_PRICE, _OL, orders, 40 * DAY)
    _count = instant(ORDER_COUNT, _OL, orders, 40 * DAY)

    # Selectors and time modifiers.
    _event("instant_selector", "event_value", _EL, _value)
    _event("instant_offset", "event_value offset 1d", _EL, instant(EVENT_VALUE, _EL, offsets, offset=DAY), grid=offsets)
    _event("instant_negative_offset", "event_value offset -1d", _EL, instant(EVENT_VALUE, _EL, offsets, offset=-DAY), grid=offsets)
    _event("matcher_equal", 'event_value{event_type="click"}', _EL, f"SELECT * FROM ({_value}) WHERE event_type = 'click'")
    _event("matcher_not_equal", 'event_value{event_type!="click"}', _EL, f"SELECT * FROM ({_value}) WHERE event_type <> 'click'")
    _event("matcher_regex", 'event_value{event_type=~"c.*|view", user_id!~"1.+"}', _EL, f"SELECT * FROM ({_value}) WHERE regexp_full_match(event_type, 'c.*|view') AND NOT regexp_full_match(user_id, '1.+')")
    _event("overlapping_lookback", "event_value", _EL, instant(EVENT_VALUE, _EL, events, 5 * DAY), lookback=5 * DAY)
    _sub = instant(EVENT_VALUE, _EL, (events[0] - 3 * DAY, events[1], resolution * HOUR))
    _event("subquery_max", f"max_over_time(event_value[2d:{'1d' if resolution == 24 else f'{resolution}h'}])", _EL, windows(f"SELECT event_type, user_id, step AS t, v AS f FROM ({_sub})", _EL, events, 2 * DAY, "max(f)"))

    # Functions of range vectors.
    for _fn, _sql in {
        "sum": "sum(f)", "avg": "avg(f)", "min": "min(f)", "max": "max(f)", "count": "CAST(count(*) AS DOUBLE)", "last": "arg_max(f, t)",
        "present": "1.0::DOUBLE", "stddev": "stddev_pop(f)", "stdvar": "var_pop(f)", "mad": "mad(f)",
    }.items():
        _event(f"{_fn}_over_time", f"{_fn}_over_time(event_value[8d])", _EL, windows(EVENT_VALUE, _EL, events, 8 * DAY, _sql))
    _event("sum_over_time_tumbling", "sum_over_time(event_value[2d])", _EL, windows(EVENT_VALUE, _EL, events, 2 * DAY, "sum(f)"))
    _event("quantile_over_time", "quantile_over_time(0.9, event_value[8d])", _EL, windows(EVENT_VALUE, _EL, events, 8 * DAY, "quantile_cont(f, 0.9)"))
    for _fn in ("rate", "increase", "delta"):
        _event(_fn, f"{_fn}(events_total[6d])", _EL, rate(EVENTS_TOTAL, _EL, events, 6 * DAY, _fn), digits=9 if _fn == "rate" else 6)
    _lagged = (
        "SELECT *, lag(f) OVER (PARTITION BY event_type, user_id ORDER BY t) AS pf, lag(t) OVER (PARTITION BY event_type, user_id ORDER BY t) AS pt "
        "FROM ({})"
    )
    _pairs = f"SELECT * FROM ({_lagged.format(EVENTS_TOTAL)}) s JOIN ({steps(events)}) g ON t > step - {6 * DAY} AND t <= step"
    _last = f"SELECT step, event_type, user_id, arg_max(struct_pack(f, t, pf, pt), t) AS x FROM ({_pairs}) GROUP BY ALL"
    _fall = "CASE WHEN x.f < x.pf THEN x.f ELSE x.f - x.pf END"
    _event("irate", "irate(events_total[6d])", _EL, f"SELECT step, event_type, user_id, {_fall} / ((x.t - x.pt) / 1000.0) AS v FROM ({_last}) WHERE x.pt > step - {6 * DAY}", digits=9)
    _event("idelta", "idelta(events_total[6d])", _EL, f"SELECT step, event_type, user_id, x.f - x.pf AS v FROM ({_last}) WHERE x.pt > step - {6 * DAY}")
    _inside = f"pt > step - {6 * DAY}"
    _event("resets", "resets(events_total[6d])", _EL, f"SELECT step, event_type, user_id, CAST(count(*) FILTER ({_inside} AND f < pf) AS DOUBLE) AS v FROM ({_pairs}) GROUP BY ALL")
    _event("changes", "changes(events_total[6d])", _EL, f"SELECT step, event_type, user_id, CAST(count(*) FILTER ({_inside} AND f <> pf) AS DOUBLE) AS v FROM ({_pairs}) GROUP BY ALL")
    _slope = "CASE WHEN min(f) = max(f) THEN 0 ELSE regr_slope(f, (t - step) / 1000.0) END"
    _event("deriv", "deriv(event_value[8d])", _EL, windows(EVENT_VALUE, _EL, events, 8 * DAY, _slope, "count(*) > 1"), digits=9)
    _line = f"CASE WHEN min(f) = max(f) THEN min(f) ELSE regr_intercept(f, (t - step) / 1000.0) + 3600 * regr_slope(f, (t - step) / 1000.0) END"
    _event("predict_linear", "predict_linear(event_value[8d], 3600)", _EL, windows(EVENT_VALUE, _EL, events, 8 * DAY, _line, "count(*) > 1"), digits=4)
    _level = "0.3 * e[1] + 0.7 * (a[1] + a[2])"
    _smooth = f"list_reduce([[x[1], x[2] - x[1]]] || list_transform(x[2:], lambda f: [f]), lambda a, e: [{_level}, 0.6 * ({_level} - a[1]) + 0.4 * a[2]])[1]"
    _listed = windows(ORDER_PRICE, _OL, orders, 30 * DAY, "list(f ORDER BY t)", "count(*) > 1")
    _order("double_exponential_smoothing", "double_exponential_smoothing(order_price[30d], 0.3, 0.6)", _OL, f"SELECT step, status, priority, {_smooth} AS v FROM (SELECT * RENAME (v AS x) FROM ({_listed}))", digits=3)

    # Aggregations.
    _rates = rate(EVENTS_TOTAL, _EL, events, 6 * DAY, "rate")
    add(prefix + "rate_sum_by_type", tables.events, "sum by (event_type) (rate(events_total[6d]))", events, ["event_type"], aggregate(_rates, ["event_type"], "sum(v)"), digits=9)
    for _fn, _sql in {
        "sum": "sum(v)", "avg": "avg(v)", "count": "CAST(count(*) AS DOUBLE)", "min": "min(v)", "max": "max(v)", "group": "1.0::DOUBLE",
        "stddev": "stddev_pop(v)", "stdvar": "var_pop(v)",
    }.items():
        _event(f"agg_{_fn}_by", f"{_fn} by (event_type) (event_value)", ["event_type"], aggregate(_value, ["event_type"], _sql))
    _event("agg_quantile", "quantile by (event_type) (0.75, event_value)", ["event_type"], aggregate(_value, ["event_type"], "quantile_cont(v, 0.75)"))
    _event("agg_without", "sum without (user_id) (event_value)", ["event_type"], aggregate(_value, ["event_type"], "sum(v)"))
    _event("agg_all", "sum(event_value)", [], aggregate(_value, [], "sum(v)"))
    _event("topk", "topk by (event_type) (2, event_value)", _EL, f"SELECT step, event_type, user_id, v FROM ({_value}) QUALIFY row_number() OVER (PARTITION BY step, event_type ORDER BY v DESC, '{{\"event_type\":\"' || event_type || '\",\"user_id\":\"' || user_id || '\"}}') <= 2")
    _event("bottomk", "bottomk(3, event_value)", _EL, f"SELECT step, event_type, user_id, v FROM ({_value}) QUALIFY row_number() OVER (PARTITION BY step ORDER BY v, '{{\"event_type\":\"' || event_type || '\",\"user_id\":\"' || user_id || '\"}}') <= 3")
    _event("limitk", "limitk by (event_type) (2, event_value)", _EL, f"SELECT step, event_type, user_id, v FROM ({_value}) QUALIFY row_number() OVER (PARTITION BY step, event_type ORDER BY '{{\"event_type\":\"' || event_type || '\",\"user_id\":\"' || user_id || '\"}}') <= 2")
    _place = "('0x' || substr(md5('event_value{\"event_type\":\"' || event_type || '\",\"user_id\":\"' || user_id || '\"}'), 1, 13))::BIGINT / 4503599627370496.0"
    _event("limit_ratio", "limit_ratio(0.4, event_value)", _EL, f"SELECT * FROM ({_value}) WHERE {_place} < 0.4")
    _event("limit_ratio_rest", "limit_ratio(-0.6, event_value)", _EL, f"SELECT * FROM ({_value}) WHERE {_place} >= 0.4")
    _order("count_values", 'count_values by (status) ("n", order_count)', ["status", "n"], f"SELECT step, status, CAST(CAST(v AS BIGINT) AS VARCHAR) AS n, CAST(count(*) AS DOUBLE) AS v FROM ({_count}) GROUP BY ALL")

    # Arithmetic, comparisons, vector matching, set operators.
    _both = f"SELECT p.step, p.status, p.priority, {{}} AS v FROM ({_price}) p JOIN ({_count}) c USING (step, status, priority)"
    for _name, _op, _sql in (
        ("add", "+", "p.v + c.v"), ("subtract", "-", "p.v - c.v"), ("multiply", "*", "p.v * c.v"), ("divide", "/", "p.v / c.v"), ("modulo", "%", "fmod(p.v, c.v + 0.0)"), ("atan2", "atan2", "atan2(p.v, c.v)"),
    ):
        _order(f"vector_{_name}", f"order_price {_op} order_count", _OL, _both.format(_sql), digits=4)
    _order("vector_power", "order_count ^ 2", _OL, f"SELECT step, status, priority, v * v AS v FROM ({_count})")
    _order("scalar_arithmetic", "(1 - order_price / 1000) % 7", _OL, f"SELECT step, status, priority, (1 - v / 1000) - 7 * trunc((1 - v / 1000) / 7) AS v FROM ({_price})")
    for _name, _op in (("equal", "=="), ("not_equal", "!="), ("greater", ">"), ("less", "<"), ("at_least", ">="), ("at_most", "<=")):
        _order(f"compare_{_name}", f"order_count {_op} 2", _OL, f"SELECT * FROM ({_count}) WHERE v {_op} 2")
    _order("compare_bool", "order_price > bool 200000", _OL, f"SELECT step, status, priority, CAST(CAST(v > 200000 AS INT) AS DOUBLE) AS v FROM ({_price})")
    _order("compare_vectors", "order_price > order_count * 150000", _OL, f"SELECT p.step, p.status, p.priority, p.v FROM ({_price}) p JOIN ({_count}) c USING (step, status, priority) WHERE p.v > c.v * 150000")
    _sums = aggregate(_price, ["status"], "sum(v)")
    _order("group_left_share", "order_price / on (status) group_left () sum by (status) (order_price)", _OL, f"SELECT p.step, p.status, p.priority, p.v / s.v AS v FROM ({_price}) p JOIN ({_sums}) s USING (step, status)")
    _order("group_right_share", "sum by (status) (order_price) - on (status) group_right () order_price", _OL, f"SELECT p.step, p.status, p.priority, s.v - p.v AS v FROM ({_price}) p JOIN ({_sums}) s USING (step, status)")
    _order("ignoring_match", "sum by (status) (order_price) / ignoring (priority) sum without (priority) (order_count)", ["status"], f"SELECT s.step, s.status, s.v / c.v AS v FROM ({_sums}) s JOIN ({aggregate(_count, ['status'], 'sum(v)')}) c USING (step, status)")
    _order("set_and", "order_price and order_count > 1", _OL, f"SELECT p.* FROM ({_price}) p SEMI JOIN (SELECT * FROM ({_count}) WHERE v > 1) c USING (step, status, priority)")
    _order("set_unless", "order_price unless on (status, priority) order_count > 1", _OL, f"SELECT p.* FROM ({_price}) p ANTI JOIN (SELECT * FROM ({_count}) WHERE v > 1) c USING (step, status, priority)")
    _order("set_or", 'order_price{status="F"} or order_count', _OL, f"SELECT * FROM ({_price}) WHERE status = 'F' UNION ALL SELECT c.* FROM ({_count}) c ANTI JOIN (SELECT * FROM ({_price}) WHERE status = 'F') p USING (step, status, priority)")
    _order("unary_minus", "-order_price", _OL, f"SELECT step, status, priority, -v AS v FROM ({_price})")

    # Functions of one value.
    _ratio = f"SELECT step, status, priority, v / 3 - 1 AS x FROM ({_count})"
    for _fn, _sql in {
        "abs": "abs(x)", "ceil": "ceil(x)", "floor": "floor(x)", "exp": "exp(x)", "sgn": "CAST(sign(x) AS DOUBLE)", "sin": "sin(x)", "cos": "cos(x)", "tan": "tan(x)",
        "atan": "atan(x)", "sinh": "sinh(x)", "cosh": "cosh(x)", "tanh": "tanh(x)", "asinh": "asinh(x)", "deg": "degrees(x)", "rad": "radians(x)",
    }.items():
        _order(f"fn_{_fn}", f"{_fn}(order_count / 3 - 1)", _OL, f"SELECT step, status, priority, {_sql} AS v FROM ({_ratio})")
    for _fn, _sql in {"sqrt": "sqrt(v)", "ln": "ln(v)", "log2": "log2(v)", "log10": "log10(v)", "acosh": "acosh(v)"}.items():
        _order(f"fn_{_fn}", f"{_fn}(order_count)", _OL, f"SELECT step, status, priority, {_sql} AS v FROM ({_count})")
    for _fn in ("asin", "acos", "atanh"):
        _order(f"fn_{_fn}", f"{_fn}(order_count / 100)", _OL, f"SELECT step, status, priority, {_fn}(v / 100) AS v FROM ({_count})")
    _order("fn_round", "round(order_price, 1000)", _OL, f"SELECT step, status, priority, floor(v * 0.001 + 0.5) / 0.001 AS v FROM ({_price})", digits=3)
    _order("fn_clamp", "clamp(order_price, 150000, 250000)", _OL, f"SELECT step, status, priority, greatest(150000, least(250000, v)) AS v FROM ({_price})")
    _order("fn_clamp_min", "clamp_min(order_price, 150000)", _OL, f"SELECT step, status, priority, greatest(150000, v) AS v FROM ({_price})")
    _order("fn_clamp_max", "clamp_max(order_price, 150000)", _OL, f"SELECT step, status, priority, least(150000, v) AS v FROM ({_price})")
    _order("fn_pi", "order_count * pi()", _OL, f"SELECT step, status, priority, v * pi() AS v FROM ({_count})")
    _order("fn_time", "order_count - order_count + time()", _OL, f"SELECT step, status, priority, step / 1000.0 AS v FROM ({_count})")
    _last_time = windows(ORDER_COUNT, _OL, orders, 40 * DAY, "max(t)")
    _order("fn_timestamp", "timestamp(order_count)", _OL, f"SELECT step, status, priority, v / 1000.0 AS v FROM ({_last_time})")

    # Labels, types, sorting, histograms.
    _event("label_replace", 'sum by (kind) (label_replace(event_value, "kind", "$1-$2", "event_type", "(.)(.*)k"))', ["kind"], f"SELECT step, CASE WHEN event_type = 'click' THEN 'c-lic' END AS kind, sum(v) AS v FROM ({_value}) GROUP BY 1, 2")
    _event("label_join", 'sum by (pair) (label_join(event_value, "pair", "/", "event_type", "user_id"))', ["pair"], f"SELECT step, event_type || '/' || user_id AS pair, v FROM ({_value})")
    _event("scalar_of_sum", 'event_value / scalar(sum(event_value))', _EL, f"SELECT x.step, event_type, user_id, x.v / s.v AS v FROM ({_value}) x JOIN (SELECT step, sum(v) AS v FROM ({_value}) GROUP BY step) s USING (step)")
    _rare = f"SELECT step, v FROM ({instant(EVENT_VALUE, _EL, hours, HOUR)}) WHERE event_type = 'signup' AND user_id = '7'"
    _event("absent", 'absent(event_value{event_type="signup", user_id="7"})', _EL, f"SELECT step, 'signup' AS event_type, '7' AS user_id, 1.0 AS v FROM ({steps(hours)}) ANTI JOIN (SELECT step FROM ({_rare})) USING (step)", lookback=HOUR, grid=hours)
    _event("absent_over_time", 'absent_over_time(event_value{event_type="signup", user_id="7"}[2d])', _EL, f"SELECT g.step, 'signup' AS event_type, '7' AS user_id, 1.0 AS v FROM ({steps(events)}) g WHERE NOT EXISTS (SELECT 1 FROM ({EVENT_VALUE}) WHERE event_type = 'signup' AND user_id = '7' AND t > g.step - {2 * DAY} AND t <= g.step)")
    _buckets = f"SELECT l_returnflag AS returnflag, step, le, CAST(count(*) FILTER (l_quantity <= le) AS DOUBLE) AS c FROM lineitem JOIN ({steps(lines)}) g ON epoch_ms(l_shipdate) <= step, (SELECT unnest([5.0, 10.0, 20.0, 40.0, 'inf'::DOUBLE]) AS le) GROUP BY ALL"
    _ranked = f"SELECT *, max(c) OVER (PARTITION BY returnflag, step) * 0.7 AS rank, lag(le, 1, 0.0) OVER w AS le0, lag(c, 1, 0.0) OVER w AS c0 FROM ({_buckets}) WINDOW w AS (PARTITION BY returnflag, step ORDER BY le)"
    _interpolated = f"SELECT step, returnflag, CASE WHEN le = 'inf'::DOUBLE THEN 40.0 ELSE le0 + (le - le0) * (rank - c0) / (c - c0) END AS v FROM ({_ranked}) WHERE c >= rank QUALIFY row_number() OVER (PARTITION BY returnflag, step ORDER BY le) = 1"
    add(prefix + "histogram_quantile", tables.lineitems, "histogram_quantile(0.7, line_bucket)", lines, ["returnflag"], _interpolated, lookback=100 * DAY)


_register("", EVENTS, ORDERS, ORDERS, EVENTS, EVENTS, 24)
_register(
    "whole_", WHOLE_EVENTS, WHOLE_ORDERS, WHOLE_LINES, (WHOLE_EVENTS[0] - DAY, WHOLE_EVENTS[1] + DAY, 12 * HOUR), (*WHOLE_EVENTS[:2], HOUR), 12
)

# What one instant, the time alone or the dimensions give.
_at = instant(EVENT_VALUE, _EL, (EVENTS[1], EVENTS[1], 1))
add("at_modifier", tables.events, "event_value @ end()", EVENTS, _EL, f"SELECT g.step, event_type, user_id, v FROM ({_at}) a, ({steps(EVENTS)}) g")
for _fn, _sql in {
    "year": "year(d)", "month": "month(d)", "day_of_month": "day(d)", "day_of_week": "dayofweek(d)", "day_of_year": "dayofyear(d)",
    "days_in_month": "day(last_day(d))", "hour": "hour(d)", "minute": "minute(d)",
}.items():
    add(f"fn_{_fn}", tables.events, f"{_fn}(vector(time() + 4000))", EVENTS, [], f"SELECT step, CAST({_sql} AS DOUBLE) AS v FROM (SELECT step, make_timestamp((step + 4000000) * 1000) AS d FROM ({steps(EVENTS)}))")
add("vector_of_scalar", tables.events, "vector(2) + 1", EVENTS, [], f"SELECT step, 3.0 AS v FROM ({steps(EVENTS)})")
_suppliers = "SELECT CAST(s_nationkey AS VARCHAR) AS nation, CAST(s_suppkey AS VARCHAR) AS supplier, s_acctbal AS v FROM supplier"
_named = f"SELECT 0::BIGINT AS step, s.nation, s.supplier, n_name AS name, s.v FROM ({_suppliers}) s JOIN nation ON CAST(n_nationkey AS VARCHAR) = s.nation"
add("group_left_names", tables.dimensions, "supplier_balance * on (nation) group_left (name) nation_info", (0, 0, 1), ["nation", "supplier", "name"], _named)
