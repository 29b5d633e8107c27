"""Queries of sorting, native histograms, blocks, scrapes and further operators over the
driver's tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelake.model import Store, store_of
from tidelake.operators import codec, histograms, storage
from tidelake.operators import labels as L
from tidelake.plans.api import Session
from tidelake.plans.engine import Options
from tidelake.plans.registry import DAY, EVENT_VALUE, HOUR, ORACLE_SQL, ORDER_PRICE, QUERIES, WHOLE_EVENTS, WHOLE_LINES, WHOLE_ORDERS, add, instant, steps
from tidelake.plans.registry_ops import _LINE, _NUMBER, _Q, BOUND, _events, _label, _payloads, query
from tidelake.session import Scratch, read_table
from tidelake.sources import blocks, exposition, ingest, tables

_EL, _OL = ["event_type", "user_id"], ["status", "priority"]


def _named(df: DataFrame, names: list[str]) -> list:
    return [L.value(F.col("labels"), n).alias(n) for n in names]


# -- order of results ---------------------------------------------------------------------------


def _places(df: DataFrame) -> DataFrame:
    """The rows of an ordered result with their place; an instant's result is a row a series."""
    rows = df.withColumn("_at", F.monotonically_increasing_id())
    return rows.withColumn("place", F.row_number().over(Window.orderBy("_at")).cast("long"))


_TIME = WHOLE_ORDERS[0] + 600 * DAY
_PRICES = instant(ORDER_PRICE, _OL, (_TIME, _TIME, 1), 40 * DAY)


def _sorted(name: str, expr: str, order: str) -> None:
    @query(f"SELECT row_number() OVER (ORDER BY {order}) AS place, status, priority, round(v, 4) AS v FROM ({_PRICES})")
    def run(spark, sf_dir):
        out = _places(Session(tables.orders(spark, sf_dir), Options(lookback=40 * DAY)).instant(expr, _TIME))
        return out.select("place", *_named(out, _OL), F.round("v", 4).alias("v"))

    for registry in (QUERIES, ORACLE_SQL):
        registry[name] = registry.pop("run")


_sorted("sort", "sort(order_price)", "v")
_sorted("sort_desc", "sort_desc(order_price)", "v DESC")
_sorted("sort_by_label", 'sort_by_label(order_price, "priority", "status")', "priority, status")
_sorted("sort_by_label_desc", 'sort_by_label_desc(order_price, "priority", "status")', "priority DESC, status DESC")


@query(f"SELECT row_number() OVER (ORDER BY priority, status, step) AS place, step, status, priority, round(v, 4) AS v FROM ({instant(ORDER_PRICE, ['priority', 'status'], WHOLE_ORDERS, 40 * DAY)})")
def matrix_order(spark, sf_dir):
    """Range results stand by label set, then time."""
    out = _places(Session(tables.orders(spark, sf_dir), Options(lookback=40 * DAY)).range("sum by (status, priority) (order_price)", *WHOLE_ORDERS))
    return out.select("place", "step", *_named(out, _OL), F.round("v", 4).alias("v"))


# -- native histograms ------------------------------------------------------------------------------

_POW = "SELECT l_returnflag AS returnflag, epoch_ms(l_shipdate) AS t, CAST(ceil(log2(l_extendedprice)) AS INT) AS k, CAST(count(*) AS DOUBLE) AS c, sum(l_extendedprice) AS s FROM lineitem WHERE l_extendedprice > 0 GROUP BY ALL"
_LAST = f"SELECT returnflag, step, max(t) AS t FROM ({_POW}) JOIN ({steps(WHOLE_LINES)}) g ON t > step - {100 * DAY} AND t <= step GROUP BY ALL"
_B = f"SELECT step, returnflag, k, c, s FROM ({_LAST}) JOIN ({_POW}) USING (returnflag, t)"
_BY = "GROUP BY step, returnflag"
_MEAN = f"SELECT *, sum(s) OVER w / sum(c) OVER w AS mean FROM ({_B}) WINDOW w AS (PARTITION BY step, returnflag)"
_VAR = "sum(c * power(power(2, k - 0.5) - mean, 2)) / sum(c)"
_RANK = f"SELECT *, 0.7 * sum(c) OVER (PARTITION BY step, returnflag) AS rank, sum(c) OVER (PARTITION BY step, returnflag ORDER BY k) AS upto FROM ({_B})"
_BELOW = "sum(CASE WHEN log2({0}) >= k THEN c WHEN log2({0}) <= k - 1 THEN 0 ELSE c * (log2({0}) - (k - 1)) END)"

for _name, _expr, _sql, _digits in (
    ("histogram_count", "histogram_count(line_native)", f"SELECT step, returnflag, sum(c) AS v FROM ({_B}) {_BY}", 6),
    ("histogram_sum", "histogram_sum(line_native)", f"SELECT step, returnflag, sum(s) AS v FROM ({_B}) {_BY}", 3),
    ("histogram_avg", "histogram_avg(line_native)", f"SELECT step, returnflag, sum(s) / sum(c) AS v FROM ({_B}) {_BY}", 2),
    ("histogram_stdvar", "histogram_stdvar(line_native)", f"SELECT step, returnflag, {_VAR} AS v FROM ({_MEAN}) {_BY}", 0),
    ("histogram_stddev", "histogram_stddev(line_native)", f"SELECT step, returnflag, sqrt({_VAR}) AS v FROM ({_MEAN}) {_BY}", 3),
    ("histogram_quantile_native", "histogram_quantile(0.7, line_native)", f"SELECT step, returnflag, power(2, k - 1 + (rank - (upto - c)) / c) AS v FROM ({_RANK}) WHERE upto >= rank QUALIFY row_number() OVER (PARTITION BY step, returnflag ORDER BY k) = 1", 4),
    ("histogram_fraction", "histogram_fraction(20000, 50000, line_native)", f"SELECT step, returnflag, ({_BELOW.format(50000)} - {_BELOW.format(20000)}) / sum(c) AS v FROM ({_B}) {_BY}", 6),
    ("histogram_arithmetic", "histogram_sum(line_native + line_native * 2)", f"SELECT step, returnflag, 3 * sum(s) AS v FROM ({_B}) {_BY}", 3),
    ("histogram_aggregation", "histogram_count(sum by (returnflag) (line_native))", f"SELECT step, returnflag, sum(c) AS v FROM ({_B}) {_BY}", 6),
):
    add(_name, tables.native_lines, _expr, WHOLE_LINES, ["returnflag"], _sql, lookback=100 * DAY, digits=_digits)


def _spread(df: DataFrame, h) -> DataFrame:
    rows = df.select("ts", "series_id", F.explode(histograms.buckets(h)).alias("b"))
    return rows.select("series_id", F.col("ts").alias("t"), "b.lo", "b.hi", "b.c")


@query(f"SELECT returnflag, t, power(2.0, k - 1) AS lo, power(2.0, k) AS hi, c FROM ({_POW})")
def histogram_bounds(spark, sf_dir):
    store = tables.native_lines(spark, sf_dir)
    return _label(_spread(store.samples, F.col("h")), store, ["returnflag"]).select("returnflag", "t", "lo", "hi", "c")


@query(f"SELECT returnflag, t, power(4.0, ceil(k / 2.0) - 1) AS lo, power(4.0, ceil(k / 2.0)) AS hi, sum(c) AS c FROM ({_POW}) GROUP BY ALL")
def histogram_coarser_schema(spark, sf_dir):
    store = tables.native_lines(spark, sf_dir)
    coarser = histograms.to_schema(F.col("h"), F.lit(-1))
    return _label(_spread(store.samples, coarser), store, ["returnflag"]).select("returnflag", "t", "lo", "hi", "c")


# -- info ----------------------------------------------------------------------------------------------


@query("SELECT CAST(s_suppkey AS VARCHAR) AS instance, CAST(s_nationkey AS VARCHAR) AS job, n_name AS name, round(s_acctbal, 6) AS v FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def info(spark, sf_dir):
    """Each supplier's balance with the name of its nation, which an info series tells."""
    supplier, nation = read_table(spark, sf_dir, "supplier"), read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    both = supplier.join(nation, F.col("n_nationkey") == F.col("s_nationkey"))
    job, instance = F.col("s_nationkey").cast("string"), F.col("s_suppkey").cast("string")
    own = F.create_map(F.lit("job"), job, F.lit("instance"), instance)
    told = F.map_concat(own, F.create_map(F.lit("name"), F.col("n_name")))
    rows = [both.select(F.lit(m).alias("metric"), x.alias("labels"), F.lit(0).cast("long").alias("ts"), f.alias("f")) for m, x, f in (("balance", own, F.col("s_acctbal")), ("target_info", told, F.lit(1.0)))]
    out = Session(store_of(rows[0].unionByName(rows[1]))).instant("info(balance)", 0)
    return out.select(*_named(out, ["instance", "job", "name"]), F.round("v", 6).alias("v"))


# -- codec ---------------------------------------------------------------------------------------------


def _codec(code: str) -> None:
    @query(f"SELECT event_type, user_id, t AS ts, round({_Q} * {2 * BOUND}, 6) AS f FROM ({EVENT_VALUE})")
    def run(spark, sf_dir):
        store = _events(spark, sf_dir)
        back = codec.dequantize(codec.decode_chunks(codec.encode_chunks(codec.quantize(store.samples, BOUND), 200, code)))
        return _label(back.select("series_id", "ts", F.round("f", 6).alias("f")), store, _EL)

    for registry in (QUERIES, ORACLE_SQL):
        registry[f"codec_{code}"] = registry.pop("run")


for _code in ("simplebits", "varint", "pfor"):
    _codec(_code)


# -- blocks --------------------------------------------------------------------------------------------

_ALL = f"SELECT event_type, user_id, t AS ts, f FROM ({EVENT_VALUE})"
_FROM, _TO = WHOLE_EVENTS[0] + 5 * DAY + HOUR, WHOLE_EVENTS[0] + 9 * DAY


def _samples(store: Store) -> DataFrame:
    return _label(store.samples.select("series_id", "ts", "f"), store, _EL).select(*_EL, "ts", "f")


@query(_ALL)
def block_round_trip(spark, sf_dir):
    root = Scratch(spark, "blocks").path("blocks")
    blocks.write_blocks(_events(spark, sf_dir), root, DAY)
    return _samples(blocks.read_blocks(spark, root, size=DAY))


@query(f"{_ALL} WHERE t BETWEEN {_FROM} AND {_TO}")
def block_scan(spark, sf_dir):
    """The blocks that a time range touches."""
    root = Scratch(spark, "blocks").path("blocks")
    blocks.write_blocks(_events(spark, sf_dir), root, DAY)
    return _samples(blocks.read_blocks(spark, root, _FROM, _TO, DAY))


@query(_ALL)
def block_snapshot(spark, sf_dir):
    scratch = Scratch(spark, "blocks")
    blocks.write_blocks(_events(spark, sf_dir), scratch.path("blocks"), DAY)
    blocks.snapshot(spark, scratch.path("blocks"), scratch.path("copy"))
    return _samples(blocks.read_blocks(spark, scratch.path("copy"), size=DAY))


@query(f"SELECT t // {DAY} * {DAY} AS block, min(t) AS mint, max(t) AS maxt, count(*) AS n FROM ({EVENT_VALUE}) GROUP BY 1")
def block_metadata(spark, sf_dir):
    root = Scratch(spark, "blocks").path("blocks")
    blocks.write_blocks(_events(spark, sf_dir), root, DAY)
    return spark.read.parquet(f"{root}/meta").select(F.col("block_start").alias("block"), "mint", "maxt", F.col("n_samples").alias("n"))


@query(_ALL)
def backfill(spark, sf_dir):
    root = Scratch(spark, "blocks").path("blocks")
    lines = exposition.dump(_events(spark, sf_dir), 0, 1 << 60, seconds=True)
    errors = blocks.backfill(spark, _payloads(lines, "# EOF\n"), root, size=DAY)
    if not errors.isEmpty():
        raise ValueError(errors.first()["error"])
    return _samples(blocks.read_blocks(spark, root, size=DAY))


@query(f"SELECT event_type, user_id, count(*) AS n, 1::BIGINT AS shards FROM ({EVENT_VALUE}) GROUP BY ALL")
def sharded_select(spark, sf_dir):
    """Every series is in one shard, whole."""
    store = _events(spark, sf_dir)
    parts = [storage.shard(store.samples, k, 4).groupBy("series_id").agg(F.count(F.lit(1)).alias("n")) for k in range(4)]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    every = every.groupBy("series_id").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("shards"))
    return _label(every, store, _EL).select(*_EL, "n", "shards")


@query(f"WITH s AS ({_ALL}), c AS (SELECT *, ts // {7 * DAY} * {7 * DAY} AS created FROM s) SELECT * FROM s UNION ALL (SELECT DISTINCT event_type, user_id, created, 0.0 FROM c ANTI JOIN (SELECT event_type, user_id, ts AS created FROM s) x USING (event_type, user_id, created) WHERE created < ts)")
def created_zero(spark, sf_dir):
    store = _events(spark, sf_dir)
    rows = store.samples.select("series_id", "ts", "f").withColumn("created", (F.floor(F.col("ts") / (7 * DAY)) * 7 * DAY).cast("long"))
    return _label(storage.with_created(rows), store, _EL).select(*_EL, "ts", "f")


@query(f"SELECT DISTINCT event_type, user_id, {_TO} AS ts FROM ({EVENT_VALUE}) s WHERE t < {_FROM} AND NOT EXISTS (SELECT 1 FROM ({EVENT_VALUE}) n WHERE n.event_type = s.event_type AND n.user_id = s.user_id AND n.t BETWEEN {_FROM} AND {_TO})")
def stale_on_disappear(spark, sf_dir):
    """End markers for the series that a first round has and the next lacks."""
    store = _events(spark, sf_dir)
    before, now = store.samples.where(F.col("ts") < _FROM), store.samples.where(F.col("ts").between(_FROM, _TO))
    return _label(storage.stale_markers(before, now, _TO).where("stale"), store, _EL).select(*_EL, "ts")


# -- scrapes, exposition, datasets ------------------------------------------------------------------------


@query(f"SELECT event_type, user_id, t AS ts, round(f, 6) AS f FROM ({EVENT_VALUE})")
def open_metrics_round_trip(spark, sf_dir):
    rows = exposition.read(_payloads(exposition.dump(_events(spark, sf_dir), 0, 1 << 60, seconds=True), "# EOF\n"), strict=True)
    return rows.where("error is null").select(*_named(rows, _EL), "ts", F.round("f", 6).alias("f"))


@query(f"SELECT {_LINE}{_NUMBER} || ' {_TO}' AS value FROM (SELECT event_type, user_id, v AS f FROM ({instant(EVENT_VALUE, _EL, (_TO, _TO, 1), 5 * DAY)}) WHERE event_type IN ('click', 'view'))")
def federation(spark, sf_dir):
    engine = Session(_events(spark, sf_dir), Options(lookback=5 * DAY)).engine
    return exposition.federate(engine, ['event_value{event_type="click"}', 'event_value{event_type=~"click|view"}'], _TO)


@query("SELECT DISTINCT event_type AS exported_job, 'app' AS job, CAST(user_id AS VARCHAR) AS user_id, 'h:1' AS instance FROM events")
def target_labels(spark, sf_dir):
    """A label that a target sets too is kept as exported_..."""
    rows = _events(spark, sf_dir).series.withColumn("labels", F.map_from_entries(F.transform(F.map_entries("labels"), lambda e: F.struct(F.when(e["key"] == "event_type", "job").otherwise(e["key"]).alias("key"), e["value"].alias("value")))))
    out = ingest.attach_target(rows, {"job": "app", "instance": "h:1"})
    return out.select(*_named(out, ["exported_job", "job", "user_id", "instance"]))


@query("WITH s AS (SELECT DISTINCT event_type AS scrape, CAST(user_id AS VARCHAR) AS u FROM events), n AS (SELECT scrape, count(*) AS n, max(length(u)) AS w, max(length(scrape)) AS e FROM s GROUP BY 1) SELECT scrape, n, CASE WHEN n > 80 THEN 'too many samples' WHEN greatest(w, e) > 5 THEN 'label value too long' END AS rejected FROM n")
def scrape_limits(spark, sf_dir):
    rows = _events(spark, sf_dir).series.withColumn("scrape", L.value(F.col("labels"), "event_type"))
    out = ingest.within_limits(rows, sample_limit=80, label_limit=3, value_length=5)
    return out.groupBy("scrape", "rejected").agg(F.count(F.lit(1)).alias("n")).select("scrape", "n", "rejected")


@query("SELECT o_orderstatus AS status, x.c AS \"column\", (row_number() OVER (PARTITION BY o_orderstatus, x.c ORDER BY o_orderkey) - 1) * 1000 AS ts, x.f AS f FROM orders, (SELECT unnest([{c: 'o_totalprice', f: o_totalprice}, {c: 'o_custkey', f: CAST(o_custkey AS DOUBLE)}]) AS x)")
def dataset_unpivot(spark, sf_dir):
    out = ingest.unpivot(read_table(spark, sf_dir, "orders"), "orders", {"status": "o_orderstatus"}, ["o_totalprice", "o_custkey"], "o_orderkey")
    return out.select(*_named(out, ["status", "column"]), "ts", "f")


@query(f"SELECT event_type, user_id, t AS ts, f AS value, CAST(t % 1000 AS VARCHAR) AS trace FROM ({EVENT_VALUE}) WHERE event_type = 'click' AND t BETWEEN {_FROM} AND {_TO}")
def exemplars(spark, sf_dir):
    store = _events(spark, sf_dir)
    found = store.samples.select("series_id", "ts", F.col("f").alias("value"), F.create_map(F.lit("trace"), (F.col("ts") % 1000).cast("string")).alias("ex_labels"))
    out = Session(Store(store.samples, store.series, found)).exemplars('rate(event_value{event_type="click"}[1d]) + 1', _FROM, _TO)
    return out.select(*_named(out, _EL), "ts", "value", F.element_at("ex_labels", "trace").alias("trace"))
