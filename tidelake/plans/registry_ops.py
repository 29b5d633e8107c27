"""Queries of the operators around the query language: storage, codec, relabeling, rules and
streams, over the driver's tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.model import Store
from tidelake.operators import codec, relabel, storage
from tidelake.operators import labels as L
from tidelake.plans.api import Session
from tidelake.plans.engine import Options
from tidelake.plans.registry import DAY, EVENT_VALUE, ORACLE_SQL, ORDER_COUNT, ORDERS, QUERIES, WHOLE_ORDERS, instant, steps
from tidelake.session import Scratch, read_table
from tidelake.sources import exposition, ingest, tables
from tidelake.streaming import rules

BOUND = 0.01
_Q = f"CAST(sign(f) * floor(abs(f) / {2 * BOUND} + 0.5) AS BIGINT)"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _events(spark: SparkSession, sf_dir: str) -> Store:
    store = tables.events(spark, sf_dir)
    keep = F.col("metric") == "event_value"
    return Store(store.samples.where(keep), store.series.where(keep))


def _label(df: DataFrame, store: Store, names: list[str]) -> DataFrame:
    series = store.series.select("series_id", *[F.element_at("labels", F.lit(n)).alias(n) for n in names])
    return df.join(series, "series_id").drop("series_id")


# -- storage ------------------------------------------------------------------------------------


@query(f"SELECT event_type, user_id, t AS ts, {_Q} AS q FROM ({EVENT_VALUE})")
def codec_quantize(spark, sf_dir):
    store = _events(spark, sf_dir)
    return _label(codec.quantize(store.samples, BOUND), store, ["event_type", "user_id"]).select("event_type", "user_id", "ts", "q")


@query(f"SELECT event_type, user_id, t AS ts, round({_Q} * {2 * BOUND}, 6) AS f FROM ({EVENT_VALUE})")
def codec_chunks_round_trip(spark, sf_dir):
    store = _events(spark, sf_dir)
    back = codec.dequantize(codec.decode_chunks(codec.encode_chunks(codec.quantize(store.samples, BOUND), 100)))
    return _label(back.select("series_id", "ts", F.round("f", 6).alias("f")), store, ["event_type", "user_id"])


@query(f"SELECT event_type, user_id, t AS ts, round({_Q} * {2 * BOUND}, 6) AS f FROM ({EVENT_VALUE})")
def codec_recompaction(spark, sf_dir):
    store = _events(spark, sf_dir)
    chunks = codec.encode_chunks(codec.quantize(store.samples, BOUND), 50, "bitpacking")
    for code, size in (("simple8b", 80), ("huffman", storage.chunk_size(2))):
        chunks = codec.recode(chunks, size, code)
    back = codec.dequantize(codec.decode_chunks(chunks))
    return _label(back.select("series_id", "ts", F.round("f", 6).alias("f")), store, ["event_type", "user_id"])


@query(f"SELECT count(*) AS samples, round(max(abs(f - {_Q} * {2 * BOUND})), 6) AS max_error, 0 AS violations, true AS smaller FROM ({EVENT_VALUE})")
def codec_error_report(spark, sf_dir):
    store = _events(spark, sf_dir)
    chunks = codec.encode_chunks(codec.quantize(store.samples, BOUND), 1000)
    report = codec.report(store.samples, chunks, BOUND)
    return report.select("samples", F.round("max_error", 6).alias("max_error"), F.col("violations").cast("int").alias("violations"), (F.col("ratio") > 1).alias("smaller"))


_SPLIT = 1_705_000_000_000


@query(f"SELECT event_type, user_id, t AS ts, CASE WHEN t % 2 = 0 THEN f ELSE -f END AS f FROM ({EVENT_VALUE})")
def merge_sources(spark, sf_dir):
    store = _events(spark, sf_dir)
    rows = store.samples.select("series_id", "ts", "f")
    merged = storage.merge_sources([rows.where("ts % 2 = 0"), rows.withColumn("f", -F.col("f"))])
    return _label(merged, store, ["event_type", "user_id"]).select("event_type", "user_id", "ts", "f")


@query(
    f"SELECT event_type, user_id, t AS ts, f FROM ({EVENT_VALUE}) "
    f"WHERE NOT (event_type = 'click' AND t BETWEEN {_SPLIT} AND {_SPLIT + 6 * DAY})"
)
def delete_and_compact(spark, sf_dir):
    store = _events(spark, sf_dir)
    gone = store.series.where(F.element_at("labels", F.lit("event_type")) == "click")
    none = spark.createDataFrame([], "series_id long, mint long, maxt long")
    marks = storage.delete_range(storage.delete_range(none, gone, _SPLIT, _SPLIT + 4 * DAY), gone, _SPLIT + 2 * DAY, _SPLIT + 6 * DAY)
    rows = store.samples.select("series_id", "ts", "f")
    merged = storage.compact([rows.where(F.col("ts") < _SPLIT + 3 * DAY), rows.where(F.col("ts") > _SPLIT)], marks)
    return _label(merged, store, ["event_type", "user_id"]).select("event_type", "user_id", "ts", "f")


@query(
    f"WITH s AS (SELECT DISTINCT event_type, user_id FROM ({EVENT_VALUE})), p AS (SELECT 'event_type' AS k, event_type AS v FROM s UNION ALL SELECT 'user_id', user_id FROM s), "
    "a AS (SELECT 'series_by_label' AS kind, k AS name, count(*) AS n FROM p GROUP BY 2), b AS (SELECT 'values_by_label' AS kind, k AS name, count(DISTINCT v) AS n FROM p GROUP BY 2), "
    "c AS (SELECT 'series_by_pair' AS kind, k || '=' || v AS name, count(*) AS n FROM p GROUP BY 2 ORDER BY n DESC, name LIMIT 10), d AS (SELECT 'series_by_metric' AS kind, 'event_value' AS name, count(*) AS n FROM s) "
    "SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c UNION ALL SELECT * FROM d"
)
def cardinality(spark, sf_dir):
    return storage.cardinality(_events(spark, sf_dir).series)


@query(
    f"WITH e AS (SELECT event_type, user_id, t // {DAY} * {DAY} AS block, count(*) AS n FROM ({EVENT_VALUE}) GROUP BY ALL), "
    "f AS (SELECT *, CASE WHEN block = min(block) OVER (PARTITION BY event_type, user_id) THEN 1 ELSE 0 END AS new FROM e) "
    "SELECT block, count(*) AS series, CAST(sum(n) AS BIGINT) AS samples, CAST(sum(new) AS BIGINT) AS new_series FROM f GROUP BY block"
)
def block_churn(spark, sf_dir):
    return storage.churn(_events(spark, sf_dir).samples, DAY)


_WINDOW = 400 * DAY
_ARRIVALS = "SELECT o_orderkey AS arrival, o_orderstatus AS status, epoch_ms(o_orderdate) AS ts, o_totalprice AS f FROM orders"


@query(
    f"WITH s AS ({_ARRIVALS}), a AS (SELECT *, max(ts) OVER (PARTITION BY status ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest, "
    "max(ts) OVER (ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS head, row_number() OVER (PARTITION BY status, ts ORDER BY arrival) AS n, "
    "first(f) OVER (PARTITION BY status, ts ORDER BY arrival) AS f0 FROM s) "
    "SELECT arrival, status, ts, CASE WHEN n > 1 AND f = f0 THEN 'duplicate' WHEN n > 1 THEN 'conflict' WHEN newest IS NULL OR ts >= newest THEN 'accepted' "
    f"WHEN ts >= head - {_WINDOW} THEN 'out_of_order_accepted' ELSE 'too_old' END AS verdict FROM a"
)
def admission(spark, sf_dir):
    rows = read_table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("arrival"), F.col("o_orderstatus").alias("status"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("ts"), F.col("o_totalprice").alias("f")
    )
    out = storage.classify(rows.withColumn("series_id", F.xxhash64("status")), _WINDOW)
    return out.select("arrival", "status", "ts", "verdict")


# -- labels and metadata ----------------------------------------------------------------------------


@query(
    "SELECT DISTINCT upper(event_type) AS kind, event_type || '/' || CAST(user_id AS VARCHAR) AS id, CAST(user_id AS VARCHAR) AS u FROM events "
    "WHERE event_type <> 'error' AND regexp_full_match(CAST(user_id AS VARCHAR), '.*[02468]')"
)
def relabel_rules(spark, sf_dir):
    rules_ = [
        relabel.Rule("drop", ("event_type",), regex="error"),
        relabel.Rule("keep", ("user_id",), regex=".*[02468]"),
        relabel.Rule("replace", ("event_type", "user_id"), separator="/", regex="(.+)", target_label="id"),
        relabel.Rule("uppercase", ("event_type",), target_label="kind"),
        relabel.Rule("labelmap", regex="(u)ser_id", replacement="$1"),
        relabel.Rule("labeldrop", regex="event_type|user_id"),
    ]
    out = relabel.apply(_events(spark, sf_dir).series, rules_)
    return out.select(*[F.element_at("labels", F.lit(n)).alias(n) for n in ("kind", "id", "u")])


@query("SELECT DISTINCT event_type AS value FROM events WHERE event_type <> 'view'")
def label_values(spark, sf_dir):
    return Session(_events(spark, sf_dir)).label_values("event_type", ['event_value{event_type!="view"}'])


@query("SELECT unnest(['__name__', 'event_type', 'user_id']) AS name")
def label_names(spark, sf_dir):
    return Session(_events(spark, sf_dir)).label_names()


@query("SELECT DISTINCT event_type, CAST(user_id AS VARCHAR) AS user_id FROM events WHERE CAST(user_id AS VARCHAR) LIKE '1%'")
def series_list(spark, sf_dir):
    found = Session(_events(spark, sf_dir)).series(['{user_id=~"1.*"}'])
    return found.select(*[F.element_at("labels", F.lit(n)).alias(n) for n in ("event_type", "user_id")])


_NUMBER = "CASE WHEN f = floor(f) THEN CAST(CAST(f AS BIGINT) AS VARCHAR) ELSE CAST(f AS VARCHAR) END"
_LINE = "'event_value{event_type=\"' || event_type || '\",user_id=\"' || user_id || '\"} ' || "


@query(f"SELECT {_LINE}{_NUMBER} || ' ' || CAST(t AS VARCHAR) AS value FROM ({EVENT_VALUE})")
def text_dump(spark, sf_dir):
    return exposition.dump(_events(spark, sf_dir), 0, 1 << 60)


def _payloads(lines, end=""):
    """Lines as bodies of some thousand; a hash deals them out, to a number that their count gives."""
    many = max(1, lines.count() // 4000)
    dealt = lines.withColumn("p", F.pmod(F.xxhash64("value"), F.lit(many))).groupBy("p")
    body = F.concat(F.array_join(F.collect_list("value"), "\n"), F.lit(f"\n{end}"))
    return dealt.agg(body.alias("body")).select("body", F.lit(0).cast("long").alias("ts"))


@query(f"SELECT event_type, count(*) AS n, round(sum(f), 4) AS total FROM ({EVENT_VALUE}) GROUP BY 1")
def text_round_trip(spark, sf_dir):
    rows = exposition.read(_payloads(exposition.dump(_events(spark, sf_dir), 0, 1 << 60)))
    rows = rows.groupBy(L.value(F.col("labels"), "event_type").alias("event_type"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("f"), 4).alias("total"))


@query(
    "SELECT l_returnflag AS metric_flag, le, CAST(count(*) FILTER (l_quantity <= bound) AS DOUBLE) AS f FROM lineitem, "
    "(SELECT unnest(['10', '30', '+Inf']) AS le, unnest([10.0, 30.0, 'inf'::DOUBLE]) AS bound) GROUP BY ALL"
)
def telemetry_histograms(spark, sf_dir):
    rows = read_table(spark, sf_dir, "lineitem")
    q = F.col("l_quantity")
    counts = [F.sum(F.when(c, 1).otherwise(0)) for c in (q <= 10, (q > 10) & (q <= 30), q > 30)]
    points = rows.groupBy("l_returnflag").agg(F.array(*counts).alias("counts"), F.sum(q).alias("sum"), F.count(F.lit(1)).alias("count"))
    points = points.select(
        F.lit("quantity").alias("name"), F.lit("histogram").alias("kind"), F.lit("cumulative").alias("temporality"), F.create_map(F.lit("flag"), "l_returnflag").alias("attributes"),
        F.create_map(F.lit("service.name"), F.lit("lines")).alias("resource"), F.lit(0).cast("long").alias("ts"), F.lit(None).cast("double").alias("value"), "count", "sum",
        F.array(F.lit(10.0), F.lit(30.0)).alias("bounds"), "counts", F.array().cast("array<struct<q:double,v:double>>").alias("quantiles"),
        F.lit(0).alias("scale"), F.lit(0.0).alias("zero_count"), F.lit(0.0).alias("zero_threshold"), F.lit(0).alias("pos_offset"), F.array().cast("array<long>").alias("pos"),
        F.lit(0).alias("neg_offset"), F.array().cast("array<long>").alias("neg"),
    )
    out = ingest.translate(points).where("metric = 'quantity_bucket'")
    return out.select(L.value(F.col("labels"), "flag").alias("metric_flag"), L.value(F.col("labels"), "le").alias("le"), "f")


# -- rules and streams --------------------------------------------------------------------------------

_RECORD = rules.RecordingRule("status:orders:sum", "sum by (status) (order_count)", {"team": "sales"})
_ALERT = rules.AlertRule("Busy", "order_count > 1", hold_ms=70 * DAY)


def _recorded(grid):
    return f"SELECT step AS ts, status, 'sales' AS team, CAST(sum(v) AS DOUBLE) AS f FROM ({instant(ORDER_COUNT, ['status', 'priority'], grid, 40 * DAY)}) GROUP BY ALL"


def _record(spark, sf_dir, grid):
    group = rules.Group("orders", (_RECORD,), grid[2])
    rows = rules.record(tables.orders(spark, sf_dir), _RECORD, group, grid[0], grid[1], Options(lookback=40 * DAY))
    return rows.where("not stale").select("ts", L.value(F.col("labels"), "status").alias("status"), L.value(F.col("labels"), "team").alias("team"), "f")


@query(_recorded(ORDERS))
def recording_rule(spark, sf_dir):
    return _record(spark, sf_dir, ORDERS)


@query(_recorded(WHOLE_ORDERS))
def whole_recording_rule(spark, sf_dir):
    return _record(spark, sf_dir, WHOLE_ORDERS)


def _runs(grid):
    count = instant(ORDER_COUNT, ["status", "priority"], grid, 40 * DAY)
    return (
        f"WITH a AS (SELECT * FROM ({count}) WHERE v > 1), b AS (SELECT *, step - {grid[2]} * row_number() OVER (PARTITION BY status, priority ORDER BY step) AS run FROM a), "
        "c AS (SELECT *, min(step) OVER (PARTITION BY status, priority, run) AS active_at FROM b) "
        f"SELECT step, status, priority, active_at, CASE WHEN step - active_at >= {70 * DAY} THEN 'firing' ELSE 'pending' END AS state FROM c"
    )


def _alerts(spark, sf_dir, grid):
    group = rules.Group("alerts", (_ALERT,), grid[2])
    out = rules.alert(tables.orders(spark, sf_dir), _ALERT, group, grid[0], grid[1], Options(lookback=40 * DAY)).where("state <> 'resolved'")
    return out.select("step", L.value(F.col("labels"), "status").alias("status"), L.value(F.col("labels"), "priority").alias("priority"), "active_at", "state")


@query(_runs(ORDERS))
def alert_rule(spark, sf_dir):
    return _alerts(spark, sf_dir, ORDERS)


@query(_runs(WHOLE_ORDERS))
def whole_alert_rule(spark, sf_dir):
    return _alerts(spark, sf_dir, WHOLE_ORDERS)


_STREAM = (1_704_153_600_000, 1_706_486_400_000, 2 * DAY)


@query(
    f"SELECT event_type, step, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM events JOIN ({steps((_STREAM[0] - 20 * DAY, _STREAM[1] + 20 * DAY, _STREAM[2]))}) g "
    f"ON epoch_us(ts) // 1000 > step - {4 * DAY} AND epoch_us(ts) // 1000 <= step GROUP BY ALL"
)
def stream_sliding_window(spark, sf_dir):
    """A sliding window over a stream of files, run until its input ends."""
    schema = read_table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events*").parquet(sf_dir)
    stream = stream.select("event_type", F.col("ts").cast("timestamp").alias("at"), "value")
    out = rules.window_aggregate(stream, ["event_type"], 4 * DAY, 2 * DAY, 60 * DAY, [F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")])
    scratch = Scratch(spark, "stream")
    # Results go to files, one set for each batch; complete mode rewrites them, so the last set is the answer.
    write = lambda batch, number: batch.write.mode("overwrite").parquet(scratch.path("result"))
    running = out.writeStream.foreachBatch(write).outputMode("complete").option("checkpointLocation", scratch.path("checkpoint")).trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.parquet(scratch.path("result"))
