import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from script import instant, load, same

from tidelake.functions.templates import Template
from tidelake.operators import codec, relabel, storage
from tidelake.operators.relabel import Rule
from tidelake.plans.ast import QueryError
from tidelake.sources import exposition, ingest
from tidelake.sources.exposition import FormatError

INF = math.inf


# -- codec -----------------------------------------------------------------------------------------

integers = st.lists(st.one_of(st.integers(0, 3), st.integers(0, 300), st.integers(0, 2**59)), max_size=400)


@settings(max_examples=60, deadline=None)
@given(integers, st.sampled_from(sorted(codec.CODES)))
def test_codes_round_trip(values, name):
    z = np.array(values, np.uint64)
    encode, decode = codec.CODES[name]
    assert decode(encode(z), len(z)).tolist() == values
    assert codec.choose_code(z) in codec.CODES


@given(st.lists(st.integers(-(2**62), 2**62), max_size=50))
def test_zigzag_round_trip(values):
    d = np.array(values, np.int64)
    assert codec.from_zigzag(codec.to_zigzag(d)).tolist() == values


@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=200), st.sampled_from([0.5, 10.0, 1e4]))
def test_segments_stay_within_the_bound(values, bound):
    v = np.array(values)
    assert np.abs(codec.from_segments(codec.segments(v, bound)) - v).max() <= bound * (1 + 1e-6) + 1e-6


def test_chunks_keep_the_bound_and_special_values(spark):
    rng = random.Random(2)
    values = [rng.choice([rng.uniform(-100, 100), float("nan"), INF, -INF, 0.0, -0.005]) for _ in range(500)]
    rows = [(k % 3, k * 1000 + rng.randrange(500), v, rng.random() < 0.02) for k, v in enumerate(values)]
    df = spark.createDataFrame(rows, "series_id long, ts long, f double, stale boolean")
    for bound in (1e-1, 1e-4):
        chunks = codec.encode_chunks(codec.quantize(df, bound), 64)
        longer = codec.recode(codec.recode(chunks, 100, "pfor"), 5000)
        for some in (chunks, longer):
            got = {(r.series_id, r.ts): r for r in codec.dequantize(codec.decode_chunks(some)).collect()}
            assert len(got) == 500
            for s, t, v, stale in rows:
                r = got[s, t]
                assert r.stale == stale
                if not stale and math.isfinite(v):
                    assert abs(r.f - v) <= bound * (1 + 1e-9)
                elif not stale:
                    assert r.f == v or (math.isnan(r.f) and math.isnan(v))
    with pytest.raises(ValueError, match="positive"):
        codec.quantize(df, 0)
    two = codec.quantize(df, 0.1).unionByName(codec.quantize(df.withColumn("ts", F.col("ts") + 10**7), 0.2))
    with pytest.raises(Exception, match="different error bounds"):
        codec.encode_chunks(two, 10_000).count()


# -- storage ------------------------------------------------------------------------------------------


def test_admission(spark):
    rows = [(1, 100, 1.0, 0), (1, 200, 2.0, 1), (1, 200, 2.0, 2), (1, 200, 3.0, 3), (1, 150, 9.0, 4), (2, 50, 1.0, 5), (1, 120, 5.0, 6), (1, 300, 1.0, 7), (1, 120, 5.0, 8)]
    df = spark.createDataFrame(rows, "series_id long, ts long, f double, arrival long")
    verdict = lambda **k: [r.verdict for r in storage.classify(df, **k).orderBy("arrival").collect()]
    assert verdict() == ["accepted", "accepted", "duplicate", "conflict", "out_of_order", "accepted", "out_of_order", "accepted", "duplicate"]
    late = verdict(out_of_order_ms=60)
    assert late[4] == "out_of_order_accepted" and late[6] == "too_old"
    assert verdict(min_valid=60)[5] == "out_of_bounds"


def test_created_zero_and_stale_markers(spark):
    rows = spark.createDataFrame([(1, 100, 5.0, 40), (1, 200, 6.0, 40), (2, 100, 1.0, None), (3, 100, 1.0, 100)], "series_id long, ts long, f double, created long")
    got = sorted((r.series_id, r.ts, r.f) for r in storage.with_created(rows).collect())
    assert got == [(1, 40, 0.0), (1, 100, 5.0), (1, 200, 6.0), (2, 100, 1.0), (3, 100, 1.0)]
    gone = storage.stale_markers(rows, rows.where("series_id > 1"), 300).collect()
    assert [(r.series_id, r.ts, r.stale) for r in gone] == [(1, 300, True)]


def test_intervals_and_shards(spark):
    marks = spark.createDataFrame([(1, 0, 10), (1, 11, 20), (1, 5, 7), (1, 30, 40), (2, 0, 1)], "series_id long, mint long, maxt long")
    got = sorted(tuple(r) for r in storage.merge_intervals(marks).collect())
    assert got == [(1, 0, 20), (1, 30, 40), (2, 0, 1)]
    rows = spark.range(100).select(F.col("id").alias("series_id"))
    assert sum(storage.shard(rows, k, 4).count() for k in range(4)) == 100


def test_compaction_plan():
    block = lambda a, b, **k: storage.Block(a, b, **k)
    ranges = [20, 60, 180]
    assert storage.plan_compaction([block(0, 20), block(20, 40)], ranges) == []
    three = [block(0, 20), block(20, 40), block(40, 60)]
    assert storage.plan_compaction([*three, block(60, 80)], ranges) == three
    assert storage.plan_compaction([block(0, 20), block(10, 40), block(60, 80)], ranges) == [block(0, 20), block(10, 40)]
    dirty = block(0, 180, n_series=100, n_deleted=10)
    assert storage.plan_compaction([dirty, block(180, 200)], ranges) == [dirty]
    assert storage.block_ranges(2, 3) == [2, 6, 18]
    blocks = [block(k * 10, k * 10 + 10, n_bytes=5) for k in range(5)]
    assert storage.beyond_retention(blocks, keep_ms=30) == blocks[:2]
    assert storage.beyond_retention(blocks, keep_bytes=12) == blocks[:3]
    assert [storage.chunk_size(k) for k in (1, 2, 3)] == [1000, 3000, 6000]
    assert storage.min_valid_time(10_000_000) == 6_400_000


# -- labels -----------------------------------------------------------------------------------------------


def relabelled(spark, labels, *rules):
    rows = relabel.apply(spark.createDataFrame([(labels,)], "labels map<string,string>"), list(rules)).collect()
    return rows[0].labels if rows else None


HOST = {"city": "Lyon", "rack": "r17", "zone": "eu-west"}


@pytest.mark.parametrize(
    ("rule", "want"),
    [
        # replace: groups of the whole match; nothing where the pattern does not match; an empty result deletes.
        (Rule(source_labels=("rack",), regex="r(\\d)(\\d)", target_label="row", replacement="row-$2-${1}"), {**HOST, "row": "row-7-1"}),
        (Rule(source_labels=("city", "zone"), separator="@", regex="(.+)@eu-(.+)", target_label="city", replacement="${2}:$1"), {**HOST, "city": "west:Lyon"}),
        (Rule(source_labels=("rack",), regex="17", target_label="row"), HOST),
        (Rule(source_labels=("zone",), target_label="zone", replacement=""), {"city": "Lyon", "rack": "r17"}),
        # keep and drop: patterns are anchored.
        (Rule("drop", ("zone",), regex="eu"), HOST),
        (Rule("drop", ("zone",), regex="eu-.*"), None),
        (Rule("keep", ("city",), regex="Ly|on"), None),
        (Rule("keep", ("city",), regex="(Nice|Lyon)"), HOST),
        (Rule("keepequal", ("city",), target_label="rack"), None),
        (Rule("dropequal", ("city",), target_label="rack"), HOST),
        # labelmap copies, labeldrop and labelkeep choose by name, case actions write a new label.
        (Rule("labelmap", regex="(c|z)(ity|one)", replacement="${2}_$1"), {**HOST, "ity_c": "Lyon", "one_z": "eu-west"}),
        (Rule("labelmap", regex="(c)(ity)", replacement="$2_to_$1"), {**HOST, "c": "Lyon"}),
        (Rule("labeldrop", regex="r.*|city"), {"zone": "eu-west"}),
        (Rule("labelkeep", regex="r.*|city"), {"city": "Lyon", "rack": "r17"}),
        (Rule("uppercase", ("zone",), target_label="area"), {**HOST, "area": "EU-WEST"}),
        (Rule("lowercase", ("city",), target_label="city"), {**HOST, "city": "lyon"}),
    ],
)
def test_relabel_actions(spark, rule, want):
    assert relabelled(spark, HOST, rule) == want


def test_hashmod(spark):
    import hashlib

    want = int.from_bytes(hashlib.md5(b"Lyon;r17").digest()[8:], "big") % 1000
    assert relabelled(spark, HOST, Rule("hashmod", ("city", "rack"), target_label="part", modulus=1000))["part"] == str(want)
    with pytest.raises(QueryError):
        Rule("hashmod", ("a",), target_label="d")
    with pytest.raises(QueryError):
        Rule("explode")


# -- text formats -------------------------------------------------------------------------------------------

PLAIN = """# HELP rpc_total Calls,\\nin all
# TYPE rpc_total counter
rpc_total{method="GET",path="a\\"b\\\\c\\n"} 1027 1395066363000
rpc_total{ method = "POST" , } 3
# a remark
bare 1e3
nan_value NaN
inf_value +Inf
{"quoted.name", x="y"} 0x10
"""


def test_plain_format():
    found = exposition.parse(PLAIN)
    assert found.metadata["rpc_total"] == ["counter", "", "Calls,\nin all"]
    assert found.rows[0] == ("rpc_total", {"method": "GET", "path": 'a"b\\c\n'}, 1395066363000, 1027.0, None)
    assert [r[0] for r in found.rows] == ["rpc_total", "rpc_total", "bare", "nan_value", "inf_value", "quoted.name"]
    assert found.rows[2][3] == 1000 and found.rows[4][3] == INF and found.rows[5][3] == 16


def test_strict_format():
    text = '# TYPE a counter\n# UNIT a s\na_total{x="y"} 5 1.5 # {trace="t1"} 0.5 1.25\na_created{x="y"} 0.25\n# EOF\n'
    found = exposition.parse(text, strict=True)
    assert found.rows == [("a_total", {"x": "y"}, 1500, 5.0, ({"trace": "t1"}, 0.5, 1250))]
    assert found.created == {("a", (("x", "y"),)): 250}


@pytest.mark.parametrize("text", ["a", "a{x=1} 2", 'a{x="1",x="2"} 3', "a 1 2 3", "{} 1", "# TYPE a thing\na 1", 'a{x="y" 1', "a one"])
def test_bad_lines(text):
    with pytest.raises(FormatError, match="line"):
        exposition.parse(text)


def test_strict_needs_its_end():
    for text in ("a 1\n", "# EOF\na 1\n"):
        with pytest.raises(FormatError):
            exposition.parse(text, strict=True)


def test_payload_rows_and_dump(spark):
    bodies = spark.createDataFrame([(PLAIN, 7), ("broken{", 8), (None, 9)], "body string, ts long")
    rows = exposition.read(bodies).collect()
    assert sum(r.error is not None for r in rows) == 1 and len(rows) == 7
    assert {r.ts for r in rows if r.metric == "bare"} == {7}
    store = load(spark, "10s", 'd{a="x\\"y"} 1 2.5')
    assert sorted(r.value for r in exposition.dump(store, 0, 10**9).collect()) == ['d{a="x\\"y"} 1 0', 'd{a="x\\"y"} 2.5 10000']
    assert [r.value for r in exposition.dump(store, 5000, 10**9, seconds=True).collect()] == ['d{a="x\\"y"} 2.5 10.000']


def test_target_labels_and_limits(spark):
    rows = spark.createDataFrame([({"job": "own", "x": "1"}, 1), ({"x": "2"}, 1), ({"exported_job": "e", "job": "own"}, 2)], "labels map<string,string>, scrape long")
    got = [r.labels for r in ingest.attach_target(rows, {"job": "t", "instance": "i"}).collect()]
    assert got == [
        {"exported_job": "own", "instance": "i", "job": "t", "x": "1"}, {"instance": "i", "job": "t", "x": "2"},
        {"exported_exported_job": "own", "exported_job": "e", "instance": "i", "job": "t"},
    ]
    assert [r.labels["job"] for r in ingest.attach_target(rows, {"job": "t"}, honor_labels=True).collect()] == ["own", "t", "own"]
    limits = ingest.within_limits(rows, sample_limit=1, name_length=5).select("scrape", "rejected").distinct().collect()
    assert {r.scrape: r.rejected for r in limits} == {1: "too many samples", 2: "label name too long"}


def test_metric_names():
    assert ingest.metric_name("http.server.duration", "ms") == "http_server_duration_milliseconds"
    assert ingest.metric_name("requests", "1", monotonic_sum=True) == "requests_total"
    assert ingest.metric_name("disk usage", "By/s") == "disk_usage_bytes_per_second"
    assert ingest.metric_name("used", "1", gauge=True) == "used_ratio"
    assert ingest.metric_name("2xx", "{requests}") == "_2xx"
    assert ingest.metric_name("programs", "g") == "programs_grams"
    assert ingest.metric_name("process.dayshift", "d") == "process_dayshift_days"
    assert ingest.metric_name("bytes.sent", "By/s") == "bytes_sent_per_second"


def test_datasets_become_series(spark):
    wide = spark.createDataFrame([("f1", 1, 0.5, 1.0), ("f1", 2, 0.6, None), ("f2", 1, 0.7, 3.0)], "file string, n long, x double, y double")
    rows = ingest.unpivot(wide, "sensor", {"FileID": "file"}, ["x", "y"], "n").collect()
    assert sorted((r.labels["FileID"], r.labels["column"], r.ts, r.f) for r in rows) == [("f1", "x", 0, 0.5), ("f1", "x", 1000, 0.6), ("f1", "y", 0, 1.0), ("f2", "x", 0, 0.7), ("f2", "y", 0, 3.0)]
    late = ingest.delayed(spark.range(1000).select(F.lit(1).alias("series_id"), (F.col("id") * 1000).alias("ts")))
    assert 120 < late.where("arrival > ts").count() < 280


def test_times_of_datasets_are_longs(spark):
    wide = spark.range(4).select(F.lit("f").alias("file"), F.col("id").alias("n"), F.col("id").cast("double").alias("x"))
    rows = ingest.unpivot(wide, "sensor", {"FileID": "file"}, ["x"], "n", step_ms=2_000_000_000)
    assert rows.schema["ts"].dataType.simpleString() == "bigint"
    assert sorted((r.f, r.ts) for r in rows.collect()) == [(0, 0), (1, 2_000_000_000), (2, 4_000_000_000), (3, 6_000_000_000)]


# -- templates -----------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("{{ $labels.job }} is {{ $value }}", "api is 1234567.5"), ("{{ humanize $value }}", "1.235M"), ("{{ $value | humanize1024 }}", "1.177Mi"),
        ("{{ humanizeDuration 93784 }}", "1d 2h 3m 4s"), ("{{ humanizePercentage 0.1234 }}", "12.34%"), ("{{ $labels.job | toUpper }}", "API"),
        ('{{ reReplaceAll "a(.)" "x$1" "abc" }}', "xbc"), ('{{ query "up" | first | value }}', "7"), ("{{ humanizeTimestamp 0 }}", "1970-01-01 00:00:00 +0000 UTC"),
        ('{{ stripPort "h.example:90" }}', "h.example"), ('{{ stripDomain "h.example:90" }}', "h:90"), ("{{ humanizeDuration 0.0012 }}", "1.2ms"), ("none", "none"),
    ],
)
def test_templates(text, want):
    assert Template(query=lambda q: [({"a": "b"}, 7.0)]).expand(text, {"job": "api"}, 1234567.5) == want


def test_template_errors():
    with pytest.raises(QueryError):
        Template().expand("{{ nothing 1 }}", {}, 0.0)
    with pytest.raises(QueryError):
        Template(query=lambda q: []).expand('{{ query "x" | first }}', {}, 0.0)


def test_same_values_merge(spark):
    a = spark.createDataFrame([(1, 0, 1.0), (1, 10, 2.0)], "series_id long, ts long, f double")
    b = spark.createDataFrame([(1, 10, 9.0), (1, 20, 3.0)], "series_id long, ts long, f double")
    got = sorted((r.ts, r.f) for r in storage.merge_sources([a, b]).collect())
    assert got == [(0, 1.0), (10, 2.0), (20, 3.0)]
    same(instant(load(spark, "10s", "x 1"), "x", "0s"), {"x{}": 1})


def test_whole_grids_see_every_row(spark):
    from tidelake.plans import registry, registry_ops  # noqa: F401  (the second adds to the first)

    sf = "/root/testdata/sf0.001"
    for table, column, grid, length in (
        ("events", "ts", registry.WHOLE_EVENTS, 12 * registry.HOUR),
        ("orders", "o_orderdate", registry.WHOLE_ORDERS, 30 * registry.DAY),
        ("lineitem", "l_shipdate", registry.WHOLE_LINES, 100 * registry.DAY),
    ):
        at = [r[0] for r in spark.read.parquet(f"{sf}/{table}.parquet").selectExpr(f"unix_millis(cast({column} as timestamp))").collect()]
        steps = range(grid[0], grid[1] + 1, grid[2])
        assert grid[2] <= length and all(any(s - length < t <= s for s in steps) for t in at)
    names = ["instant_selector", "rate", "agg_sum_by", "topk", "vector_add", "set_or", "fn_ln", "histogram_quantile", "recording_rule", "alert_rule"]
    assert all(f"whole_{n}" in registry.QUERIES and f"whole_{n}" in registry.ORACLE_SQL for n in names)
    counted = registry.QUERIES["whole_agg_count_by"](spark, sf).agg({"v": "sum"}).collect()[0][0]
    events = spark.read.parquet(f"{sf}/events.parquet").selectExpr("event_type", "user_id", f"ceil((unix_millis(cast(ts as timestamp)) - {registry.JAN_2024}) / {12 * registry.HOUR})")
    assert counted == events.distinct().count()
