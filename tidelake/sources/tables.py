"""The driver's relational tables as time series."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelake.model import Store, store_of
from tidelake.operators import histograms
from tidelake.operators import labels as L
from tidelake.session import read_table


def to_store(parts: list[tuple[str, DataFrame, list[str]]], series_of: dict[str, DataFrame] | None = None) -> Store:
    """A store from (metric, rows (ts, f, label columns...), label columns) of each metric;
    `series_of` has the label columns of a metric where they are cheaper to tell.

    The id is a hash of metric and label columns; the labels themselves live in the series
    dimension alone, so samples stay narrow: four columns, and the metric is a literal that
    lets the optimizer drop the other metrics' branches."""
    samples, series = [], []
    for metric, rows, names in parts:
        key = [F.lit(metric), *[F.col(n).cast("string") for n in names]]
        identity = F.xxhash64(*key).alias("series_id")
        name = F.lit(metric).alias("metric")
        samples.append(rows.select(identity, name, "ts", F.col("f").cast("double").alias("f")))
        known = (series_of or {}).get(metric, rows)
        distinct = known.select(*names).distinct() if names else rows.limit(1)
        series.append(distinct.select(identity, name, L.of(names).alias("labels")))
    return Store(reduce(DataFrame.unionByName, samples), reduce(DataFrame.unionByName, series))


def _ms(c: str) -> Column:
    return F.unix_millis(F.col(c).cast("timestamp"))


def events(spark: SparkSession, sf_dir: str) -> Store:
    """event_value: a gauge; events_total: how many events of its type a user had so far,
    a counter that starts anew every 7 days; one point a millisecond."""
    rows = read_table(spark, sf_dir, "events").select(F.col("event_type"), F.col("user_id"), _ms("ts").alias("ts"), "value")
    rows = rows.groupBy("event_type", "user_id", "ts").agg(F.max("value").alias("f"))
    order = Window.partitionBy("event_type", "user_id", F.floor(F.col("ts") / 604_800_000)).orderBy("ts")
    total = rows.withColumn("f", F.row_number().over(order))
    names = ["event_type", "user_id"]
    return to_store([("event_value", rows, names), ("events_total", total, names)])


def orders(spark: SparkSession, sf_dir: str) -> Store:
    """order_price{status, priority}: sum a day; order_count: number a day."""
    rows = read_table(spark, sf_dir, "orders")
    rows = rows.groupBy(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), _ms("o_orderdate").alias("ts")).agg(
        F.sum("o_totalprice").alias("total"), F.count(F.lit(1)).alias("n")
    )
    names = ["status", "priority"]
    return to_store([("order_price", rows.withColumn("f", F.col("total")), names), ("order_count", rows.withColumn("f", F.col("n")), names)])


def lineitems(spark: SparkSession, sf_dir: str) -> Store:
    """line_quantity{returnflag, linestatus}: sum a day; line_bucket{le, returnflag}: lines so
    far whose quantity is at most le, a classic histogram."""
    rows = read_table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("returnflag"), F.col("l_linestatus").alias("linestatus"), _ms("l_shipdate").alias("ts"), "l_quantity"
    )
    quantity = rows.groupBy("returnflag", "linestatus", "ts").agg(F.sum("l_quantity").alias("f"))
    bounds = {"5": 5.0, "10": 10.0, "20": 20.0, "40": 40.0, "+Inf": float("inf")}
    # A sum for each bound in one aggregate; only its rows, a few for each day, are multiplied.
    below = [F.sum(F.when(F.col("l_quantity") <= b, 1).otherwise(0)).alias(le) for le, b in bounds.items()]
    counts = rows.groupBy("returnflag", "ts").agg(*below)
    pairs = F.explode(F.array(*[F.struct(F.lit(le).alias("le"), F.col(f"`{le}`").alias("n")) for le in bounds])).alias("x")
    bucket = counts.select("returnflag", "ts", pairs).select("returnflag", "ts", "x.le", "x.n")
    order = Window.partitionBy("returnflag", "le").orderBy("ts")
    bucket = bucket.withColumn("f", F.sum("n").over(order))
    names = rows.select("returnflag").distinct().withColumn("le", F.explode(F.array(*[F.lit(le) for le in bounds])))
    return to_store([("line_quantity", quantity, ["returnflag", "linestatus"]), ("line_bucket", bucket, ["le", "returnflag"])], {"line_bucket": names})


def native_lines(spark: SparkSession, sf_dir: str) -> Store:
    """line_native{returnflag}: a native histogram (schema 0) of a day's extended prices."""
    rows = read_table(spark, sf_dir, "lineitem").where("l_extendedprice > 0").select(
        F.col("l_returnflag").alias("returnflag"), _ms("l_shipdate").alias("ts"), F.ceil(F.log2("l_extendedprice")).cast("int").alias("k"), "l_extendedprice"
    )
    rows = rows.groupBy("returnflag", "ts", "k").agg(F.count(F.lit(1)).cast("double").alias("c"), F.sum("l_extendedprice").alias("s"))
    rows = rows.groupBy("returnflag", "ts").agg(F.map_from_entries(F.collect_list(F.struct("k", "c"))).alias("pos"), F.sum("c").alias("n"), F.sum("s").alias("s"))
    h = histograms.struct(schema=F.lit(0), count=F.col("n"), sum=F.col("s"), pos=F.col("pos"))
    return store_of(rows.select(F.lit("line_native").alias("metric"), L.of(["returnflag"]).alias("labels"), "ts", F.lit(None).cast("double").alias("f"), h.alias("h")))


def dimensions(spark: SparkSession, sf_dir: str, ts: int = 0) -> Store:
    """supplier_balance{supplier, nation} and customer_balance{segment, nation} (mean) at one
    time, and nation_info{nation, name, region} of value 1."""
    supplier = read_table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("supplier"), F.col("s_nationkey").alias("nation"), F.lit(ts).cast("long").alias("ts"), F.col("s_acctbal").alias("f")
    )
    customer = read_table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"))
    customer = customer.agg(F.avg("c_acctbal").alias("f")).withColumn("ts", F.lit(ts).cast("long"))
    nation = read_table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("nation"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"), F.lit(ts).cast("long").alias("ts"), F.lit(1.0).alias("f")
    )
    return to_store(
        [
            ("supplier_balance", supplier, ["nation", "supplier"]),
            ("customer_balance", customer, ["nation", "segment"]),
            ("nation_info", nation, ["name", "nation", "region"]),
        ]
    )
