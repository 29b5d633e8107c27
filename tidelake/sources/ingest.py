"""What happens between parsing and storing: label conflicts, limits, reports, and the
translation of telemetry data points to series."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelake.functions.ieee import INF
from tidelake.operators import histograms
from tidelake.operators import labels as L


def attach_target(rows: DataFrame, target: dict[str, str], honor_labels: bool = False) -> DataFrame:
    """Add a target's labels.  Where a sample has such a label already, its own goes to
    exported_<name> (again exported_ if that is taken), or stays if `honor_labels`."""
    labels = F.col("labels")
    for name in sorted(target):
        own = L.value(labels, name)
        if honor_labels:
            labels = F.when(F.map_contains_key(F.col("labels"), name), labels).otherwise(L.put(labels, name, F.lit(target[name])))
            continue
        spare = F.lit(f"exported_{name}")
        spare = F.when(F.map_contains_key(labels, spare), F.concat(F.lit("exported_"), spare)).otherwise(spare)
        moved = F.map_from_entries(
            F.concat(F.filter(F.map_entries(labels), lambda e: e["key"] != name), F.array(F.struct(spare.alias("key"), own.alias("value"))))
        )
        labels = L.put(F.when(own != "", moved).otherwise(labels), name, F.lit(target[name]))
    return rows.withColumn("labels", L.normal(labels))


def within_limits(
    rows: DataFrame, sample_limit: int | None = None, label_limit: int | None = None, name_length: int | None = None, value_length: int | None = None,
) -> DataFrame:
    """With `rejected`: the reason why a row's scrape (column scrape) is refused, or null.

    A scrape with too many samples is refused as a whole, one with too many or too long
    labels too."""
    entries = F.map_entries("labels")
    reason = F.lit(None).cast("string")
    if value_length is not None:
        reason = F.when(F.exists(entries, lambda e: F.length(e["value"]) > value_length), "label value too long").otherwise(reason)
    if name_length is not None:
        reason = F.when(F.exists(entries, lambda e: F.length(e["key"]) > name_length), "label name too long").otherwise(reason)
    if label_limit is not None:
        reason = F.when(F.size(entries) > label_limit, "too many labels").otherwise(reason)
    rows = rows.withColumn("_reason", reason)
    found = rows.groupBy("scrape").agg(F.count(F.lit(1)).alias("_n"), F.max("_reason").alias("_worst"))
    if sample_limit is not None:
        found = found.withColumn("_worst", F.when(F.col("_n") > sample_limit, "too many samples").otherwise(F.col("_worst")))
    return rows.join(found.select("scrape", F.col("_worst").alias("rejected")), "scrape").drop("_reason")


def reports(rows: DataFrame, scrapes: DataFrame) -> DataFrame:
    """up, scrape_samples_scraped, scrape_samples_post_metric_relabeling and
    scrape_duration_seconds of each scrape (scrape, ts, ok, seconds, scraped)."""
    kept = rows.groupBy("scrape").agg(F.count(F.lit(1)).cast("double").alias("kept"))
    all_ = scrapes.join(kept, "scrape", "left")
    values = F.array(
        F.struct(F.lit("up").alias("metric"), F.col("ok").cast("double").alias("f")),
        F.struct(F.lit("scrape_duration_seconds").alias("metric"), F.col("seconds").cast("double").alias("f")),
        F.struct(F.lit("scrape_samples_scraped").alias("metric"), F.col("scraped").cast("double").alias("f")),
        F.struct(F.lit("scrape_samples_post_metric_relabeling").alias("metric"), F.coalesce("kept", F.lit(0.0)).alias("f")),
    )
    return all_.select("scrape", "ts", F.explode(values).alias("x")).select("scrape", "ts", "x.metric", "x.f")


# Names of units in metric names.
UNITS = {
    "d": "days", "h": "hours", "min": "minutes", "s": "seconds", "ms": "milliseconds", "us": "microseconds", "ns": "nanoseconds",
    "By": "bytes", "KiBy": "kibibytes", "MiBy": "mebibytes", "GiBy": "gibibytes", "TiBy": "tibibytes", "KBy": "kilobytes", "MBy": "megabytes",
    "GBy": "gigabytes", "TBy": "terabytes", "m": "meters", "V": "volts", "A": "amperes", "J": "joules", "W": "watts", "g": "grams",
    "Cel": "celsius", "Hz": "hertz", "%": "percent", "1": "",
}
PER_UNITS = {"s": "second", "m": "minute", "h": "hour", "d": "day", "w": "week", "mo": "month", "y": "year"}


def metric_name(name: str, unit: str = "", monotonic_sum: bool = False, gauge: bool = False) -> str:
    """A name in lower-level form: words joined by one _, with the unit and _total or _ratio."""
    words = [w for w in re.split(r"[^a-zA-Z0-9:]+", name) if w]
    main, _, per = unit.partition("/")
    named = set(words)  # a unit that is a word of the name is not said again; one inside a word is
    if "{" not in main and (long := UNITS.get(main.strip(), main.strip())):
        parts = re.findall(r"[a-zA-Z0-9]+", long)
        words += [] if named.issuperset(parts) else parts
    if per and "{" not in per and (long := PER_UNITS.get(per.strip(), per.strip())) not in named:
        words += ["per", long]
    if monotonic_sum:
        words = [w for w in words if w != "total"] + ["total"]
    if gauge and unit == "1":
        words = [w for w in words if w != "ratio"] + ["ratio"]
    out = "_".join(words)
    return f"_{out}" if out[:1].isdigit() else out


def label_name(name: Column) -> Column:
    """Characters that a label name cannot have become _; a leading digit gets key_."""
    clean = F.regexp_replace(name, r"[^a-zA-Z0-9_]", "_")
    return F.when(clean.rlike(r"^[0-9]"), F.concat(F.lit("key_"), clean)).when(clean.rlike(r"^_[^_]"), F.concat(F.lit("key"), clean)).otherwise(clean)


def _taken() -> Column:
    return F.coalesce(F.col("temporality") == "cumulative", F.lit(False)) | F.col("kind").isin("gauge", "summary")


def refused(points: DataFrame) -> DataFrame:
    """The points that `translate` leaves out, by name, kind and temporality, with their number."""
    return points.where(~_taken()).groupBy("name", "kind", "temporality").agg(F.count(F.lit(1)).alias("n"))


def translate(points: DataFrame) -> DataFrame:
    """Telemetry data points to rows (metric, labels, ts, f[, h]).

    points: name (normalised), kind (gauge, sum, histogram, exponential, summary), temporality
    (cumulative or delta; `refused` has the delta points), attributes and resource maps, ts, value, count,
    sum, bounds, counts (of explicit buckets), quantiles (array of q, v), and for exponential
    ones scale, zero_count, zero_threshold, pos_offset, pos, neg_offset, neg.
    service.namespace/service.name become job, service.instance.id instance."""
    renamed = lambda m: F.transform(F.map_entries(m), lambda e: F.struct(label_name(e["key"]).alias("key"), e["value"].alias("value")))
    service = F.concat_ws("/", F.element_at("resource", "service.namespace"), F.element_at("resource", "service.name"))
    own = F.array(
        F.struct(F.lit("job").alias("key"), service.alias("value")),
        F.struct(F.lit("instance").alias("key"), F.coalesce(F.element_at("resource", "service.instance.id"), F.lit("")).alias("value")),
    )
    entries = F.filter(renamed(F.col("attributes")), lambda e: ~e["key"].isin("job", "instance"))
    # Attributes whose names become equal are joined by ';', in order of name.
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    merged = F.transform(
        keys, lambda k: F.struct(k.alias("key"), F.array_join(F.transform(F.array_sort(F.filter(entries, lambda e: e["key"] == k)), lambda e: e["value"]), ";").alias("value"))
    )
    p = points.where(_taken())
    p = p.withColumn("labels", L.normal(F.map_from_entries(F.concat(merged, own))))
    plain = p.where(F.col("kind").isin("gauge", "sum")).select(F.col("name").alias("metric"), "labels", "ts", F.col("value").alias("f"))
    h = p.where("kind = 'histogram'")
    running = F.aggregate(
        F.col("counts"), F.array().cast("array<double>"),
        lambda a, c: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0.0)) + c.cast("double"))),
    )
    bounds = F.concat(F.col("bounds").cast("array<double>"), F.array(F.lit(INF)))
    text = lambda b: F.when(b == F.lit(INF), F.lit("+Inf")).otherwise(_bound(b))
    pairs = F.arrays_zip(bounds.alias("le"), running.alias("c"))
    buckets = h.select("name", "labels", "ts", F.explode(pairs).alias("b"))
    buckets = buckets.select(F.concat("name", F.lit("_bucket")).alias("metric"), L.put(F.col("labels"), "le", text(F.col("b.le"))).alias("labels"), "ts", F.col("b.c").alias("f"))
    both = p.where(F.col("kind").isin("histogram", "summary"))
    parts = [
        both.select(F.concat("name", F.lit("_sum")).alias("metric"), "labels", "ts", F.col("sum").alias("f")),
        both.select(F.concat("name", F.lit("_count")).alias("metric"), "labels", "ts", F.col("count").cast("double").alias("f")),
    ]
    s = p.where("kind = 'summary'").select("name", "labels", "ts", F.explode("quantiles").alias("x"))
    parts.append(s.select(F.col("name").alias("metric"), L.put(F.col("labels"), "quantile", _bound(F.col("x.q"))).alias("labels"), "ts", F.col("x.v").alias("f")))
    out = plain.unionByName(buckets)
    for part in parts:
        out = out.unionByName(part)
    e = p.where("kind = 'exponential'")
    # Bucket `offset + k` of base 2**(2**-scale) is bucket offset + k + 1 of ours.
    spread = lambda offset, counts: F.map_from_entries(F.transform(counts, lambda c, k: F.struct((k + F.col(offset) + 1).cast("int").alias("key"), c.cast("double").alias("value"))))
    native = histograms.struct(
        schema=F.col("scale"), zero_threshold=F.coalesce("zero_threshold", F.lit(0.0)), zero_count=F.col("zero_count").cast("double"),
        count=F.col("count").cast("double"), sum=F.col("sum"), pos=spread("pos_offset", F.col("pos")), neg=spread("neg_offset", F.col("neg")),
    )
    e = e.select(F.col("name").alias("metric"), "labels", "ts", F.lit(None).cast("double").alias("f"), histograms.compact(histograms.to_schema(native, F.least(F.col("scale"), F.lit(8)))).alias("h"))
    info = p.select(
        F.lit("target_info").alias("metric"),
        L.normal(F.map_from_entries(F.concat(F.filter(renamed(F.col("resource")), lambda e: ~e["key"].isin("service_name", "service_namespace", "service_instance_id", "job", "instance")), own))).alias("labels"),
        "ts", F.lit(1.0).alias("f"),
    )
    info = info.groupBy("metric", F.to_json("labels").alias("key")).agg(F.max("ts").alias("ts"), F.max("f").alias("f"))
    info = info.select("metric", L.from_key(F.col("key")).alias("labels"), "ts", "f").where(F.size(F.map_filter("labels", lambda k, _: ~k.isin("job", "instance"))) > 0)
    return out.unionByName(info).unionByName(e, allowMissingColumns=True)


def _bound(b: Column) -> Column:
    from tidelake.functions.ieee import format_value

    return format_value(b)


def unpivot(wide: DataFrame, dataset: str, keys: dict[str, str], columns: list[str], order: str, step_ms: int = 1000) -> DataFrame:
    """A wide table of measurements as series: one for each column and key combination, one
    sample a row in the given order, at a fixed distance in time."""
    from pyspark.sql import Window

    upto = Window.partitionBy(*[F.col(c) for c in keys.values()]).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    place = F.count(F.lit(1)).over(upto) - 1  # a row_number is an int, too short for the times of some 2 million rows
    rows = wide.withColumn("ts", place * step_ms)
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("f")) for c in columns])
    rows = rows.withColumn("x", F.explode(pairs)).where("x.f is not null")
    own = [x for label, c in keys.items() for x in (F.lit(label), F.col(c).cast("string"))]
    return rows.select(F.lit(dataset).alias("metric"), L.normal(F.create_map(*own, F.lit("column"), F.col("x.column"))).alias("labels"), "ts", F.col("x.f").alias("f"))


def delayed(samples: DataFrame, share: float = 0.2, most_ms: int = 1_200_000, seed: int = 1) -> DataFrame:
    """With `arrival`: a share of the samples comes late, by up to `most_ms`; by a hash, so
    that reruns agree."""
    u = F.pmod(F.xxhash64(F.lit(seed), "series_id", "ts"), F.lit(1 << 30)) / float(1 << 30)
    late = F.pmod(F.xxhash64(F.lit(seed + 1), "series_id", "ts"), F.lit(most_ms)) + 1
    return samples.withColumn("arrival", F.col("ts") + F.when(u < share, late).otherwise(0))
