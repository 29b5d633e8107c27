"""Native histograms as structs of maps, and what the query language does with them.

Buckets are maps from index to count, for observations above and below zero.  With
schema s, bucket i reaches from b**(i-1) (exclusive) to b**i, b = 2**(2**-s); schema -53
has custom bounds instead.  All functions are columns over one row's histograms; only
sums over rows explode buckets, so that they are added with partial sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelake.functions.ieee import INF, NAN, divide, num
from tidelake.model import HISTOGRAM

CUSTOM = -53
UNKNOWN, RESET, NOT_RESET, GAUGE = 0, 1, 2, 3
_MAP = "map<int,double>"


def _no_buckets() -> Column:
    return F.map_from_entries(F.array().cast("array<struct<key:int,value:double>>"))


def struct(**fields: Column) -> Column:
    """A histogram; fields left out are empty."""
    default = {
        "hint": F.lit(UNKNOWN), "schema": F.lit(0), "zero_threshold": num(0.0), "zero_count": num(0.0), "count": num(0.0), "sum": num(0.0),
        "pos": _no_buckets(), "neg": _no_buckets(), "custom": F.array().cast("array<double>"),
    }
    return F.struct(*[fields.get(n, d).alias(n) for n, d in default.items()]).cast(HISTOGRAM)


def let(f, **values: Column) -> Column:
    """f of values that are computed once; an expression that is named often in another
    would otherwise be copied as often, and expressions of expressions grow beyond use."""
    one = F.array(F.struct(*[v.alias(k) for k, v in values.items()]))
    return F.element_at(F.transform(one, lambda x: f(*[x[k] for k in values])), 1)


def _with(h: Column, **fields: Column) -> Column:
    names = ("hint", "schema", "zero_threshold", "zero_count", "count", "sum", "pos", "neg", "custom")
    return F.struct(*[fields.get(n, h[n]).alias(n) for n in names]).cast(HISTOGRAM)


def _merged(entries: Column) -> Column:
    """A map from entries (key, value) whose keys may repeat: counts are added."""
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    total = lambda k: F.aggregate(F.filter(entries, lambda e: e["key"] == k), num(0.0), lambda s, e: s + e["value"])
    return F.map_from_entries(F.transform(F.array_sort(keys), lambda k: F.struct(k.alias("key"), total(k).alias("value"))))


def _coarser(buckets: Column, by: Column) -> Column:
    """Buckets at a resolution lower by `by` doublings."""
    moved = F.transform(
        F.map_entries(buckets), lambda e: F.struct((F.floor((e["key"] - 1) / F.pow(num(2.0), by)) + 1).cast("int").alias("key"), e["value"].alias("value"))
    )
    return F.when(by <= 0, buckets).otherwise(_merged(moved))


def to_schema(h: Column, schema: Column) -> Column:
    def run(h: Column, schema: Column) -> Column:
        by = (h["schema"] - schema).cast("double")
        return F.when(h["schema"] == schema, h).otherwise(_with(h, schema=schema, pos=_coarser(h["pos"], by), neg=_coarser(h["neg"], by)))

    return let(run, h=h, schema=schema)


def widen_zero(h: Column, threshold: Column) -> Column:
    """Let the zero bucket reach at least to `threshold`, taking in what lies inside."""

    def run(h: Column, threshold: Column) -> Column:
        inside = lambda k: upper(h, k) <= threshold
        taken = lambda m: F.aggregate(F.map_values(F.map_filter(m, lambda k, _: inside(k))), num(0.0), lambda s, v: s + v)
        rest = lambda m: F.map_filter(m, lambda k, _: ~inside(k))
        count = h["zero_count"] + taken(h["pos"]) + taken(h["neg"])
        wider = _with(h, zero_threshold=threshold, zero_count=count, pos=rest(h["pos"]), neg=rest(h["neg"]))
        return F.when(threshold <= h["zero_threshold"], h).otherwise(wider)

    return let(run, h=h, threshold=threshold)


def upper(h: Column, k: Column) -> Column:
    """Upper bound of bucket k above zero."""
    custom = F.when(k < F.size(h["custom"]), F.try_element_at(h["custom"], k + 1)).otherwise(num(INF))
    return F.when(h["schema"] == CUSTOM, custom).otherwise(F.pow(num(2.0), k * F.pow(num(2.0), -h["schema"].cast("double"))))


def lower(h: Column, k: Column) -> Column:
    custom = F.when(k <= 0, num(-INF)).otherwise(F.try_element_at(h["custom"], F.greatest(k, F.lit(1))))
    return F.when(h["schema"] == CUSTOM, custom).otherwise(F.pow(num(2.0), (k - 1) * F.pow(num(2.0), -h["schema"].cast("double"))))


def compact(h: Column) -> Column:
    """Without empty buckets."""
    return let(lambda h: _with(h, pos=F.map_filter(h["pos"], lambda _, v: v != 0), neg=F.map_filter(h["neg"], lambda _, v: v != 0)), h=h)


def valid(h: Column) -> Column:
    """No negative counts, and a count that the buckets make up (unless the sum is no number)."""
    parts = F.concat(F.map_values(h["pos"]), F.map_values(h["neg"]), F.array(h["zero_count"]))
    total = F.aggregate(parts, num(0.0), lambda s, v: s + v)
    schema = ((h["schema"] >= -4) & (h["schema"] <= 8)) | (h["schema"] == CUSTOM)
    return schema & ~F.exists(parts, lambda v: v < 0) & (F.isnan(h["sum"]) | (F.abs(total - h["count"]) <= 1e-9 * F.greatest(h["count"], num(1.0))))


def scale(h: Column, by: Column) -> Column:
    return let(lambda h, by: _each(h, lambda v: v * by), h=h, by=by)


def _each(h: Column, f) -> Column:
    """f of the counts and the sum."""
    of = lambda m: F.transform_values(m, lambda _, v: f(v))
    return _with(h, zero_count=f(h["zero_count"]), count=f(h["count"]), sum=f(h["sum"]), pos=of(h["pos"]), neg=of(h["neg"]))


def divide_by(h: Column, by: Column) -> Column:
    return let(lambda h, by: _each(h, lambda v: divide(v, by)), h=h, by=by)


def compatible(a: Column, b: Column) -> Column:
    """Both exponential, or custom with the same bounds."""
    custom = (a["schema"] == CUSTOM) & (b["schema"] == CUSTOM) & (a["custom"] == b["custom"])
    return custom | ((a["schema"] != CUSTOM) & (b["schema"] != CUSTOM))


def combine(a: Column, b: Column, sign: float) -> Column:
    """a + b or a - b at the lower resolution and the wider zero bucket; null if incompatible."""
    def add(x: Column, y: Column) -> Column:
        zip_ = lambda p, q: F.map_zip_with(p, q, lambda _, u, v: F.coalesce(u, num(0.0)) + F.coalesce(v, num(0.0)) * sign)
        return _with(
            x, zero_count=x["zero_count"] + y["zero_count"] * sign, count=x["count"] + y["count"] * sign, sum=x["sum"] + y["sum"] * sign,
            pos=zip_(x["pos"], y["pos"]), neg=zip_(x["neg"], y["neg"]),
        )

    def run(a: Column, b: Column) -> Column:
        schema = F.least(a["schema"], b["schema"])
        threshold = F.greatest(a["zero_threshold"], b["zero_threshold"])
        alike = lambda h: widen_zero(to_schema(h, schema), threshold)
        return F.when(compatible(a, b), compact(let(add, x=alike(a), y=alike(b))))

    return let(run, a=a, b=b)


def equal(a: Column, b: Column) -> Column:
    text = lambda h: F.to_json(let(lambda h: _with(h, hint=F.lit(UNKNOWN)), h=compact(h)))
    return text(a) == text(b)


def reset_between(before: Column, after: Column) -> Column:
    """Whether a counter histogram has started anew: its count or any bucket has fallen, or
    its buckets can no longer hold what they held."""
    def run(before: Column, after: Column) -> Column:
        schema, threshold = after["schema"], after["zero_threshold"]
        coarser = (before["schema"] < schema) | (before["zero_threshold"] > threshold) | ~compatible(before, after)
        old = widen_zero(to_schema(before, F.least(before["schema"], schema)), threshold)
        missing = lambda n, e: e["value"] > F.coalesce(F.try_element_at(n, e["key"]), num(0.0))
        fell = lambda m, n: F.exists(F.map_entries(m), lambda e: missing(n, e))
        lost = let(lambda o: (o["zero_count"] > after["zero_count"]) | fell(o["pos"], after["pos"]) | fell(o["neg"], after["neg"]), o=old)
        by_hint = F.when(after["hint"] == RESET, F.lit(True)).when(after["hint"] == NOT_RESET, F.lit(False))
        return F.coalesce(by_hint, (after["count"] < before["count"]) | coarser | lost)

    return let(run, before=before, after=after)


def buckets(h: Column) -> Column:
    """All buckets (lo, hi, c, zero) in order of value; the zero bucket among them."""
    kind = "array<struct<lo:double,hi:double,c:double,zero:boolean>>"
    custom = h["schema"] == CUSTOM
    neg = F.transform(F.map_entries(h["neg"]), lambda e: F.struct((-upper(h, e["key"])).alias("lo"), (-lower(h, e["key"])).alias("hi"), e["value"].alias("c"), F.lit(False).alias("zero")))
    pos = F.transform(F.map_entries(h["pos"]), lambda e: F.struct(lower(h, e["key"]).alias("lo"), upper(h, e["key"]).alias("hi"), e["value"].alias("c"), F.lit(False).alias("zero")))
    zero = F.array(F.struct((-h["zero_threshold"]).alias("lo"), h["zero_threshold"].alias("hi"), h["zero_count"].alias("c"), F.lit(True).alias("zero")))
    zero = F.when((h["zero_count"] > 0) & ~custom, zero.cast(kind)).otherwise(F.array().cast(kind))
    return F.filter(F.array_sort(F.concat(neg.cast(kind), zero, pos.cast(kind))), lambda b: b["c"] > 0)


def _within(h: Column, b: Column, share: Column) -> Column:
    """The value at a share of a bucket's observations: linear in zero and custom buckets,
    else on the logarithmic scale of the buckets."""
    lo = F.when(b["zero"] & (F.size(h["neg"]) == 0) & (F.size(h["pos"]) > 0), num(0.0)).otherwise(b["lo"])
    hi = F.when(b["zero"] & (F.size(h["pos"]) == 0) & (F.size(h["neg"]) > 0), num(0.0)).otherwise(b["hi"])
    lo = F.when((h["schema"] == CUSTOM) & (b["lo"] == num(-INF)) & (hi > 0), num(0.0)).otherwise(lo)
    linear = lo + (hi - lo) * share
    up = F.pow(num(2.0), F.log2(F.abs(lo)) + (F.log2(F.abs(hi)) - F.log2(F.abs(lo))) * share)
    down = -F.pow(num(2.0), F.log2(F.abs(hi)) + (F.log2(F.abs(lo)) - F.log2(F.abs(hi))) * (1 - share))
    open_end = F.when(hi == num(INF), lo).when(lo == num(-INF), hi)
    return F.coalesce(open_end, F.when(b["zero"] | (h["schema"] == CUSTOM), linear).when(lo > 0, up).otherwise(down))


def quantile(h: Column, q: Column) -> Column:
    return let(lambda h, q, b: _quantile(h, q, b, q * h["count"]), h=h, q=q, b=buckets(h))


def _quantile(h: Column, q: Column, b: Column, rank: Column) -> Column:
    start = F.struct(num(0.0).alias("seen"), F.lit(None).cast("double").alias("value"))

    def step(a: Column, b: Column) -> Column:
        here = a["value"].isNull() & (a["seen"] + b["c"] >= rank)
        return F.struct((a["seen"] + b["c"]).alias("seen"), F.when(here, _within(h, b, (rank - a["seen"]) / b["c"])).otherwise(a["value"]).alias("value"))

    found = F.aggregate(b, start, step, lambda a: a["value"])
    last = F.try_element_at(b, F.lit(-1))["hi"]
    return (
        F.when(F.isnan(q) | (h["count"] == 0) | F.isnan(h["count"]), num(NAN)).when(q < 0, num(-INF)).when(q > 1, num(INF))
        .otherwise(F.coalesce(found, last, num(NAN)))
    )


def fraction(h: Column, low: Column, high: Column) -> Column:
    """The estimated share of observations between two values."""
    return let(_fraction, h=h, low=low, high=high, all_=buckets(h))


def _fraction(h: Column, low: Column, high: Column, all_: Column) -> Column:
    def rank(at: Column) -> Column:
        def below(b: Column) -> Column:
            lo = F.when(b["zero"] & (F.size(h["neg"]) == 0) & (F.size(h["pos"]) > 0), num(0.0)).otherwise(b["lo"])
            hi = F.when(b["zero"] & (F.size(h["pos"]) == 0) & (F.size(h["neg"]) > 0), num(0.0)).otherwise(b["hi"])
            linear = (at - lo) / (hi - lo)
            up = (F.log2(F.abs(at)) - F.log2(F.abs(lo))) / (F.log2(F.abs(hi)) - F.log2(F.abs(lo)))
            share = F.when(b["zero"] | (h["schema"] == CUSTOM), linear).otherwise(up)
            return F.when(at >= hi, b["c"]).when(at <= lo, num(0.0)).otherwise(b["c"] * share)

        return F.aggregate(all_, num(0.0), lambda s, b: s + below(b))

    share = (F.least(rank(high), h["count"]) - rank(low)) / h["count"]
    return F.when((h["count"] == 0) | F.isnan(low) | F.isnan(high), num(NAN)).when(low >= high, num(0.0)).otherwise(share)


def variance(h: Column) -> Column:
    """Around the mean, each bucket's observations at its geometric mean, those of buckets
    across zero at zero."""
    return let(_variance, h=h, mean=divide(h["sum"], h["count"]))


def _variance(h: Column, mean: Column) -> Column:
    def add(s: Column, b: Column) -> Column:
        same = (b["lo"] < 0) == (b["hi"] < 0)
        middle = F.when(b["zero"] | ~same | (b["lo"] * b["hi"] <= 0), num(0.0)).otherwise(F.signum(b["hi"]) * F.sqrt(F.abs(b["lo"] * b["hi"])))
        middle = F.when(h["schema"] == CUSTOM, (b["lo"] + b["hi"]) / 2).otherwise(middle)
        return s + (middle - mean) * (middle - mean) * b["c"]

    return divide(F.aggregate(buckets(h), num(0.0), add), h["count"])


STATISTICS = {
    "histogram_count": lambda h: h["count"],
    "histogram_sum": lambda h: h["sum"],
    "histogram_avg": lambda h: divide(h["sum"], h["count"]),
    "histogram_stddev": lambda h: F.sqrt(variance(h)),
    "histogram_stdvar": variance,
}


def sum_by(df: DataFrame, keys: list[str], average: bool = False) -> DataFrame:
    """(keys..., h): the sum or mean of the histograms of each group; groups that mix
    custom and exponential buckets, or different bounds, give nothing.

    Histograms are brought to the group's lowest resolution and widest zero bucket, and
    their buckets added row by row, with partial sums."""
    shape = df.groupBy(*keys).agg(
        F.min("h.schema").alias("_s"), F.max("h.schema").alias("_t"), F.max("h.zero_threshold").alias("_z"),
        F.min(F.to_json("h.custom")).alias("_c"), F.max(F.to_json("h.custom")).alias("_d"), F.count(F.lit(1)).alias("_n"),
        F.sum("h.count").alias("_count"), F.sum("h.sum").alias("_sum"), F.max("h.hint").alias("_hint"),
    )
    shape = shape.where((F.col("_c") == F.col("_d")) & ((F.col("_s") == F.col("_t")) | (F.col("_s") != CUSTOM)))
    on = F.lit(True)
    renamed = shape.select(*[F.col(k).alias(f"{k}__") for k in keys], *[c for c in shape.columns if c.startswith("_")])
    for k in keys:
        on = on & df[k].eqNullSafe(renamed[f"{k}__"])
    rows = df.join(renamed, on).withColumn("h", widen_zero(to_schema(F.col("h"), F.col("_s")), F.col("_z")))
    part = lambda name, m: F.transform(F.map_entries(m), lambda e: F.struct(F.lit(name).alias("side"), e["key"].alias("k"), e["value"].alias("c")))
    zero = F.array(F.struct(F.lit("z").alias("side"), F.lit(0).alias("k"), F.col("h.zero_count").alias("c")))
    each = rows.select(*keys, F.explode(F.concat(part("p", F.col("h.pos")), part("n", F.col("h.neg")), zero)).alias("b"))
    summed = each.groupBy(*keys, "b.side", "b.k").agg(F.sum("b.c").alias("c"))
    side = lambda s: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("side") == s, F.struct("k", "c")))))
    maps = summed.groupBy(*keys).agg(side("p").alias("pos"), side("n").alias("neg"), F.sum(F.when(F.col("side") == "z", F.col("c"))).alias("zero"))
    on = F.lit(True)
    for k in keys:
        on = on & maps[k].eqNullSafe(renamed[f"{k}__"])
    out = maps.join(renamed, on)
    h = struct(
        hint=F.col("_hint").cast("int"), schema=F.col("_s"), zero_threshold=F.col("_z"), zero_count=F.coalesce("zero", num(0.0)), count=F.col("_count"), sum=F.col("_sum"),
        pos=F.col("pos").cast(_MAP), neg=F.col("neg").cast(_MAP), custom=F.from_json("_c", "array<double>"),
    )
    h = compact(h)
    return out.select(*keys, (divide_by(h, F.col("_n").cast("double")) if average else h).alias("h"))


def increase(points: Column, counter: bool) -> Column:
    """The change over an array of (ts, h) in order: last - first, plus what stood before
    each reset; null where two points do not go together."""
    first = F.element_at(points, 1)["h"]
    start = F.struct(first.alias("before"), scale(first, num(0.0)).alias("lost"))

    def step(a: Column, p: Column) -> Column:
        lost = F.when(reset_between(a["before"], p["h"]), combine(a["lost"], a["before"], 1.0)).otherwise(a["lost"]) if counter else a["lost"]
        return F.struct(p["h"].alias("before"), lost.alias("lost"))

    folded = F.aggregate(F.slice(points, 2, F.size(points)), start, step)
    total = combine(combine(F.element_at(points, -1)["h"], first, -1.0), folded["lost"], 1.0)
    return let(lambda h: F.when(h.isNotNull(), _with(h, hint=F.lit(GAUGE))), h=total)


def from_classic(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., h): custom-bucket histograms from cumulative buckets (keys..., le, v[, sum])."""
    pairs = F.array_sort(F.collect_list(F.struct("le", F.col("v").alias("c"))))
    total = F.max(F.col("sum")) if "sum" in df.columns else num(0.0)
    out = df.groupBy(*keys).agg(pairs.alias("b"), total.alias("sum"))
    bounds = F.filter(F.transform("b", lambda x: x["le"]), lambda le: le != num(INF))
    counts = F.transform("b", lambda x, i: F.struct(i.alias("key"), (x["c"] - F.when(i > 0, F.element_at("b", F.greatest(i, F.lit(1)))["c"]).otherwise(num(0.0))).alias("value")))
    filled = F.map_from_entries(F.filter(counts, lambda e: e["value"] != 0))
    return out.select(*keys, struct(schema=F.lit(CUSTOM), count=F.element_at("b", -1)["c"], sum=F.coalesce("sum", num(0.0)), pos=filled, custom=bounds).alias("h"))
