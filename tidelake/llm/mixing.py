"""Mixing sources to target weights, by a multivariate-hypergeometric splitting tree.

Sizes are counted in words.  The sources, in code-point order (null last), weigh
1, 2, 3, 1, 2, 3, ... and share the total of all sizes; a target stops at `most`
times its source's size, the excess being shared again by weight.

Every source is dealt into 256 blocks by a hash of its documents.  A source's quota
is the number of block instances that the mix takes: each block once for every whole
time that the target holds the source, then blocks in a permuted order as far as they
fit into the rest, and at last one block of which only some documents are taken.  That
block is dealt again into 256 parts, and so on, for three levels; the last part is
filled document by document.

The quotas of all sources stand at the root of a tree over the output shards.  Each
node draws how many instances of each source go to its left half, by a multivariate
hypergeometric draw, so a shard's composition is that of a uniform shuffle of the whole
mix, without the shuffle.  A shard then takes its quota from each source's permuted
instances, a range that no other shard takes, and orders its documents by a hash.
There is a shard for about every `SHARD_WORDS` words of the mix, and 1024 at most; beyond
that each shard is dealt by a hash into as many parts as bring a part back to that size,
and a part, not a shard, is what one task shuffles.

Main path: DataFrame functions only.  What meets in one row is one entry for each
source and 256 for each of its blocks (some ten thousand sources: a few megabytes), and
a number for each source and shard, never documents; documents are read once,
aggregated with partial sums, and joined with the plan by (source, block).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelake.session import Scratch

WORD = r"[^\x20\x09-\x0D]+"
FAN = 256
LEVELS = 3
#: Words of an output shard, until there are 2**MOST_DEPTH; larger shards go in parts.
SHARD_WORDS = 1 << 24
MOST_DEPTH = 10


@dataclass(frozen=True)
class Mix:
    """documents: the input with _key (source), _h, _size and the blocks _b0, _b1, _b2.
    sources: one row for each source.  plan: one row for each source and block taken.
    parts: of a shard, each for one task."""

    documents: DataFrame
    sources: DataFrame
    plan: DataFrame
    parts: int


def sized(documents: DataFrame, seed: int) -> DataFrame:
    """Null text: size 0.  Null source: a source of its own.  Equal rows share a block."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    source = F.col("source").cast("string")
    d = documents.withColumn("_key", F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))).withColumn("_size", size)
    d = d.withColumn("_h", F.xxhash64(F.lit(seed), F.col("_key"), F.col("doc_id").cast("string"), F.col("_size")))
    for level in range(LEVELS):
        block = F.shiftrightunsigned("_h", 8 * level).bitwiseAND(F.lit(FAN - 1))
        d = d.withColumn(f"_b{level}", block.cast("int"))
    return d


def _targets(sizes: DataFrame, most: int) -> DataFrame:
    """One row, `all`: an array of (key, source, w, size, target) in source order."""
    one = sizes.groupBy("_key").agg(F.sum("size").alias("size"))
    name = F.when(F.col("_key") != "n", F.expr("substr(_key, 2)"))
    one = one.select(F.struct((F.col("_key") == "n").alias("last"), name.alias("source"), "_key", "size").alias("x"))
    row = one.agg(F.array_sort(F.collect_list("x")).alias("x"))
    weighted = F.transform(
        "x",
        lambda x, i: F.struct(
            x["_key"].alias("key"), x["source"].alias("source"), (i % 3 + 1).cast("double").alias("w"), x["size"].alias("size")
        ),
    )
    row = row.select(weighted.alias("x"))
    ratio = F.array_sort(
        F.transform("x", lambda x: F.struct((x["size"] / x["w"]).alias("r"), x["size"].cast("double").alias("s"), x["w"].alias("w")))
    )
    total = F.aggregate("x", F.lit(0.0), lambda a, x: a + x["size"])
    weight = F.aggregate("x", F.lit(0.0), lambda a, x: a + x["w"])
    row = row.select("x", ratio.alias("r"), total.alias("total"), weight.alias("weight"))
    # Sources from the smallest ratio of size to weight on: those below the level that the rest would get stop at `most` times their size.
    start = F.struct(F.col("total").alias("t"), F.col("weight").alias("w"))
    rest = F.aggregate(
        "r",
        start,
        lambda a, x: F.when(
            most * x["s"] * a["w"] <= x["w"] * a["t"],
            F.struct((a["t"] - most * x["s"]).alias("t"), (a["w"] - x["w"]).alias("w")),
        ).otherwise(a),
    )
    row = row.select("x", rest.alias("rest"))
    level = F.when(F.col("rest.w") > 0, F.col("rest.t") / F.col("rest.w")).otherwise(F.lit(float("inf")))
    row = row.select("x", level.alias("level"))
    return row.select(
        F.transform(
            "x",
            lambda x: F.struct(
                x["key"],
                x["source"],
                x["w"],
                x["size"],
                F.least((x["size"] * most).cast("double"), F.when(x["size"] > 0, x["w"] * F.col("level")).otherwise(0.0)).alias("target"),
            ),
        ).alias("all")
    )


def _fill(sizes: Column, room: Column, order: Column) -> Column:
    """(left, taken, open): `order` is an array of block numbers; a block is taken if it
    fits into what is left; `open` is the smallest block that did not fit, or null."""
    at = lambda b: F.element_at(sizes, (b + 1).cast("int"))
    start = F.struct(room.cast("double").alias("left"), F.array().cast("array<int>").alias("taken"))
    filled = F.aggregate(
        order,
        start,
        lambda a, b: F.when(
            (at(b) > 0) & (at(b) <= a["left"]),
            F.struct((a["left"] - at(b)).alias("left"), F.concat(a["taken"], F.array(b)).alias("taken")),
        ).otherwise(a),
        lambda a: a,
    )
    return filled


def _open(sizes: Column, order: Column, filled: Column) -> Column:
    at = lambda b: F.element_at(sizes, (b + 1).cast("int"))
    shut = F.filter(order, lambda b: (at(b) > 0) & ~F.array_contains(filled["taken"], b))
    least = F.array_min(F.transform(shut, lambda b: F.struct(at(b).alias("s"), b.alias("b"))))
    return F.when(filled["left"] >= 1, least["b"])


def _permuted(seed: int, *of: Column) -> Column:
    hashed = F.transform(F.sequence(F.lit(0), F.lit(FAN - 1)), lambda b: F.struct(F.xxhash64(F.lit(seed), *of, b).alias("h"), b.alias("b")))
    return F.transform(F.array_sort(hashed), lambda x: x["b"])


def _spread(sums: DataFrame, block: str) -> DataFrame:
    """(_key, sizes): each source's sums by block as an array of FAN numbers."""
    pairs = sums.groupBy("_key").agg(F.map_from_entries(F.collect_list(F.struct(block, "size"))).alias("m"))
    sizes = F.transform(F.sequence(F.lit(0), F.lit(FAN - 1)), lambda b: F.coalesce(F.element_at("m", b), F.lit(0)))
    return pairs.select("_key", sizes.alias("sizes"))


def _hypergeometric(hits: Column, total: Column, draws: Column, *seed: Column) -> Column:
    """Hits among `draws` draws without replacement, by one uniform number a draw."""
    unit = F.lit(float(1 << 30))

    def draw(got: Column, j: Column) -> Column:
        u = F.pmod(F.xxhash64(*seed, j), F.lit(1 << 30)) / unit
        return got + F.when(u * (total - j + 1) < (hits - got), F.lit(1)).otherwise(F.lit(0)).cast("long")

    return F.when(
        (draws > 0) & (hits > 0), F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(draws, F.lit(1).cast("long"))), F.lit(0).cast("long"), draw)
    ).otherwise(F.lit(0).cast("long"))


def _shards(row: DataFrame, seed: int, depth: int) -> DataFrame:
    """From one row with `quotas` to rows (node, quotas) for the 2**depth shards."""
    nodes = row.select(F.lit(1).cast("long").alias("node"), "quotas")
    for _ in range(depth):
        total = F.aggregate("quotas", F.lit(0).cast("long"), lambda a, q: a + q)
        nodes = nodes.withColumn("total", total)
        half = F.floor((F.col("total") + 1) / 2).cast("long")
        indexed = F.transform("quotas", lambda q, i: F.struct(q.alias("q"), i.alias("i")))
        start = F.struct(
            F.col("total").alias("rest"), half.alias("draws"), F.array().cast("array<bigint>").alias("out")
        )

        def split(a: Column, x: Column) -> Column:
            got = _hypergeometric(x["q"], a["rest"], a["draws"], F.lit(seed), F.col("node"), x["i"])
            got = F.transform(F.array(got), lambda g: F.struct((a["rest"] - x["q"]).alias("rest"), (a["draws"] - g).alias("draws"), F.concat(a["out"], F.array(g)).alias("out")))
            return F.element_at(got, 1)

        nodes = nodes.withColumn("left", F.aggregate(indexed, start, split, lambda a: a["out"]))
        right = F.zip_with("quotas", "left", lambda q, g: q - g)
        both = F.array(
            F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("quotas")),
            F.struct((F.col("node") * 2 + 1).alias("node"), right.alias("quotas")),
        )
        nodes = nodes.select(F.explode(both).alias("n")).select("n.node", "n.quotas")
    return nodes


def plan_mix(documents: DataFrame, scratch: Scratch, most: int = 3, depth: int | None = None, seed: int = 17) -> Mix:
    """Plan the mix of all `documents` over 2**depth shards, by default as the total asks for.

    An empty table gives an empty plan; sources without words have target 0 and take
    nothing.  The plan depends on the rows alone, so reruns agree."""
    d = sized(documents, seed)
    slim = scratch.write(d.select("_key", "_h", "_size", "_b0", "_b1", "_b2"), "sized")
    sums = scratch.write(slim.groupBy("_key", "_b0").agg(F.sum("_size").alias("size")), "blocks")
    targets = scratch.write(_targets(sums, most), "targets")
    words = targets.select(F.aggregate("all", F.lit(0).cast("long"), lambda a, x: a + x["size"])).first()[0]
    if depth is None:
        depth = min(MOST_DEPTH, max(0, math.ceil(math.log2(max(1, words / SHARD_WORDS)))))
    parts = max(1, math.ceil(words / (SHARD_WORDS << depth)))
    sources = targets.select(F.posexplode("all").alias("i", "x")).select(
        "i", F.col("x.key").alias("_key"), "x.source", "x.w", F.col("x.size").alias("source_size"), "x.target"
    )
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int")
    sources = sources.withColumn("whole", whole)
    sources = sources.withColumn("room", F.col("target") - F.col("whole") * F.col("source_size"))

    # The rest of each source's target, level by level: whole blocks, then parts of one block.
    state, inside = sources.select("_key", F.col("room").alias("left")), slim
    chosen = sources.select("_key")
    for level in range(LEVELS):
        here = sums if level == 0 else inside.groupBy("_key", f"_b{level}").agg(F.sum("_size").alias("size"))
        filled = _spread(here, f"_b{level}").join(state, "_key")
        filled = filled.withColumn("order", _permuted(seed + level, F.col("_key")))
        filled = filled.withColumn("f", _fill(F.col("sizes"), F.col("left"), F.col("order")))
        filled = filled.withColumn("open", _open(F.col("sizes"), F.col("order"), F.col("f")))
        keep = [F.col("f.taken").alias(f"taken{level}"), F.col("open").alias(f"open{level}"), F.col("f.left").alias("left")]
        if level == 0:
            keep.append("sizes")
        filled = scratch.write(filled.select("_key", *keep), f"level{level}")
        chosen = chosen.join(filled.drop("left"), "_key", "left")
        state = filled.where(f"open{level} is not null").select("_key", "left", F.col(f"open{level}").alias("open"))
        inside = inside.join(state.drop("left"), "_key").where(F.col(f"_b{level}") == F.col("open")).drop("open")
        state = state.drop("open")
    # The last part: distinct documents from the largest on, equal rows as one; at last one more if that comes nearer.
    items = inside.where("_size > 0").groupBy("_key", "_h").agg(F.sum("_size").alias("s"))
    items = items.groupBy("_key").agg(F.sort_array(F.collect_list(F.struct("s", F.col("_h").alias("h"))), asc=False).alias("x"))
    start = F.struct(F.col("left").alias("left"), F.array().cast("array<bigint>").alias("taken"))
    pick = F.aggregate(
        "x",
        start,
        lambda a, x: F.when(
            x["s"] <= a["left"], F.struct((a["left"] - x["s"]).alias("left"), F.concat(a["taken"], F.array(x["h"])).alias("taken"))
        ).otherwise(a),
    )
    items = items.join(state, "_key").withColumn("p", pick)
    extra = F.filter("x", lambda x: ~F.array_contains(F.col("p.taken"), x["h"]) & (x["s"] < 2 * F.col("p.left")))
    extra = F.transform(F.slice(F.sort_array(extra), 1, 1), lambda x: x["h"])
    last = items.select("_key", F.concat("p.taken", extra).alias("last"))
    chosen = scratch.write(chosen.join(last, "_key", "left"), "chosen")
    sources = sources.join(chosen, "_key", "left")

    # Block instances of each source in a permuted order; the open block counts as one.
    filled_blocks = F.filter(F.sequence(F.lit(0), F.lit(FAN - 1)), lambda b: F.coalesce(F.element_at("sizes", (b + 1).cast("int")), F.lit(0)) > 0)
    again = F.when(F.col("whole") > 0, F.sequence(F.lit(0), F.col("whole") - 1)).otherwise(F.array().cast("array<int>"))
    full = F.flatten(F.transform(again, lambda r: F.transform(filled_blocks, lambda b: F.struct(r.alias("r"), b.alias("b"), F.lit(False).alias("part")))))
    rest = F.transform("taken0", lambda b: F.struct(F.col("whole").alias("r"), b.alias("b"), F.lit(False).alias("part")))
    part = F.when(F.col("open0").isNotNull(), F.array(F.struct(F.col("whole").alias("r"), F.col("open0").alias("b"), F.lit(True).alias("part"))))
    none = F.array().cast("array<struct<r:int,b:int,part:boolean>>")
    every = F.concat(full, F.coalesce(rest, none), F.coalesce(part, none))
    shuffled = F.transform(
        F.array_sort(F.transform(every, lambda x: F.struct(F.xxhash64(F.lit(seed + 91), F.col("_key"), x["r"], x["b"]).alias("h"), x.alias("x")))),
        lambda y: y["x"],
    )
    sources = scratch.write(sources.withColumn("instances", shuffled), "instances")

    quotas = sources.agg(F.array_sort(F.collect_list(F.struct("i", F.size("instances").cast("long").alias("n")))).alias("q"))
    quotas = quotas.select(F.transform("q", lambda x: x["n"]).alias("quotas"))
    shards = _shards(quotas, seed, depth)
    shards = shards.agg(F.array_sort(F.collect_list(F.struct((F.col("node") - (1 << depth)).alias("shard"), "quotas"))).alias("shards"))
    shards = scratch.write(shards, "shards")  # one row: 2**depth numbers for each source
    # The shard of each instance in turn: a shard's number as often as its quota says.
    quota = lambda s: F.element_at(s["quotas"], (F.col("i") + 1).cast("int")).cast("int")
    shard = F.flatten(F.transform("shards", lambda s: F.array_repeat(s["shard"].cast("int"), quota(s))))
    dealt = sources.join(F.broadcast(shards)).withColumn("of", shard)  # one row, of a size that `depth` and the sources give
    placed = F.zip_with("instances", "of", lambda x, s: F.struct(x["r"].alias("repeat"), x["b"].alias("b"), x["part"].alias("part"), s.alias("shard")))
    dealt = dealt.select("_key", "taken1", "open1", "taken2", "open2", "last", F.explode(placed).alias("p"))
    plan = dealt.groupBy("_key", F.col("p.b").alias("_b0")).agg(
        F.array_sort(F.collect_list(F.struct("p.repeat", "p.shard", "p.part"))).alias("draws"),
        F.first(F.when(F.col("p.part"), F.struct("taken1", "open1", "taken2", "open2", "last")), ignorenulls=True).alias("part"),
    )
    return Mix(d, sources.select("_key", "source", "source_size", "target"), scratch.write(plan, "plan"), parts)


def _draws() -> Column:
    """The draws of a document: all of its block's, but of an open block's only if it is chosen."""
    has = lambda name, x: F.coalesce(F.array_contains(F.col(f"part.{name}"), x), F.lit(False))
    same = lambda name, x: F.coalesce(F.col(f"part.{name}") == x, F.lit(False))
    third = has("taken2", F.col("_b2")) | (same("open2", F.col("_b2")) & has("last", F.col("_h")))
    chosen = has("taken1", F.col("_b1")) | (same("open1", F.col("_b1")) & third)
    kept = F.filter("draws", lambda x: ~x["part"] | F.col("_in"))
    return chosen, F.when(F.col("_size") > 0, F.coalesce(kept, F.array())).otherwise(F.array())


def taken(mix: Mix) -> DataFrame:
    """Each row of the documents with source_size, target, taken (words, repeats counted)
    and draws: an array of (repeat, shard, part)."""
    d = mix.documents.join(mix.plan, ["_key", "_b0"], "left")
    d = d.join(mix.sources.select("_key", "source_size", "target"), "_key", "left")
    chosen, draws = _draws()
    d = d.withColumn("_in", chosen).withColumn("draws", draws)
    return d.withColumn("taken", F.col("_size") * F.size("draws"))


def mixed(mix: Mix, columns: list[str], seed: int = 17) -> DataFrame:
    """The mix itself: one row for each drawn copy of a document, with _shard, _part (of
    the shard, by a hash) and _place, a hash by which a part's rows are shuffled."""
    rows = taken(mix).select(*[F.col(f"`{c}`") for c in columns], "_h", F.explode("draws").alias("_x"))
    place = F.xxhash64(F.lit(seed + 5), "_h", "_x.repeat")
    part = F.pmod(F.xxhash64(F.lit(seed + 6), "_h", "_x.repeat"), F.lit(mix.parts)).cast("int")
    return rows.select(*[F.col(f"`{c}`") for c in columns], F.col("_x.shard").alias("_shard"), part.alias("_part"), place.alias("_place"))
