"""N-gram Jaccard join by grouped prefixes.

A document's set holds the distinct hashes of its word shingles.  All sets are ordered
alike: by how often a shingle occurs in the corpus (as a sketch of fixed size counts
it), then by hash.  Two sets that are similar enough share a shingle among the first
n - ceil(t * n) + 1 of each, their prefixes.

1. Equal sets form a class, and classes with the same size and prefix form a group.
   Only groups enter the join of prefixes.
2. Star round: in each list of groups that share a prefix shingle, all are compared
   with one leader, that for which the shingle comes first.  Pairs of groups that
   pass the size and position filters are expand into pairs of members and verified.
3. Rest round: the remaining pairs of a list are compared, but only between members
   that the star round did not already put into one component.  No link between
   components is lost, and a large group of near copies never becomes all its pairs.
4. Components of the verified links.

Only hashes are kept between steps; the sets of candidates are taken from the texts
again.  Joins on a shingle, a group or a class have plain exchanges on both sides, so
that adaptive execution can split a hot key; whatever is counted by key is summed
before the shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelake.llm import kernels
from tidelake.llm.components import connected_components
from tidelake.session import Scratch, release

#: The sketch has a slot for about every SLOT_BYTES bytes of text, 2**20 to 2**24 of them.
SLOT_BYTES = 1 << 10
LEAST_BITS, MOST_BITS = 20, 24
BITMAP = 1024
_U = np.uint64


def _shingle_rows(column: pa.Array, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end, distinct hashes, row number in the slice), slice by slice."""
    data, offsets = kernels.string_buffers(column)
    for i, j in kernels.slices(offsets):
        h, bounds = kernels.words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        yield (i, j, *kernels.distinct(*kernels.shingles(h, bounds, width)))


def frequency_levels(documents: DataFrame, width: int) -> np.ndarray:
    """How often shingles of each sketch slot occur in all texts, as a base-2 logarithm of
    what a slot has above the median slot.

    The sketch grows with the corpus until its levels are 16 MB (a byte for each slot), which
    is what each task gets.  Every shingle of every text counts, however the texts are dealt
    to tasks.  The median is what shingles that do not
    recur put into each slot of a large corpus; without it they would blur the levels."""

    size = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(1, size / SLOT_BYTES)))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int64)
        for batch in batches:
            data, offsets = kernels.string_buffers(batch.column(0))
            for i, j in kernels.slices(offsets):
                h, bounds = kernels.words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                np.add.at(total, (kernels.shingles(h, bounds, width)[0] >> _U(64 - bits)).astype(np.int64), 1)
        slot = np.flatnonzero(total)
        kernels.tidy()
        yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(total[slot])], ["slot", "n"])

    counted = documents.select("text").mapInArrow(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    table = counted.toArrow()  # one row for each slot at most
    n = np.zeros(1 << bits, np.int64)
    n[table.column("slot").to_numpy()] = table.column("n").to_numpy()
    above = n - int(np.median(n))
    levels = np.zeros(1 << bits, np.uint8)
    levels[above > 0] = np.log2(above[above > 0]).astype(np.uint8) + 1
    return levels


def prefixes(documents: DataFrame, width: int, percent: int, levels: np.ndarray) -> DataFrame:
    """(doc_id, rk, n, s1, s2, prefix, bits): rk identifies the text, s1 and s2 the set;
    bits has a bit set for the hash of each element."""

    shift = _U(64 - int(math.log2(len(levels))))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, h, owner in _shingle_rows(batch.column("text"), width):
                n = np.bincount(owner, minlength=j - i)
                level = levels[(h >> shift).astype(np.int64)]
                order = np.lexsort((h, level, owner))
                first = np.append(0, np.cumsum(n))
                keep = n - -(-n * percent // 100) + 1
                keep[n == 0] = 0
                place = np.arange(len(h)) - np.repeat(first[:-1], n)
                prefix = h[order][place < np.repeat(keep, n)]
                sums = []
                for salt in (0x2545F4914F6CDD1D, 0x9E6C63D0676A9A99):
                    running = np.zeros(len(h) + 1, np.uint64)
                    np.cumsum(kernels.mix(h ^ _U(salt)), out=running[1:])
                    sums.append(pa.array((running[first[1:]] - running[first[:-1]]).view(np.int64)))
                cuts = np.append(0, np.cumsum(keep)).astype(np.int32)
                marks = np.zeros((j - i, BITMAP), dtype=bool)
                marks[owner, (h & _U(BITMAP - 1)).astype(np.int64)] = True
                bits = pa.array(np.packbits(marks).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id")[i:j],
                        batch.column("rk")[i:j],
                        pa.array(n.astype(np.int64)),
                        *sums,
                        pa.ListArray.from_arrays(cuts, pa.array(prefix.view(np.int64))),
                        pa.FixedSizeListArray.from_arrays(bits, BITMAP // 64).cast(pa.list_(pa.int64())),
                    ],
                    ["doc_id", "rk", "n", "s1", "s2", "prefix", "bits"],
                )
        kernels.tidy()

    kind = documents.schema["doc_id"].dataType.simpleString()
    source = documents.select("doc_id", "text", text_key().alias("rk"))
    return source.mapInArrow(extract, f"doc_id {kind}, rk long, n long, s1 long, s2 long, prefix array<long>, bits array<long>")


def text_key() -> Column:
    """What identifies a text in these steps: its 64-bit hash."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def _fits(percent: int, n: str, i: str, m: str, j: str) -> Column:
    """Sizes n, m and places i, j of a shared shingle allow the needed overlap, if it is the first shared one."""
    n, i, m, j = F.col(n), F.col(i), F.col(m), F.col(j)
    most = 1 + F.least(n - i - 1, m - j - 1)
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (most * (100 + percent) >= (n + m) * percent)


def _possible(percent: int) -> Column:
    """The bitmaps allow the needed overlap: a bit that one set alone has is an element that
    the other lacks."""
    alone = lambda x, y: F.aggregate(
        F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q)))), F.lit(0), lambda s, c: s + c
    )
    most = F.least(F.col("na") - alone("ba", "bb"), F.col("nb") - alone("bb", "ba"))
    return most * (100 + percent) >= (F.col("na") + F.col("nb")) * percent


def _verify(candidates: DataFrame, documents: DataFrame, members: DataFrame, width: int, percent: int, scratch: Scratch, name: str) -> DataFrame:
    """The pairs (a, b) of classes whose sets are similar enough."""
    candidates = scratch.write(candidates.distinct(), f"{name}-offered")
    side = lambda x: members.select(F.col("cid").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"b{x}"))
    candidates = candidates.join(side("a"), "a").join(side("b"), "b").where(_possible(percent)).select("a", "b")
    candidates = scratch.write(candidates, f"{name}-candidates")
    ids = candidates.select(F.col("a").alias("cid")).unionByName(candidates.select(F.col("b").alias("cid"))).distinct()
    needed = members.join(scratch.write(ids, f"{name}-ids"), "cid", "left_semi").select("cid", "rk", F.col("low").alias("doc_id"))
    needed = scratch.write(needed, f"{name}-needed")
    release(scratch)
    same = documents["doc_id"].eqNullSafe(needed["doc_id"]) & (text_key() == needed["rk"])
    # Merged at every size: what is needed grows with the corpus, and a broadcast would not.
    texts = documents.select("doc_id", "text").join(needed.hint("merge"), same).select("cid", "text")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, h, owner in _shingle_rows(batch.column("text"), width):
                cuts = np.searchsorted(owner, np.arange(j - i + 1)).astype(np.int32)
                sets = pa.ListArray.from_arrays(cuts, pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("cid")[i:j], sets], ["cid", "elements"])
        kernels.tidy()

    sets = scratch.write(texts.mapInArrow(extract, "cid long, elements array<long>"), f"{name}-sets")
    release(scratch)
    if sets.count() > needed.count():  # rows that repeat a doc_id and its text
        sets = scratch.write(sets.groupBy("cid").agg(F.first("elements").alias("elements")), f"{name}-once")
    pairs = candidates.join(sets.select(F.col("cid").alias("a"), F.col("elements").alias("ea")), "a")
    pairs = pairs.join(sets.select(F.col("cid").alias("b"), F.col("elements").alias("eb")), "b")
    both = F.size(F.array_intersect("ea", "eb"))
    pairs = pairs.where(both * (100 + percent) >= (F.size("ea") + F.size("eb")) * percent).select("a", "b")
    links = scratch.write(pairs, f"{name}-links")
    scratch.drop(*[f"{name}-{t}" for t in ("sets", "once", "needed", "ids", "candidates", "offered")])
    release(scratch)
    return links


def link_components(documents: DataFrame, scratch: Scratch, width: int = 5, percent: int = 80, keyed: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of `documents`.

    Two documents link when 100 * |intersection| >= percent * |union|.  A text without
    words (null and empty too) has an empty set and links with nothing; one with fewer
    than `width` words has its whole sequence as one shingle.  component_id is the
    smallest doc_id reachable, null where no document reached has an id.  Repeated rows
    link as any copies do.  Other columns of the input are not looked at.  With `keyed` there
    are also rk, the text's text_key, and component, which identifies the component even
    without ids and is null for an empty set."""
    kernels.small_batches(documents)
    levels = frequency_levels(documents, width)
    rows = prefixes(documents, width, percent, levels)
    rows = rows.withColumn("cid", F.xxhash64("n", "s1", "s2")).withColumn("gid", F.xxhash64("n", "prefix"))
    rows = scratch.write(rows.select("doc_id", "rk", "n", "cid", "gid", "prefix", "bits"), "rows")
    some = rows.where("n > 0")
    low = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rk")).alias("x")
    members = some.groupBy("cid", "gid", "n").agg(low, F.first("bits").alias("bits"))
    members = scratch.write(members.select("cid", "gid", "n", F.col("x.doc_id").alias("low"), F.col("x.rk").alias("rk"), "bits"), "members")
    groups = some.groupBy("gid").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.min("cid").alias("lead"), F.max("cid").alias("other"))
    groups = scratch.write(groups, "groups")
    rows = scratch.write(rows.select("doc_id", "rk", "n", "cid") if keyed else rows.select("doc_id", "n", "cid"), "slim")
    scratch.drop("rows")
    release(scratch)
    postings = groups.select("gid", "n", F.posexplode("prefix").alias("pos", "token"))
    tokens = postings.groupBy("token").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("pos", "n", "gid")).alias("first"))
    tokens = scratch.write(tokens.where("c > 1").select("token", F.col("first.gid").alias("lgid"), F.col("first.n").alias("ln"), F.col("first.pos").alias("lpos")), "tokens")
    listed = scratch.write(postings.join(tokens, "token"), "listed")
    groups = scratch.write(groups.drop("prefix"), "leads")
    scratch.drop("groups", "tokens")
    release(scratch)

    # Star round.
    star = listed.where("gid <> lgid").where(_fits(percent, "n", "pos", "ln", "lpos")).select(F.col("gid").alias("x"), F.col("lgid").alias("y"))
    star = star.distinct().unionByName(groups.where("lead <> other").select(F.col("gid").alias("x"), F.col("gid").alias("y")))
    star = scratch.write(star, "star")
    slim = members.select("gid", "cid")
    pairs = star.join(slim.select(F.col("gid").alias("x"), F.col("cid").alias("a")), "x")
    pairs = pairs.join(groups.select(F.col("gid").alias("y"), F.col("lead").alias("b")), "y").where("a <> b")
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    links = _verify(pairs, documents, members, width, percent, scratch, "star")
    found = connected_components(links, scratch, "star-components")

    # Rest round: only between components.
    placed = members.join(found, members["cid"] == found["id"], "left")
    placed = scratch.write(placed.select("cid", "gid", "n", "low", F.coalesce("component", "cid").alias("comp")), "placed")
    spans = scratch.write(placed.groupBy("gid").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")), "spans")
    open_lists = listed.select("token", "gid", "n", "pos").join(spans, "gid")
    open_lists = scratch.write(open_lists, "open-lists")
    divided = scratch.write(open_lists.groupBy("token").agg(F.min("lo").alias("l"), F.max("hi").alias("h")).where("l < h").select("token"), "divided")
    open_lists = scratch.write(open_lists.join(divided, "token", "left_semi"), "divided-lists")
    # Lists are divided by size: similar sets are in the same band or in bands side by side.
    band = F.floor(F.log("n") / math.log(100 / percent)) if percent < 100 else F.col("n")
    open_lists = open_lists.withColumn("band", band.cast("long"))
    beside = F.explode(F.array(*[F.col("band") + k for k in ((-1, 0, 1) if percent < 100 else (0,))])).alias("band")
    left = open_lists.select("token", "band", *[F.col(c).alias(f"{c}_x") for c in ("gid", "n", "pos", "lo", "hi")])
    right = open_lists.select("token", beside, *[F.col(c).alias(f"{c}_y") for c in ("gid", "n", "pos", "lo", "hi")])
    settled = F.expr("lo_x = hi_x and lo_y = hi_y and lo_x = lo_y")
    rest = left.join(right, (left["token"] == right["token"]) & (left["band"] == right["band"]) & F.expr("gid_x < gid_y") & ~settled & _fits(percent, "n_x", "pos_x", "n_y", "pos_y"))
    rest = rest.select(F.col("gid_x").alias("x"), F.col("gid_y").alias("y")).distinct()
    rest = scratch.write(rest.unionByName(spans.where("lo < hi").select(F.col("gid").alias("x"), F.col("gid").alias("y"))), "rest")
    scratch.drop("listed", "open-lists", "divided", "divided-lists", "star")
    release(scratch)
    slim = placed.select("gid", "cid", "comp")
    pairs = rest.join(slim.select(F.col("gid").alias("x"), F.col("cid").alias("a"), F.col("comp").alias("ca")), "x")
    pairs = pairs.join(slim.select(F.col("gid").alias("y"), F.col("cid").alias("b"), F.col("comp").alias("cb")), "y")
    pairs = pairs.where("ca <> cb").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = _verify(pairs, documents, members, width, percent, scratch, "rest")
    found = connected_components(links.unionByName(more), scratch, "components")

    # The smallest id of each component, back to every row.
    placed = members.join(found, members["cid"] == found["id"], "left").select("cid", "low", F.coalesce("component", "cid").alias("comp"))
    placed = scratch.write(placed, "final")
    lows = scratch.write(placed.groupBy("comp").agg(F.min("low").alias("component_id")), "lows")
    named = placed.select("cid", "comp").join(lows, "comp").withColumnRenamed("comp", "component")
    out = ["doc_id", "n_shingles", "component_id", *(["rk", "component"] if keyed else [])]
    named = scratch.write(named.select("cid", *[c for c in out if c.startswith("component")]), "named")
    slim = rows.withColumnRenamed("n", "n_shingles").withColumn("cid", F.when(F.col("n_shingles") > 0, F.col("cid")))
    alone = slim.where("cid is null").withColumn("component_id", F.col("doc_id")).withColumn("component", F.lit(None).cast("long"))
    return slim.where("cid is not null").join(named, "cid").select(*out).unionByName(alone.select(*out))
