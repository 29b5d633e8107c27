"""Removal of repeated passages by prefix-free parsing and suffix order.

A byte is repeated if some string of `length` bytes covers it that also starts
anywhere else, in the same text or another; no string crosses the end of a text.

The corpus is first dealt out, so that tasks can order suffixes without one another.  The
trigger of a string is the least rolling hash of `GRAM` bytes among its first places, so
equal strings have equal triggers and all starts that have one trigger form a zone.

1. A trigger's own context, the bytes from it on that all strings of its zone share, is
   counted over the corpus.  Where it occurs once, nothing in the zone is repeated.
2. The whole text under a zone, with its place relative to the trigger.  Where it
   occurs twice, the whole zone is repeated; one occurrence stands for all equal ones
   from here on.
3. What is left are contexts with different zones, the edges of repeats.  A task takes
   whole contexts and orders the suffixes of their texts (`prefixfree`: dictionary and
   parse, a suffix array of each, and the two combined); a start is repeated if a
   neighbour in this order shares `length` bytes.
4. A context with over `FAMILY` different zones is not for one task.  Its zones are cut
   into steps of 16 starts, which spread over tasks as their own hashes do: the part that
   all strings of a step share, then the step's whole text, and only where these leave it
   open each start's own string.

Comparisons between tasks are of 64-bit hashes inside groups of equal 64-bit hashes.
Counting is by partial sums, so a passage in every text costs each task one row.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelake.llm.kernels import mix, slices, small_batches, string_buffers, tidy
from tidelake.llm.prefixfree import Hashes, repeated
from tidelake.session import Scratch, release

GRAM = 24
SPAN = 256
MINIMUM = 64
#: Bytes of a passage of about fifty words, shorter than a string that op5 removes.
PASSAGE = 280
STEP = 16
#: A context with more different zones is settled by strings' hashes, not in one task.
FAMILY = 2048
_PIECE = 1 << 18
_U = np.uint64
_LOW = _U((1 << 24) - 1)


def span_of(length: int) -> int:
    """Places among which the trigger of a string of `length` bytes is looked for; the rest
    of the string, at least `GRAM` bytes, is the trigger's context."""
    if length < MINIMUM:
        raise ValueError(f"length {length} is below {MINIMUM}")
    return min(SPAN, length - max(GRAM, length * 3 // 8))


def _least(v: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every `width` neighbours, by running minima of blocks."""
    n = len(v) - width + 1
    padded = np.full(-(-len(v) // width) * width, ~_U(0))
    padded[: len(v)] = v
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def _pieces(offsets: np.ndarray, extra: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(row i, row j, first byte, end, byte in the text): whole texts of about 256 KB
    together, or 256 KB of a longer text and `extra` bytes more."""
    for i, j in slices(offsets, _PIECE):
        a, b = int(offsets[i]), int(offsets[j])
        if j == i + 1 and b - a > 2 * _PIECE:
            for s in range(a, b, _PIECE):
                yield i, j, s, min(s + _PIECE + extra, b), s - a
        else:
            yield i, j, a, b, 0


def _zones(data: np.ndarray, offsets: np.ndarray, length: int):
    """(text number, trigger, first and last start, context hash, zone hash) of the zones."""
    room = np.maximum(np.diff(offsets) - length + 1, 0)
    total = int(room.sum())
    if not total:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.view(np.uint64), none.view(np.uint64)
    hashes = Hashes(data)
    places = np.arange(len(data) - GRAM + 1)
    gram = (hashes.of(places, places + GRAM) & ~_LOW) | places.astype(np.uint64)
    span = span_of(length)
    trigger = (_least(gram, span) & _LOW).astype(np.int64)
    skipped = offsets[:-1] - np.append(0, np.cumsum(room)[:-1])
    starts = np.arange(total) + np.repeat(skipped, room)
    text = np.repeat(np.arange(len(room)), room)
    trigger = trigger[starts]
    new = np.ones(total, dtype=bool)
    new[1:] = (trigger[1:] != trigger[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    first, last, trigger, text = starts[at], starts[np.append(at[1:], total) - 1], trigger[at], text[at]
    context = hashes.of(trigger, trigger + (length - span))
    zone = hashes.of(first, last + length) + mix(((trigger - first) << 20 | (last - first)).astype(np.uint64))
    return text, trigger, first, last, context, zone


def _text_keys() -> list[Column]:
    text = F.coalesce(F.col("text"), F.lit(""))
    return [F.xxhash64(text).alias("_tk"), F.xxhash64(F.lit(7), text).alias("_tl")]


def _candidates(spans: pa.Array, shorter: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) place of each run of starts of longer strings that the spans of starts
    of strings `shorter` bytes shorter leave possible, as row * 2**32 + place."""
    lo, hi = (spans.values.field(f).to_numpy().astype(np.int64) for f in ("lo", "hi"))
    ends = np.asarray(spans.offsets)
    first, last = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in range(rows):
        begin, end = _merge(np.stack([lo[ends[k] : ends[k + 1]], hi[ends[k] : ends[k + 1]]], axis=1), 1)
        long = end - begin > shorter
        first.append(begin[long] + (k << 32))
        last.append(end[long] - 1 - shorter + (k << 32))
    return np.concatenate(first), np.concatenate(last)


def zones(documents: DataFrame, length: int, passage: int | None = None) -> DataFrame:
    """(_tk, _tl, a, lo, hi, k1, k2): every zone of every text, places in bytes.  With
    `passage`, those with starts that the column _short, the spans of repeated strings of
    `passage` bytes, leaves possible: a longer string repeats only where all of its parts do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = string_buffers(batch.column("text"))
            keys = [batch.column(c).to_numpy() for c in ("_tk", "_tl")]
            possible = _candidates(batch.column("_short"), length - passage, len(batch)) if passage else None
            for i, j, a, b, shift in _pieces(offsets, length - 1):
                own = offsets[i : j + 1] - a if j > i + 1 else np.array([0, b - a])
                found = _zones(data[a:b], own, length)
                if possible:
                    at = (found[0] + i << 32) - own[found[0]] + shift
                    run = np.searchsorted(possible[1], found[2] + at)
                    inside = run < len(possible[0])
                    inside[inside] = possible[0][run[inside]] <= (found[3] + at)[inside]
                    found = [x[inside] for x in found]
                text, trigger, first, last, context, zone = found
                base = own[text] - shift
                yield pa.RecordBatch.from_arrays(
                    [
                        *[pa.array(k[i:j][text]) for k in keys],
                        *[pa.array((x - base).astype(np.int32)) for x in (trigger, first, last)],
                        pa.array(context.view(np.int64)),
                        pa.array(zone.view(np.int64)),
                    ],
                    ["_tk", "_tl", "a", "lo", "hi", "k1", "k2"],
                )
        tidy()

    schema = "_tk long, _tl long, a int, lo int, hi int, k1 long, k2 long"
    return documents.select("text", *_text_keys(), *(["_short"] if passage else [])).mapInArrow(run, schema)


def _steps(texts: DataFrame, length: int) -> DataFrame:
    """From texts with an array `zs` of zones (a, lo, hi, w) to their steps:
    (core, whole, w, _tk, _tl, lo, hi, starts), starts being the hash of each start's string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = string_buffers(batch.column("text"))
            keys = [batch.column(c).to_numpy() for c in ("_tk", "_tl")]
            listed = batch.column("zs")
            parts, ends = listed.values, np.asarray(listed.offsets)
            zone = {f: parts.field(f).to_numpy() for f in ("a", "lo", "hi", "w")}
            for i, j, a, b, shift in _pieces(offsets, length + 2 * SPAN):
                got = np.arange(ends[i], ends[j])
                row = np.repeat(np.arange(i, j), np.diff(ends[i : j + 1]))
                if j == i + 1 and offsets[j] - offsets[i] > 2 * _PIECE:
                    inside = (zone["lo"][got] >= shift) & (zone["lo"][got] < shift + _PIECE)
                    got, row = got[inside], row[inside]
                if not len(got):
                    continue
                base = offsets[row] - a
                trigger, lo, hi, w = (zone[f][got].astype(np.int64) for f in ("a", "lo", "hi", "w"))
                hashes = Hashes(data[a:b])
                low, high = (trigger - hi) // STEP, (trigger - lo) // STEP
                many = high - low + 1
                of = np.repeat(np.arange(len(got)), many)
                q = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many) + low[of]
                trigger, lo, hi, base, row, w = (x[of] for x in (trigger, lo, hi, base, row, w))
                begin, end = np.maximum(lo, trigger - STEP * q - STEP + 1), np.minimum(hi, trigger - STEP * q)
                near = trigger - STEP * q + base
                core = hashes.of(near, near + length - STEP + 1) + mix(q.astype(np.uint64) + _U(1))
                whole = hashes.of(begin + base, end + length + base) + mix(
                    ((trigger - begin) << 20 | (end - begin)).astype(np.uint64)
                )
                count = end - begin + 1
                each = np.repeat(begin + base, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
                salt = (np.repeat(trigger + base, count) - each).astype(np.uint64)
                own = hashes.of(each, each + length) + mix(salt + _U(1 << 32))
                cuts = np.append(0, np.cumsum(count)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(core.view(np.int64)),
                        pa.array(whole.view(np.int64)),
                        pa.array(w.astype(np.int32)),
                        *[pa.array(k[row]) for k in keys],
                        *[pa.array(x.astype(np.int32)) for x in (begin, end)],
                        pa.ListArray.from_arrays(cuts, pa.array(own.view(np.int64))),
                    ],
                    ["core", "whole", "w", "_tk", "_tl", "lo", "hi", "starts"],
                )
        tidy()

    schema = "core long, whole long, w int, _tk long, _tl long, lo int, hi int, starts array<long>"
    return texts.mapInArrow(run, schema)


def _segments(texts: DataFrame, length: int) -> DataFrame:
    """From texts with an array `zs` of zones (k1, lo, hi) to the bytes under each zone:
    (k1, _tk, _tl, lo, n, bytes), n being the zone's number of starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = string_buffers(batch.column("text"))
            listed = batch.column("zs")
            ends = np.asarray(listed.offsets)
            row = np.repeat(np.arange(len(batch)), np.diff(ends))
            zone = {f: listed.values.field(f).to_numpy()[ends[0] : ends[-1]] for f in ("k1", "lo", "hi")}
            keys = [batch.column(c).to_numpy()[row] for c in ("_tk", "_tl")]
            begin = offsets[row] + zone["lo"]
            size = zone["hi"] - zone["lo"] + length
            for i, j in slices(np.append(0, np.cumsum(size)).astype(np.int64), _PIECE):
                parts = [data[b : b + n].tobytes() for b, n in zip(begin[i:j], size[i:j], strict=True)]
                starts = (size[i:j] - length + 1).astype(np.int32)
                columns = [zone["k1"][i:j], *[k[i:j] for k in keys], zone["lo"][i:j].astype(np.int32), starts]
                yield pa.RecordBatch.from_arrays(
                    [*map(pa.array, columns), pa.array(parts, pa.binary())], ["k1", "_tk", "_tl", "lo", "n", "bytes"]
                )
        tidy()

    return texts.mapInArrow(run, "k1 long, _tk long, _tl long, lo int, n int, bytes binary")


def _ordered(segments: DataFrame, length: int) -> DataFrame:
    """(_tk, _tl, lo, hi): runs of starts whose strings a neighbour in suffix order shares.
    A task takes whole contexts, about 256 KB of segments together."""

    def runs(table: pa.Table) -> pa.RecordBatch:
        parts = table.column("bytes").combine_chunks().cast(pa.large_binary())
        _, ends, raw = parts.buffers()
        ends = np.frombuffer(ends, np.int64)[parts.offset : parts.offset + len(parts) + 1]
        data = np.frombuffer(raw, np.uint8)[ends[0] : ends[-1]]
        offsets = ends - ends[0]
        n = table.column("n").to_numpy().astype(np.int64)
        first = np.append(0, np.cumsum(n))
        segment = np.repeat(np.arange(len(n)), n)
        inside = np.arange(first[-1]) - first[segment]
        found = repeated(data, offsets, offsets[segment] + inside, length)
        begins, stops = found.copy(), found.copy()
        begins[1:] &= ~found[:-1] | (segment[1:] != segment[:-1])
        stops[:-1] &= ~found[1:] | (segment[1:] != segment[:-1])
        begins, stops = np.flatnonzero(begins), np.flatnonzero(stops)
        of = segment[begins]
        lo = table.column("lo").to_numpy()[of]
        keys = [pa.array(table.column(c).to_numpy()[of]) for c in ("_tk", "_tl")]
        places = [pa.array((lo + inside[x]).astype(np.int32)) for x in (begins, stops)]
        return pa.RecordBatch.from_arrays([*keys, *places], ["_tk", "_tl", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            while len(batch):
                size = sum(b.column("bytes").nbytes for b in held)
                if size >= _PIECE and held[-1].column("k1")[-1] != batch.column("k1")[0]:
                    yield runs(pa.Table.from_batches(held))
                    held, size = [], 0
                k = batch.column("k1").to_numpy()
                room = np.searchsorted(np.cumsum(pc.binary_length(batch.column("bytes")).to_numpy()), max(_PIECE - size, 1))
                cuts = np.flatnonzero(k[1:] != k[:-1]) + 1
                later = cuts[cuts >= room]
                cut = int(later[0]) if len(later) else len(batch)
                held.append(batch.slice(0, cut))
                batch = batch.slice(cut)
                if len(batch):
                    yield runs(pa.Table.from_batches(held))
                    held = []
        if held:
            yield runs(pa.Table.from_batches(held))
        tidy()

    dealt = segments.repartition("k1").sortWithinPartitions("k1")
    return dealt.mapInArrow(run, "_tk long, _tl long, lo int, hi int")


def _by_strings(texts: DataFrame, edges: DataFrame, scratch: Scratch, length: int) -> list[DataFrame]:
    """Spans of repeated starts of zones whose contexts have too many different zones for
    one task: by hashes of steps, and of strings where these leave a step open."""
    steps = scratch.write(_steps(texts.join(edges, ["_tk", "_tl"]), length), "steps")
    release(scratch)
    at = F.struct("_tk", "_tl", "lo")
    kinds = steps.groupBy("core", "whole").agg(
        F.max("w").alias("w"), F.min(at).alias("one"), F.max(at).alias("other"), F.first("starts").alias("starts")
    )
    weight = F.when((F.col("w") > 1) | (F.col("one") != F.col("other")), 2).otherwise(1).alias("w")
    kinds = scratch.write(kinds.select("core", "whole", weight, "one", "starts"), "step-kinds")
    places = steps.select("core", "whole", "_tk", "_tl", "lo", "hi")  # without the hashes of the starts
    more = places.join(kinds.where("w > 1").select("core", "whole"), ["core", "whole"], "left_semi")
    more = scratch.write(more.select("_tk", "_tl", "lo", "hi").distinct(), "more")
    open_cores = kinds.groupBy("core").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("core")
    open_cores = scratch.write(open_cores, "open-cores")
    fine = kinds.join(open_cores, "core", "left_semi").select("core", "w", "one", F.posexplode("starts").alias("k", "h"))
    fine = scratch.write(fine, "fine")
    same = fine.groupBy("core", "h").agg(F.sum("w").alias("n")).where("n > 1").select("core", "h")
    same = scratch.write(same, "same")
    last = fine.where("w = 1").join(same, ["core", "h"], "left_semi")
    start = (F.col("one.lo") + F.col("k")).cast("int")
    last = last.select("one._tk", "one._tl", start.alias("lo"), start.alias("hi"))
    last = scratch.write(last, "last")
    scratch.drop("steps", "step-kinds", "open-cores", "fine", "same")
    release(scratch)
    return [more, last]


def repeated_starts(documents: DataFrame, scratch: Scratch, length: int = 400, passage: int | None = None) -> DataFrame:
    """(_tk, _tl, spans): for each text with repeats, spans (lo, hi) of the starts of
    its repeated strings, as offsets in bytes.  `passage`: as for zones()."""
    every = scratch.write(zones(documents, length, passage), "zones")
    twice = every.groupBy("k1").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("k1")
    twice = scratch.write(twice, "contexts")
    shared = scratch.write(every.join(twice, "k1", "left_semi"), "shared")
    scratch.drop("zones", "contexts")
    release(scratch)

    one = F.min(F.struct("_tk", "_tl", "a", "lo", "hi")).alias("one")
    kinds = scratch.write(shared.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"), one), "kinds")
    whole = shared.join(kinds.where("n > 1").select("k1", "k2"), ["k1", "k2"], "left_semi")
    found = [scratch.write(whole.select("_tk", "_tl", "lo", "hi").distinct(), "whole")]
    contexts = kinds.groupBy("k1").agg(F.count(F.lit(1)).alias("m"), F.min("n").alias("n")).where("m > 1 and n = 1")
    contexts = scratch.write(contexts.select("k1", (F.col("m") > FAMILY).alias("large")), "open-contexts")
    weight = F.least("n", F.lit(2)).cast("int").alias("w")
    edges = kinds.join(contexts, "k1").select("large", "one._tk", "one._tl", F.struct("k1", "one.a", "one.lo", "one.hi", weight).alias("z"))
    edges = scratch.write(edges.groupBy("large", "_tk", "_tl").agg(F.collect_list("z").alias("zs")), "edges")
    scratch.drop("shared", "kinds", "open-contexts")
    release(scratch)

    texts = documents.select("text", *_text_keys()).dropDuplicates(["_tk", "_tl"])
    small = texts.join(edges.where("not large").drop("large"), ["_tk", "_tl"])
    segments = scratch.write(_segments(small, length), "segments")
    release(scratch)
    found.append(scratch.write(_ordered(segments, length), "ordered"))
    scratch.drop("segments")
    if not (large := edges.where("large").drop("large")).isEmpty():
        found += _by_strings(texts, large, scratch, length)
    spans = functools.reduce(DataFrame.unionByName, found).groupBy("_tk", "_tl")
    spans = scratch.write(spans.agg(F.collect_list(F.struct("lo", "hi")).alias("_spans")), "spans")
    scratch.drop("whole", "ordered", "more", "last", "edges")
    release(scratch)
    return spans


def _merge(spans: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Spans of starts (lo, hi) as the disjoint, separate byte runs [begin, end) under their strings."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1] + length)
    new = np.ones(len(spans), dtype=bool)
    new[1:] = spans[1:, 0] > reach[:-1]
    at = np.flatnonzero(new)
    return spans[at, 0], reach[np.append(at[1:], len(spans)) - 1]


def deduplicate(
    documents: DataFrame, scratch: Scratch, length: int = 400, as_text: bool = False, passage: int | None = None
) -> DataFrame:
    """The rows of `documents` with `kept` (binary: the bytes that stay, joined),
    n_bytes, n_removed and n_spans (maximal removed runs).  With `as_text` the bytes that
    stay take the place of `text` instead, without characters that a cut has broken.
    With `passage` (at most `length`) n_passage_bytes is added: the bytes under repeated
    strings of `passage` bytes, which are not removed for that.

    A null text counts as empty; texts of fewer than `length` bytes lose nothing; of
    equal texts of at least `length` bytes all lose everything, repeated rows too.
    Input columns named like an added one are replaced.  `length` and `passage` are
    at least `MINIMUM`."""
    if passage is not None and passage > length:
        raise ValueError(f"passage {passage} is above length {length}")
    small_batches(documents)
    added = ("kept", "n_bytes", "n_removed", "n_spans", *(["n_passage_bytes"] if passage else []))
    columns = [c for c in documents.columns if c.lower() not in added]
    source = documents.select(*[F.col(f"`{c}`") for c in columns], *_text_keys())
    if passage:
        short = repeated_starts(documents, Scratch(scratch.spark, "passages"), passage).withColumnRenamed("_spans", "_short")
        some = source.select("text", "_tk", "_tl").join(short, ["_tk", "_tl"])
        spans = short.join(repeated_starts(some, scratch, length, passage), ["_tk", "_tl"], "left")
        spans = scratch.write(spans, "both")
    else:
        spans = repeated_starts(documents, scratch, length)
    source = source.join(spans, ["_tk", "_tl"], "left").drop("_tk", "_tl")

    from pyspark.sql.types import BinaryType, LongType, StructType

    schema = StructType([f for f in source.schema.fields if f.name not in ("_spans", "_short")])
    schema = schema if as_text else schema.add("kept", BinaryType())
    for c in added[1:]:
        schema = schema.add(c, LongType())

    def runs_of(column: pa.Array, n: int) -> list[tuple[np.ndarray, np.ndarray] | None]:
        lo, hi = (column.values.field(f).to_numpy().astype(np.int64) for f in ("lo", "hi"))
        ends, empty = np.asarray(column.offsets), np.asarray(column.is_null())
        each = (slice(ends[k], ends[k + 1]) for k in range(len(column)))
        return [None if e else _merge(np.stack([lo[x], hi[x]], axis=1), n) for x, e in zip(each, empty, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = string_buffers(batch.column("text"))
            kept, removed, runs = [], [], []
            for k, found in enumerate(runs_of(batch.column("_spans"), length)):
                text = data[offsets[k] : offsets[k + 1]].tobytes()
                begin, end = found or (np.zeros(0, np.int64), np.zeros(0, np.int64))
                cuts = zip(np.append(0, end), np.append(begin, len(text)), strict=True)
                kept.append(b"".join(text[a:b] for a, b in cuts))
                removed.append(len(text) - len(kept[-1]))
                runs.append(len(begin))
            texts = pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()) if as_text else None
            counts = [np.diff(offsets), removed, runs]
            if passage:
                counts.append([int((f[1] - f[0]).sum()) if f else 0 for f in runs_of(batch.column("_short"), passage)])
            yield pa.RecordBatch.from_arrays(
                [
                    *[texts if as_text and c == "text" else batch.column(c) for c in columns],
                    *([] if as_text else [pa.array(kept, pa.binary())]),
                    *[pa.array(x, pa.int64()) for x in counts],
                ],
                [*columns, *added[as_text:]],
            )
        tidy()

    return source.mapInArrow(run, schema)
