"""Error-bounded lossy compression of samples, and chunks of coded integers.

A value v becomes the integer q = round(v / 2e), halves away from zero, so that 2e * q is
within e of v; NaN, infinities and end markers go into a side column and take no part in
prediction.  Chunks hold the zigzag form of q's differences in one of several codes.
Merging and re-chunking move q, never the decoded value, so errors do not add up; the
bound is a column, and chunks of different bounds are not merged without quantizing.

Quantizing, predicting and decoding are columns; packing bits is Arrow batches.
"""

from __future__ import annotations

import heapq
import struct
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelake.functions.ieee import INF, NAN, num

NORMAL, STALE, IS_NAN, PLUS_INF, MINUS_INF = range(5)

# -- columns --------------------------------------------------------------------------------


def quantized(v: Column, bound: Column) -> Column:
    return (F.signum(v) * F.floor(F.abs(v) / (bound * 2) + 0.5)).cast("long")


def special(v: Column, stale: Column | None = None) -> Column:
    kind = F.when(F.isnan(v), IS_NAN).when(v == num(INF), PLUS_INF).when(v == num(-INF), MINUS_INF).otherwise(NORMAL)
    return kind if stale is None else F.when(stale, STALE).otherwise(kind)


def zigzag(d: Column) -> Column:
    return F.when(d >= 0, d * 2).otherwise(-d * 2 - 1)


def quantize(samples: DataFrame, bound: float) -> DataFrame:
    """(series_id, ts, q, special, bound); q is null for special values.  Values too large for
    64 bits at this bound fail."""
    if not bound > 0:
        raise ValueError("the error bound must be positive")
    stale = F.col("stale") if "stale" in samples.columns else None
    kind = special(F.col("f"), stale)
    e = num(bound)
    too_large = F.abs(F.col("f")) / (2 * bound) >= 2.0**62
    q = F.when(too_large, F.raise_error(F.lit("value too large for the error bound")).cast("long")).otherwise(quantized(F.col("f"), e))
    return samples.select("series_id", "ts", F.when(kind == NORMAL, q).alias("q"), kind.cast("byte").alias("special"), e.alias("bound"))


def dequantize(rows: DataFrame) -> DataFrame:
    """(series_id, ts, f, stale) from q."""
    f = (
        F.when(F.col("special") == NORMAL, F.col("q") * F.col("bound") * 2).when(F.col("special") == PLUS_INF, num(INF))
        .when(F.col("special") == MINUS_INF, num(-INF)).otherwise(num(NAN))
    )
    return rows.select("series_id", "ts", f.alias("f"), (F.col("special") == STALE).alias("stale"))


def predicted(rows: DataFrame) -> DataFrame:
    """With d, the difference to the last normal q of the series, and its zigzag form z."""
    order = Window.partitionBy("series_id").orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    d = F.col("q") - F.coalesce(F.last("q", ignorenulls=True).over(order), F.lit(0))
    return rows.withColumn("d", d).withColumn("z", zigzag(F.col("d")))


def width_shares(rows: DataFrame) -> DataFrame:
    """(series_id, n, to8, to12): how many differences fit into 8 and 12 bits."""
    z = predicted(rows).where("z is not null")
    return z.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("z") < 1 << 8).cast("int")).alias("to8"), F.avg((F.col("z") < 1 << 12).cast("int")).alias("to12")
    )


# -- codes of unsigned integers -----------------------------------------------------------------


class Bits:
    """Bits appended from the lowest on."""

    def __init__(self) -> None:
        self.parts: list[np.ndarray] = []

    def add(self, values: np.ndarray, widths) -> None:
        widths = np.broadcast_to(np.asarray(widths, np.int64), len(values))
        total = int(widths.sum())
        if total:
            place = np.arange(total) - np.repeat(np.cumsum(widths) - widths, widths)
            self.parts.append(((np.repeat(values.astype(np.uint64), widths) >> place.astype(np.uint64)) & np.uint64(1)).astype(np.uint8))

    def bytes(self) -> bytes:
        return np.packbits(np.concatenate(self.parts), bitorder="little").tobytes() if self.parts else b""


def _unpacked(data: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")


def _integers(bits: np.ndarray, at: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """Integers of given places and widths."""
    out = np.zeros(len(at), np.uint64)
    for k in range(int(widths.max(initial=0))):
        have = widths > k
        out[have] |= bits[at[have] + k].astype(np.uint64) << np.uint64(k)
    return out


def _widths(z: np.ndarray) -> np.ndarray:
    """Bits that each integer needs; 0 for 0."""
    out, rest = np.zeros(len(z), np.int64), z.copy()
    for k in (32, 16, 8, 4, 2, 1):
        large = rest >= np.uint64(1) << np.uint64(k)
        out[large] += k
        rest[large] >>= np.uint64(k)
    return out + (rest > 0)


def varint_encode(z: np.ndarray) -> bytes:
    out = bytearray()
    for v in z.tolist():
        while v >= 128:
            out.append(v & 127 | 128)
            v >>= 7
        out.append(v)
    return bytes(out)


def varint_decode(data: bytes, n: int) -> np.ndarray:
    out, v, shift = [], 0, 0
    for b in data:
        v |= (b & 127) << shift
        shift += 7
        if b < 128:
            out.append(v)
            v = shift = 0
            if len(out) == n:
                break
    return np.array(out, np.uint64)


# How many integers of how many bits a 60-bit payload holds, by selector.
SIMPLE8B = ((240, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))


def simple8b_encode(z: np.ndarray) -> bytes:
    """64-bit words of a 4-bit selector and a payload; the last word may be part empty."""
    widths = _widths(z)
    if widths.max(initial=0) > 60:
        raise ValueError("simple8b holds integers of up to 60 bits")
    values, need, words, at = z.tolist(), widths.tolist(), [], 0
    while at < len(values):
        for selector, (count, width) in enumerate(SIMPLE8B):
            some = need[at : at + count]
            if max(some) <= width and (width or len(some) == count):  # zeros without payload fill whole words only
                word = selector
                for k, v in enumerate(values[at : at + count]):
                    word |= v << (4 + k * width)
                words.append(word)
                at += len(some)
                break
    return np.array(words, np.uint64).tobytes()


def simple8b_decode(data: bytes, n: int) -> np.ndarray:
    words = np.frombuffer(data, np.uint64)
    out: list[np.ndarray] = []
    for word in words:
        count, width = SIMPLE8B[int(word) & 15]
        if not width:
            out.append(np.zeros(count, np.uint64))
        else:
            shifts = np.uint64(4) + np.arange(count, dtype=np.uint64) * np.uint64(width)
            out.append(word >> shifts & np.uint64((1 << width) - 1))
    return np.concatenate(out)[:n] if out else np.zeros(0, np.uint64)


def bitpacking_encode(z: np.ndarray, block: int = 128) -> bytes:
    """Blocks of 128 integers at the width of the largest, in a byte before each block."""
    out = []
    for at in range(0, len(z), block):
        part = z[at : at + block]
        width = int(_widths(part).max())
        bits = Bits()
        bits.add(part, width)
        out.append(bytes([width]) + bits.bytes())
    return b"".join(out)


def bitpacking_decode(data: bytes, n: int, block: int = 128) -> np.ndarray:
    out, at, left = [], 0, n
    while left:
        size, width = min(block, left), data[at]
        length = -(-size * width // 8)
        bits = _unpacked(data[at + 1 : at + 1 + length])
        out.append(_integers(bits, np.arange(size) * width, np.full(size, width)))
        at, left = at + 1 + length, left - size
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def pfor_encode(z: np.ndarray, block: int = 128) -> bytes:
    """Blocks at the width that costs least; what does not fit is patched: its place and high bits."""
    out = []
    for at in range(0, len(z), block):
        part = z[at : at + block]
        need = _widths(part)
        cost = [len(part) * w + int((need > w).sum()) * (8 + 64) for w in range(65)]
        width = int(np.argmin(cost))
        odd = np.flatnonzero(need > width)
        low = part & np.uint64((1 << width) - 1) if width < 64 else part
        bits = Bits()
        bits.add(low, width)
        high = part[odd] >> np.uint64(width) if width < 64 else part[odd]
        out.append(bytes([width, len(odd)]) + odd.astype(np.uint8).tobytes() + high.tobytes() + bits.bytes())
    return b"".join(out)


def pfor_decode(data: bytes, n: int, block: int = 128) -> np.ndarray:
    out, at, left = [], 0, n
    while left:
        size, width, patches = min(block, left), data[at], data[at + 1]
        at += 2
        odd = np.frombuffer(data, np.uint8, patches, at).astype(np.int64)
        high = np.frombuffer(data[at + patches : at + 9 * patches], np.uint64)
        at += 9 * patches
        length = -(-size * width // 8)
        part = _integers(_unpacked(data[at : at + length]), np.arange(size) * width, np.full(size, width))
        part[odd] |= high << np.uint64(width) if width < 64 else high
        out.append(part)
        at, left = at + length, left - size
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _code_lengths(counts: Counter) -> dict[int, int]:
    heap = [(n, k, (s,)) for k, (s, n) in enumerate(sorted(counts.items()))]
    lengths = dict.fromkeys(counts, 0)
    if len(heap) == 1:
        return dict.fromkeys(counts, 1)
    heapq.heapify(heap)
    tick = len(heap)
    while len(heap) > 1:
        n, _, a = heapq.heappop(heap)
        m, _, b = heapq.heappop(heap)
        for s in a + b:
            lengths[s] += 1
        heapq.heappush(heap, (n + m, tick, a + b))
        tick += 1
    return lengths


def _canonical(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """symbol -> (code, length), codes in order of length and symbol."""
    code, last, out = 0, 0, {}
    for s in sorted(lengths, key=lambda s: (lengths[s], s)):
        code <<= lengths[s] - last
        last = lengths[s]
        out[s] = (code, last)
        code += 1
    return out


def huffman_encode(z: np.ndarray) -> bytes:
    """The distinct integers with the lengths of their canonical codes, then the codes."""
    if not len(z):
        return b""
    lengths = _code_lengths(Counter(z.tolist()))
    codes = _canonical(lengths)
    symbols = np.array(sorted(codes), np.uint64)
    table = varint_encode(np.diff(symbols, prepend=np.uint64(0)))
    widths = np.array([codes[s][1] for s in symbols.tolist()])
    reverse = np.array([int(f"{codes[s][0]:0{codes[s][1]}b}"[::-1], 2) for s in symbols.tolist()], object)
    at = np.searchsorted(symbols, z)
    bits = Bits()
    for k in range(0, len(z), 4096):
        some = at[k : k + 4096]
        bits.add(reverse[some].astype(np.uint64), widths[some])
    return struct.pack("<II", len(symbols), len(table)) + table + widths.astype(np.uint8).tobytes() + bits.bytes()


def huffman_decode(data: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.uint64)
    count, size = struct.unpack_from("<II", data)
    symbols = np.cumsum(varint_decode(data[8 : 8 + size], count))
    widths = data[8 + size : 8 + size + count]
    back = {(w, c): s for s, (c, w) in _canonical(dict(zip(symbols.tolist(), widths, strict=True))).items()}
    out, code, width = [], 0, 0
    for bit in _unpacked(data[8 + size + count :]).tolist():
        code, width = code << 1 | bit, width + 1
        s = back.get((width, code))
        if s is not None:
            out.append(s)
            code = width = 0
            if len(out) == n:
                break
    return np.array(out, np.uint64)


def best_widths(need: np.ndarray, most: int = 16) -> tuple[list[int], int]:
    """Up to `most` widths, and the bits that all integers take at the next width and a
    selector for it; by dynamic programming over the histogram of widths."""
    count = np.bincount(need, minlength=65)
    present = [w for w in range(65) if count[w]] or [0]
    total = np.append(0, np.cumsum([count[w] for w in present]))
    best: tuple[int, list[int]] | None = None
    cost = {0: (0, [])}
    for k in range(1, min(most, len(present)) + 1):
        nxt: dict[int, tuple[int, list[int]]] = {}
        for j in range(1, len(present) + 1):
            options = [(c + int(total[j] - total[i]) * present[j - 1], ws + [present[j - 1]]) for i, (c, ws) in cost.items() if i < j]
            if options:
                nxt[j] = min(options)
        cost = nxt
        if len(present) in cost:
            bits, ws = cost[len(present)]
            bits += len(need) * (k - 1).bit_length()
            if best is None or bits < best[0]:
                best = (bits, ws)
    return best[1], best[0]


def simplebits_encode(z: np.ndarray) -> bytes:
    """A selector of one of at most 16 widths for each integer, then the integers."""
    if not len(z):
        return b""
    need = _widths(z)
    widths, _ = best_widths(need)
    chosen = np.searchsorted(widths, need)
    bits = Bits()
    bits.add(chosen, (len(widths) - 1).bit_length())
    bits.add(z, np.array(widths)[chosen])
    return bytes([len(widths), *widths]) + bits.bytes()


def simplebits_decode(data: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.uint64)
    k = data[0]
    widths, bits = np.frombuffer(data, np.uint8, k, 1).astype(np.int64), _unpacked(data[1 + k :])
    size = (k - 1).bit_length()
    chosen = _integers(bits, np.arange(n) * size, np.full(n, size)).astype(np.int64)
    own = widths[chosen]
    return _integers(bits, n * size + np.cumsum(own) - own, own)


CODES = {
    "simple8b": (simple8b_encode, simple8b_decode),
    "huffman": (huffman_encode, huffman_decode),
    "simplebits": (simplebits_encode, simplebits_decode),
    "bitpacking": (bitpacking_encode, bitpacking_decode),
    "varint": (varint_encode, varint_decode),
    "pfor": (pfor_encode, pfor_decode),
}


def choose_code(z: np.ndarray) -> str:
    """Mostly one-byte differences: huffman; mostly short ones: simple8b; else the cheaper of
    the estimates for huffman and simplebits."""
    if not len(z):
        return "varint"
    need = _widths(z)
    to8, to12 = (need <= 8).mean(), (need <= 12).mean()
    if to8 > 0.99:
        return "huffman"
    if to8 > 0.8 and to12 > 0.95 and need.max() <= 60:
        return "simple8b"
    _, n = np.unique(z, return_counts=True)
    entropy = float(-(n * np.log2(n / len(z))).sum()) + len(n) * (8 + need.mean())
    return "huffman" if entropy < best_widths(need)[1] else "simplebits"


def to_zigzag(d: np.ndarray) -> np.ndarray:
    return ((d << 1) ^ (d >> 63)).view(np.uint64)


def from_zigzag(z: np.ndarray) -> np.ndarray:
    return (z >> np.uint64(1)).view(np.int64) ^ -(z & np.uint64(1)).view(np.int64)


# -- piecewise linear segments --------------------------------------------------------------------


def segments(values: np.ndarray, bound: float) -> list[tuple[int, float, float]]:
    """(length, start, slope): the longest runs that a line from the first value keeps within the bound."""
    out, at, n = [], 0, len(values)
    while at < n:
        low, high, k = -np.inf, np.inf, 1
        while at + k < n:
            a, b = (values[at + k] - bound - values[at]) / k, (values[at + k] + bound - values[at]) / k
            if max(low, a) > min(high, b) or not np.isfinite(values[at + k]):
                break
            low, high, k = max(low, a), min(high, b), k + 1
        out.append((k, float(values[at]), 0.0 if k == 1 else float((low + high) / 2)))
        at += k
    return out


def from_segments(parts: list[tuple[int, float, float]]) -> np.ndarray:
    return np.concatenate([start + slope * np.arange(n) for n, start, slope in parts]) if parts else np.zeros(0)


# -- chunks -------------------------------------------------------------------------------------------

_CHUNK = "series_id long, chunk long, mint long, maxt long, n int, bound double, code string, times binary, data binary, specials binary"
_CHUNK_TYPE = pa.schema(
    [("series_id", pa.int64()), ("chunk", pa.int64()), ("mint", pa.int64()), ("maxt", pa.int64()), ("n", pa.int32()), ("bound", pa.float64()), ("code", pa.string())]
    + [(c, pa.binary()) for c in ("times", "data", "specials")]
)


def encode_chunks(rows: DataFrame, size: int = 1000, code: str = "auto", cut_ms: int = 2_592_000_000) -> DataFrame:
    """Chunks of at most `size` samples from quantized rows (series_id, ts, q, special, bound).

    Series are dealt to tasks by spans of `cut_ms`, so a long series is many tasks and no chunk
    crosses a span; a task sorts its rows and cuts chunks as they come.  A chunk's number is
    its first time."""

    def chunk(s: int, ts: np.ndarray, q: np.ndarray, kinds: np.ndarray, bounds: np.ndarray) -> dict:
        if (bounds != bounds[0]).any():
            raise ValueError("a chunk cannot hold samples of different error bounds")
        z = to_zigzag(np.diff(q[kinds == 0], prepend=np.int64(0)))
        name = choose_code(z) if code == "auto" else code
        times = bitpacking_encode(to_zigzag(np.diff(np.diff(ts, prepend=ts[0]), prepend=0)))
        odd = np.flatnonzero(kinds)
        specials = odd.astype(np.int32).tobytes() + kinds[odd].astype(np.int8).tobytes()
        return {
            "series_id": s, "chunk": int(ts[0]), "mint": int(ts[0]), "maxt": int(ts[-1]), "n": len(ts),
            "bound": float(bounds[0]), "code": name, "times": times, "data": CODES[name][0](z), "specials": specials,
        }

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def cut(table: pa.Table, last: bool) -> tuple[list[dict], pa.Table | None]:
            """The table's chunks, and its rows that may belong to a chunk with more to come."""
            q = table.column("q").fill_null(0).to_numpy()
            series, span, ts, kinds, bounds = (table.column(c).to_numpy() for c in ("series_id", "span", "ts", "special", "bound"))
            new = np.flatnonzero((series[1:] != series[:-1]) | (span[1:] != span[:-1])) + 1
            starts = np.concatenate([np.arange(a, b, size) for a, b in zip([0, *new], [*new, len(ts)], strict=True)]).astype(np.int64)
            ends = np.append(starts[1:], len(ts))
            if not last:
                starts, ends = starts[:-1], ends[:-1]
            made = [chunk(int(series[a]), ts[a:b], q[a:b], kinds[a:b], bounds[a:b]) for a, b in zip(starts, ends, strict=True)]
            return made, None if last else table.slice(int(ends[-1]) if len(ends) else 0)

        for batch in batches:
            if not len(batch):
                continue
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            made, rest = cut(table.combine_chunks(), False)
            if made:
                yield pa.RecordBatch.from_pylist(made, _CHUNK_TYPE)
        if rest is not None and rest.num_rows:
            yield pa.RecordBatch.from_pylist(cut(rest.combine_chunks(), True)[0], _CHUNK_TYPE)

    rows = rows.select("series_id", F.floor(F.col("ts") / cut_ms).alias("span"), "ts", "q", "special", "bound")
    return rows.repartition("series_id", "span").sortWithinPartitions("series_id", "span", "ts").mapInArrow(encode, _CHUNK)


def decode_chunks(chunks: DataFrame) -> DataFrame:
    """The quantized rows (series_id, ts, q, special, bound) of chunks."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n, many = row["n"], len(row["specials"]) // 5
                ts = np.cumsum(np.cumsum(from_zigzag(bitpacking_decode(row["times"], n)))) + row["mint"]
                kinds = np.zeros(n, np.int8)
                kinds[np.frombuffer(row["specials"], np.int32, many)] = np.frombuffer(row["specials"], np.int8, many, 4 * many)
                z = CODES[row["code"]][1](row["data"], n - many)
                q = np.zeros(n, np.int64)
                q[kinds == 0] = np.cumsum(from_zigzag(z))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, row["series_id"])), pa.array(ts), pa.array(q, mask=kinds != 0), pa.array(kinds), pa.array(np.full(n, row["bound"]))],
                    ["series_id", "ts", "q", "special", "bound"],
                )

    return chunks.mapInArrow(decode, "series_id long, ts long, q long, special byte, bound double")


def recode(chunks: DataFrame, size: int, code: str = "auto") -> DataFrame:
    """Longer chunks of the same integers, as compaction makes them."""
    return encode_chunks(decode_chunks(chunks), size, code)


def report(samples: DataFrame, chunks: DataFrame, bound: float) -> DataFrame:
    """(samples, n_bytes, ratio, max_error, violations): 16 bytes a sample before."""
    back = dequantize(decode_chunks(chunks)).select("series_id", "ts", F.col("f").alias("g"))
    error = F.abs(F.col("f") - F.col("g"))
    both = samples.join(back, ["series_id", "ts"]).agg(
        F.count(F.lit(1)).alias("samples"), F.max(error).alias("max_error"), F.sum((error > 1.05 * bound).cast("int")).alias("violations")
    )
    size = chunks.agg(F.sum(F.length("data") + F.length("times") + F.length("specials")).alias("n_bytes"))
    return both.join(F.broadcast(size)).select("samples", "n_bytes", (F.col("samples") * 16 / F.col("n_bytes")).alias("ratio"), "max_error", "violations")
