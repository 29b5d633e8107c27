"""Suffix order of texts by prefix-free parsing.

1. A place whose window of `WINDOW` bytes has a rolling hash divisible by `PERIOD` is a
   trigger.  A phrase goes from one trigger (or the start of a text) to the end of the
   next trigger's window (or the end of the text), so phrases overlap by a window.  As
   triggers depend on their windows alone, no suffix of a phrase that is longer than a
   window is a prefix of another.
2. The dictionary holds each distinct phrase once; its suffix array is made by prefix
   doubling over the phrases' bytes.  Equal suffixes of different phrases share a rank.
3. The parse holds each text as the ranks of its phrases; its suffix array is made by
   the same prefix doubling over these ranks.
4. Both combine into the order of the texts' suffixes: first by the rank of the rest of
   the phrase at hand, then by the rank of the parse from the next phrase on.

Sorting works on the dictionary and the parse, which repetitive text leaves small.
"""

from __future__ import annotations

import numpy as np

from tidelake.llm.kernels import mix

WINDOW = 12
PERIOD = 48
_U = np.uint64
_PIECE = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_CODES = np.random.default_rng(400).integers(1, 2**63, 256, dtype=np.uint64) | _U(1)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(1 << n.bit_length(), _PIECE + 4096), base, np.uint64)
        steps[0] = 1
        have = _powers[base] = np.cumprod(steps)
    return have[:n]


class Hashes:
    """Hashes of any substring of `data`, by prefix sums modulo 2**64."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_CODES[data] * _power(_BASE, len(data)), out=self.sums[1:])
        self.back = _power(_INVERSE, len(data) + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start])


def _ranks(values: np.ndarray) -> np.ndarray:
    """1 + the number of smaller values; equal values have equal ranks."""
    order = np.argsort(values)
    ordered = values[order]
    first = np.ones(len(values), dtype=bool)
    first[1:] = ordered[1:] != ordered[:-1]
    rank = np.empty(len(values), np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(1, len(values) + 1), 0))
    return rank


def _double(rank: np.ndarray, room: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of the suffixes of sequences by prefix doubling.  rank: of their first `depth`
    elements, room: elements up to the sequence's end.  An end comes before any element.
    Only places that still tie with a longer suffix are sorted again."""
    n = len(rank)
    tied = np.arange(n)
    while True:
        many = np.bincount(rank[tied], minlength=n + 1)
        longer = np.bincount(rank[tied], weights=room[tied] > depth, minlength=n + 1)
        tied = tied[(many[rank[tied]] > 1) & (longer[rank[tied]] > 0)]
        if not len(tied):
            return rank
        follows = np.zeros(len(tied), np.int64)
        inside = np.flatnonzero(room[tied] > depth)
        follows[inside] = rank[tied[inside] + depth]
        order = np.argsort(rank[tied] * (n + 1) + follows)
        group, follows = rank[tied][order], follows[order]
        place = np.arange(len(tied))
        head = np.ones(len(tied), dtype=bool)
        head[1:] = group[1:] != group[:-1]
        first = head.copy()
        first[1:] |= follows[1:] != follows[:-1]
        start = np.maximum.accumulate(np.where(head, place, 0))
        rank = rank.copy()
        rank[tied[order]] = group + np.maximum.accumulate(np.where(first, place, 0)) - start
        depth *= 2


def _phrases(hashes: Hashes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, phrases left in the text with this one) of the phrases of all texts."""
    n = int(offsets[-1])
    places = np.arange(max(n - WINDOW + 1, 0))
    found = np.flatnonzero(hashes.of(places, places + WINDOW) % _U(PERIOD) == 0)
    fits = found + WINDOW <= offsets[np.searchsorted(offsets, found, side="right")]
    cut = np.zeros(n, dtype=bool)
    cut[found[fits]] = True
    cut[offsets[:-1][np.diff(offsets) > 0]] = True
    begin = np.flatnonzero(cut)
    stop = offsets[np.searchsorted(offsets, begin, side="right")]
    end = np.minimum(np.append(begin[1:], n) + WINDOW, stop)
    after = np.searchsorted(begin, stop, side="left")
    return begin, end, after - np.arange(len(begin))


def suffix_ranks(data: np.ndarray, offsets: np.ndarray, hashes: Hashes, wanted: np.ndarray) -> np.ndarray:
    """The order (indices into `wanted`) of the suffixes that start at the places `wanted`
    and go to the ends of their texts, data[offsets[t]:offsets[t + 1]].  Equal suffixes
    stand side by side."""
    if not len(wanted):
        return np.zeros(0, np.int64)
    begin, end, left = _phrases(hashes, offsets)
    _, first, phrase = np.unique(
        hashes.of(begin, end) + mix((end - begin).astype(np.uint64)), return_index=True, return_inverse=True
    )
    size = (end - begin)[first]
    at = np.append(0, np.cumsum(size))
    place = np.arange(at[-1]) + np.repeat(begin[first] - at[:-1], size)
    room = np.repeat(at[1:], size) - np.arange(at[-1])
    characters = np.append(data[place].astype(np.int64) + 1, np.zeros(7, np.int64))
    head = np.zeros(len(place), np.int64)
    for k in range(7):
        head = head << 9 | np.where(room > k, characters[k : k + len(place)], 0)
    dictionary = _double(_ranks(head), room, 7)

    parse = np.append(_double(_ranks(dictionary[at[:-1]][phrase]), left, 1), 0)

    of = np.searchsorted(begin, wanted, side="right") - 1
    rest = dictionary[at[phrase[of]] + wanted - begin[of]]
    following = np.where(left[of] > 1, parse[of + 1], 0)
    return np.lexsort((following, rest))


def repeated(data: np.ndarray, offsets: np.ndarray, wanted: np.ndarray, length: int) -> np.ndarray:
    """Whether the string of `length` bytes at each place of `wanted` starts at another of
    these places too, i.e. a neighbour in suffix order shares as many bytes."""
    hashes = Hashes(data)
    order = suffix_ranks(data, offsets, hashes, wanted)
    string = hashes.of(wanted[order], wanted[order] + length)
    same = string[1:] == string[:-1]
    out = np.zeros(len(wanted), dtype=bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out
