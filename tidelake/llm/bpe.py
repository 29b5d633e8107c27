"""BPE encoding and decoding with a segment tree over the ranks of adjacent pairs.

A word starts as one symbol for each byte, the last with the end-of-word mark.  The
leaves of a segment tree hold the rank of the merge of each symbol with its right
neighbour; the root is the smallest (rank, place), the leftmost lowest-rank merge.  A
merge changes three leaves, each in logarithmic time, so a word of n bytes takes
O(n log n) whatever its length.  The new words of some texts are merged together, their
trees being rows of one array; a long word has a tree of its own.

Words are independent, and so are texts: rows are mapped where they are, nothing is
shuffled, and a worker keeps the results of at most `_KEPT` words.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructType
from tokenizers import Regex
from tokenizers.normalizers import NFC, Lowercase, Sequence
from tokenizers.pre_tokenizers import Split

from tidelake.llm.kernels import small_batches, tidy

_KEPT = 150_000
# str.split takes these four for white space, the file's pattern does not.
_SEPARATORS = regex.compile(r"[\x1c-\x1f]")


_SHIFT = 20  # a pair of symbols as one integer
_NONE = 1 << 62
_WIDEST = 64  # bytes of the longest words that are merged together


def merge_symbols(symbols: list[int], ranks: dict[int, tuple[int, int]]) -> list[int]:
    """Apply merges (pair as `pair()` gives it -> (rank, symbol)) until no adjacent pair has one."""
    n = len(symbols)
    if n < 2:
        return symbols
    find = ranks.get
    leaves = []
    for k in range(n - 1):
        got = find(symbols[k] << _SHIFT | symbols[k + 1])
        leaves.append(_NONE if got is None else got[0] * n + k)
    if min(leaves) == _NONE:
        return symbols
    symbols = list(symbols)
    width = 1 << (n - 2).bit_length()
    tree = [_NONE] * width + leaves + [_NONE] * (width - n + 1)
    for at in range(width - 1, 0, -1):
        a, b = tree[2 * at], tree[2 * at + 1]
        tree[at] = a if a < b else b
    right, left = list(range(1, n + 1)), list(range(-1, n - 1))
    while (root := tree[1]) != _NONE:
        k = root % n
        gone = right[k]
        after, before = right[gone], left[k]
        symbols[k] = merged = ranks[symbols[k] << _SHIFT | symbols[gone]][1]
        right[k] = after
        changes = []
        if gone < n - 1:
            changes.append((width + gone, _NONE))
        got = None
        if after < n:
            left[after] = k
            got = find(merged << _SHIFT | symbols[after])
        changes.append((width + k, _NONE if got is None else got[0] * n + k))
        if before >= 0:
            got = find(symbols[before] << _SHIFT | merged)
            changes.append((width + before, _NONE if got is None else got[0] * n + before))
        for at, value in changes:
            if tree[at] == value:
                continue
            tree[at] = value
            while at > 1:  # up to the first node that stays as it is
                other = tree[at ^ 1]
                at >>= 1
                if other < value:
                    value = other
                if tree[at] == value:
                    break
                tree[at] = value
    out, k = [], 0
    while k < n:
        out.append(symbols[k])
        k = right[k]
    return out


def pair(a: int, b: int) -> int:
    return a << _SHIFT | b


class Merges:
    """The merges of a vocabulary as arrays, for many words at a time."""

    def __init__(self, ranks: dict[int, tuple[int, int]]):
        self.keys = np.array(sorted(ranks), np.int64)
        self.ranks = np.array([ranks[k][0] for k in self.keys.tolist()], np.int64)
        self.merged = np.zeros(int(self.ranks.max(initial=-1)) + 1, np.int64)
        self.merged[self.ranks] = [ranks[k][1] for k in self.keys.tolist()]

    def leaf(self, a: np.ndarray, b: np.ndarray, place: np.ndarray) -> np.ndarray:
        """(rank, place) as one number, or _NONE; a negative symbol has no pair."""
        if not len(self.keys):
            return np.full(len(a), _NONE)
        key = a << _SHIFT | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.ranks[at] * _WIDEST + place, _NONE)

    def apply(self, symbols: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbols that stay, how many each row has) of rows of symbols, -1 beyond their length."""
        n, width = symbols.shape
        sym, places = symbols.ravel(), np.arange(width)
        tree = np.full((n, 2 * width), _NONE)
        first = self.leaf(symbols[:, :-1].ravel(), symbols[:, 1:].ravel(), np.tile(places[:-1], n))
        tree[:, width : 2 * width - 1] = first.reshape(n, width - 1)
        size = width
        while size > 1:
            size //= 2
            tree[:, size : 2 * size] = np.minimum(tree[:, 2 * size : 4 * size : 2], tree[:, 2 * size + 1 : 4 * size : 2])
        tree, depth = tree.ravel(), width.bit_length() - 1
        right, left = np.tile(places + 1, n), np.tile(places - 1, n)
        alive = (places[None, :] < length[:, None]).ravel()
        row = np.arange(n)
        while True:
            root = tree[row * (2 * width) + 1]
            row, root = row[root != _NONE], root[root != _NONE]
            if not len(row):
                break
            base, top = row * width, row * (2 * width)
            k = root % _WIDEST
            gone = right[base + k]
            after, before = right[base + gone], left[base + k]
            new = self.merged[root // _WIDEST]
            sym[base + k] = new
            alive[base + gone] = False
            right[base + k] = after
            follows = after < length[row]
            left[(base + after)[follows]] = k[follows]
            next_ = np.where(follows, sym[base + np.minimum(after, width - 1)], -1)
            last = np.where(before >= 0, sym[base + np.maximum(before, 0)], -1)
            tree[top + width + gone] = _NONE
            tree[top + width + k] = self.leaf(new, next_, k)
            led = before >= 0
            tree[(top + width + before)[led]] = self.leaf(last, new, before)[led]
            for at in (width + gone, width + k, width + np.where(led, before, k)):
                for _ in range(depth):
                    at = at >> 1
                    tree[top + at] = np.minimum(tree[top + 2 * at], tree[top + 2 * at + 1])
        return sym[alive], alive.reshape(n, width).sum(axis=1)


def _byte_letters() -> list[str]:
    """The printable character that stands for each byte in the vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class WordBpe:
    """A tokenizer file of the kind BPE with word ends: text is composed (NFC), put in
    lower case, and split into pieces by the file's pattern; white space is dropped.  The
    merges, and decoding, are done here; ids are the tokenizers library's."""

    def __init__(self, spec: dict):
        model = spec["model"]
        suffix = model["end_of_word_suffix"]
        vocabulary: dict[str, int] = model["vocab"]
        added = spec["added_tokens"]
        letters = _byte_letters()
        self.inner = [vocabulary[c] for c in letters]
        self.final = [vocabulary[c + suffix] for c in letters]
        self.ranks = {}
        for rank, (a, b) in enumerate(model["merges"]):
            if a in vocabulary and b in vocabulary:
                self.ranks[pair(vocabulary[a], vocabulary[b])] = (rank, vocabulary[a + b])
        self.merges = Merges(self.ranks)
        self.first = np.array(self.inner, np.int64)
        self.last = np.array(self.final, np.int64)
        self.special = {t["content"]: t["id"] for t in added}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        pattern = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        self.ascii_pieces = regex.compile(pattern).findall
        # Characters' classes and lower case change with the version of Unicode; beyond ASCII the library's own decide.
        self.normal = Sequence([NFC(), Lowercase()]).normalize_str
        self.pieces = Split(Regex(pattern), "removed", invert=True).pre_tokenize_str
        names = vocabulary | self.special
        self.tokens = [""] * (max(names.values()) + 1)
        for token, number in names.items():
            self.tokens[number] = token
        self.token_array = pa.array(self.tokens, pa.string())
        self.packed = _Packed(self)

    @classmethod
    def from_file(cls, path: str) -> WordBpe:
        with open(path, encoding="utf-8") as f:
            return cls(json.load(f))

    def _piece(self, piece: str) -> list[int]:
        data = piece.encode("utf-8", "replace")
        symbols = [self.inner[b] for b in data]
        symbols[-1] = self.final[data[-1]]
        return merge_symbols(symbols, self.ranks)

    def split(self, chunk: str) -> list[str]:
        if chunk.isascii():
            return self.ascii_pieces(chunk.lower())
        return [piece for piece, _ in self.pieces(self.normal(chunk))]

    def chunk(self, chunk: str) -> list[int]:
        """Ids of text without special tokens."""
        out: list[int] = []
        for piece in self.split(chunk):
            out += self._piece(piece)
        return out

    def pieces_packed(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of distinct pieces as 32-bit integers, joined."""
        out: dict[str, bytes] = {}
        widths: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            data = piece.encode("utf-8", "replace")
            if len(data) > _WIDEST:
                out[piece] = np.array(self._piece(piece), np.int32).tobytes()
            else:
                widths.setdefault(max(2, 1 << (len(data) - 1).bit_length()), []).append((piece, data))
        for width, some in widths.items():
            for k in range(0, len(some), 8192):
                part = some[k : k + 8192]
                length = np.array([len(d) for _, d in part])
                letters = np.frombuffer(b"".join(d.ljust(width, b"\0") for _, d in part), np.uint8).reshape(len(part), width)
                symbols = self.first[letters]
                symbols[np.arange(width)[None, :] >= length[:, None]] = -1
                ends = (np.arange(len(part)), length - 1)
                symbols[ends] = self.last[letters[ends]]
                ids, counts = self.merges.apply(symbols, length)
                packed, at = ids.astype(np.int32).tobytes(), 0
                for (piece, _), n in zip(part, counts.tolist(), strict=True):
                    out[piece] = packed[at : at + 4 * n]
                    at += 4 * n
        return out

    def learn(self, texts: list[str]) -> None:
        """Put the new short runs of some texts into the table, all at once."""
        if len(self.packed) > _KEPT:
            self.packed.clear()
        new = set()
        for text in texts:
            new.update(text.split())
        new = [c for c in new if c not in self.packed and len(c) <= _WIDEST]
        split = [self.split(c) for c in new]
        done = self.pieces_packed(list({p for pieces in split for p in pieces}))
        for c, pieces in zip(new, split, strict=True):
            self.packed[c] = b"".join([done[p] for p in pieces])

    def encode_packed(self, text: str) -> bytes:
        """Ids as 32-bit integers, joined."""
        if any(s in text for s in self.special):
            return b"".join(
                np.array([self.special[part]] if part in self.special else self.chunk(part), np.int32).tobytes()
                for part in self.split_special.split(text)
            )
        if _SEPARATORS.search(text):
            return np.array(self.chunk(text), np.int32).tobytes()
        return b"".join(map(self.packed.__getitem__, text.split()))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), np.int32).tolist()

    def decode(self, ids: list[int]) -> str:
        """Without a decoder in its file, the tokens as they stand, joined by one space."""
        return " ".join(self.tokens[i] for i in ids)


class _Packed(dict):
    """Run of text without white space -> its packed ids.  Pieces never hold white space."""

    def __init__(self, bpe: WordBpe):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, chunk: str) -> bytes:
        packed = np.array(self.bpe.chunk(chunk), np.int32).tobytes()
        if len(chunk) <= _WIDEST:
            self[chunk] = packed
        return packed


_loaded: dict[str, WordBpe] = {}


def _tokenizer(spec: str) -> WordBpe:
    """One tokenizer for each worker process."""
    key = hashlib.md5(spec.encode()).hexdigest()
    if key not in _loaded:
        _loaded[key] = WordBpe(json.loads(spec))
    return _loaded[key]


def _spec(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def _with(df: DataFrame, drop: tuple[str, ...], *fields) -> tuple[DataFrame, StructType, list[str]]:
    small_batches(df)
    columns = [c for c in df.columns if c.lower() not in drop]
    source = df.select(*[f"`{c}`" for c in columns])
    schema = StructType(list(source.schema.fields))
    for name, kind in fields:
        schema = schema.add(name, kind)
    return source, schema, columns


def encode(documents: DataFrame, path: str, keep_text: bool = True) -> DataFrame:
    """The rows of `documents` with n_tokens (long) and ids (array<int>).

    A null or empty text, or one of white space, has no ids.  Input columns named ids or
    n_tokens are replaced.  The file is read on the driver and sent with the tasks."""
    spec = _spec(path)
    drop = ("ids", "n_tokens")
    source, schema, columns = _with(documents, drop, ("n_tokens", LongType()), ("ids", ArrayType(IntegerType())))
    if not keep_text:
        schema = StructType([f for f in schema.fields if f.name != "text"])
    names = [c for c in columns if keep_text or c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _tokenizer(spec)
        for batch in batches:
            for start in range(0, len(batch), 256):
                part = batch.slice(start, 256)
                texts = [t or "" for t in part.column("text").to_pylist()]
                bpe.learn(texts)
                packed = [bpe.encode_packed(t) for t in texts]
                counts = np.array([len(p) // 4 for p in packed], np.int64)
                ids = np.frombuffer(b"".join(packed), np.int32)
                cuts = np.append(0, np.cumsum(counts)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in names], pa.array(counts), pa.ListArray.from_arrays(cuts, pa.array(ids))],
                    [*names, "n_tokens", "ids"],
                )
        tidy()

    return source.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """The rows of `encoded` with `decoded`, the text of their ids; null ids give an
    empty text.  An input column named decoded is replaced."""
    spec = _spec(path)
    source, schema, columns = _with(encoded, ("decoded",), ("decoded", StringType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _tokenizer(spec)
        for batch in batches:
            for start in range(0, len(batch), 256):
                part = batch.slice(start, 256)
                ids = part.column("ids")
                cuts = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy())).astype(np.int32)
                tokens = bpe.token_array.take(ids.flatten())
                joined = pc.binary_join(pa.ListArray.from_arrays(cuts, tokens), " ")
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in columns], joined], [*columns, "decoded"])
        tidy()

    return source.mapInArrow(run, schema)
