"""Token counts by a linear longest-match automaton.

The vocabulary is a trie.  A node's failure link says where matching goes on when the
next character has no child there, and its popped count how many pieces the greedy
longest match has then given up for good; both are computed once, by breadth.  A word is
read character by character, each step a child or a failure link, so a word takes time
linear in its length, and no piece is ever built.

Pieces that begin a word carry a mark before their first character; a word that cannot
be matched to its end counts as one unknown token.  Texts are independent: rows are
mapped where they are, and a worker keeps the counts of at most `_KEPT` words.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StructType

from tidelake.llm.kernels import string_buffers

MARK = "▁"
_KEPT = 200_000
_UNKNOWN = 1 << 40  # a word's value: its tokens, and this much more if it is unknown


class Automaton:
    """Node 0 is the root; `children` are dictionaries, `fail` is -1 for none."""

    def __init__(self, vocabulary: list[str]):
        self.children: list[dict[str, int]] = [{}]
        whole = [False]
        for piece in vocabulary:
            node = 0
            for c in piece:
                after = self.children[node].get(c)
                if after is None:
                    after = self.children[node][c] = len(self.children)
                    self.children.append({})
                    whole.append(False)
                node = after
            whole[node] = node > 0
        n = len(self.children)
        self.fail, self.popped = [-1] * n, [0] * n
        queue = deque([0])
        while queue:
            node = queue.popleft()
            for c, child in self.children[node].items():
                queue.append(child)
                if whole[child]:
                    self.fail[child], self.popped[child] = 0, 1
                    continue
                at, count = self.fail[node], self.popped[node]
                while at >= 0 and c not in self.children[at]:
                    count += self.popped[at]
                    at = self.fail[at]
                if at >= 0:
                    self.fail[child], self.popped[child] = self.children[at][c], count

    def count(self, word: str) -> int | None:
        """Pieces of the greedy longest match, or None if it does not reach the end."""
        children, fail, popped = self.children, self.fail, self.popped
        node = total = 0
        for c in word:
            while (after := children[node].get(c)) is None:
                total += popped[node]
                node = fail[node]
                if node < 0:
                    return None
            node = after
        while node:
            total += popped[node]
            node = fail[node]
            if node < 0:
                return None
        return total


class _Words(dict):
    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        n = self.automaton.count(MARK + word.decode("utf-8", "replace"))
        value = 1 + _UNKNOWN if n is None else n
        if len(word) <= 64:
            self[word] = value
        return value


_loaded: dict[str, _Words] = {}


def _words(vocabulary: list[str]) -> _Words:
    """One automaton for each worker process."""
    key = hashlib.md5("\n".join(vocabulary).encode()).hexdigest()
    if key not in _loaded:
        _loaded[key] = _Words(Automaton(vocabulary))
    return _loaded[key]


def vocabulary_of(model_path: str) -> list[str]:
    """The pieces of a sentence-piece model, without control and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    ids = range(model.get_piece_size())
    return [model.id_to_piece(i) for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]


def count_tokens(documents: DataFrame, vocabulary: list[str]) -> DataFrame:
    """The rows of `documents` with n_words, n_tokens and n_unknown (words counted as one
    unknown token each).

    Words are runs of bytes other than space and 0x09-0x0D.  A null, empty or blank text has
    none.  Input columns of these names are replaced."""
    added = ("n_words", "n_tokens", "n_unknown")
    columns = [c for c in documents.columns if c.lower() not in added]
    source = documents.select(*[f"`{c}`" for c in columns])
    schema = StructType(list(source.schema.fields))
    for name in added:
        schema = schema.add(name, LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(vocabulary)
        for batch in batches:
            data, offsets = string_buffers(batch.column("text"))
            counts = np.zeros((3, len(batch)), np.int64)
            for k in range(len(batch)):
                found = data[offsets[k] : offsets[k + 1]].tobytes().split()
                total = sum(map(words.__getitem__, found))
                counts[:, k] = len(found), total % _UNKNOWN, total // _UNKNOWN
                if len(words) > _KEPT:
                    words.clear()
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, counts)], [*columns, *added])

    return source.mapInArrow(run, schema)
