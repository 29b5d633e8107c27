import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidelake.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
THEIRS, OURS = Tokenizer.from_file(PATH), bpe.WordBpe.from_file(PATH)


def agree(text):
    want = THEIRS.encode(text, add_special_tokens=False).ids
    assert OURS.encode(text) == want
    OURS.packed.clear()
    OURS.learn([text])
    assert OURS.encode(text) == want
    assert OURS.decode(want) == THEIRS.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize(
    "text",
    [
        "", " ", "Hello, World's 123 I'll it'S!!", "a<|endoftext|>b <|startoftext|>", "<|ENDOFTEXT|>", "x" * 3000, "ΑΣ ΣΑΣ Σ", "İstanbul ǅ ŉ", "é å̧ Å",
        "日本語 テスト 한국어", "👍🏽 ☃", "\x1c\x1d\x85\xa0 　​\x00", "½ ² ٣ Ⅷ", "don't 've re", "\t\n a  b\r\n", "ﬁ ﷺ", "<|endoftext|", "à<|endoftext|>́b",
    ],
)
def test_texts(text):
    agree(text)


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=40))
def test_any_text(text):
    agree(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=30))
def test_merges_like_repeated_search(symbols):
    ranks = {(0, 1): (0, 4), (1, 0): (1, 5), (0, 0): (2, 6), (4, 4): (3, 7), (6, 6): (4, 8), (2, 2): (5, 2), (3, 4): (6, 9)}
    ours = {bpe.pair(*p): v for p, v in ranks.items()}
    want = list(symbols)
    while pairs := [(ranks[p][0], k) for k, p in enumerate(zip(want, want[1:], strict=False)) if p in ranks]:
        _, k = min(pairs)
        want[k : k + 2] = [ranks[want[k], want[k + 1]][1]]
    assert bpe.merge_symbols(symbols, ours) == want
    if symbols:
        row = np.full((3, 32), -1)
        row[1, : len(symbols)] = symbols
        row[0, 0] = row[2, 0] = 3
        ids, counts = bpe.Merges(ours).apply(row, np.array([1, len(symbols), 1]))
        assert ids.tolist() == [3, *want, 3] and counts.tolist() == [1, len(want), 1]


def test_rows(spark, documents, none):
    rows = bpe.decode(bpe.encode(documents.withColumnRenamed("n", "ids"), PATH), PATH).collect()
    assert len(rows) == 16
    for r in rows:
        want = THEIRS.encode(r.text or "", add_special_tokens=False).ids
        assert (r.ids, r.n_tokens, r.decoded) == (want, len(want), THEIRS.decode(want, skip_special_tokens=False))
    assert bpe.encode(none, PATH).count() == 0
