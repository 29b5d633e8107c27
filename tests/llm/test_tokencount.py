import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidelake.llm import tokencount

VOCABULARY = tokencount.vocabulary_of(public_tokenizers.path("piece_bpe_32k.model"))


def greedy(pieces, longest, word):
    at = n = 0
    while at < len(word):
        size = next((k for k in range(min(longest, len(word) - at), 0, -1) if word[at : at + k] in pieces), 0)
        if not size:
            return None
        at, n = at + size, n + 1
    return n


@settings(max_examples=300, deadline=None)
@given(st.sets(st.text("abc", min_size=1, max_size=5), max_size=14), st.lists(st.text("abcd", max_size=14), max_size=8))
def test_equals_greedy_matching(pieces, words):
    automaton = tokencount.Automaton(sorted(pieces))
    for word in words:
        assert automaton.count(word) == greedy(pieces, 5, word)


def test_known_words():
    automaton, pieces = tokencount.Automaton(VOCABULARY), set(VOCABULARY)
    longest = max(map(len, pieces))
    for word in ["the", "tokenization", "x" * 500, "naïve", "日本", "\U0001fae9", "", "a.b,c", "▁"]:
        assert automaton.count(tokencount.MARK + word) == greedy(pieces, longest, tokencount.MARK + word)


def test_rows(spark, documents, none):
    pieces, longest = set(VOCABULARY), max(map(len, VOCABULARY))
    rows = tokencount.count_tokens(documents.withColumnRenamed("n", "n_tokens"), VOCABULARY).collect()
    assert len(rows) == 16
    for r in rows:
        words = (r.text or "").encode().split()
        found = [greedy(pieces, longest, tokencount.MARK + w.decode()) for w in words]
        assert (r.n_words, r.n_tokens, r.n_unknown) == (len(words), sum(1 if f is None else f for f in found), found.count(None))
    assert tokencount.count_tokens(none, VOCABULARY).count() == 0
    assert [len(tokencount.count_tokens(documents, []).where("n_unknown <> n_words").collect())] == [0]


@pytest.mark.parametrize("vocabulary", [[], ["a"], ["a", "ab", "abc", "c", "bcd"]])
def test_small_vocabularies(vocabulary):
    automaton = tokencount.Automaton(vocabulary)
    for word in ("", "a", "abcd", "abc", "ca", "z"):
        assert automaton.count(word) == greedy(set(vocabulary), 5, word)
