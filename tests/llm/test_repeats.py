import hashlib
import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelake.llm import prefixfree, repeats
from tidelake.session import Scratch


def check(rows, length=400):
    want = brute.repeats([r.text for r in rows], length)
    got = [(r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in rows]
    assert got == want


def test_sample_equals_brute_force(spark, scratch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = repeats.deduplicate(docs, scratch, passage=280).collect()
    check(rows)
    assert [r.n_passage_bytes for r in rows] == [w[1] for w in brute.repeats([r.text for r in rows], 280)]


def test_suffix_order_equals_sorting():
    rng = random.Random(4)
    some = bytes(rng.choice(b"abc") for _ in range(900))
    texts = [some[:700], b"x" + some[50:], b"", b"a" * 300, b"ab" * 200, some[100:800] + b"q", some[:700], b"z"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.append(0, np.cumsum([len(t) for t in texts]))
    owner = np.repeat(np.arange(len(texts)), np.diff(offsets))
    suffix = [texts[t][k - offsets[t] :] for k, t in enumerate(owner)]
    begin, end, _ = prefixfree._phrases(prefixfree.Hashes(data), offsets)
    assert len(begin) > 40 and len({bytes(data[b:e]) for b, e in zip(begin, end, strict=True)}) < len(begin)
    for wanted in (np.arange(len(data)), np.arange(0, len(data), 7)):
        order = prefixfree.suffix_ranks(data, offsets, prefixfree.Hashes(data), wanted)
        assert [suffix[k] for k in wanted[order]] == sorted(suffix[k] for k in wanted)


@pytest.mark.parametrize(("length", "family"), [(64, 1), (100, 2048), (280, 1)])
def test_lengths_and_large_contexts(spark, scratch, monkeypatch, length, family):
    monkeypatch.setattr(repeats, "FAMILY", family)
    rng = random.Random(length)
    text = lambda n: "".join(rng.choice("abcd") for _ in range(n))
    shared = text(length + 40)
    rows = [(k, text(rng.randrange(200)) + shared[rng.randrange(30) : len(shared) - rng.randrange(30)] + text(150)) for k in range(40)]
    rows += [rows[3], (50, None), (51, ""), (52, "ha " * 400)]
    got = repeats.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), scratch, length)
    check(got.collect(), length)


def test_lengths_out_of_range(scratch, documents):
    with pytest.raises(ValueError, match="below"):
        repeats.span_of(repeats.MINIMUM - 1)
    with pytest.raises(ValueError, match="above"):
        repeats.deduplicate(documents, scratch, 300, passage=301)


def test_planted_passages(spark, scratch):
    """Passages around the length, in one text and several, periodic text and near copies."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdé ") for _ in range(6))
    text = lambda n: "".join(word() for _ in range(n // 6))
    shared = [text(n) for n in (390, 399, 405, 480, 700, 1500)]
    rows = []
    for k in range(60):
        parts = [text(rng.randrange(0, 900))]
        for _ in range(rng.randrange(3)):
            parts += [rng.choice(shared)[: rng.choice([350, 410, 5000])], text(rng.randrange(300))]
        rows.append((k, "".join(parts)))
    edited = list(text(3000))
    for k in range(60, 66):
        copy = list(edited)
        for _ in range(k - 60):
            copy[rng.randrange(len(copy))] = "#"
        rows.append((k, "".join(copy)))
    rows += [(70, "ab" * 500), (71, "a" * 401), (72, "a" * 400), (73, "xyz" * 133 + "x")]
    check(repeats.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), scratch).collect())


def test_edge_rows(spark, scratch, documents, none):
    rows = repeats.deduplicate(documents.withColumnRenamed("n", "n_bytes"), scratch).collect()
    assert len(rows) == 16
    check(rows)
    cut = repeats.deduplicate(documents, Scratch(spark, "test"), as_text=True)
    assert cut.where(F.col("text").isNull()).count() == 0 and "kept" not in cut.columns
    assert repeats.deduplicate(none, Scratch(spark, "test")).count() == 0


def test_long_texts_go_in_pieces(monkeypatch):
    monkeypatch.setattr(repeats, "_PIECE", 1000)
    rng = np.random.default_rng(2)
    data = rng.integers(97, 101, 9000).astype(np.uint8)
    whole = repeats._zones(data, np.array([0, len(data)]), 400)
    found = {}
    for i, j, a, b, shift in repeats._pieces(np.array([0, len(data)]), 399):
        assert (i, j) == (0, 1)
        _, trigger, first, last, context, _ = repeats._zones(data[a:b], np.array([0, b - a]), 400)
        for t, f, e, c in zip(trigger + shift, first + shift, last + shift, context, strict=True):
            found.update({s: (t, c) for s in range(f, e + 1)})
    _, trigger, first, last, context, _ = whole
    want = {s: (t, c) for t, f, e, c in zip(trigger, first, last, context, strict=True) for s in range(f, e + 1)}
    assert found == want
