import brute
import corpus_pipeline
from tokenizers import Tokenizer

from tidelake.llm import repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_each_stage_on_its_own_input(spark):
    import public_tokenizers

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    frames = []
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame((out := stage(spark, docs, sf)).collect(), out.schema)
        frames.append(docs)
    assert all(f.columns == COLUMNS for f in frames[:-1])
    good, single, cut, mixed, last = ([r.asDict() for r in f.collect()] for f in frames)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in good}
    assert sum(labels[i] == 1 and i in kept for i in labels) / sum(labels[i] == 1 for i in labels) > 0.9
    groups = brute.jaccard([(r["doc_id"], r["text"]) for r in good], 5, 80)
    assert {r["doc_id"] for r in single} == {i for i, (_, c) in groups.items() if i == c}
    want = brute.repeats([r["text"] for r in single], repeats.PASSAGE)
    by_id = {r["doc_id"]: r for r in cut}
    for r, (size, removed, _, _) in zip(single, want, strict=True):
        assert len(by_id[r["doc_id"]]["text"].encode()) in range(size - removed - 6, size - removed + 1)
        assert by_id[r["doc_id"]]["n_chars"] == len(by_id[r["doc_id"]]["text"])
    counts = {}
    for r in mixed:
        counts[r["doc_id"]] = counts.get(r["doc_id"], 0) + 1
        assert r["text"] == by_id[r["doc_id"]]["text"]
    assert max(counts.values()) <= 3
    theirs = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert len(last) == len(mixed)
    for r in last:
        ids = theirs.encode(by_id[r["doc_id"]]["text"], add_special_tokens=False).ids
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["decoded"] == theirs.decode(ids, skip_special_tokens=False)


def test_one_row_of_each_group_stays(spark):
    base = [f"w{k}" for k in range(60)]
    text, near, other = " ".join(base), " ".join([*base[:59], "x"]), " ".join(f"q{k}" for k in range(60))
    rows = [(1, text, "a"), (2, near, "a"), (2, other, "a"), (1, text, "b"), (None, near, "a"), (5, "", "a"), (5, "", "a"), (None, "no id", "a"), (None, "NO  id", "a")]
    docs = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = [(r.doc_id, r.text.lower().split()[:2], r.source) for r in corpus_pipeline.ngram_jaccard_join(spark, docs, "").collect()]
    want = [(1, ["w0", "w1"], "a"), (2, ["q0", "q1"], "a"), (5, [], "a"), (5, [], "a"), (None, ["no", "id"], "a")]
    assert sorted(got, key=str) == sorted(want, key=str)
