"""A training corpus from raw documents: filter, deduplicate, mix and tokenise.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and works on all
rows that the stage before it kept.  All but the last return the columns of documents.
A stage is written as Parquet and read again before the next, so that no plan spans
two stages and a lost executor costs no more than tasks of one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelake.llm import bpe, jaccard, mixing, quality, repeats
from tidelake.session import Scratch, read_table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score below 0.3) go."""
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = quality.train(read_table(spark, sf_dir, "documents").select("doc_id", "text"), labels)
    return quality.score(docs, model).where("predicted = 1").select(*docs.columns)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays: that with the smallest doc_id, without
    one only if no row of the group has any, then by the text's hash.

    Documents without words are in no group and stay."""
    scratch = Scratch(spark, "pipeline-jaccard")
    groups = jaccard.link_components(docs.select("doc_id", "text"), scratch, keyed=True).where("n_shingles > 0")
    counted = scratch.write(groups.groupBy("component", "doc_id", "rk").agg(F.count(F.lit(1)).alias("n")), "counted")
    best = counted.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rk")).alias("best"))
    marked = counted.join(scratch.write(best, "best"), "component").select("doc_id", "rk", "n", F.expr("doc_id <=> best.doc_id and rk = best.rk").alias("stays"))
    marked = scratch.write(marked.where("not stays or n > 1").select("doc_id", "rk", "stays"), "marked")
    same = lambda keys: docs["doc_id"].eqNullSafe(keys["doc_id"]) & (jaccard.text_key() == keys["rk"])
    kept = docs.join(marked, same(marked), "left_anti")
    twice = marked.where("stays")
    one = Window.partitionBy("doc_id", jaccard.text_key()).orderBy(*[c for c in docs.columns if c not in ("doc_id", "text")])
    once = docs.join(twice, same(twice), "left_semi").withColumn("_n", F.row_number().over(one)).where("_n = 1")
    return kept.select(*docs.columns).unionByName(once.select(*docs.columns))


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of `repeats.PASSAGE` bytes (about fifty words) or more that occur again are
    cut out of the texts."""
    kept = repeats.deduplicate(docs, Scratch(spark, "pipeline-repeats"), repeats.PASSAGE, as_text=True)
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of all sources to their target weights, shuffled inside the parts of its shards; a
    document that it takes twice or thrice is as many rows."""
    mix = mixing.plan_mix(docs, Scratch(spark, "pipeline-mix"))
    rows = mixing.mixed(mix, docs.columns)
    rows = rows.repartition("_shard", "_part").sortWithinPartitions("_shard", "_part", "_place")
    return rows.select(*docs.columns)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and the text that they decode to."""
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    encoded = bpe.decode(bpe.encode(docs, path, keep_text=False), path)
    return encoded.select("doc_id", "lang", "source", "n_tokens", "ids", "decoded")


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("suffix-array dedup", suffix_array_dedup),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", bpe_encoding),
]

#: Hash-based stages cannot be put in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        if k:
            docs = scratch.write(docs, f"stage{k}")
        docs = stage(spark, docs, sf_dir)
    return docs
