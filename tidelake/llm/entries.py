"""The operators of this subpackage as queries (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.session import Scratch, read_table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelake.llm import quality

    documents = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "quality")
    scored = quality.classify(documents, labels)
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", "predicted")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelake.llm import mixing

    documents = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mix = mixing.plan_mix(documents, Scratch(spark, "op2"))
    shards = F.array_sort(F.array_distinct(F.transform("draws", lambda x: x["shard"])))
    return mixing.taken(mix).select(
        "doc_id", F.col("_size").alias("size"), "source_size", "target", "taken", shards.alias("shards")
    )


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelake.llm import jaccard

    documents = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard.link_components(documents, Scratch(spark, "op3"), width=3, percent=90)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tidelake.llm import bpe

    path = public_tokenizers.path("word_bpe_49k.json")
    documents = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = bpe.decode(bpe.encode(documents, path, keep_text=False), path)
    return encoded.select(
        "doc_id",
        "n_tokens",
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelake.llm import repeats

    documents = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = repeats.deduplicate(documents, Scratch(spark, "op5"), passage=repeats.PASSAGE)
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_passage_bytes")


def op6_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelake.llm import warczip

    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    records = warczip.round_trip(pages, Scratch(spark, "op6"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tidelake.llm import tokencount

    vocabulary = tokencount.vocabulary_of(public_tokenizers.path("piece_bpe_32k.model"))
    documents = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokencount.count_tokens(documents, vocabulary).drop("text")


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelake.llm import epsgrid

    embeddings = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return epsgrid.near_duplicates(embeddings, Scratch(spark, "op8"))


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelake.llm import hnsw

    embeddings = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    queries = embeddings.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    return hnsw.nearest(embeddings, queries, Scratch(spark, "op9"))


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelake.llm import sitestyle

    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    text = sitestyle.extract(pages, Scratch(spark, "op10"))
    return text.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


QUERIES = {
    "op1_quality": op1_quality,
    "op2_mix_sources": op2_mix_sources,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op4_bpe": op4_bpe,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_warc_zip": op6_warc_zip,
    "op7_token_counts": op7_token_counts,
    "op8_embedding_dedup": op8_embedding_dedup,
    "op9_nearest": op9_nearest,
    "op10_main_text": op10_main_text,
}

#: The others hash, train or search approximately; tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op6_warc_zip": """
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
        r AS (SELECT payload_digest, max(page_id) AS last FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
        SELECT page_id, payload_bytes, payload_digest,
            CASE WHEN coalesce(last, page_id) = page_id THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN last <> page_id THEN last END AS refers_to
        FROM p LEFT JOIN r USING (payload_digest)""",
    "op8_embedding_dedup": """
        WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
            WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
            AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
            AND list_cosine_similarity(a.e, b.e) >= 0.95),
        reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
        low AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
        n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
        SELECT vec_id, coalesce(n.n, 0) AS n_links, component_id, vec_id = component_id AS kept
        FROM embeddings JOIN low ON low.a = vec_id LEFT JOIN n ON n.a = vec_id""",
}
