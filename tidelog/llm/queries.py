"""The operators as queries over the driver's tables, with oracle SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import bpe, jaccard, langid, linededup, mixing, quality, secrets, sharding, suffix, topk

SHARDS = 40
TOKENIZER = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into 40 shards, with each one's shard among 41."""
    return sharding.shard_documents(table(spark, sf_dir, "documents"), SHARDS)


def domain_labels(labels: DataFrame) -> DataFrame:
    """doc_id and domain: toxic, else low or good by quality; other labels than 0 and 1 name no domain."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "good")
    return labels.select("doc_id", domain.alias("domain"))


#: Target shares of all tokens.
SHARES = {"good": 0.95, "low": 0.04, "toxic": 0.01}


def op2_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's domain posteriors, sampling rate and copies for the target shares."""
    docs, labels = table(spark, sf_dir, "documents"), domain_labels(table(spark, sf_dir, "labels"))
    rows, domains, _ = mixing.mixing(docs, labels, SHARES)
    shares = [(F.element_at("membership", i + 1) / mixing.MILLION).alias(f"p_{d}") for i, d in enumerate(domains)]
    return rows.select("doc_id", "n_tokens", *shares, "rate", "copies")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document loses to lines that an earlier document or place already has."""
    return linededup.remove_repeated_units(table(spark, sf_dir, "documents")).drop("kept")


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best candidates of every 50th vector."""
    return topk.exact_top_k(table(spark, sf_dir, "embeddings"), k=5, every=50)


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents under Jaccard similarity 0.9 or more of 3-word shingles."""
    groups = jaccard.jaccard_groups(table(spark, sf_dir, "documents"), jaccard.Similarity(k=3, num=9, den=10))
    return groups.select("doc_id", "n_shingles", "component_id", "n_links")


def op6_adaptive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality verdicts of all documents, thresholds by language and source."""
    return quality.quality_rules(table(spark, sf_dir, "documents"))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the 400-byte strings that occur elsewhere too."""
    return suffix.remove_repeats(table(spark, sf_dir, "documents"), length=400, full=False, short=suffix.PASSAGE_BYTES)


def op8_boundary_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's token ids and of what they decode to."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode_documents(docs, tokenizer_path(), full=False)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, by its text, declaration and source."""
    return langid.identify_documents(table(spark, sf_dir, "documents"), keep_text=False).select("doc_id", "lang", "source", "detected", "confidence", "n_trigrams", "kept")


def language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every page, by its text, markup, address suffix and host."""
    return langid.identify_pages(table(spark, sf_dir, "pages"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, in nested encodings too."""
    return secrets.scan_documents(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("redacted")


QUERIES = {
    f.__name__: f
    for f in (
        op1_jump_sharding,
        op2_soft_mixing,
        op3_line_dedup,
        op4_exact_top_k,
        op5_ngram_jaccard_join,
        op6_adaptive_quality,
        op7_suffix_array_dedup,
        op8_boundary_bpe,
        op9_language_id,
        op10_secret_scan,
        language_id_pages,
    )
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from tidelog.llm.oracles import ORACLES

    return {k: v for k, v in ORACLES.items() if k in QUERIES}
