"""A training corpus from the documents table, in five stages that each call one operator of tidelog.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import bpe, jaccard, langid, mixing, queries, secrets
from tidelog.llm.common import set_aside, splittable, staged, with_row_info
from tidelog.shipping import ship

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language, or with none that the evidence makes likely, go; the others keep all columns.

    The scored evidence is staged without texts; only texts that may belong to a rejected row are shuffled.
    Rows with the same doc_id, text, declaration and source are judged alike; null and empty texts go.
    """
    ship(spark)
    plain, restore = set_aside(docs, ["doc_id", "text", "lang", "source"])
    text, lang, source = F.coalesce("text", F.lit("")), F.col("lang"), F.col("source")
    hashed = plain.withColumn("text_hash", F.xxhash64(text, lang.isNull(), lang, source.isNull(), source))
    judged = langid.identify_documents(hashed.select("doc_id", "text_hash", "text", "lang", "source"), keep_text=False)
    rejected = judged.where(~F.col("kept")).select("doc_id", "text_hash").distinct().withColumn("goes", F.lit(True))
    return restore(with_row_info(hashed, staged(rejected, "rejected"), "goes").where(F.col("goes").isNull()))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the least doc_id (a null comes after all), then the least text hash.

    Documents without words are in no group and stay; of repeated rows in a group one stays.
    """
    ship(spark)
    groups = jaccard.jaccard_groups(docs, jaccard.Similarity(k=5, num=8, den=10)).where("n_links > 0")
    rank = F.struct(F.col("doc_id").isNull().alias("null_id"), "doc_id", "text_hash")
    grouped = staged(groups.select("group_id", "doc_id", "text_hash", rank.alias("rank")).distinct(), "grouped")
    first = grouped.groupBy("group_id").agg(F.min("rank").alias("first"))
    verdicts = grouped.join(splittable(first, "group_id"), "group_id").select("doc_id", "text_hash", (F.col("rank") == F.col("first")).alias("stays"))
    plain, restore = set_aside(docs, ["doc_id", "text"])
    hashed = plain.withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    told = with_row_info(hashed, staged(verdicts, "verdicts"), "stays")
    alone = told.where(F.col("stays").isNull())
    chosen = told.where("stays").dropDuplicates(["doc_id", "text_hash"])
    return restore(alone.unionByName(chosen))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by marks; n_chars follows the text."""
    ship(spark)
    plain, restore = set_aside(docs, ["text", "n_chars"])
    cleaned = secrets.scan_documents(plain).withColumnRenamed("redacted", "text")
    changed = F.when(F.col("spans") == "", F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType))
    return restore(cleaned.withColumn("n_chars", changed))


def target_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are dropped or repeated so that the domains' tokens meet their target shares."""
    ship(spark)
    labels = queries.domain_labels(queries.table(spark, sf_dir, "labels"))
    return mixing.mixed_documents(docs, labels, queries.SHARES)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's token ids and what they decode to, with digests."""
    ship(spark)
    return bpe.encode_documents(docs, queries.tokenizer_path())


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secret_scan),
    ("mixing sources to target weights", target_mix),
    ("BPE encoding and decoding", tokenise),
]

#: SQL can express neither the fitted stages nor the tokenizer; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each one's result written and read again before the next."""
    docs = queries.table(spark, sf_dir, "documents").select(*COLUMNS)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = staged(docs, name.replace(" ", "-"))
    return docs
