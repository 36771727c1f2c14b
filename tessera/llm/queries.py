"""Registered queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import (
    byte_repeats,
    decontaminate,
    html_content,
    language_id,
    merkle,
    mixing,
    ngram_join,
    pii,
    quality,
    secret_scan,
    sharding,
    substrings,
    whitening,
)
from tessera.llm.tables import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f
    return register


@query()
def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document inside an occurrence of a 10-word benchmark window."""
    found = decontaminate.scan(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
        "longest")


@query()
def op10_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule ledger of every document and the current policy's verdict."""
    book = quality.apply_policy(quality.ledger(read(spark, sf_dir, "documents")))
    base = F.col("failed").bitwiseAND(F.lit(quality.BASE.mask)) != 0
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       base.alias("base_failed"), (~base & F.col("kept")).alias("kept"), "failed")


@query()
def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of each document under 3-word-shingle similarity 0.9."""
    return ngram_join.near_duplicates(read(spark, sf_dir, "documents"))


@query()
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document left after removing 13-word windows that start in a smaller document."""
    left = substrings.deduplicate(read(spark, sf_dir, "documents"), with_text=False)
    return left.withColumnRenamed("kept", "kept_sha256")


@query()
def op2_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uniform shuffle of all documents into 40 shards whose counts are at most one apart."""
    docs = read(spark, sf_dir, "documents").select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    return sharding.shuffle(docs).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query()
def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every document in the mix of sources, and whether it lies before the horizon."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", F.xxhash64("text").alias("text"))
    return mixing.mix(docs).select("doc_id", "source", "block", "slot", "place", "kept")


@query()
def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: matches of the fixed patterns, and tokens that pass the randomness battery."""
    found = secret_scan.scan(read(spark, sf_dir, "documents"))
    kinds = secret_scan.KINDS
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in kinds],
        F.sha2(secret_scan.span_list(kinds), 256).alias("base_sha256"), secret_scan.span_list((*kinds, "random")).alias("spans"))


@query()
def op4_html_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_content.extract(read(spark, sf_dir, "pages"))


@query()
def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: matches of the fixed patterns, and mentions found by context."""
    found = pii.extract(read(spark, sf_dir, "documents"))
    count = [F.size(F.expr(f"filter(spans, s -> s.kind = {i})")).cast("long").alias(f"n_{k}") for i, k in enumerate(pii.KINDS)]
    return found.select("doc_id", *count, F.sha2(pii.span_list("spans"), 256).alias("base_sha256"), pii.span_list("spans", "found").alias("spans"))


@query()
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, by family first and then within it."""
    docs = read(spark, sf_dir, "documents")
    return language_id.predict(docs, language_id.fit(docs))


@query(merkle.oracle())
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document, and the root that the proof gives for half of them tampered with."""
    altered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    torn = F.when(altered, merkle.leaf({"text": F.translate("text", "\n", "")}))
    tree = merkle.manifest(read(spark, sf_dir, "documents"), torn)
    folded = tree.withColumn("folded_root", merkle.fold(F.coalesce("other", "leaf")))
    return folded.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.proof_text().cast("binary"), 256).alias("proof_sha256"),
                         "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


@query()
def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened coordinates of every embedding on the first 16 components."""
    rows = whitening.usable(read(spark, sf_dir, "embeddings"))
    return whitening.whiten(rows, whitening.fit(rows))


@query()
def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of each document left after removing 400-byte strings that start more than once."""
    left = byte_repeats.deduplicate(read(spark, sf_dir, "documents"), with_text=False)
    return left.withColumnRenamed("kept", "kept_sha256")
