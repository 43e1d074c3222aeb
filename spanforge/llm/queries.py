"""The subpackage's registered queries and, where SQL can express one, its DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles
from .ann import search
from .common import table, utf8_size
from .decontamination import covered, hit_items, phrase_matches
from .html_text import extract_pages
from .minhash import near_duplicates
from .sentencepiece_codec import encode_documents
from .sharding import histogram_sort_shards
from .token_counts import token_counts
from .substring_dedup import shared_passages
from .toxicity import THRESHOLD, fit, held_out, score_toxicity
from .warc import archive, read_bundles

N_SHARDS = 40


def op3_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of nearly equal bytes, in doc_id order."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    size = utf8_size(F.col("text")) + 16
    sharded = histogram_sort_shards(docs, N_SHARDS, "doc_id", size)
    crc = F.crc32(F.encode("text", "UTF-8"))
    return sharded.select("doc_id", size.alias("size"), crc.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact token-length histogram of all documents with its suffix sums."""
    return token_counts(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which words of every document stand in a 10-word window of a benchmark item."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = phrase_matches(docs, table(spark, sf_dir, "benchmark"))
    items, n_hit = hit_items(F.col("hits")), covered(F.col("hits")).cast("long")
    return found.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a WARC record in seekable bundles, read back from the archives."""
    index, _ = archive(spark, table(spark, sf_dir, "pages"), "page_id", "url", "html")
    number = lambda c: F.nullif(F.col(c), F.lit("")).cast("long")
    return read_bundles(index).select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate component of every document at a similarity of 0.85 over 5-word shingles."""
    return near_duplicates(table(spark, sf_dir, "documents"), n=5, percent=85)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity score of every document, by a model of the labels that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    scored = score_toxicity(docs, fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest vectors found for every vector whose id is divisible by 50."""
    return search(table(spark, sf_dir, "embeddings"), k=5, every=50)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of 50 words or more that repeats a passage of an earlier document."""
    return shared_passages(table(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SentencePiece ids of every document, decoded again as a check."""
    return encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


QUERIES = (
    op1_substring_dedup, op2_sentencepiece, op3_histogram_sort, op4_warc, op5_minhash, op6_ann, op7_html_text, op8_token_counts, op9_toxicity,
    op10_decontamination,
)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op3_histogram_sort": oracles.SHARDS, "op5_minhash": oracles.NEAR_DUPLICATES, "op4_warc": oracles.WARC, "op10_decontamination": oracles.DECONTAMINATION}
