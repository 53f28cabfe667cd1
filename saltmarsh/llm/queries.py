"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saltmarsh.llm import oracles
from saltmarsh.llm._store import new_path
from saltmarsh.llm.decontamination import find_contained
from saltmarsh.llm.doc_fingerprints import version_likeness
from saltmarsh.llm.embedding_dedup import embedding_links
from saltmarsh.llm.filter_audit import audit_filters
from saltmarsh.llm.html_extract import extract_text
from saltmarsh.llm.ngram_join import ngram_classes
from saltmarsh.llm.sentencepiece_codec import encoded_documents
from saltmarsh.llm.sharding import assign_shards
from saltmarsh.llm.substring_dedup import repeated_passages
from saltmarsh.llm.token_alignment import aligned_documents
from saltmarsh.llm.toxicity import held_out, score, train
from saltmarsh.llm.url_filter import judge_urls
from saltmarsh.llm.warc import read_warc, write_warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links(_table(spark, sf_dir, "embeddings"), cosine=0.98)


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_classes(_table(spark, sf_dir, "documents"), k=4, percent=85)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_warc(_table(spark, sf_dir, "pages"), path, min_bytes=0)
    return read_warc(spark, path, with_payload=False).select(
        F.col("source_id").cast("long").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
        "intact",
    )


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(_table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(_table(spark, sf_dir, "documents"), 16)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contained(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = train(docs, labels.filter(~held_out()))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded_documents(spark, _table(spark, sf_dir, "documents"))


URL_RULES = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(_table(spark, sf_dir, "pages"), URL_RULES)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return version_likeness(_table(spark, sf_dir, "documents"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned_documents(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding_dedup": op1_embedding_dedup,
    "op2_ngram_join": op2_ngram_join,
    "op3_warc": op3_warc,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_sharding": op5_sharding,
    "op6_decontamination": op6_decontamination,
    "op7_toxicity": op7_toxicity,
    "op8_html_text": op8_html_text,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_url_filter": op10_url_filter,
    "op11_filter_audit": op11_filter_audit,
    "op12_document_fingerprints": op12_document_fingerprints,
    "op13_token_alignment": op13_token_alignment,
}

ORACLES: dict[str, str] = {
    "op2_ngram_join": oracles.OP2,
    "op6_decontamination": oracles.OP6,
    "op11_filter_audit": oracles.OP11,
}
