"""The registered queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from promptledger.llm import (centroids, decontamination, disclosure, host_trust, jaccard_join, periodic_runs, pitman_yor, quality_forest, repeats,
                              sentencepiece_backend, source_mix, token_store, toxicity_cnn)
from promptledger.llm.storage import folder
from promptledger.sources.tables import read_table


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded into a token store and read back through its index."""
    import public_tokenizers
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    at = folder(spark, "token-store")
    token_store.write(docs, at, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return token_store.read(docs, at)


def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the 100-byte strings that also start earlier."""
    return repeats.digest(read_table(spark, sf_dir, "documents", "doc_id", "text"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of 3-word shingles have a Jaccard similarity of 0.9 or more."""
    return jaccard_join.grouped(read_table(spark, sf_dir, "documents", "doc_id", "text"), k=3, num=90, den=100)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded with the rebuilt SentencePiece model, with parity and round trip."""
    import public_tokenizers
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return sentencepiece_backend.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), ["doc_id"], with_ids=False)


def op5_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document, and the terms that disclose it."""
    return disclosure.judge(read_table(spark, sf_dir, "documents", "doc_id", "text"))


def op6_quality_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule statistics and the isolation forest's verdict on every document."""
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    found = quality_forest.judge(docs, read_table(spark, sf_dir, "labels", "doc_id", "quality"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                        "base_failed", "kept", "anomaly")


def op7_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document under a hierarchical Pitman-Yor model of the training fold."""
    return pitman_yor.score(read_table(spark, sf_dir, "documents", "doc_id", "text"))


def op8_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return toxicity_cnn.judge(docs, read_table(spark, sf_dir, "labels", "doc_id", "toxic")).drop("key")


URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op9_host_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url by rules, then by trust and distrust of its host."""
    pages = read_table(spark, sf_dir, "pages", "page_id", "url", "html")
    return host_trust.judge(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside an occurrence of a benchmark window."""
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return decontamination.judge(docs, read_table(spark, sf_dir, "benchmark", "item_id", "text"))


def op11_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of all documents by source weights takes of every document."""
    return source_mix.digest(read_table(spark, sf_dir, "documents", "doc_id", "source", "text"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster and distance of every embedding after ten exact rounds."""
    return centroids.digest(read_table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document, and its text without their repetitions."""
    return periodic_runs.digest(read_table(spark, sf_dir, "documents", "doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_store": op1_token_store,
    "op2_repeats": op2_repeats,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_disclosure": op5_disclosure,
    "op6_quality_forest": op6_quality_forest,
    "op7_pitman_yor": op7_pitman_yor,
    "op8_toxicity_cnn": op8_toxicity_cnn,
    "op9_host_trust": op9_host_trust,
    "op10_decontamination": op10_decontamination,
    "op11_source_mix": op11_source_mix,
    "op12_centroids": op12_centroids,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLE: dict[str, str] = {
    "op3_jaccard_join": jaccard_join.sql(k=3, num=90, den=100),
    "op9_host_trust": "select page_id, host, path, \"rule\", verdict from (" + host_trust.sql(URL_RULES) + ")",
    "op10_decontamination": decontamination.sql(),
    "op11_source_mix": source_mix.sql(),
    "op12_centroids": centroids.sql(),
}
