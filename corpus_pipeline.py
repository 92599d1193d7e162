"""The corpus pipeline: five stages from ``documents`` to token ids.

Each stage is a function of (spark, docs, sf_dir) that returns a DataFrame; its
rows are written as Parquet and read again as the next stage's documents.  A
lost executor therefore costs at most the stage that is running.

Python workers get texts in Arrow batches of ``BATCH_ROWS`` rows, so their
memory does not grow with Spark's default of 10,000 whole texts.  The setting
stays in the session, since a stage's rows are computed when they are written.

Null texts are kept up to the last stage, where they have no ids.  Further
columns are carried along.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptledger.llm import decontamination, disclosure, jaccard_join, sentencepiece_backend, toxicity_cnn
from promptledger.llm.storage import written
from promptledger.sources.tables import read_table


BATCH_ROWS = 1_000
BATCHES = "spark.sql.execution.arrow.maxRecordsPerBatch"


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject."""
    spark.conf.set(BATCHES, BATCH_ROWS)
    return toxicity_cnn.clean(docs, read_table(spark, sf_dir, "labels", "doc_id", "toxic"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.8 or more on five-word shingles."""
    spark.conf.set(BATCHES, BATCH_ROWS)
    return jaccard_join.distinct_documents(docs, k=5, num=80, den=100)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage of a benchmark item."""
    return decontamination.clean(docs, read_table(spark, sf_dir, "benchmark", "item_id", "text"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and the terms that disclose it replaced in the text."""
    out = disclosure.sanitise(docs)
    return out.withColumn("n_chars", F.length("text").cast(out.schema["n_chars"].dataType)) if "n_chars" in out.columns else out


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with the check that they decode to it."""
    spark.conf.set(BATCHES, BATCH_ROWS)
    import public_tokenizers
    keep = [c for c in docs.columns if c != "text"]
    return sentencepiece_backend.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), keep)


STAGES = [
    ("toxicity", toxicity),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark),
    ("PII", personal_data),
    ("SentencePiece encoding and decoding", encoding),
]

ORACLE_SQL = None  # trained and iterative stages; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "pipeline-" + "".join(c if c.isalnum() else "-" for c in name.lower()))
    return docs
