"""Sinks K1-K6: append-only Parquet tables and CSV reports.

Appends go through Spark's commit protocol (a task retried after an
executor loss does not leave partial files), partitioned by ``day`` where
reports prune by date.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import settings as S
from .prompts import prompt_hash

REQUEST_COLUMNS = ["id", "ts", "day", "user_id", "prompt_hash", "prompt_preview", "complexity_tier",
                   "classifier_conf", "low_confidence", "routed_model", "provider", "input_tokens",
                   "output_tokens", "cost_usd", "cost_if_highest_quality", "latency_ms", "output_preview"]


def request_rows(df: DataFrame) -> DataFrame:
    """K1 projection: hash of the full prompt, 150 / 200-character previews,
    classifier fields null when absent, ``low_confidence`` false when absent.
    A ``prompt_hash`` / ``prompt_preview`` computed upstream is kept as is."""
    cols = set(df.columns)

    def opt(c, typ):
        return F.col(c) if c in cols else F.lit(None).cast(typ)
    return df.select(
        "id", "ts", F.to_date("ts").alias("day"),
        F.coalesce(opt("user_id", "string").cast("string"), F.lit(S.DEFAULT_USER_ID)).alias("user_id"),
        (F.col("prompt_hash") if "prompt_hash" in cols else prompt_hash("prompt")).alias("prompt_hash"),
        (F.col("prompt_preview") if "prompt_preview" in cols
         else F.substring("prompt", 1, S.PROMPT_PREVIEW_CHARS)).alias("prompt_preview"),
        opt("complexity_tier", "int").alias("complexity_tier"),
        opt("classifier_conf", "double").alias("classifier_conf"),
        F.coalesce(opt("low_confidence", "boolean"), F.lit(False)).alias("low_confidence"),
        "routed_model", opt("provider", "string").alias("provider"),
        "input_tokens", "output_tokens", "cost_usd", "cost_if_highest_quality", "latency_ms",
        F.substring(opt("output_text", "string"), 1, S.OUTPUT_PREVIEW_CHARS).alias("output_preview"))


def append_requests(df: DataFrame, path: str) -> None:
    """K1: append to the request log, partitioned by day."""
    request_rows(df).write.mode("append").partitionBy("day").parquet(path)


def baseline_rows(runs: DataFrame) -> DataFrame:
    """K3 projection: previews cut to 150 / 200 characters."""
    return runs.select(
        "*", F.substring("prompt", 1, S.PROMPT_PREVIEW_CHARS).alias("prompt_preview"),
        F.substring(F.coalesce("output_text", F.lit("")), 1, S.OUTPUT_PREVIEW_CHARS).alias("output_preview")
    ).drop("prompt", "output_text")


def write_csv(df: DataFrame, path: str) -> None:
    """K5 / K6: a report as CSV with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)
