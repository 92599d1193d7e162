"""Request preparation: prompt extraction (P1), request validation (P2),
prompt hash (P3), previews (P4) and the response document (P9).

Conversations are reduced with aggregates (``max_by``, counts, ``bool_or``)
that combine map-side, never by collecting a conversation's messages into
one array: a conversation with a third of all turns still costs one
partial row per partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import settings as S


def prompt_hash(c: str = "prompt") -> Column:
    """First 16 hex characters of SHA-256 of the full prompt."""
    return F.substring(F.sha2(F.col(c), 256), 1, S.PROMPT_HASH_HEX)


def previews(prompt: str = "prompt", output: str | None = None) -> list[Column]:
    """150-character prompt preview (and 200-character output preview)."""
    cols = [F.substring(F.col(prompt), 1, S.PROMPT_PREVIEW_CHARS).alias("prompt_preview")]
    if output:
        cols.append(F.substring(F.col(output), 1, S.OUTPUT_PREVIEW_CHARS).alias("output_preview"))
    return cols


def extract_prompts(turns: DataFrame, key: str = "conv_id", order: str = "turn",
                    role: str = "role", text: str = "text") -> DataFrame:
    """Per conversation, the last ``user`` message, else the last message."""
    last_user = F.max_by(F.when(F.col(role) == "user", F.col(text)),
                         F.when(F.col(role) == "user", F.col(order)))
    return turns.groupBy(key).agg(
        F.coalesce(last_user, F.max_by(F.col(text), F.col(order))).alias("prompt"))


def validate_requests(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """One row per chat request with defaults filled and a verdict.

    Rules: at least one message, every content non-empty, ``max_tokens`` in
    1..8192 (default 1024), ``temperature`` in 0..2 (default 0.1),
    ``user_id`` default ``default``.  Input: one row per message with the
    request parameters repeated; ``__dropped`` marks a message removed from
    its request (a request left with none has no messages)."""
    kept = F.when(~F.col("__dropped"), F.lit(1))
    agg = turns.groupBy(key).agg(
        F.count(kept).alias("n_messages"),
        F.coalesce(F.bool_or(F.when(~F.col("__dropped"), F.length("content") == 0)), F.lit(False))
        .alias("__empty"),
        F.max_by(F.when(~F.col("__dropped") & (F.col("role") == "user"), F.col("content")),
                 F.when(~F.col("__dropped") & (F.col("role") == "user"), F.col("turn"))).alias("__user_prompt"),
        F.max_by(F.when(~F.col("__dropped"), F.col("content")),
                 F.when(~F.col("__dropped"), F.col("turn"))).alias("__last_prompt"),
        # request parameters repeat on every message: max is the value, and
        # unlike first() it does not depend on row order after a shuffle
        F.max("max_tokens").alias("__mt"),
        F.max("temperature").alias("__temp"),
        F.max("user_id").alias("__uid"),
    )
    mt = F.coalesce(F.col("__mt"), F.lit(S.DEFAULT_MAX_TOKENS))
    temp = F.coalesce(F.col("__temp"), F.lit(S.DEFAULT_TEMPERATURE))
    reason = (F.when(F.col("n_messages") == 0, F.lit("no_messages"))
              .when(F.col("__empty"), F.lit("empty_content"))
              .when((mt < 1) | (mt > S.MAX_TOKENS_LIMIT), F.lit("max_tokens_out_of_range"))
              .when((temp < 0) | (temp > S.MAX_TEMPERATURE), F.lit("temperature_out_of_range")))
    return agg.select(
        key, "n_messages", mt.alias("max_tokens"), temp.alias("temperature"),
        F.coalesce(F.col("__uid"), F.lit(S.DEFAULT_USER_ID)).alias("user_id"),
        F.when(reason.isNull(), F.coalesce(F.col("__user_prompt"), F.col("__last_prompt"))).alias("prompt"),
        F.when(reason.isNull(), F.lit("valid")).otherwise(F.lit("rejected")).alias("status"),
        reason.alias("reject_reason"))


def response_documents(log: DataFrame) -> DataFrame:
    """Each request as one JSON document with the derived fields
    (ISO timestamp, total tokens, savings USD / %)."""
    b, c = F.col("cost_if_highest_quality"), F.col("cost_usd")
    doc = F.struct(
        F.col("id").alias("request_id"), F.col("routed_model").alias("model_id"),
        "input_tokens", "output_tokens", (F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens"),
        "latency_ms", c.cast("double").alias("cost_usd"), b.cast("double").alias("cost_if_highest_quality"),
        (b - c).cast("double").alias("savings_usd"),
        F.when(b == 0, F.lit(0.0)).otherwise(F.round((b - c) / b * 100, 2).cast("double")).alias("savings_pct"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"))
    return log.select("id", F.to_json(doc).alias("document"))
