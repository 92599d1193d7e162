"""The completion flow: a validated prompt is featurised, scored, routed,
priced and becomes a row of the request log (P1, P2, F, M14, R1, R2, J2, C1,
K1).

Every step is a projection or a join with a size-checked config table, so the
same chain runs on a batch and on a stream.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import settings as S
from ..functions.text import add_features, token_estimates
from ..sources import config_tables as ct
from . import sinks
from .costs import price_requests
from .routing import resolve_model, route

Scorer = Callable[[DataFrame], DataFrame]  # adds complexity_tier and classifier_conf to featurised rows


def from_messages(requests: DataFrame) -> DataFrame:
    """P1 + P2 on requests that carry their messages as an array of
    (role, content): the prompt (last user message, else the last one), the
    parameters with defaults, and status / reject_reason."""
    m = F.coalesce(F.col("messages"), F.array().cast(requests.schema["messages"].dataType))
    users = F.filter(m, lambda x: x["role"] == "user")
    mt = F.coalesce("max_tokens", F.lit(S.DEFAULT_MAX_TOKENS))
    temp = F.coalesce("temperature", F.lit(S.DEFAULT_TEMPERATURE))
    empty = F.exists(m, lambda x: F.coalesce(F.length(x["content"]), F.lit(0)) == 0)
    reason = (F.when(F.size(m) == 0, F.lit("no_messages")).when(empty, F.lit("empty_content"))
              .when((mt < 1) | (mt > S.MAX_TOKENS_LIMIT), F.lit("max_tokens_out_of_range"))
              .when((temp < 0) | (temp > S.MAX_TEMPERATURE), F.lit("temperature_out_of_range")))
    prompt = F.coalesce(F.try_element_at(users, F.lit(-1)), F.try_element_at(m, F.lit(-1)))["content"]
    return requests.select(
        *[c for c in requests.columns if c not in ("messages", "max_tokens", "temperature", "user_id")],
        mt.alias("max_tokens"), temp.alias("temperature"), F.coalesce("user_id", F.lit(S.DEFAULT_USER_ID)).alias("user_id"),
        F.when(reason.isNull(), prompt).alias("prompt"), F.when(reason.isNull(), F.lit("valid")).otherwise(F.lit("rejected")).alias("status"),
        reason.alias("reject_reason"))


def complete(valid: DataFrame, score: Scorer, registry: DataFrame, settings: DataFrame) -> DataFrame:
    """Routed and priced requests of ``valid(prompt, max_tokens, ...)``.

    ``score`` is a fitted classifier or any other source of tier and
    confidence.  Input tokens are the estimate of the prompt, output tokens
    are ``output_tokens`` if the rows have it (a finished completion), else
    the budget ``max_tokens``."""
    scored = score(add_features(valid)).drop(*S.FEATURE_NAMES)
    facts = ct.registry_facts(registry)
    routed = resolve_model(route(scored, settings), registry, facts=facts)
    spent = F.col("output_tokens") if "output_tokens" in valid.columns else F.col("max_tokens")
    estimate = token_estimates("prompt")[0]
    sized = routed.withColumns({"input_tokens": estimate.cast("bigint"), "output_tokens": spent.cast("bigint")})
    return price_requests(sized, registry, facts=facts)


def by_model(model, threshold: float = S.ROUTING["low_confidence_threshold"]) -> Scorer:
    """Scorer of a fitted (calibrated) classifier."""
    from .classifier import score

    def run(rows: DataFrame) -> DataFrame:
        out = score(model, rows, threshold).drop("low_confidence")
        return out.withColumnsRenamed({"predicted": "complexity_tier", "confidence": "classifier_conf"})

    return run


def request_rows(completed: DataFrame, registry: DataFrame) -> DataFrame:
    """K1 rows of completed requests, with the provider of the routed model."""
    keys = registry.select(F.col("model_key").alias("routed_model"), "provider")
    return sinks.request_rows(completed.join(F.broadcast(keys), "routed_model", "left"))
