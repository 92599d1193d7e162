"""Failure detection and escalation: V6-V10, J11, K2, K8 / J4.

All decisions are column predicates over one row; the only shuffle is the
id join to the re-run completions (J11), a sort-merge join of two fact
tables partitioned on the request id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import token_cost
from ..settings import DEFAULT_THRESHOLDS, Thresholds
from ..sources import config_tables as ct
from .costs import baseline_prices


def is_routing_failure(score: str = "quality_score", gap: str = "quality_gap",
                       t: Thresholds = DEFAULT_THRESHOLDS) -> Column:
    """V6: gap > threshold or cheap score < minimum (both strict)."""
    return (F.col(gap) > F.lit(float(t.gap_threshold))) | (F.col(score) < F.lit(float(t.min_cheap_score)))


def corrected_tier(tier: str = "complexity_tier", gap: str = "quality_gap",
                   t: Thresholds = DEFAULT_THRESHOLDS) -> Column:
    """V7: min(3, tier + (2 if gap > bump cut-off else 1))."""
    bump = F.when(F.col(gap) > F.lit(float(t.bump_gap)), F.lit(2)).otherwise(F.lit(1))
    return F.least(F.lit(3), F.col(tier) + bump).cast("int")


def decide(df: DataFrame, score: str = "quality_score", gap: str = "quality_gap",
           elapsed: str = "latency_ms", t: Thresholds = DEFAULT_THRESHOLDS) -> DataFrame:
    """V8: add ``decision``.

    null / sentinel score, or null gap with a score that is no failure by
    itself -> unverified; not a failure -> routing_correct;
    failure with ``budget - elapsed < reserve`` (strict) ->
    latency_budget_exhausted; else escalate."""
    q = F.col(score)
    remaining = F.lit(float(t.budget_ms)) - F.col(elapsed)
    low = q < F.lit(float(t.min_cheap_score))
    decision = (F.when(q.isNull() | (q < 0) | (F.col(gap).isNull() & ~low), F.lit("unverified"))
                .when(~F.coalesce(is_routing_failure(score, gap, t), low), F.lit("routing_correct"))
                .when(remaining < F.lit(float(t.reserve_ms)), F.lit("latency_budget_exhausted"))
                .otherwise(F.lit("escalate")))
    return df.withColumn("decision", decision)


def routing_failures(decided: DataFrame, t: Thresholds = DEFAULT_THRESHOLDS) -> DataFrame:
    """K2: one failure row per failed routing (both failure branches log),
    with the reason that the judge gave (null if none)."""
    failed = decided.where(F.col("decision").isin("escalate", "latency_budget_exhausted"))
    return failed.select(
        F.col("id").alias("request_id"),
        F.col("ts"),
        F.col("complexity_tier").alias("classified_tier"),
        corrected_tier("complexity_tier", "quality_gap", t).alias("correct_tier"),
        F.col("quality_gap"),
        F.col("judge_reason").alias("failure_reason"),
    )


def escalation_reason(gap: str = "quality_gap", score: str = "quality_score") -> Column:
    """``quality_gap=%.1f cheap_score=%.1f``."""
    return F.format_string("quality_gap=%.1f cheap_score=%.1f", F.col(gap), F.col(score))


def escalation_outcomes(decided: DataFrame, completions: DataFrame, registry: DataFrame) -> DataFrame:
    """Outcome of every request, in one pass and one join.

    Escalations are matched to the best model's re-run.  A match escalates
    with the re-run's full cost as ``cost_delta_usd``; no match is a failed
    re-run.  Other decisions are not escalated with a zero delta.  A request
    with several re-runs (a replayed completion) counts once, at the highest
    cost, so no cost is hidden.

    Requests that are not escalated join on a key of their own that no re-run
    has, so they spread over all partitions and match nothing."""
    facts = ct.registry_facts(registry)
    best_key = F.lit(facts.best_key).cast("string")
    best_id = F.lit(facts.best_id).cast("string")
    bin_, bout = baseline_prices(facts)
    reruns = (completions.where(F.col("model_key") == best_key)
              .select(F.col("prompt_id").alias("id"),
                      token_cost("input_tokens", "output_tokens", bin_, bout).alias("__cost"))
              .groupBy(F.struct(F.lit(True).alias("esc"), F.col("id")).alias("__key"))
              .agg(F.max("__cost").alias("__rerun_cost")))
    wanted = F.col("decision") == "escalate"
    keyed = decided.withColumn("__key", F.struct(wanted.alias("esc"), F.col("id")))
    ok = F.col("__rerun_cost").isNotNull()
    return keyed.join(reruns, "__key", "left").select(
        *[F.col(c) for c in decided.columns],
        ok.alias("escalated"),
        F.when(ok, best_id).alias("escalated_model"),
        F.coalesce(F.col("__rerun_cost"), F.lit(0).cast("decimal(18,8)")).alias("cost_delta_usd"),
        F.when(ok, escalation_reason()).when(wanted, F.lit("escalation_api_failed"))
        .otherwise(F.col("decision")).alias("reason"),
    )


def merge_escalations(requests: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Requests left-joined to their escalation outcome;
    ``escalated`` defaults to false and ``cost_delta_usd`` to 0.

    A request with several outcomes takes the latest by ``escalated_at``
    where there is such a column; of equals (or without it) the escalated and
    dearest one."""
    when = F.col("escalated_at") if "escalated_at" in outcomes.columns else F.lit(None).cast("timestamp")
    last = F.max(F.struct(when.alias("t"), "escalated", F.col("cost_delta_usd").alias("delta"), F.col("escalated_model").alias("model")))
    o = outcomes.groupBy("id").agg(last.alias("__o")).select(
        "id", F.col("__o.escalated").alias("__esc"), F.col("__o.model").alias("escalated_model"), F.col("__o.delta").alias("__delta"))
    j = requests.drop("escalated", "escalated_model", "cost_delta_usd").join(o, "id", "left")
    return j.select(
        *[F.col(c) for c in requests.columns if c not in ("escalated", "escalated_model", "cost_delta_usd")],
        F.coalesce(F.col("__esc"), F.lit(False)).alias("escalated"),
        F.col("escalated_model"),
        F.coalesce(F.col("__delta"), F.lit(0).cast("decimal(18,8)")).alias("cost_delta_usd"),
    )
