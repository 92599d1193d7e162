"""Cost math C1-C8 in exact decimals.

Prices come from the registry through a broadcast hash join on the model
key; the best-model (baseline) and cheapest-model prices are read from the
registry while the plan is built (no job for an inline registry) and folded
in as literals.  No fact-table shuffle happens here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import token_cost
from ..sources import config_tables as ct


def best_model(registry: DataFrame) -> DataFrame:
    """Among ``quality_tier = 'high'`` the highest input + output price
    (ties: the first in registry order).  One row (empty registry: nulls)."""
    high = registry.where(F.col("quality_tier") == "high")
    order = F.struct((F.col("cost_per_1k_input_usd") + F.col("cost_per_1k_output_usd")),
                     -F.col("registry_order"))
    best = high.agg(F.max_by(F.struct(*registry.columns), order).alias("b"))
    return best.select("b.*")


def baseline_prices(facts: ct.RegistryFacts) -> tuple[Column, Column]:
    """C3 prices: the best model's per-token prices as literals."""
    return ct.price_literal(facts.best_in), ct.price_literal(facts.best_out)


def price_requests(df: DataFrame, registry: DataFrame, model_col: str = "routed_model",
                   in_col: str = "input_tokens", out_col: str = "output_tokens",
                   facts: ct.RegistryFacts | None = None) -> DataFrame:
    """C1 + C3 (+ J2): add ``cost_usd`` and ``cost_if_highest_quality``.

    One broadcast hash join of the registry on the model key gives the
    prices; a key missing from the registry is priced as the cheapest
    model (J2, its prices are literals).  The baseline is never
    null: the same tokens at the best model's prices.  ``facts`` are the
    registry's, if they were read already.
    """
    prices = registry.select(F.col("model_key").alias("__pm"),
                             F.col("price_in_per_token").alias("__pin"),
                             F.col("price_out_per_token").alias("__pout"))
    facts = facts or ct.registry_facts(registry)   # size-checked before the broadcast
    c_in, c_out = ct.price_literal(facts.cheapest_in), ct.price_literal(facts.cheapest_out)
    j = df.join(F.broadcast(prices), F.col(model_col) == F.col("__pm"), "left")
    bin_, bout = baseline_prices(facts)
    cols = [F.col(c) for c in df.columns]
    return j.select(
        *cols,
        token_cost(F.col(in_col), F.col(out_col), F.coalesce(F.col("__pin"), c_in),
                   F.coalesce(F.col("__pout"), c_out)).alias("cost_usd"),
        token_cost(F.col(in_col), F.col(out_col), bin_, bout).alias("cost_if_highest_quality"),
    )


def savings_columns(cost: str = "cost_usd", base: str = "cost_if_highest_quality",
                    pct_places: int = 2) -> list[Column]:
    """C4 savings USD (8 places), C5 savings % (0.0 when the baseline is 0)."""
    c, b = F.col(cost), F.col(base)
    pct = F.when(b == 0, F.lit(0.0)).otherwise(
        F.round((b - c) / b * F.lit(100), pct_places).cast("double"))
    return [(b - c).cast("double").alias("savings_usd"), pct.alias("savings_pct")]


def judge_costs(verdicts: DataFrame, registry: DataFrame) -> DataFrame:
    """Price each judge call (judge tokens at the best model's prices)."""
    bin_, bout = baseline_prices(ct.registry_facts(registry))
    return verdicts.select(
        "*", token_cost(F.col("judge_input_tokens"), F.col("judge_output_tokens"), bin_, bout)
        .alias("judge_cost_usd"))
