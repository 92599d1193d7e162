"""Routing: tier -> model (J1), low confidence (R1), choice (R2), unknown
model fallback (J2), patch validation / application (R3, R4, J8) and
replay under a patched mapping (R5).

Config tables are bounded (one row per tier / setting / model) and are
broadcast; one-row config values (threshold, fallback, cheapest model)
are read once while the plan is built and folded in as literals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import config_tables as ct


def route(df: DataFrame, settings: DataFrame, tier_col: str = "complexity_tier",
          conf_col: str = "classifier_conf") -> DataFrame:
    """R1 + R2 + J1: add ``low_confidence`` and ``routed_model``.

    Low confidence is ``conf < threshold`` (strict); it selects the fallback
    model, otherwise the tier's model (left join: an unmapped tier gives
    null, which pricing resolves through J2)."""
    facts = ct.routing_facts(settings)             # size-checked before the broadcast
    threshold = F.lit(facts.threshold).cast("double")
    fallback = F.lit(facts.fallback).cast("string")
    rules = ct.routing_rules(settings).select(F.col("tier").alias("__rt_tier"), F.col("model_key").alias("__rt_model"))
    joined = df.join(F.broadcast(rules), F.col(tier_col) == F.col("__rt_tier"), "left")
    low = F.col(conf_col) < threshold
    return joined.select(
        *[F.col(c) for c in df.columns],
        low.alias("low_confidence"),
        F.when(low, fallback).otherwise(F.col("__rt_model")).alias("routed_model"),
    )


def resolve_model(df: DataFrame, registry: DataFrame, model_col: str = "routed_model",
                  facts: ct.RegistryFacts | None = None) -> DataFrame:
    """Keep a model key found in the registry, else (unknown or null) the
    cheapest model."""
    keys = registry.select(F.col("model_key").alias("__known"))
    cheapest = F.lit((facts or ct.registry_facts(registry)).cheapest_key).cast("string")
    j = df.join(F.broadcast(keys), F.col(model_col) == F.col("__known"), "left")
    found = F.coalesce(F.col("__known"), cheapest).alias(model_col)
    return j.select(*[found if c == model_col else F.col(c) for c in df.columns])


def patch_violations(patch: DataFrame, registry: DataFrame) -> DataFrame:
    """Rows of a routing patch that would be rejected.

    ``*_model`` values must be registry keys (left anti join against the
    registry); the threshold must be a number in [0, 1]; an empty patch is
    one violation of its own."""
    ct.registry_facts(registry)                      # size-checked before the broadcast
    keys = registry.select(F.col("model_key").alias("value"))
    models = patch.where(F.col("key").endswith("_model"))
    unknown = (models.join(F.broadcast(keys), "value", "left_anti")
               .select("key", "value", F.lit("unknown_model").alias("reason")))
    thr = F.col("value").try_cast("double")
    bad_thr = (patch.where((F.col("key") == "low_confidence_threshold")
                           & (thr.isNull() | (thr < 0) | (thr > 1)))
               .select("key", "value", F.lit("threshold_out_of_range").alias("reason")))
    empty = (patch.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == 0)
             .select(F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("value"),
                     F.lit("empty_patch").alias("reason")))
    return unknown.unionByName(bad_thr).unionByName(empty)


def apply_patch(settings: DataFrame, patch: DataFrame) -> DataFrame:
    """Supplied keys override, the rest is kept; of a key supplied twice the greatest value counts.

    Both tables are bounded config, so the result is an inline table again
    and reading it launches no job."""
    def rows(df: DataFrame, what: str) -> list:
        return sorted((r["key"], r["value"]) for r in ct.config_rows(df.select("key", "value"), ct.MAX_CONFIG_ROWS, what)
                      if r["key"] is not None and r["value"] is not None)

    merged = dict(rows(settings, "routing settings")) | dict(rows(patch, "routing patch"))
    return ct.local_table(settings.sparkSession, sorted(merged.items()), ct.SETTINGS_SCHEMA)
