"""Config as DataFrames (S3 registry, S4 routing rules, S5 tiers).

Config tables are tiny and bounded by construction (one row per model,
tier or setting), so they are the only things this package broadcasts.
"""

from __future__ import annotations

import re
from decimal import Decimal
from typing import NamedTuple

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import settings as S

PRICE_1K = T.DecimalType(18, 8)
PRICE_TOKEN = T.DecimalType(18, 12)

REGISTRY_SCHEMA = T.StructType([
    T.StructField("model_key", T.StringType(), False),
    T.StructField("provider", T.StringType(), False),
    T.StructField("model_id", T.StringType(), False),
    T.StructField("cost_per_1k_input_usd", PRICE_1K, False),
    T.StructField("cost_per_1k_output_usd", PRICE_1K, False),
    T.StructField("quality_tier", T.StringType(), False),
    T.StructField("avg_latency_ms", T.IntegerType(), False),
    T.StructField("display_name", T.StringType(), False),
    T.StructField("registry_order", T.IntegerType(), False),
])


def _sql_literal(v, dtype: T.DataType) -> str:
    if v is None:
        return f"CAST(NULL AS {dtype.simpleString()})"
    if isinstance(dtype, T.StringType):
        return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(dtype, T.BooleanType):
        return "true" if v else "false"
    return f"CAST('{v}' AS {dtype.simpleString()})"


def local_table(spark: SparkSession, rows: list[tuple], schema: T.StructType) -> DataFrame:
    """A small driver-side table as an inline ``VALUES`` relation.

    It plans as a ``LocalTableScan`` (no Python worker, no RDD), folds into
    scalar subqueries cheaply and broadcasts for free."""
    names = [f.name for f in schema.fields]
    if rows:
        values = ", ".join("(" + ", ".join(_sql_literal(v, f.dataType) for v, f in zip(r, schema.fields)) + ")"
                           for r in rows)
        return spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(names)})")
    nulls = ", ".join(f"{_sql_literal(None, f.dataType)} AS {f.name}" for f in schema.fields)
    return spark.sql(f"SELECT {nulls} WHERE false")


# a registry has one row per model; broadcasting beyond this is refused
MAX_REGISTRY_ROWS = 10_000


def config_row(df: DataFrame):
    """The row of a one-row config aggregate (best model, cheapest model,
    routing thresholds), read once while the plan is built.

    The value is folded into the fact-table plan as a literal, so running a
    report launches no extra job per config value (a scalar subquery would
    run one on every execution).  Only config tables are read this way; the
    input is bounded by construction and a second row is an error."""
    rows = df.limit(2).collect()
    if len(rows) > 1:
        raise ValueError("config aggregate returned more than one row")
    return rows[0] if rows else None


# routing settings / rules have one row per setting; broadcasting beyond this is refused
MAX_CONFIG_ROWS = 10_000


def check_bound(n, limit: int, what: str) -> None:
    """Refuse to broadcast a config table with more than ``limit`` rows."""
    if n is not None and n > limit:
        raise ValueError(f"{what} has {n} rows, more than {limit}; not broadcast")


def config_rows(df: DataFrame, limit: int, what: str) -> list[Row]:
    """All rows of a config table; more than ``limit`` are refused.

    Projections over inline ``VALUES`` fold to a local relation while they
    are planned, so reading such a table launches no job; a config table
    kept elsewhere costs one."""
    rows = df.limit(limit + 1).collect()
    check_bound(len(rows), limit, what)
    return rows


class RegistryFacts(NamedTuple):
    """What pricing and routing need of a registry besides its rows (None: no such model)."""

    cheapest_key: str | None = None
    cheapest_in: Decimal | None = None
    cheapest_out: Decimal | None = None
    best_key: str | None = None
    best_id: str | None = None
    best_in: Decimal | None = None
    best_out: Decimal | None = None


def registry_facts(registry: DataFrame) -> RegistryFacts:
    """One read of the registry, size-checked before anything broadcasts it:
    the cheapest model by input price (J2's fallback) and the best one (C2:
    of high quality, the highest input + output price), ties by registry order."""
    rows = config_rows(registry.select("model_key", "model_id", "quality_tier", "cost_per_1k_input_usd", "cost_per_1k_output_usd",
                                       "registry_order", "price_in_per_token", "price_out_per_token"), MAX_REGISTRY_ROWS, "model registry")
    if not rows:
        return RegistryFacts()
    cheap = min(rows, key=lambda r: (r["cost_per_1k_input_usd"], r["registry_order"]))
    best = max((r for r in rows if r["quality_tier"] == "high"),
               key=lambda r: (r["cost_per_1k_input_usd"] + r["cost_per_1k_output_usd"], -r["registry_order"]), default=None)
    return RegistryFacts(cheap["model_key"], cheap["price_in_per_token"], cheap["price_out_per_token"],
                         *((best["model_key"], best["model_id"], best["price_in_per_token"], best["price_out_per_token"]) if best else ()))


def price_literal(v) -> "F.Column":
    """A per-token price as a DECIMAL(18,12) literal (null stays null)."""
    return F.lit(None if v is None else str(v)).cast(PRICE_TOKEN)


def registry_rows(models=None) -> list[tuple]:
    models = S.MODEL_REGISTRY if models is None else models
    if len(models) > MAX_REGISTRY_ROWS:
        raise ValueError(f"registry has {len(models)} rows, more than {MAX_REGISTRY_ROWS}")
    return [(key, prov, mid, Decimal(pin), Decimal(pout), q, int(lat), name, i)
            for i, (key, prov, mid, pin, pout, q, lat, name) in enumerate(models)]


def model_registry(spark: SparkSession, models=None) -> DataFrame:
    """The registry with per-token prices as DECIMAL(18,12)."""
    kind = PRICE_TOKEN.simpleString()
    return local_table(spark, registry_rows(models), REGISTRY_SCHEMA).selectExpr(
        "*", *(f"CAST(CAST(cost_per_1k_{way}put_usd AS {kind}) / 1000 AS {kind}) AS price_{way}_per_token" for way in ("in", "out")))


RULES_SCHEMA = T.StructType([
    T.StructField("tier", T.IntegerType(), False),
    T.StructField("model_key", T.StringType(), False),
])

SETTINGS_SCHEMA = T.StructType([
    T.StructField("key", T.StringType(), False),
    T.StructField("value", T.StringType(), False),
])


def routing_settings_rows(routing: dict | None = None) -> list[tuple]:
    routing = dict(S.ROUTING if routing is None else routing)
    return [(k, str(v)) for k, v in routing.items()]


def routing_settings(spark: SparkSession, routing: dict | None = None) -> DataFrame:
    """S4 in key / value form (the shape a patch is applied to)."""
    return local_table(spark, routing_settings_rows(routing), SETTINGS_SCHEMA)


def routing_rules(settings: DataFrame) -> DataFrame:
    """S4 long form: one (tier, model_key) row per ``tier_N_model`` setting."""
    tier = F.regexp_extract("key", r"^tier_(\d+)_model$", 1)
    return (settings.where(tier != "")
            .select(tier.cast("int").alias("tier"), F.col("value").alias("model_key")))


def routing_thresholds(settings: DataFrame) -> DataFrame:
    """S4 one-row form: fallback model and low-confidence threshold.

    A global aggregate, so exactly one row by construction; consumers read
    it through a scalar subquery instead of joining."""
    return settings.agg(
        F.count(F.lit(1)).alias("n_settings"),
        F.max(F.when(F.col("key") == "fallback_model", F.col("value"))).alias("fallback_model"),
        F.max(F.when(F.col("key") == "low_confidence_threshold", F.col("value")))
        .cast("double").alias("low_confidence_threshold"),
    )


class RoutingFacts(NamedTuple):
    """Routing settings as values: model per tier, fallback model, low-confidence threshold."""

    models: dict[int, str]
    fallback: str | None
    threshold: float | None


def routing_facts(settings: DataFrame) -> RoutingFacts:
    """One read of the key / value settings, size-checked."""
    rows = config_rows(settings.select("key", "value"), MAX_CONFIG_ROWS, "routing settings")
    by_key = {r["key"]: r["value"] for r in rows}
    tiers = {int(m[1]): v for k, v in by_key.items() if (m := re.fullmatch(r"tier_([0-9]+)_model", k or ""))}
    threshold = by_key.get("low_confidence_threshold")
    return RoutingFacts(tiers, by_key.get("fallback_model"), None if threshold is None else float(threshold))


def tier_definitions(spark: SparkSession) -> DataFrame:
    """Tier number, name, description, examples and the model each tier routes to."""
    schema = T.StructType([
        T.StructField("tier", T.IntegerType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("description", T.StringType(), False),
        T.StructField("examples", T.StringType(), False),
    ])
    rows = [(n, name, text, "\n".join(examples)) for n, name, text, examples in S.TIERS]
    tiers = local_table(spark, rows, schema).withColumn("examples", F.split("examples", "\n"))
    rules = routing_rules(routing_settings(spark))
    config_rows(rules, MAX_CONFIG_ROWS, "routing rules")
    return tiers.join(F.broadcast(rules), "tier", "left").withColumnRenamed("model_key", "routed_to")
