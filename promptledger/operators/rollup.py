"""Daily partial states of the reports, with signed corrections.

``partials`` reduces requests to one row per (day, tier, model): counts and
exact decimal sums, no averages.  Such rows add up, so

* an append of requests appends the partials of the batch;
* a verdict or an escalation that arrives later appends a correction: the
  partials of the request as it is now, less those as it was.

Reports read the partials alone, a few rows per day and append.  ``compact``
adds up the rows of the days that were touched and rewrites those folders only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import state_path
from .escalation import is_routing_failure

KEYS = ["day", "complexity_tier", "routed_model"]
EXACT, VALUE = "decimal(38,8)", "decimal(28,8)"  # of sums, and of what is summed
SUMS = ["n", "cost", "baseline", "scored", "score", "verified", "verified_score", "timed", "latency", "escalated", "failed"]


def partials(requests: DataFrame, sign: int = 1) -> DataFrame:
    """Rows of ``KEYS`` and ``SUMS``; ``sign`` -1 takes the requests out again.

    Scores and latencies enter as decimals of eight places, so sums do not
    depend on their order and a correction cancels exactly."""
    q, ms = F.col("quality_score"), F.col("latency_ms")
    one = F.lit(sign).cast("long")

    def total(c) -> F.Column:
        value = c.cast(VALUE)
        return F.coalesce(F.sum(value if sign > 0 else -value), F.lit(0)).cast(EXACT)

    def often(cond) -> F.Column:
        return F.sum(F.when(F.coalesce(cond, F.lit(False)), one).otherwise(0))

    return requests.groupBy(*KEYS).agg(
        F.sum(one).alias("n"), total(F.col("cost_usd")).alias("cost"), total(F.col("cost_if_highest_quality")).alias("baseline"),
        often(q.isNotNull()).alias("scored"), total(q).alias("score"), often(q >= 0).alias("verified"),
        total(F.when(q >= 0, q)).alias("verified_score"), often(ms.isNotNull()).alias("timed"), total(ms).alias("latency"),
        often(F.col("escalated")).alias("escalated"), often((q >= 0) & is_routing_failure()).alias("failed"))


def append(rows: DataFrame, path: str) -> None:
    """Append partial rows to the rollup, one file per day of the batch."""
    rows.repartition("day").write.mode("append").partitionBy("day").parquet(path)


def correct(before: DataFrame, after: DataFrame, path: str) -> None:
    """Append the difference that later verdicts or escalations make: ``before`` and ``after`` hold the same requests."""
    append(added(partials(before, -1).unionByName(partials(after))).where(" or ".join(f"{c} <> 0" for c in SUMS)), path)


def added(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEYS).agg(*(F.sum(c).cast(rows.schema[c].dataType).alias(c) for c in SUMS))


def compact(spark: SparkSession, path: str, days: list) -> None:
    """One row per (tier, model) for the given days; folders of other days are not touched."""
    staged = state_path(spark, "rollup")
    rows = spark.read.parquet(path)
    kept = added(rows.where(F.col("day").isin(list(days)))).where(F.col("n") != 0)
    kept.write.parquet(staged)
    (spark.read.schema(kept.schema).parquet(staged).repartition("day").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path))


def _mean(total: str, n: str, places: int) -> F.Column:
    return F.round(F.col(total).cast("double") / F.nullif(F.col(n), F.lit(0)), places)


def savings_summary(rows: DataFrame) -> DataFrame:
    """A1 from the partials."""
    s = rows.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in SUMS))
    cost, base = F.col("cost").cast(VALUE), F.col("baseline").cast(VALUE)
    money = lambda c: F.round(c, 6).cast("double")
    pct = F.round((F.lit(1) - cost / F.nullif(base, F.lit(0))) * F.lit(100), 1).cast("double")
    return s.select(F.col("n").alias("total_requests"), money(cost).alias("total_cost_usd"), money(base).alias("total_baseline_cost"),
                    money(base - cost).alias("savings_usd"), F.coalesce(pct, F.lit(0.0)).alias("savings_pct"),
                    _mean("score", "scored", 2).alias("avg_quality_score"), _mean("verified_score", "verified", 2).alias("avg_quality_verified"),
                    F.coalesce(_mean("latency", "timed", 0), F.lit(0.0)).alias("avg_latency_ms"))


def daily(rows: DataFrame) -> DataFrame:
    """A6 + A7 + W1 per day: costs, requests, escalation rate, failures."""
    s = rows.groupBy("day").agg(*(F.sum(c).alias(c) for c in SUMS)).where("n <> 0")
    return s.select("day", F.round("cost", 6).cast("double").alias("cost_actual"), F.round("baseline", 6).cast("double").alias("cost_baseline"),
                    F.col("n").alias("num_requests"), F.round(F.col("escalated") / F.col("n") * 100, 1).alias("escalation_rate"),
                    F.col("failed").alias("failures"))


def by_tier(rows: DataFrame) -> DataFrame:
    """A3 from the partials."""
    return rows.where("complexity_tier is not null").groupBy("complexity_tier").agg(F.sum("n").alias("n")).where("n <> 0")


def by_model(rows: DataFrame) -> DataFrame:
    """A4 from the partials (ordered as the report is)."""
    s = rows.groupBy("routed_model").agg(F.sum("n").alias("n"), F.sum("scored").alias("scored"), F.sum("score").alias("score")).where("n <> 0")
    return s.select("routed_model", "n", _mean("score", "scored", 2).alias("avg_quality")).orderBy(F.desc("n"), "routed_model")
