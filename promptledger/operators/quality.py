"""Data-quality rules Q1-Q5 (the constraints Parquet does not enforce)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def null_baseline(log: DataFrame) -> DataFrame:
    """Q1: rows with a null baseline cost (must be 0)."""
    return log.agg(F.count(F.lit(1)).alias("rows"),
                   F.count_if(F.col("cost_if_highest_quality").isNull()).alias("null_baseline"))


def duplicate_ids(df: DataFrame, key: str = "id") -> DataFrame:
    """Q2: keys that occur more than once, with their counts."""
    return (df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") > 1))


def orphans(children: DataFrame, parents: DataFrame, fk: str = "request_id", pk: str = "id") -> DataFrame:
    """Child rows whose foreign key has no parent (left anti join)."""
    keys = parents.select(F.col(pk).alias(fk))
    return children.join(keys, fk, "left_anti")


def with_parent(children: DataFrame, parents: DataFrame, fk: str = "request_id", pk: str = "id") -> DataFrame:
    """Child rows that do have a parent (left semi join)."""
    keys = parents.select(F.col(pk).alias(fk))
    return children.join(keys, fk, "left_semi")


def range_violations(log: DataFrame) -> DataFrame:
    """Q4: one row per broken value rule, with the rule name."""
    checks = [
        ("tier_out_of_range", F.col("complexity_tier").isNotNull() & ~F.col("complexity_tier").between(1, 3)),
        ("confidence_out_of_range", F.col("classifier_conf").isNotNull()
         & ~F.col("classifier_conf").between(0.0, 1.0)),
        ("score_out_of_range", F.col("quality_score").isNotNull() & (F.col("quality_score") != -1.0)
         & ~F.col("quality_score").between(1.0, 5.0)),
        ("negative_tokens", (F.col("input_tokens") < 0) | (F.col("output_tokens") < 0)),
    ]
    rule = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in checks]))
    return (log.select("id", rule.alias("rules")).where(F.size("rules") > 0)
            .select("id", F.explode("rules").alias("rule")))


def registry_violations(registry: DataFrame) -> DataFrame:
    """Q4 on the registry: quality label must be high / medium / low."""
    return registry.where(~F.col("quality_tier").isin("high", "medium", "low")).select(
        "model_key", F.lit("bad_quality_label").alias("rule"))
