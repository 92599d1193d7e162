"""Feedback loop W1-W8 and the consumption ledger.

The service flips a ``used_in_retrain`` flag in place.  Here failures are
append-only and consumption is a second append-only table of failure ids:
"unconsumed" is a left anti join, "consume" is an append of ids, and a
replayed append is harmless (the anti join is idempotent by id).  The
ledger is appended only after the guard accepted the new model (the
service marks failures before the guard decides, so a rejected retrain
loses them; ``consume_before_guard=True`` restores that behaviour).
"""

from __future__ import annotations

import datetime as _dt

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..settings import DEFAULT_THRESHOLDS, Thresholds

LEDGER_SCHEMA = T.StructType([
    T.StructField("failure_id", T.LongType(), False),
    T.StructField("consumed_at", T.TimestampType(), True),
    T.StructField("run_id", T.StringType(), True),
])

AUDIT_SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType(), False),
    T.StructField("timestamp", T.TimestampType(), False),
    T.StructField("old_accuracy", T.DoubleType(), True),
    T.StructField("new_accuracy", T.DoubleType(), True),
    T.StructField("num_original", T.LongType(), True),
    T.StructField("num_failures", T.LongType(), True),
    T.StructField("total_examples", T.LongType(), True),
    T.StructField("status", T.StringType(), False),
    T.StructField("model_replaced", T.BooleanType(), False),
    T.StructField("model_path", T.StringType(), True),
])


def pending_failures(failures: DataFrame, ledger: DataFrame) -> DataFrame:
    """Failures whose id is not in the ledger (peek, no marking)."""
    used = ledger.select(F.col("failure_id").alias("id"))
    return failures.join(used, "id", "left_anti")


def pending_count(failures: DataFrame, ledger: DataFrame) -> DataFrame:
    """Number of failures waiting for the next retrain."""
    return pending_failures(failures, ledger).agg(F.count(F.lit(1)).alias("pending_failures"))


def export_rows(pending: DataFrame) -> DataFrame:
    """The (prompt, tier) training rows of pending failures."""
    return pending.select("id", "prompt", F.col("correct_tier").alias("tier"))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger; empty only if there is none yet.  Any other failure to
    read it (storage down, no permission) is raised: an empty ledger would
    send every failure into training again."""
    try:
        return spark.read.schema(LEDGER_SCHEMA).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER_SCHEMA)


def consume(ids: DataFrame, path: str, run_id: str) -> None:
    """Append the exported failure ids to the ledger (after the guard)."""
    (ids.select(F.col("id").cast("long").alias("failure_id"),
                F.current_timestamp().alias("consumed_at"), F.lit(run_id).alias("run_id"))
     .write.mode("append").parquet(path))


def export_failures(spark: SparkSession, failures: DataFrame, ledger_path: str, run_id: str) -> DataFrame:
    """W2 as one call: the pending rows, consumed right away.

    The pending rows are written to a run folder next to the ledger first,
    so the returned DataFrame does not change when the ledger grows (a
    second export then yields nothing)."""
    pending = export_rows(pending_failures(failures, read_ledger(spark, ledger_path)))
    snap = f"{ledger_path.rstrip('/')}_exports/{run_id}"
    pending.write.mode("overwrite").parquet(snap)
    out = spark.read.parquet(snap)
    consume(out, ledger_path, run_id)
    return out


def training_set(labelled: DataFrame, exported: DataFrame) -> DataFrame:
    """Original rows UNION ALL failure rows (no dedup; extra columns dropped)."""
    return (labelled.select("prompt", F.col("tier").cast("int").alias("tier"))
            .unionByName(exported.select("prompt", F.col("tier").cast("int").alias("tier"))))


def retrain_status(old, new, num_failures, model_exists, dry_run, t: Thresholds = DEFAULT_THRESHOLDS) -> F.Column:
    """W5 + W7 as a column expression over the run's metrics.

    skipped (no new failures and a model exists) / failed (every candidate
    scored 0) / rejected (old > 0 and new < old - guard, strict) /
    dry_run_ok / replaced."""
    old, new = F.col(old), F.col(new)
    return (F.when((F.col(num_failures) == 0) & F.col(model_exists), F.lit("skipped"))
            .when(F.coalesce(new, F.lit(0.0)) <= 0, F.lit("failed"))
            .when((F.coalesce(old, F.lit(0.0)) > 0) & (new < old - F.lit(t.guard)), F.lit("rejected"))
            .when(F.col(dry_run), F.lit("dry_run_ok"))
            .otherwise(F.lit("replaced")))


def retrain_decision(metrics: DataFrame, t: Thresholds = DEFAULT_THRESHOLDS) -> DataFrame:
    """W5 / W7 over a table of runs (old_accuracy, new_accuracy,
    num_failures, model_exists, dry_run)."""
    return metrics.select("*", retrain_status("old_accuracy", "new_accuracy", "num_failures",
                                              "model_exists", "dry_run", t).alias("status"))


def audit_row(spark: SparkSession, run_id: str, status: str, old_acc, new_acc, num_original,
              num_failures, model_path) -> DataFrame:
    """One audit row; ``total = original + failures``; rejections
    are logged too."""
    total = None if num_original is None or num_failures is None else num_original + num_failures
    row = (run_id, _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None), old_acc, new_acc, num_original,
           num_failures, total, status, status == "replaced", model_path)
    return spark.createDataFrame([row], AUDIT_SCHEMA)
