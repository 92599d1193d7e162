"""Multi-step jobs: model training / scoring (M1-M15) and the retrain
run of the feedback loop (W2-W8).

Training inputs are featurised once and cut from their lineage by writing
them as a table in the shared ``spark.checkpoint.dir`` (never a local
checkpoint), so iterative fitting neither recomputes the text features nor
depends on an executor that may be gone.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import settings as S
from ..operators import classifier as clf
from ..operators import flywheel as fw
from ..operators.calibration import PlattCalibrated
from ..session import state_path


def prepared(df: DataFrame, label: str = "label", keep: tuple[str, ...] = ()) -> DataFrame:
    """Features, 0-based label, split flag, fold id and balanced weights.

    The featurised rows are written once as a table in the shared
    checkpoint folder (``spark.checkpoint.dir``) and read back: that cuts
    the lineage (iterative fitting never recomputes the text features, and
    a lost executor does not send it back to the texts) with a single job.
    Class weights are then counted from the written table; a fit on part of
    the rows counts its own."""
    spark = df.sparkSession
    f = clf.featurise(df).withColumn("label_idx", (F.col(label) - 1).cast("double"))
    out = f.select(*keep, label, "label_idx", *S.FEATURE_NAMES,
                   clf.split_flag().alias("is_test"), clf.fold_id().alias("fold"))
    path = state_path(spark, "training")
    out.write.parquet(path)
    return clf.with_weights(spark.read.parquet(path), label)


CALIBRATION_FOLDS = 3


def fit_candidates(data: DataFrame, k: int = CALIBRATION_FOLDS):
    """Fit M3 / M4 calibrated (M6) on the training side, evaluate on the test
    side (M7), pick the best (M11).  Returns (models, results with ``is_best``)."""
    train, test = data.where(~F.col("is_test")), data.where(F.col("is_test"))
    models, results = clf.train_candidates(train, test, lambda est, rows: PlattCalibrated(est, k=k, fold_col="fold").fit(rows))
    best = clf.best_candidate(results).select(F.col("candidate").alias("__best"))
    flagged = results.join(F.broadcast(best), results["candidate"] == best["__best"], "left").select(
        "candidate", "candidate_order", "accuracy", F.col("__best").isNotNull().alias("is_best"))
    return models, flagged


def calibrated_model(data: DataFrame, candidate: str = "logistic_regression", k: int = 5):
    """M6 on the training side."""
    train = clf.with_weights(data.where(~F.col("is_test")).drop("weight"))
    return PlattCalibrated(clf.candidates(train.count())[candidate], k=k, fold_col="fold").fit(train)


def retrain(spark: SparkSession, labelled: DataFrame, failures: DataFrame, ledger_path: str,
            model_dir: str, old_accuracy: float | None, model_exists: bool, dry_run: bool = False,
            consume_before_guard: bool = False, t=S.DEFAULT_THRESHOLDS) -> DataFrame:
    """Export pending failures, retrain both candidates on the union,
    guard against regression, append the ledger only when the new model is
    accepted, persist the model and return the audit row (also for
    rejections)."""
    run_id = uuid.uuid4().hex[:12]
    pending = fw.export_rows(fw.pending_failures(failures, fw.read_ledger(spark, ledger_path)))
    snap = f"{ledger_path.rstrip('/')}_exports/{run_id}"
    pending.write.mode("overwrite").parquet(snap)
    exported = spark.read.parquet(snap)
    if consume_before_guard and not dry_run:
        fw.consume(exported, ledger_path, run_id)
    num_failures = exported.count()
    num_original = labelled.count()
    if num_failures == 0 and model_exists:
        status, new_acc, path = "skipped", None, None
    else:
        union = fw.training_set(labelled, exported).withColumnRenamed("tier", "label")
        data = prepared(union)
        models, results = fit_candidates(data)
        best = results.where("is_best").first()
        new_acc = float(best["accuracy"]) if best else 0.0
        metrics = spark.createDataFrame(
            [(old_accuracy, new_acc, num_failures, model_exists, dry_run)],
            "old_accuracy double, new_accuracy double, num_failures long, model_exists boolean, dry_run boolean")
        status = fw.retrain_decision(metrics, t).first()["status"]
        path = None
        if status == "replaced":
            path = f"{model_dir.rstrip('/')}/{run_id}"
            clf.save_model(models[best["candidate"]], path, best["candidate"],
                           {r["candidate"]: r["accuracy"] for r in results.collect()})
            if not consume_before_guard:
                fw.consume(exported, ledger_path, run_id)
    audit = fw.audit_row(spark, run_id, status, old_accuracy, new_acc, num_original, num_failures, path)
    audit.write.mode("append").parquet(f"{model_dir.rstrip('/')}/retrain_log")
    return audit
