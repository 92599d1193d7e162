"""Feedback loop: ledger, export idempotence, guard."""

from pyspark.sql import functions as F

from promptledger.operators import flywheel as fw


def _failures(spark, n=5):
    return spark.createDataFrame([(i, i * 10, f"prompt {i}", 1, 2) for i in range(n)],
                                 "id long, request_id long, prompt string, classified_tier int, correct_tier int")


def test_second_export_is_empty(spark, tmp_dir):
    f = _failures(spark)
    ledger = f"{tmp_dir}/ledger"
    first = fw.export_failures(spark, f, ledger, "run1")
    assert first.count() == 5
    assert sorted(r.tier for r in first.collect()) == [2] * 5
    second = fw.export_failures(spark, f, ledger, "run2")
    assert second.count() == 0
    assert first.count() == 5           # the first export is a stable snapshot


def test_pending_and_count(spark):
    f = _failures(spark)
    ledger = spark.createDataFrame([(0,), (3,)], "failure_id long")
    assert sorted(r.id for r in fw.pending_failures(f, ledger).collect()) == [1, 2, 4]
    assert fw.pending_count(f, ledger).first().pending_failures == 3


def test_training_set_is_union_all(spark):
    lab = spark.createDataFrame([("a", 1, "d"), ("a", 1, "d")], "prompt string, tier int, domain string")
    exp = spark.createDataFrame([(1, "a", 3)], "id long, prompt string, tier int")
    ts = fw.training_set(lab, exp)
    assert ts.columns == ["prompt", "tier"] and ts.count() == 3


def test_guard_boundaries(spark):
    rows = [(0.90, 0.88, 5, True, False),    # exactly old - 0.02: kept
            (0.90, 0.879, 5, True, False),   # below: rejected
            (0.0, 0.5, 5, True, False),      # no old accuracy: replaced
            (0.90, 0.95, 5, True, True),     # dry run
            (0.90, None, 0, True, False),    # nothing new and a model exists
            (0.90, 0.0, 5, False, False)]    # every candidate scored 0
    m = spark.createDataFrame(rows, "old_accuracy double, new_accuracy double, num_failures long, "
                                    "model_exists boolean, dry_run boolean")
    got = [r.status for r in fw.retrain_decision(m).collect()]
    assert got == ["replaced", "rejected", "replaced", "dry_run_ok", "skipped", "failed"]


def test_audit_row_totals(spark):
    a = fw.audit_row(spark, "r", "rejected", 0.9, 0.5, 100, 10, None).first()
    assert a.total_examples == 110 and a.model_replaced is False


def test_retrain_job_appends_ledger_only_when_replaced(spark, tmp_dir):
    from conftest import SF_SMALL
    from promptledger.plans import jobs
    from promptledger.sources import fixtures as fx
    lab = fx.prompts(spark, SF_SMALL).select("prompt", F.col("label").alias("tier"))
    fails = fx.with_prompts(spark, SF_SMALL, fx.failure_log(spark, SF_SMALL), "request_id").where(F.col("prompt").isNotNull())
    ledger, models = f"{tmp_dir}/ledger", f"{tmp_dir}/models"
    # an impossible bar: rejected, nothing consumed
    a = jobs.retrain(spark, lab, fails, ledger, models, old_accuracy=1.0, model_exists=True).first()
    assert a.status == "rejected"
    assert fw.read_ledger(spark, ledger).count() == 0
    a = jobs.retrain(spark, lab, fails, ledger, models, old_accuracy=None, model_exists=False).first()
    assert a.status == "replaced" and a.model_path
    from promptledger.operators import classifier as clf
    assert clf.load_model(a.model_path)[1]["calibrated"]
    assert fw.read_ledger(spark, ledger).count() == a.num_failures
    a = jobs.retrain(spark, lab, fails, ledger, models, old_accuracy=0.5, model_exists=True).first()
    assert a.status == "skipped"
    assert spark.read.parquet(f"{models}/retrain_log").count() == 3


def test_unreadable_ledger_is_an_error(spark, tmp_dir):
    import pytest
    assert fw.read_ledger(spark, f"{tmp_dir}/none").count() == 0
    with pytest.raises(Exception):
        fw.read_ledger(spark, "nosuchstore://bucket/ledger").count()
