"""Independent fits run side by side, with the results of fits one after the other."""

import threading

import pytest
from pyspark.sql import functions as F

from promptledger import settings as S
from promptledger.operators import calibration as cal
from promptledger.operators import classifier as clf


@pytest.fixture(scope="module")
def rows(spark):
    i = F.col("id")
    feats = [((i * (7 + j)) % (11 + j) + i % 3).cast("double").alias(n) for j, n in enumerate(S.FEATURE_NAMES)]
    df = spark.range(300).select("id", (i % 3 + 1).cast("int").alias("label"), (i % 3).cast("double").alias("label_idx"),
                                 F.pmod(F.xxhash64("id"), F.lit(3)).cast("int").alias("fold"), *feats)
    return clf.with_weights(df.persist())


class Meeting:
    """A pipeline whose fit waits until the other folds are fitted too."""

    def __init__(self, pipeline, barrier):
        self.pipeline, self.barrier = pipeline, barrier

    def fit(self, df):
        self.barrier.wait(60)
        return self.pipeline.fit(df)


def test_results_keep_their_order_and_errors_are_raised(spark):
    barrier = threading.Barrier(3)

    def call(i):
        barrier.wait(60)
        return i

    assert clf.side_by_side(spark, [lambda i=i: call(i) for i in range(3)]) == [0, 1, 2]
    with pytest.raises(ZeroDivisionError):
        clf.side_by_side(spark, [lambda: 1, lambda: 1 // 0])


def test_folds_are_fitted_side_by_side(rows, monkeypatch):
    build, barrier = clf.build_pipeline, threading.Barrier(3)
    accs = []
    for f in range(3):
        train = rows.where(F.col("fold") != f)
        model = build(clf.candidates(train.count())["logistic_regression"]).fit(clf.with_weights(train.drop("weight")))
        accs.append(clf.accuracy(clf.score(model, rows.where(F.col("fold") == f))).first()["accuracy"])
    monkeypatch.setattr(clf, "build_pipeline", lambda est: Meeting(build(est), barrier))
    r = clf.cross_validate(rows, "logistic_regression", 3, fold_col="fold").first()
    assert r.folds == 3 and r.cv_mean == pytest.approx(sum(accs) / 3)


def test_calibration_members_are_fitted_side_by_side(rows, monkeypatch):
    build, barrier = clf.build_pipeline, threading.Barrier(3)
    est = clf.candidates(rows.count())["logistic_regression"]
    alone = [build(est.copy()).fit(rows.where(F.col("fold") != f)).stages[-1] for f in range(3)]
    monkeypatch.setattr(cal, "build_pipeline", lambda e: Meeting(build(e), barrier))
    members = cal.PlattCalibrated(est, k=3, fold_col="fold").fit(rows).members
    for lr, (base, coefs) in zip(alone, members, strict=True):
        assert base.stages[-1].coefficientMatrix.toArray() == pytest.approx(lr.coefficientMatrix.toArray())
        assert len(coefs) == 3
