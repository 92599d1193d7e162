"""Platt calibration (M6), cross-validated, as a Spark ML Estimator.

For each of ``k`` hash folds: fit the base pipeline on the other folds,
score the held-out fold, and fit one binary sigmoid (a one-feature
``LogisticRegression``) per class on that fold's class probability.
A calibrated probability is the per-class sigmoid of the base probability,
normalised over classes, averaged over the ``k`` fold models.
Everything is distributed Spark ML fitting; the sigmoid coefficients are
two numbers per class and fold.
"""

from __future__ import annotations

import json
from functools import partial

from pyspark import StorageLevel
from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .classifier import TIERS, build_pipeline, fold_id, side_by_side


class PlattCalibrated(Estimator):
    """Wraps a candidate estimator; ``fit`` returns a :class:`PlattCalibratedModel`."""

    def __init__(self, estimator, k: int = 5, text_col: str = "prompt", fold_col: str | None = None):
        super().__init__()
        self.estimator = estimator
        self.k = k
        self.text_col = text_col
        self.fold_col = fold_col

    def _fit(self, df: DataFrame) -> "PlattCalibratedModel":
        fold = F.col(self.fold_col) % self.k if self.fold_col else fold_id(self.text_col, self.k)
        folds = df.withColumn("__fold", fold)
        # held-out scores are 3 probabilities and a label per row, persisted
        # (recomputable from lineage) for the sigmoid fits over them
        def member(f):
            base = build_pipeline(self.estimator.copy()).fit(folds.where(F.col("__fold") != f))
            held = (base.transform(folds.where(F.col("__fold") == f))
                    .select(vector_to_array(F.col("probability")).alias("__p"), "label_idx")
                    .persist(StorageLevel.MEMORY_AND_DISK))
            coefs = []
            for i, _ in enumerate(TIERS):
                one = held.select(F.col("__p")[i].alias("s"),
                                  (F.col("label_idx") == i).cast("double").alias("y"))
                one = VectorAssembler(inputCols=["s"], outputCol="sv").transform(one)
                lr = LogisticRegression(featuresCol="sv", labelCol="y", maxIter=100, regParam=0.0)
                m = lr.fit(one)
                coefs.append((float(m.coefficients[0]), float(m.intercept)))
            held.unpersist()
            return base, coefs

        return PlattCalibratedModel(side_by_side(df.sparkSession, [partial(member, f) for f in range(self.k)]))


class PlattCalibratedModel(Model):
    def __init__(self, members):
        super().__init__()
        self.members = members

    def _transform(self, df: DataFrame) -> DataFrame:
        out = df
        parts = []
        for j, (base, coefs) in enumerate(self.members):
            scored = base.transform(out).withColumn(f"__p{j}", vector_to_array(F.col("probability")))
            out = scored.drop("rawPrediction", "probability", "prediction", "features", "scaled")
            sig = [F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(a) * F.col(f"__p{j}")[i] + F.lit(b))))
                   for i, (a, b) in enumerate(coefs)]
            tot = sum(sig[1:], sig[0])
            # all sigmoids can underflow to 0: then the classes are equal
            parts.append([F.when(tot > 0, s / tot).otherwise(F.lit(1.0 / len(sig))) for s in sig])
        avg = [sum((p[i] for p in parts), F.lit(0.0)) / F.lit(float(len(parts))) for i in range(len(TIERS))]
        res = out.withColumn("probability", array_to_vector(F.array(*avg)))
        return res.drop(*[f"__p{j}" for j in range(len(self.members))])

    def save(self, path: str) -> None:
        """Each fold's pipeline and the sigmoid coefficients."""
        meta = []
        for j, (base, coefs) in enumerate(self.members):
            base.write().overwrite().save(f"{path}/member_{j}")
            meta.append(coefs)
        s = SparkSession.builder.getOrCreate()
        s.createDataFrame([(json.dumps(meta),)], "coefs string").write.mode("overwrite").json(
            f"{path}/calibration")

    @staticmethod
    def load(path: str) -> "PlattCalibratedModel":
        s = SparkSession.builder.getOrCreate()
        meta = json.loads(s.read.json(f"{path}/calibration").first()["coefs"])
        members = [(PipelineModel.load(f"{path}/member_{j}"), [tuple(c) for c in coefs])
                   for j, coefs in enumerate(meta)]
        return PlattCalibratedModel(members)
