"""Complexity classifier on Spark ML (M1-M15); calibration lives in
:mod:`promptledger.operators.calibration`.

Featurising is the column expressions of :mod:`promptledger.functions.text`
(no UDF); the vector is ``VectorAssembler`` over the 14 names in their
fixed order.  Training, scoring and every metric are distributed: metrics
are conditional aggregates over a prediction table, never a driver loop
over rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import settings as S
from ..functions.text import add_features

TIERS = [1, 2, 3]


# a forest fit keeps about 0.6 KB a row while it runs, so only a few run at once
FITS_AT_ONCE = 3


def side_by_side(spark: SparkSession, calls: list[Callable]) -> list:
    """The results of independent fits, in the order of ``calls``.

    A fit is a chain of short jobs with idle cores between and at the end of
    them; the jobs of the other fits fill these (as ``parallelism`` does in
    Spark's ``CrossValidator``)."""
    with ThreadPool(min(FITS_AT_ONCE, len(calls))) as pool:
        return pool.map(lambda call: call(), [inheritable_thread_target(spark)(c) for c in calls], chunksize=1)


def featurise(df: DataFrame, text_col: str = "prompt") -> DataFrame:
    """F1-F14 then F15 (missing feature -> 0.0)."""
    f = add_features(df, text_col)
    return f.select(*[c for c in f.columns if c not in S.FEATURE_NAMES],
                    *[F.coalesce(F.col(n), F.lit(0.0)).alias(n) for n in S.FEATURE_NAMES])


def split_flag(text_col: str = "prompt", test_fraction: float = 0.2) -> F.Column:
    """M2: deterministic 80/20 split, ``true`` = test.

    The first 4 hex digits of md5(prompt) below ``0.2 * 16^4``: no shuffle,
    reproducible across runs and clusters, ~20 % within every tier."""
    cut = format(int(test_fraction * 16 ** 4), "04x")
    return F.substring(F.md5(F.col(text_col)), 1, 4) < F.lit(cut)


def fold_id(text_col: str = "prompt", k: int = 5) -> F.Column:
    """M8: fold number from a hash of the prompt."""
    return F.pmod(F.xxhash64(F.col(text_col)), F.lit(k)).cast("int")


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """M5: balanced weight n / (k * n_class) per class; n and k come from the
    class counts, so the rows are read once."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_class"))
    every = Window.partitionBy(F.lit(1))
    n, k = F.sum("n_class").over(every), F.count(label).over(every)
    return counts.select(label, "n_class", (n / (k * F.col("n_class"))).alias("weight"))


# a classifier has a handful of classes; more than this is refused
MAX_CLASSES = 1_000


def with_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Attach M5 weights ``n / (k * n_class)``.

    The per-class counts (one row per class, at most ``MAX_CLASSES``,
    checked) are read once and folded in as a literal map, so attaching
    them needs no join: a class holding most of the rows cannot skew a
    shuffle.  Same formula as :func:`class_weights`; a null label gets a
    null weight."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_class")).limit(MAX_CLASSES + 2).collect()
    classes = [r for r in counts if r[label] is not None]
    if len(classes) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes in {label!r}")
    n, k = sum(r["n_class"] for r in counts), len(classes)
    if not classes:
        return df.withColumn("weight", F.lit(None).cast("double"))
    weights = F.create_map(*[x for r in classes for x in (F.lit(r[label]), F.lit(n / (k * r["n_class"])))])
    return df.withColumn("weight", weights[F.col(label)])


def candidates(n_rows: int | None = None, weight_col: str = "weight") -> dict:
    """M3 / M4: the two candidate estimators, in tie-break order."""
    reg = 1.0 / n_rows if n_rows else 0.0
    # tol 1e-4: scikit-learn's default for the L-BFGS solver the service
    # trains with (Spark's own default, 1e-6, doubles the iterations at sf0.1
    # for the same test accuracy)
    lr = LogisticRegression(featuresCol="scaled", labelCol="label_idx", weightCol=weight_col,
                            family="multinomial", regParam=reg, elasticNetParam=0.0,
                            maxIter=5000, tol=1e-4, standardization=False)
    rf = RandomForestClassifier(featuresCol="scaled", labelCol="label_idx", weightCol=weight_col,
                                numTrees=100, maxDepth=10, seed=42)
    return {"logistic_regression": lr, "random_forest": rf}


def build_pipeline(estimator) -> Pipeline:
    """M1 scaler (fit on the training side only) + the estimator."""
    return Pipeline(stages=[
        VectorAssembler(inputCols=S.FEATURE_NAMES, outputCol="features"),
        StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True),
        estimator,
    ])


def score(model, df: DataFrame, threshold: float = S.ROUTING["low_confidence_threshold"]) -> DataFrame:
    """Tier, confidence (max probability), low-confidence flag; the
    features stay on the row."""
    out = model.transform(df)
    probs = vector_to_array(F.col("probability"))
    return (out.withColumn("__p", probs)
            .withColumn("predicted", (F.array_position(F.col("__p"), F.array_max("__p")) ).cast("int"))
            .withColumn("confidence", F.array_max("__p"))
            .withColumn("low_confidence", F.col("confidence") < F.lit(threshold))
            .drop("__p", "rawPrediction", "probability", "prediction", "features", "scaled"))


def accuracy(pred: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """M7: share of rows whose prediction equals the label."""
    return pred.agg(F.avg((F.col(label) == F.col(predicted)).cast("int")).alias("accuracy"),
                    F.count(F.lit(1)).alias("n"))


def confusion_matrix(pred: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """3 x 3 with zero cells (pivot over the known tiers)."""
    cm = pred.groupBy(label).pivot(predicted, TIERS).agg(F.count(F.lit(1)))
    full = cm.select(label, *[F.coalesce(F.col(str(t)), F.lit(0)).cast("bigint").alias(f"pred_{t}")
                              for t in TIERS])
    return full.orderBy(label)


def classification_report(pred: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """M9: per-class precision / recall / F1 / support plus macro and
    weighted averages (rows ``macro avg`` / ``weighted avg``)."""
    per = []
    for t in TIERS:
        per += [F.count_if((F.col(predicted) == t) & (F.col(label) == t)).alias(f"tp{t}"),
                F.count_if(F.col(predicted) == t).alias(f"pp{t}"),
                F.count_if(F.col(label) == t).alias(f"sup{t}")]
    agg = pred.agg(*per)
    rows = []
    for t in TIERS:
        tp, pp, sup = F.col(f"tp{t}"), F.col(f"pp{t}"), F.col(f"sup{t}")
        prec = F.when(pp > 0, tp / pp).otherwise(F.lit(0.0))
        rec = F.when(sup > 0, tp / sup).otherwise(F.lit(0.0))
        f1 = F.when(prec + rec > 0, F.lit(2.0) * prec * rec / (prec + rec)).otherwise(F.lit(0.0))
        rows.append(F.struct(F.lit(str(t)).alias("class"), prec.alias("precision"), rec.alias("recall"),
                             f1.alias("f1"), sup.alias("support")))
    per_class = agg.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    summ = per_class.agg(
        F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
        (F.sum(F.col("precision") * F.col("support")) / F.sum("support")).alias("wp"),
        (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("wr"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("wf"),
        F.sum("support").alias("s"))
    avgs = summ.select(F.explode(F.array(
        F.struct(F.lit("macro avg").alias("class"), F.col("mp").alias("precision"), F.col("mr").alias("recall"),
                 F.col("mf").alias("f1"), F.col("s").alias("support")),
        F.struct(F.lit("weighted avg").alias("class"), F.col("wp").alias("precision"),
                 F.col("wr").alias("recall"), F.col("wf").alias("f1"), F.col("s").alias("support")))).alias("r"))
    out = per_class.unionByName(avgs.select("r.*"))
    return out.select("class", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")],
                      F.col("support").cast("bigint").alias("support"))


def best_candidate(results: DataFrame) -> DataFrame:
    """Highest accuracy; ties go to the earlier candidate."""
    return results.orderBy(F.desc("accuracy"), F.asc("candidate_order")).limit(1)


def train_candidates(train: DataFrame, test: DataFrame, fit=None) -> tuple[dict, DataFrame]:
    """Fit M3 and M4 on ``train`` (prepared rows), score ``test``; returns the
    fitted models and a results table (candidate, order, accuracy).

    Weights and regularisation come from the training rows.  ``fit(estimator,
    rows)`` may wrap the estimator (calibration); by default it is fitted as
    a plain pipeline."""
    spark = train.sparkSession
    train = with_weights(train.drop("weight"))
    fit = fit or (lambda est, rows: build_pipeline(est).fit(rows))

    def one(est):
        model = fit(est, train)
        return model, accuracy(score(model, test)).select("accuracy").first()[0]

    ests = candidates(train.count())
    done = side_by_side(spark, [partial(one, est) for est in ests.values()])
    fitted = {name: model for name, (model, _) in zip(ests, done, strict=True)}
    rows = [(name, i, float(acc or 0.0)) for i, (name, (_, acc)) in enumerate(zip(ests, done, strict=True))]
    results = spark.createDataFrame(rows, "candidate string, candidate_order int, accuracy double")
    return fitted, results


def cross_validate(data: DataFrame, estimator_name: str, k: int = 5, fold_col: str | None = None) -> DataFrame:
    """M8: fold accuracies of one candidate; mean and population std."""
    spark = data.sparkSession
    folds = data.withColumn("__fold", F.col(fold_col) if fold_col else fold_id("prompt", k))

    def fold(f):
        tr = folds.where(F.col("__fold") != f)
        te = folds.where(F.col("__fold") == f)
        # weights and regularisation belong to the rows that are fitted
        model = build_pipeline(candidates(tr.count())[estimator_name]).fit(with_weights(tr.drop("weight")))
        a = accuracy(score(model, te)).select("accuracy").first()[0]
        return f, float(a or 0.0)

    accs = side_by_side(spark, [partial(fold, f) for f in range(k)])
    df = spark.createDataFrame(accs, "fold int, accuracy double")
    return df.agg(F.avg("accuracy").alias("cv_mean"), F.stddev_pop("accuracy").alias("cv_std"),
                  F.count(F.lit(1)).alias("folds"))


def golden_gate(pred: DataFrame, target: float = S.ACCURACY_TARGET) -> DataFrame:
    """Per-prompt pass flags and the overall gate."""
    acc = pred.agg(F.avg((F.col("label") == F.col("predicted")).cast("int")).alias("a")).select("a").scalar()
    return pred.select("*", (F.col("label") == F.col("predicted")).alias("passed"),
                       acc.alias("gate_accuracy"), (acc >= F.lit(target)).alias("meets_target"))


def save_model(model, path: str, name: str, accuracies: dict[str, float]) -> None:
    """Persist a fitted pipeline or calibrated model with its metadata:
    candidate name, accuracy of every candidate, feature order."""
    calibrated = not isinstance(model, PipelineModel)
    if calibrated:
        model.save(f"{path}/model")
    else:
        model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(name, calibrated, accuracies, list(S.FEATURE_NAMES))],
                          "name string, calibrated boolean, accuracies map<string,double>, features array<string>"
                          ).write.mode("overwrite").parquet(f"{path}/metadata")


def load_model(path: str):
    """The model and its metadata (a dict); the feature order must be
    the one that this code computes."""
    from .calibration import PlattCalibratedModel
    meta = SparkSession.getActiveSession().read.parquet(f"{path}/metadata").first().asDict()
    if meta["features"] != list(S.FEATURE_NAMES):
        raise ValueError(f"the model at {path} was fitted on other features")
    return (PlattCalibratedModel if meta["calibrated"] else PipelineModel).load(f"{path}/model"), meta
