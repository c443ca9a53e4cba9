"""Four regressors on a feature table, through Spark ML."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.common import _py2java
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import (
    DecisionTreeRegressor,
    GBTRegressor,
    LinearRegressionModel,
    RandomForestRegressor,
)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions.expr import clean_label
from ..operators.ranking import two_ended_top
from ..operators.staging import staging_root
from .many_targets import fit_many_targets

ELASTIC_NET, TREE = "Elastic Net", "Decision Tree"
BOOSTING, FOREST = "Gradient Boosting", "Random Forest"
MODEL_ORDER = [ELASTIC_NET, TREE, BOOSTING, FOREST]

_COLUMNS = {"featuresCol": "features", "labelCol": "label", "predictionCol": "pred"}


def elastic_net(
    train: DataFrame,
    features: Sequence[str],
    *,
    alpha: float = fv.ELASTIC_NET["alpha"],
    l1_ratio: float = fv.ELASTIC_NET["l1_ratio"],
    max_iter: int = fv.ELASTIC_NET["max_iter"],
) -> LinearRegressionModel:
    """Elastic net with the loss ``MSE/2 + alpha*rho*|w|_1 + alpha*(1-rho)/2*|w|^2``.

    The rows are read once, for their second moments; the solver descends by coordinates on these.
    Spark's own solvers stop early where one feature is a sum of others, as the cross-section mean
    is, and penalise in units of the label's deviation; the result is Spark's model all the same.
    """
    options = {"alpha": alpha, "l1_ratio": l1_ratio, "max_iter": max_iter}
    one = train.select(F.lit(0).alias("_all"), *features, "label")
    fit = fit_many_targets(one, features, keys=["_all"], **options).first()
    if fit is None:
        raise ValueError("no complete training rows")
    spark = train.sparkSession
    weights = _py2java(spark.sparkContext, Vectors.dense(fit.coefs))
    name = f"linearRegression_{uuid.uuid4().hex[:12]}"
    made = spark._jvm.org.apache.spark.ml.regression.LinearRegressionModel(name, weights, fit.intercept)
    return LinearRegressionModel(made).setFeaturesCol("features").setPredictionCol("pred")


def decision_tree(max_bins: int = 32) -> DecisionTreeRegressor:
    return DecisionTreeRegressor(
        maxDepth=fv.TREE["max_depth"],
        minInstancesPerNode=fv.TREE["min_leaf"],
        maxBins=max_bins,
        seed=fv.SEED,
        **_COLUMNS,
    )


def gradient_boosting(rounds: int = fv.BOOSTING["rounds"], max_bins: int = 32) -> GBTRegressor:
    return GBTRegressor(
        maxIter=rounds,
        maxDepth=fv.BOOSTING["max_depth"],
        stepSize=fv.BOOSTING["learning_rate"],
        maxBins=max_bins,
        checkpointInterval=25,
        seed=fv.SEED,
        **_COLUMNS,
    )


def random_forest(trees: int = fv.FOREST["trees"], max_bins: int = 32) -> RandomForestRegressor:
    return RandomForestRegressor(
        numTrees=trees,
        maxDepth=fv.FOREST["max_depth"],
        minInstancesPerNode=fv.FOREST["min_leaf"],
        featureSubsetStrategy="all",
        maxBins=max_bins,
        seed=fv.SEED,
        **_COLUMNS,
    )


@dataclass
class Fit:
    """Models fitted on the training rows of one target, and their forecasts of the others."""

    features: list[str]
    models: dict[str, PipelineModel]
    predictions: DataFrame


def _regressor(name: str, rounds: int, trees: int, max_bins: int):
    if name == TREE:
        return decision_tree(max_bins)
    if name == BOOSTING:
        return gradient_boosting(rounds, max_bins)
    return random_forest(trees, max_bins)


def _fitted(name: str, train: DataFrame, features: list[str], rounds: int, trees: int, max_bins: int):
    assembler = VectorAssembler(inputCols=features, outputCol="features")
    if name == ELASTIC_NET:
        return PipelineModel([assembler, elastic_net(train, features)])
    return Pipeline(stages=[assembler, _regressor(name, rounds, trees, max_bins)]).fit(train)


def fit_models(
    rows: DataFrame,
    features: Sequence[str],
    names: Sequence[str] = MODEL_ORDER,
    *,
    rounds: int = fv.BOOSTING["rounds"],
    trees: int = fv.FOREST["trees"],
    max_bins: int = 32,
    at_once: int = 4,
) -> Fit:
    """Fit each model on rows with ``is_train`` and predict the rest, ``at_once`` models side by side.

    ``rows`` are standardised feature rows of one target; stage them first, every model reads
    them. Trees bin features: raise ``max_bins`` towards the row count for finer splits.
    """
    if "target" in rows.columns and rows.select("target").distinct().limit(2).count() > 1:
        raise ValueError("rows of several targets: fit each target by itself")
    _checkpoints(rows.sparkSession)
    features = list(features)
    train, test = rows.where("is_train"), rows.where(~F.col("is_train"))
    fit = inheritable_thread_target(rows.sparkSession)(
        lambda name: _fitted(name, train, features, rounds, trees, max_bins)
    )
    # a model's jobs leave cores idle between its rounds; other models' jobs use them
    with ThreadPoolExecutor(max_workers=max(1, min(at_once, len(names)))) as pool:
        models = dict(zip(names, pool.map(fit, names), strict=True))
    predicted = []
    for name in names:
        predicted.append(
            models[name]
            .transform(test)
            .select(
                F.lit(name).alias("model"), "target", "date", "pred", F.col("label").alias("actual")
            )
        )
    return Fit(features, models, reduce(DataFrame.unionByName, predicted))


def _checkpoints(spark: SparkSession) -> None:
    """Boosting cuts its lineage below the shared folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(staging_root(spark))


def coefficients(fit: Fit, spark: SparkSession, name: str = ELASTIC_NET) -> DataFrame:
    """(feature, coef): coefficients of the linear model, importances of a tree model."""
    last = fit.models[name].stages[-1]
    weights = last.coefficients if hasattr(last, "coefficients") else last.featureImportances
    pairs = [(f, float(w)) for f, w in zip(fit.features, weights.toArray(), strict=True)]
    return spark.createDataFrame(pairs, "feature string, coef double")


def top_coefficients(
    coefs: DataFrame,
    largest: int = fv.COEF_LARGEST,
    smallest: int = fv.COEF_SMALLEST,
) -> DataFrame:
    """Largest and smallest coefficients, stacked, with a readable name and the sign class."""
    top = two_ended_top(coefs, "coef", "feature", largest, smallest)
    return top.select(
        "feature",
        clean_label("feature").alias("label"),
        "coef",
        F.when(F.col("coef") > 0, "positive").otherwise("not positive").alias("sign_class"),
    )


def save_models(fit: Fit, folder: str) -> None:
    for name, model in fit.models.items():
        model.write().overwrite().save(f"{folder}/{name.lower().replace(' ', '_')}")
