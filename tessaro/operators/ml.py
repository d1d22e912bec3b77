"""Model comparison on ``pyspark.ml``: features, folds, out-of-fold predictions, importances."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import worker_path
from . import forest
from .schema import drop_all_null, numeric_columns
from .stats import errors

#: The models' parameters.
MODELS = {
    "linear_regression": lambda seed: LinearRegression(solver="normal"),
    "elastic_net": lambda seed: LinearRegression(regParam=0.05, elasticNetParam=0.5, standardization=False),
    "random_forest": lambda seed: RandomForestRegressor(numTrees=500, maxDepth=30, minInstancesPerNode=3, seed=seed),
    "gradient_boosting": lambda seed: GBTRegressor(stepSize=0.05, maxDepth=4, maxIter=300, seed=seed),
    "boosting_subsampled": lambda seed: GBTRegressor(stepSize=0.04, maxDepth=4, maxIter=400, subsamplingRate=0.85, seed=seed),
}
SCALED = ("linear_regression", "elastic_net")


def feature_columns(df: DataFrame, target: str, without: set[str] = frozenset()) -> list[str]:
    """Numeric columns with values, minus ids, leakage and the target."""
    found = numeric_columns(drop_all_null(df.select(*numeric_columns(df, {target, *without}))))
    if not found:
        raise ValueError("no feature columns")
    return found


def pipeline(features: list[str], target: str, model: str, seed: int = 42) -> Pipeline:
    filled = [f"_f_{c}" for c in features]
    stages = [Imputer(strategy="median", relativeError=0.001, inputCols=features, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="_raw")]
    if model in SCALED:
        stages.append(StandardScaler(withMean=True, inputCol="_raw", outputCol="_x"))
    est = MODELS[model](seed).setFeaturesCol("_x" if model in SCALED else "_raw").setLabelCol(target).setPredictionCol("prediction")
    return Pipeline(stages=[*stages, est])


def with_folds(df: DataFrame, key: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """A fold from a hash of the key: the same at every run and on any cluster."""
    return df.withColumn("fold", F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(folds)).cast("int"))


def out_of_fold(df: DataFrame, key: str, features: list[str], target: str, model: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """(key, fold, target, prediction, residual, abs_error): each row predicted by the model that hasn't seen it."""
    data = with_folds(df.where(F.col(target).isNotNull()), key, folds, seed).withColumns({c: F.col(c).cast("double") for c in [*features, target]}).cache()
    parts = []
    for k in range(folds):
        fitted = pipeline(features, target, model, seed).fit(data.where(F.col("fold") != k))
        parts.append(fitted.transform(data.where(F.col("fold") == k)).select(key, "fold", F.col(target).alias("target"), "prediction"))
    data.unpersist()  # the fits are done; predictions read the source again
    out = reduce(DataFrame.unionByName, parts)
    return out.withColumn("residual", F.col("target") - F.col("prediction")).withColumn("abs_error", F.abs("residual"))


def compare_models(df: DataFrame, key: str, features: list[str], target: str, models: list[str], folds: int = 5, seed: int = 42) -> DataFrame:
    """(model, cv_rmse_mean, cv_rmse_std, cv_mae_mean, cv_mae_std, cv_r2_mean, cv_r2_std), best first; population deviation."""
    rows = []
    for m in models:
        e = errors(out_of_fold(df, key, features, target, m, folds, seed), "target", "prediction", ["fold"])
        rows.append(e.agg(*[f(c).alias(f"cv_{c}_{n}") for c in ("rmse", "mae", "r2") for f, n in ((F.avg, "mean"), (F.stddev_pop, "std"))]).select(F.lit(m).alias("model"), "*"))
    return reduce(DataFrame.unionByName, rows).orderBy("cv_rmse_mean", "model")


def forest_importances(data: DataFrame, features: list[str], target: str, seed: int = 42) -> list[float] | None:
    """The random forest's importances with all its parameters, from trees grown in tasks; None where :mod:`forest` can't."""
    est = MODELS["random_forest"](seed)
    if est.getFeatureSubsetStrategy() not in ("auto", "onethird") or not est.getBootstrap() or est.getMinInfoGain() or est.getMinWeightFractionPerNode() or est.getNumTrees() < 2:
        return None
    filled = [f"_f_{c}" for c in features]
    imputer = Imputer(strategy="median", relativeError=0.001, inputCols=features, outputCols=filled)
    data = imputer.fit(data).transform(data).select(*filled, target)
    worker_path(data.sparkSession)
    return forest.importances(data, filled, target, est.getNumTrees(), est.getMaxDepth(), est.getMinInstancesPerNode(), est.getMaxBins(), est.getSubsamplingRate(), -(-len(features) // 3), seed)


def importance(df: DataFrame, features: list[str], target: str, model: str, seed: int = 42) -> DataFrame:
    """(feature, importance, sign), the largest first: |coefficient| and its sign, or impurity."""
    data = df.where(F.col(target).isNotNull()).withColumns({c: F.col(c).cast("double") for c in [*features, target]})
    signed, w = False, forest_importances(data, features, target, seed) if model == "random_forest" else None
    if w is None:
        last = pipeline(features, target, model, seed).fit(data).stages[-1]
        signed = hasattr(last, "coefficients")
        w = last.coefficients.toArray() if signed else last.featureImportances.toArray()
    rows = [(c, float(abs(v)), ("+" if v >= 0 else "-") if signed else None) for c, v in zip(features, w)]
    return df.sparkSession.createDataFrame(sorted(rows, key=lambda r: (-r[1], r[0])), "feature string, importance double, sign string")


def ablation(df: DataFrame, key: str, target: str, scenarios: dict[str, list[str]], models: list[str], folds: int = 5, seed: int = 42) -> DataFrame:
    """:func:`compare_models` for each list of features."""
    parts = [compare_models(df, key, f, target, models, folds, seed).select(F.lit(s).alias("scenario"), F.lit(len(f)).alias("n_features"), "*") for s, f in scenarios.items()]
    return reduce(DataFrame.unionByName, parts)


def representative_nodes(nodes: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """(cluster, node): the node nearest to each k-means centre of (node, x, y)."""
    data = VectorAssembler(inputCols=["x", "y"], outputCol="_x").transform(nodes)
    model = KMeans(k=k, seed=seed, featuresCol="_x", predictionCol="cluster").fit(data)
    centres = nodes.sparkSession.createDataFrame([(i, float(c[0]), float(c[1])) for i, c in enumerate(model.clusterCenters())], "cluster int, cx double, cy double")
    got = model.transform(data).join(F.broadcast(centres), "cluster").withColumn("d", F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy")))
    return got.groupBy("cluster").agg(F.min(F.struct("d", "node")).alias("b")).select("cluster", F.col("b.node").alias("node"))
