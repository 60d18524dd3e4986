"""A latency regressor: the better of two tree ensembles."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import Imputer, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .datasets import unit_hash


def fit_latency_regressor(df: DataFrame, target: str, categorical: list[str], numeric: list[str], id_col: str, trees: int = 250, least: int = 8, seed: int = 42):
    """(model, scores DataFrame: model, mae, r2, best). Rows without a target don't count, and under `least` of them is an
    error; missing categories become the most frequent one, missing numbers the median; a keyed hash holds out a quarter. The
    forest has `trees` trees, the boosted ensemble a tenth of them, as its trees grow one after another."""
    rows = df.where(F.col(target).isNotNull())
    if rows.limit(least).count() < least:
        raise ValueError(f"at least {least} rows with a target are needed")
    categorical, numeric = [c for c in categorical if c in df.columns], [c for c in numeric if c in df.columns]
    common = rows.agg(*[F.mode(c).alias(c) for c in categorical]).first().asDict() if categorical else {}
    rows = rows.na.fill({k: v for k, v in common.items() if v is not None}).select(id_col, *categorical, *[F.col(c).cast("double").alias(c) for c in numeric], F.col(target).cast("double").alias("__y"))
    test = unit_hash(str(seed), F.col(id_col).cast("string")) < 0.25
    train, held = rows.where(~test), rows.where(test)
    steps = [StringIndexer(inputCols=categorical, outputCols=[f"{c}__i" for c in categorical], handleInvalid="keep"), OneHotEncoder(inputCols=[f"{c}__i" for c in categorical], outputCols=[f"{c}__v" for c in categorical])] if categorical else []
    steps += [Imputer(strategy="median", inputCols=numeric, outputCols=[f"{c}__n" for c in numeric])] if numeric else []
    steps.append(VectorAssembler(inputCols=[f"{c}__v" for c in categorical] + [f"{c}__n" for c in numeric], outputCol="__x"))
    features = Pipeline(stages=steps).fit(train)
    ready = features.transform(train).select("__x", "__y").persist()
    kinds = {"random_forest": RandomForestRegressor(featuresCol="__x", labelCol="__y", numTrees=trees, seed=seed, maxMemoryInMB=1024), "boosted_trees": GBTRegressor(featuresCol="__x", labelCol="__y", maxIter=max(1, trees // 10), seed=seed)}
    found = []
    for name, kind in kinds.items():
        model = PipelineModel([features, kind.fit(ready)])
        out = model.transform(held)
        score = lambda m: RegressionEvaluator(labelCol="__y", metricName=m).evaluate(out)  # noqa: E731, B023
        found.append((score("mae"), score("r2"), name, model))
    ready.unpersist()
    best = min(found, key=lambda f: f[0])
    scores = df.sparkSession.createDataFrame([(n, m, r, n == best[2]) for m, r, n, _ in found], "model string, mae double, r2 double, best boolean")
    return best[3], scores
