"""Boosted trees on MLlib: every fit is a distributed job over the training rows."""
from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourgrid.session import use_checkpoint_folder

CELL = ("zone", "local_date", "hour")
# Default number of trees and learning rate.
TREES, RATE = 100, 0.1


def assemble(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Feature vector of the rows whose features are complete."""
    clean = df.na.drop("any", subset=list(features))
    return VectorAssembler(inputCols=list(features), outputCol="_features").transform(clean).withColumn(
        "_label", F.col(target).cast("double"))


def fit_trees(train: DataFrame, params: Mapping[str, object] | None = None, weight: str | None = None
              ) -> GBTRegressionModel:
    options = {"maxIter": TREES, "stepSize": RATE, "maxDepth": 5, "seed": 7, **(params or {})}
    use_checkpoint_folder(train.sparkSession)
    trees = GBTRegressor(featuresCol="_features", labelCol="_label", predictionCol="y_pred", **options)
    if weight:
        trees = trees.setWeightCol(weight)
    return trees.fit(train.filter(F.col("_label").isNotNull()))


def gbt_forecast(df: DataFrame, features: Sequence[str], target: str, origins: Sequence[date], last: date,
                 train_days: int, params: Mapping[str, object] | None = None) -> DataFrame:
    """Refit at each origin on the ``train_days`` days before it and forecast up to the next origin.

    All zones share a fit; pass a numeric zone code among the features to let the trees tell them apart.
    """
    data = assemble(df, features, target)
    out = None
    ends = [*origins[1:], None]
    for origin, end in zip(origins, ends):
        start = F.lit(origin)
        age = F.datediff(start, "local_date")
        model = fit_trees(data.filter((age > 0) & (age <= train_days)), params)
        days = data.filter((age <= 0) & (F.col("local_date") <= F.lit(last)))
        days = days if end is None else days.filter(F.col("local_date") < F.lit(end))
        part = model.transform(days).select(*CELL, start.alias("origin"), F.col("_label").alias("y_true"), "y_pred")
        out = part if out is None else out.unionByName(part)
    return out


def importance_table(model: GBTRegressionModel, one_row: DataFrame, features: Sequence[str]) -> DataFrame:
    """Features ranked by importance; ``one_row`` is any single-row table of the session."""
    weights = F.array(*[F.lit(float(v)) for v in model.featureImportances.toArray()])
    rows = one_row.select(F.posexplode(weights).alias("_i", "importance"))
    named = rows.withColumn("feature", F.element_at(F.array(*[F.lit(f) for f in features]), F.col("_i") + 1))
    return named.orderBy(F.col("importance").desc(), "feature").select("feature", "importance")


def gbt_grid(df: DataFrame, features: Sequence[str], target: str, split: str,
             grid: Sequence[Mapping[str, object]]) -> DataFrame:
    """Validation RMSE of each parameter set; training rows are those before the validation days."""
    data = assemble(df, features, target)
    train = data.filter(F.col(split).isin("long", "short"))
    check = data.filter((F.col(split) == "validation") & F.col("_label").isNotNull())
    out = None
    error = F.col("y_pred") - F.col("_label")
    for i, params in enumerate(grid):
        text = ", ".join(f"{k}={v}" for k, v in sorted(params.items()))
        score = fit_trees(train, params).transform(check).agg(F.sqrt(F.avg(error * error)).alias("rmse"))
        score = score.select(F.lit(i).alias("trial"), F.lit(text).alias("params"), "rmse")
        out = score if out is None else out.unionByName(score)
    return out


def best_trial(trials: DataFrame) -> DataFrame:
    return trials.agg(F.min_by(F.struct("trial", "params", "rmse"), F.struct("rmse", "trial")).alias("_b")).select("_b.*")

