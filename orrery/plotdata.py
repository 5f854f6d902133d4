"""The tables behind the usual plots of models; nothing is drawn here."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.core import Dataset, Fitted, Spec
from orrery.operators.linear import Lasso, LinearFit
from orrery.operators.unsupervised import ProjectionFit
from orrery.selection import KFold, Scoring, cross_validate, default_scoring, seeded, split, with_parameters


def scree(spark, fitted: ProjectionFit) -> DataFrame:
    """(component, variance, ratio, cumulative)."""
    rows = [(k + 1, float(v), float(r), float(c)) for k, (v, r, c) in enumerate(zip(fitted.explained, fitted.ratio, np.cumsum(fitted.ratio), strict=True))]
    return spark.createDataFrame(rows, "component int, variance double, ratio double, cumulative double")


def loadings(spark, fitted: ProjectionFit) -> DataFrame:
    """(feature, component, loading)."""
    rows = [(c, k + 1, float(fitted.components[i, k])) for i, c in enumerate(fitted.features) for k in range(fitted.components.shape[1])]
    return spark.createDataFrame(rows, "feature string, component int, loading double")


def coefficients(spark, fitted: LinearFit) -> DataFrame:
    return spark.createDataFrame([(c, float(b)) for c, b in zip(fitted.features, fitted.coefficients, strict=True)], "feature string, coefficient double")


def residuals(fitted: Fitted, data: Dataset) -> DataFrame:
    """The rows with prediction and residual."""
    return fitted.predict(data.df).withColumn("residual", F.col(f"`{data.targets[0]}`") - F.col("prediction"))


def residual_histogram(fitted: Fitted, data: Dataset, bins: int = 20) -> DataFrame:
    """(bin, n) over equal bins between the least and the greatest residual."""
    rows = residuals(fitted, data)
    low, high = rows.agg(F.min("residual"), F.max("residual")).first()
    width = (high - low) / bins or 1.0
    return rows.groupBy(F.least(F.floor((F.col("residual") - low) / width), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def regularization_path(spark, data: Dataset, spec: Spec | None = None, penalties: Sequence[float] | None = None) -> DataFrame:
    """(lam, feature, coefficient) over 30 penalties, evenly spread on a logarithmic scale."""
    rows = []
    for lam in penalties if penalties is not None else np.geomspace(1e-3, 10, 30):
        f = with_parameters(spec or Lasso(), {"lam": float(lam)}).fit(data)
        rows += [(float(lam), c, float(b)) for c, b in zip(f.features, f.coefficients, strict=True)]
    return spark.createDataFrame(rows, "lam double, feature string, coefficient double")


def _mean_scores(spec: Spec, part: Dataset, folds: KFold, scoring: Scoring | None) -> tuple[float, float]:
    """Mean scores on the rows that each model was fitted to, and on those of its fold."""
    score = scoring or default_scoring(spec)[0]
    result, rows = cross_validate(spec, part, folds, scoring), split(folds, part.df, part.id).persist()
    try:
        own = [score(m.predict(rows.where(F.col("fold") != k)), part.targets[0]) for k, m in enumerate(result.models, 1)]
    finally:
        rows.unpersist()
    return float(np.mean(own)), result.mean


def learning_curve(spark, spec: Spec, data: Dataset, shares: Sequence[float] = (0.2, 0.4, 0.6, 0.8, 1.0), folds: KFold | None = None, scoring: Scoring | None = None, seed: int = 0) -> DataFrame:
    """(share, train, validation): mean scores of fits to growing parts of the rows, the parts chosen by hashed ids."""
    rows = []
    for share in shares:
        part = data.with_df(data.df.where(F.conv(F.substring(seeded(data.id, seed), 1, 6), 16, 10).cast("double") < share * 16**6))
        rows.append((float(share), *_mean_scores(spec, part, folds or KFold(3), scoring)))
    return spark.createDataFrame(rows, "share double, train double, validation double")


def validation_curve(spark, spec: Spec, data: Dataset, parameter: str, values: Sequence, folds: KFold | None = None, scoring: Scoring | None = None) -> DataFrame:
    """(value, train, validation) for each value of a parameter."""
    rows = [(str(v), *_mean_scores(with_parameters(spec, {parameter: v}), data, folds or KFold(3), scoring)) for v in values]
    return spark.createDataFrame(rows, "value string, train double, validation double")


def partial_dependence(fitted: Fitted, data: Dataset, feature: str, grid: Sequence[float]) -> DataFrame:
    """(value, prediction): the mean prediction when a feature takes each value of the grid in all rows.

    The grid is short; each row is scored once per value and only the means are shuffled.
    """
    rows = data.df.withColumn("_value", F.explode(F.array(*[F.lit(float(v)) for v in grid]))).withColumn(feature, F.col("_value"))
    return fitted.predict(rows).groupBy(F.col("_value").alias("value")).agg(F.avg("prediction").alias("prediction"))


def partial_dependence_pair(fitted: Fitted, data: Dataset, features: tuple[str, str], x: Sequence[float], y: Sequence[float]) -> DataFrame:
    """(x, y, prediction): the mean prediction when two features take each pair of the grid in all rows."""
    a, b = features
    cells = F.array(*[F.struct(F.lit(float(u)).alias("x"), F.lit(float(v)).alias("y")) for u in x for v in y])
    rows = data.df.withColumn("_cell", F.explode(cells)).withColumns({a: F.col("_cell.x"), b: F.col("_cell.y")})
    return fitted.predict(rows).groupBy(F.col("_cell.x").alias("x"), F.col("_cell.y").alias("y")).agg(F.avg("prediction").alias("prediction"))


def individual_dependence(fitted: Fitted, data: Dataset, feature: str, grid: Sequence[float]) -> DataFrame:
    """(id, value, prediction): each row's prediction when a feature takes each value of the grid; the data need an id."""
    rows = data.df.withColumn("_value", F.explode(F.array(*[F.lit(float(v)) for v in grid]))).withColumn(feature, F.col("_value"))
    return fitted.predict(rows).select(F.col(f"`{data.id}`").alias("id"), F.col("_value").alias("value"), "prediction")


def on_grid(spark, fitted: Fitted, x: Sequence[float], y: Sequence[float]) -> DataFrame:
    """Predictions on a grid of a model's two features (boundaries and surfaces)."""
    rows = [(float(a), float(b)) for a in x for b in y]
    return fitted.predict(spark.createDataFrame(rows, f"{fitted.features[0]} double, {fitted.features[1]} double"))


def probability_simplex(df: DataFrame, proba: Sequence[str]) -> DataFrame:
    """Adds barycentric coordinates u, v of three probabilities."""
    _, b, c = (F.col(p) for p in proba)
    return df.withColumns({"u": b + c / 2, "v": c * float(np.sqrt(3) / 2)})
