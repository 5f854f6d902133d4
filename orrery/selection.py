"""Splits by row numbers, cross-validation, tuning, permutation importance."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.core import Context, Dataset, Fitted, Spec, check
from orrery.plans.ordering import row_numbers


def seeded(id: str, seed: int) -> Column:
    """A pseudo-random order of ids that other engines can compute too."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(id).cast("string")).cast("binary"))


@dataclass(frozen=True)
class KFold:
    """n_splits folds over positions; the first n mod k folds get one row more."""

    n_splits: int = 5
    shuffle: bool = False
    seed: int = 0

    def __post_init__(self) -> None:
        check(self.n_splits >= 2, "n_splits must be at least 2")


def split(folds: KFold, df: DataFrame, id: str) -> DataFrame:
    """Adds ``fold`` (from 1). Only ids are sorted; they are joined back to the rows."""
    order = [seeded(id, folds.seed), F.col(id)] if folds.shuffle else [F.col(id)]
    ranked, n = row_numbers(df.select(id), *order)
    size, extra, k = n // folds.n_splits, n % folds.n_splits, F.col("_r")
    fold = F.when(k < extra * (size + 1), F.floor(k / (size + 1))).otherwise(extra + F.floor((k - extra * (size + 1)) / max(size, 1)))
    return df.join(ranked.select(id, (fold + 1).cast("int").alias("fold")), id)


def train_test_split(df: DataFrame, id: str, test_size: float = 0.25, seed: int = 0, stratify: str | None = None) -> DataFrame:
    """Adds ``is_test``. ceil(n * test_size) rows are tests; stratified: floors, then the largest remainders, one at least each way."""
    part = [stratify] if stratify else []
    counts = {r[0]: r[1] for r in df.groupBy(*[F.col(c).alias("k") for c in part]).count().collect()} if part else {None: df.count()}
    n = sum(counts.values())
    total = int(np.ceil(n * test_size))
    check(1 <= total < n, "test_size must leave rows on both sides")
    keys = sorted(counts)
    quota = {k: min(max(int(total * counts[k] // n), 1 if part else total), counts[k] - 1) for k in keys}
    while part and sum(quota.values()) != total:
        up = sum(quota.values()) < total
        gap = lambda k: total * counts[k] / n - quota[k]
        open_ = [k for k in keys if (quota[k] < counts[k] - 1 if up else quota[k] > 1)]
        check(bool(open_), "the test size cannot keep every class on both sides")
        best = max(open_, key=gap) if up else min(open_, key=gap)
        quota[best] += 1 if up else -1
    # one order over all classes; a class's first row gives the place where its own numbers start
    ranked, _ = row_numbers(df.select(id, *part), *[F.col(c) for c in part], seeded(id, seed), F.col(id))
    limit = F.lit(total)
    if part:
        limit, starts = F.lit(0), {r[0]: r[1] for r in ranked.groupBy(stratify).agg(F.min("_r")).collect()}
        for k in keys:
            limit = F.when(F.col(stratify) == F.lit(k), starts[k] + quota[k]).otherwise(limit)
    return df.join(ranked.select(id, (F.col("_r") < limit).alias("is_test")), id)


Scoring = Callable[[DataFrame, str], float]


def default_scoring(spec: Spec) -> tuple[Scoring, bool]:
    """Accuracy for classifiers (greater is better), root mean squared error otherwise."""
    if spec.task == "classification":
        return (lambda df, y: df.agg(F.avg((F.col(y) == F.col("prediction")).cast("double"))).first()[0]), True
    return (lambda df, y: df.agg(F.sqrt(F.avg((F.col(y) - F.col("prediction")) ** 2))).first()[0]), False


@dataclass(frozen=True)
class CrossValidationResult:
    scores: tuple[float, ...]
    models: tuple[Fitted, ...]

    @property
    def mean(self) -> float:
        return float(np.mean(self.scores))

    def to_df(self, spark) -> DataFrame:
        return spark.createDataFrame([(i + 1, s) for i, s in enumerate(self.scores)], "fold int, score double")


def cross_validate(spec: Spec, data: Dataset, folds: KFold | None = None, scoring: Scoring | None = None, context: Context | None = None) -> CrossValidationResult:
    """Fits the whole specification on the rows outside each fold and scores it inside; nothing of a fold reaches its fit."""
    context, folds = context or Context(), folds or KFold()
    score = scoring or default_scoring(spec)[0]
    df = split(folds, data.df, data.id).persist()
    try:
        scores, models = [], []
        for k in range(1, folds.n_splits + 1):
            fitted = spec.fit(data.with_df(df.where(F.col("fold") != k)), context=context.derive("fold", k))
            models.append(fitted)
            scores.append(score(fitted.predict(df.where(F.col("fold") == k)), data.targets[0]))
        return CrossValidationResult(tuple(scores), tuple(models))
    finally:
        df.unpersist()


evaluate = cross_validate


@dataclass(frozen=True)
class TuningResult:
    parameters: tuple[dict, ...]
    scores: tuple[float, ...]
    best: dict
    best_score: float
    model: Fitted | None

    def to_df(self, spark) -> DataFrame:
        return spark.createDataFrame([(i + 1, str(p), s) for i, (p, s) in enumerate(zip(self.parameters, self.scores, strict=True))], "trial int, parameters string, score double")


def with_parameters(spec: Spec, parameters: dict) -> Spec:
    """A copy with other parameters; ``step__name`` reaches into nested specifications."""
    for key, value in parameters.items():
        head, _, rest = key.partition("__")
        if rest and head.isdigit():
            steps = list(spec.steps)
            steps[int(head)] = with_parameters(steps[int(head)], {rest: value})
            spec = replace(spec, steps=tuple(steps))
        else:
            spec = replace(spec, **{head: with_parameters(getattr(spec, head), {rest: value}) if rest else value})
    return spec


def tune(spec: Spec, data: Dataset, grid: dict[str, Sequence], folds: KFold | None = None, scoring: Scoring | None = None, maximize: bool | None = None, refit: bool = True, context: Context | None = None) -> TuningResult:
    """All combinations, the first parameter varying fastest; only a strictly better score replaces an earlier one."""
    context = context or Context()
    maximize = default_scoring(spec)[1] if maximize is None else maximize
    trials = [dict(zip(grid, reversed(values), strict=True)) for values in product(*[grid[k] for k in reversed(list(grid))])]
    scores, best = [], None
    for i, parameters in enumerate(trials):
        result = cross_validate(with_parameters(spec, parameters), data, folds, scoring, context.derive("tuning/trial", i + 1))
        scores.append(result.mean)
        if best is None or (result.mean > best[0] if maximize else result.mean < best[0]):
            best = (result.mean, parameters)
    model = with_parameters(spec, best[1]).fit(data, context=context.derive("tuning/refit")) if refit else None
    return TuningResult(tuple(trials), tuple(scores), best[1], best[0], model)


def permuted(df: DataFrame, column: str, id: str, seed: int, repeat: int = 0) -> DataFrame:
    """The rows with one column's values dealt anew: two numberings of the ids, joined."""
    a, _ = row_numbers(df.select(id), F.col(id))
    b, _ = row_numbers(df.select(id, F.col(column).alias("_v")), seeded(id, seed * 1000 + repeat), F.col(id))
    b = b.drop(id)
    return df.join(a.join(b, "_r").select(id, "_v"), id).withColumn(column, F.col("_v")).drop("_v")


def permutation_importance(fitted: Fitted, data: Dataset, scoring: Scoring | None = None, greater_is_better: bool | None = None, n_repeats: int = 5, seed: int = 0) -> list[dict]:
    """For each feature mean and population deviation of how much worse the score gets when it is permuted."""
    default, better = default_scoring(fitted.spec)
    score, sign = scoring or default, 1 if (better if greater_is_better is None else greater_is_better) else -1
    base, out = score(fitted.predict(data.df), data.targets[0]), []
    for j, c in enumerate(data.features):
        drops = [sign * (base - score(fitted.predict(permuted(data.df, c, data.id, seed + j, r)), data.targets[0])) for r in range(n_repeats)]
        out.append({"feature": c, "importance": float(np.mean(drops)), "deviation": float(np.std(drops))})
    return out
