"""Estimators that wrap other specifications."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.core import Context, Dataset, Fitted, FitReport, Spec, check, proba_names
from orrery.errors import UnsupportedDataError
from orrery.operators.linear import _logistic, _stable_log_loss
from orrery.plans import solvers
from orrery.plans.passes import first_argmax, partial_sums
from orrery.selection import KFold, split


def _named(fitted: Fitted, df: DataFrame, name: str, proba: bool = False) -> DataFrame:
    """Adds a member's prediction (or its probabilities) under names of its own, dropping what it needed."""
    have = df.columns
    out = fitted.predict_proba(df) if proba else fitted.predict(df)
    new = [c for c in out.columns if c.startswith("proba_") and c not in have] if proba else ["prediction"]
    return out.select(*[F.col(f"`{c}`") for c in have if c not in new], *[F.col(f"`{c}`").alias(f"{name}{i}" if proba else name) for i, c in enumerate(new)])


def _labels(data: Dataset) -> list:
    from orrery.plans.passes import classes_of

    return classes_of(data)


@dataclass(frozen=True)
class _ClassifierFit(Fitted):
    models: tuple
    classes: tuple

    def shares(self, df: DataFrame) -> tuple[DataFrame, list[Column], list[str]]:
        """The frame with helper columns, the class shares as expressions, and the helpers' names."""
        raise NotImplementedError

    def predict_proba(self, df: DataFrame) -> DataFrame:
        out, shares, extra = self.shares(df)
        return out.withColumns(dict(zip(proba_names(self.classes), shares, strict=True))).drop(*extra)

    def predict(self, df: DataFrame) -> DataFrame:
        out, shares, extra = self.shares(df)
        return out.withColumn("prediction", first_argmax(shares, self.classes)).drop(*extra)


@dataclass(frozen=True)
class OvRFit(_ClassifierFit):
    def shares(self, df):
        extra = []
        for k, m in enumerate(self.models):
            df = _named(m, df, f"_m{k}_", proba=True)
            extra += [f"_m{k}_0", f"_m{k}_1"]
        s = [F.col(f"_m{k}_1") for k in range(len(self.models))]
        if len(self.classes) == 2:
            return df, [1 - s[0], s[0]], extra
        total = reduce(lambda a, b: a + b, s)
        return df, [F.when(total > 0, x / total).otherwise(1.0 / len(s)) for x in s], extra


@dataclass(frozen=True)
class OneVsRestClassifier(Spec):
    """One binary model per class (two classes: one), probabilities renormalised."""

    estimator: Spec = None
    task = "classification"
    probabilistic = True

    def _fit(self, data: Dataset, context: Context) -> Fitted:
        classes, y, models = _labels(data), data.targets[0], []
        for c in classes[-1:] if len(classes) == 2 else classes:
            df = data.df.withColumn("_binary", (F.col(f"`{y}`") == F.lit(c)).cast("int"))
            models.append(self.estimator.fit(replace(data, df=df, target="_binary"), context=context.derive("class", c)))
        return OvRFit(self, data.features, models[0].report, tuple(models), tuple(classes))


@dataclass(frozen=True)
class OvOFit(_ClassifierFit):
    def shares(self, df):
        pairs = list(combinations(range(len(self.classes)), 2))
        for k, m in enumerate(self.models):
            df = _named(m, df, f"_m{k}")
        votes = [sum(((F.col(f"_m{k}") == F.lit(self.classes[c])).cast("double") for k, p in enumerate(pairs) if c in p), F.lit(0.0)) / len(pairs) for c in range(len(self.classes))]
        return df, votes, [f"_m{k}" for k in range(len(self.models))]


@dataclass(frozen=True)
class OneVsOneClassifier(Spec):
    """One model per pair of classes; probabilities are shares of votes."""

    estimator: Spec = None
    task = "classification"
    probabilistic = True

    def _fit(self, data: Dataset, context: Context) -> Fitted:
        classes, y = _labels(data), data.targets[0]
        models = [self.estimator.fit(data.with_df(data.df.where(F.col(f"`{y}`").isin(a, b))), context=context.derive("pair", a, b)) for a, b in combinations(classes, 2)]
        return OvOFit(self, data.features, models[0].report, tuple(models), tuple(classes))


@dataclass(frozen=True)
class MultiFit(Fitted):
    models: tuple
    targets: tuple[str, ...]
    chained: bool = False

    def predict(self, df: DataFrame) -> DataFrame:
        """Adds ``prediction_<target>``; a chain feeds each prediction to the next model."""
        for m, t in zip(self.models, self.targets, strict=True):
            if self.chained:
                df = _named(m, df, f"prediction_{t}").withColumn(f"_chain_{t}", F.col(f"prediction_{t}").cast("double"))
            else:
                df = _named(m, df, f"prediction_{t}")
        return df.drop(*[f"_chain_{t}" for t in self.targets])


@dataclass(frozen=True)
class MultiOutputRegressor(Spec):
    """One model per target column."""

    estimator: Spec = None
    task = "regression"

    def _fit(self, data: Dataset, context: Context) -> Fitted:
        models = [self.estimator.fit(replace(data, target=t), context=context.derive("output", t)) for t in data.targets]
        return MultiFit(self, data.features, models[0].report, tuple(models), data.targets)


@dataclass(frozen=True)
class MultiOutputClassifier(MultiOutputRegressor):
    """One classifier per target column."""

    task = "classification"


@dataclass(frozen=True)
class ClassifierChain(Spec):
    """Each classifier also sees the earlier targets: true ones in the fit, predicted ones afterwards. Labels must be numbers."""

    estimator: Spec = None
    order: tuple | None = None
    task = "classification"

    def _fit(self, data: Dataset, context: Context) -> Fitted:
        targets = tuple(data.targets[i] for i in self.order) if self.order else data.targets
        df, features, models = data.df, list(data.features), []
        for t in targets:
            models.append(self.estimator.fit(replace(data, df=df, features=tuple(features), target=t), context=context.derive("link", t)))
            df = df.withColumn(f"_chain_{t}", F.col(f"`{t}`").cast("double"))
            features.append(f"_chain_{t}")
        return MultiFit(self, data.features, models[0].report, tuple(models), targets, True)


@dataclass(frozen=True)
class AverageFit(Fitted):
    """Weighted means of members' predictions, or of their probabilities, or votes."""

    models: tuple
    weights: tuple[float, ...]
    classes: tuple | None = None
    hard: bool = False

    def _shares(self, df: DataFrame) -> tuple[DataFrame, list[Column], list[str]]:
        extra, W = [], sum(self.weights)
        for k, m in enumerate(self.models):
            df = _named(m, df, f"_m{k}" if self.hard or self.classes is None else f"_m{k}_", proba=not self.hard and self.classes is not None)
            extra += [f"_m{k}"] if self.hard or self.classes is None else [f"_m{k}_{i}" for i in range(len(self.classes))]
        if self.classes is None:
            return df, [sum((w * F.col(f"_m{k}") for k, w in enumerate(self.weights)), F.lit(0.0)) / W], extra
        one = lambda k, i: (F.col(f"_m{k}") == F.lit(self.classes[i])).cast("double") if self.hard else F.col(f"_m{k}_{i}")
        return df, [sum((w * one(k, i) for k, w in enumerate(self.weights)), F.lit(0.0)) / W for i in range(len(self.classes))], extra

    def predict(self, df: DataFrame) -> DataFrame:
        out, shares, extra = self._shares(df)
        return out.withColumn("prediction", shares[0] if self.classes is None else first_argmax(shares, self.classes)).drop(*extra)

    def predict_proba(self, df: DataFrame) -> DataFrame:
        if self.classes is None:
            return super().predict_proba(df)
        out, shares, extra = self._shares(df)
        return out.withColumns(dict(zip(proba_names(self.classes), shares, strict=True))).drop(*extra)


@dataclass(frozen=True)
class VotingRegressor(Spec):
    """Weighted mean of the members' predictions."""

    estimators: tuple = ()
    voting_weights: tuple | None = None
    task = "regression"

    def _fit(self, data: Dataset, context: Context) -> Fitted:
        models = tuple(e.fit(data, context=context.derive("member", i)) for i, e in enumerate(self.estimators))
        return AverageFit(self, data.features, models[0].report, models, tuple(self.voting_weights or [1.0] * len(models)))


@dataclass(frozen=True)
class VotingClassifier(VotingRegressor):
    """soft: weighted mean of probabilities; hard: weighted votes, of equal ones the first class."""

    voting: str = "soft"
    task = "classification"
    probabilistic = True

    def _fit(self, data: Dataset, context: Context) -> Fitted:
        check(self.voting in ("soft", "hard"), "voting must be soft or hard")
        base = super()._fit(data, context)
        return replace(base, classes=tuple(_labels(data)), hard=self.voting == "hard")


@dataclass(frozen=True)
class BaggingRegressor(Spec):
    """Members on Poisson-bootstrap (or Bernoulli) rows and random features; predictions averaged.

    Row multiplicities come from a seeded hash of the id, so every member's sample is one projection, reproducible anywhere.
    """

    estimator: Spec = None
    n_estimators: int = 10
    max_samples: float = 1.0
    max_features: float = 1.0
    bootstrap: bool = True
    task = "regression"

    def _member(self, data: Dataset, i: int, context: Context) -> Fitted:
        rng = context.rng("features", i)
        k = max(1, round(self.max_features * len(data.features)))
        features = tuple(data.features[j] for j in sorted(rng.choice(len(data.features), k, replace=False)))
        key = F.col(f"`{data.id}`") if data.id else F.xxhash64(*[F.col(f"`{c}`") for c in data.features])
        u = F.pmod(F.xxhash64(key, F.lit(context.derive("rows", i).seed >> 2)), F.lit(1 << 30)) / float(1 << 30)
        if self.bootstrap:
            p, total, cuts = np.exp(-self.max_samples), 0.0, []
            for m in range(12):
                total += p
                cuts.append(total)
                p *= self.max_samples / (m + 1)
            times = sum(((u >= c).cast("int") for c in cuts), F.lit(0))
            df = data.df.withColumn("_times", F.explode(F.array_repeat(F.lit(1), times))).drop("_times")
        else:
            df = data.df.where(u < self.max_samples)
        return self.estimator.fit(replace(data, df=df, features=features), context=context.derive("member", i))

    def _fit(self, data: Dataset, context: Context) -> Fitted:
        models = tuple(self._member(data, i, context) for i in range(self.n_estimators))
        return AverageFit(self, data.features, models[0].report, models, (1.0,) * len(models))


@dataclass(frozen=True)
class BaggingClassifier(BaggingRegressor):
    """Like BaggingRegressor, averaging probabilities."""

    task = "classification"
    probabilistic = True

    def _fit(self, data: Dataset, context: Context) -> Fitted:
        return replace(super()._fit(data, context), classes=tuple(_labels(data)))


def _out_of_fold(spec: Spec, data: Dataset, cv: KFold, context: Context, name: str, proba: bool) -> DataFrame:
    """The rows with predictions of models that have not seen them: a union of scored folds, no join."""
    df = data.df if "_fold" in data.df.columns else split(cv, data.df, data.id).withColumnRenamed("fold", "_fold")
    parts = []
    for k in range(1, cv.n_splits + 1):
        m = spec.fit(data.with_df(df.where(F.col("_fold") != k)), context=context.derive("fold", k))
        parts.append(_named(m, df.where(F.col("_fold") == k), name, proba))
    return reduce(DataFrame.unionByName, parts)


@dataclass(frozen=True)
class StackFit(Fitted):
    models: tuple
    final: Fitted
    proba: bool

    def _stacked(self, df: DataFrame) -> DataFrame:
        for k, m in enumerate(self.models):
            df = _named(m, df, f"_stack{k}_" if self.proba else f"_stack{k}", self.proba)
        return df

    def predict(self, df: DataFrame) -> DataFrame:
        return self.final.predict(self._stacked(df)).drop(*self.final.features)

    def predict_proba(self, df: DataFrame) -> DataFrame:
        return self.final.predict_proba(self._stacked(df)).drop(*self.final.features)


@dataclass(frozen=True)
class StackingRegressor(Spec):
    """Out-of-fold predictions of the members are the features of a final model; members are refitted on all rows."""

    estimators: tuple = ()
    final_estimator: Spec = None
    cv: KFold = field(default_factory=KFold)
    task = "regression"
    stack_proba = False

    def _fit(self, data: Dataset, context: Context) -> Fitted:
        if data.id is None:
            raise UnsupportedDataError("stacking needs an id column")
        df = data.df
        for k, e in enumerate(self.estimators):
            df = _out_of_fold(e, data.with_df(df), self.cv, context.derive("member", k), f"_stack{k}_" if self.stack_proba else f"_stack{k}", self.stack_proba)
        names = tuple(c for c in df.columns if c.startswith("_stack"))
        final = self.final_estimator.fit(replace(data, df=df, features=names), context=context.derive("final"))
        models = tuple(e.fit(data, context=context.derive("refit", k)) for k, e in enumerate(self.estimators))
        return StackFit(self, data.features, final.report, models, final, self.stack_proba)


@dataclass(frozen=True)
class StackingClassifier(StackingRegressor):
    """Like StackingRegressor, on the members' probabilities."""

    task = "classification"
    probabilistic = True
    stack_proba = True


@dataclass(frozen=True)
class TransformedFit(Fitted):
    model: Fitted

    def predict(self, df: DataFrame) -> DataFrame:
        out = self.model.predict(df)
        return out.withColumn("prediction", self.spec.inverse_func(F.col("prediction")))


@dataclass(frozen=True)
class TransformedTargetRegressor(Spec):
    """Fits on func(target) and predicts inverse_func of it; both map columns to columns."""

    regressor: Spec = None
    func: Callable[[Column], Column] = lambda c: c
    inverse_func: Callable[[Column], Column] = lambda c: c
    task = "regression"

    def _fit(self, data: Dataset, context: Context) -> Fitted:
        df = data.df.withColumn("_target", self.func(F.col(f"`{data.targets[0]}`")))
        model = self.regressor.fit(replace(data, df=df, target="_target"), context=context)
        return TransformedFit(self, data.features, model.report, model)


@dataclass(frozen=True)
class CalibratedFit(_ClassifierFit):
    slopes: Sequence = ()

    def shares(self, df):
        df = _named(self.models[0], df, "_c_", proba=True)
        extra = [f"_c_{i}" for i in range(len(self.classes))]
        s = [1 / (1 + F.exp(-(F.lit(float(a)) * F.col(f"_c_{i}") + float(b)))) for i, (a, b) in zip(range(1, 2) if len(self.classes) == 2 else range(len(self.classes)), self.slopes, strict=True)]
        if len(self.classes) == 2:
            return df, [1 - s[0], s[0]], extra
        total = reduce(lambda a, b: a + b, s)
        return df, [x / total for x in s], extra


@dataclass(frozen=True)
class CalibratedClassifier(Spec):
    """Platt scaling of out-of-fold probabilities: two parameters per class by L-BFGS over distributed sums."""

    estimator: Spec = None
    cv: KFold = field(default_factory=KFold)
    task = "classification"
    probabilistic = True

    def _fit(self, data: Dataset, context: Context) -> Fitted:
        classes, y = _labels(data), data.targets[0]
        scored = _out_of_fold(self.estimator, data, self.cv, context, "_c_", True).persist()
        slopes = []
        for i in [1] if len(classes) == 2 else range(len(classes)):
            rows = scored.select(F.col(f"_c_{i}").alias("p"), (F.col(f"`{y}`") == F.lit(classes[i])).cast("double").alias("y"))

            def objective(theta: np.ndarray, rows: DataFrame = rows) -> tuple[float, np.ndarray]:
                def block(M: np.ndarray) -> np.ndarray:
                    z = theta[0] * M[:, 0] + theta[1]
                    r = _logistic(z) - M[:, 1]
                    return np.array([_stable_log_loss(z, M[:, 1]).sum(), r @ M[:, 0], r.sum()])

                t = partial_sums(rows, 3, block)
                return t[0], t[1:]

            slopes.append(tuple(solvers.lbfgs(objective, np.array([1.0, 0.0])).parameters))
        scored.unpersist()
        model = self.estimator.fit(data, context=context.derive("refit"))
        return CalibratedFit(self, data.features, model.report, (model,), tuple(classes), tuple(slopes))


@dataclass(frozen=True)
class ThresholdFit(Fitted):
    model: Fitted
    classes: tuple
    threshold: float

    def predict_proba(self, df: DataFrame) -> DataFrame:
        return self.model.predict_proba(df)

    def predict(self, df: DataFrame) -> DataFrame:
        out = _named(self.model, df, "_t_", proba=True)
        return out.withColumn("prediction", F.when(F.col("_t_1") >= self.threshold, F.lit(self.classes[1])).otherwise(F.lit(self.classes[0]))).drop("_t_0", "_t_1")


@dataclass(frozen=True)
class ThresholdSelectionWrapper(Spec):
    """The first of the thresholds 0, 0.01 ... 1 with the best out-of-fold f1, accuracy or balanced accuracy; two classes."""

    estimator: Spec = None
    metric: str = "f1"
    cv: KFold = field(default_factory=KFold)
    task = "classification"
    probabilistic = True

    def __post_init__(self) -> None:
        check(self.metric in ("f1", "accuracy", "balanced_accuracy"), "unknown metric")

    def _fit(self, data: Dataset, context: Context) -> Fitted:
        classes = _labels(data)
        check(len(classes) == 2, "a threshold needs two classes")
        scored = _out_of_fold(self.estimator, data, self.cv, context, "_t_", True)
        hit = F.col(f"`{data.targets[0]}`") == F.lit(classes[1])
        # one histogram over the grid; a row counts for all thresholds up to its own
        grid = scored.select(F.least(F.floor(F.col("_t_1") * 100 + 1e-9), F.lit(100)).cast("int").alias("g"), hit.cast("double").alias("y"))
        counts = {r["g"]: (r["p"], r["n"]) for r in grid.groupBy("g").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n")).collect()}
        P, N = sum(c[0] for c in counts.values()), sum(c[1] for c in counts.values())
        best = (-1.0, 0.0)
        for g in range(101):
            tp, fp = sum(c[0] for k, c in counts.items() if k >= g), sum(c[1] for k, c in counts.items() if k >= g)
            value = {"f1": 2 * tp / max(tp + fp + P, 1e-300), "accuracy": (tp + N - fp) / (P + N), "balanced_accuracy": 0.5 * (tp / max(P, 1e-300) + (N - fp) / max(N, 1e-300))}[self.metric]
            if value > best[0] + 1e-12:
                best = (value, g / 100)
        model = self.estimator.fit(data, context=context.derive("refit"))
        return ThresholdFit(self, data.features, FitReport(model.report.observations, len(data.features), details={"threshold": best[1], "score": best[0]}), model, tuple(classes), best[1])
