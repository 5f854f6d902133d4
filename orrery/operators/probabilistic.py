"""Gaussian and multinomial classifiers: one grouped aggregate each; scores are column expressions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.core import Context, Dataset, Fitted, FitReport, Spec, add_numpy, check, proba_names
from orrery.errors import UnsupportedDataError
from orrery.plans.passes import SQL_COLUMNS, class_index, classes_of, dot, first_argmax, guard, held, number, partial_sums


@dataclass(frozen=True)
class _JointFit(Fitted):
    classes: tuple

    def joint(self) -> list[Column]:
        """Joint log-likelihood of each class."""
        raise NotImplementedError

    def joint_block(self, X: np.ndarray) -> np.ndarray:
        """The same of a block of rows, a column for each class."""
        raise NotImplementedError

    @property
    def _wide(self) -> bool:
        """Whether the expressions of ``joint`` would outgrow generated code."""
        return len(self.features) > SQL_COLUMNS

    def predict_proba(self, df: DataFrame) -> DataFrame:
        self._need(df)
        names = proba_names(self.classes)
        if self._wide:

            def step(X: np.ndarray) -> list[np.ndarray]:
                z = self.joint_block(X)
                e = np.exp(z - z.max(axis=1, keepdims=True))
                return list((e / e.sum(axis=1, keepdims=True)).T)

            return add_numpy(df, self.features, [(n, "double") for n in names], step)
        z = self.joint()
        top = F.greatest(*z)
        e = [F.exp(v - top) for v in z]
        total = sum(e[1:], e[0])
        return df.withColumns({n: v / total for n, v in zip(names, e, strict=True)})

    def predict(self, df: DataFrame) -> DataFrame:
        self._need(df)
        if self._wide:
            placed = add_numpy(df, self.features, [("prediction", "long")], lambda X: [self.joint_block(X).argmax(axis=1)])
            return placed.withColumn("prediction", F.element_at(F.array(*[F.lit(c) for c in self.classes]), F.col("prediction").cast("int") + 1))
        return df.withColumn("prediction", first_argmax(self.joint(), self.classes))


@dataclass(frozen=True)
class GaussianNBFit(_JointFit):
    priors: np.ndarray
    means: np.ndarray
    variances: np.ndarray

    def joint(self) -> list[Column]:
        out = []
        for prior, m, v in zip(self.priors, self.means, self.variances, strict=True):
            z = F.lit(float(np.log(prior) - 0.5 * np.log(2 * np.pi * v).sum()))
            for c, mj, vj in zip(self.features, m, v, strict=True):
                z = z - (number(c) - float(mj)) * (number(c) - float(mj)) / float(2 * vj)
            out.append(z)
        return out

    def joint_block(self, X: np.ndarray) -> np.ndarray:
        z = np.log(self.priors) - 0.5 * np.log(2 * np.pi * self.variances).sum(axis=1)
        return z - np.column_stack([((X - m) ** 2 / (2 * v)).sum(axis=1) for m, v in zip(self.means, self.variances, strict=True)])


def _class_moments(data: Dataset, what: str) -> tuple[int, list, np.ndarray, np.ndarray, np.ndarray]:
    """Number of rows, classes, and for each class its weight, means and population variances: one grouped aggregate."""
    n = guard(data.df, [*data.features, *([data.weight] if data.weight else [])], what)
    classes = classes_of(data)
    w = number(data.weight) if data.weight else F.lit(1.0)
    sums = [F.sum(w).alias("w"), *[F.sum(w * number(c)).alias(f"s{i}") for i, c in enumerate(data.features)]]
    first = {r["k"]: r for r in data.df.groupBy(F.col(f"`{data.targets[0]}`").alias("k")).agg(*sums).collect()}
    weight = np.array([first[k]["w"] for k in classes])
    means = np.array([[first[k][f"s{i}"] for i in range(len(data.features))] for k in classes]) / weight[:, None]
    place = class_index(data.targets[0], classes)
    center = [F.element_at(F.array(*[F.lit(float(v)) for v in means[:, i]]), place + 1) for i in range(len(data.features))]
    squares = [F.sum(w * (number(c) - m) * (number(c) - m)).alias(f"v{i}") for i, (c, m) in enumerate(zip(data.features, center, strict=True))]
    second = {r["k"]: r for r in data.df.groupBy(F.col(f"`{data.targets[0]}`").alias("k")).agg(*squares).collect()}
    variances = np.array([[second[k][f"v{i}"] for i in range(len(data.features))] for k in classes]) / weight[:, None]
    return n, classes, weight, means, variances


@dataclass(frozen=True)
class GaussianNaiveBayes(Spec):
    """Class means and population variances, these raised by var_smoothing times the greatest variance of a feature."""

    var_smoothing: float = 1e-9
    task = "classification"
    weights = True
    probabilistic = True

    def _fit(self, data: Dataset, context: Context) -> Fitted:
        n, classes, weight, means, variances = _class_moments(data, "GaussianNaiveBayes")
        share = weight / weight.sum()
        overall = share @ (variances + means**2) - (share @ means) ** 2
        variances = variances + max(self.var_smoothing * overall.max(), np.finfo(float).eps)
        return GaussianNBFit(self, data.features, FitReport(n, len(data.features), details={"class_order": classes}), tuple(classes), share, means, variances)


@dataclass(frozen=True)
class DiscriminantFit(_JointFit):
    priors: np.ndarray
    means: np.ndarray
    precisions: np.ndarray  # one for all classes, or one each
    logdets: np.ndarray

    def joint(self) -> list[Column]:
        out, p = [], len(self.features)
        for k, (prior, m) in enumerate(zip(self.priors, self.means, strict=True)):
            P, logdet = self.precisions[k % len(self.precisions)], self.logdets[k % len(self.precisions)]
            d = [number(c) - float(v) for c, v in zip(self.features, m, strict=True)]
            q = sum((float(P[i, j] * (1 if i == j else 2)) * d[i] * d[j] for i in range(p) for j in range(i, p)), F.lit(0.0))
            out.append(F.lit(float(np.log(prior) - 0.5 * logdet)) - 0.5 * q)
        return out

    def joint_block(self, X: np.ndarray) -> np.ndarray:
        out = []
        for k, (prior, m) in enumerate(zip(self.priors, self.means, strict=True)):
            P, logdet = self.precisions[k % len(self.precisions)], self.logdets[k % len(self.precisions)]
            out.append(np.log(prior) - 0.5 * logdet - 0.5 * (((X - m) @ P) * (X - m)).sum(axis=1))
        return np.column_stack(out)


def _class_covariances(data: Dataset, classes: list, means: np.ndarray) -> np.ndarray:
    """Sums of weighted centred cross-products per class: one pass."""
    K, p = means.shape
    with held(data, class_index(data.targets[0], classes)) as rows:

        def block(M: np.ndarray) -> np.ndarray:
            X, y, w = M[:, :-2], M[:, -2].astype(int), M[:, -1]
            D = X - means[y]
            return np.array([(D[y == k].T * w[y == k]) @ D[y == k] for k in range(K)])

        return partial_sums(rows, K * p * p, block).reshape(K, p, p)


@dataclass(frozen=True)
class LinearDiscriminantAnalysis(Spec):
    """Gaussian classes with one pooled maximum-likelihood covariance + regularization * I."""

    regularization: float = 1e-6
    task = "classification"
    weights = True
    probabilistic = True
    pooled = True

    def _fit(self, data: Dataset, context: Context) -> Fitted:
        n, classes, weight, means, _ = _class_moments(data, type(self).__name__)
        S, p = _class_covariances(data, classes, means), len(data.features)
        S = S.sum(axis=0, keepdims=True) / weight.sum() if self.pooled else S / weight[:, None, None]
        S = S + self.regularization * np.eye(p)
        return DiscriminantFit(self, data.features, FitReport(n, p, details={"class_order": classes}), tuple(classes), weight / weight.sum(), means, np.linalg.inv(S), np.linalg.slogdet(S)[1])


@dataclass(frozen=True)
class QuadraticDiscriminantAnalysis(LinearDiscriminantAnalysis):
    """Gaussian classes, each with its own covariance."""

    pooled = False


@dataclass(frozen=True)
class MultinomialNBFit(_JointFit):
    log_priors: np.ndarray
    log_probabilities: np.ndarray

    def joint(self) -> list[Column]:
        return [dot(self.features, b, a) for b, a in zip(self.log_probabilities, self.log_priors, strict=True)]

    def joint_block(self, X: np.ndarray) -> np.ndarray:
        return X @ self.log_probabilities.T + self.log_priors


@dataclass(frozen=True)
class MultinomialNaiveBayes(Spec):
    """Smoothed shares of each feature's count per class; unsmoothed (or equal) priors."""

    alpha: float = 1.0
    fit_prior: bool = True
    task = "classification"
    weights = True
    probabilistic = True
    sparse = True

    def __post_init__(self) -> None:
        check(self.alpha > 0, "alpha must be positive")

    def _fit(self, data: Dataset, context: Context) -> Fitted:
        n = guard(data.df, [*data.features, *([data.weight] if data.weight else [])], "MultinomialNaiveBayes")
        classes, w = classes_of(data), number(data.weight) if data.weight else F.lit(1.0)
        x = [number(c) for c in data.features]
        rows = {r["k"]: r for r in data.df.groupBy(F.col(f"`{data.targets[0]}`").alias("k")).agg(F.sum(w).alias("w"), F.min(F.least(*x, F.lit(float("inf")))).alias("low"), *[F.sum(w * c).alias(f"s{i}") for i, c in enumerate(x)]).collect()}
        if min(r["low"] for r in rows.values()) < 0:
            raise UnsupportedDataError("MultinomialNaiveBayes needs non-negative features")
        counts = np.array([[rows[k][f"s{i}"] for i in range(len(x))] for k in classes]) + self.alpha
        weight = np.array([rows[k]["w"] for k in classes])
        priors = np.log(weight / weight.sum()) if self.fit_prior else np.full(len(classes), -np.log(len(classes)))
        return MultinomialNBFit(self, data.features, FitReport(n, len(x), details={"class_order": classes}), tuple(classes), priors, np.log(counts / counts.sum(axis=1, keepdims=True)))
