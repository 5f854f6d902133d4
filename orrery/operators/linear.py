"""Linear models. Those of the Gram family take one pass of cross-products; the others a few passes of small sums."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.core import Context, Dataset, Fitted, FitReport, Spec, check, proba_names
from orrery.errors import UnsupportedDataError
from orrery.plans import solvers
from orrery.plans.ordering import quantiles
from orrery.plans.passes import class_index, classes_of, collect_local, dot, first_argmax, guard, held, moments, number, partial_sums, pool, sigmoid


def _report(data: Dataset, n: int, context: Context, trace: solvers.Trace | None = None, **details) -> FitReport:
    status, notes = "success", ()
    if trace is not None:
        details |= {"iterations": trace.iterations, "converged": trace.converged, "objective_history": trace.history}
        if not trace.converged:
            status, notes = "max_iterations", ("the iteration did not converge",)
    return FitReport(int(n), len(data.features), status, warnings=notes, details=details, root_seed=context.root_seed, stream_id=context.stream_id)


@dataclass(frozen=True)
class LinearFit(Fitted):
    """intercept + coefficients . features, through an inverse link."""

    coefficients: np.ndarray
    intercept: float
    link: str = "identity"

    def score(self) -> Column:
        z = dot(self.features, self.coefficients, self.intercept)
        return F.exp(z) if self.link == "log" else z

    def predict(self, df: DataFrame) -> DataFrame:
        self._need(df)
        return df.withColumn("prediction", self.score())


@dataclass(frozen=True)
class MeanFit(Fitted):
    total: float
    weight: float

    @property
    def mean(self) -> float:
        return self.total / self.weight

    def predict(self, df: DataFrame) -> DataFrame:
        return df.withColumn("prediction", F.lit(self.mean))


@dataclass(frozen=True)
class MeanRegressor(Spec):
    """Predicts the (weighted) mean of the target."""

    task = "regression"
    weights = True
    partial = True

    def _fit(self, data: Dataset, context: Context) -> Fitted:
        n = guard(data.df, [data.targets[0], *([data.weight] if data.weight else [])], "MeanRegressor")
        w = number(data.weight) if data.weight else F.lit(1.0)
        row = data.df.agg(F.sum(w * number(data.targets[0])).alias("s"), F.sum(w).alias("w")).first()
        return MeanFit(self, data.features, _report(data, n, context), row["s"], row["w"])

    def partial_fit(self, fitted, data: Dataset, context: Context | None = None) -> Fitted:
        new = self._fit(data, context or Context())
        if fitted is None:
            return new
        report = FitReport(fitted.report.observations + new.report.observations, len(fitted.features))
        return MeanFit(self, fitted.features, report, fitted.total + new.total, fitted.weight + new.weight)


def _gram_parts(data: Dataset, fit_intercept: bool, what: str) -> tuple:
    """Moments, X'WX and X'Wy (centred if there is an intercept), means."""
    m = moments(data.df, [*data.features, *data.targets], data.weight, what)
    cross = m.cross if fit_intercept else m.raw()
    p = len(data.features)
    mean = m.mean if fit_intercept else np.zeros(len(m.mean))
    return m, cross[:p, :p], cross[:p, p:], mean[:p], mean[p:]


@dataclass(frozen=True)
class LinearRegression(Spec):
    """Least squares, of least norm if the features are dependent."""

    fit_intercept: bool = True
    solver: str = "qr"
    task = "regression"
    weights = True

    def __post_init__(self) -> None:
        check(self.solver in ("qr", "svd", "cholesky", "lsqr"), "unknown solver")

    def _fit(self, data: Dataset, context: Context) -> Fitted:
        m, G, c, mx, my = _gram_parts(data, self.fit_intercept, "LinearRegression")
        b = solvers.solve_symmetric(G, c[:, 0])
        return LinearFit(self, data.features, _report(data, m.n, context, solver="normal equations"), b, float(my[0] - mx @ b) if self.fit_intercept else 0.0)


@dataclass(frozen=True)
class RidgeRegression(Spec):
    """Least squares plus lambda times the squared norm of the coefficients; the intercept is free."""

    lam: float = 1.0
    fit_intercept: bool = True
    task = "regression"
    weights = True

    def __post_init__(self) -> None:
        check(self.lam >= 0, "lam must not be negative")

    def _fit(self, data: Dataset, context: Context) -> Fitted:
        m, G, c, mx, my = _gram_parts(data, self.fit_intercept, "RidgeRegression")
        b = solvers.solve_symmetric(G + self.lam * np.eye(len(G)), c[:, 0])
        return LinearFit(self, data.features, _report(data, m.n, context, solver="normal equations"), b, float(my[0] - mx @ b) if self.fit_intercept else 0.0)


@dataclass(frozen=True)
class ElasticNet(Spec):
    """(1/2W) sum w r^2 + lam * (l1_ratio |b|_1 + (1 - l1_ratio)/2 |b|^2), by coordinate descent on the cross-products."""

    lam: float = 1.0
    l1_ratio: float = 0.5
    fit_intercept: bool = True
    max_iterations: int = 1000
    tolerance: float = 1e-6
    task = "regression"
    weights = True
    sparse = True

    def __post_init__(self) -> None:
        check(self.lam >= 0 and 0 <= self.l1_ratio <= 1, "lam must not be negative and l1_ratio lie within 0 and 1")

    def _fit(self, data: Dataset, context: Context) -> Fitted:
        m, G, c, mx, my = _gram_parts(data, self.fit_intercept, type(self).__name__)
        t = solvers.elastic_net(G / m.weight, c[:, 0] / m.weight, self.lam * self.l1_ratio, self.lam * (1 - self.l1_ratio), context.iterations(self.max_iterations), context.tol(self.tolerance))
        b = t.parameters
        return LinearFit(self, data.features, _report(data, m.n, context, t), b, float(my[0] - mx @ b) if self.fit_intercept else 0.0)


@dataclass(frozen=True)
class Lasso(ElasticNet):
    """ElasticNet with l1_ratio 1."""

    l1_ratio: float = 1.0


# --- logistic ----------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class OneVsRestLogit(Fitted):
    """One sigmoid per class (two classes: one for the last), renormalised."""

    classes: tuple
    coefficients: np.ndarray  # (models, features)
    intercepts: np.ndarray

    def probabilities(self) -> list[Column]:
        s = [sigmoid(dot(self.features, b, a)) for b, a in zip(self.coefficients, self.intercepts, strict=True)]
        if len(self.classes) == 2:
            return [1 - s[0], s[0]]
        total = sum(s[1:], s[0])
        return [F.when(total > 0, x / total).otherwise(1.0 / len(s)) for x in s]

    def predict_proba(self, df: DataFrame) -> DataFrame:
        self._need(df)
        return df.withColumns(dict(zip(proba_names(self.classes), self.probabilities(), strict=True)))

    def predict(self, df: DataFrame) -> DataFrame:
        self._need(df)
        return df.withColumn("prediction", first_argmax(self.probabilities(), self.classes))


def _binary_targets(classes: Sequence) -> list[int]:
    return [1] if len(classes) == 2 else list(range(len(classes)))


def _design(M: np.ndarray, fit_intercept: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    X, y, w = M[:, :-2], M[:, -2], M[:, -1]
    return (np.column_stack((X, np.ones(len(X)))) if fit_intercept else X), y, w


def _stable_log_loss(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum(z, 0) - z * y + np.log1p(np.exp(-np.abs(z)))


def _logistic(z: np.ndarray) -> np.ndarray:
    e = np.exp(-np.abs(z))
    return np.where(z >= 0, 1 / (1 + e), e / (1 + e))


@dataclass(frozen=True)
class LogisticRegression(Spec):
    """Sum of logistic losses + lam/2 |b|^2, by damped Newton; each iteration is one pass of gradient and Hessian."""

    lam: float = 1.0
    fit_intercept: bool = True
    max_iterations: int = 100
    tolerance: float = 1e-8
    task = "classification"
    weights = True
    probabilistic = True

    def __post_init__(self) -> None:
        check(self.lam >= 0, "lam must not be negative")

    def _fit(self, data: Dataset, context: Context) -> Fitted:
        n = guard(data.df, [*data.features, *([data.weight] if data.weight else [])], "LogisticRegression")
        classes = classes_of(data)
        p = len(data.features)
        q = p + self.fit_intercept
        penalty = np.array([self.lam] * p + [0.0] * self.fit_intercept)
        B, A, traces = [], [], []
        with held(data, class_index(data.targets[0], classes)) as rows:
            for k in _binary_targets(classes):

                def step(theta: np.ndarray, k: int = k) -> tuple[float, np.ndarray, np.ndarray]:
                    def block(M: np.ndarray) -> np.ndarray:
                        X, y, w = _design(M, self.fit_intercept)
                        y = (y == k).astype(float)
                        z = X @ theta
                        s = _logistic(z)
                        return np.concatenate(([w @ _stable_log_loss(z, y)], X.T @ (w * (s - y)), ((X.T * (w * s * (1 - s))) @ X).ravel()))

                    total = partial_sums(rows, 1 + q + q * q, block)
                    return total[0] + 0.5 * penalty @ theta**2, total[1 : 1 + q] + penalty * theta, total[1 + q :].reshape(q, q) + np.diag(penalty)

                t = solvers.newton(step, np.zeros(q), context.iterations(self.max_iterations), context.tol(self.tolerance))
                traces.append(t)
                B.append(t.parameters[:p])
                A.append(t.parameters[p] if self.fit_intercept else 0.0)
        worst = min(traces, key=lambda t: t.converged)
        return OneVsRestLogit(self, data.features, _report(data, n, context, worst, class_order=classes), tuple(classes), np.array(B), np.array(A))


@dataclass(frozen=True)
class SparseLogisticRegression(Spec):
    """Mean logistic loss + lam * (l1_ratio |b|_1 + (1 - l1_ratio)/2 |b|^2), by accelerated proximal gradients."""

    lam: float = 1.0
    l1_ratio: float = 1.0
    fit_intercept: bool = True
    max_iterations: int = 1000
    tolerance: float = 1e-6
    task = "classification"
    weights = True
    probabilistic = True
    sparse = True

    def _fit(self, data: Dataset, context: Context) -> Fitted:
        m = moments(data.df, data.features, data.weight, "SparseLogisticRegression")
        classes = classes_of(data)
        p, q = len(data.features), len(data.features) + self.fit_intercept
        raw = m.raw() / m.weight
        if self.fit_intercept:
            raw = np.block([[raw, m.mean[:, None]], [m.mean[None, :], np.ones((1, 1))]])
        step = 1 / (0.25 * np.linalg.eigvalsh(raw)[-1] + self.lam * (1 - self.l1_ratio) + 1e-12)
        l1, l2 = self.lam * self.l1_ratio, self.lam * (1 - self.l1_ratio)
        mask = np.array([1.0] * p + [0.0] * self.fit_intercept)
        B, A, traces = [], [], []
        with held(data, class_index(data.targets[0], classes)) as rows:
            for k in _binary_targets(classes):

                def objective(theta: np.ndarray, k: int = k) -> tuple[float, np.ndarray]:
                    def block(M: np.ndarray) -> np.ndarray:
                        X, y, w = _design(M, self.fit_intercept)
                        y = (y == k).astype(float)
                        z = X @ theta
                        return np.concatenate(([w @ _stable_log_loss(z, y)], X.T @ (w * (_logistic(z) - y))))

                    total = partial_sums(rows, 1 + q, block) / m.weight
                    return total[0] + 0.5 * l2 * mask @ theta**2, total[1:] + l2 * mask * theta

                prox = lambda v, s: np.where(mask > 0, np.sign(v) * np.maximum(np.abs(v) - s * l1, 0), v)
                t = solvers.fista(objective, prox, np.zeros(q), step, max_iterations=context.iterations(self.max_iterations), tolerance=context.tol(self.tolerance))
                traces.append(t)
                B.append(t.parameters[:p])
                A.append(t.parameters[p] if self.fit_intercept else 0.0)
        return OneVsRestLogit(self, data.features, _report(data, m.n, context, min(traces, key=lambda t: t.converged), class_order=classes), tuple(classes), np.array(B), np.array(A))


# --- models fitted by L-BFGS over distributed gradients ------------------------------------------------------------------


def _lbfgs_fit(spec, data: Dataset, context: Context, start: np.ndarray, block: Callable[[np.ndarray, np.ndarray], np.ndarray], penalty: np.ndarray, target: Column | None = None) -> solvers.Trace:
    """``block(theta, M)`` gives value and gradient of a block of rows; the coefficients of the features come first.

    What is minimised is the mean over the weights, with coefficients in units of their features' sizes, so that the tolerance means
    the same for any number of rows and any units.
    """
    p = len(data.features)
    with held(data, target) as rows:
        sums = partial_sums(rows, p + 1, lambda M: np.concatenate((M[:, -1] @ M[:, :p] ** 2, [M[:, -1].sum()])))
        weight, units = max(float(sums[p]), 1e-300), np.ones(len(start))
        units[:p] = np.where(sums[:p] > 0, np.sqrt(sums[:p] / weight), 1.0)

        def objective(scaled: np.ndarray) -> tuple[float, np.ndarray]:
            theta = scaled / units
            total = partial_sums(rows, 1 + len(start), lambda M: block(theta, M))
            return (total[0] + 0.5 * penalty @ theta**2) / weight, (total[1:] + penalty * theta) / units / weight

        t = solvers.lbfgs(objective, start * units, tolerance=context.tol(spec.tolerance), max_iterations=context.iterations(spec.max_iterations))
        t.parameters = t.parameters / units
        t.history = [h * weight for h in t.history]
        return t


@dataclass(frozen=True)
class _GLM(Spec):
    lam: float = 0.0
    fit_intercept: bool = True
    max_iterations: int = 500
    tolerance: float = 1e-6
    task = "regression"
    weights = True

    def family(self) -> tuple[float, str]:
        """Power of the variance function, and the link."""
        raise NotImplementedError

    def _fit(self, data: Dataset, context: Context) -> Fitted:
        name, y = type(self).__name__, number(data.targets[0])
        n = guard(data.df, [*data.features, *data.targets, *([data.weight] if data.weight else [])], name)
        power, link = self.family()
        w = number(data.weight) if data.weight else F.lit(1.0)
        row = data.df.agg(F.min(y).alias("least"), (F.sum(w * y) / F.sum(w)).alias("mean")).first()
        if row["least"] < 0 or (power >= 2 and row["least"] <= 0):
            raise UnsupportedDataError(f"{name} needs {'positive' if power >= 2 else 'non-negative'} targets")
        p, q = len(data.features), len(data.features) + self.fit_intercept
        start = np.zeros(q)
        if self.fit_intercept:
            start[p] = np.log(max(row["mean"], 1e-12)) if link == "log" else row["mean"]

        def block(theta: np.ndarray, M: np.ndarray) -> np.ndarray:
            X, y, w = _design(M, self.fit_intercept)
            z = X @ theta
            mu = np.exp(np.clip(z, -700, 700)) if link == "log" else z
            if (mu <= 0).any():
                return np.concatenate(([np.inf], np.zeros(q)))
            return np.concatenate(([w @ _half_deviance(y, mu, power)], X.T @ (w * (mu - y) * mu**-power * (mu if link == "log" else 1.0))))

        t = _lbfgs_fit(self, data, context, start, block, np.array([self.lam] * p + [0.0] * self.fit_intercept))
        return LinearFit(self, data.features, _report(data, n, context, t, power=power, link=link), t.parameters[:p], float(t.parameters[p]) if self.fit_intercept else 0.0, link)


def _half_deviance(y: np.ndarray, mu: np.ndarray, power: float) -> np.ndarray:
    safe = np.maximum(y, 1e-300)
    if power == 0:
        return 0.5 * (y - mu) ** 2
    if power == 1:
        return np.where(y > 0, y * np.log(safe / mu), 0.0) - y + mu
    if power == 2:
        return y / mu - np.log(safe / mu) - 1
    return np.where(y > 0, safe ** (2 - power), 0.0) / ((1 - power) * (2 - power)) - y * mu ** (1 - power) / (1 - power) + mu ** (2 - power) / (2 - power)


@dataclass(frozen=True)
class PoissonRegression(_GLM):
    """Half deviance of counts with a log link."""

    def family(self) -> tuple[float, str]:
        return 1.0, "log"


@dataclass(frozen=True)
class GammaRegression(_GLM):
    """Half deviance of positive targets with a log link."""

    def family(self) -> tuple[float, str]:
        return 2.0, "log"


@dataclass(frozen=True)
class TweedieRegression(_GLM):
    """Half deviance with variance mu^power; link auto: identity for power <= 0, else log."""

    power: float = 1.5
    link: str = "auto"

    def __post_init__(self) -> None:
        check(not 0 < self.power < 1, "power must not lie between 0 and 1")
        check(self.link in ("auto", "log", "identity"), "unknown link")

    def family(self) -> tuple[float, str]:
        return self.power, ("identity" if self.power <= 0 else "log") if self.link == "auto" else self.link


@dataclass(frozen=True)
class QuantileRegression(Spec):
    """Pinball loss, smoothed within epsilon of zero, + lam/2 |b|^2."""

    quantile: float = 0.5
    lam: float = 0.0
    epsilon: float = 1e-4
    fit_intercept: bool = True
    max_iterations: int = 500
    tolerance: float = 1e-6
    task = "regression"
    weights = True

    def __post_init__(self) -> None:
        check(0 < self.quantile < 1 and self.epsilon > 0, "quantile must lie between 0 and 1 and epsilon be positive")

    def _fit(self, data: Dataset, context: Context) -> Fitted:
        n = guard(data.df, [*data.features, *data.targets, *([data.weight] if data.weight else [])], "QuantileRegression")
        p, q = len(data.features), len(data.features) + self.fit_intercept
        start = np.zeros(q)
        if self.fit_intercept:
            start[p] = quantiles(data.df, number(data.targets[0]), [0.5])[0]

        def block(theta: np.ndarray, M: np.ndarray) -> np.ndarray:
            X, y, w = _design(M, self.fit_intercept)
            r = y - X @ theta
            a, e = np.abs(r), self.epsilon
            smooth = np.where(a <= e, 0.5 * r * r / e, a - 0.5 * e)
            slope = np.where(a <= e, r / e, np.sign(r))
            return np.concatenate(([w @ (0.5 * smooth + (self.quantile - 0.5) * r)], -X.T @ (w * (0.5 * slope + self.quantile - 0.5))))

        t = _lbfgs_fit(self, data, context, start, block, np.array([self.lam] * p + [0.0] * self.fit_intercept))
        return LinearFit(self, data.features, _report(data, n, context, t), t.parameters[:p], float(t.parameters[p]) if self.fit_intercept else 0.0)


@dataclass(frozen=True)
class HuberRegression(Spec):
    """Joint fit of coefficients and a scale s: s*eps + r^2/s within eps*s of zero, 2*eps*|r| + (eps - eps^2)*s beyond, + lam/2 |b|^2."""

    epsilon: float = 1.35
    lam: float = 1.0
    fit_intercept: bool = True
    max_iterations: int = 500
    tolerance: float = 1e-6
    task = "regression"
    weights = True

    def _fit(self, data: Dataset, context: Context) -> Fitted:
        n = guard(data.df, [*data.features, *data.targets, *([data.weight] if data.weight else [])], "HuberRegression")
        p, q = len(data.features), len(data.features) + self.fit_intercept
        y = number(data.targets[0])
        middle, deviation = quantiles(data.df, y, [0.5])[0], data.df.agg(F.stddev_pop(y)).first()[0]
        start = np.zeros(q + 1)
        if self.fit_intercept:
            start[p] = middle
        start[q] = np.log(max(deviation or 0.0, 1e-6))

        def block(theta: np.ndarray, M: np.ndarray) -> np.ndarray:
            X, y, w = _design(M, self.fit_intercept)
            s, e = np.exp(theta[q]), self.epsilon
            r = y - X @ theta[:q]
            a = np.abs(r)
            near = a <= e * s
            loss = np.where(near, e * s + r * r / s, 2 * e * a + (e - e * e) * s)
            slope = np.where(near, 2 * r / s, 2 * e * np.sign(r))
            by_scale = np.where(near, e - (r / s) ** 2, e - e * e)
            return np.concatenate(([w @ loss], -X.T @ (w * slope), [s * (w @ by_scale)]))

        t = _lbfgs_fit(self, data, context, start, block, np.array([self.lam] * p + [0.0] * (1 + self.fit_intercept)))
        return LinearFit(self, data.features, _report(data, n, context, t, scale=float(np.exp(t.parameters[q]))), t.parameters[:p], float(t.parameters[p]) if self.fit_intercept else 0.0)


@dataclass(frozen=True)
class OrdinalFit(Fitted):
    classes: tuple
    coefficients: np.ndarray
    thresholds: np.ndarray

    def probabilities(self) -> list[Column]:
        z = dot(self.features, self.coefficients)
        below = [sigmoid(F.lit(float(t)) - z) for t in self.thresholds]
        return [below[0], *[b - a for a, b in zip(below[:-1], below[1:], strict=True)], 1 - below[-1]]

    def predict_proba(self, df: DataFrame) -> DataFrame:
        self._need(df)
        return df.withColumns(dict(zip(proba_names(self.classes), self.probabilities(), strict=True)))

    def predict(self, df: DataFrame) -> DataFrame:
        self._need(df)
        return df.withColumn("prediction", first_argmax(self.probabilities(), self.classes))


@dataclass(frozen=True)
class OrdinalRegression(Spec):
    """Cumulative logits with increasing thresholds (the first, and logarithms of the differences) + lam/2 |b|^2."""

    lam: float = 0.0
    max_iterations: int = 500
    tolerance: float = 1e-6
    task = "classification"
    weights = True
    probabilistic = True

    def _fit(self, data: Dataset, context: Context) -> Fitted:
        n = guard(data.df, [*data.features, *([data.weight] if data.weight else [])], "OrdinalRegression")
        classes = classes_of(data)
        p, K = len(data.features), len(classes)
        counts = {r[0]: r[1] for r in data.df.groupBy(F.col(f"`{data.targets[0]}`")).count().collect()}
        share = np.cumsum([counts[c] for c in classes])[:-1] / n
        logits = np.log(share / (1 - share))
        start = np.concatenate((np.zeros(p), logits[:1], np.log(np.maximum(np.diff(logits), 1e-3))))

        def thresholds(theta: np.ndarray) -> np.ndarray:
            return np.cumsum(np.concatenate((theta[p : p + 1], np.exp(theta[p + 1 :]))))

        def block(theta: np.ndarray, M: np.ndarray) -> np.ndarray:
            X, y, w = M[:, :-2], M[:, -2].astype(int), M[:, -1]
            edges = np.concatenate(([-np.inf], thresholds(theta), [np.inf]))
            z = X @ theta[:p]
            hi, lo = _logistic(edges[y + 1] - z), _logistic(edges[y] - z)
            prob = np.maximum(hi - lo, 1e-15)
            dhi, dlo = hi * (1 - hi), lo * (1 - lo)
            by_z = w * (dhi - dlo) / prob
            by_edge = np.zeros(K + 1)
            np.add.at(by_edge, y + 1, -w * dhi / prob)
            np.add.at(by_edge, y, w * dlo / prob)
            tail = np.cumsum(by_edge[1:K][::-1])[::-1]
            return np.concatenate(([-w @ np.log(prob)], X.T @ by_z, tail[:1], tail[1:] * np.exp(theta[p + 1 :])))

        t = _lbfgs_fit(self, data, context, start, block, np.array([self.lam] * p + [0.0] * (K - 1)), class_index(data.targets[0], classes))
        return OrdinalFit(self, data.features, _report(data, n, context, t, class_order=classes), tuple(classes), t.parameters[:p], thresholds(t.parameters))


# --- sampled and sequential linear models -------------------------------------------------------------------------------


@dataclass(frozen=True)
class TheilSenRegression(Spec):
    """Spatial median of the least-squares fits to random subsets of p + 1 rows; intercept: median residual.

    The subsets are drawn from a hash pool of at most max_subpopulations * (p + 1) rows.
    """

    max_subpopulations: int = 10_000
    max_iterations: int = 300
    tolerance: float = 1e-6
    fit_intercept: bool = True
    task = "regression"

    def _fit(self, data: Dataset, context: Context) -> Fitted:
        n = guard(data.df, [*data.features, *data.targets], "TheilSenRegression")
        p = len(data.features)
        k = p + self.fit_intercept
        rng = context.rng("theil-sen")
        rows = _sampled_rows(data, n, min(n, self.max_subpopulations * k), rng)
        X, y = rows[:, :-1], rows[:, -1]
        if len(y) < k:
            raise UnsupportedDataError(f"TheilSenRegression needs at least {k} rows")
        from math import comb

        if comb(len(y), k) <= self.max_subpopulations:
            from itertools import combinations

            picks = np.array(list(combinations(range(len(y)), k)))
        else:
            picks = np.array([rng.choice(len(y), k, replace=False) for _ in range(self.max_subpopulations)])
        D = np.column_stack((X, np.ones(len(X)))) if self.fit_intercept else X
        betas = np.array([np.linalg.lstsq(D[i], y[i], rcond=None)[0] for i in picks])[:, :p]
        b, steps, converged = _spatial_median(betas, self.max_iterations, self.tolerance)
        intercept = 0.0
        if self.fit_intercept:
            intercept = quantiles(data.df, number(data.targets[0]) - dot(data.features, b), [0.5])[0]
        return LinearFit(self, data.features, _report(data, n, context, solvers.Trace(b, [], steps, converged), subpopulations=len(picks)), b, float(intercept))


def _sampled_rows(data: Dataset, n: int, size: int, rng: np.random.Generator) -> np.ndarray:
    """About ``size`` rows (features, target): a seeded hash pool in which repeated rows keep their share; all if there are no more."""
    columns = [number(c).alias(f"x{i}") for i, c in enumerate([*data.features, data.targets[0]])]
    rows = data.df.select(*columns)
    if n > size:
        rows = pool(rows, size, int(rng.integers(1 << 31)))
    M = np.column_stack([np.asarray(c.to_numpy(zero_copy_only=False), dtype=float) for c in rows.toArrow().itercolumns()])
    return M[np.lexsort(M.T[::-1])]


def _spatial_median(points: np.ndarray, max_iterations: int, tolerance: float) -> tuple[np.ndarray, int, bool]:
    if points.shape[1] == 1:
        return np.median(points, axis=0), 0, True
    x = points.mean(axis=0)
    for k in range(1, max_iterations + 1):
        d = np.linalg.norm(points - x, axis=1)
        at = d < 1e-12
        w = 1 / np.where(at, np.inf, d)
        if not w.any():
            return x, k, True
        new = (points * w[:, None]).sum(axis=0) / w.sum()
        if at.any():  # a step from a data point is damped by how many points lie there
            r = np.linalg.norm(((points - x) * w[:, None]).sum(axis=0))
            new = x if r == 0 else max(0.0, 1 - at.sum() / r) * new + min(1.0, at.sum() / r) * x
        moved = np.abs(new - x).max()
        x = new
        if moved <= tolerance:
            return x, k, True
    return x, max_iterations, False


@dataclass(frozen=True)
class RANSACRegression(Spec):
    """Fits the base model to random minimal samples, keeps the one with most rows within the threshold, and refits on those.

    Trials are drawn from a hash pool of at most max(5000, 50 * size of a sample) rows and scored on all rows, in groups: one
    aggregate counts the inliers of all trials of a group.
    """

    base_estimator: Spec = field(default_factory=LinearRegression)
    min_samples: int | None = None
    residual_threshold: float | None = None
    max_trials: int = 100
    stop_probability: float = 0.99
    loss: str = "absolute_error"
    task = "regression"

    def __post_init__(self) -> None:
        check(self.loss in ("absolute_error", "squared_error"), "loss must be absolute_error or squared_error")

    def _fit(self, data: Dataset, context: Context) -> Fitted:
        n = guard(data.df, [*data.features, *data.targets], "RANSACRegression")
        p, y = len(data.features), number(data.targets[0])
        size = self.min_samples or p + 1
        if n < size:
            raise UnsupportedDataError(f"RANSACRegression needs at least {size} rows")
        threshold = self.residual_threshold
        if threshold is None:
            middle = quantiles(data.df, y, [0.5])[0]
            threshold = quantiles(data.df, F.abs(y - middle), [0.5])[0]
        rng = context.rng("ransac")
        drawn = _sampled_rows(data, n, min(n, max(5000, 50 * size)), rng)
        loss = lambda b, a: F.abs(y - dot(data.features, b, a)) if self.loss == "absolute_error" else (y - dot(data.features, b, a)) ** 2
        best, trials, needed, D = (-1, np.inf, None), 0, self.max_trials, np.column_stack((drawn[:, :-1], np.ones(len(drawn))))
        while trials < min(self.max_trials, needed):
            group = []
            for _ in range(min(20, self.max_trials - trials)):
                pick = rng.choice(len(drawn), size, replace=False)
                b = np.linalg.lstsq(D[pick], drawn[pick, -1], rcond=None)[0]
                group.append((b[:-1], b[-1]))
            sums = []
            for i, (b, a) in enumerate(group):
                inside = loss(b, a) <= threshold
                sums += [F.sum(inside.cast("long")).alias(f"n{i}"), F.sum(F.when(inside, loss(b, a))).alias(f"l{i}")]
            row = data.df.agg(*sums).first()
            for i, (b, a) in enumerate(group):
                if (row[f"n{i}"], -(row[f"l{i}"] or 0.0)) > (best[0], -best[1]):
                    best = (row[f"n{i}"], row[f"l{i}"] or 0.0, (b, a))
            trials += len(group)
            ratio = (best[0] / n) ** size
            needed = 0 if ratio >= 1 else np.inf if ratio <= 0 else np.log(1 - self.stop_probability) / np.log(1 - ratio)
        if best[2] is None or best[0] < size:
            raise UnsupportedDataError("no trial found enough inliers")
        inliers = data.df.where(loss(*best[2]) <= threshold)
        final = self.base_estimator.fit(data.with_df(inliers), context=context.derive("final"))
        return RansacFit(self, data.features, _report(data, n, context, inliers=best[0], trials=trials, threshold=threshold), final)


@dataclass(frozen=True)
class RansacFit(Fitted):
    model: Fitted

    def predict(self, df: DataFrame) -> DataFrame:
        return self.model.predict(df)


@dataclass(frozen=True)
class SGDFit(Fitted):
    classes: tuple | None
    coefficients: np.ndarray  # (outputs, features)
    intercepts: np.ndarray
    steps: int = 0
    epochs: int = 0

    def probabilities(self) -> list[Column]:
        z = [dot(self.features, b, a) for b, a in zip(self.coefficients, self.intercepts, strict=True)]
        top = F.greatest(*z)
        e = [F.exp(v - top) for v in z]
        total = sum(e[1:], e[0])
        return [v / total for v in e]

    def predict_proba(self, df: DataFrame) -> DataFrame:
        if self.classes is None:
            return super().predict_proba(df)
        return df.withColumns(dict(zip(proba_names(self.classes), self.probabilities(), strict=True)))

    def predict(self, df: DataFrame) -> DataFrame:
        self._need(df)
        if self.classes is None:
            return df.withColumn("prediction", dot(self.features, self.coefficients[0], float(self.intercepts[0])))
        return df.withColumn("prediction", first_argmax(self.probabilities(), self.classes))


@dataclass(frozen=True)
class _SGD(Spec):
    learning_rate: float = 0.01
    l2: float = 1e-4
    epochs: int = 20
    batch_size: int = 32
    fit_intercept: bool = True
    partial = True
    weights = True

    def _classes(self, data: Dataset) -> list | None:
        return None

    def _start(self, data: Dataset, classes: list | None) -> SGDFit:
        k = len(classes) if classes else 1
        return SGDFit(self, data.features, FitReport(0, len(data.features)), tuple(classes) if classes else None, np.zeros((k, len(data.features))), np.zeros(k))

    def _run(self, fitted: SGDFit, data: Dataset, epochs: int, context: Context) -> SGDFit:
        local = collect_local(data, type(self).__name__)
        X, w = local.X, local.w
        if fitted.classes is None:
            Y = local.y[0].astype(float)[:, None]
        else:
            place = {c: i for i, c in enumerate(fitted.classes)}
            unknown = set(local.y[0].tolist()) - set(place)
            if unknown:
                raise UnsupportedDataError(f"labels that were not there at first: {sorted(unknown)}")
            Y = np.eye(len(place))[[place[c] for c in local.y[0].tolist()]]
        B, a, steps = fitted.coefficients.copy(), fitted.intercepts.copy(), fitted.steps
        for epoch in range(epochs):
            order = context.rng("sgd", fitted.epochs + epoch).permutation(len(X))
            for lo in range(0, len(X), self.batch_size):
                i = order[lo : lo + self.batch_size]
                z = X[i] @ B.T + a
                if fitted.classes is not None:
                    z = np.exp(z - z.max(axis=1, keepdims=True))
                    z /= z.sum(axis=1, keepdims=True)
                g = (z - Y[i]) * w[i][:, None] / w[i].sum()
                rate = self.learning_rate / np.sqrt(steps + 1)
                steps += 1
                B -= rate * (g.T @ X[i] + self.l2 * B)
                if self.fit_intercept:
                    a -= rate * g.sum(axis=0)
        report = _report(data, fitted.report.observations + len(X), context, steps=steps)
        return SGDFit(self, data.features, report, fitted.classes, B, a, steps, fitted.epochs + epochs)

    def _fit(self, data: Dataset, context: Context) -> Fitted:
        return self._run(self._start(data, self._classes(data)), data, self.epochs, context)

    def partial_fit(self, fitted, data: Dataset, context: Context | None = None, classes: Sequence | None = None) -> Fitted:
        start = fitted if fitted is not None else self._start(data, list(classes) if classes else self._classes(data))
        return self._run(start, data, 1, context or Context())


@dataclass(frozen=True)
class SGDRegressor(_SGD):
    """Mini-batch gradient steps on half the squared error + l2/2 |b|^2."""

    task = "regression"


@dataclass(frozen=True)
class SGDClassifier(_SGD):
    """Mini-batch gradient steps on softmax cross-entropy; the classes are those of the first batch."""

    task = "classification"
    probabilistic = True

    def _classes(self, data: Dataset) -> list:
        return classes_of(data)


# --- splines and latent factors ------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class MarsFit(Fitted):
    terms: tuple[tuple[tuple[int, float, int], ...], ...]  # factors: feature, knot, direction
    coefficients: np.ndarray

    def predict(self, df: DataFrame) -> DataFrame:
        self._need(df)
        total = F.lit(0.0)
        for term, b in zip(self.terms, self.coefficients, strict=True):
            e = F.lit(float(b))
            for j, knot, direction in term:
                e = e * F.greatest(F.lit(0.0), (number(self.features[j]) - knot) * float(direction))
            total = total + e
        return df.withColumn("prediction", total)


def _mars_columns(X: np.ndarray, terms: Sequence) -> np.ndarray:
    out = np.ones((len(X), len(terms)))
    for t, term in enumerate(terms):
        for j, knot, direction in term:
            out[:, t] *= np.maximum(0.0, (X[:, j] - knot) * direction)
    return out


@dataclass(frozen=True)
class MARSRegressor(Spec):
    """Adaptive hinge terms: pairs are added by the drop of squared error, then terms are dropped by generalised cross-validation.

    Every step is one pass: the products of all candidate pairs with the present terms, the target and each other; which pair is
    best, and all of the pruning, follows from these small matrices.
    """

    max_terms: int = 21
    max_degree: int = 1
    max_knots: int = 32
    pruning_penalty: float = 3.0
    tolerance: float = 1e-6
    task = "regression"

    def _fit(self, data: Dataset, context: Context) -> Fitted:
        n = guard(data.df, [*data.features, *data.targets], "MARSRegressor")
        knots = self._knots(data)
        terms: list[tuple] = [()]
        with held(data) as rows:
            G, c, yy = self._gram(rows, terms)
            rss = [self._rss(G, c, yy)[1]]
            while len(terms) + 2 <= self.max_terms:
                pairs = [(t, j, k) for t, term in enumerate(terms) if len(term) < self.max_degree for j in range(len(data.features)) if j not in {f[0] for f in term} for k in knots[j]]
                best = self._best_pair(rows, terms, pairs, G, c, yy)
                if best is None or not rss[-1] - best[0] > self.tolerance * max(rss[-1], 1.0):
                    break
                t, j, k = best[1]
                terms += [(*terms[t], (j, k, 1)), (*terms[t], (j, k, -1))]
                G, c, yy = self._gram(rows, terms)
                rss.append(self._rss(G, c, yy)[1])
        active = list(range(len(terms)))
        kept, gcv = list(active), self._gcv(rss[-1], n, len(active))
        while len(active) > 1:
            scored = []
            for t in active[1:]:
                rest = [x for x in active if x != t]
                scored.append((self._gcv(self._rss(G[np.ix_(rest, rest)], c[rest], yy)[1], n, len(rest)), t, rest))
            value, _, active = min(scored, key=lambda s: s[0])
            if value < gcv:
                gcv, kept = value, list(active)
        b, final = self._rss(G[np.ix_(kept, kept)], c[kept], yy)
        return MarsFit(self, data.features, _report(data, n, context, forward_rss=rss, gcv=gcv, residual_sum_squares=final), tuple(terms[t] for t in kept), b)

    def _knots(self, data: Dataset) -> list[list[float]]:
        out = []
        for c in data.features:
            values = data.df.select(number(c).alias("v")).distinct()
            count = values.count()
            if count > 10_000:  # evenly spread interior values
                q = data.df.agg(F.percentile_approx(number(c), F.array(*[F.lit(k / (self.max_knots + 1)) for k in range(1, self.max_knots + 1)]), F.lit(100_000))).first()[0]
                out.append(sorted(set(q)))
                continue
            inner = sorted(r["v"] for r in values.collect())[1:-1]
            if len(inner) > self.max_knots:
                inner = [inner[i] for i in sorted({round(x) for x in np.linspace(0, len(inner) - 1, self.max_knots)})]
            out.append(inner)
        return out

    def _gram(self, rows: DataFrame, terms: list) -> tuple[np.ndarray, np.ndarray, float]:
        k = len(terms) + 1

        def block(M: np.ndarray) -> np.ndarray:
            D = np.column_stack((_mars_columns(M[:, :-2], terms), M[:, -2]))
            return D.T @ D

        total = partial_sums(rows, k * k, block).reshape(k, k)
        return total[:-1, :-1], total[:-1, -1], float(total[-1, -1])

    @staticmethod
    def _rss(G: np.ndarray, c: np.ndarray, yy: float) -> tuple[np.ndarray, float]:
        b = solvers.solve_symmetric(G, c)
        return b, max(0.0, float(yy - c @ b))

    def _gcv(self, rss: float, n: int, terms: int) -> float:
        effective = terms + self.pruning_penalty * max(terms - 1, 0) / 2
        return rss / n / max(1 - effective / n, np.finfo(float).eps) ** 2

    def _best_pair(self, rows: DataFrame, terms: list, pairs: list, G: np.ndarray, c: np.ndarray, yy: float):
        if not pairs:
            return None
        m, K = len(terms), len(pairs)

        def block(M: np.ndarray) -> np.ndarray:
            X, y = M[:, :-2], M[:, -2]
            D = _mars_columns(X, terms)
            out = []
            for t, j, k in pairs:
                right, left = D[:, t] * np.maximum(0, X[:, j] - k), D[:, t] * np.maximum(0, k - X[:, j])
                out.append(np.concatenate((D.T @ right, D.T @ left, [right @ right, left @ left, right @ left, right @ y, left @ y, np.count_nonzero(right), np.count_nonzero(left)])))
            return np.array(out)

        total = partial_sums(rows, K * (2 * m + 7), block).reshape(K, 2 * m + 7)
        best = None
        for row, pair in zip(total, pairs, strict=True):
            r, left, (rr, ll, rl, ry, ly, nr, nl) = row[:m], row[m : 2 * m], row[2 * m :]
            if nr <= 1 or nl <= 1:
                continue
            big = np.block([[G, np.column_stack((r, left))], [np.vstack((r, left)), np.array([[rr, rl], [rl, ll]])]])
            _, rss = self._rss(big, np.concatenate((c, [ry, ly])), yy)
            if best is None or rss < best[0]:
                best = (rss, pair)
        return best


@dataclass(frozen=True)
class PLSFit(LinearFit):
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    rotations: np.ndarray | None = None
    loadings: np.ndarray | None = None

    def transform(self, df: DataFrame) -> DataFrame:
        self._need(df)
        R = self.rotations / self.scale[:, None]
        kept = [F.col(f"`{c}`") for c in df.columns if c not in self.features]
        return df.select(*kept, *[dot(self.features, R[:, k], -float(self.mean @ R[:, k])).alias(f"component{k + 1}") for k in range(R.shape[1])])

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        names = [f"component{k + 1}" for k in range(self.loadings.shape[1])]
        kept = [F.col(f"`{c}`") for c in df.columns if c not in names]
        return df.select(*kept, *[dot(names, self.loadings[i] * self.scale[i], self.mean[i]).alias(c) for i, c in enumerate(self.features)])


@dataclass(frozen=True)
class PartialLeastSquaresRegression(Spec):
    """PLS1 from the cross-products alone: one pass over the data."""

    n_components: int = 2
    scale: bool = True
    task = "regression"

    def __post_init__(self) -> None:
        check(self.n_components >= 1, "n_components must be positive")

    def output_names(self, features: Sequence[str]) -> list[str]:
        return ["prediction"]

    def _fit(self, data: Dataset, context: Context) -> Fitted:
        m = moments(data.df, [*data.features, data.targets[0]], None, "PartialLeastSquaresRegression")
        p = len(data.features)
        check(self.n_components <= p, "n_components must not exceed the number of features")
        s = np.sqrt(m.variance[:p]) if self.scale else np.ones(p)
        s[s == 0] = 1.0
        S, c = m.cross[:p, :p] / np.outer(s, s), m.cross[:p, p] / s
        W, P, q = [], [], []
        rest = c.copy()
        R: list[np.ndarray] = []
        for _ in range(self.n_components):
            norm = np.linalg.norm(rest)
            if norm < 1e-12:
                break
            w = rest / norm
            r = w.copy()
            for rj, pj in zip(R, P, strict=True):
                r -= (pj @ w) * rj
            tt = float(r @ S @ r)
            if tt <= 1e-12:
                break
            load = S @ r / tt
            qk = float(r @ c) / tt
            W.append(w)
            R.append(r)
            P.append(load)
            q.append(qk)
            rest = rest - tt * qk * load
        if not R:
            raise UnsupportedDataError("the target does not vary with the features")
        Rm, Pm = np.column_stack(R), np.column_stack(P)
        b = Rm @ np.array(q) / s
        return PLSFit(self, data.features, _report(data, m.n, context, components=len(R)), b, float(m.mean[p] - m.mean[:p] @ b), "identity", m.mean[:p], s, Rm, Pm)


