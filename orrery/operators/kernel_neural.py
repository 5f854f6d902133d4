"""Kernel machines (bounded rows, one n by n matrix on the driver) and networks (full-batch gradients are distributed sums)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.core import Context, Dataset, Fitted, FitReport, Spec, add_numpy, check, proba_names
from orrery.errors import UnsupportedDataError
from orrery.operators.neighbors import pairwise_distances
from orrery.plans.passes import class_index, classes_of, collect_local, dot, guard, held, partial_sums, sigmoid


def gram_matrix(A: np.ndarray, B: np.ndarray, kernel: str = "rbf", gamma: object = "scale", degree: int = 3, coef0: float = 1.0) -> np.ndarray:
    g = 1 / A.shape[1] if gamma == "scale" else float(gamma)
    if kernel == "linear":
        return A @ B.T
    return np.exp(-g * pairwise_distances(A, B, "squared_euclidean")) if kernel == "rbf" else (g * A @ B.T + coef0) ** degree


class _Kernel(Spec):
    weights = True

    def kernel_of(self, A: np.ndarray, B: np.ndarray) -> np.ndarray:
        return gram_matrix(A, B, self.kernel, self.gamma, self.degree, self.coef0)


@dataclass(frozen=True)
class KernelFit(Fitted):
    train: np.ndarray
    dual: np.ndarray  # (rows, outputs)
    intercepts: np.ndarray
    classes: tuple | None = None

    def scores(self, X: np.ndarray) -> np.ndarray:
        return self.spec.kernel_of(X, self.train) @ self.dual + self.intercepts

    def predict(self, df: DataFrame) -> DataFrame:
        self._need(df)
        if self.classes is None:
            return add_numpy(df, self.features, [("prediction", "double")], lambda X: [self.scores(X)[:, 0]])
        pick = lambda X: [(self.scores(X)[:, 0] >= 0).astype(np.int64) if len(self.classes) == 2 else self.scores(X).argmax(axis=1)]
        out = add_numpy(df, self.features, [("_k", "long")], pick)
        return out.withColumn("prediction", F.element_at(F.array(*[F.lit(c) for c in self.classes]), F.col("_k").cast("int") + 1)).drop("_k")


@dataclass(frozen=True)
class KernelRidgeRegression(_Kernel):
    """(K + lam I) a = y; no intercept."""

    lam: float = 1.0
    kernel: str = "rbf"
    gamma: object = "scale"
    degree: int = 3
    coef0: float = 1.0
    task = "regression"
    weights = False

    def _fit(self, data: Dataset, context: Context) -> Fitted:
        local = collect_local(data, "KernelRidgeRegression", 5000)
        a = np.linalg.solve(self.kernel_of(local.X, local.X) + self.lam * np.eye(len(local.X)), local.y[0].astype(float))
        return KernelFit(self, data.features, FitReport(len(local.X), len(data.features)), local.X, a[:, None], np.zeros(1))


def _descend(K: np.ndarray, w: np.ndarray, C: float, gradient, max_iterations: int, tolerance: float) -> tuple[np.ndarray, float, bool]:
    """Gradient steps in the function space of K with a step from its spectrum."""
    augmented = np.column_stack((K, np.ones(len(K))))
    step = 1 / max(np.linalg.norm(K, 2) + C / w.sum() * w.max() * np.linalg.norm(augmented, 2) ** 2, 1e-300)
    a, b = np.zeros(len(K)), 0.0
    for _ in range(max_iterations):
        Ka = K @ a
        d = gradient(Ka + b)
        new, nb = a - step * (Ka + K @ d), b - step * d.sum()
        change = max(np.abs(new - a).max(), abs(nb - b))
        a, b = new, nb
        if change <= tolerance:
            return a, b, True
    return a, b, False


@dataclass(frozen=True)
class SupportVectorClassifier(_Kernel):
    """Half the squared norm + C/(2W) sum w hinge^2; one function per class (two classes: one)."""

    C: float = 1.0
    kernel: str = "rbf"
    gamma: object = "scale"
    degree: int = 3
    coef0: float = 1.0
    max_iterations: int = 2000
    tolerance: float = 1e-5
    task = "classification"

    def _fit(self, data: Dataset, context: Context) -> Fitted:
        local, classes = collect_local(data, "SupportVectorClassifier", 3000), classes_of(data)
        K, w, y = self.kernel_of(local.X, local.X), local.w, np.array(local.y[0].tolist(), dtype=object)
        found = []
        for c in classes[-1:] if len(classes) == 2 else classes:
            t = np.where(y == c, 1.0, -1.0)
            found.append(_descend(K, w, self.C, lambda f, t=t: -self.C / w.sum() * w * t * np.maximum(1 - t * f, 0), context.iterations(self.max_iterations), context.tol(self.tolerance)))
        status = "success" if all(f[2] for f in found) else "max_iterations"
        return KernelFit(self, data.features, FitReport(len(w), len(data.features), status), local.X, np.column_stack([f[0] for f in found]), np.array([f[1] for f in found]), tuple(classes))


@dataclass(frozen=True)
class SupportVectorRegressor(_Kernel):
    """Half the squared norm + C/(2W) sum w max(|r| - epsilon, 0)^2."""

    C: float = 1.0
    epsilon: float = 0.1
    kernel: str = "rbf"
    gamma: object = "scale"
    degree: int = 3
    coef0: float = 1.0
    max_iterations: int = 2000
    tolerance: float = 1e-5
    task = "regression"

    def _fit(self, data: Dataset, context: Context) -> Fitted:
        local = collect_local(data, "SupportVectorRegressor", 3000)
        y, w = local.y[0].astype(float), local.w
        slope = lambda f: self.C / w.sum() * w * np.sign(f - y) * np.maximum(np.abs(f - y) - self.epsilon, 0)
        a, b, ok = _descend(self.kernel_of(local.X, local.X), w, self.C, slope, context.iterations(self.max_iterations), context.tol(self.tolerance))
        return KernelFit(self, data.features, FitReport(len(w), len(data.features), "success" if ok else "max_iterations"), local.X, a[:, None], np.array([b]))


@dataclass(frozen=True)
class MLPFit(Fitted):
    W1: np.ndarray
    b1: np.ndarray
    W2: np.ndarray
    b2: np.ndarray
    classes: tuple | None

    def forward(self, X: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        z = X @ self.W1 + self.b1
        h = np.maximum(z, 0) if self.spec.activation == "relu" else np.tanh(z)
        out = h @ self.W2 + self.b2
        if self.classes is not None:
            out = np.exp(out - out.max(axis=1, keepdims=True))
            out /= out.sum(axis=1, keepdims=True)
        return z, h, out

    def predict(self, df: DataFrame) -> DataFrame:
        self._need(df)
        if self.classes is None:
            return add_numpy(df, self.features, [("prediction", "double")], lambda X: [self.forward(X)[2][:, 0]])
        out = add_numpy(df, self.features, [("_k", "long")], lambda X: [self.forward(X)[2].argmax(axis=1)])
        return out.withColumn("prediction", F.element_at(F.array(*[F.lit(c) for c in self.classes]), F.col("_k").cast("int") + 1)).drop("_k")

    def predict_proba(self, df: DataFrame) -> DataFrame:
        if self.classes is None:
            return super().predict_proba(df)
        return add_numpy(df, self.features, [(n, "double") for n in proba_names(self.classes)], lambda X: list(self.forward(X)[2].T))


@dataclass(frozen=True)
class MLPClassifier(Spec):
    """One hidden layer, softmax; full-batch gradient descent, one pass per step."""

    hidden_units: int = 32
    activation: str = "relu"
    learning_rate: float = 0.01
    l2: float = 1e-4
    max_iterations: int = 200
    tolerance: float = 1e-6
    task = "classification"
    probabilistic = True

    def __post_init__(self) -> None:
        check(self.activation in ("relu", "tanh"), "activation must be relu or tanh")

    def _fit(self, data: Dataset, context: Context) -> Fitted:
        n, p, q = guard(data.df, data.features, type(self).__name__), len(data.features), self.hidden_units
        classes = classes_of(data) if self.task == "classification" else None
        K, rng = len(classes) if classes else 1, context.rng("mlp")
        W = [rng.standard_normal((p, q)) * np.sqrt(2 / (p + q)), np.zeros(q), rng.standard_normal((q, K)) * np.sqrt(2 / (q + K)), np.zeros(K)]
        sizes, history, converged = np.cumsum([p * q, q, q * K]), [], False
        with held(data, class_index(data.targets[0], classes) if classes else None) as rows:
            for _ in range(context.iterations(self.max_iterations)):
                fit = MLPFit(self, data.features, FitReport(n, p), *W, tuple(classes) if classes else None)

                def block(M: np.ndarray, fit: MLPFit = fit) -> np.ndarray:
                    X, y = M[:, :-2], M[:, -2]
                    z, h, out = fit.forward(X)
                    if classes:
                        Y = np.eye(K)[y.astype(int)]
                        loss = -np.log(np.maximum((out * Y).sum(axis=1), 1e-15)).sum()
                    else:
                        Y = y[:, None]
                        loss = 0.5 * ((out - Y) ** 2).sum()
                    g = out - Y
                    back = g @ fit.W2.T * ((z > 0) if self.activation == "relu" else 1 - h * h)
                    return np.concatenate(((X.T @ back).ravel(), back.sum(axis=0), (h.T @ g).ravel(), g.sum(axis=0), [loss]))

                total = partial_sums(rows, p * q + q + q * K + K + 1, block) / n
                parts = np.split(total[:-1], sizes)
                history.append(float(total[-1] + 0.5 * self.l2 * ((W[0] ** 2).sum() + (W[2] ** 2).sum())))
                if len(history) > 1 and abs(history[-2] - history[-1]) <= context.tol(self.tolerance):
                    converged = True
                    break
                for i, g in enumerate(parts):
                    W[i] = W[i] - self.learning_rate * (g.reshape(W[i].shape) + (self.l2 * W[i] if i in (0, 2) else 0))
        return MLPFit(self, data.features, FitReport(n, p, "success" if converged else "max_iterations", details={"objective_history": history}), *W, tuple(classes) if classes else None)


@dataclass(frozen=True)
class MLPRegressor(MLPClassifier):
    """One hidden layer, linear output, half the squared error."""

    task = "regression"
    probabilistic = False


@dataclass(frozen=True)
class RBMFit(Fitted):
    W: np.ndarray
    visible: np.ndarray
    hidden: np.ndarray

    def transform(self, df: DataFrame) -> DataFrame:
        self._need(df)
        kept = [F.col(f"`{c}`") for c in df.columns if c not in self.features]
        return df.select(*kept, *[sigmoid(dot(self.features, self.W[:, k], b)).alias(f"hidden{k + 1}") for k, b in enumerate(self.hidden)])

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        names = [f"hidden{k + 1}" for k in range(len(self.hidden))]
        kept = [F.col(f"`{c}`") for c in df.columns if c not in names]
        return df.select(*kept, *[sigmoid(dot(names, self.W[i], b)).alias(c) for i, (c, b) in enumerate(zip(self.features, self.visible, strict=True))])


@dataclass(frozen=True)
class BernoulliRBM(Spec):
    """Contrastive divergence with one step on mini-batches; inputs lie within 0 and 1."""

    n_components: int = 256
    learning_rate: float = 0.1
    batch_size: int = 10
    n_iterations: int = 10

    def output_names(self, features) -> list[str]:
        return [f"hidden{k + 1}" for k in range(self.n_components)]

    def _fit(self, data: Dataset, context: Context) -> Fitted:
        X = collect_local(data, "BernoulliRBM").X
        if X.min() < 0 or X.max() > 1:
            raise UnsupportedDataError("BernoulliRBM needs values within 0 and 1")
        rng, p, q = context.rng("rbm"), X.shape[1], self.n_components
        W, v, h = rng.standard_normal((p, q)) * 0.01, np.zeros(p), np.zeros(q)
        act = lambda z: 1 / (1 + np.exp(-z))
        for _ in range(self.n_iterations):
            order = rng.permutation(len(X))
            for lo in range(0, len(X), self.batch_size):
                x = X[order[lo : lo + self.batch_size]]
                up = act(x @ W + h)
                down = act((rng.random(up.shape) < up) @ W.T + v)
                again = act(down @ W + h)
                rate = self.learning_rate / len(x)
                W = W + rate * (x.T @ up - down.T @ again)
                v, h = v + rate * (x - down).sum(axis=0), h + rate * (up - again).sum(axis=0)
        return RBMFit(self, data.features, FitReport(len(X), p), W, v, h)
