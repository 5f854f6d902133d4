"""Solvers that run on the driver over small arrays; what they ask of the data comes from callables, usually distributed passes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

from orrery.errors import NumericalFailureError

Objective = Callable[[np.ndarray], tuple[float, np.ndarray]]


@dataclass
class Trace:
    """Parameters found, the objective's history, and whether the iteration converged."""

    parameters: np.ndarray
    history: list[float] = field(default_factory=list)
    iterations: int = 0
    converged: bool = False


def solve_symmetric(A: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Solution of least norm of A x = b for a symmetric A that may be singular."""
    try:
        return np.linalg.lstsq(A, b, rcond=1e-12)[0]
    except np.linalg.LinAlgError as e:
        raise NumericalFailureError(str(e)) from e


def least_squares(X: np.ndarray, y: np.ndarray, solver: str = "qr") -> np.ndarray:
    if solver == "lsqr":
        return lsqr(X, y).parameters
    if solver == "cholesky":
        return solve_symmetric(X.T @ X, X.T @ y)
    return np.linalg.lstsq(X, y, rcond=None)[0]


def ridge_least_squares(X: np.ndarray, y: np.ndarray, penalty: float) -> np.ndarray:
    return solve_symmetric(X.T @ X + penalty * np.eye(X.shape[1]), X.T @ y)


def elastic_net(G: np.ndarray, c: np.ndarray, l1: float, l2: float, max_iterations: int, tolerance: float) -> Trace:
    """Cyclic coordinate descent on 1/2 b'Gb - c'b + l1 |b| + l2/2 b'b; G and c are mean cross-products."""
    b = np.zeros(len(c))
    for k in range(1, max_iterations + 1):
        change = 0.0
        for j in range(len(c)):
            if G[j, j] + l2 == 0:
                continue
            rho = c[j] - G[j] @ b + G[j, j] * b[j]
            new = np.sign(rho) * max(abs(rho) - l1, 0.0) / (G[j, j] + l2)
            change = max(change, abs(new - b[j]))
            b[j] = new
        if change <= tolerance:
            return Trace(b, [], k, True)
    return Trace(b, [], max_iterations, False)


def newton(step: Callable[[np.ndarray], tuple[float, np.ndarray, np.ndarray]], start: np.ndarray, max_iterations: int, tolerance: float) -> Trace:
    """Damped Newton: ``step`` gives value, gradient and Hessian; steps are halved until the value falls enough."""
    x = start.copy()
    value, gradient, hessian = step(x)
    trace = Trace(x, [value])
    for k in range(1, max_iterations + 1):
        direction = -solve_symmetric(hessian, gradient)
        slope, size = float(gradient @ direction), 1.0
        if np.abs(direction).max(initial=0) <= tolerance:
            trace.converged = True
            break
        while True:
            candidate = x + size * direction
            new = step(candidate)
            if new[0] <= value + 1e-4 * size * slope or size < 1e-8:
                break
            size /= 2
        moved = np.abs(candidate - x).max(initial=0)
        x, (value, gradient, hessian) = candidate, new
        trace.history.append(value)
        trace.iterations = k
        if moved <= tolerance or np.abs(gradient).max(initial=0) <= tolerance:
            trace.converged = True
            break
    trace.parameters = x
    return trace


def lbfgs(objective: Objective, start: np.ndarray, memory: int = 10, tolerance: float = 1e-6, max_iterations: int = 500) -> Trace:
    """Limited-memory BFGS with backtracking; ends at a small gradient, or where the value no longer falls beyond its rounding."""
    x, stalled = start.copy(), 0
    value, gradient = objective(x)
    trace = Trace(x, [value])
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for k in range(1, max_iterations + 1):
        if np.abs(gradient).max(initial=0) <= tolerance:
            trace.converged = True
            break
        q, alphas = gradient.copy(), []
        for s, y in reversed(past):
            a = (s @ q) / (y @ s)
            alphas.append(a)
            q -= a * y
        if past:
            s, y = past[-1]
            q *= (s @ y) / (y @ y)
        for (s, y), a in zip(past, reversed(alphas), strict=True):
            q += s * (a - (y @ q) / (y @ s))
        direction = -q
        slope = float(gradient @ direction)
        if slope >= 0:
            past.clear()
            direction, slope = -gradient, -float(gradient @ gradient)
        size = 1.0 if past else min(1.0, 1.0 / max(np.abs(gradient).sum(), 1e-12))
        new_value, new_gradient = objective(x + size * direction)
        while not (np.isfinite(new_value) and new_value <= value + 1e-4 * size * slope) and size > 1e-14:
            size /= 2
            new_value, new_gradient = objective(x + size * direction)
        if size <= 1e-14:
            trace.converged = np.abs(gradient).max(initial=0) <= 1e3 * tolerance
            break
        s, y = size * direction, new_gradient - gradient
        gain, least = value - new_value, 4 * np.finfo(float).eps * max(1.0, abs(value))
        stalled = stalled + 1 if gain <= least else 0
        x, value, gradient = x + s, new_value, new_gradient
        if s @ y > 1e-14:
            past = [*past[-(memory - 1) :], (s, y)]
        trace.history.append(value)
        trace.iterations = k
        if stalled >= 2:  # the value no longer falls beyond its rounding
            trace.converged = True
            break
    trace.parameters = x
    return trace


def conjugate_gradient(apply: Callable[[np.ndarray], np.ndarray], b: np.ndarray, start: np.ndarray | None = None, tolerance: float = 1e-8, max_iterations: int | None = None) -> Trace:
    x = np.zeros_like(b) if start is None else start.copy()
    r = b - apply(x)
    p, rr = r.copy(), float(r @ r)
    trace = Trace(x, [rr**0.5])
    for k in range(1, (max_iterations or 10 * len(b)) + 1):
        if rr**0.5 <= tolerance * max(1.0, float(np.linalg.norm(b))):
            trace.converged = True
            break
        Ap = apply(p)
        a = rr / float(p @ Ap)
        x, r = x + a * p, r - a * Ap
        new = float(r @ r)
        p, rr = r + new / rr * p, new
        trace.history.append(rr**0.5)
        trace.iterations = k
    trace.parameters, trace.converged = x, trace.converged or rr**0.5 <= tolerance * max(1.0, float(np.linalg.norm(b)))
    return trace


def lsqr(A: np.ndarray, b: np.ndarray, tolerance: float = 1e-8, max_iterations: int | None = None) -> Trace:
    """Least squares by Golub-Kahan bidiagonalisation."""
    x = np.zeros(A.shape[1])
    beta = float(np.linalg.norm(b))
    if beta == 0:
        return Trace(x, [0.0], 0, True)
    u = b / beta
    v = A.T @ u
    alpha = float(np.linalg.norm(v))
    if alpha == 0:
        return Trace(x, [beta], 0, True)
    v /= alpha
    w, phi, rho = v.copy(), beta, alpha
    trace = Trace(x, [beta])
    for k in range(1, (max_iterations or 4 * A.shape[1] + 10) + 1):
        u = A @ v - alpha * u
        beta = float(np.linalg.norm(u))
        u = u / beta if beta else u
        v = A.T @ u - beta * v
        alpha = float(np.linalg.norm(v))
        v = v / alpha if alpha else v
        r = (rho * rho + beta * beta) ** 0.5
        c, s = rho / r, beta / r
        theta, rho, step = s * alpha, -c * alpha, c * phi
        phi = s * phi
        x = x + step / r * w
        w = v - theta / r * w
        trace.history.append(phi)
        trace.iterations = k
        if abs(phi * alpha * c) <= tolerance * max(1.0, trace.history[0]):
            trace.converged = True
            break
    trace.parameters = x
    return trace


def proximal_gradient(objective: Objective, prox: Callable[[np.ndarray, float], np.ndarray], start: np.ndarray, step: float, max_iterations: int = 1000, tolerance: float = 1e-6, accelerate: bool = False) -> Trace:
    """Gradient steps, each followed by ``prox``; accelerate: with momentum (FISTA)."""
    x, v, t = start.copy(), start.copy(), 1.0
    trace = Trace(x)
    for k in range(1, max_iterations + 1):
        value, gradient = objective(v)
        new = prox(v - step * gradient, step)
        change = np.abs(new - x).max(initial=0)
        if accelerate:
            t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
            v, t = new + (t - 1) / t_new * (new - x), t_new
        else:
            v = new
        x = new
        trace.history.append(value)
        trace.iterations = k
        if change <= tolerance:
            trace.converged = True
            break
    trace.parameters = x
    return trace


def fista(objective: Objective, prox: Callable[[np.ndarray, float], np.ndarray], start: np.ndarray, step: float, **options) -> Trace:
    return proximal_gradient(objective, prox, start, step, accelerate=True, **options)


def newton_cg(objective: Objective, hessian_vector: Callable[[np.ndarray, np.ndarray], np.ndarray], start: np.ndarray, max_iterations: int = 100, tolerance: float = 1e-6) -> Trace:
    """Newton's method whose systems are solved by conjugate gradients."""
    x = start.copy()
    trace = Trace(x)
    for k in range(1, max_iterations + 1):
        value, gradient = objective(x)
        trace.history.append(value)
        if np.abs(gradient).max(initial=0) <= tolerance:
            trace.converged = True
            break
        direction = conjugate_gradient(lambda p, x=x: hessian_vector(x, p), -gradient, tolerance=1e-6).parameters
        size = 1.0
        while objective(x + size * direction)[0] > value + 1e-4 * size * float(gradient @ direction) and size > 1e-10:
            size /= 2
        x = x + size * direction
        trace.iterations = k
    trace.parameters = x
    return trace


def stochastic_gradient(sample_gradient: Callable[[np.ndarray, int], np.ndarray], start: np.ndarray, n: int, learning_rate: float = 0.01, epochs: int = 10, rng: np.random.Generator | None = None) -> Trace:
    x, rng = start.copy(), rng or np.random.default_rng(0)
    for _ in range(epochs):
        for i in rng.permutation(n):
            x -= learning_rate * sample_gradient(x, int(i))
    return Trace(x, [], epochs, True)


def expectation_maximization(e_step: Callable, m_step: Callable, log_likelihood: Callable, start, max_iterations: int = 100, tolerance: float = 1e-3):
    """Alternates the steps until the log-likelihood gains less than tolerance, relatively. Returns (parameters, trace)."""
    parameters, trace = start, Trace(np.zeros(0))
    last = -np.inf
    for k in range(1, max_iterations + 1):
        parameters = m_step(e_step(parameters))
        value = log_likelihood(parameters)
        trace.history.append(value)
        trace.iterations = k
        if abs(value - last) <= tolerance * max(1.0, abs(last)):
            trace.converged = True
            break
        last = value
    return parameters, trace
