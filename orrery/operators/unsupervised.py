"""Decompositions, clusterings and mixtures."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.core import Context, Dataset, Fitted, FitReport, Spec, add_numpy, check, proba_names
from orrery.errors import UnsupportedDataError
from orrery.plans.blocks import Side, make_blocks, pairs
from orrery.plans.graphs import components, cut
from orrery.plans.ordering import row_numbers
from orrery.plans.passes import collect_local, dot, guard, held, moments, number, partial_sums, pool


@dataclass(frozen=True)
class ProjectionFit(Fitted):
    """(x - mean) @ components, one column for each; the inverse goes back by ``back``."""

    mean: np.ndarray
    components: np.ndarray  # (features, outputs)
    back: np.ndarray | None
    prefix: str
    explained: np.ndarray | None = None
    ratio: np.ndarray | None = None

    @property
    def names(self) -> list[str]:
        return [f"{self.prefix}{k + 1}" for k in range(self.components.shape[1])]

    def transform(self, df: DataFrame) -> DataFrame:
        self._need(df)
        kept = [F.col(f"`{c}`") for c in df.columns if c not in self.features]
        C = self.components
        return df.select(*kept, *[dot(self.features, C[:, k], -float(self.mean @ C[:, k])).alias(n) for k, n in enumerate(self.names)])

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        if self.back is None:
            return super().inverse_transform(df)
        kept = [F.col(f"`{c}`") for c in df.columns if c not in self.names]
        return df.select(*kept, *[dot(self.names, self.back[:, i], self.mean[i]).alias(c) for i, c in enumerate(self.features)])


def _signed(V: np.ndarray) -> np.ndarray:
    """Columns with their entry of greatest magnitude positive."""
    at = np.abs(V).argmax(axis=0)
    return V * np.where(V[at, np.arange(V.shape[1])] < 0, -1.0, 1.0)


class _Components(Spec):
    def output_names(self, features: Sequence[str]) -> list[str]:
        return [f"component{k + 1}" for k in range(self.n_components or len(features))]


@dataclass(frozen=True)
class PCA(_Components):
    """Eigenvectors of the covariance, from one pass of cross-products."""

    n_components: int | None = None
    whiten: bool = False

    def _fit(self, data: Dataset, context: Context) -> Fitted:
        m = moments(data.df, data.features, None, "PCA")
        k = self.n_components or len(data.features)
        check(1 <= k <= len(data.features), "n_components must not exceed the number of features")
        value, V = np.linalg.eigh(m.cross / max(m.n - 1, 1))
        value, V = np.maximum(value[::-1], 0), _signed(V[:, ::-1])
        s = np.sqrt(np.where(value[:k] > 0, value[:k], 1)) if self.whiten else np.ones(k)
        total = value.sum() or 1.0
        return ProjectionFit(self, data.features, FitReport(m.n, len(data.features)), m.mean, V[:, :k] / s, (V[:, :k] * s).T, "component", value[:k], value[:k] / total)


@dataclass(frozen=True)
class TruncatedSVD(_Components):
    """Like PCA without centring."""

    n_components: int = 2

    def _fit(self, data: Dataset, context: Context) -> Fitted:
        m = moments(data.df, data.features, None, "TruncatedSVD")
        value, V = np.linalg.eigh(m.raw())
        value, V, k = np.maximum(value[::-1], 0), _signed(V[:, ::-1]), self.n_components
        check(1 <= k <= len(data.features), "n_components must not exceed the number of features")
        return ProjectionFit(self, data.features, FitReport(m.n, len(data.features)), np.zeros(len(data.features)), V[:, :k], V[:, :k].T, "component", np.sqrt(value[:k]), value[:k] / (value.sum() or 1.0))


@dataclass(frozen=True)
class RandomProjection(Spec):
    """Gaussian entries of variance 1/k, or sparse ones of +-1/sqrt(density k)."""

    n_components: int = 2
    distribution: str = "gaussian"
    density: float | None = None

    def output_names(self, features: Sequence[str]) -> list[str]:
        return [f"projection{k + 1}" for k in range(self.n_components)]

    def _fit(self, data: Dataset, context: Context) -> Fitted:
        check(self.distribution in ("gaussian", "sparse"), "unknown distribution")
        n, p, k, rng = guard(data.df, data.features, "RandomProjection"), len(data.features), self.n_components, context.rng("projection")
        if self.distribution == "gaussian":
            R = rng.standard_normal((p, k)) / np.sqrt(k)
        else:
            density = self.density or 1 / np.sqrt(p)
            R = np.where(rng.random((p, k)) < density, rng.choice([-1.0, 1.0], (p, k)), 0.0) / np.sqrt(density * k)
        return ProjectionFit(self, data.features, FitReport(n, p), np.zeros(p), R, None, "projection")


@dataclass(frozen=True)
class FastICA(Spec):
    """Whitening from the covariance, then symmetric fixed-point steps with tanh, one pass each."""

    n_components: int = 2
    max_iterations: int = 200
    tolerance: float = 1e-4

    def output_names(self, features: Sequence[str]) -> list[str]:
        return [f"independent_component{k + 1}" for k in range(self.n_components)]

    def _fit(self, data: Dataset, context: Context) -> Fitted:
        m, k = moments(data.df, data.features, None, "FastICA"), self.n_components
        value, V = np.linalg.eigh(m.cross / m.n)
        value, V = value[::-1][:k], V[:, ::-1][:, :k]
        check(k <= len(data.features) and value[-1] > 1e-12, "n_components exceeds the rank of the data")
        white = V / np.sqrt(value)

        def orthogonal(W: np.ndarray) -> np.ndarray:
            s, U = np.linalg.eigh(W @ W.T)
            return U / np.sqrt(s) @ U.T @ W

        W = orthogonal(context.rng("ica").standard_normal((k, k)))
        converged = False
        with held(data) as rows:
            for step in range(1, context.iterations(self.max_iterations) + 1):

                def block(M: np.ndarray, W: np.ndarray = W) -> np.ndarray:
                    Z = (M[:, :-2] - m.mean) @ white
                    g = np.tanh(Z @ W.T)
                    return np.concatenate(((g.T @ Z).ravel(), (1 - g * g).sum(axis=0)))

                total = partial_sums(rows, k * k + k, block) / m.n
                new = orthogonal(total[: k * k].reshape(k, k) - total[k * k :, None] * W)
                change = np.abs(np.abs((new * W).sum(axis=1)) - 1).max()
                W = new
                if change <= context.tol(self.tolerance):
                    converged = True
                    break
        unmix = _signed(white @ W.T)
        report = FitReport(m.n, len(data.features), "success" if converged else "max_iterations", details={"iterations": step})
        return ProjectionFit(self, data.features, report, m.mean, unmix, np.linalg.pinv(unmix), "independent_component")


@dataclass(frozen=True)
class NMFFit(Fitted):
    H: np.ndarray
    iterations: int

    def _embed(self, X: np.ndarray) -> np.ndarray:
        W = np.full((len(X), len(self.H)), max(X.mean(), 1e-9) if len(X) else 1.0)
        HH = self.H @ self.H.T
        for _ in range(self.iterations):
            W *= (X @ self.H.T) / np.maximum(W @ HH, 1e-12)
        return W

    def transform(self, df: DataFrame) -> DataFrame:
        self._need(df)
        names = [f"component{k + 1}" for k in range(len(self.H))]
        out = add_numpy(df, self.features, [(n, "double") for n in names], lambda X: list(self._embed(X).T))
        return out.drop(*self.features)

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        names = [f"component{k + 1}" for k in range(len(self.H))]
        kept = [F.col(f"`{c}`") for c in df.columns if c not in names]
        return df.select(*kept, *[dot(names, self.H[:, i]).alias(c) for i, c in enumerate(self.features)])


@dataclass(frozen=True)
class NMF(_Components):
    """Non-negative factors: the factor of the features is held by the driver, the rows' embeddings are found within the tasks."""

    n_components: int = 2
    max_iterations: int = 200
    tolerance: float = 1e-4

    def _fit(self, data: Dataset, context: Context) -> Fitted:
        n, p, k = guard(data.df, data.features, "NMF"), len(data.features), self.n_components
        row = data.df.agg(F.min(F.least(*[number(c) for c in data.features], F.lit(float("inf")))).alias("low"), F.avg(sum((number(c) for c in data.features), F.lit(0.0)) / p).alias("mean")).first()
        if row["low"] < 0:
            raise UnsupportedDataError("NMF needs non-negative features")
        H = context.rng("nmf").random((k, p)) * np.sqrt(max(row["mean"], 1e-9) / k) + 1e-3
        last, history, converged = np.inf, [], False
        with held(data) as rows:
            for _ in range(context.iterations(self.max_iterations)):
                fit = NMFFit(self, data.features, FitReport(n, p), H, 20)

                def block(M: np.ndarray, fit: NMFFit = fit) -> np.ndarray:
                    X = M[:, :-2]
                    W = fit._embed(X)
                    return np.concatenate(((W.T @ W).ravel(), (W.T @ X).ravel(), [((X - W @ fit.H) ** 2).sum()]))

                total = partial_sums(rows, k * k + k * p + 1, block)
                WW, WX, loss = total[: k * k].reshape(k, k), total[k * k : -1].reshape(k, p), total[-1]
                history.append(float(loss))
                if last - loss <= context.tol(self.tolerance) * max(last if np.isfinite(last) else loss, 1e-12) and np.isfinite(last):
                    converged = True
                    break
                last = loss
                for _ in range(10):
                    H = H * WX / np.maximum(WW @ H, 1e-12)
        return NMFFit(self, data.features, FitReport(n, p, "success" if converged else "max_iterations", details={"objective_history": history}), H, self.max_iterations)


# --- clusterings ---------------------------------------------------------------------------------------------------------


def _nearest(features: Sequence[str], centers: np.ndarray) -> tuple[list[Column], Column]:
    """Squared distances to the centers, and the number (from 1) of the nearest; of equals the first."""
    d = [sum(((number(c) - float(v)) * (number(c) - float(v)) for c, v in zip(features, m, strict=True)), F.lit(0.0)) for m in centers]
    best = F.least(*d) if len(d) > 1 else d[0]
    out = F.lit(len(d))
    for i in range(len(d) - 2, -1, -1):
        out = F.when(d[i] == best, i + 1).otherwise(out)
    return d, out


@dataclass(frozen=True)
class CentersFit(Fitted):
    centers: np.ndarray
    inertia: float = 0.0

    def predict(self, df: DataFrame) -> DataFrame:
        self._need(df)
        return df.withColumn("cluster", _nearest(self.features, self.centers)[1])

    def transform(self, df: DataFrame) -> DataFrame:
        self._need(df)
        d = _nearest(self.features, self.centers)[0]
        return df.select("*", *[F.sqrt(x).alias(f"distance{i + 1}") for i, x in enumerate(d)])


@dataclass(frozen=True)
class KMeans(Spec):
    """Lloyd's steps, one pass each; starts by k-means++ on a hash pool of at most max(2000, 20 k) rows; n_init starts, least inertia wins; empty clusters go to the farthest row."""

    n_clusters: int = 8
    init: object = "kmeans++"
    n_init: int = 10
    max_iterations: int = 300
    tolerance: float = 1e-4
    task = "clustering"
    weights = True

    def _fit(self, data: Dataset, context: Context) -> Fitted:
        n, k, p = guard(data.df, data.features, "KMeans"), self.n_clusters, len(data.features)
        check(1 <= k <= n, "n_clusters must not exceed the number of rows")
        given = None if isinstance(self.init, str) else np.asarray(self.init, dtype=float)
        best = None
        with held(data) as rows:
            sample = None if given is not None else _sample(rows, n, max(2000, 20 * k), p)
            for start in range(1 if given is not None else self.n_init):
                C = given.copy() if given is not None else _start(sample, k, context.rng("kmeans", start), self.init)
                for step in range(1, context.iterations(self.max_iterations) + 1):

                    def block(M: np.ndarray, C: np.ndarray = C) -> np.ndarray:
                        X, w = M[:, :-2], M[:, -1]
                        d = ((X[:, None, :] - C[None]) ** 2).sum(axis=2)
                        at = d.argmin(axis=1)
                        one = np.eye(len(C))[at] * w[:, None]
                        return np.concatenate(((one.T @ X).ravel(), one.sum(axis=0), [w @ d.min(axis=1)]))

                    total = partial_sums(rows, k * p + k + 1, block)
                    sums, counts, inertia = total[: k * p].reshape(k, p), total[k * p : -1], total[-1]
                    new = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1e-300)[:, None], C)
                    for rank, empty in enumerate(np.flatnonzero(counts == 0)):
                        far = rows.orderBy(F.desc(F.least(*_nearest([f"x{i}" for i in range(p)], C)[0], F.lit(float("inf"))))).limit(rank + 1).collect()[-1]
                        new[empty] = [far[f"x{i}"] for i in range(p)]
                    shift = ((new - C) ** 2).sum(axis=1).max()
                    C = new
                    if shift <= context.tol(self.tolerance) ** 2:
                        break
                inertia = partial_sums(rows, 1, lambda M, C=C: np.array([M[:, -1] @ ((M[:, None, :-2] - C[None]) ** 2).sum(axis=2).min(axis=1)]))[0]
                if best is None or inertia < best[1]:
                    best = (C, float(inertia), step)
        return CentersFit(self, data.features, FitReport(n, p, details={"iterations": best[2], "inertia": best[1]}), best[0], best[1])


def _sample(rows: DataFrame, n: int, size: int, p: int) -> np.ndarray:
    """At most ``size`` rows for starts, without their last columns; repeated rows keep their share."""
    picked = rows if n <= size else pool(rows, size)
    X = np.array([r[:p] for r in map(tuple, picked.collect())], dtype=float).reshape(-1, p)
    return X[np.lexsort(X.T[::-1])]


def _start(X: np.ndarray, k: int, rng: np.random.Generator, how: str) -> np.ndarray:
    if how == "random":
        return X[rng.choice(len(X), k, replace=False)].copy()
    C = [X[rng.integers(len(X))]]
    for _ in range(k - 1):
        d = np.min([((X - c) ** 2).sum(axis=1) for c in C], axis=0)
        C.append(X[rng.choice(len(X), p=d / d.sum()) if d.sum() > 0 else rng.integers(len(X))])
    return np.array(C)


#: Numbers of core points that a prediction ships to its tasks (32 MB); beyond, rows and core points meet by cells.
CORE_NUMBERS = 4_000_000


def _near(points: DataFrame, others: DataFrame, p: int, radius: float) -> DataFrame:
    """Points (x0, x1, ...) joined with the others (y0, y1, ...) within the radius, by the cells of their first two features."""
    axes = range(min(p, 2))
    left = points.withColumns({f"_g{i}": F.floor(F.col(f"x{i}") / radius) for i in axes})
    right = others
    for i in axes:
        right = right.withColumn(f"_g{i}", F.explode(F.array(*[F.floor(F.col(f"y{i}") / radius) + v for v in (-1, 0, 1)])))
    square = sum(((F.col(f"x{i}") - F.col(f"y{i}")) * (F.col(f"x{i}") - F.col(f"y{i}")) for i in range(p)), F.lit(0.0))
    cells = [f"_g{i}" for i in axes]
    return left.join(right, cells).withColumn("_square", square).where(F.col("_square") <= radius**2).drop(*cells)


def _counted(sides: list[tuple[Side, Side]], square: float) -> dict[str, np.ndarray]:
    """The weight of each point's neighbours besides itself, where there are any."""
    sums: dict[int, tuple[Side, np.ndarray]] = {}
    for one, two in sides:
        a, b = (sums.setdefault(s.place, (s, np.zeros(len(s.value))))[1] for s in (one, two))
        for i, j in pairs(one, two, square):
            a += np.bincount(i, two.value[j], len(a))
            if one is not two:
                b += np.bincount(j, one.value[i], len(b))
        if one is two:
            a -= one.value
    hit = [(s.numbers[v > 0], v[v > 0]) for s, v in sums.values()]
    return {"number": np.concatenate([h[0] for h in hit] or [np.zeros(0, dtype=np.int64)]), "others": np.concatenate([h[1] for h in hit] or [np.zeros(0)])}


def _union(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the sets of i and j; a set's root is its least place."""

    def root(k: np.ndarray) -> np.ndarray:
        r = parent[k]
        while (up := parent[r] != r).any():
            r[up] = parent[r[up]]
        parent[k] = r
        return r

    while len(i):
        i, j = root(i), root(j)
        i, j = i[i != j], j[i != j]
        parent[np.maximum(i, j)] = np.minimum(i, j)


def _linked(sides: list[tuple[Side, Side]], square: float) -> dict[str, np.ndarray]:
    """Edges that connect what is connected among a tile's core points, and all pairs of another point with a core point."""
    start, numbers = {}, []
    for s in (s for both in sides for s in both):
        if s.place not in start:
            start[s.place] = sum(map(len, numbers))
            numbers.append(s.numbers)
    number_of = np.concatenate(numbers or [np.zeros(0, dtype=np.int64)])
    parent, borders = np.arange(len(number_of)), []
    for one, two in sides:
        for i, j in pairs(one, two, square):
            ci, cj = one.value[i] == 2, two.value[j] == 2
            i, j = start[one.place] + i, start[two.place] + j
            _union(parent, i[ci & cj], j[ci & cj])
            borders.append((i[~ci & cj], j[~ci & cj]))
            if one is not two:
                borders.append((j[ci & ~cj], i[ci & ~cj]))
    ends = np.flatnonzero(parent != np.arange(len(parent)))
    a, b = (np.concatenate([v, *[x[k] for x in borders]]) for k, v in enumerate((ends, parent[ends])))
    return {"a": number_of[a], "b": number_of[b], "core": np.arange(len(a)) < len(ends)}


@dataclass(frozen=True)
class DBSCANFit(Fitted):
    labels: DataFrame  # id, cluster, core
    core: DataFrame  # y0, y1, ..., _core, _cluster: the distinct core points
    cores: int

    def predict(self, df: DataFrame) -> DataFrame:
        """The cluster of the nearest core point within the radius (of equally near ones the first), else 0."""
        self._need(df)
        p = len(self.features)
        if self.cores * p > CORE_NUMBERS:
            keyed = cut(df.withColumn("_key", F.monotonically_increasing_id()))
            near = _near(keyed.select("_key", *[number(c).alias(f"x{i}") for i, c in enumerate(self.features)]), self.core, p, self.spec.radius)
            best = near.groupBy("_key").agg(F.min_by("_cluster", F.struct("_square", "_core")).alias("cluster"))
            return keyed.join(best, "_key", "left").withColumn("cluster", F.coalesce(F.col("cluster").cast("long"), F.lit(0).cast("long"))).drop("_key")
        rows = sorted(self.core.collect(), key=lambda r: r["_core"])
        core, numbers = np.array([[r[f"y{i}"] for i in range(p)] for r in rows]).reshape(-1, p), np.array([r["_cluster"] for r in rows], dtype=np.int64)
        radius = self.spec.radius

        def step(X: np.ndarray) -> list[np.ndarray]:
            best, found = np.full(len(X), np.inf), np.zeros(len(X), dtype=np.int64)
            for j in range(0, len(core), 1024):
                for i in range(0, len(X), 256):
                    d = ((X[i : i + 256, None, :] - core[None, j : j + 1024]) ** 2).sum(axis=2)
                    at, low = d.argmin(axis=1), d.min(axis=1)
                    nearer = (low < best[i : i + 256]) & (low <= radius**2)
                    best[i : i + 256][nearer], found[i : i + 256][nearer] = low[nearer], numbers[j : j + 1024][at[nearer]]
            return [found]

        return add_numpy(df, self.features, [("cluster", "long")], step)


@dataclass(frozen=True)
class DBSCAN(Spec):
    """Density clusters: core rows have min_neighbors rows (themselves included) within the radius.

    Equal rows are one point with their number as its weight. Blocks of points meet in tiles that count neighbours, and then link
    core points by as few edges as connect a tile's; no list of all pairs is made. Clusters are components of core points, numbered
    by their first core row; a border row gets the least number among its core neighbours; noise is 0. The driver gets the
    blocks' boxes, a sample of 40 rows a block that only decides the splits, and counts. Where boxes don't tell blocks apart (many features) the cost is that of all pairs.
    """

    radius: float = 0.5
    min_neighbors: int = 5
    task = "clustering"

    def __post_init__(self) -> None:
        check(self.radius > 0 and self.min_neighbors >= 1, "radius and min_neighbors must be positive")

    def _fit(self, data: Dataset, context: Context) -> Fitted:
        if data.id is None:
            raise UnsupportedDataError("DBSCAN needs an id column")
        n, p = guard(data.df, data.features, "DBSCAN"), len(data.features)
        x, y = [f"x{i}" for i in range(p)], [f"y{i}" for i in range(p)]
        rows = data.df.select(F.col(f"`{data.id}`").alias("id"), *[number(c).alias(v) for c, v in zip(data.features, x, strict=True)])
        points = cut(rows.groupBy(*x).agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).withColumn("key", F.monotonically_increasing_id()))
        distinct = points.count()
        blocks = make_blocks(points, distinct, p, self.radius)
        others = blocks.meet(blocks.rows.select("block", F.col("n").cast("array<double>").alias("values")), _counted, "number long, others double").groupBy("number").agg(F.sum("others").alias("others"))
        core = F.col("n") + F.coalesce("others", F.lit(0)) >= self.min_neighbors
        known = cut(blocks.members.join(others, "number", "left").select("block", "number", "key", core.alias("core"), F.col("others").isNotNull().alias("linked")))
        # points without neighbours are left out; 1: border or noise, 2: core
        flag = F.when(~F.col("linked"), 0.0).when(F.col("core"), 2.0).otherwise(1.0)
        flags = known.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("number", flag.alias("flag")))).alias("all"), F.max("linked").alias("any"))
        links = cut(blocks.meet(flags.where("any").select("block", F.col("all.flag").alias("values")), _linked, "a long, b long, core boolean"))
        cores = known.where("core")
        found = components(links.where("core").select("a", "b").union(cores.select("number", "number")))
        firsts = found.join(cores, F.col("node") == F.col("number")).join(points, "key").groupBy("label").agg(F.min("first").alias("first"))
        numbers, clusters = row_numbers(firsts, F.asc("first"), F.asc("label"))
        own = cut(found.join(numbers, "label").select(F.col("node").alias("number"), (F.col("_r") + 1).cast("int").alias("own")))
        border = links.where("not core").join(own.withColumnRenamed("number", "b"), "b").groupBy(F.col("a").alias("number")).agg(F.min("own").alias("least"))
        placed = cut(known.join(own, "number", "left").join(border, "number", "left").select("key", F.coalesce("own", "least", F.lit(0)).alias("cluster"), F.col("own").isNotNull().alias("core")))
        of = points.select(F.col("first").alias("id"), "key") if distinct == n else rows.join(points.select(*x, "key"), x).select("id", "key")
        labels = cut(of.join(placed, "key").select("id", "cluster", "core"))
        centers = cut(points.join(placed.where("core"), "key").select(*[F.col(a).alias(b) for a, b in zip(x, y, strict=True)], F.col("first").alias("_core"), F.col("cluster").alias("_cluster")))
        return DBSCANFit(self, data.features, FitReport(n, p, details={"clusters": clusters}), labels, centers, centers.count())


def _merge_tree(D: np.ndarray, linkage: str, k: int) -> np.ndarray:
    """Cluster numbers (from 1, by smallest member) after merging the nearest pairs down to k clusters."""
    n = len(D)
    D = D.astype(float).copy()
    np.fill_diagonal(D, np.inf)
    size, alive, member = np.ones(n), np.ones(n, dtype=bool), [[i] for i in range(n)]
    for _ in range(n - k):
        i, j = divmod(int(np.argmin(D)), n)
        i, j = min(i, j), max(i, j)
        if linkage == "single":
            row = np.minimum(D[i], D[j])
        elif linkage == "complete":
            row = np.where(np.isinf(D[i]) | np.isinf(D[j]), np.inf, np.maximum(D[i], D[j]))
        else:
            row = (size[i] * D[i] + size[j] * D[j]) / (size[i] + size[j])
        row[~alive] = np.inf
        row[[i, j]] = np.inf
        D[i, :], D[:, i] = row, row
        D[j, :], D[:, j] = np.inf, np.inf
        alive[j] = False
        size[i] += size[j]
        member[i] += member[j]
    labels = np.zeros(n, dtype=int)
    for number_, i in enumerate(sorted(np.flatnonzero(alive), key=lambda i: min(member[i])), 1):
        labels[member[i]] = number_
    return labels


@dataclass(frozen=True)
class AgglomerativeFit(CentersFit):
    labels: np.ndarray | None = None


@dataclass(frozen=True)
class AgglomerativeClustering(Spec):
    """Bottom-up merging with single, complete or average linkage; quadratic, so rows are bounded. New rows go to the nearest centroid."""

    n_clusters: int = 2
    linkage: str = "average"
    task = "clustering"

    def __post_init__(self) -> None:
        check(self.linkage in ("single", "complete", "average"), "unknown linkage")

    def _fit(self, data: Dataset, context: Context) -> Fitted:
        from orrery.operators.neighbors import pairwise_distances

        local = collect_local(data, "AgglomerativeClustering", 3000)
        check(1 <= self.n_clusters <= len(local.X), "n_clusters must not exceed the number of rows")
        labels = _merge_tree(pairwise_distances(local.X, local.X), self.linkage, self.n_clusters)
        centers = np.array([local.X[labels == k].mean(axis=0) for k in range(1, self.n_clusters + 1)])
        return AgglomerativeFit(self, data.features, FitReport(len(local.X), len(data.features)), centers, 0.0, labels)


@dataclass(frozen=True)
class FeatureAgglomeration(Spec):
    """Groups of similar columns, each replaced by its mean; column distances come from the cross-products."""

    n_clusters: int = 2
    linkage: str = "average"

    def output_names(self, features: Sequence[str]) -> list[str]:
        return [f"feature_cluster{k + 1}" for k in range(self.n_clusters)]

    def _fit(self, data: Dataset, context: Context) -> Fitted:
        m, p = moments(data.df, data.features, None, "FeatureAgglomeration"), len(data.features)
        G = m.raw()
        D = np.sqrt(np.maximum(np.diag(G)[:, None] + np.diag(G)[None] - 2 * G, 0))
        labels = _merge_tree(D, self.linkage, self.n_clusters)
        member = np.array([[float(v == k) for k in range(1, self.n_clusters + 1)] for v in labels])
        return ProjectionFit(self, data.features, FitReport(m.n, p, details={"labels": labels.tolist()}), np.zeros(p), member / member.sum(axis=0), member.T, "feature_cluster")


@dataclass(frozen=True)
class MixtureFit(Fitted):
    weights_: np.ndarray
    means: np.ndarray
    covariances: np.ndarray
    bound: float

    def joint(self, X: np.ndarray) -> np.ndarray:
        out = []
        for w, m, S in zip(self.weights_, self.means, self.covariances, strict=True):
            L = np.linalg.cholesky(S)
            z = np.linalg.solve(L, (X - m).T)
            out.append(np.log(w) - 0.5 * (z * z).sum(axis=0) - np.log(np.diag(L)).sum() - 0.5 * len(m) * np.log(2 * np.pi))
        return np.array(out).T.reshape(len(X), -1)

    def responsibilities(self, X: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = self.joint(X)
        top = z.max(axis=1, keepdims=True)
        e = np.exp(z - top)
        total = e.sum(axis=1, keepdims=True)
        return e / total, (top + np.log(total))[:, 0]

    def predict(self, df: DataFrame) -> DataFrame:
        self._need(df)
        return add_numpy(df, self.features, [("cluster", "long")], lambda X: [self.joint(X).argmax(axis=1) + 1])

    def predict_proba(self, df: DataFrame) -> DataFrame:
        self._need(df)
        names = proba_names(range(1, len(self.weights_) + 1))
        return add_numpy(df, self.features, [(n, "double") for n in names], lambda X: list(self.responsibilities(X)[0].T))


@dataclass(frozen=True)
class GaussianMixture(Spec):
    """EM with full covariances + regularization * I; one pass per iteration; the best bound of n_init starts, from a hash pool of at most max(2000, 20 k) rows."""

    n_components: int = 1
    n_init: int = 1
    max_iterations: int = 100
    tolerance: float = 1e-3
    regularization: float = 1e-6
    task = "clustering"
    probabilistic = True

    def _fit(self, data: Dataset, context: Context) -> Fitted:
        m, K, p = moments(data.df, data.features, None, "GaussianMixture"), self.n_components, len(data.features)
        best = None
        with held(data) as rows:
            sample = _sample(rows, m.n, max(2000, 20 * K), p)
            for start in range(self.n_init):
                C = _start(sample, K, context.rng("mixture", start), "kmeans++")
                at = ((sample[:, None] - C[None]) ** 2).sum(axis=2).argmin(axis=1)
                S = np.array([(np.cov(sample[at == k].T, bias=True).reshape(p, p) if (at == k).sum() > 1 else np.diag(m.variance)) + self.regularization * np.eye(p) for k in range(K)])
                fit = MixtureFit(self, data.features, FitReport(m.n, p), np.maximum(np.bincount(at, minlength=K) / len(at), 1e-12), np.array([sample[at == k].mean(axis=0) if (at == k).any() else C[k] for k in range(K)]), S, -np.inf)
                for step in range(1, context.iterations(self.max_iterations) + 1):

                    def block(M: np.ndarray, fit: MixtureFit = fit) -> np.ndarray:
                        X = M[:, :-2]
                        R, ll = fit.responsibilities(X)
                        D = X - m.mean
                        return np.concatenate((R.sum(axis=0), (R.T @ D).ravel(), np.array([(D.T * R[:, k]) @ D for k in range(K)]).ravel(), [ll.sum()]))

                    t = partial_sums(rows, K + K * p + K * p * p + 1, block)
                    nk = np.maximum(t[:K], 1e-12)
                    d = t[K : K + K * p].reshape(K, p) / nk[:, None]
                    S = t[K + K * p : -1].reshape(K, p, p) / nk[:, None, None] - d[:, :, None] * d[:, None, :] + self.regularization * np.eye(p)
                    bound = t[-1] / m.n
                    done = abs(bound - fit.bound) <= context.tol(self.tolerance) * max(1.0, abs(fit.bound)) if np.isfinite(fit.bound) else False
                    fit = MixtureFit(self, data.features, FitReport(m.n, p, "success" if done else "max_iterations", details={"iterations": step, "bound": float(bound)}), nk / m.n, d + m.mean, S, float(bound))
                    if done:
                        break
                if best is None or fit.bound > best.bound:
                    best = fit
        return best
