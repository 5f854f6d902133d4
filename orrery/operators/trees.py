"""Trees and forests. Exact trees are grown from sorted prefix sums, on the driver or, of many rows, in distributed passes; forests grow one tree per task; boosting bins features by
quantiles and finds every level's splits from one distributed histogram pass."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.core import Context, Dataset, Fitted, FitReport, Spec, add_numpy, check, proba_names
from orrery.plans.graphs import cut
from orrery.plans.ordering import quantiles, running_sums_within
from orrery.plans.passes import class_index, classes_of, collect_local, guard, held, number, partial_sums, pool


@dataclass(frozen=True)
class Tree:
    """Nodes in arrays: feature (-1 for a leaf), threshold (x <= threshold goes left), children, and a value row."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def leaves(self, X: np.ndarray) -> np.ndarray:
        at = np.zeros(len(X), dtype=np.int64)
        while True:
            f = self.feature[at]
            inner = np.flatnonzero(f >= 0)
            if not len(inner):
                return at
            go = X[inner, f[inner]] <= self.threshold[at[inner]]
            at[inner] = np.where(go, self.left[at[inner]], self.right[at[inner]])

    def predict(self, X: np.ndarray) -> np.ndarray:
        return self.value[self.leaves(X)]


def _impurity(stats: np.ndarray, total: np.ndarray, criterion: str) -> np.ndarray:
    """Impurity times weight for rows of class weights (or of w, wy, wyy)."""
    if criterion == "squared_error":
        return stats[..., 2] - stats[..., 1] ** 2 / np.maximum(stats[..., 0], 1e-300)
    p = stats / np.maximum(total, 1e-300)[..., None]
    if criterion == "gini":
        return total * (1 - (p * p).sum(axis=-1))
    return -total * np.where(p > 0, p * np.log2(np.maximum(p, 1e-300)), 0).sum(axis=-1)


def grow(X: np.ndarray, S: np.ndarray, w: np.ndarray, spec, rng: np.random.Generator, features: int | None = None) -> Tree:
    """S: per row class weights, or (w, wy, wyy). Ties go to the lowest feature and threshold."""
    rows: list[list] = []
    regression = spec.criterion == "squared_error"

    def total(s: np.ndarray) -> np.ndarray:
        return s[..., 0] if regression else s.sum(axis=-1)

    def build(i: np.ndarray, depth: int) -> int:
        s = S[i].sum(axis=0)
        node = len(rows)
        value = np.array([s[1] / s[0]]) if regression else s / s.sum()
        rows.append([-1, 0.0, -1, -1, value])
        here = float(_impurity(s, total(s), spec.criterion))
        if (spec.max_depth is not None and depth >= spec.max_depth) or len(i) < spec.min_samples_split or here <= 1e-12:
            return node
        best = (max(spec.min_impurity_decrease, 1e-12), None)
        order = range(X.shape[1]) if features is None or features >= X.shape[1] else sorted(rng.choice(X.shape[1], features, replace=False))
        for j in order:
            x = X[i, j]
            by = np.argsort(x, kind="stable")
            xs = x[by]
            if xs[0] == xs[-1]:
                continue
            if spec.splitter == "random":
                t = rng.uniform(xs[0], xs[-1])
                cuts = np.array([np.searchsorted(xs, t, side="right")])
                thresholds = np.array([t])
            else:
                cuts = np.flatnonzero(xs[1:] > xs[:-1]) + 1
                thresholds = (xs[cuts] + xs[cuts - 1]) / 2
                thresholds = np.where(thresholds >= xs[cuts], xs[cuts - 1], thresholds)
            ok = (cuts >= spec.min_samples_leaf) & (cuts <= len(i) - spec.min_samples_leaf)
            if not ok.any():
                continue
            left = np.cumsum(S[i][by], axis=0)[cuts - 1]
            right = s - left
            gain = (here - _impurity(left, total(left), spec.criterion) - _impurity(right, total(right), spec.criterion)) / w.sum()
            gain = np.where(ok, gain, -1)
            k = int(gain.argmax())
            if gain[k] > best[0] + 1e-15:
                best = (gain[k], (j, float(thresholds[k])))
        if best[1] is None:
            return node
        j, t = best[1]
        go = X[i, j] <= t
        rows[node][0], rows[node][1] = j, t
        rows[node][2] = build(i[go], depth + 1)
        rows[node][3] = build(i[~go], depth + 1)
        return node

    build(np.arange(len(X)), 0)
    return Tree(np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), np.array([r[3] for r in rows]), np.array([r[4] for r in rows]))


#: Rows of a tree that the driver grows, and of a node below which a tree's rest is grown within a task.
LOCAL_ROWS, TASK_ROWS = 200_000, 50_000


def _impurity_column(s: list[Column], criterion: str) -> Column:
    """``_impurity`` as an expression."""
    if criterion == "squared_error":
        return s[2] - s[1] * s[1] / F.greatest(s[0], F.lit(1e-300))
    total = sum(s, F.lit(0.0))
    shares = [v / F.greatest(total, F.lit(1e-300)) for v in s]
    if criterion == "gini":
        return total * (1 - sum((v * v for v in shares), F.lit(0.0)))
    return -total * sum((F.when(v > 0, v * F.log2(F.greatest(v, F.lit(1e-300)))).otherwise(0.0) for v in shares), F.lit(0.0))


def grow_large(data: Dataset, classes: list | None, spec, rng: np.random.Generator, features: int | None = None) -> Tree:
    """The tree of ``grow`` from any number of rows, level by level.

    Rows are summed by node, feature and value; running sums over ranges of these give each cut's gain, and the best of each node
    and feature comes to the driver. Nodes of at most TASK_ROWS rows are grown to their end within a task each.
    """
    p, spark = len(data.features), data.df.sparkSession
    w = number(data.weight) if data.weight else F.lit(1.0)
    if classes is None:
        y = number(data.targets[0])
        S = [w, w * y, w * y * y]
    else:
        y = class_index(data.targets[0], classes)
        S = [F.when(y == i, w).otherwise(0.0) for i in range(len(classes))]
    s, x = [f"s{i}" for i in range(len(S))], [f"x{i}" for i in range(p)]
    # 0.0 makes -0.0 and 0.0 one value
    rows = cut(data.df.select(F.lit(0).cast("long").alias("node"), *[(number(c) + F.lit(0.0)).alias(v) for c, v in zip(data.features, x, strict=True)], *[v.alias(c) for v, c in zip(S, s, strict=True)]))
    nodes: list[list] = [[-1, 0.0, -1, -1, None]]
    small: list[DataFrame] = []
    seeds: dict[int, tuple[int, int]] = {}
    weight, depth = None, 0
    while True:
        known = {r["node"]: (r["n"], np.array([r[c] for c in s])) for r in rows.groupBy("node").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in s]).collect()}
        total = (lambda v: v[0]) if classes is None else np.sum
        weight = float(total(known[0][1])) if weight is None else weight
        large, few = {}, []
        for v, (n, sums) in sorted(known.items()):
            nodes[v][4] = np.array([sums[1] / sums[0]]) if classes is None else sums / sums.sum()
            here = float(_impurity(sums, total(sums), spec.criterion))
            if (spec.max_depth is not None and depth >= spec.max_depth) or n < spec.min_samples_split or here <= 1e-12:
                continue
            if n <= TASK_ROWS:
                few.append(v)
                seeds[v] = (int(rng.integers(1 << 62)), depth)
            else:
                large[v] = (n, sums, here)
        if few:
            small.append(rows.where(F.col("node").isin(few)))
        if not large:
            break
        splits = _large_splits(rows, large, weight, spec, rng, features, p, s)
        if not splits:
            break
        moves = []
        for v, (j, t) in sorted(splits.items()):
            nodes[v][:4] = [j, t, len(nodes), len(nodes) + 1]
            moves.append((v, j, t, len(nodes), len(nodes) + 1))
            nodes += [[-1, 0.0, -1, -1, None], [-1, 0.0, -1, -1, None]]
        to = F.broadcast(spark.createDataFrame(moves, "node long, j int, t double, left long, right long"))
        goes = F.when(F.element_at(F.array(*x), F.col("j") + 1) <= F.col("t"), F.col("left")).otherwise(F.col("right"))
        rows = cut(rows.join(to, "node").select(goes.alias("node"), *x, *s))
        depth += 1
    rest: dict[int, Tree] = {}
    if small:

        def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
            import pickle

            node = key[0].as_py()
            seed, at = seeds[node]
            own = replace(spec, max_depth=None if spec.max_depth is None else spec.max_depth - at)
            X, S = (np.column_stack([group[c].to_numpy() for c in names]) for names in (x, s))
            t = grow(X, S, np.array([weight]), own, np.random.Generator(np.random.PCG64(seed)), features)
            return pa.table({"node": pa.array([node], pa.int64()), "tree": pa.array([pickle.dumps((t.feature, t.threshold, t.left, t.right, t.value))], pa.binary())})

        import pickle

        every = small[0]
        for other in small[1:]:
            every = every.union(other)
        rest = {r["node"]: Tree(*pickle.loads(r["tree"])) for r in every.groupBy("node").applyInArrow(run, "node long, tree binary").collect()}
    # in the order of ``grow``: a node, what is left of it, what is right of it
    out: list[list] = []

    def place(v: int) -> int:
        at = len(out)
        if v in rest:
            t = rest[v]
            out.extend([int(f), float(c), int(a) + at if a >= 0 else -1, int(b) + at if b >= 0 else -1, u] for f, c, a, b, u in zip(t.feature, t.threshold, t.left, t.right, t.value, strict=True))
            return at
        out.append(list(nodes[v]))
        if nodes[v][0] >= 0:
            out[at][2] = place(nodes[v][2])
            out[at][3] = place(nodes[v][3])
        return at

    place(0)
    return Tree(*[np.array([r[k] for r in out]) for k in range(5)])


def _large_splits(rows: DataFrame, large: dict, weight: float, spec, rng: np.random.Generator, features: int | None, p: int, s: list[str]) -> dict[int, tuple[int, float]]:
    """The best feature and threshold of each node that has one."""
    spark, sums = rows.sparkSession, ", ".join(f"t{i} double" for i in range(len(s)))
    totals = F.broadcast(spark.createDataFrame([(v, n, *map(float, t), here) for v, (n, t, here) in large.items()], f"node long, n long, {sums}, here double"))
    chosen = [(v, j) for v in large for j in (range(p) if features is None or features >= p else sorted(rng.choice(p, features, replace=False).tolist()))]
    long = rows.select("node", F.explode(F.array(*[F.struct(F.lit(j).alias("j"), F.col(f"x{j}").alias("v")) for j in range(p)])).alias("e"), *s).select("node", "e.j", "e.v", *s)
    long = long.join(F.broadcast(spark.createDataFrame(chosen, "node long, j int")), ["node", "j"])
    added = [F.count(F.lit(1)).cast("double").alias("c"), *[F.sum(c).alias(c) for c in s]]
    if spec.splitter == "random":
        ends = sorted(long.groupBy("node", "j").agg(F.min("v"), F.max("v")).collect())
        drawn = [(v, j, float(rng.uniform(a, b))) for v, j, a, b in ends if a < b]
        if not drawn:
            return {}
        cuts = F.broadcast(spark.createDataFrame(drawn, "node long, j int, t double"))
        left = long.join(cuts, ["node", "j"]).where("v <= t").groupBy("node", "j", F.col("t").alias("v")).agg(*added)
    else:
        left = running_sums_within(long.groupBy("node", "j", "v").agg(*added), ["node", "j"], "v", ["c", *s])
    one, two = [F.col(c) for c in s], [F.col(f"t{i}") - F.col(c) for i, c in enumerate(s)]
    gain = (F.col("here") - _impurity_column(one, spec.criterion) - _impurity_column(two, spec.criterion)) / F.lit(weight)
    least = max(spec.min_samples_leaf, 1)
    scored = left.join(totals, "node").where((F.col("c") >= least) & (F.col("n") - F.col("c") >= least)).select("node", "j", "v", gain.alias("gain"))
    best: dict[int, tuple[float, tuple[int, float]]] = {}
    for r in sorted(scored.groupBy("node", "j").agg(F.max(F.struct("gain", (-F.col("v")).alias("v"))).alias("best")).collect(), key=lambda r: (r["node"], r["j"])):
        if r["best"]["gain"] > best.get(r["node"], (max(spec.min_impurity_decrease, 1e-12), None))[0] + 1e-15:
            best[r["node"]] = (r["best"]["gain"], (r["j"], -r["best"]["v"]))
    found = {v: split for v, (_, split) in best.items()}
    if spec.splitter == "random" or not found:
        return found
    # thresholds lie halfway to the next value
    at = F.broadcast(spark.createDataFrame([(v, j, a) for v, (j, a) in found.items()], "node long, j int, a double"))
    own = F.element_at(F.array(*[f"x{j}" for j in range(p)]), F.col("j") + 1)
    above = {r["node"]: r["b"] for r in rows.join(at, "node").groupBy("node").agg(F.min(F.when(own > F.col("a"), own)).alias("b")).collect()}
    return {v: (j, a if (a + above[v]) / 2 >= above[v] else (a + above[v]) / 2) for v, (j, a) in found.items()}


@dataclass(frozen=True)
class TreesFit(Fitted):
    """The mean of several trees' values: probabilities, or a number."""

    trees: tuple[Tree, ...]
    classes: tuple | None

    def values(self, X: np.ndarray) -> np.ndarray:
        return sum(t.predict(X) for t in self.trees) / len(self.trees)

    def predict(self, df: DataFrame) -> DataFrame:
        self._need(df)
        if self.classes is None:
            return add_numpy(df, self.features, [("prediction", "double")], lambda X: [self.values(X)[:, 0]])
        out = add_numpy(df, self.features, [("_k", "long")], lambda X: [self.values(X).argmax(axis=1)])
        return out.withColumn("prediction", F.element_at(F.array(*[F.lit(c) for c in self.classes]), F.col("_k").cast("int") + 1)).drop("_k")

    def predict_proba(self, df: DataFrame) -> DataFrame:
        if self.classes is None:
            return super().predict_proba(df)
        return add_numpy(df, self.features, [(n, "double") for n in proba_names(self.classes)], lambda X: list(self.values(X).T))

    def nodes(self, spark) -> DataFrame:
        rows = [(k, i, int(t.feature[i]), float(t.threshold[i]), int(t.left[i]), int(t.right[i]), [float(v) for v in t.value[i]]) for k, t in enumerate(self.trees) for i in range(len(t.feature))]
        return spark.createDataFrame(rows, "tree int, node int, feature int, threshold double, left int, right int, value array<double>")


def _statistics(local, classes: list | None) -> np.ndarray:
    if classes is None:
        y = local.y[0].astype(float)
        return np.column_stack((local.w, local.w * y, local.w * y * y))
    place = {c: i for i, c in enumerate(classes)}
    return np.eye(len(classes))[[place[v] for v in local.y[0].tolist()]] * local.w[:, None]


@dataclass(frozen=True)
class DecisionTreeClassifier(Spec):
    """Greedy exact tree; criterion gini or entropy; splitter best or random. More than LOCAL_ROWS rows take distributed passes."""

    criterion: str = "gini"
    splitter: str = "best"
    max_depth: int | None = None
    min_samples_split: int = 2
    min_samples_leaf: int = 1
    max_features: object = None
    min_impurity_decrease: float = 0.0
    task = "classification"
    weights = True
    probabilistic = True

    def _n_features(self, p: int) -> int | None:
        m = self.max_features
        return None if m is None else max(1, math.isqrt(p)) if m == "sqrt" else max(1, int(math.log2(p))) if m == "log2" else max(1, round(m * p)) if isinstance(m, float) else int(m)

    def _fit(self, data: Dataset, context: Context) -> Fitted:
        classes = classes_of(data) if self.task == "classification" else None
        n = guard(data.df, data.features, type(self).__name__)
        if n > LOCAL_ROWS:
            guard(data.df, [*([data.targets[0]] if classes is None else []), *([data.weight] if data.weight else [])], type(self).__name__)
            tree = grow_large(data, classes, self, context.rng("tree"), self._n_features(len(data.features)))
            return TreesFit(self, data.features, FitReport(n, len(data.features), details={"nodes": len(tree.feature)}), (tree,), tuple(classes) if classes else None)
        local = collect_local(data, type(self).__name__, LOCAL_ROWS)
        tree = grow(local.X, _statistics(local, classes), local.w, self, context.rng("tree"), self._n_features(local.X.shape[1]))
        return TreesFit(self, data.features, FitReport(len(local.X), len(data.features), details={"nodes": len(tree.feature)}), (tree,), tuple(classes) if classes else None)


@dataclass(frozen=True)
class DecisionTreeRegressor(DecisionTreeClassifier):
    """Greedy exact tree by variance reduction."""

    criterion: str = "squared_error"
    task = "regression"
    probabilistic = False


@dataclass(frozen=True)
class RandomForestClassifier(DecisionTreeClassifier):
    """Trees on bootstrap rows with random features at each node; one task per tree, training rows are shipped once."""

    n_estimators: int = 100
    bootstrap: bool = True
    max_features: object = "sqrt"

    def _fit(self, data: Dataset, context: Context) -> Fitted:
        classes = classes_of(data) if self.task == "classification" else None
        local = collect_local(data, type(self).__name__, 100_000)
        S, spark = _statistics(local, classes), data.df.sparkSession
        shared = spark.sparkContext.broadcast((local.X, S, local.w))
        seeds = [(i, context.derive("tree", i).seed >> 1) for i in range(self.n_estimators)]
        spec, m = self, self._n_features(local.X.shape[1])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import pickle

            X, S, w = shared.value
            for batch in batches:
                out = []
                for seed in batch.column(1).to_pylist():
                    rng = np.random.Generator(np.random.PCG64(seed))
                    i = rng.integers(len(X), size=len(X)) if spec.bootstrap else np.arange(len(X))
                    t = grow(X[i], S[i], w[i], spec, rng, m)
                    out.append(pickle.dumps((t.feature, t.threshold, t.left, t.right, t.value)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["i", "tree"])

        import pickle

        parts = min(self.n_estimators, max(1, spark.sparkContext.defaultParallelism))
        grown = spark.createDataFrame(seeds, "i int, seed long").repartition(parts).mapInArrow(run, "i int, tree binary").collect()
        trees = tuple(Tree(*pickle.loads(r["tree"])) for r in sorted(grown, key=lambda r: r["i"]))
        return TreesFit(self, data.features, FitReport(len(local.X), len(data.features), details={"trees": len(trees)}), trees, tuple(classes) if classes else None)


@dataclass(frozen=True)
class RandomForestRegressor(RandomForestClassifier):
    criterion: str = "squared_error"
    max_features: object = None
    task = "regression"
    probabilistic = False


@dataclass(frozen=True)
class ExtraTreesClassifier(RandomForestClassifier):
    """No bootstrap, random thresholds."""

    bootstrap: bool = False
    splitter: str = "random"


@dataclass(frozen=True)
class ExtraTreesRegressor(RandomForestRegressor):
    bootstrap: bool = False
    splitter: str = "random"


#: Trees whose scores a pass adds up itself before they are written to the rows.
SCORED_TREES = 8


def _uniform(i: np.ndarray, seed: np.uint64) -> np.ndarray:
    """Numbers in [0, 1) from row numbers and a seed (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = i.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + seed
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53)


@dataclass(frozen=True)
class BoostFit(Fitted):
    edges: tuple[np.ndarray, ...]
    base: np.ndarray
    sequences: tuple[tuple[Tree, ...], ...]  # one per class, or one
    classes: tuple | None

    def bins(self, X: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, X[:, j], side="right") for j, e in enumerate(self.edges)]).astype(float)

    def steps(self, B: np.ndarray, trees: tuple[Tree, ...]) -> np.ndarray:
        return self.spec.learning_rate * sum((t.predict(B)[:, 0] for t in trees), np.zeros(len(B)))

    def raw(self, X: np.ndarray) -> np.ndarray:
        B = self.bins(X)
        return np.column_stack([b + self.steps(B, seq) for b, seq in zip(self.base, self.sequences, strict=True)])

    def probabilities(self, X: np.ndarray) -> np.ndarray:
        s = 1 / (1 + np.exp(-self.raw(X)))
        return np.column_stack((1 - s[:, 0], s[:, 0])) if len(self.classes) == 2 else s / s.sum(axis=1, keepdims=True)

    def predict_proba(self, df: DataFrame) -> DataFrame:
        if self.classes is None:
            return super().predict_proba(df)
        return add_numpy(df, self.features, [(n, "double") for n in proba_names(self.classes)], lambda X: list(self.probabilities(X).T))

    def predict(self, df: DataFrame) -> DataFrame:
        self._need(df)
        if self.classes is None:
            return add_numpy(df, self.features, [("prediction", "double")], lambda X: [self.raw(X)[:, 0]])
        out = add_numpy(df, self.features, [("_k", "long")], lambda X: [self.probabilities(X).argmax(axis=1)])
        return out.withColumn("prediction", F.element_at(F.array(*[F.lit(c) for c in self.classes]), F.col("_k").cast("int") + 1)).drop("_k")


@dataclass(frozen=True)
class HistGradientBoostingRegressor(Spec):
    """Trees on quantile bins with Newton leaves; each level of each tree is one histogram pass. Values on an edge go up.

    row_subsample: each tree takes each row with this probability, by a hash of its number. feature_subsample: share of the features,
    rounded up, that each split chooses from. Rows carry the scores of earlier trees, renewed every few trees.
    """

    n_estimators: int = 100
    learning_rate: float = 0.1
    max_depth: int = 3
    max_bins: int = 255
    min_samples_leaf: int = 5
    l1: float = 0.0
    l2: float = 0.0
    tolerance: float = 1e-7
    row_subsample: float = 1.0
    feature_subsample: float = 1.0
    task = "regression"
    weights = True

    def __post_init__(self) -> None:
        check(2 <= self.max_bins <= 255, "max_bins must be 2 to 255")
        check(0 < self.row_subsample <= 1 and 0 < self.feature_subsample <= 1, "subsamples must be above 0 and at most 1")

    def _fit(self, data: Dataset, context: Context) -> Fitted:
        n, p = guard(data.df, data.features, type(self).__name__), len(data.features)
        classes = classes_of(data) if self.task == "classification" else None
        q = F.array(*[F.lit(k / self.max_bins) for k in range(1, self.max_bins)])
        row = data.df.agg(*[F.percentile_approx(number(c), q, F.lit(10_000)).alias(f"e{i}") for i, c in enumerate(data.features)]).first()
        edges = tuple(np.unique(row[f"e{i}"]) for i in range(p))
        width = max(len(e) for e in edges) + 1
        target = class_index(data.targets[0], classes) if classes else None
        models = [None] if classes is None else [1] if len(classes) == 2 else list(range(len(classes)))
        base, sequences, history = [], [], []
        with held(data, target) as rows:
            for k in models:
                label = (lambda y: y) if k is None else (lambda y, k=k: (y == k).astype(float))
                s = partial_sums(rows, 2, lambda M, label=label: np.array([M[:, -1] @ label(M[:, -2]), M[:, -1].sum()]))
                mean = s[0] / s[1]
                start = mean if k is None else float(np.log(mean / (1 - mean)))
                trees, last, scored = [], np.inf, 0
                state = rows.withColumns({"i": F.monotonically_increasing_id().cast("double"), "z": F.lit(start)})
                # numbers of rows must not change between passes that draw by them
                state = cut(state) if self.row_subsample < 1 else state.persist(StorageLevel.MEMORY_AND_DISK)
                fit = BoostFit(self, data.features, FitReport(n, p), edges, np.array([start]), (), None)
                for t in range(self.n_estimators):
                    rng = context.rng("boosting", (k or 0) * self.n_estimators + t)
                    tree, loss = self._tree(state, fit, tuple(trees[scored:]), label, k is not None, width, rng)
                    history.append(loss)
                    if abs(last - loss) <= self.tolerance:
                        break
                    last = loss
                    trees.append(tree)
                    if len(trees) - scored == SCORED_TREES:
                        recent, before = tuple(trees[scored:]), state
                        state = add_numpy(state, [*[f"x{j}" for j in range(p)], "z"], [("z", "double")], lambda M, recent=recent: [M[:, p] + fit.steps(fit.bins(M[:, :p]), recent)]).persist(StorageLevel.MEMORY_AND_DISK)
                        state.count()
                        before.unpersist()
                        scored = len(trees)
                state.unpersist()
                base.append(start)
                sequences.append(tuple(trees))
        return BoostFit(self, data.features, FitReport(n, p, details={"loss": history}), edges, np.array(base), tuple(sequences), tuple(classes) if classes else None)

    def _tree(self, rows: DataFrame, fit: BoostFit, recent: tuple[Tree, ...], label, logistic: bool, width: int, rng: np.random.Generator) -> tuple[Tree, float]:
        p = len(fit.features)
        nodes = [[-1, 0.0, -1, -1, 0.0]]
        frontier, loss = [0], 0.0
        seed, choices = rng.integers(1 << 62, dtype=np.uint64), math.ceil(self.feature_subsample * p)
        shrink = lambda g: np.sign(g) * max(abs(g) - self.l1, 0.0)
        for depth in range(self.max_depth + 1):
            tree = self._made(nodes)
            place = {v: i for i, v in enumerate(frontier)}
            size = len(frontier) * p * width * 3

            def block(M: np.ndarray, tree: Tree = tree, place: dict = place, size: int = size) -> np.ndarray:
                y, w, B = label(M[:, p]), M[:, p + 1], fit.bins(M[:, :p])
                z = M[:, p + 3] + fit.steps(B, recent)
                s = 1 / (1 + np.exp(-z)) if logistic else z
                g, h = w * (s - y), w * (s * (1 - s) if logistic else np.ones(len(y)))
                value = (w @ (np.maximum(z, 0) - z * y + np.log1p(np.exp(-np.abs(z))))) if logistic else 0.5 * (w @ (z - y) ** 2)
                at = np.array([place.get(v, -1) for v in range(len(tree.feature))])[tree.leaves(B)]
                out, keep = np.zeros(size), at >= 0
                if self.row_subsample < 1:
                    keep &= _uniform(M[:, p + 2], seed) < self.row_subsample
                for j in range(p):
                    base = ((at[keep] * p + j) * width + B[keep, j].astype(int)) * 3
                    for k, v in enumerate((g, h, np.ones(len(y)))):
                        np.add.at(out, base + k, v[keep])
                return np.concatenate((out, [value]))

            total = partial_sums(rows, size + 1, block)
            H = total[:-1].reshape(len(frontier), p, width, 3)
            loss = total[-1] if depth == 0 else loss
            following = []
            for v, hist in zip(frontier, H, strict=True):
                G, W, N = hist[0].sum(axis=0)
                nodes[v][4] = -shrink(G) / (W + self.l2 + 1e-12)
                if depth == self.max_depth or N < 2 * self.min_samples_leaf:
                    continue
                L = np.cumsum(hist, axis=1)[:, :-1]
                R = hist.sum(axis=1)[:, None] - L
                score = lambda A: np.maximum(np.abs(A[..., 0]) - self.l1, 0) ** 2 / (A[..., 1] + self.l2 + 1e-12)
                gain = score(L) + score(R) - shrink(G) ** 2 / (W + self.l2 + 1e-12)
                gain[(L[..., 2] < self.min_samples_leaf) | (R[..., 2] < self.min_samples_leaf)] = -1
                if choices < p:
                    gain[np.setdiff1d(np.arange(p), rng.choice(p, choices, replace=False))] = -1
                j, b = divmod(int(gain.argmax()), gain.shape[1])
                if gain[j, b] <= 1e-12:
                    continue
                nodes[v][:4] = [j, b + 0.5, len(nodes), len(nodes) + 1]
                following += [len(nodes), len(nodes) + 1]
                nodes += [[-1, 0.0, -1, -1, 0.0], [-1, 0.0, -1, -1, 0.0]]
            frontier = following
            if not frontier:
                break
        return self._made(nodes), float(loss)

    @staticmethod
    def _made(nodes: list) -> Tree:
        return Tree(np.array([r[0] for r in nodes]), np.array([r[1] for r in nodes]), np.array([r[2] for r in nodes]), np.array([r[3] for r in nodes]), np.array([[r[4]] for r in nodes]))


@dataclass(frozen=True)
class HistGradientBoostingClassifier(HistGradientBoostingRegressor):
    """Logistic loss; one sequence of trees per class (two classes: one), renormalised."""

    task = "classification"
    probabilistic = True


@dataclass(frozen=True)
class IsolationFit(Fitted):
    trees: tuple[Tree, ...]
    normal: float
    threshold: float

    def scores(self, X: np.ndarray) -> np.ndarray:
        return 2.0 ** (-np.mean([t.predict(X)[:, 0] for t in self.trees], axis=0) / self.normal)

    def anomaly_score(self, df: DataFrame) -> DataFrame:
        self._need(df)
        return add_numpy(df, self.features, [("score", "double")], lambda X: [self.scores(X)])

    def predict(self, df: DataFrame) -> DataFrame:
        """Adds ``anomaly``: -1 for anomalies, 1 otherwise."""
        self._need(df)
        return add_numpy(df, self.features, [("anomaly", "long")], lambda X: [np.where(self.scores(X) >= self.threshold, -1, 1)])


def anomaly_score(fitted: Fitted, df: DataFrame) -> DataFrame:
    return fitted.anomaly_score(df)


def _path(n: float) -> float:
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


@dataclass(frozen=True)
class IsolationForest(Spec):
    """Random splits of samples of at most max_samples rows; the score is 2^(-mean path / expected path).

    The samples are drawn from a hash pool of at most 40 * max_samples rows, in which repeated rows keep their share.
    """

    n_estimators: int = 100
    max_samples: object = "auto"
    contamination: float | None = None
    task = "anomaly"

    def _fit(self, data: Dataset, context: Context) -> Fitted:
        n = guard(data.df, data.features, "IsolationForest", 2)
        size = min(n, 256 if self.max_samples == "auto" else int(self.max_samples))
        rows = data.df.select(*[number(c).alias(f"x{i}") for i, c in enumerate(data.features)])
        limit = min(n, size * 40)
        if n > limit:
            rows = pool(rows, limit, context.derive("pool", 0).seed >> 2)
        X = np.array([tuple(r) for r in rows.collect()], dtype=float)
        X = X[np.lexsort(X.T[::-1])]
        trees = tuple(self._tree(X[(rng := context.rng("isolation", i)).choice(len(X), size, replace=False)], rng) for i in range(self.n_estimators))
        fit = IsolationFit(self, data.features, FitReport(n, len(data.features), details={"sample": size}), trees, max(_path(size), 1e-12), 0.5)
        if self.contamination is None:
            return fit
        threshold = quantiles(fit.anomaly_score(data.df), F.col("score"), [1 - self.contamination])[0]
        return IsolationFit(self, data.features, fit.report, trees, fit.normal, threshold)

    def _tree(self, X: np.ndarray, rng: np.random.Generator) -> Tree:
        rows, depth_limit = [], math.ceil(math.log2(max(len(X), 2)))

        def build(i: np.ndarray, depth: int) -> int:
            node = len(rows)
            rows.append([-1, 0.0, -1, -1, [depth + _path(len(i))]])
            spread = np.flatnonzero(X[i].max(axis=0) > X[i].min(axis=0)) if len(i) > 1 else []
            if depth >= depth_limit or not len(spread):
                return node
            j = int(rng.choice(spread))
            t = rng.uniform(X[i, j].min(), X[i, j].max())
            go = X[i, j] <= t
            rows[node][:2] = [j, t]
            rows[node][2] = build(i[go], depth + 1)
            rows[node][3] = build(i[~go], depth + 1)
            return node

        build(np.arange(len(X)), 0)
        return Tree(*[np.array([r[k] for r in rows]) for k in range(5)])


