"""The library: closed-form and golden values, invariants of fits, and parity with SQL."""

from __future__ import annotations

from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import orrery.operators  # noqa: F401
from orrery import queries as library
from orrery.core import REGISTRY, Context, Dataset, model_catalog
from orrery.errors import GraphValidationError, InvalidHyperparameterError, PersistenceVersionError, SchemaMismatchError, UnsupportedDataError
from orrery.operators.kernel_neural import KernelRidgeRegression, MLPClassifier
from orrery.operators.linear import GammaRegression, HuberRegression, LinearRegression, LogisticRegression, MARSRegressor, MeanRegressor, PoissonRegression, QuantileRegression, RANSACRegression, RidgeRegression, SGDRegressor, TweedieRegression
from orrery.operators.meta import CalibratedClassifier, OneVsRestClassifier, StackingRegressor, VotingClassifier
from orrery.operators.preprocess import Impute, OneHotEncode, PolynomialFeatures, Standardize
from orrery.operators.probabilistic import GaussianNaiveBayes, LinearDiscriminantAnalysis
from orrery.operators.trees import DecisionTreeClassifier, HistGradientBoostingRegressor, IsolationForest, RandomForestClassifier
from orrery.operators.unsupervised import DBSCAN, PCA, GaussianMixture, KMeans
from orrery.pipeline import Chain, Select
from orrery.plans import solvers
from orrery.selection import KFold, tune
from orrery.sources import load_model, save_model
from orrery.streaming import StreamingFit

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def small(spark):
    rows = [(i, float(a), float(b), float(y), float(w), "hot" if y > 2 else "cold") for i, (a, b, y, w) in enumerate([(1, 2, 2, 1), (2, 0, 1, 2), (3, 1, 3, 1), (4, 3, 7, 3)])]
    return spark.createDataFrame(rows, "id long, a double, b double, y double, w double, c string").cache()


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(5)
    X = np.concatenate([rng.normal(m, 0.3, (30, 2)) for m in ((0, 0), (4, 0), (0, 4))])
    rows = [(i, float(x), float(y), "abc"[i // 30]) for i, (x, y) in enumerate(X)]
    return spark.createDataFrame(rows, "id long, x double, y double, k string").cache()


@pytest.mark.parametrize(("spec", "weight", "want"), [
    (LinearRegression(), None, (1.2142857, 1.2142857, -1.6071429)),
    (LinearRegression(), "w", (1.2366412, 1.1984733, -1.5877863)),
    (RidgeRegression(2.0), None, (0.9444444, 0.9444444, -0.5277778)),
    (RidgeRegression(2.0), "w", (1.0666667, 1.1049645, -0.9418440)),
])
def test_least_squares_values(small, spec, weight, want):
    f = spec.fit(small, features=["a", "b"], target="y", weight=weight)
    assert np.allclose([*f.coefficients, f.intercept], want, atol=1e-6)


@pytest.mark.parametrize(("spec", "target", "want", "tolerance"), [
    (PoissonRegression(), "p", (1.2594105129, 2.6904570378, 4.4329581815), 1e-4),
    (GammaRegression(), "p", (1.1796072958, 2.6798520708, 4.5498203684), 1e-4),
    (TweedieRegression(power=1.5), "p", (1.2171590509, 2.6761132746, 4.4771030632), 1e-4),
    (QuantileRegression(), "r", (-1.9678082192, 1.6965753425, 4.4773972603), 0.1),
    (HuberRegression(), "r", (-2.0490907094, 1.6981834022, 4.5612283417), 0.1),
])
def test_generalised_and_robust_values(spark, spec, target, want, tolerance):
    X = [(-2.0, 0.5), (-1.5, 1.2), (-1.0, -0.4), (-0.5, 1.8), (0.0, 0.3), (0.5, -1.0), (1.0, 1.1), (1.5, -0.6), (2.0, 0.8), (2.5, -1.4), (3.0, 1.5), (3.5, -0.2)]
    y = {"p": (0.8, 1.4, 1.1, 2.2, 2.0, 1.7, 3.5, 2.8, 4.6, 3.7, 6.2, 5.4), "r": (-2.7, -1.8, -1.9, -0.2, 0.1, 0.0, 2.2, 2.1, 4.0, 4.1, 12.0, 5.8)}[target]
    f = spec.fit(spark.createDataFrame([(*x, v) for x, v in zip(X, y, strict=True)], "a double, b double, y double").coalesce(1), features=["a", "b"], target="y")
    got = f.predict(spark.createDataFrame([(-1.25, 0.2), (0.75, 0.7), (2.75, -0.3)], "a double, b double").coalesce(1)).collect()
    assert np.allclose([r["prediction"] for r in got], want, atol=tolerance, rtol=1e-4)


def test_weights_equal_repeated_rows(small):
    repeated = small.withColumn("n", F.explode(F.expr("sequence(1, cast(w as int))")))
    for spec, y in ((LogisticRegression(0.5), "c"), (RidgeRegression(1.0), "y")):
        a = spec.fit(small, features=["a", "b"], target=y, weight="w")
        b = spec.fit(repeated, features=["a", "b"], target=y)
        assert np.allclose(a.coefficients, b.coefficients, atol=1e-6)


def test_preprocessing(spark, small):
    out = PolynomialFeatures().fit(small, features=["a", "b"]).transform(small).where("id = 3").first()
    assert [out[c] for c in ("bias", "polynomial1", "polynomial2", "polynomial3", "polynomial4", "polynomial5")] == [1, 4, 3, 16, 12, 9]
    holes = spark.createDataFrame([(1, 30.0, "Paris"), (2, None, "Lyon"), (3, 40.0, None), (4, 40.0, "Paris")], "id long, age double, city string")
    filled = Impute().fit(holes, features=["age", "city"], id="id").transform(holes).orderBy("id").collect()
    assert filled[1]["age"] == pytest.approx(110 / 3) and filled[2]["city"] == "Paris"
    chain = Chain(Impute(), OneHotEncode()).fit(holes, features=["age", "city"], id="id")
    assert [c for c in chain.transform(holes).columns if c != "id"] == ["age", "city__Lyon", "city__Paris"]
    with pytest.raises(UnsupportedDataError):
        Standardize().fit(holes, features=["age"])


def test_standardize_merges_batches(small):
    whole = Standardize().fit(small, features=["a", "b"])
    part = Standardize().partial_fit(None, Dataset(small.where("id < 2"), ("a", "b")))
    part = Standardize().partial_fit(part, Dataset(small.where("id >= 2"), ("a", "b")))
    assert np.allclose(part.shift, whole.shift) and np.allclose(part.scale, whole.scale)


def test_composition_errors(small):
    with pytest.raises(GraphValidationError):
        Chain(RidgeRegression(), Standardize())
    with pytest.raises(SchemaMismatchError):
        Select("nothing").fit(small, features=["a"])
    with pytest.raises(InvalidHyperparameterError):
        RidgeRegression(-1.0)
    with pytest.raises(UnsupportedDataError):
        MARSRegressor().fit(small, features=["a"], target="y", weight="w")


@pytest.mark.parametrize("spec", [LogisticRegression(0.1), GaussianNaiveBayes(), LinearDiscriminantAnalysis(), DecisionTreeClassifier(), RandomForestClassifier(n_estimators=5), OneVsRestClassifier(LogisticRegression(0.1)), VotingClassifier((GaussianNaiveBayes(), LogisticRegression(0.1))), CalibratedClassifier(GaussianNaiveBayes(), KFold(3, True)), MLPClassifier(learning_rate=0.5, max_iterations=60)], ids=lambda s: type(s).__name__)
def test_classifiers(blobs, spec):
    f = spec.fit(blobs, features=["x", "y"], target="k", id="id", context=Context(3))
    out = f.predict_proba(f.predict(blobs)).toPandas()
    assert (out["prediction"] == out["k"]).mean() > 0.95
    assert np.allclose(out[["proba_a", "proba_b", "proba_c"]].sum(axis=1), 1)


def test_clusterings(blobs):
    for spec in (KMeans(3, n_init=3), GaussianMixture(3, n_init=2)):
        out = spec.fit(blobs, features=["x", "y"]).predict(blobs).groupBy("k").agg(F.countDistinct("cluster").alias("n")).collect()
        assert all(r["n"] == 1 for r in out)
    labels = {r["id"]: r["cluster"] for r in DBSCAN(1.0, 4).fit(blobs, features=["x", "y"], id="id").labels.collect()}
    assert [labels[i] for i in (0, 30, 60)] == [1, 2, 3]
    p = PCA().fit(blobs, features=["x", "y"])
    back = p.inverse_transform(p.transform(blobs)).orderBy("id").first()
    assert back["x"] == pytest.approx(blobs.orderBy("id").first()["x"])


def test_other_regressors(spark):
    rows = [(i, i / 10, abs(i / 10 - 3) + max(0, i / 10 - 7) * 2) for i in range(121)]
    df = spark.createDataFrame(rows, "id long, x double, y double").cache()
    rmse = lambda f: f.predict(df).agg(F.sqrt(F.avg((F.col("y") - F.col("prediction")) ** 2))).first()[0]
    assert rmse(MARSRegressor(max_terms=9).fit(df, features=["x"], target="y")) < 0.2
    assert rmse(KernelRidgeRegression(0.01, gamma=1.0).fit(df, features=["x"], target="y", id="id")) < 0.2
    assert rmse(HistGradientBoostingRegressor(n_estimators=15, learning_rate=0.4).fit(df, features=["x"], target="y")) < 0.5
    line = df.withColumn("y", F.when(F.col("id") % 10 == 0, 50.0).otherwise(2 * F.col("x") + 1))
    assert np.allclose(RANSACRegression(residual_threshold=0.5).fit(line, features=["x"], target="y").model.coefficients, [2.0], atol=1e-6)
    stack = StackingRegressor((LinearRegression(), RidgeRegression(0.5)), RidgeRegression(0.25), KFold(3))
    assert stack.fit(line.where("id % 10 != 0"), features=["x"], target="y", id="id").predict(line).where("id = 5").first()["prediction"] == pytest.approx(2.0, abs=0.1)


def test_isolation_forest(spark):
    ring = [(float(np.cos(t)), float(np.sin(t))) for t in np.linspace(0, 6.2, 80)] + [(6.0, 6.0), (-6.0, 6.0), (6.0, -6.0), (-6.0, -6.0)]
    df = spark.createDataFrame(ring, "x double, y double")
    out = IsolationForest(contamination=0.05).fit(df, features=["x", "y"]).predict(df).where("anomaly = -1").collect()
    assert sorted(abs(r["x"]) for r in out)[-4:] == [6.0] * 4


def test_solvers():
    A, b = np.array([[4.0, 1], [1, 3], [2, 0]]), np.array([1.0, 2, 3])
    x = np.linalg.lstsq(A, b, rcond=None)[0]
    assert np.allclose(solvers.lsqr(A, b).parameters, x) and np.allclose(solvers.conjugate_gradient(lambda v: A.T @ (A @ v), A.T @ b).parameters, x)
    f = lambda v: (0.5 * ((A @ v - b) ** 2).sum(), A.T @ (A @ v - b))
    assert np.allclose(solvers.lbfgs(f, np.zeros(2)).parameters, x, atol=1e-4)
    assert np.allclose(solvers.newton_cg(f, lambda v, p: A.T @ (A @ p), np.zeros(2)).parameters, x, atol=1e-4)


def test_tuning_and_artifacts(small, tmp_path):
    line = small.withColumn("y", 2 * F.col("a") + 1)
    best = tune(RidgeRegression(), Dataset(line, ("a",), "y", id="id"), {"lam": [10.0, 0.0, 0.1]}, KFold(2))
    assert best.best == {"lam": 0.0}
    save_model(best.model, str(tmp_path / "m"))
    again = load_model(str(tmp_path / "m"))
    assert np.array_equal(again.coefficients, best.model.coefficients)
    assert again.predict(line).first()["prediction"] == pytest.approx(best.model.predict(line).first()["prediction"])
    name = next((tmp_path / "m").glob("*.npy"))
    name.write_bytes(name.read_bytes()[:-1] + b"x")
    with pytest.raises(PersistenceVersionError):
        load_model(str(tmp_path / "m"))


def test_streaming_mean(spark, small, tmp_path):
    small.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(small.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    fitted = StreamingFit(MeanRegressor(), ["a"], "y", "w").run(stream, str(tmp_path / "checkpoint"))
    assert fitted.mean == pytest.approx(28 / 7)
    with pytest.raises(UnsupportedDataError):
        StreamingFit(LinearRegression(), ["a"], "y")


def test_registry():
    assert len(REGISTRY) >= 70 and {"Chain", "KMeans", "StackingClassifier"} <= set(REGISTRY)
    assert all(c.__doc__ for c in REGISTRY.values())
    assert {r["name"] for r in model_catalog(partial_fit=True)} == {"MeanRegressor", "Standardize", "SGDRegressor", "SGDClassifier"}
    assert SGDRegressor().capabilities().weights


@pytest.mark.parametrize("name", sorted(library.oracle_sql()))
def test_parity_with_sql(spark, name):
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    got, want = library.queries()[name](spark, SF).toPandas(), con.execute(library.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    a, b = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(a, b, check_dtype=False, atol=1e-9)


def test_whole_embeddings_by_force(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas().sort_values("vec_id")
    ids, y, X = df["vec_id"].to_numpy(), df["label"].to_numpy(), np.stack(df["embedding"]).astype(float)
    assert X.shape[1] == 64
    rows = lambda name: library.queries()[name](spark, SF).collect()
    D = np.sqrt(((X[:, None] - X[None]) ** 2).sum(axis=2))
    near = [np.lexsort((ids, d.round(9)))[:5] for d in D]
    got = {(r["query_id"], r["rank"]): (r["neighbor_id"], r["distance"]) for r in rows("k_neighbors")}
    want = {(ids[i], k + 1): (ids[near[i][k]], D[i, near[i][k]]) for i in range(len(ids)) for k in range(1, 5)}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1], abs=1e-4) for k in want)
    votes = {ids[i]: min(set(y[n]), key=lambda c, n=n: (-(y[n] == c).sum(), c)) for i, n in enumerate(near)}
    assert {r["vec_id"]: r["prediction"] for r in rows("knn_classifier")} == votes
    means = {r["vec_id"]: r["prediction"] for r in rows("knn_regressor")}
    assert all(means[ids[i]] == pytest.approx(y[n].mean(), abs=1e-4) for i, n in enumerate(near)) and len(means) == len(ids)
    cluster = np.array([np.argmin(d[:4]) for d in D])
    for r in rows("kmeans_step"):
        own = X[cluster == r["cluster"] - 1]
        assert r["n"] == len(own) and r["mean"] == pytest.approx(own[:, r["place"]].mean(), abs=1e-4)
    core = (D <= 0.6).sum(axis=1) >= 4
    found = {r["id"]: r for r in rows("dbscan")}
    assert all(found[i]["core"] == c and (found[i]["cluster"] == 0) == (not (core & (D[k] <= 0.6)).any()) for k, (i, c) in enumerate(zip(ids, core, strict=True)))


def test_pools_keep_the_share_of_repeated_rows(spark):
    from orrery.operators.linear import _sampled_rows
    from orrery.operators.unsupervised import _sample

    df = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 0.0).otherwise(F.col("id") + 1.0).alias("x0"), F.lit(1.0).alias("y"))
    for seed in range(2):
        drawn = _sampled_rows(Dataset(df, ("x0",), "y"), 30_000, 2000, np.random.default_rng(seed))
        assert len(drawn) == 2000 and abs((drawn[:, 0] == 0).mean() - 1 / 3) < 0.05
        others = drawn[drawn[:, 0] != 0, 0]
        assert len(set(others)) == len(others)
    assert abs((_sample(df, 30_000, 2000, 1) == 0).mean() - 1 / 3) < 0.05
    seen = []

    class Seen(IsolationForest):
        def _tree(self, X, rng):
            seen.append((X == 0).mean())
            return super(Seen, self)._tree(X, rng)

    Seen(n_estimators=20).fit(df, features=["x0"], context=Context(3))
    assert abs(np.mean(seen) - 1 / 3) < 0.05


def test_ordering(spark, monkeypatch):
    from orrery.plans import ordering
    from orrery.plans.ordering import quantiles, row_numbers, running_sums, with_previous

    df = spark.range(1000, numPartitions=7).select(((F.col("id") * 37) % 1000).alias("k"), F.lit(1.0).alias("v"))
    numbered, n = row_numbers(df, F.desc("k"))
    assert n == 1000 and numbered.where("_r <> 999 - k").count() == 0 and numbered.columns == ["k", "v", "_r"]
    sums, totals = running_sums(df, F.asc("k"), ["v"])
    assert totals == [1000.0] and sums.where("v <> k + 1").count() == 0
    assert [tuple(r) for r in with_previous(df, F.asc("k"), ["k"]).where("_previous.k is null or _previous.k <> k - 1").select("k").collect()] == [(0,)]
    empty = df.limit(0)
    assert row_numbers(empty, F.asc("k"))[1] == 0 and running_sums(empty, F.asc("k"), ["v"])[1] == [0.0] and quantiles(empty, F.col("k"), [0.5]) == [None]
    rng = np.random.default_rng(2)
    for x in (rng.normal(size=801), np.r_[np.zeros(500), rng.exponential(size=300)], np.r_[-1e300, 1e300, 3.0], np.array([2.0])):
        rows = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double").repartition(5)
        for few in (10_000, 0):
            monkeypatch.setattr(ordering, "FEW", few)
            assert np.allclose(quantiles(rows, F.col("x"), [0, 0.25, 0.5, 0.9, 1]), np.quantile(x, [0, 0.25, 0.5, 0.9, 1]), rtol=1e-12)


def test_functions_refuse_and_keep_digits(spark):
    from orrery import functions as K
    from orrery import metrics

    rows = spark.createDataFrame([(1e16,), (1.0,), (-1e16,), (None,), (2.0**-20,)], "x double").repartition(3)
    assert K.stable_sum(rows, "x").first()["sum"] == 1 + 2.0**-20
    assert K.stable_sum(rows.limit(0), "x").first()["sum"] == 0
    scored = spark.createDataFrame([(0, 0.7, 0.4), (1, 0.5, 0.5)], "y int, a double, b double")
    for df, classes in ((scored, [0, 1]), (scored.where("y = 1"), [0, 2])):
        with pytest.raises(Exception, match="probabilities|none of the classes"):
            metrics.log_loss(df, "y", ["a", "b"], classes).collect()
    curve = spark.createDataFrame([(3.0, 0.0, 1.0), (2.0, 1.0, 1.0), (1.0, 0.5, 1.0)], "threshold double, x double, y double")
    with pytest.raises(Exception, match="only grows"):
        metrics.area_under_curve(curve, "x", "y").collect()
    with pytest.raises(ValueError, match="fills"):
        K.center_sparse(spark.createDataFrame([(1, 1, 2.0)], "i int, j int, v double"), spark.createDataFrame([(1, 1.0)], "j int, m double"))


def test_learning_curve_scores_training_rows(spark):
    from orrery.operators.trees import DecisionTreeRegressor
    from orrery.plotdata import learning_curve

    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i, float(i), float(v)) for i, v in enumerate(rng.normal(size=60))], "id long, x double, y double")
    # a full tree knows its own rows by heart, and nothing of the others
    r = learning_curve(spark, DecisionTreeRegressor(max_depth=20, min_samples_leaf=1), Dataset(df, ("x",), "y", id="id"), shares=(1.0,)).first()
    assert r["train"] == pytest.approx(0, abs=1e-9) and r["validation"] > 0.5


def test_wide_bayes_equals_the_expressions(spark, monkeypatch):
    from orrery.operators import probabilistic as P

    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, "ab"[i % 2], *[float(abs(v)) for v in rng.normal(i % 2, 1, 4)]) for i in range(40)], "id long, k string, a double, b double, c double, d double")
    for spec in (P.GaussianNaiveBayes(), P.QuadraticDiscriminantAnalysis(), P.LinearDiscriminantAnalysis(), P.MultinomialNaiveBayes()):
        f = spec.fit(df, features=list("abcd"), target="k")
        narrow = f.predict(f.predict_proba(df)).orderBy("id").toPandas()
        with monkeypatch.context() as m:
            m.setattr(P, "SQL_COLUMNS", 2)
            pd.testing.assert_frame_equal(f.predict(f.predict_proba(df)).orderBy("id").toPandas(), narrow, atol=1e-9)


def test_dbscan_by_force(spark, monkeypatch):
    from orrery.operators import unsupervised as U

    rng = np.random.default_rng(4)
    X = np.r_[rng.normal(0, 0.5, (60, 3)), rng.normal(3, 0.5, (40, 3)), np.zeros((30, 3)), np.full((4, 3), 20.0), [[-0.0, 9, 9]]].round(3)
    df = spark.createDataFrame([(i * 3, *map(float, v)) for i, v in enumerate(X)], "id long, a double, b double, c double").repartition(4)
    f = DBSCAN(0.5, 4).fit(df, features=list("abc"), id="id")
    near = ((X[:, None] - X[None]) ** 2).sum(axis=2) <= 0.25
    core, cluster, number = near.sum(axis=1) >= 4, np.zeros(len(X), dtype=int), 0
    for i in np.flatnonzero(core):
        if not cluster[i]:
            number, todo = number + 1, [i]
            while todo:
                k = todo.pop()
                if not cluster[k]:
                    cluster[k] = number
                    todo += list(np.flatnonzero(near[k] & core))
    want = [c or min(cluster[near[i] & core], default=0) for i, c in enumerate(cluster)]
    got = f.labels.orderBy("id").toPandas()
    assert got["id"].tolist() == [i * 3 for i in range(len(X))] and got["cluster"].tolist() == want and got["core"].tolist() == core.tolist()
    by_blocks = f.predict(df).orderBy("id").toPandas()["cluster"].tolist()
    assert [by_blocks[i] for i in np.flatnonzero(core)] == [want[i] for i in np.flatnonzero(core)] and by_blocks[-1] == 0
    monkeypatch.setattr(U, "CORE_NUMBERS", 0)
    assert f.predict(df).orderBy("id").toPandas()["cluster"].tolist() == by_blocks


def test_dbscan_makes_no_list_of_pairs(spark, monkeypatch):
    from orrery.operators import unsupervised as U
    from orrery.plans import blocks as B

    # different points of one dense group, of a chain at exactly the radius, and far apart in many features
    rng = np.random.default_rng(8)
    chain = np.zeros((70, 12))
    chain[:, 0] = 50 + 0.5 * np.arange(70)
    X = np.r_[rng.normal(0, 0.01, (300, 12)), chain, rng.normal(0, 9, (200, 12)), np.full((1, 12), 1e9)]
    X = X[rng.permutation(len(X))]
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(X)], "id long, " + ", ".join(f"f{i} double" for i in range(12))).repartition(3)
    made = []
    meet = B.Blocks.meet

    def seen(*a):
        out = meet(*a).persist()
        made.append(out.count())
        return out

    monkeypatch.setattr(B.Blocks, "meet", seen)
    monkeypatch.setattr(B, "BLOCK", 128)
    monkeypatch.setattr(B, "PART", 16)
    f = U.DBSCAN(0.5, 3).fit(df, features=[f"f{i}" for i in range(12)], id="id")
    assert max(made) < 8 * len(X)  # the group alone has 90 000 pairs
    near = ((X[:, None] - X[None]) ** 2).sum(axis=2) <= 0.25
    core, reach = near.sum(axis=1) >= 3, np.eye(len(X), dtype=bool)
    for _ in range(8):
        reach = (reach.astype(int) @ (near & core & core[:, None] | reach).astype(int)) > 0
        reach = (reach.astype(int) @ reach.astype(int)) > 0
    first = np.array([np.flatnonzero(r & core).min() if c else -1 for r, c in zip(reach, core, strict=True)])
    number = {v: i + 1 for i, v in enumerate(sorted(set(first[core])))}
    own = np.array([number.get(v, 0) for v in first])
    want = [c or min(own[near[i] & core], default=0) for i, c in enumerate(own)]
    got = f.labels.orderBy("id").toPandas()
    assert got["cluster"].tolist() == want and got["core"].tolist() == core.tolist() and max(want) == 2


@pytest.mark.parametrize("scale", [1.0, 1e-9, 1e7, 1e-60, 1e150])
def test_close_pairs_are_those_of_the_plain_sum(scale):
    from orrery.plans.blocks import close

    X = np.stack(np.meshgrid(*[np.arange(5.0)] * 3), axis=-1).reshape(-1, 3) * 0.1 * scale + 1e3 * scale
    square = (0.1 * scale) ** 2
    with np.errstate(over="ignore"):
        gap = (X[:, None] - X[None]) ** 2
        want = gap[..., 0] + gap[..., 1] + gap[..., 2] <= square
    got = np.zeros_like(want)
    for i, j in close(X, X, square):
        got[i, j] = True
    assert (got == want).all()


@pytest.mark.parametrize("kind", ["gini", "entropy", "squared_error"])
def test_large_trees_are_those_of_the_driver(spark, monkeypatch, kind):
    from orrery.operators import trees as T

    rng = np.random.default_rng(9)
    X = np.c_[rng.integers(0, 4, 600), rng.normal(size=600), np.where(rng.random(600) < 0.3, -0.0, rng.integers(-3, 3, 600) / 4)]
    y = np.round(X[:, 0] * 2 + (X[:, 1] > 0.3) - X[:, 2] ** 2 + rng.normal(0, 0.3, 600), 3)
    rows = [(i, *map(float, v), float(t), "abc"[int(t > 1) + int(t > 4)], 1.0 + i % 3) for i, (v, t) in enumerate(zip(X, y, strict=True))]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, y double, k string, w double").repartition(3)
    monkeypatch.setattr(T, "TASK_ROWS", 120)
    for depth, leaf, weight in ((1, 1, None), (5, 4, "w")):
        spec = T.DecisionTreeRegressor(max_depth=depth, min_samples_leaf=leaf) if kind == "squared_error" else T.DecisionTreeClassifier(criterion=kind, max_depth=depth, min_samples_leaf=leaf)
        made = []
        for most in (200_000, 100):
            monkeypatch.setattr(T, "LOCAL_ROWS", most)
            made.append(spec.fit(df, features=list("abc"), target="y" if kind == "squared_error" else "k", id="id", weight=weight).trees[0])
        one, large = made
        assert len(one.feature) > depth and all(np.allclose(getattr(one, f), getattr(large, f)) for f in ("feature", "threshold", "left", "right", "value"))
    drawn = T.DecisionTreeRegressor(splitter="random", max_features=2, max_depth=9).fit(df, features=list("abc"), target="y")
    got = drawn.predict(df).toPandas()
    assert ((got["prediction"] - got["y"]) ** 2).mean() < got["y"].var() / 3


def test_tree_stump_of_more_rows_than_the_driver_takes(spark, tmp_path):
    part = spark.read.parquet(f"{SF}/part.parquet")
    copies = part.crossJoin(spark.range(-(-200_001 // part.count())).withColumnRenamed("id", "k"))
    copies.withColumn("p_partkey", F.col("p_partkey") + F.col("k") * 1_000_000).drop("k").write.parquet(f"{tmp_path}/part.parquet")
    whole, own = (library.queries()["tree_stump"](spark, d).collect() for d in (tmp_path, SF))
    assert whole == own


def test_boosting_carries_scores_and_draws(spark, monkeypatch):
    from orrery.operators import trees as T

    rng = np.random.default_rng(6)
    X = rng.normal(size=(400, 3))
    rows = [(i, *map(float, x), float(x[0] * 2 + (x[1] > 0)), "np"[int(x[0] + x[1] > 0)]) for i, x in enumerate(X)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, y double, k string").repartition(3).cache()
    fitted = {}
    for held_trees in (2, 100):
        monkeypatch.setattr(T, "SCORED_TREES", held_trees)
        f = T.HistGradientBoostingRegressor(n_estimators=7, learning_rate=0.5).fit(df, features=list("abc"), target="y")
        fitted[held_trees] = f.predict(df).orderBy("id").toPandas()["prediction"].to_numpy()
    assert np.allclose(fitted[2], fitted[100])
    monkeypatch.setattr(T, "SCORED_TREES", 4)
    drawn = T.HistGradientBoostingRegressor(n_estimators=7, learning_rate=0.5, row_subsample=0.5, feature_subsample=0.6)
    one, again = (drawn.fit(df, features=list("abc"), target="y", context=Context(5)).predict(df).orderBy("id").toPandas() for _ in range(2))
    assert np.allclose(one["prediction"], again["prediction"]) and not np.allclose(one["prediction"], fitted[2])
    assert np.sqrt(((one["prediction"] - one["y"]) ** 2).mean()) < one["y"].std() / 2
    c = T.HistGradientBoostingClassifier(n_estimators=6, learning_rate=0.5, row_subsample=0.7).fit(df, features=list("abc"), target="k").predict(df).toPandas()
    assert (c["prediction"] == c["k"]).mean() > 0.9


def test_neighbors_in_blocks(spark, monkeypatch):
    from orrery.operators import neighbors as N

    df = spark.range(90).select("id", (F.col("id") * 37 % 89).cast("double").alias("x"), (F.col("id") * 11 % 13).cast("double").alias("y")).repartition(3)
    f = N.NearestNeighbors(4).fit(df, features=["x", "y"], id="id")
    rows = lambda: [(r["query_id"], r["rank"], r["neighbor_id"], round(r["distance"], 9)) for r in f.kneighbors(df, "id").orderBy("query_id", "rank").collect()]
    whole = rows()
    monkeypatch.setattr(N, "BLOCK_ROWS", 20)
    assert rows() == whole and len(whole) == 360
