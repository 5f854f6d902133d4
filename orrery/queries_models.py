"""Queries of models whose fits have a closed form, or a few Newton steps, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery import selection
from orrery.core import Dataset
from orrery.operators.linear import ElasticNet, Lasso, LinearRegression, LogisticRegression, PartialLeastSquaresRegression, RidgeRegression
from orrery.operators.meta import MultiOutputRegressor, OneVsRestClassifier, TransformedTargetRegressor, VotingRegressor
from orrery.operators.preprocess import Standardize
from orrery.operators.probabilistic import LinearDiscriminantAnalysis, QuadraticDiscriminantAnalysis
from orrery.operators.unsupervised import PCA, TruncatedSVD
from orrery.plotdata import individual_dependence, loadings, partial_dependence_pair, residual_histogram, residuals, scree
from orrery.queries import _coefficients, _lines, _query, _r, _read


@_query("SELECT o_orderkey, round(o_totalprice, 4) AS o_totalprice FROM orders")
def inverse_transform(spark, d):
    df = _read(spark, d, "orders").select("o_orderkey", "o_totalprice")
    f = Standardize().fit(df, features=["o_totalprice"])
    return _r(f.inverse_transform(f.transform(df)))


@_query("SELECT o_orderkey, round((o_totalprice - avg(o_totalprice) OVER ()) / stddev_pop(o_totalprice) OVER (), 4) + 0.0 AS o_totalprice FROM orders")
def partial_fit_standardize(spark, d):
    df = _read(spark, d, "orders").select("o_orderkey", "o_totalprice")
    f = None
    for k in range(3):
        f = Standardize().partial_fit(f, Dataset(df.where(F.col("o_orderkey") % 3 == k), ("o_totalprice",)))
    return _r(f.transform(df))



def _penalised(l1: float, l2: float) -> str:
    slope = f"sign(c) * greatest(abs(c) - {l1}, 0) / (v + {l2})"
    return f"WITH m AS (SELECT covar_pop(l_quantity, l_extendedprice / 1000) AS c, var_pop(l_quantity) AS v, avg(l_quantity) AS x, avg(l_extendedprice / 1000) AS y FROM lineitem) SELECT 'intercept' AS term, round(y - x * {slope}, 4) + 0.0 AS value FROM m UNION ALL SELECT 'l_quantity', round({slope}, 4) + 0.0 FROM m"


def _thousands(spark, d) -> DataFrame:
    return _lines(spark, d).withColumn("price", F.col("l_extendedprice") / 1000)


@_query(_penalised(20.0, 0.0))
def lasso(spark, d):
    f = Lasso(20.0).fit(_thousands(spark, d), features=["l_quantity"], target="price")
    return _r(spark.createDataFrame(_coefficients(f), "term string, value double"))


@_query(_penalised(15.0, 35.0))
def elastic_net(spark, d):
    f = ElasticNet(50.0, 0.3).fit(_thousands(spark, d), features=["l_quantity"], target="price")
    return _r(spark.createDataFrame(_coefficients(f), "term string, value double"))


_OPEN = "SELECT o_orderkey, o_totalprice / 100000.0::DOUBLE AS x, (o_orderstatus = 'O')::INT::DOUBLE AS y FROM orders"


def _open(spark, d) -> DataFrame:
    return _read(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") / 100000).alias("x"), (F.col("o_orderstatus") == "O").cast("int").alias("y"))


_NEWTON = f"""WITH RECURSIVE s AS (SELECT x, y FROM ({_OPEN})), it(k, a, b) AS (SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE UNION ALL
 SELECT k + 1, a - ((h2 + 2.0) * g0 - h1 * (g1 + 2.0 * b)) / (h0 * (h2 + 2.0) - h1 * h1), b - (h0 * (g1 + 2.0 * b) - h1 * g0) / (h0 * (h2 + 2.0) - h1 * h1) FROM (
  SELECT k, a, b, sum(p - y) AS g0, sum(x * (p - y)) AS g1, sum(p * (1 - p)) AS h0, sum(x * p * (1 - p)) AS h1, sum(x * x * p * (1 - p)) AS h2 FROM (
   SELECT k, a, b, x, y, 1 / (1 + exp(-(a + b * x))) AS p FROM it, s WHERE k < 12) GROUP BY k, a, b))"""


@_query(f"{_NEWTON} SELECT o_orderkey, round(1 - 1 / (1 + exp(-(a + b * x))), 4) AS proba_0, round(1 / (1 + exp(-(a + b * x))), 4) AS proba_1 FROM ({_OPEN}), it WHERE k = 12")
def logistic_probabilities(spark, d):
    df = _open(spark, d)
    return _r(LogisticRegression(2.0, tolerance=1e-11).fit(df, features=["x"], target="y").predict_proba(df).select("o_orderkey", "proba_0", "proba_1"))


@_query(f"{_NEWTON} SELECT o_orderkey, (a + b * x > 0)::INT AS prediction FROM ({_OPEN}), it WHERE k = 12")
def one_vs_rest(spark, d):
    df = _open(spark, d)
    return OneVsRestClassifier(LogisticRegression(2.0)).fit(df, features=["x"], target="y").predict(df).select("o_orderkey", F.col("prediction").cast("int").alias("prediction"))


_STATUS = "SELECT o_orderkey, o_orderstatus AS k, o_totalprice / 100000.0::DOUBLE AS x, (o_custkey % 11)::DOUBLE AS z FROM orders"


def _status(spark, d) -> DataFrame:
    return _read(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("k"), (F.col("o_totalprice") / 100000).alias("x"), (F.col("o_custkey") % 11).cast("double").alias("z"))


def _discriminant(pooled: bool) -> str:
    """Joint log-likelihoods of the classes, with the inverse of a symmetric matrix of two rows written out."""
    own = "var_pop(x) AS a, covar_pop(x, z) AS b, var_pop(z) AS e"
    spread = "SELECT k, n, mx, mz, sum(n * a) OVER () / sum(n) OVER () + 1e-6 AS a, sum(n * b) OVER () / sum(n) OVER () AS b, sum(n * e) OVER () / sum(n) OVER () + 1e-6 AS e FROM c" if pooled else "SELECT k, n, mx, mz, a + 1e-6 AS a, b, e + 1e-6 AS e FROM c"
    joint = "ln(n / (sum(n) OVER (PARTITION BY o_orderkey))) - 0.5 * ln(a * e - b * b) - 0.5 * (e * (x - mx) ** 2 - 2 * b * (x - mx) * (z - mz) + a * (z - mz) ** 2) / (a * e - b * b)"
    return f"""WITH s AS ({_STATUS}), c AS (SELECT k, count(*)::DOUBLE AS n, avg(x) AS mx, avg(z) AS mz, {own} FROM s GROUP BY k), v AS ({spread}),
 j AS (SELECT o_orderkey, v.k, {joint} AS l FROM s, v), t AS (SELECT o_orderkey, k, exp(l) / sum(exp(l)) OVER (PARTITION BY o_orderkey) AS p FROM j)
 SELECT o_orderkey, round(max(p) FILTER (k = 'F'), 6) AS "proba_F", round(max(p) FILTER (k = 'O'), 6) AS "proba_O", round(max(p) FILTER (k = 'P'), 6) AS "proba_P" FROM t GROUP BY 1"""


@_query(_discriminant(True))
def linear_discriminant(spark, d):
    df = _status(spark, d)
    return _r(LinearDiscriminantAnalysis().fit(df, features=["x", "z"], target="k").predict_proba(df).select("o_orderkey", "proba_F", "proba_O", "proba_P"), 6)


@_query(_discriminant(False))
def quadratic_discriminant(spark, d):
    df = _status(spark, d)
    return _r(QuadraticDiscriminantAnalysis().fit(df, features=["x", "z"], target="k").predict_proba(df).select("o_orderkey", "proba_F", "proba_O", "proba_P"), 6)


_SVD = "(SELECT sum(l_quantity * l_quantity) AS a, sum(l_quantity * l_tax * 1000) AS b, sum(l_tax * l_tax * 1e6) AS e FROM lineitem)"


@_query(f"SELECT round(sqrt((a + e) / 2 + sqrt((a - e) ** 2 / 4 + b * b)), 3) AS s1, round(sqrt((a + e) / 2 - sqrt((a - e) ** 2 / 4 + b * b)), 3) AS s2 FROM {_SVD}")
def singular_values(spark, d):
    df = _lines(spark, d).select("l_quantity", (F.col("l_tax") * 1000).alias("tax"))
    f = TruncatedSVD().fit(df, features=["l_quantity", "tax"])
    return _r(spark.createDataFrame([tuple(float(v) for v in f.explained)], "s1 double, s2 double"), 3)


_PCA = """WITH c AS (SELECT var_samp(l_quantity) AS a, covar_samp(l_quantity, l_tax * 1000) AS b, var_samp(l_tax * 1000) AS e, avg(l_quantity) AS mx, avg(l_tax * 1000) AS mz FROM lineitem),
 v AS (SELECT *, (a + e) / 2 + sqrt((a - e) ** 2 / 4 + b * b) AS v1, (a + e) / 2 - sqrt((a - e) ** 2 / 4 + b * b) AS v2 FROM c)"""


@_query(f"{_PCA} SELECT 1 AS component, round(v1, 4) AS variance, round(v1 / (v1 + v2), 6) AS ratio, round(v1 / (v1 + v2), 6) AS cumulative FROM v UNION ALL SELECT 2, round(v2, 4), round(v2 / (v1 + v2), 6), 1.0 FROM v")
def scree_table(spark, d):
    df = _lines(spark, d).select("l_quantity", (F.col("l_tax") * 1000).alias("tax"))
    t = scree(spark, PCA().fit(df, features=["l_quantity", "tax"]))
    return t.select("component", F.round("variance", 4).alias("variance"), F.round("ratio", 6).alias("ratio"), F.round("cumulative", 6).alias("cumulative"))


@_query(f"{_PCA}, w AS (SELECT v1 - e AS p, b AS q FROM v) SELECT component, feature, round(abs(x) / sqrt(p * p + q * q), 4) AS size FROM (SELECT 1 AS component, 'l_quantity' AS feature, p AS x, p, q FROM w UNION ALL SELECT 1, 'tax', q, p, q FROM w UNION ALL SELECT 2, 'l_quantity', q, p, q FROM w UNION ALL SELECT 2, 'tax', p, p, q FROM w)")
def loadings_table(spark, d):
    df = _lines(spark, d).select("l_quantity", (F.col("l_tax") * 1000).alias("tax"))
    return _r(loadings(spark, PCA().fit(df, features=["l_quantity", "tax"])).select("component", "feature", F.abs("loading").alias("size")))


def _line(y: str, x: str = "l_quantity") -> str:
    return f"(regr_intercept({y}, {x}) + regr_slope({y}, {x}) * q)"


_GRID = "(SELECT unnest([1.0, 20.0, 50.0])::DOUBLE AS q)"


def _at(spark) -> DataFrame:
    return spark.createDataFrame([(1.0,), (20.0,), (50.0,)], "l_quantity double")


@_query(f"SELECT q AS l_quantity, round({_line('l_extendedprice')}, 3) AS price, round({_line('l_tax * 100')}, 4) AS tax FROM lineitem, {_GRID} GROUP BY q")
def multi_output_regressor(spark, d):
    df = _lines(spark, d).select("l_quantity", F.col("l_extendedprice").alias("price"), (F.col("l_tax") * 100).alias("tax"))
    f = MultiOutputRegressor(LinearRegression()).fit(Dataset(df, ("l_quantity",), ("price", "tax")))
    out = f.predict(_at(spark))
    price, tax = [c for c in out.columns if c != "l_quantity"]
    return out.select("l_quantity", F.round(price, 3).alias("price"), F.round(tax, 4).alias("tax"))


@_query(f"""WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, covar_pop(l_quantity, l_extendedprice) * count(*) / (var_pop(l_quantity) * count(*) + 1e6) AS r, avg(l_quantity) AS x, avg(l_extendedprice) AS y FROM lineitem)
 SELECT q AS l_quantity, round((3 * (y + b * (q - x)) + (y + r * (q - x))) / 4, 3) AS prediction FROM f, {_GRID}""")
def voting_regressor(spark, d):
    f = VotingRegressor((LinearRegression(), RidgeRegression(1e6)), (3.0, 1.0)).fit(_lines(spark, d), features=["l_quantity"], target="l_extendedprice")
    return _r(f.predict(_at(spark)).select("l_quantity", "prediction"), 3)


@_query(f"SELECT q AS l_quantity, round(exp{_line('ln(l_extendedprice)')}, 2) AS prediction FROM lineitem, {_GRID} GROUP BY q")
def transformed_target(spark, d):
    f = TransformedTargetRegressor(LinearRegression(), F.log, F.exp).fit(_lines(spark, d), features=["l_quantity"], target="l_extendedprice")
    return _r(f.predict(_at(spark)).select("l_quantity", "prediction"), 2)


@_query("""WITH m AS (SELECT avg(l_quantity) AS mx, avg(l_tax) AS mt, avg(l_extendedprice) AS my, stddev_pop(l_quantity) AS sx, stddev_pop(l_tax) AS st, corr(l_quantity, l_tax) AS r, covar_pop(l_quantity, l_extendedprice) / stddev_pop(l_quantity) AS cx, covar_pop(l_tax, l_extendedprice) / stddev_pop(l_tax) AS ct FROM lineitem),
 f AS (SELECT *, (cx * cx + ct * ct) / (cx * cx + ct * ct + 2 * r * cx * ct) AS k FROM m)
 SELECT term, round(value, 3) + 0.0 AS value FROM (SELECT 'intercept' AS term, my - k * (cx / sx * mx + ct / st * mt) AS value FROM f UNION ALL SELECT 'l_quantity', k * cx / sx FROM f UNION ALL SELECT 'l_tax', k * ct / st FROM f)""")
def partial_least_squares(spark, d):
    f = PartialLeastSquaresRegression(1).fit(_lines(spark, d), features=["l_quantity", "l_tax"], target="l_extendedprice")
    return _r(spark.createDataFrame(_coefficients(f), "term string, value double"), 3)


@_query("""WITH r AS (SELECT p_size::DOUBLE AS x, p_retailprice AS y, row_number() OVER (ORDER BY p_partkey) - 1 AS k, count(*) OVER () AS n FROM part),
 g AS (SELECT x, y, CASE WHEN k < (n % 3) * (n // 3 + 1) THEN k // (n // 3 + 1) ELSE n % 3 + (k - (n % 3) * (n // 3 + 1)) // (n // 3) END + 1 AS fold FROM r),
 f AS (SELECT h.fold, avg(g.x) AS mx, avg(g.y) AS my, covar_pop(g.x, g.y) * count(*) / (var_pop(g.x) * count(*) + 1) AS b FROM g, (SELECT unnest([1, 2, 3]) AS fold) h WHERE g.fold <> h.fold GROUP BY h.fold)
 SELECT fold::INT AS fold, round(sqrt(avg((y - my - b * (x - mx)) ** 2)), 4) AS score FROM g JOIN f USING (fold) GROUP BY fold""")
def cross_validation(spark, d):
    df = _read(spark, d, "part").select("p_partkey", "p_size", "p_retailprice")
    data = Dataset(df, ("p_size",), "p_retailprice", id="p_partkey")
    return _r(selection.cross_validate(RidgeRegression(1.0), data, selection.KFold(3)).to_df(spark))


_FIT = "(SELECT regr_slope(p_retailprice, p_size) AS b, regr_intercept(p_retailprice, p_size) AS a FROM part)"


def _fitted(spark, d):
    data = Dataset(_read(spark, d, "part").select("p_partkey", "p_size", "p_retailprice"), ("p_size",), "p_retailprice", id="p_partkey")
    return LinearRegression().fit(data), data


@_query(f"SELECT p_partkey, round(a + b * p_size, 4) AS prediction, round(p_retailprice - a - b * p_size, 4) + 0.0 AS residual FROM part, {_FIT}")
def residual_table(spark, d):
    return _r(residuals(*_fitted(spark, d)).select("p_partkey", "prediction", "residual"))


@_query(f"WITH r AS (SELECT p_retailprice - a - b * p_size AS r FROM part, {_FIT}), e AS (SELECT min(r) AS low, (max(r) - min(r)) / 8 AS w FROM r) SELECT least(floor((r - low) / w), 7)::INT AS bin, count(*) AS n FROM r, e GROUP BY 1")
def residual_bins(spark, d):
    return residual_histogram(*_fitted(spark, d), bins=8)


@_query(f"SELECT p_partkey AS id, q AS value, round(a + b * q, 4) AS prediction FROM part, {_GRID}, {_FIT}")
def individual_dependence_table(spark, d):
    return _r(individual_dependence(*_fitted(spark, d), "p_size", [1.0, 20.0, 50.0]))


@_query("""WITH m AS (SELECT avg(l_quantity) AS x, avg(l_discount) AS z, avg(l_extendedprice) AS y, var_pop(l_quantity) AS a, covar_pop(l_quantity, l_discount) AS b, var_pop(l_discount) AS e, covar_pop(l_quantity, l_extendedprice) AS p, covar_pop(l_discount, l_extendedprice) AS q FROM lineitem),
 f AS (SELECT *, (e * p - b * q) / (a * e - b * b) AS bx, (a * q - b * p) / (a * e - b * b) AS bz FROM m)
 SELECT u AS x, v AS y, round(f.y + bx * (u - f.x) + bz * (v - z), 3) AS prediction FROM f, (SELECT unnest([1.0, 30.0])::DOUBLE AS u), (SELECT unnest([0.0, 0.05, 0.1])::DOUBLE AS v)""")
def partial_dependence_two(spark, d):
    data = Dataset(_lines(spark, d), ("l_quantity", "l_discount"), "l_extendedprice")
    return _r(partial_dependence_pair(LinearRegression().fit(data), data, ("l_quantity", "l_discount"), [1.0, 30.0], [0.0, 0.05, 0.1]), 3)
