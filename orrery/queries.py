"""The library's queries over the driver's tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import orrery.operators  # noqa: F401
from orrery import functions as K
from orrery import metrics, selection
from orrery.core import Dataset
from orrery.operators.linear import LinearRegression, MeanRegressor, PoissonRegression, RidgeRegression
from orrery.operators.neighbors import KNeighborsClassifier, KNeighborsRegressor, NearestNeighbors
from orrery.operators.preprocess import Impute, MinMaxScale, Normalize, OneHotEncode, PolynomialFeatures, RobustScale, Standardize
from orrery.operators.probabilistic import GaussianNaiveBayes, MultinomialNaiveBayes
from orrery.operators.trees import DecisionTreeRegressor
from orrery.operators.unsupervised import DBSCAN, PCA, CentersFit, KMeans
from orrery.pipeline import Chain, ColumnMap, Select

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _r(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles rounded, so that different orders of summation give the same value."""
    return df.select(*[(F.round(F.col(f.name), digits) + F.lit(0.0)).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f"`{f.name}`") for f in df.schema.fields])


ORDERS = "o_orderkey, o_totalprice"


@_query("SELECT o_orderkey, round((o_totalprice - avg(o_totalprice) OVER ()) / stddev_pop(o_totalprice) OVER (), 4) + 0.0 AS o_totalprice FROM orders")
def standardize(spark, d):
    df = _read(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return _r(Standardize().fit(df, features=["o_totalprice"]).transform(df))


@_query("SELECT o_orderkey, round(-1 + 2 * (o_totalprice - min(o_totalprice) OVER ()) / (max(o_totalprice) OVER () - min(o_totalprice) OVER ()), 4) + 0.0 AS o_totalprice FROM orders")
def min_max_scale(spark, d):
    df = _read(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return _r(MinMaxScale((-1.0, 1.0)).fit(df, features=["o_totalprice"]).transform(df))


@_query("SELECT o_orderkey, round((o_totalprice - q.m) / (q.h - q.l), 4) + 0.0 AS o_totalprice FROM orders, (SELECT quantile_cont(o_totalprice, 0.5) AS m, quantile_cont(o_totalprice, 0.25) AS l, quantile_cont(o_totalprice, 0.75) AS h FROM orders) q")
def robust_scale(spark, d):
    df = _read(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return _r(RobustScale().fit(df, features=["o_totalprice"]).transform(df))


@_query("SELECT p_partkey, round(p_size / sqrt(p_size * p_size + p_retailprice * p_retailprice), 4) AS p_size, round(p_retailprice / sqrt(p_size * p_size + p_retailprice * p_retailprice), 4) AS p_retailprice FROM part")
def normalize_rows(spark, d):
    df = _read(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    return _r(Normalize().fit(df, features=["p_size", "p_retailprice"]).transform(df))


@_query("SELECT p_partkey, 1.0::DOUBLE AS bias, p_size::DOUBLE AS polynomial1, p_retailprice AS polynomial2, round(p_size * p_size::DOUBLE, 4) AS polynomial3, round(p_size * p_retailprice, 4) AS polynomial4, round(p_retailprice * p_retailprice, 4) AS polynomial5 FROM part")
def polynomial_features(spark, d):
    df = _read(spark, d, "part").select("p_partkey", "p_size", "p_retailprice")
    return _r(PolynomialFeatures().fit(df, features=["p_size", "p_retailprice"]).transform(df))


_HOLES = "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS price, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS priority FROM orders"


@_query(f"""WITH h AS ({_HOLES}), m AS (SELECT avg(price) AS a FROM h),
 p AS (SELECT priority FROM h WHERE priority IS NOT NULL GROUP BY priority ORDER BY count(*) DESC, min(o_orderkey) LIMIT 1)
 SELECT o_orderkey, round(coalesce(price, (SELECT a FROM m)), 4) AS price, coalesce(priority, (SELECT priority FROM p)) AS priority FROM h""")
def impute(spark, d):
    df = _read(spark, d, "orders")
    df = df.select("o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("price"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("priority"))
    return _r(Impute().fit(df, features=["price", "priority"], id="o_orderkey").transform(df))


@_query("SELECT o_orderkey, (o_orderstatus = 'F')::INT::DOUBLE AS \"o_orderstatus__F\", (o_orderstatus = 'O')::INT::DOUBLE AS \"o_orderstatus__O\", (o_orderstatus = 'P')::INT::DOUBLE AS \"o_orderstatus__P\" FROM orders")
def one_hot_encode(spark, d):
    df = _read(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return OneHotEncode().fit(df, features=["o_orderstatus"]).transform(df)


@_query("""WITH s AS (SELECT o_orderkey, o_orderstatus, (o_totalprice - avg(o_totalprice) OVER ()) / stddev_pop(o_totalprice) OVER () AS x FROM orders)
 SELECT o_orderkey, round(x, 4) + 0.0 AS o_totalprice, (o_orderstatus = 'F')::INT::DOUBLE AS "o_orderstatus__F", (o_orderstatus = 'O')::INT::DOUBLE AS "o_orderstatus__O", (o_orderstatus = 'P')::INT::DOUBLE AS "o_orderstatus__P" FROM s""")
def column_map(spark, d):
    df = _read(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    spec = ColumnMap(("o_totalprice", Standardize()), ("o_orderstatus", OneHotEncode()))
    return _r(spec.fit(df, features=["o_totalprice", "o_orderstatus"]).transform(df))


@_query("SELECT p_partkey, round((p_retailprice - avg(p_retailprice) OVER ()) / stddev_pop(p_retailprice) OVER (), 4) + 0.0 AS p_retailprice FROM part")
def select_chain(spark, d):
    df = _read(spark, d, "part").select("p_partkey", "p_size", "p_retailprice")
    return _r(Chain(Select("p_retailprice"), Standardize()).fit(df, features=["p_size", "p_retailprice"]).transform(df))


def _lines(spark, d) -> DataFrame:
    return _read(spark, d, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _coefficients(f) -> list[tuple]:
    return [("intercept", float(f.intercept)), *[(c, float(b)) for c, b in zip(f.features, f.coefficients, strict=True)]]


@_query("SELECT 'intercept' AS term, round(regr_intercept(l_extendedprice, l_quantity), 4) AS value FROM lineitem UNION ALL SELECT 'l_quantity', round(regr_slope(l_extendedprice, l_quantity), 4) FROM lineitem")
def linear_regression(spark, d):
    f = LinearRegression().fit(_lines(spark, d), features=["l_quantity"], target="l_extendedprice")
    return _r(spark.createDataFrame(_coefficients(f), "term string, value double"))


_RIDGE = "(SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS s, avg(l_extendedprice) AS b, count(*) * covar_pop(l_quantity, l_extendedprice) / stddev_pop(l_quantity) / (count(*) + 1000.0) AS a FROM lineitem)"


@_query(f"SELECT l_quantity, count(*) AS n, round(any_value(f.b + f.a * (l_quantity - f.m) / f.s), 2) AS prediction FROM lineitem, {_RIDGE} f GROUP BY l_quantity")
def chain_standardize_ridge(spark, d):
    df = _lines(spark, d)
    f = Chain(Standardize(), RidgeRegression(1000.0)).fit(df.withColumn("x", F.col("l_quantity")), features=["x"], target="l_extendedprice")
    return _r(f.predict(df.withColumn("x", F.col("l_quantity"))).groupBy("l_quantity").agg(F.count(F.lit(1)).alias("n"), F.first("prediction").alias("prediction")), 2)


@_query("SELECT round(sum(l_quantity * l_extendedprice) / sum(l_quantity), 4) AS prediction FROM lineitem")
def mean_regressor(spark, d):
    df = _lines(spark, d)
    f = MeanRegressor().fit(df, features=["l_tax"], target="l_extendedprice", weight="l_quantity")
    return _r(f.predict(spark.range(1)).select("prediction"))


@_query("""WITH RECURSIVE g AS (SELECT p_size / 50.0::DOUBLE AS x, count(*)::DOUBLE AS n, sum(p_retailprice) AS t FROM part GROUP BY 1),
it(k, a, b) AS (SELECT 0, ln(sum(t) / sum(n)), 0.0::DOUBLE FROM g UNION ALL
 SELECT k + 1, a + (s2 * g0 - s1 * g1) / (s0 * s2 - s1 * s1), b + (s0 * g1 - s1 * g0) / (s0 * s2 - s1 * s1) FROM (
  SELECT k, a, b, sum(n * exp(a + b * x)) AS s0, sum(n * x * exp(a + b * x)) AS s1, sum(n * x * x * exp(a + b * x)) AS s2,
   sum(t - n * exp(a + b * x)) AS g0, sum(x * (t - n * exp(a + b * x))) AS g1 FROM it, g WHERE k < 25 GROUP BY k, a, b))
SELECT term, round(v, 3) + 0.0 AS value FROM (SELECT 'intercept' AS term, a AS v FROM it WHERE k = 25 UNION ALL SELECT 'x', b FROM it WHERE k = 25)""")
def poisson_regression(spark, d):
    df = _read(spark, d, "part").select((F.col("p_size") / 50).alias("x"), F.col("p_retailprice").alias("y"))
    f = PoissonRegression().fit(df, features=["x"], target="y")
    return _r(spark.createDataFrame(_coefficients(f), "term string, value double"), 3)


@_query("""WITH m AS (SELECT avg(l_quantity) AS q, avg(l_discount) AS k FROM lineitem) SELECT i, j, round(v, 6) AS value FROM (
 SELECT 'l_quantity' AS i, 'l_quantity' AS j, covar_samp(l_quantity, l_quantity) AS v FROM lineitem UNION ALL SELECT 'l_quantity', 'l_discount', covar_samp(l_quantity, l_discount) FROM lineitem
 UNION ALL SELECT 'l_discount', 'l_quantity', covar_samp(l_discount, l_quantity) FROM lineitem UNION ALL SELECT 'l_discount', 'l_discount', covar_samp(l_discount, l_discount) FROM lineitem)""")
def covariance_matrix(spark, d):
    return _r(K.covariance_matrix(_lines(spark, d), ["l_quantity", "l_discount"]), 6)


@_query("""WITH c AS (SELECT var_samp(l_quantity) AS a, covar_samp(l_quantity, l_tax * 1000) AS b, var_samp(l_tax * 1000) AS d FROM lineitem)
 SELECT round((a + d) / 2 + sqrt((a - d) * (a - d) / 4 + b * b), 4) AS v1, round((a + d) / 2 - sqrt((a - d) * (a - d) / 4 + b * b), 4) AS v2 FROM c""")
def pca_variances(spark, d):
    df = _lines(spark, d).select("l_quantity", (F.col("l_tax") * 1000).alias("tax"))
    f = PCA().fit(df, features=["l_quantity", "tax"])
    return _r(spark.createDataFrame([tuple(float(v) for v in f.explained)], "v1 double, v2 double"))


@_query("SELECT o_orderstatus AS \"row\", o_orderpriority AS \"column\", coalesce(n, 0)::BIGINT AS n FROM (SELECT DISTINCT o_orderstatus FROM orders) a CROSS JOIN (SELECT DISTINCT o_orderpriority FROM orders) b LEFT JOIN (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2) c USING (o_orderstatus, o_orderpriority)")
def contingency_matrix(spark, d):
    return K.contingency(_read(spark, d, "orders"), "o_orderstatus", "o_orderpriority")


@_query("SELECT b.bin::INT AS bin, count(p_size)::BIGINT AS n FROM range(5) b(bin) LEFT JOIN part ON (p_size >= bin * 10 AND (p_size < bin * 10 + 10 OR (bin = 4 AND p_size = 50))) GROUP BY 1")
def histogram_counts(spark, d):
    return K.histogram_counts(_read(spark, d, "part"), "p_size", [0, 10, 20, 30, 40, 50])


@_query("SELECT p_partkey, p_brand, rank() OVER w + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0::DOUBLE AS rank FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size)")
def rank_values(spark, d):
    return _read(spark, d, "part").select("p_partkey", "p_brand", K.rank_values("p_size", "average", ["p_brand"]).alias("rank"))


@_query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def topk(spark, d):
    return K.topk(_read(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", 25)


@_query("SELECT round(avg((p - y) * (p - y)), 4) AS mse, round(sqrt(avg((p - y) * (p - y))), 4) AS rmse, round(avg(abs(p - y)), 4) AS mae, round(avg(CASE WHEN abs(p - y) <= 1.35 THEN 0.5 * (p - y) * (p - y) ELSE 1.35 * (abs(p - y) - 0.675) END), 4) AS huber, round(avg(CASE WHEN y >= p THEN 0.9 * (y - p) ELSE -0.1 * (y - p) END), 4) AS pinball FROM (SELECT l_quantity AS y, 25 + l_discount * 10 AS p FROM lineitem)")
def regression_losses(spark, d):
    y, p = F.col("l_quantity"), 25 + F.col("l_discount") * 10
    return _r(_lines(spark, d).agg(K.mean_squared_error(y, p).alias("mse"), K.root_mean_squared_error(y, p).alias("rmse"), K.mean_absolute_error(y, p).alias("mae"), K.huber_loss(y, p).alias("huber"), K.quantile_loss(y, p, 0.9).alias("pinball")))


@_query("SELECT round(sum(w * x) / sum(w), 6) AS mean, round((sum(w * x * x) - sum(w * x) * sum(w * x) / sum(w)) / (sum(w) - sum(w * w) / sum(w)), 4) AS variance FROM (SELECT l_tax * 100 AS x, l_quantity AS w FROM lineitem)")
def weighted_moments(spark, d):
    x, w = F.col("l_tax") * 100, F.col("l_quantity")
    out = _lines(spark, d).agg(K.weighted_mean(x, w).alias("mean"), K.weighted_variance(x, w, True).alias("variance"))
    return out.select(F.round("mean", 6).alias("mean"), F.round("variance", 4).alias("variance"))


_SCORED = "SELECT doc_id, quality AS y, CASE WHEN n_chars > 1500 THEN 1 ELSE 0 END AS p, round(n_chars / (n_chars + 1500.0), 3)::DOUBLE AS s FROM labels JOIN documents USING (doc_id)"


def _scored(spark, d) -> DataFrame:
    df = _read(spark, d, "labels").join(_read(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return df.select("doc_id", F.col("quality").alias("y"), (F.col("n_chars") > 1500).cast("int").alias("p"), F.round(F.col("n_chars") / (F.col("n_chars") + 1500.0), 3).alias("s"))


@_query(f"SELECT round(avg((y = p)::INT), 6) AS accuracy FROM ({_SCORED})")
def accuracy(spark, d):
    return _r(metrics.accuracy_score(_scored(spark, d), "y", "p"), 6)


@_query(f"WITH s AS ({_SCORED}) SELECT a.v::INT AS actual, b.v::INT AS predicted, (SELECT count(*) FROM s WHERE y = a.v AND p = b.v)::DOUBLE AS n FROM range(2) a(v), range(2) b(v)")
def confusion_matrix(spark, d):
    return metrics.confusion_matrix(_scored(spark, d), "y", "p")


_PRF = f"""WITH s AS ({_SCORED}), c AS (SELECT v, (SELECT count(*) FROM s WHERE y = v AND p = v)::DOUBLE AS tp, (SELECT count(*) FROM s WHERE p = v)::DOUBLE AS pp, (SELECT count(*) FROM s WHERE y = v)::DOUBLE AS ap FROM range(2) r(v))"""


@_query(f"{_PRF} SELECT round(avg(tp / pp), 6) AS precision, round(avg(tp / ap), 6) AS recall, round(avg(2 * tp / (pp + ap)), 6) AS f1 FROM c")
def precision_recall_f1(spark, d):
    return _r(metrics.precision_recall_f1(_scored(spark, d), "y", "p"), 6)


_CURVE = f"""WITH g AS (SELECT s AS threshold, sum(y)::DOUBLE AS p, sum(1 - y)::DOUBLE AS n FROM ({_SCORED}) GROUP BY s),
 c AS (SELECT threshold, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER () AS P, sum(n) OVER () AS N FROM g WINDOW w AS (ORDER BY threshold DESC))"""


@_query(_CURVE.replace(" AS P,", " AS pos,").replace(" AS N FROM", " AS neg FROM") + " SELECT threshold, round(fp / neg, 6) AS fpr, round(tp / pos, 6) AS tpr FROM c UNION ALL SELECT 'Infinity'::DOUBLE, 0.0, 0.0")
def roc_curve(spark, d):
    return _r(metrics.roc_curve(_scored(spark, d), "y", "s"), 6)


@_query(_CURVE.replace(" AS P,", " AS pos,").replace(" AS N FROM", " AS neg FROM") + " SELECT threshold, round(tp / (tp + fp), 6) AS precision, round(tp / pos, 6) AS recall FROM c UNION ALL SELECT 'Infinity'::DOUBLE, 1.0, 0.0")
def precision_recall_curve(spark, d):
    return _r(metrics.precision_recall_curve(_scored(spark, d), "y", "s"), 6)


@_query(_CURVE.replace(" AS P,", " AS pos,").replace(" AS N FROM", " AS neg FROM") + ", r AS (SELECT threshold, fp / neg AS x, tp / pos AS y FROM c UNION ALL SELECT 'Infinity'::DOUBLE, 0.0, 0.0) SELECT round(sum(a), 6) AS area FROM (SELECT (x - lag(x) OVER w) * (y + lag(y) OVER w) / 2 AS a FROM r WINDOW w AS (ORDER BY threshold DESC))")
def roc_auc(spark, d):
    return _r(metrics.area_under_curve(metrics.roc_curve(_scored(spark, d), "y", "s"), "fpr", "tpr"), 6)


@_query(f"SELECT least(floor(s * 10), 9)::INT AS bin, round(avg(s), 6) AS mean_predicted, round(avg(y), 6) AS observed, count(*) AS n FROM ({_SCORED}) GROUP BY 1")
def calibration_curve(spark, d):
    return _r(metrics.calibration_curve(_scored(spark, d), "y", "s"), 6)


@_query("""WITH r AS (SELECT event_id, row_number() OVER (ORDER BY md5('3|' || event_id::VARCHAR), event_id) - 1 AS k, count(*) OVER () AS n FROM events)
 SELECT event_id, (CASE WHEN k < (n % 7) * (n // 7 + 1) THEN k // (n // 7 + 1) ELSE n % 7 + (k - (n % 7) * (n // 7 + 1)) // (n // 7) END + 1)::INT AS fold FROM r""")
def k_fold(spark, d):
    return selection.split(selection.KFold(7, True, 3), _read(spark, d, "events"), "event_id").select("event_id", "fold")


@_query("SELECT event_id, row_number() OVER (ORDER BY md5('5|' || event_id::VARCHAR), event_id) <= ceil(0.25 * (SELECT count(*) FROM events)) AS is_test FROM events")
def train_test_split(spark, d):
    return selection.train_test_split(_read(spark, d, "events"), "event_id", 0.25, 5).select("event_id", "is_test")


@_query("""WITH r AS (SELECT event_id, row_number() OVER (ORDER BY event_id) AS k, row_number() OVER (ORDER BY md5('4002|' || event_id::VARCHAR), event_id) AS q, value FROM events)
 SELECT a.event_id, b.value FROM r a JOIN r b ON a.k = b.q""")
def permuted_column(spark, d):
    return selection.permuted(_read(spark, d, "events").select("event_id", "value"), "value", "event_id", 4, 2)


_EMB = "SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings"


#: Numbers of an embedding.
WHOLE = 64


def _embeddings(spark, d, dims: int = WHOLE) -> tuple[DataFrame, list[str]]:
    names = [f"e{i}" for i in range(dims)]
    return _read(spark, d, "embeddings").select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(names)]), names


_NEAR = f"""WITH v AS ({_EMB}), q AS (SELECT a.vec_id AS query_id, b.vec_id AS neighbor_id, a.label AS ql, b.label AS nl, list_distance(a.e, b.e) AS distance FROM v a, v b),
 n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), neighbor_id) AS rank FROM q QUALIFY rank <= 5)"""


@_query(f"{_NEAR} SELECT query_id, rank::INT AS rank, neighbor_id, round(distance, 4) AS distance FROM n WHERE rank > 1")
def k_neighbors(spark, d):
    df, names = _embeddings(spark, d)
    f = NearestNeighbors(5).fit(df, features=names, id="vec_id")
    return _r(f.kneighbors(df, "vec_id").where("rank > 1"))


@_query(f"{_NEAR} SELECT query_id AS vec_id, arg_min(nl, (-c, nl)) AS prediction FROM (SELECT query_id, nl, count(*) AS c FROM n GROUP BY 1, 2) GROUP BY 1")
def knn_classifier(spark, d):
    df, names = _embeddings(spark, d)
    return KNeighborsClassifier(5).fit(df, features=names, target="label", id="vec_id").predict(df).select("vec_id", "prediction")


@_query(f"{_NEAR} SELECT query_id AS vec_id, round(avg(nl), 4) AS prediction FROM n GROUP BY 1")
def knn_regressor(spark, d):
    df, names = _embeddings(spark, d)
    return _r(KNeighborsRegressor(5).fit(df, features=names, target="label", id="vec_id").predict(df).select("vec_id", "prediction"))


@_query(f"WITH v AS ({_EMB}) SELECT a.vec_id AS a, b.vec_id AS b, round(list_distance(a.e, b.e), 4) AS euclidean, round(1 - list_cosine_similarity(a.e, b.e), 4) AS cosine FROM v a JOIN v b ON b.vec_id = a.vec_id + 1")
def array_distances(spark, d):
    df = _read(spark, d, "embeddings")
    a = df.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x"))
    b = df.select(F.col("vec_id").alias("b"), F.col("embedding").alias("y"))
    both = a.join(b, F.col("b") == F.col("a") + 1)
    return _r(both.select("a", "b", K.euclidean(F.col("x"), F.col("y")).alias("euclidean"), K.cosine_distance(F.col("x"), F.col("y")).alias("cosine")))


@_query(f"""WITH v AS ({_EMB}), c AS (SELECT e, row_number() OVER (ORDER BY vec_id) AS k FROM v ORDER BY vec_id LIMIT 4),
 a AS (SELECT vec_id, v.e, arg_min(k, (list_distance(v.e, c.e), k)) AS k FROM v, c GROUP BY vec_id, v.e)
 SELECT k::INT AS cluster, count(*) AS n, place::INT AS place, round(avg(e[place + 1]), 4) + 0.0 AS mean FROM a, range({WHOLE}) p(place) GROUP BY k, place""")
def kmeans_step(spark, d):
    df, names = _embeddings(spark, d)
    start = [tuple(r) for r in df.orderBy("vec_id").limit(4).select(*names).collect()]
    f = KMeans(4, init=start, max_iterations=1).fit(df, features=names)
    given = CentersFit(f.spec, f.features, f.report, np.array(start))
    counts = given.predict(df).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    centers = spark.createDataFrame([(i + 1, j, float(v)) for i, c in enumerate(f.centers) for j, v in enumerate(c)], "cluster int, place int, mean double")
    return _r(counts.join(F.broadcast(centers), "cluster"))


@_query(f"""WITH RECURSIVE v AS ({_EMB}), p AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a, v b WHERE list_distance(a.e, b.e) <= 0.6),
 c AS MATERIALIZED (SELECT a FROM p GROUP BY a HAVING count(*) >= 4), g AS MATERIALIZED (SELECT a, b FROM p WHERE a IN (FROM c) AND b IN (FROM c)),
 r(a, b) AS (SELECT a, b FROM g UNION SELECT r.a, g.b FROM r JOIN g ON r.b = g.a), l AS (SELECT a, min(b) AS label FROM r GROUP BY a),
 k AS MATERIALIZED (SELECT a, dense_rank() OVER (ORDER BY label) AS cluster FROM l)
 SELECT vec_id AS id, coalesce(own.cluster, (SELECT min(cluster) FROM p JOIN k ON k.a = p.b WHERE p.a = vec_id), 0)::INT AS cluster, own.a IS NOT NULL AS core FROM v LEFT JOIN k own ON own.a = vec_id""")
def dbscan(spark, d):
    df, names = _embeddings(spark, d)
    return DBSCAN(0.6, 4).fit(df, features=names, id="vec_id").labels


_GNB = " - ".join(["ln(p)"] + [f"0.5 * ln(2 * pi() * v{i}) - (e[{i + 1}] - m{i}) * (e[{i + 1}] - m{i}) / (2 * v{i})" for i in range(WHOLE)])


@_query(f"""WITH v AS ({_EMB}), s AS (SELECT greatest({', '.join(f'var_pop(e[{i + 1}])' for i in range(WHOLE))}) * 1e-9 AS eps FROM v),
 c AS (SELECT label, count(*) / (SELECT count(*) FROM v)::DOUBLE AS p, {', '.join(f'avg(e[{i + 1}]) AS m{i}, var_pop(e[{i + 1}]) + (SELECT eps FROM s) AS v{i}' for i in range(WHOLE))} FROM v GROUP BY label)
 SELECT vec_id, arg_min(c.label, (-({_GNB}), c.label)) AS prediction FROM v, c GROUP BY vec_id""")
def gaussian_naive_bayes(spark, d):
    df, names = _embeddings(spark, d)
    return GaussianNaiveBayes().fit(df, features=names, target="label").predict(df).select("vec_id", "prediction")


@_query("""WITH c AS (SELECT o_orderstatus AS k, count(*) AS n, sum(x1) + 1.0 AS a, sum(x2) + 1.0 AS b FROM (SELECT o_orderstatus, o_custkey % 9 AS x1, o_orderkey % 4 AS x2 FROM orders) GROUP BY 1)
 SELECT k AS class, round(ln(n / (sum(n) OVER ())::DOUBLE), 6) AS prior, round(ln(a / (a + b)), 6) AS x1, round(ln(b / (a + b)), 6) AS x2 FROM c""")
def multinomial_naive_bayes(spark, d):
    df = _read(spark, d, "orders").select("o_orderstatus", (F.col("o_custkey") % 9).alias("x1"), (F.col("o_orderkey") % 4).alias("x2"))
    f = MultinomialNaiveBayes().fit(df, features=["x1", "x2"], target="o_orderstatus")
    rows = [(c, float(p), float(b[0]), float(b[1])) for c, p, b in zip(f.classes, f.log_priors, f.log_probabilities, strict=True)]
    return _r(spark.createDataFrame(rows, "class string, prior double, x1 double, x2 double"), 6)


@_query("""WITH g AS (SELECT p_size AS x, count(*) AS n, sum(p_retailprice) AS s FROM part GROUP BY 1), c AS (SELECT x, sum(n) OVER w AS n, sum(s) OVER w AS s, sum(n) OVER () AS tn, sum(s) OVER () AS ts, lead(x) OVER (ORDER BY x) AS nx FROM g WINDOW w AS (ORDER BY x))
 SELECT round((x + nx) / 2.0, 4) AS threshold, round(s / n, 4) AS "left", round((ts - s) / (tn - n), 4) AS "right" FROM c WHERE nx IS NOT NULL ORDER BY s * s / n + (ts - s) * (ts - s) / (tn - n) DESC, x LIMIT 1""")
def tree_stump(spark, d):
    df = _read(spark, d, "part").select("p_partkey", "p_size", "p_retailprice")
    t = DecisionTreeRegressor(max_depth=1).fit(df, features=["p_size"], target="p_retailprice", id="p_partkey").trees[0]
    return _r(spark.createDataFrame([(float(t.threshold[0]), float(t.value[t.left[0]][0]), float(t.value[t.right[0]][0]))], "threshold double, left double, right double"))


@_query()
def model_catalog(spark, d):
    from orrery.core import catalog_df

    return catalog_df(spark)


_PDP = "(SELECT regr_slope(l_extendedprice, l_quantity) AS a, regr_intercept(l_extendedprice, l_quantity) AS b FROM lineitem)"


@_query(f"SELECT v::DOUBLE AS value, round(b + a * v, 4) AS prediction FROM {_PDP}, (SELECT unnest([1.0, 10.0, 25.0, 50.0]) AS v)")
def partial_dependence(spark, d):
    from orrery.plotdata import partial_dependence as pdp

    data = Dataset(_lines(spark, d), ("l_quantity",), "l_extendedprice")
    return _r(pdp(LinearRegression().fit(data), data, "l_quantity", [1.0, 10.0, 25.0, 50.0]))


@_query("SELECT 1 AS id, 'Standardize' AS kind, '0' AS inputs UNION ALL SELECT 2, 'MinMaxScale', '1' UNION ALL SELECT 3, 'RidgeRegression', '2'")
def pipeline_graph(spark, d):
    from orrery.plans.graph import graph_data

    rows = graph_data(Chain(Standardize(), MinMaxScale(), RidgeRegression()))
    return spark.createDataFrame([(r["id"], r["kind"], ",".join(map(str, r["inputs"]))) for r in rows], "id int, kind string, inputs string")


@_query("SELECT o_orderkey, round((o_totalprice - min(o_totalprice) OVER ()) / (max(o_totalprice) OVER () - min(o_totalprice) OVER ()), 6) + 0.0 AS o_totalprice FROM orders")
def fused_affine_steps(spark, d):
    from orrery.plans.graph import fuse

    df = _read(spark, d, "orders").select("o_orderkey", "o_totalprice")
    fused = fuse(Chain(Standardize(), MinMaxScale()).fit(df, features=["o_totalprice"]))
    assert len(fused.steps) == 1
    return _r(fused.transform(df), 6)


def queries() -> dict[str, Query]:
    from orrery import queries_functions, queries_models  # noqa: F401  (they register theirs)

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)
