"""Queries of the function library, of metrics and of splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery import functions as K
from orrery import metrics, selection
from orrery.operators.preprocess import Normalize
from orrery.queries import _EMB, _SCORED, _lines, _query, _r, _read, _scored

_PART = "SELECT p_partkey, p_size / 10.0::DOUBLE AS a, p_retailprice / 500.0::DOUBLE AS b, (p_partkey % 7)::DOUBLE AS c FROM part"


def _part(spark, d) -> DataFrame:
    return _read(spark, d, "part").select("p_partkey", (F.col("p_size") / 10).alias("a"), (F.col("p_retailprice") / 500).alias("b"), (F.col("p_partkey") % 7).cast("double").alias("c"))


@_query("SELECT round(sum(l_extendedprice), 2) AS total, round(avg(l_extendedprice), 4) AS mean, round(var_samp(l_discount * 100), 6) AS variance, round(fsum(l_extendedprice), 2) AS stable, round(sqrt(sum(l_extendedprice * l_extendedprice)), 2) AS norm FROM lineitem")
def reductions(spark, d):
    df = _lines(spark, d)
    x = F.col("l_extendedprice")
    own = df.agg(K.reduction_sum(x).alias("total"), K.reduction_mean(x).alias("mean"), K.reduction_variance(F.col("l_discount") * 100).alias("variance"))
    own = own.crossJoin(K.stable_sum(df, "l_extendedprice").withColumnRenamed("sum", "stable")).crossJoin(K.stable_norm(df, "l_extendedprice"))  # one row each
    return own.select(*[F.round(c, n).alias(c) for c, n in (("total", 2), ("mean", 4), ("variance", 6), ("stable", 2), ("norm", 2))])


@_query(f"""WITH p AS ({_PART}), e AS (SELECT *, ln(exp(a) + exp(b) + exp(c)) AS t FROM p)
 SELECT p_partkey, round(t, 6) AS logsumexp, round(exp(a - t), 6) AS s1, round(exp(c - t), 6) AS s3, round(b - t, 6) + 0.0 AS l2, round(1 / (1 + exp(-(a - b))), 6) AS sigmoid, least(greatest(a, 1.0), 4.0) AS clipped FROM e""")
def log_functions(spark, d):
    v = [F.col("a"), F.col("b"), F.col("c")]
    s = K.softmax(v)
    return _r(_part(spark, d).select("p_partkey", K.logsumexp(v).alias("logsumexp"), s[0].alias("s1"), s[2].alias("s3"), K.logsoftmax(v)[1].alias("l2"), K.sigmoid(F.col("a") - F.col("b")).alias("sigmoid"), K.clip_values(F.col("a"), 1.0, 4.0).alias("clipped")), 6)


@_query(f"SELECT round(avg(-(y * ln(1 / (1 + exp(-z))) + (1 - y) * ln(1 - 1 / (1 + exp(-z))))), 6) AS loss FROM (SELECT y, s * 6 - 3 AS z FROM ({_SCORED}))")
def binary_cross_entropy(spark, d):
    return _r(_scored(spark, d).agg(K.binary_cross_entropy(F.col("s") * 6 - 3, F.col("y")).alias("loss")), 6)


@_query("SELECT min(o_totalprice) AS low, max(o_totalprice) AS high, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS argmin, arg_min(o_orderkey, (-o_totalprice, o_orderkey)) AS argmax FROM orders")
def extrema(spark, d):
    return K.extrema(_read(spark, d, "orders"), "o_totalprice", "o_orderkey")


@_query(" UNION ALL ".join(f"SELECT {q}::DOUBLE AS q, round(quantile_cont(l_extendedprice, {q}), 4) AS value FROM lineitem" for q in (0.0, 0.1, 0.5, 0.77, 1.0)))
def quantile_values(spark, d):
    df = _lines(spark, d)
    return _r(spark.createDataFrame([(q, K.quantile_value(df, "l_extendedprice", q)) for q in (0.0, 0.1, 0.5, 0.77, 1.0)], "q double, value double"))


@_query("SELECT o_orderpriority AS label, count(*) AS n FROM orders GROUP BY 1")
def class_counts(spark, d):
    return K.class_counts(_read(spark, d, "orders"), "o_orderpriority")


@_query("""WITH m AS (SELECT sum(l_quantity) AS w, sum(l_quantity * l_quantity) AS w2, sum(l_quantity * l_discount * 100) / sum(l_quantity) AS a, sum(l_quantity * l_tax * 100) / sum(l_quantity) AS b FROM lineitem),
 s AS (SELECT l_quantity AS q, l_discount * 100 - a AS x, l_tax * 100 - b AS y, w - w2 / w AS n FROM lineitem, m)
 SELECT i, j, round(v, 6) AS value FROM (SELECT 'd' AS i, 'd' AS j, sum(q * x * x) / any_value(n) AS v FROM s UNION ALL SELECT 'd', 't', sum(q * x * y) / any_value(n) FROM s UNION ALL SELECT 't', 'd', sum(q * x * y) / any_value(n) FROM s UNION ALL SELECT 't', 't', sum(q * y * y) / any_value(n) FROM s)""")
def weighted_covariance(spark, d):
    df = _lines(spark, d).select("l_quantity", (F.col("l_discount") * 100).alias("d"), (F.col("l_tax") * 100).alias("t"))
    return _r(K.weighted_covariance(df, ["d", "t"], "l_quantity", True), 6)


_ENTRIES = "SELECT l_orderkey AS i, l_linenumber::INT AS j, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2"


def _entries(spark, d) -> DataFrame:
    return _read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("i"), F.col("l_linenumber").cast("int").alias("j")).agg(F.sum("l_quantity").alias("v"))


@_query(f"SELECT i, round(sum(v * (j + 0.5)), 4) AS value FROM ({_ENTRIES}) GROUP BY i")
def sparse_matvec(spark, d):
    e = _entries(spark, d)
    return _r(K.sparse_matvec(e, F.broadcast(e.select("j").distinct().withColumn("u", F.col("j") + 0.5))))


@_query(f"SELECT j, round(sum(v * j / 2.0), 4) AS value FROM ({_ENTRIES}) GROUP BY j")
def sparse_scaled_sums(spark, d):
    e = _entries(spark, d)
    return _r(K.sparse_column_sums(K.scale_columns(e, F.broadcast(e.select("j").distinct().withColumn("s", F.col("j") / 2)))))


@_query(f"WITH s AS (SELECT j, sum(v) AS v, count(*)::DOUBLE AS u FROM ({_ENTRIES}) GROUP BY j) SELECT round(sum(v * u), 2) AS value FROM s")
def sparse_dot(spark, d):
    s = _entries(spark, d).groupBy("j").agg(F.sum("v").alias("v"), F.count("*").cast("double").alias("u"))
    return _r(K.sparse_dot(s.select("j", "v"), s.select("j", "u")), 2)


@_query(f"""WITH e AS ({_ENTRIES}), n AS (SELECT count(DISTINCT i) AS n FROM e), m AS (SELECT j, sum(v) / any_value(n) AS m FROM e, n GROUP BY j)
 SELECT r.i, m.j, round(coalesce(v, 0) - m, 4) + 0.0 AS v FROM (SELECT DISTINCT i FROM e) r CROSS JOIN m LEFT JOIN e ON e.i = r.i AND e.j = m.j""")
def center_sparse(spark, d):
    e = _entries(spark, d)
    rows = e.select("i").distinct()
    return _r(K.center_sparse(e, e.groupBy("j").agg((F.sum("v") / rows.count()).alias("m")), rows))


@_query(f"SELECT round(-avg(ln(CASE WHEN y = 1 THEN s ELSE 1 - s END)), 6) AS log_loss FROM ({_SCORED})")
def log_loss(spark, d):
    return _r(metrics.log_loss(_scored(spark, d).withColumn("r", 1 - F.col("s")), "y", ["r", "s"], [0, 1]), 6)


@_query(f"""WITH s AS ({_SCORED}), e AS (SELECT DISTINCT x FROM (SELECT unnest(quantile_cont(s, [0, 0.2, 0.4, 0.6, 0.8, 1])) AS x FROM s UNION ALL SELECT 0.0 UNION ALL SELECT 1.0)),
 b AS (SELECT y, s, (SELECT count(*) FROM e WHERE x <= s) - 1 AS k, (SELECT count(*) FROM e) - 2 AS top FROM s)
 SELECT least(k, top)::INT AS bin, round(avg(s), 6) AS mean_predicted, round(avg(y), 6) AS observed, count(*) AS n FROM b GROUP BY 1""")
def calibration_quantiles(spark, d):
    return _r(metrics.calibration_curve(_scored(spark, d), "y", "s", n_bins=5, strategy="quantile"), 6)


_PRF = f"WITH s AS ({_SCORED}), c AS (SELECT v, (SELECT count(*) FROM s WHERE y = v AND p = v)::DOUBLE AS tp, (SELECT count(*) FROM s WHERE p = v)::DOUBLE AS pp, (SELECT count(*) FROM s WHERE y = v)::DOUBLE AS ap FROM range(2) r(v))"


@_query(f"""{_PRF} SELECT 'weighted' AS average, round(sum(ap * tp / pp) / sum(ap), 6) AS precision, round(sum(tp) / sum(ap), 6) AS recall, round(sum(ap * 2 * tp / (pp + ap)) / sum(ap), 6) AS f1 FROM c
 UNION ALL SELECT 'micro', round(sum(tp) / sum(pp), 6), round(sum(tp) / sum(ap), 6), round(2 * sum(tp) / (sum(pp) + sum(ap)), 6) FROM c""")
def precision_recall_averages(spark, d):
    df = _scored(spark, d)
    parts = [metrics.precision_recall_f1(df, "y", "p", average).select(F.lit(average).alias("average"), "precision", "recall", "f1") for average in ("weighted", "micro")]
    return _r(parts[0].union(parts[1]), 6)


@_query("SELECT p_partkey, rank() OVER w + 0.0::DOUBLE AS low, (rank() OVER w + count(*) OVER (PARTITION BY p_brand, p_size) - 1)::DOUBLE AS high, dense_rank() OVER w + 0.0::DOUBLE AS dense FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size)")
def rank_ties(spark, d):
    ranks = [K.rank_values("p_size", ties, ["p_brand"]).alias(name) for ties, name in (("min", "low"), ("max", "high"), ("dense", "dense"))]
    return _read(spark, d, "part").select("p_partkey", *ranks)


@_query("SELECT p_partkey, round(p_size / (p_size + p_retailprice), 6) AS p_size, round(p_retailprice / (p_size + p_retailprice), 6) AS p_retailprice, round(p_size / greatest(p_size, p_retailprice), 6) AS m_size, round(p_retailprice / greatest(p_size, p_retailprice), 6) AS m_price FROM part")
def normalize_other_norms(spark, d):
    df = _read(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    both = df.withColumns({"m_size": F.col("p_size"), "m_price": F.col("p_retailprice")})
    both = Normalize("l1").fit(both, features=["p_size", "p_retailprice"]).transform(both)
    return _r(Normalize("max").fit(both, features=["m_size", "m_price"]).transform(both), 6)


_PAIRED = f"SELECT a.vec_id AS a, b.vec_id AS b, a.e AS x, b.e AS y FROM ({_EMB}) a JOIN ({_EMB}) b ON b.vec_id = a.vec_id + 1"


@_query(f"""SELECT a, b, round(list_distance(x, y) ** 2, 4) AS squared, round(list_sum([abs(x[i] - y[i]) FOR i IN range(1, 65)]), 4) AS manhattan, round(list_dot_product(x, y), 4) + 0.0 AS linear,
 round(exp(-0.1 * list_distance(x, y) ** 2), 4) AS rbf, round((0.5 * list_dot_product(x, y) + 1) ** 3, 4) + 0.0 AS poly FROM ({_PAIRED})""")
def distances_and_kernels(spark, d):
    df = _read(spark, d, "embeddings")
    right = df.select(F.col("vec_id").alias("b"), F.col("embedding").alias("y"))
    both = df.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x")).join(right, F.col("b") == F.col("a") + 1)
    x, y = F.col("x"), F.col("y")
    return _r(both.select("a", "b", K.squared_euclidean(x, y).alias("squared"), K.manhattan(x, y).alias("manhattan"), K.kernel_value(x, y, "linear").alias("linear"), K.kernel_value(x, y, "rbf", 0.1).alias("rbf"), K.kernel_value(x, y, "polynomial", 0.5).alias("poly")))


@_query(f"SELECT p_partkey, round(sqrt(2 * (a - 2) ** 2 + 2 * 0.5 * (a - 2) * (b - 3) + (b - 3) ** 2), 6) AS distance FROM ({_PART})")
def mahalanobis(spark, d):
    return _r(_part(spark, d).select("p_partkey", K.mahalanobis_distance([F.col("a"), F.col("b")], [2.0, 3.0], [[2.0, 0.5], [0.5, 1.0]]).alias("distance")), 6)


@_query("SELECT event_id, (CASE WHEN k < (n % 4) * (n // 4 + 1) THEN k // (n // 4 + 1) ELSE n % 4 + (k - (n % 4) * (n // 4 + 1)) // (n // 4) END + 1)::INT AS fold FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS k, count(*) OVER () AS n FROM events)")
def k_fold_in_order(spark, d):
    return selection.split(selection.KFold(4), _read(spark, d, "events"), "event_id").select("event_id", "fold")


@_query("SELECT l_orderkey, l_linenumber::INT AS l_linenumber, l_quantity, rank() OVER w + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0::DOUBLE AS rank FROM lineitem WINDOW w AS (ORDER BY l_quantity)")
def rank_whole_table(spark, d):
    df = _read(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("int").alias("l_linenumber"), "l_quantity")
    return K.rank_rows(df, "l_quantity")
