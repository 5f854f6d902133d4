"""Scalar, aggregate and selection functions as column expressions and small DataFrames."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.plans.ordering import quantiles, row_numbers, running_sums
from orrery.plans.passes import moments


def _fold(a: Column, b: Column, step) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: step(x.cast("double"), y.cast("double"))), F.lit(0.0), lambda s, v: s + v)


def vector_dot(a: Column, b: Column) -> Column:
    """Dot product of two arrays."""
    return _fold(a, b, lambda x, y: x * y)


def squared_euclidean(a: Column, b: Column) -> Column:
    return _fold(a, b, lambda x, y: (x - y) * (x - y))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(squared_euclidean(a, b))


def manhattan(a: Column, b: Column) -> Column:
    return _fold(a, b, lambda x, y: F.abs(x - y))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; a zero vector is an error."""
    size = F.sqrt(vector_dot(a, a)) * F.sqrt(vector_dot(b, b))
    return F.when(size > 0, 1 - vector_dot(a, b) / size).otherwise(F.raise_error(F.lit("cosine distance of a zero vector")).cast("double"))


METRICS = {"euclidean": euclidean, "squared_euclidean": squared_euclidean, "manhattan": manhattan, "cosine": cosine_distance}


def mahalanobis_distance(x: Sequence[Column], center: Sequence[float], precision: Sequence[Sequence[float]]) -> Column:
    d = [c - F.lit(float(m)) for c, m in zip(x, center, strict=True)]
    return F.sqrt(sum((F.lit(float(precision[i][j])) * d[i] * d[j] for i in range(len(d)) for j in range(len(d))), F.lit(0.0)))


def kernel_value(a: Column, b: Column, kernel: str = "rbf", gamma: float = 1.0, degree: int = 3, coef0: float = 1.0) -> Column:
    if kernel == "linear":
        return vector_dot(a, b)
    return F.exp(-gamma * squared_euclidean(a, b)) if kernel == "rbf" else F.pow(gamma * vector_dot(a, b) + coef0, F.lit(degree))


def logsumexp(values: Sequence[Column]) -> Column:
    top = F.greatest(*values)
    return top + F.log(sum((F.exp(v - top) for v in values), F.lit(0.0)))


def softmax(values: Sequence[Column]) -> list[Column]:
    top = F.greatest(*values)
    e = [F.exp(v - top) for v in values]
    return [v / sum(e, F.lit(0.0)) for v in e]


def logsoftmax(values: Sequence[Column]) -> list[Column]:
    total = logsumexp(values)
    return [v - total for v in values]


def sigmoid(z: Column) -> Column:
    return F.when(z >= 0, 1 / (1 + F.exp(-z))).otherwise(F.exp(z) / (1 + F.exp(z)))


def clip_values(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def _mean(e: Column, w: Column | None) -> Column:
    return F.avg(e) if w is None else F.sum(w * e) / F.sum(w)


def binary_cross_entropy(z: Column, y: Column, w: Column | None = None) -> Column:
    return _mean(F.greatest(z, F.lit(0.0)) - z * y + F.log1p(F.exp(-F.abs(z))), w)


def mean_squared_error(y: Column, p: Column, w: Column | None = None) -> Column:
    return _mean((p - y) * (p - y), w)


def root_mean_squared_error(y: Column, p: Column, w: Column | None = None) -> Column:
    return F.sqrt(mean_squared_error(y, p, w))


def mean_absolute_error(y: Column, p: Column, w: Column | None = None) -> Column:
    return _mean(F.abs(p - y), w)


def huber_loss(y: Column, p: Column, delta: float = 1.35, w: Column | None = None) -> Column:
    d = F.abs(p - y)
    return _mean(F.when(d <= delta, 0.5 * d * d).otherwise(delta * (d - 0.5 * delta)), w)


def quantile_loss(y: Column, p: Column, quantile: float = 0.5, w: Column | None = None) -> Column:
    d = y - p
    return _mean(F.when(d >= 0, quantile * d).otherwise((quantile - 1) * d), w)


def reduction_sum(x: Column) -> Column:
    return F.sum(x.cast("double"))


def reduction_mean(x: Column) -> Column:
    return F.avg(x)


def reduction_variance(x: Column, corrected: bool = True) -> Column:
    return F.var_samp(x) if corrected else F.var_pop(x)


def weighted_sum(x: Column, w: Column) -> Column:
    return F.sum(w * x)


def weighted_mean(x: Column, w: Column) -> Column:
    return F.sum(w * x) / F.sum(w)


def weighted_variance(x: Column, w: Column, corrected: bool = False) -> Column:
    """Around the weighted mean; corrected: by the reliability of the weights."""
    m2 = F.sum(w * x * x) - F.sum(w * x) * F.sum(w * x) / F.sum(w)
    return m2 / (F.sum(w) - (F.sum(w * w) / F.sum(w) if corrected else F.lit(0.0)))


def stable_norm(df: DataFrame, c: str) -> DataFrame:
    """Euclidean norm without overflow: two aggregates."""
    top = df.agg(F.max(F.abs(F.col(c))).alias("m")).first()["m"]
    if not top:
        return df.agg(F.lit(0.0).alias("norm"))
    return df.agg((F.lit(float(top)) * F.sqrt(F.sum(F.pow(F.col(c) / F.lit(float(top)), F.lit(2))))).alias("norm"))


def stable_sum(df: DataFrame, c: str) -> DataFrame:
    """Sum that loses next to nothing to cancellation, whatever the order of the rows: two aggregates.

    Each value is split twice at a power of two above what the sum can reach. The upper parts are multiples of one unit, so their
    sums are exact in any order; only the rests round. Nulls are left out; an empty column sums to 0.
    """
    x = F.col(c).cast("double")
    n, top = df.agg(F.count(x), F.max(F.abs(x))).first()
    if not top or not math.isfinite(top):
        return df.agg(F.coalesce(F.sum(x), F.lit(0.0)).alias("sum"))
    room = 2.0 ** math.ceil(math.log2(n + 2))
    first = room * 2.0 ** math.ceil(math.log2(top))
    second = first * 2.0**-53 * room
    if not math.isfinite(first * 2):
        raise OverflowError(f"the sum of {c} may leave the range of doubles")
    upper = (x + F.lit(first)) - F.lit(first)
    middle = ((x - upper) + F.lit(second)) - F.lit(second)
    return df.agg((F.sum(upper) + (F.sum(middle) + F.sum((x - upper) - middle))).alias("sum"))


def argbest(df: DataFrame, value: str, id: str, largest: bool = True) -> DataFrame:
    """The id of the greatest (least) value; of equals the first id."""
    e = F.min_by(F.col(id), F.struct(-F.col(value) if largest else F.col(value), F.col(id)))
    return df.agg(e.alias("id"))


def extrema(df: DataFrame, value: str, id: str) -> DataFrame:
    """(low, high, argmin, argmax) in one aggregate; of equals the first id. Nulls are left out."""
    x, key = F.col(value), F.when(F.col(value).isNotNull(), F.col(id))
    least = lambda e: F.min_by(key, F.when(x.isNotNull(), F.struct(e, F.col(id))))
    return df.agg(F.min(x).alias("low"), F.max(x).alias("high"), least(x).alias("argmin"), least(-x).alias("argmax"))


def quantile_value(df: DataFrame, value: str, q: float) -> float | None:
    """Exact quantile by linear interpolation; None without values."""
    if not 0 <= q <= 1:
        raise ValueError("q must lie within 0 and 1")
    return quantiles(df, F.col(value), [q])[0]


def topk(df: DataFrame, value: str, id: str, k: int, largest: bool = True) -> DataFrame:
    return df.orderBy(F.desc(value) if largest else F.asc(value), F.col(id)).limit(k)


def rank_values(value: str, ties: str = "average", partition: Sequence[str] = ()) -> Column:
    """Ranks from 1; ties: average, min, max or dense. A partition keeps one task from holding all rows."""
    w = Window.partitionBy(*partition).orderBy(value)
    same = F.count(F.lit(1)).over(Window.partitionBy(*partition, value))
    if ties == "dense":
        return F.dense_rank().over(w).cast("double")
    low = F.rank().over(w)
    return (low if ties == "min" else low + same - 1 if ties == "max" else low + (same - 1) / 2).cast("double")


def rank_rows(df: DataFrame, value: str, ties: str = "average") -> DataFrame:
    """The rows with ``rank`` over the whole table: distinct values are counted and ordered by ranges, and joined back."""
    counted, _ = row_numbers(df.groupBy(F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c")), F.asc("_v"))
    sums, _ = running_sums(counted.withColumn("_e", F.col("_c").cast("double")), F.asc("_v"), ["_e"])
    low = F.col("_e") - F.col("_c") + 1
    rank = {"dense": F.col("_r") + 1.0, "min": low, "max": F.col("_e"), "average": (low + F.col("_e")) / 2}[ties]
    return df.join(sums.select("_v", rank.alias("rank")), F.col(value).eqNullSafe(F.col("_v"))).drop("_v")


def contingency(df: DataFrame, row: str, column: str) -> DataFrame:
    """(row, column, n) for all pairs of levels, zeros included. Levels are few by nature; the grid is built from them."""
    grid = df.select(F.col(row).alias("row")).distinct().crossJoin(df.select(F.col(column).alias("column")).distinct())
    counts = df.groupBy(F.col(row).alias("row"), F.col(column).alias("column")).agg(F.count(F.lit(1)).alias("n"))
    return grid.join(counts, ["row", "column"], "left").select("row", "column", F.coalesce("n", F.lit(0)).alias("n"))


def class_counts(df: DataFrame, label: str) -> DataFrame:
    """(label, n) of the labels that occur; null is one of them."""
    return df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def histogram_counts(df: DataFrame, value: str, edges: Sequence[float]) -> DataFrame:
    """(bin, n): half-open bins, the last one closed; empty bins are listed, values outside are not counted."""
    x, bin_ = F.col(value), F.lit(None).cast("int")
    for i in range(len(edges) - 2, -1, -1):
        last = i == len(edges) - 2
        bin_ = F.when((x >= edges[i]) & ((x <= edges[i + 1]) if last else (x < edges[i + 1])), i).otherwise(bin_)
    counts = df.select(bin_.alias("bin")).where("bin is not null").groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    bins = df.sparkSession.range(len(edges) - 1).select(F.col("id").cast("int").alias("bin"))
    return bins.join(F.broadcast(counts), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def sparse_matvec(entries: DataFrame, vector: DataFrame) -> DataFrame:
    """(i, j, v) rows times (j, u) rows -> (i, value)."""
    return entries.join(vector, "j").groupBy("i").agg(F.sum(F.col("v") * F.col("u")).alias("value"))


def scale_columns(entries: DataFrame, scales: DataFrame) -> DataFrame:
    """(i, j, v) rows with v times the column's scale, from (j, s) rows; a column without one is an error."""
    scale = F.coalesce("s", F.raise_error(F.lit("a column has no scale")).cast("double"))
    return entries.join(scales, "j", "left").select("i", "j", (F.col("v") * scale).alias("v"))


def sparse_dot(a: DataFrame, b: DataFrame) -> DataFrame:
    """(j, v) rows times (j, u) rows -> value."""
    return a.join(b, "j").agg(F.coalesce(F.sum(F.col("v") * F.col("u")), F.lit(0.0)).alias("value"))


def center_sparse(entries: DataFrame, means: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """(i, j, v) rows less their columns' means, from (j, m) rows of all columns.

    Means other than zero fill the matrix: that needs the row numbers (i), which allow it; without them it is an error.
    """
    if not means.where("m <> 0").limit(1).count():
        return entries
    if rows is None:
        raise ValueError("centring fills the matrix; give its row numbers to allow it")
    dense = rows.select("i").crossJoin(F.broadcast(means))  # the filled matrix itself: every row has every column
    return dense.join(entries, ["i", "j"], "left").select("i", "j", (F.coalesce("v", F.lit(0.0)) - F.col("m")).alias("v"))


def sparse_column_sums(entries: DataFrame) -> DataFrame:
    return entries.groupBy("j").agg(F.sum("v").alias("value"))


def covariance_matrix(df: DataFrame, columns: Sequence[str], corrected: bool = True) -> DataFrame:
    """(i, j, value) rows of the covariance matrix, by one aggregate."""
    f = F.covar_samp if corrected else F.covar_pop
    pairs = [(a, b) for a in columns for b in columns]
    row = df.agg(*[f(F.col(a), F.col(b)).alias(f"c{k}") for k, (a, b) in enumerate(pairs)])
    cells = F.array(*[F.struct(F.lit(a).alias("i"), F.lit(b).alias("j"), F.col(f"c{k}").alias("value")) for k, (a, b) in enumerate(pairs)])
    return row.select(F.explode(cells).alias("c")).select("c.*")


def weighted_covariance(df: DataFrame, columns: Sequence[str], weight: str, corrected: bool = False) -> DataFrame:
    """(i, j, value) around the weighted means, by two aggregates; corrected: by the reliability of the weights."""
    m = moments(df, columns, weight, "weighted_covariance")
    value = m.cross / (m.weight - (m.weight2 / m.weight if corrected else 0.0))
    return df.sparkSession.createDataFrame([(a, b, float(value[i, j])) for i, a in enumerate(columns) for j, b in enumerate(columns)], "i string, j string, value double")
