"""Distributed passes over a feature table: each returns a small sum, at any number of rows.

Partial sums are made within the tasks (map-side) and only they are moved; sums of partitions are added in partition order, so
that a rerun over the same partitions gives the same bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.core import Dataset
from orrery.errors import UnsupportedDataError

#: Up to this many columns moments are one SQL aggregate; beyond, numpy blocks within the tasks.
SQL_COLUMNS = 16
#: Rows that a method whose cost is quadratic or sequential accepts.
MAX_LOCAL_ROWS = 20_000


#: Equal rows of a pool are numbered in runs of so many.
_RUN = 1 << 16


def pool(rows: DataFrame, size: int, seed: int = 0) -> DataFrame:
    """``size`` rows drawn without replacement: the first by a hash of their content, their rank among equal rows and the seed.

    A value takes the share of the pool that it has of the rows, and the partitions don't matter. Equal rows are counted before
    they move, and numbered in runs that are dealt over the tasks.
    """
    names = rows.columns
    runs = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("_n"))
    runs = runs.withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / _RUN)))).repartition(*names, "_run")
    at = F.col("_run") * _RUN
    ranked = runs.withColumn("_rank", F.explode(F.sequence(at, F.least(at + _RUN, F.col("_n")) - 1)))
    return ranked.orderBy(F.xxhash64(F.lit(seed), *names, "_rank"), *names, "_rank").limit(size).select(*names)


def number(c: str) -> Column:
    return F.col(f"`{c}`").cast("double")


def guard(df: DataFrame, columns: Sequence[str], what: str = "the model", minimum: int = 1) -> int:
    """One aggregate that counts rows and rejects missing, NaN and infinite values."""
    bad = [F.sum((number(c).isNull() | F.isnan(number(c)) | (F.abs(number(c)) == float("inf"))).cast("long")).alias(f"b{i}") for i, c in enumerate(columns)]
    row = df.agg(F.count(F.lit(1)).alias("n"), *bad).first()
    wrong = [c for i, c in enumerate(columns) if row[f"b{i}"]]
    if wrong:
        raise UnsupportedDataError(f"{what} needs finite values; there are others in {', '.join(wrong)}")
    if row["n"] < minimum:
        raise UnsupportedDataError(f"{what} needs at least {minimum} rows; there are {row['n']}")
    return row["n"]


@dataclass(frozen=True)
class Moments:
    """Weighted sums of columns: their number, total weight, sum of squared weights, means and centred cross-products."""

    n: int
    weight: float
    weight2: float
    mean: np.ndarray
    cross: np.ndarray

    @property
    def variance(self) -> np.ndarray:
        """Population variances."""
        return np.diag(self.cross) / self.weight

    def raw(self) -> np.ndarray:
        """Cross-products that are not centred."""
        return self.cross + self.weight * np.outer(self.mean, self.mean)


def moments(df: DataFrame, columns: Sequence[str], weight: str | None = None, what: str = "the model") -> Moments:
    """Two aggregates: means with the guard for finite values, then cross-products around them."""
    w = number(weight) if weight else F.lit(1.0)
    checked = [*columns, *([weight] if weight else [])]
    bad = sum(((number(c).isNull() | F.isnan(number(c)) | (F.abs(number(c)) == float("inf"))).cast("long") for c in checked), F.lit(0))
    negative = F.sum((w < 0).cast("long")) if weight else F.lit(0)
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(bad).alias("bad"), F.sum(w).alias("w"), F.sum(w * w).alias("w2"), negative.alias("negative"), *[F.sum(w * number(c)).alias(f"s{i}") for i, c in enumerate(columns)]).first()
    if not row["n"]:
        raise UnsupportedDataError(f"{what} needs at least one row")
    if row["bad"]:
        raise UnsupportedDataError(f"{what} needs finite values")
    if row["negative"] or row["w"] <= 0:
        raise UnsupportedDataError(f"{what} needs weights that are not negative and not all zero")
    mean = np.array([row[f"s{i}"] for i in range(len(columns))]) / row["w"]
    return Moments(row["n"], row["w"], row["w2"], mean, cross_products(df, columns, mean, w))


def cross_products(df: DataFrame, columns: Sequence[str], center: np.ndarray, w: Column) -> np.ndarray:
    p = len(columns)
    out = np.zeros((p, p))
    if p <= SQL_COLUMNS:
        x = [number(c) - F.lit(float(m)) for c, m in zip(columns, center, strict=True)]
        pairs = [(i, j) for i in range(p) for j in range(i, p)]
        row = df.agg(*[F.sum(w * x[i] * x[j]).alias(f"c{i}_{j}") for i, j in pairs]).first() if pairs else None
        for i, j in pairs:
            out[i, j] = out[j, i] = row[f"c{i}_{j}"] or 0.0
        return out
    rows = df.select(*[number(c).alias(f"x{i}") for i, c in enumerate(columns)], w.alias("w"))
    return partial_sums(rows, p * p, lambda M: ((M[:, :-1] - center).T * M[:, -1]) @ (M[:, :-1] - center)).reshape(p, p)


def partial_sums(rows: DataFrame, size: int, step: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all rows of what ``step`` makes of a block of rows (a matrix of all columns)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += np.ravel(step(np.column_stack([np.asarray(c.to_numpy(zero_copy_only=False), dtype=np.float64) for c in batch.columns])))
        context = TaskContext.get()
        yield pa.RecordBatch.from_arrays([pa.array([context.partitionId() if context else 0], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["part", "total"])

    parts = rows.mapInArrow(run, "part long, total binary").collect()
    return sum((np.frombuffer(r["total"]) for r in sorted(parts, key=lambda r: r["part"])), np.zeros(size))


@contextmanager
def held(data: Dataset, target: Column | None = None) -> Iterator[DataFrame]:
    """The feature table (features, target, weight as doubles), kept for an iteration's passes and released after them."""
    columns = [number(c).alias(f"x{i}") for i, c in enumerate(data.features)]
    y = target if target is not None else number(data.targets[0]) if data.targets else F.lit(0.0)
    rows = data.df.select(*columns, y.cast("double").alias("y"), (number(data.weight) if data.weight else F.lit(1.0)).alias("w")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield rows
    finally:
        rows.unpersist()


def classes_of(data: Dataset, minimum: int = 2) -> list:
    """The sorted distinct labels."""
    found = [r[0] for r in data.df.select(F.col(f"`{data.targets[0]}`")).distinct().limit(10_001).collect()]
    if None in found:
        raise UnsupportedDataError("labels must not be missing")
    if len(found) > 10_000:
        raise UnsupportedDataError("there are more than 10000 classes")
    if len(found) < minimum:
        raise UnsupportedDataError(f"at least {minimum} classes are needed")
    return sorted(found)


def class_index(target: str, classes: Sequence) -> Column:
    """The label's place among the classes, from 0."""
    out = F.lit(None).cast("int")
    for i, c in reversed(list(enumerate(classes))):
        out = F.when(F.col(f"`{target}`") == F.lit(c), i).otherwise(out)
    return out


@dataclass(frozen=True)
class Local:
    """A small dataset on the driver, in the order of its ids."""

    X: np.ndarray
    y: list[np.ndarray]
    w: np.ndarray
    ids: np.ndarray


def collect_local(data: Dataset, what: str, max_rows: int = MAX_LOCAL_ROWS) -> Local:
    """Rows for methods that need an n by n matrix or go through rows one by one; more than max_rows is an error, not a sample."""
    order = F.col(f"`{data.id}`") if data.id else F.monotonically_increasing_id()
    rows = data.df.select(order.alias("i"), *[number(c).alias(f"x{i}") for i, c in enumerate(data.features)], *[F.col(f"`{t}`").alias(f"y{i}") for i, t in enumerate(data.targets)], (number(data.weight) if data.weight else F.lit(1.0)).alias("w"))
    table = rows.limit(max_rows + 1).toArrow()
    if table.num_rows > max_rows:
        raise UnsupportedDataError(f"{what} works on at most {max_rows} rows; use a model that is fitted in distributed passes")
    if not table.num_rows:
        raise UnsupportedDataError(f"{what} needs at least one row")
    table = table.sort_by("i")
    X = np.column_stack([np.asarray(table[f"x{i}"].to_numpy(zero_copy_only=False), dtype=np.float64) for i in range(len(data.features))]) if data.features else np.zeros((table.num_rows, 0))
    if not np.isfinite(X).all():
        raise UnsupportedDataError(f"{what} needs finite values")
    y = [np.array(table[f"y{i}"].to_pylist()) for i in range(len(data.targets))]
    return Local(X, y, np.asarray(table["w"].to_numpy(zero_copy_only=False), dtype=np.float64), np.array(table["i"].to_pylist()))


def dot(features: Sequence[str], coefficients: np.ndarray, intercept: float = 0.0) -> Column:
    """intercept + sum of coefficient times feature, as one expression."""
    out = F.lit(float(intercept))
    for c, b in zip(features, coefficients, strict=True):
        if b:
            out = out + F.lit(float(b)) * number(c)
    return out


def sigmoid(z: Column) -> Column:
    return F.when(z >= 0, 1 / (1 + F.exp(-z))).otherwise(F.exp(z) / (1 + F.exp(z)))


def first_argmax(values: Sequence[Column], labels: Sequence) -> Column:
    """The label of the greatest value; of equals the first."""
    ranked = [F.struct(v.alias("value"), F.lit(-i).alias("place"), F.lit(label).alias("label")) for i, (v, label) in enumerate(zip(values, labels, strict=True))]
    return F.array_max(F.array(*ranked))["label"]  # each value stands once in the expression
