"""Feature transformers whose fitted state turns into column expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations, combinations_with_replacement

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.core import Context, Dataset, Fitted, FitReport, Spec, check, logical_type
from orrery.errors import UnsupportedDataError
from orrery.plans.ordering import quantiles
from orrery.plans.passes import guard, moments, number


@dataclass(frozen=True)
class Affine(Fitted):
    """Each feature becomes (x - shift) / scale, times ``span`` plus ``low``; optionally clipped."""

    shift: np.ndarray
    scale: np.ndarray
    span: float = 1.0
    low: float = 0.0
    clip: bool = False

    def expressions(self) -> dict[str, Column]:
        out = {}
        for c, m, s in zip(self.features, self.shift, self.scale, strict=True):
            x = (number(c) - F.lit(float(m))) / F.lit(float(s))
            if self.span != 1.0 or self.low:
                x = F.lit(float(self.low)) + F.lit(float(self.span)) * x
            out[c] = F.least(F.greatest(x, F.lit(float(self.low))), F.lit(float(self.low + self.span))) if self.clip else x
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        self._need(df)
        return df.withColumns(self.expressions())

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        self._need(df)
        back = {c: ((number(c) - self.low) / self.span) * F.lit(float(s)) + F.lit(float(m)) for c, m, s in zip(self.features, self.shift, self.scale, strict=True)}
        return df.withColumns(back)


@dataclass(frozen=True)
class MergedAffine(Affine):
    """An Affine that remembers count, means and sums of squared deviations, so that batches can be merged."""

    count: float = 0.0
    mean: np.ndarray | None = None
    m2: np.ndarray | None = None


@dataclass(frozen=True)
class Standardize(Spec):
    """(x - mean) / population standard deviation; constant columns are divided by 1."""

    center: bool = True
    scale: bool = True
    partial = True
    sparse = True

    def _made(self, features: Sequence[str], n: float, mean: np.ndarray, m2: np.ndarray, context: Context) -> MergedAffine:
        deviation = np.sqrt(np.maximum(m2 / n, 0))
        deviation[deviation == 0] = 1.0
        p = len(features)
        report = FitReport(int(n), p, details={"center": self.center, "scale": self.scale}, root_seed=context.root_seed, stream_id=context.stream_id)
        return MergedAffine(self, tuple(features), report, mean if self.center else np.zeros(p), deviation if self.scale else np.ones(p), count=n, mean=mean, m2=m2)

    def _fit(self, data: Dataset, context: Context) -> Fitted:
        x = [number(c) for c in data.features]
        n = guard(data.df, data.features, "Standardize")
        row = data.df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(x)], *[F.var_pop(c).alias(f"v{i}") for i, c in enumerate(x)]).first()
        p = len(x)
        return self._made(data.features, float(n), np.array([row[f"m{i}"] for i in range(p)]), n * np.array([row[f"v{i}"] for i in range(p)]), context)

    def partial_fit(self, fitted: Fitted | None, data: Dataset, context: Context | None = None) -> Fitted:
        new = self._fit(data, context or Context())
        if fitted is None:
            return new
        n = fitted.count + new.count
        delta = new.mean - fitted.mean
        mean = fitted.mean + delta * new.count / n
        m2 = fitted.m2 + new.m2 + delta**2 * fitted.count * new.count / n
        return self._made(fitted.features, n, mean, m2, context or Context())


@dataclass(frozen=True)
class MinMaxScale(Spec):
    """Scales each column to feature_range; constant columns go to its lower end."""

    feature_range: tuple[float, float] = (0.0, 1.0)
    clip: bool = False

    def __post_init__(self) -> None:
        check(self.feature_range[0] < self.feature_range[1], "feature_range must increase")

    def _fit(self, data: Dataset, context: Context) -> Fitted:
        n = guard(data.df, data.features, "MinMaxScale")
        row = data.df.agg(*[f(number(c)).alias(f"{k}{i}") for i, c in enumerate(data.features) for k, f in (("a", F.min), ("b", F.max))]).first()
        low = np.array([row[f"a{i}"] for i in range(len(data.features))])
        span = np.array([row[f"b{i}"] for i in range(len(data.features))]) - low
        span[span == 0] = 1.0
        a, b = self.feature_range
        return Affine(self, data.features, FitReport(n, len(low)), low, span, b - a, a, self.clip)


@dataclass(frozen=True)
class RobustScale(Spec):
    """(x - median) / (difference of two linearly interpolated quantiles); a zero difference becomes 1."""

    center: bool = True
    scale: bool = True
    quantile_range: tuple[float, float] = (0.25, 0.75)

    def __post_init__(self) -> None:
        check(0 <= self.quantile_range[0] < self.quantile_range[1] <= 1, "quantile_range must increase within 0 and 1")

    def _fit(self, data: Dataset, context: Context) -> Fitted:
        n = guard(data.df, data.features, "RobustScale")
        lo, hi = self.quantile_range
        q = np.array([quantiles(data.df, number(c), [lo, 0.5, hi]) for c in data.features])
        span = q[:, 2] - q[:, 0]
        span[span == 0] = 1.0
        p = len(span)
        return Affine(self, data.features, FitReport(n, p), q[:, 1] if self.center else np.zeros(p), span if self.scale else np.ones(p))


@dataclass(frozen=True)
class _RowWise(Fitted):
    def transform(self, df: DataFrame) -> DataFrame:
        self._need(df)
        return df.withColumns(self.spec.row_expressions(self.features))


@dataclass(frozen=True)
class Normalize(Spec):
    """Divides each row by its l1, l2 or max norm; zero rows stay."""

    norm: str = "l2"
    sparse = True

    def __post_init__(self) -> None:
        check(self.norm in ("l1", "l2", "max"), "norm must be l1, l2 or max")

    def row_expressions(self, features: Sequence[str]) -> dict[str, Column]:
        x = [number(c) for c in features]
        if self.norm == "l2":
            size = F.sqrt(sum((c * c for c in x), F.lit(0.0)))
        elif self.norm == "l1":
            size = sum((F.abs(c) for c in x), F.lit(0.0))
        else:
            size = F.greatest(F.lit(0.0), *[F.abs(c) for c in x])
        return {c: F.when(size > 0, v / size).otherwise(v) for c, v in zip(features, x, strict=True)}

    def _fit(self, data: Dataset, context: Context) -> Fitted:
        return _RowWise(self, data.features, FitReport(guard(data.df, data.features, "Normalize"), len(data.features)))


@dataclass(frozen=True)
class _Appended(Fitted):
    """A transform whose columns replace the features."""

    names: tuple[str, ...] = ()

    def transform(self, df: DataFrame) -> DataFrame:
        self._need(df)
        kept = [F.col(f"`{c}`") for c in df.columns if c not in self.features]
        return df.select(*kept, *[e.alias(n) for n, e in self.expressions().items()])

    def expressions(self) -> dict[str, Column]:
        raise NotImplementedError


@dataclass(frozen=True)
class _Polynomial(_Appended):
    terms: tuple[tuple[int, ...], ...] = ()

    def expressions(self) -> dict[str, Column]:
        out = {}
        for name, term in zip(self.names, self.terms, strict=True):
            e = F.lit(1.0)
            for k, j in enumerate(term):
                e = number(self.features[j]) if k == 0 else e * number(self.features[j])
            out[name] = e
        return out


@dataclass(frozen=True)
class PolynomialFeatures(Spec):
    """Monomials by total degree, then by feature index; with a bias column first unless told otherwise."""

    degree: int = 2
    include_bias: bool = True
    interaction_only: bool = False

    def __post_init__(self) -> None:
        check(1 <= self.degree <= 32, "degree must be 1 to 32")

    def terms(self, p: int) -> list[tuple[int, ...]]:
        choose = combinations if self.interaction_only else combinations_with_replacement
        count = sum(math.comb(p, d) if self.interaction_only else math.comb(p + d - 1, d) for d in range(1, self.degree + 1))
        check(count + self.include_bias <= 100_000, "there would be more than 100000 columns")
        return [()] * self.include_bias + [t for d in range(1, self.degree + 1) for t in choose(range(p), d)]

    def output_names(self, features: Sequence[str]) -> list[str]:
        n = len(self.terms(len(features))) - self.include_bias
        return ["bias"] * self.include_bias + [f"polynomial{i + 1}" for i in range(n)]

    def _fit(self, data: Dataset, context: Context) -> Fitted:
        n = guard(data.df, data.features, "PolynomialFeatures")
        return _Polynomial(self, data.features, FitReport(n, len(data.features)), tuple(self.output_names(data.features)), tuple(self.terms(len(data.features))))


@dataclass(frozen=True)
class _Imputed(Fitted):
    fills: tuple = ()

    def transform(self, df: DataFrame) -> DataFrame:
        self._need(df)
        return df.withColumns({c: F.coalesce(F.col(f"`{c}`"), F.lit(v)) for c, v in zip(self.features, self.fills, strict=True)})


@dataclass(frozen=True)
class Impute(Spec):
    """Fills missing values: mean, median, most_frequent (of equals the one seen first), constant; auto: mean or most_frequent."""

    strategy: str = "auto"
    fill_value: object = None
    missing = True

    def __post_init__(self) -> None:
        check(self.strategy in ("auto", "mean", "median", "most_frequent", "constant"), "unknown strategy")
        check(self.strategy != "constant" or self.fill_value is not None, "a constant needs fill_value")

    def _fit(self, data: Dataset, context: Context) -> Fitted:
        kinds = {f.name: logical_type(f.dataType) for f in data.df.schema.fields}
        df, fills, sums, plain = data.df, {}, {}, []
        for c in data.features:
            how = self.strategy if self.strategy != "auto" else "mean" if kinds[c] == "continuous" else "most_frequent"
            if how in ("mean", "median") and kinds[c] != "continuous":
                raise UnsupportedDataError(f"{how} needs numbers; {c} has none")
            if how == "constant":
                fills[c] = self.fill_value
            elif how == "most_frequent":
                plain.append(c)
            elif how == "mean":
                sums[c] = F.avg(number(c))
            else:
                fills[c] = quantiles(df, number(c), [0.5])[0]
        row = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(F.col(f"`{c}`")).alias(f"have{i}") for i, c in enumerate(data.features)], *[e.alias(f"fill{i}") for i, e in enumerate(sums.values())]).first()
        empty = [c for i, c in enumerate(data.features) if not row[f"have{i}"] and (c not in fills or self.strategy == "median")]
        if empty:
            raise UnsupportedDataError(f"all values are missing in {', '.join(empty)}")
        fills |= {c: row[f"fill{i}"] for i, c in enumerate(sums)}
        order = F.col(f"`{data.id}`") if data.id else F.monotonically_increasing_id()
        for c in plain:
            counts = df.where(F.col(f"`{c}`").isNotNull()).groupBy(F.col(f"`{c}`").alias("v")).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
            fills[c] = counts.orderBy(F.desc("n"), "first").first()["v"]
        return _Imputed(self, data.features, FitReport(row["n"], len(data.features)), tuple(fills[c] for c in data.features))


@dataclass(frozen=True)
class _Encoded(_Appended):
    levels: dict | None = None

    def expressions(self) -> dict[str, Column]:
        out: dict[str, Column] = {}
        for c in self.features:
            x, levels = F.col(f"`{c}`"), self.levels.get(c)
            if levels is None:
                out[c] = number(c)
                continue
            known = x.isin([v for v in levels])
            for v in levels:
                one = F.when(x == F.lit(v), 1.0).otherwise(0.0)
                if self.spec.handle_unknown == "error":
                    one = F.when(F.coalesce(known, F.lit(False)), one).otherwise(F.raise_error(F.lit(f"unknown level in {c}")).cast("double"))
                out[f"{c}__{v}"] = one
        return out


@dataclass(frozen=True)
class OneHotEncode(Spec):
    """A 0/1 column for each level, sorted, named ``<column>__<level>``; numbers pass at their place."""

    handle_unknown: str = "error"
    passthrough_numeric: bool = True
    max_levels: int = 10_000

    def __post_init__(self) -> None:
        check(self.handle_unknown in ("error", "ignore"), "handle_unknown must be error or ignore")

    def output_names(self, features: Sequence[str]) -> None:
        return None

    def _fit(self, data: Dataset, context: Context) -> Fitted:
        kinds = {f.name: logical_type(f.dataType) for f in data.df.schema.fields}
        encoded = [c for c in data.features if not (self.passthrough_numeric and kinds[c] == "continuous")]
        row = data.df.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(f"`{c}`").isNull().cast("long")).alias(f"m{i}") for i, c in enumerate(encoded)], *[F.approx_count_distinct(F.col(f"`{c}`")).alias(f"d{i}") for i, c in enumerate(encoded)]).first()
        for i, c in enumerate(encoded):
            if row[f"m{i}"]:
                raise UnsupportedDataError(f"values are missing in {c}; impute first")
            if row[f"d{i}"] > self.max_levels:
                raise UnsupportedDataError(f"{c} has more than {self.max_levels} levels")
        levels = {c: sorted(r[0] for r in data.df.select(F.col(f"`{c}`")).distinct().collect()) for c in encoded}
        fitted = _Encoded(self, data.features, FitReport(row["n"], len(data.features)), (), levels)
        return _Encoded(self, data.features, fitted.report, tuple(fitted.expressions()), levels)


def with_moments(data: Dataset, what: str):
    """Moments of features and targets together."""
    return moments(data.df, [*data.features, *data.targets], data.weight, what)
