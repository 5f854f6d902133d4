"""Composition: chains, parallel branches, selections and column maps of specifications."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.core import Context, Dataset, Fitted, FitReport, Spec
from orrery.errors import GraphValidationError, SchemaMismatchError


def _outputs(before: DataFrame, after: DataFrame, features: Sequence[str]) -> list[str]:
    """Feature columns after a transform: those that replaced or extended the given ones."""
    others = set(before.columns) - set(features)
    return [c for c in after.columns if c not in others]


@dataclass(frozen=True)
class ChainFit(Fitted):
    steps: tuple[Fitted, ...] = ()

    def _before_last(self, df: DataFrame) -> DataFrame:
        for s in self.steps[:-1]:
            df = s.transform(df)
        return df

    def transform(self, df: DataFrame) -> DataFrame:
        return self.steps[-1].transform(self._before_last(df))

    def predict(self, df: DataFrame) -> DataFrame:
        return self.steps[-1].predict(self._before_last(df))

    def predict_proba(self, df: DataFrame) -> DataFrame:
        return self.steps[-1].predict_proba(self._before_last(df))

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        for s in reversed(self.steps):
            df = s.inverse_transform(df)
        return df


@dataclass(frozen=True)
class Chain(Spec):
    """Transformers in order, and at most one predictor, which must be last. Weights reach the predictor only."""

    steps: tuple[Spec, ...] = ()

    def __init__(self, *steps: Spec, **named) -> None:
        object.__setattr__(self, "steps", tuple(named.get("steps", steps)))
        if not self.steps:
            raise GraphValidationError("a chain needs a step")
        if any(not s.transforms for s in self.steps[:-1]):
            raise GraphValidationError("only the last step of a chain may be a predictor")

    @property
    def task(self) -> str:
        return self.steps[-1].task

    @property
    def weights(self) -> bool:
        return self.steps[-1].weights

    @property
    def missing(self) -> bool:
        return self.steps[0].missing

    @property
    def sparse(self) -> bool:
        return self.steps[0].sparse

    @property
    def probabilistic(self) -> bool:
        return self.steps[-1].probabilistic

    def output_names(self, features: Sequence[str]) -> list[str] | None:
        names: list[str] | None = list(features)
        for s in self.steps:
            names = None if names is None else s.output_names(names)
        return names

    def _fit(self, data: Dataset, context: Context) -> Fitted:
        features, fitted = data.features, []
        for i, s in enumerate(self.steps):
            own = data if i == len(self.steps) - 1 else replace(data, weight=None)
            f = s.fit(own, context=context.derive("node", i + 1))
            fitted.append(f)
            if i < len(self.steps) - 1:
                after = f.transform(data.df)
                data = data.with_df(after, _outputs(data.df, after, data.features))
        return ChainFit(self, features, fitted[-1].report, tuple(fitted))


@dataclass(frozen=True)
class _SelectFit(Fitted):
    kept: tuple[str, ...] = ()

    def transform(self, df: DataFrame) -> DataFrame:
        self._need(df)
        return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in self.features or c in self.kept])


@dataclass(frozen=True)
class Select(Spec):
    """Keeps some of the features, by name or by place from 1."""

    columns: tuple = ()

    def __init__(self, *columns, **named) -> None:
        object.__setattr__(self, "columns", tuple(named.get("columns", columns)))

    def output_names(self, features: Sequence[str]) -> list[str]:
        names = [features[c - 1] if isinstance(c, int) and 0 < c <= len(features) else c for c in self.columns]
        absent = [c for c in names if c not in features]
        if absent:
            raise SchemaMismatchError(f"columns are absent: {absent}")
        return names

    def _fit(self, data: Dataset, context: Context) -> Fitted:
        return _SelectFit(self, data.features, FitReport(0, len(data.features)), tuple(self.output_names(data.features)))


@dataclass(frozen=True)
class _BranchFit(Fitted):
    branches: tuple = ()  # (prefix, columns, fitted)

    def transform(self, df: DataFrame) -> DataFrame:
        """Every branch is a projection of the same rows, so all of them are one projection: no join."""
        self._need(df)
        kept = [c for c in df.columns if c not in self.features]
        inputs = {c: f"_in_{i}" for i, c in enumerate(self.features)}
        out = df.select(*[F.col(f"`{c}`") for c in kept], *[F.col(f"`{c}`").alias(n) for c, n in inputs.items()])
        names: list[str] = []
        for prefix, columns, fitted in self.branches:
            have = out.columns
            step = fitted.transform(out.withColumns({c: F.col(inputs[c]) for c in columns}))
            new = [c for c in step.columns if c not in have]
            renamed = {c: f"{prefix}{c}" for c in new}
            out = step.select(*[F.col(f"`{c}`") for c in have], *[F.col(f"`{c}`").alias(f"_out_{n}") for c, n in renamed.items()])
            names += renamed.values()
        return out.select(*[F.col(f"`{c}`") for c in kept], *[F.col(f"`_out_{n}`").alias(n) for n in names])


@dataclass(frozen=True)
class Parallel(Spec):
    """The same input to several transformers; their outputs side by side, named ``branch<i>_<column>``."""

    branches: tuple[Spec, ...] = ()

    def __init__(self, *branches: Spec, **named) -> None:
        object.__setattr__(self, "branches", tuple(named.get("branches", branches)))
        if len(self.branches) < 1 or any(not b.transforms for b in self.branches):
            raise GraphValidationError("branches must be transformers")

    def output_names(self, features: Sequence[str]) -> list[str] | None:
        parts = [b.output_names(features) for b in self.branches]
        return None if any(p is None for p in parts) else [f"branch{i + 1}_{c}" for i, p in enumerate(parts) for c in p]

    def _fit(self, data: Dataset, context: Context) -> Fitted:
        fitted = [b.fit(replace(data, weight=None), context=context.derive("branch", i + 1)) for i, b in enumerate(self.branches)]
        return _BranchFit(self, data.features, FitReport(fitted[0].report.observations, len(data.features)), tuple((f"branch{i + 1}_", data.features, f) for i, f in enumerate(fitted)))


@dataclass(frozen=True)
class Concatenate(Spec):
    """The outputs of parallel branches as one table; they already stand side by side, so nothing is moved."""

    def _fit(self, data: Dataset, context: Context) -> Fitted:
        return _SelectFit(self, data.features, FitReport(0, len(data.features)), data.features)


@dataclass(frozen=True)
class ColumnMap(Spec):
    """Pairs of columns and transformers; outputs in the order of the pairs."""

    pairs: tuple = ()

    def __init__(self, *pairs, **named) -> None:
        made = tuple(((c,) if isinstance(c, str) else tuple(c), s) for c, s in named.get("pairs", pairs))
        object.__setattr__(self, "pairs", made)
        if not made or any(not s.transforms for _, s in made):
            raise GraphValidationError("a column map needs transformers")

    def output_names(self, features: Sequence[str]) -> list[str] | None:
        parts = [s.output_names(c) for c, s in self.pairs]
        return None if any(p is None for p in parts) else [n for p in parts for n in p]

    def _fit(self, data: Dataset, context: Context) -> Fitted:
        out = []
        for i, (columns, s) in enumerate(self.pairs):
            out.append(("", columns, s.fit(replace(data, features=columns, weight=None), context=context.derive("column", i + 1))))
        return _BranchFit(self, data.features, FitReport(out[0][2].report.observations, len(data.features)), tuple(out))
