"""Contracts: specifications, fitted models, datasets, schemas, contexts and reports.

A *specification* is an immutable dataclass of hyper-parameters. ``fit`` gives a *fitted* object with separate state. A fitted
object adds columns to a DataFrame lazily: as expressions where the model is one, else as one Arrow-batched numpy step.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, fields, replace
from typing import Any, ClassVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.errors import InvalidHyperparameterError, SchemaMismatchError, UnsupportedDataError

# --- schema ----------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class ColumnSchema:
    name: str
    logical_type: str = "continuous"  # or categorical
    role: str = "feature"
    levels: tuple | None = None
    allows_missing: bool = False
    generated_by: str | None = None


@dataclass(frozen=True)
class Schema:
    columns: tuple[ColumnSchema, ...]
    target: ColumnSchema | None = None

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    def __repr__(self) -> str:
        target = f" -> {self.target.name}" if self.target else ""
        return f"Schema({', '.join(f'{c.name}: {c.logical_type}' for c in self.columns)}{target})"


def logical_type(kind: T.DataType) -> str:
    """Numbers and booleans are continuous; everything else, dates included, is categorical."""
    return "continuous" if isinstance(kind, (T.NumericType, T.BooleanType)) else "categorical"


def infer_schema(df: DataFrame, features: Sequence[str], target: str | None = None) -> Schema:
    kinds = {f.name: f for f in df.schema.fields}
    missing = [c for c in [*features, *([target] if target else [])] if c not in kinds]
    if missing:
        raise SchemaMismatchError(f"columns are absent: {', '.join(missing)}")
    own = tuple(ColumnSchema(c, logical_type(kinds[c].dataType), allows_missing=kinds[c].nullable) for c in features)
    return Schema(own, ColumnSchema(target, logical_type(kinds[target].dataType), "target") if target else None)


# --- context and report ----------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Context:
    """Seed, limits and tolerance of a fit. ``derive`` names an independent stream of random numbers."""

    root_seed: int = 0
    stream_id: str = "root"
    max_iterations: int | None = None
    tolerance: float | None = None

    def derive(self, *parts: Any) -> Context:
        return replace(self, stream_id="/".join([self.stream_id, *map(str, parts)]))

    @property
    def seed(self) -> int:
        return int.from_bytes(hashlib.sha256(f"{self.root_seed}|{self.stream_id}".encode()).digest()[:8], "big")

    def rng(self, *parts: Any) -> np.random.Generator:
        return np.random.Generator(np.random.PCG64((self.derive(*parts) if parts else self).seed))

    def iterations(self, default: int) -> int:
        return self.max_iterations or default

    def tol(self, default: float) -> float:
        return default if self.tolerance is None else self.tolerance


@dataclass(frozen=True)
class FitReport:
    """What a fit did."""

    observations: int
    features: int
    status: str = "success"
    backend: str = "spark"
    warnings: tuple[str, ...] = ()
    details: dict = field(default_factory=dict)
    root_seed: int = 0
    stream_id: str = "root"
    deterministic: bool = True

    def to_df(self, spark) -> DataFrame:
        rows = [(f.name, str(getattr(self, f.name))) for f in fields(self) if f.name != "details"] + [(f"details.{k}", str(v)) for k, v in self.details.items()]
        return spark.createDataFrame(rows, "field string, value string")


# --- data ------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Dataset:
    """A DataFrame with the roles of its columns. Row positions are ranks of ``id``."""

    df: DataFrame
    features: tuple[str, ...]
    target: str | tuple[str, ...] | None = None
    weight: str | None = None
    id: str | None = None

    def __post_init__(self) -> None:
        object.__setattr__(self, "features", tuple([self.features] if isinstance(self.features, str) else self.features))
        if isinstance(self.target, list):
            object.__setattr__(self, "target", tuple(self.target))
        have = set(self.df.columns)
        need = [*self.features, *self.targets, *([self.weight] if self.weight else []), *([self.id] if self.id else [])]
        absent = [c for c in need if c not in have]
        if absent:
            raise SchemaMismatchError(f"columns are absent: {', '.join(absent)}")

    @property
    def targets(self) -> tuple[str, ...]:
        return () if self.target is None else self.target if isinstance(self.target, tuple) else (self.target,)

    @property
    def schema(self) -> Schema:
        return infer_schema(self.df, self.features, self.targets[0] if self.targets else None)

    def with_df(self, df: DataFrame, features: Sequence[str] | None = None) -> Dataset:
        return replace(self, df=df, features=tuple(features) if features is not None else self.features)


# --- specifications and fitted models --------------------------------------------------------------------------------

REGISTRY: dict[str, type] = {}


@dataclass(frozen=True)
class Capabilities:
    task: str
    sparse: bool = False
    missing: bool = False
    weights: bool = False
    partial_fit: bool = False
    probabilistic: bool = False


class Spec:
    """Base of specifications. ``_fit`` gets a validated Dataset and a Context."""

    task: ClassVar[str] = "transform"
    sparse: ClassVar[bool] = False
    missing: ClassVar[bool] = False
    weights: ClassVar[bool] = False
    partial: ClassVar[bool] = False
    probabilistic: ClassVar[bool] = False

    def __init_subclass__(cls, **kwargs: Any) -> None:
        super().__init_subclass__(**kwargs)
        if not cls.__name__.startswith("_"):
            REGISTRY[cls.__name__] = cls

    @property
    def supervised(self) -> bool:
        return self.task in ("regression", "classification")

    @property
    def transforms(self) -> bool:
        return self.task == "transform"

    def capabilities(self) -> Capabilities:
        return Capabilities(self.task, self.sparse, self.missing, self.weights, self.partial, self.probabilistic)

    def output_names(self, features: Sequence[str]) -> list[str] | None:
        """Names of the columns that a transform gives, if they are known before the fit."""
        return list(features) if self.task == "transform" else {"regression": ["prediction"], "classification": ["prediction"], "clustering": ["cluster"], "anomaly": ["anomaly"]}.get(self.task)

    def fit(self, data: Dataset | DataFrame, features: Sequence[str] | None = None, target: str | None = None, weight: str | None = None, id: str | None = None, context: Context | None = None) -> Fitted:
        if not isinstance(data, Dataset):
            used = {target, weight, id}
            data = Dataset(data, tuple(features or [c for c in data.columns if c not in used]), target, weight, id)
        if self.supervised and data.target is None:
            raise UnsupportedDataError(f"{type(self).__name__} needs a target")
        if data.weight and not self.weights:
            raise UnsupportedDataError(f"{type(self).__name__} does not take weights")
        return self._fit(data, context or Context())

    def _fit(self, data: Dataset, context: Context) -> Fitted:
        raise NotImplementedError

    def partial_fit(self, fitted: Fitted | None, data: Dataset, context: Context | None = None) -> Fitted:
        raise UnsupportedDataError(f"{type(self).__name__} cannot be fitted in parts")


def check(condition: bool, message: str) -> None:
    if not condition:
        raise InvalidHyperparameterError(message)


Outputs = dict[str, Column]


@dataclass(frozen=True)
class Fitted:
    """Base of fitted objects: the specification, the features it was fitted on, and a report."""

    spec: Spec
    features: tuple[str, ...]
    report: FitReport

    def _need(self, df: DataFrame) -> None:
        absent = [c for c in self.features if c not in df.columns]
        if absent:
            raise SchemaMismatchError(f"columns are absent: {', '.join(absent)}")

    def predict(self, df: DataFrame) -> DataFrame:
        """Adds ``prediction`` (``cluster`` for clusterings, ``anomaly`` for detectors)."""
        raise UnsupportedDataError(f"{type(self.spec).__name__} does not predict")

    def predict_proba(self, df: DataFrame) -> DataFrame:
        """Adds ``proba_<class>`` for each class, in the order of the classes."""
        raise UnsupportedDataError(f"{type(self.spec).__name__} does not give probabilities")

    def transform(self, df: DataFrame) -> DataFrame:
        raise UnsupportedDataError(f"{type(self.spec).__name__} does not transform")

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        raise UnsupportedDataError(f"{type(self.spec).__name__} has no inverse")

    def __repr__(self) -> str:
        return f"Fitted({self.spec!r}, {len(self.features)} features, {self.report.observations} rows)"


def proba_names(classes: Sequence[Any]) -> list[str]:
    return [f"proba_{c}" for c in classes]


_ARROW = {"double": pa.float64(), "long": pa.int64(), "string": pa.string(), "int": pa.int32(), "array<double>": pa.list_(pa.float64())}


def add_numpy(df: DataFrame, features: Sequence[str], outputs: Sequence[tuple[str, str]], step: Callable[[np.ndarray], Sequence[np.ndarray]]) -> DataFrame:
    """Adds columns that ``step`` computes from the matrix of features, one Arrow batch at a time; other columns pass through."""
    kept = [c for c in df.columns if c not in {n for n, _ in outputs}]
    schema = T.StructType([f for f in df.schema.fields if f.name in kept])
    for name, kind in outputs:
        schema = schema.add(name, kind)
    inputs = [f"_x{i}" for i in range(len(features))]
    wide = df.select(*[F.col(f"`{c}`") for c in kept], *[F.col(f"`{c}`").cast("double").alias(x) for c, x in zip(features, inputs, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.columns
            X = np.column_stack([np.asarray(c.to_numpy(zero_copy_only=False), dtype=np.float64) for c in columns[len(kept) :]]) if inputs else np.zeros((batch.num_rows, 0))
            new = [pa.array(list(v) if kind.startswith("array") else v, _ARROW[kind]) for v, (_, kind) in zip(step(X), outputs, strict=True)]
            yield pa.RecordBatch.from_arrays([*columns[: len(kept)], *new], names=[*kept, *[n for n, _ in outputs]])

    return wide.mapInArrow(run, schema)


def model_catalog(task: str | None = None, **filters: bool) -> list[dict]:
    """The registered specifications, by task and capabilities."""
    rows = []
    for name, cls in sorted(REGISTRY.items()):
        # composites take theirs from their steps
        own = [getattr(cls, k) for k in ("task", "sparse", "missing", "weights", "partial", "probabilistic")]
        c = Capabilities(*["composition" if i == 0 else False if isinstance(v, property) else v for i, v in enumerate(own)] if isinstance(own[0], property) else own)
        if (task is None or c.task == task) and all(getattr(c, k) == v for k, v in filters.items()):
            rows.append({"name": name, **{f.name: getattr(c, f.name) for f in fields(c)}})
    return rows


def catalog_df(spark, **filters) -> DataFrame:
    return spark.createDataFrame([tuple(r.values()) for r in model_catalog(**filters)], "name string, task string, sparse boolean, missing boolean, weights boolean, partial_fit boolean, probabilistic boolean")


# --- verbs -----------------------------------------------------------------------------------------------------------


def fit(spec: Spec, data, **options) -> Fitted:
    return spec.fit(data, **options)


def predict(fitted: Fitted, df: DataFrame) -> DataFrame:
    return fitted.predict(df)


def predict_proba(fitted: Fitted, df: DataFrame) -> DataFrame:
    return fitted.predict_proba(df)


def transform(fitted: Fitted, df: DataFrame) -> DataFrame:
    return fitted.transform(df)


def inverse_transform(fitted: Fitted, df: DataFrame) -> DataFrame:
    return fitted.inverse_transform(df)


def partial_fit(fitted: Fitted | Spec, data: Dataset, context: Context | None = None) -> Fitted:
    """Merges a batch into a fitted object; a specification starts one."""
    return fitted.partial_fit(None, data, context) if isinstance(fitted, Spec) else fitted.spec.partial_fit(fitted, data, context)


def report(fitted: Fitted) -> FitReport:
    return fitted.report


def capabilities(spec: Spec) -> Capabilities:
    return spec.capabilities()


def input_contract(spec: Spec) -> dict:
    """What a specification asks of its input."""
    c = spec.capabilities()
    return {"numeric": spec.task != "encode", "finite": True, "missing": c.missing, "sparse": c.sparse, "weights": c.weights, "target": spec.supervised}


def output_schema(spec: Spec, schema: Schema) -> Schema | None:
    """The schema that a specification's output has, without touching data; None if it depends on the data."""
    names = spec.output_names(schema.names)
    return None if names is None else Schema(tuple(ColumnSchema(n, generated_by=type(spec).__name__) for n in names), schema.target)
