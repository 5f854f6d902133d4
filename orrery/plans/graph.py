"""Pipelines as graphs: nodes and edges, validation, tracing of fitted steps, and fusion of adjacent affine steps."""

from __future__ import annotations

import time
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame

from orrery.core import Capabilities, Fitted, Schema, Spec, output_schema
from orrery.errors import GraphValidationError
from orrery.operators.preprocess import Affine
from orrery.pipeline import Chain, ChainFit, ColumnMap, Parallel


@dataclass(frozen=True)
class Node:
    """What a step of a pipeline asks for and gives."""

    id: int
    kind: str
    spec: Spec
    inputs: tuple[int, ...]
    capabilities: Capabilities


def build_graph(spec: Spec) -> list[Node]:
    """Nodes in topological order; 0 is the input. A column map becomes selections, branches and a concatenation."""
    nodes: list[Node] = []

    def add(s: Spec, inputs: tuple[int, ...], kind: str | None = None) -> int:
        nodes.append(Node(len(nodes) + 1, kind or type(s).__name__, s, inputs, s.capabilities()))
        return len(nodes)

    def walk(s: Spec, source: int) -> int:
        if isinstance(s, Chain):
            for step in s.steps:
                source = walk(step, source)
            return source
        if isinstance(s, ColumnMap):
            return add(s, tuple(walk(b, add(s, (source,), "Select")) for _, b in s.pairs), "Concatenate")
        if isinstance(s, Parallel):
            return add(s, tuple(walk(b, source) for b in s.branches), "Concatenate")
        return add(s, (source,))

    walk(spec, 0)
    predictors = [n for n in nodes if not n.spec.transforms]
    if len(predictors) > 1 or predictors and predictors[0] is not nodes[-1]:
        raise GraphValidationError("a pipeline has at most one predictor, and it comes last")
    return nodes


def graph_data(spec: Spec) -> list[dict]:
    return [{"id": n.id, "kind": n.kind, "inputs": list(n.inputs), "task": n.capabilities.task} for n in build_graph(spec)]


def propagate_schema(spec: Chain, schema: Schema) -> list[Schema | None]:
    """The schema after each step, without touching data; None from where it depends on the data."""
    out: list[Schema | None] = []
    for s in spec.steps:
        schema = None if schema is None else output_schema(s, schema)
        out.append(schema)
    return out


def trace(fitted: ChainFit, df: DataFrame) -> list[dict]:
    """Runs a fitted chain step by step: seconds up to and including each step, and its columns."""
    rows = []
    for i, step in enumerate(fitted.steps):
        df = step.predict(df) if i == len(fitted.steps) - 1 and not step.spec.transforms else step.transform(df)
        began = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        rows.append({"node": i + 1, "kind": type(step.spec).__name__, "seconds": time.perf_counter() - began, "columns": df.columns})
    return rows


def _plain(s: Fitted) -> bool:
    return isinstance(s, Affine) and not s.clip


def fuse(fitted: ChainFit) -> ChainFit:
    """Adjacent affine steps on the same features become one: ((x - m1)/s1*a1 + l1 - m2)/s2*a2 + l2."""
    steps: list[Fitted] = []
    for s in fitted.steps:
        last = steps[-1] if steps else None
        if last is not None and _plain(last) and _plain(s) and last.features == s.features:
            gain = last.span / last.scale * s.span / s.scale
            shift = last.shift - (last.low - s.shift) * last.scale / last.span - s.low * s.scale / s.span * last.scale / last.span
            steps[-1] = Affine(s.spec, s.features, s.report, shift, 1 / np.where(gain == 0, 1, gain))
        else:
            steps.append(s)
    return replace(fitted, steps=tuple(steps))
