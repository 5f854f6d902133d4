"""All pairs of points within a radius, by blocks of neighbouring points; no pair of points need become a row.

Points are dealt into blocks by median splits of a sample. Pairs of blocks whose bounding boxes lie farther apart than the radius
are left out; the others meet in tiles, where matrix products give the distances. Products that come near the radius to within
their rounding error are replaced by the plain sum of squares, so that the pairs are those of the plain sum.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.plans.graphs import cut

#: Points of a block at most (a number holds 12 bits of place), and of the parts of a block whose boxes are compared.
BLOCK, PART = 4096, 256
#: Rows of the sample for each block; the splits only decide how well blocks are told apart, not what is found.
SAMPLED = 32
#: Bytes of the points that meet in a tile, and points whose distances are held at a time.
TILE_BYTES, CHUNK = 1 << 26, 512
#: Boxes are farther apart than the radius beyond this factor, which covers the rounding of their gap.
SLACK = 1 + 1e-9


def close(A: np.ndarray, B: np.ndarray, square: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (i of A, j of B) whose squared distance, summed in the order of the columns, is at most ``square``, in chunks."""
    if not len(A) or not len(B):
        return
    p, middle = A.shape[1], (A.mean(axis=0) + B.mean(axis=0)) / 2
    with np.errstate(over="ignore", invalid="ignore"):
        A0, B0 = A - middle, B - middle
        # scaled by a power of two, so that squares stay within the range of the short numbers
        widest = max(np.abs(A0).max(), np.abs(B0).max())
        scale = 2.0 ** -np.floor(np.log2(widest)) if 0 < widest < np.inf else 1.0
        A0, B0, scaled = A0 * scale, B0 * scale, square * scale * scale
        a, b = (A0 * A0).sum(axis=1), (B0 * B0).sum(axis=1)
        most = max(a.max(), b.max())
        for kind in (np.float32, np.float64):
            error = float(2.1 * (p + 8) * np.finfo(kind).eps * most)
            if error <= scaled / 1000:
                break
        right = np.column_stack((B0, np.ones(len(B)), b)).astype(kind).T.copy()
        for lo in range(0, len(A), CHUNK):
            left = np.column_stack((-2 * A0[lo : lo + CHUNK], a[lo : lo + CHUNK], np.ones(len(A[lo : lo + CHUNK])))).astype(kind)
            d = (left @ right).ravel()
            at = np.flatnonzero(d <= scaled + error) if np.isfinite(error) else np.arange(len(d))
            if not len(at):
                continue
            unsure = np.flatnonzero(~(d[at] < scaled - error))
            i, j = np.divmod(at, len(B))
            keep = np.ones(len(at), dtype=bool)
            for k in range(0, len(unsure), 1 << 18):
                u = unsure[k : k + (1 << 18)]
                total = np.zeros(len(u))
                for c in range(p):
                    gap = A[lo + i[u], c] - B[j[u], c]
                    total += gap * gap
                keep[u] = total <= square
            yield lo + i[keep], j[keep]


def _apart(low: np.ndarray, high: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
    """Squared gaps between one box and others."""
    with np.errstate(over="ignore"):
        gap = np.maximum(np.maximum(lows - high, low - highs), 0)
        return (gap * gap).sum(axis=-1)


def _splits(X: np.ndarray, size: int) -> list[tuple[int, float, int, int]]:
    """Median splits (feature, threshold, left, right) down to ``size`` rows; a leaf is (-1, its number, 0, 0)."""
    nodes: list[tuple[int, float, int, int]] = []
    leaves = 0

    def build(i: np.ndarray) -> int:
        nonlocal leaves
        at = len(nodes)
        nodes.append((-1, float(leaves), 0, 0))
        spread = np.ptp(X[i], axis=0) if len(i) > size else np.zeros(1)
        j = int(spread.argmax())
        if spread[j] > 0:
            x = X[i, j]
            t = np.partition(x, (len(x) - 1) // 2)[(len(x) - 1) // 2]
            t = t if t < x.max() else x[x < t].max()
            left = build(i[x <= t])
            nodes[at] = (j, float(t), left, build(i[x > t]))
        else:
            leaves += 1
        return at

    build(np.arange(len(X)))
    return nodes


def _leaf(X: np.ndarray, nodes: list[tuple[int, float, int, int]]) -> np.ndarray:
    """The number of each row's leaf."""
    feature, threshold, left, right = (np.array(v) for v in zip(*nodes, strict=True))
    at = np.zeros(len(X), dtype=np.int64)
    while len(inner := np.flatnonzero(feature[at] >= 0)):
        go = X[inner, feature[at[inner]]] <= threshold[at[inner]]
        at[inner] = np.where(go, left[at[inner]], right[at[inner]])
    return threshold[at].astype(np.int64)


def _matrix(columns: list) -> np.ndarray:
    return np.column_stack([np.asarray(c.to_numpy(zero_copy_only=False) if isinstance(c, pa.Array) else c.to_numpy(), dtype=np.float64) for c in columns])


@dataclass(frozen=True)
class Side:
    """A block, or what is left of it, in a tile: numbers and coordinates of its points, and their values."""

    place: int
    numbers: np.ndarray
    X: np.ndarray
    value: np.ndarray

    @cached_property
    def parts(self) -> tuple[np.ndarray, np.ndarray]:
        starts = np.arange(0, len(self.X), PART)
        return np.minimum.reduceat(self.X, starts), np.maximum.reduceat(self.X, starts)


def pairs(one: Side, two: Side, square: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Close pairs of two sides, in chunks; parts whose boxes are too far apart are left out."""
    if not len(one.X) or not len(two.X):
        return
    near = np.array([_apart(low, high, *two.parts) <= square * SLACK for low, high in zip(*one.parts, strict=True)])
    if near.all():
        yield from close(one.X, two.X, square)
        return
    for k in np.flatnonzero(near.any(axis=1)):
        of = np.flatnonzero(np.repeat(near[k], PART)[: len(two.X)])
        for i, j in close(one.X[k * PART : (k + 1) * PART], two.X[of], square):
            yield k * PART + i, of[j]


@dataclass(frozen=True)
class Blocks:
    """Points (x0, x1, ..., key, n) in blocks; ``members`` has their blocks, numbers, keys and n."""

    rows: DataFrame  # block, keys, x, n, low, high
    plan: DataFrame  # place, block, tile, side (1: left, 2: right, 3: both)
    tiles: int
    square: float

    @property
    def members(self) -> DataFrame:
        one = F.explode(F.arrays_zip(F.sequence(F.lit(0).cast("long"), F.size("keys").cast("long") - 1).alias("place"), F.col("keys").alias("key"), F.col("n").alias("n")))
        return self.rows.select("block", one.alias("m")).select("block", (F.col("block") * BLOCK + F.col("m.place")).alias("number"), F.col("m.key").alias("key"), F.col("m.n").alias("n"))

    def meet(self, values: DataFrame, step: Callable[[list[tuple[Side, Side]], float], dict[str, np.ndarray]], schema: str) -> DataFrame:
        """What ``step`` makes of each tile's pairs of sides. values: (block, values), a number for each point; 0 leaves it out."""
        shipped = self.rows.select("block", "x").join(values, "block").join(F.broadcast(self.plan), "block")
        parts, square = max(1, min(self.tiles, 2000)), self.square

        def sides(found: list[tuple[Side, int]]) -> list[tuple[Side, Side]]:
            return [(a, b) for a, left in found for b, right in found if left & 1 and right & 2 and a.place <= b.place]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: list[tuple[Side, int]] = []
            tile = None

            def ended() -> pa.RecordBatch:
                out = step(sides(found), square)
                return pa.RecordBatch.from_arrays([pa.array(v) for v in out.values()], names=list(out))

            for batch in batches:
                for r in batch.to_pylist():
                    if tile is not None and r["tile"] != tile:
                        yield ended()
                        found = []
                    tile = r["tile"]
                    value = np.asarray(r["values"], dtype=np.float64)
                    kept = np.flatnonzero(value)
                    X = np.frombuffer(r["x"]).reshape(len(value), -1)
                    found.append((Side(r["place"], r["block"] * BLOCK + kept, X if len(kept) == len(X) else X[kept], value[kept]), r["side"]))
            if tile is not None:
                yield ended()

        kept = shipped.select("tile", "block", "place", "side", "values", "x")
        dealt = kept.withColumn("_part", (F.col("tile") % parts).cast("int")).repartitionById(parts, "_part").drop("_part")
        return dealt.sortWithinPartitions("tile").mapInArrow(run, schema)


def make_blocks(points: DataFrame, n: int, p: int, radius: float) -> Blocks:
    """Blocks of ``n`` different points (x0, x1, ..., key, n), and which of them meet."""
    x, spark = [f"x{i}" for i in range(p)], points.sparkSession
    size = SAMPLED * -(-n // BLOCK) * 5 // 4  # a quarter more blocks, since sampled splits are uneven
    drawn = points.select(*x) if n <= size else points.where(F.pmod(F.xxhash64(*x), F.lit(1 << 30)) < int((1 << 30) * size / n)).select(*x)
    table = drawn.toArrow()
    sample = _matrix([table[c] for c in x])
    nodes = _splits(sample, max(1, SAMPLED if n > BLOCK else len(sample)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_leaf(_matrix(batch.columns[:p]), nodes))], names=[*x, "key", "n", "leaf"])

    def build(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        X = _matrix([group[c] for c in x])
        count = -(-len(X) // BLOCK)
        order = _leaf(X, _splits(X, PART)).argsort(kind="stable")
        out = []
        for k, at in enumerate(np.array_split(order, count)):
            own = group.select(["key", "n"]).take(pa.array(at))
            out.append((key[0].as_py() << 20 | k, own["key"].to_pylist(), own["n"].to_pylist(), X[at].tobytes(), X[at].min(axis=0).tolist(), X[at].max(axis=0).tolist()))
        names = ["block", "keys", "n", "x", "low", "high"]
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.float64())]
        return pa.table({c: pa.array(list(v), t) for c, t, v in zip(names, kinds, zip(*out, strict=True), strict=True)})

    schema = T.StructType(points.select(*x, "key", "n").schema.fields).add("leaf", "long")
    leaves = points.select(*x, "key", "n").mapInArrow(assign, schema)
    rows = cut(leaves.groupBy("leaf").applyInArrow(build, "block long, keys array<long>, n array<long>, x binary, low array<double>, high array<double>"))
    known = sorted(rows.select("block", "low", "high").collect(), key=lambda r: r["block"])
    low, high = np.array([r["low"] for r in known]).reshape(-1, p), np.array([r["high"] for r in known]).reshape(-1, p)
    square, wide = radius**2, np.sqrt(8 * spark.sparkContext.defaultParallelism)
    together = max(1, min(16, TILE_BYTES // (2 * BLOCK * p * 8), int(-(-len(known) // wide))))  # blocks of a tile's side
    meeting: dict[tuple[int, int], dict[int, int]] = {}
    for i in range(len(known)):
        for j in i + np.flatnonzero(_apart(low[i], high[i], low[i:], high[i:]) <= square * SLACK):
            own = meeting.setdefault((i // together, int(j) // together), {})
            own[i] = own.get(i, 0) | 1
            own[int(j)] = own.get(int(j), 0) | 2
    plan = [(place, known[place]["block"], t, side) for t, (_, own) in enumerate(sorted(meeting.items())) for place, side in own.items()]
    return Blocks(rows, spark.createDataFrame(plan, "place int, block long, tile int, side int"), len(meeting), square)
