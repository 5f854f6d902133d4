"""Row numbers, running sums and exact quantiles over a global order; no task holds all rows.

Rows are sorted by ranges and cut from their plan, so that a rerun finds the same places. Of each range only its size, sums or
last row come to the driver: as many rows as the sort has partitions.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orrery.plans.graphs import cut

#: Accuracy of the estimate that brackets an exact quantile.
_ACCURACY = 10_000
#: Distinct values of a bracket that the driver sorts itself; more are ordered by ranges.
FEW = 10_000


def ordered(df: DataFrame, *order: Column) -> DataFrame:
    """The rows with ``_part`` (number of their range) and ``_at`` (growing along the order)."""
    return cut(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", 33))


def _with(rows: DataFrame, known: list[tuple], schema: str) -> DataFrame:
    """Rows joined with one broadcast row for each range."""
    return rows.join(F.broadcast(rows.sparkSession.createDataFrame(known, f"_part long, {schema}")), "_part")


def row_numbers(df: DataFrame, *order: Column) -> tuple[DataFrame, int]:
    """The rows with ``_r``, their number from 0 in the order, and how many there are."""
    rows = ordered(df, *order)
    known, total = [], 0
    for r in sorted(rows.groupBy("_part").count().collect()):
        known.append((r["_part"], total))
        total += r["count"]
    numbered = _with(rows, known, "_base long")
    return numbered.withColumn("_r", F.col("_base") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at", "_part", "_base"), total


def running_sums(df: DataFrame, order: Column, columns: Sequence[str]) -> tuple[DataFrame, list[float]]:
    """The rows with each column replaced by its sum up to the row, and the totals."""
    rows = ordered(df, order)
    known, totals = [], [0.0] * len(columns)
    for r in sorted(rows.groupBy("_part").agg(*[F.sum(c).cast("double").alias(c) for c in columns]).collect()):
        known.append((r["_part"], *totals))
        totals = [t + (r[c] or 0.0) for t, c in zip(totals, columns, strict=True)]
    so_far = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    found = _with(rows, known, ", ".join(f"_base{i} double" for i in range(len(columns))))
    found = found.withColumns({c: F.sum(c).over(so_far) + F.col(f"_base{i}") for i, c in enumerate(columns)})
    return found.select(*df.columns), totals


def running_sums_within(df: DataFrame, within: Sequence[str], order: str, columns: Sequence[str]) -> DataFrame:
    """The rows with each column replaced by its sum up to the row, among rows of equal ``within``; a group may span many ranges.

    To the driver come as many rows as there are groups and ranges.
    """
    rows = ordered(df, *within, order)
    known, before, last = [], [], None
    for r in sorted(rows.groupBy("_part", *within).agg(*[F.sum(c).cast("double").alias(c) for c in columns]).collect(), key=lambda r: (tuple(r[k] for k in within), r["_part"])):
        if (group := tuple(r[k] for k in within)) != last:
            before, last = [0.0] * len(columns), group
        known.append((r["_part"], *group, *before))
        before = [t + r[c] for t, c in zip(before, columns, strict=True)]
    kinds = dict(df.dtypes)
    schema = ", ".join(["_part long", *[f"{k} {kinds[k]}" for k in within], *[f"_base{i} double" for i in range(len(columns))]])
    found = rows.join(F.broadcast(df.sparkSession.createDataFrame(known, schema)), ["_part", *within])
    so_far = Window.partitionBy("_part", *within).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    return found.withColumns({c: F.sum(c).over(so_far) + F.col(f"_base{i}") for i, c in enumerate(columns)}).select(*df.columns)


def with_previous(df: DataFrame, order: Column, columns: Sequence[str]) -> DataFrame:
    """The rows with ``_previous``, a struct of the columns of the row before; null in the first row."""
    rows = ordered(df, order)
    last = rows.groupBy("_part").agg(F.max_by(F.struct(*columns), "_at").alias("last")).collect()
    known, before = [], None
    for r in sorted(last, key=lambda r: r["_part"]):
        known.append((r["_part"], before))
        before = tuple(r["last"])
    kinds = dict(df.dtypes)
    found = _with(rows, known, f"_before struct<{','.join(f'{c}:{kinds[c]}' for c in columns)}>")
    lag = F.lag(F.struct(*columns)).over(Window.partitionBy("_part").orderBy("_at"))
    return found.withColumn("_previous", F.coalesce(lag, F.col("_before"))).select(*df.columns, "_previous")


def quantiles(df: DataFrame, value: Column, shares: Sequence[float]) -> list[float | None]:
    """Exact quantiles of the values that aren't null, by linear interpolation between neighbours; None without values.

    An estimate brackets each quantile; the distinct values inside are counted and ordered. A bracket that turns out to miss the
    wanted ranks is replaced by the whole range.
    """
    values = df.select(value.cast("double").alias("v")).where("v is not null")
    margin = 2 / _ACCURACY
    low, high = ([min(max(s + d, 0.0), 1.0) for s in shares] for d in (-margin, margin))
    guess = values.agg(F.count("v").alias("n"), F.percentile_approx("v", [*low, *high], _ACCURACY).alias("q")).first()
    n = guess["n"]
    if not n:
        return [None] * len(shares)
    brackets = list(zip(guess["q"][: len(shares)], guess["q"][len(shares) :], strict=True))
    below = values.agg(*[F.count(F.when(F.col("v") < a, 1)).alias(f"a{i}") for i, (a, _) in enumerate(brackets)], *[F.count(F.when(F.col("v") <= b, 1)).alias(f"b{i}") for i, (_, b) in enumerate(brackets)]).first()
    out: list[float | None] = []
    for i, s in enumerate(shares):
        place = s * (n - 1)
        k, part = int(place), place - int(place)
        wanted = [k, min(k + 1, n - 1)]
        covered = below[f"a{i}"] <= wanted[0] and below[f"b{i}"] > wanted[1]
        if covered and brackets[i][0] == brackets[i][1]:
            out.append(float(brackets[i][0]))
            continue
        inside, start = (values.where(F.col("v").between(*brackets[i])), below[f"a{i}"]) if covered else (values, 0)
        counted = inside.groupBy("v").agg(F.count(F.lit(1)).alias("c"))
        few = sorted(tuple(r) for r in counted.limit(FEW + 1).collect())
        if len(few) <= FEW:
            ends = [start + e for e in accumulate(c for _, c in few)]
            hit = [few[bisect_right(ends, w)][0] for w in wanted]
            out.append(float(hit[0] + (hit[1] - hit[0]) * part))
            continue
        sums, _ = running_sums(counted, F.asc("v"), ["c"])
        hit = [sums.where(F.col("c") + start > w).agg(F.min("v")).first()[0] for w in wanted]
        out.append(float(hit[0] + (hit[1] - hit[0]) * part))
    return out
