"""Evaluation of predictions, as small DataFrames that are computed by aggregates and running sums over distinct scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.plans.ordering import quantiles, running_sums, with_previous


def _w(weight: str | None) -> Column:
    return F.col(weight).cast("double") if weight else F.lit(1.0)


def accuracy_score(df: DataFrame, y: str, p: str, weight: str | None = None) -> DataFrame:
    w = _w(weight)
    return df.agg((F.sum(w * (F.col(y) == F.col(p)).cast("double")) / F.sum(w)).alias("accuracy"))


def confusion_matrix(df: DataFrame, y: str, p: str, labels: Sequence | None = None, weight: str | None = None) -> DataFrame:
    """(actual, predicted, n) over the sorted union of labels, zeros included."""
    counts = df.groupBy(F.col(y).alias("actual"), F.col(p).alias("predicted")).agg(F.sum(_w(weight)).alias("n"))
    if labels is None:
        known = counts.select(F.col("actual").alias("label")).union(counts.select("predicted")).distinct()
    else:
        known = df.sparkSession.createDataFrame([(v,) for v in labels], ["label"])
    grid = known.select(F.col("label").alias("actual")).crossJoin(known.select(F.col("label").alias("predicted")))
    return grid.join(counts, ["actual", "predicted"], "left").select("actual", "predicted", F.coalesce("n", F.lit(0.0)).alias("n"))


def precision_recall_f1(df: DataFrame, y: str, p: str, average: str = "macro", zero_division: float = 0.0, weight: str | None = None) -> DataFrame:
    """precision, recall, f1; average: macro, micro, weighted, or none (one row per label)."""
    cells = confusion_matrix(df, y, p, weight=weight)
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0.0)
    by = cells.select(F.explode(F.array(F.struct(F.col("actual").alias("label"), hit.alias("tp"), F.lit(0.0).alias("pp"), F.col("n").alias("ap")), F.struct(F.col("predicted").alias("label"), F.lit(0.0).alias("tp"), F.col("n").alias("pp"), F.lit(0.0).alias("ap")))).alias("c"))
    by = by.select("c.*").groupBy("label").agg(F.sum("tp").alias("tp"), F.sum("pp").alias("pp"), F.sum("ap").alias("ap"))
    ratio = lambda a, b: F.when(b == 0, F.lit(zero_division)).otherwise(a / b)
    if average == "micro":
        by = by.agg(F.sum("tp").alias("tp"), F.sum("pp").alias("pp"), F.sum("ap").alias("ap"))
    scored = by.withColumns({"precision": ratio(F.col("tp"), F.col("pp")), "recall": ratio(F.col("tp"), F.col("ap")), "f1": ratio(2 * F.col("tp"), F.col("pp") + F.col("ap"))})
    names = ["precision", "recall", "f1"]
    if average == "none":
        return scored.select("label", *names)
    if average == "weighted":
        return scored.agg(*[(F.sum(F.col(c) * F.col("ap")) / F.sum("ap")).alias(c) for c in names])
    return scored.agg(*[F.avg(c).alias(c) for c in names])


def log_loss(df: DataFrame, y: str, proba: Sequence[str], classes: Sequence, epsilon: float = 2.220446049250313e-16) -> DataFrame:
    """Mean negative logarithm of the label's probability. Unknown labels, and probabilities that aren't shares of one, are errors."""
    p, all_of = F.lit(None).cast("double"), [F.col(name).cast("double") for name in proba]
    for c, share in zip(classes, all_of, strict=True):
        p = F.when(F.col(y) == F.lit(c), share).otherwise(p)
    total = sum(all_of[1:], all_of[0])
    shares = (F.abs(total - 1) <= 1.5e-8) & (F.least(*all_of, F.lit(1.0)) >= 0) & (F.greatest(*all_of, F.lit(0.0)) <= 1)
    wrong = F.when(~F.coalesce(shares, F.lit(False)), F.lit("each row's probabilities must lie within 0 and 1 and sum to 1")).when(p.isNull(), F.lit("a label is none of the classes"))
    return df.agg((-F.avg(F.when(wrong.isNotNull(), F.raise_error(wrong).cast("double")).otherwise(F.log(F.greatest(p, F.lit(epsilon)))))).alias("log_loss"))


def _by_threshold(df: DataFrame, y: str, score: str, positive, weight: str | None) -> DataFrame:
    """One row per distinct score: true and false positives at or above it, and the totals."""
    w, hit = _w(weight), F.col(y) == F.lit(positive)
    grouped = df.groupBy(F.col(score).cast("double").alias("threshold")).agg(F.sum(F.when(hit, w).otherwise(0.0)).alias("p"), F.sum(F.when(hit, 0.0).otherwise(w)).alias("n"))
    sums, (positives, negatives) = running_sums(grouped, F.desc("threshold"), ["p", "n"])
    return sums.select("threshold", F.col("p").alias("tp"), F.col("n").alias("fp"), F.lit(positives).alias("P"), F.lit(negatives).alias("N"))


def roc_curve(df: DataFrame, y: str, score: str, positive=1, weight: str | None = None) -> DataFrame:
    """(threshold, fpr, tpr) by descending threshold, from (infinity, 0, 0)."""
    rows = _by_threshold(df, y, score, positive, weight).select("threshold", (F.col("fp") / F.col("N")).alias("fpr"), (F.col("tp") / F.col("P")).alias("tpr"))
    return df.sparkSession.createDataFrame([(float("inf"), 0.0, 0.0)], "threshold double, fpr double, tpr double").union(rows)


def precision_recall_curve(df: DataFrame, y: str, score: str, positive=1, weight: str | None = None) -> DataFrame:
    """(threshold, precision, recall) by descending threshold, from (infinity, 1, 0)."""
    rows = _by_threshold(df, y, score, positive, weight).select("threshold", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), (F.col("tp") / F.col("P")).alias("recall"))
    return df.sparkSession.createDataFrame([(float("inf"), 1.0, 0.0)], "threshold double, precision double, recall double").union(rows)


def area_under_curve(curve: DataFrame, x: str, y: str, order: str = "threshold") -> DataFrame:
    """Trapezoids along descending ``order``; an x that both grows and shrinks along it is an error."""
    rows = with_previous(curve.select(F.col(order).alias("_o"), F.col(x).alias("x"), F.col(y).alias("y")), F.desc("_o"), ["x", "y"])
    step = F.col("x") - F.col("_previous.x")
    both = rows.agg(F.sum(step * (F.col("y") + F.col("_previous.y")) / 2).alias("area"), F.min(step).alias("low"), F.max(step).alias("high"))
    turns = (F.col("low") < 0) & (F.col("high") > 0)
    return both.select(F.when(turns, F.raise_error(F.lit("the area needs an x that only grows or only shrinks")).cast("double")).otherwise(F.col("area")).alias("area"))


def calibration_curve(df: DataFrame, y: str, score: str, positive=1, n_bins: int = 10, strategy: str = "uniform", weight: str | None = None) -> DataFrame:
    """(bin, mean_predicted, observed, n) of the occupied bins; an edge belongs to the bin above it, 1 to the last.

    strategy: uniform (bins of equal width) or quantile (edges at the scores' quantiles, equal ones merged, and 0 and 1).
    """
    if strategy == "uniform":
        bin_ = F.least(F.floor(F.col(score) * n_bins), F.lit(n_bins - 1)).cast("int")
    elif strategy == "quantile":
        found = [q for q in quantiles(df, F.col(score), [k / n_bins for k in range(n_bins + 1)]) if q is not None]
        edges = sorted({0.0, 1.0, *found})
        bin_ = F.lit(0)
        for i in range(1, len(edges) - 1):
            bin_ = F.when(F.col(score) >= edges[i], i).otherwise(bin_)
    else:
        raise ValueError("strategy must be uniform or quantile")
    w, hit = _w(weight), (F.col(y) == F.lit(positive)).cast("double")
    n = F.sum(w) if weight else F.count(F.lit(1))
    return df.groupBy(bin_.alias("bin")).agg((F.sum(w * F.col(score)) / F.sum(w)).alias("mean_predicted"), (F.sum(w * hit) / F.sum(w)).alias("observed"), n.alias("n"))
