"""Quality classifier: a sparse rule ensemble over text statistics.

Statistics are DataFrame expressions over the whole text. On a bounded sample of labelled rows (``SAMPLE`` at most, the first
by hash of their ids) small boosted trees are grown in numpy; every path from a root is a conjunctive rule. A logistic model
with lasso penalty over the rules keeps a few of them. These are compiled into one DataFrame expression, so that scoring a
corpus needs no Python at all.

Edge cases: a null text counts as an empty one and gets the score of its (zero) statistics; labels that are null or not 0 or 1
are not learned from; contradicting or repeated labels of an id are all learned from; without labelled rows of both classes the
score is the share of label 1 (0.5 without any); repeated rows are kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import WORD, cut, held_out, read, text_or_empty

#: Labelled rows that are learned from at most.
SAMPLE = 8000
#: From this score on a text is predicted to be of label 1.
GOOD = 0.7
TREES, DEPTH, LEAF, THRESHOLDS = 40, 3, 8, 24
SHRINK = 0.3
LASSO = 5e-4


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a text, each a double."""
    count = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("double")
    words, chars = count(WORD), F.length(text).cast("double")
    lines = F.split(text, "\n")
    return {
        "words": F.log1p(words),
        "word_length": chars / (words + 1),
        "letter_runs": count(r"\p{L}+") / (words + 1),
        "upper": count(r"\p{Lu}") / (chars + 1),
        "upper_pairs": count(r"\p{Lu}{2,}") / (words + 1),
        "digits": count("[0-9]+") / (words + 1),
        "symbols": count(r"[^\p{L}\p{N}\s.,;:!?'\"()|-]+") / (words + 1),
        "bars": count(r"\|") / (words + 1),
        "shouts": count(r"[!?]{2,}") / (words + 1),
        "stops": count(r"[.,;:]") / (words + 1),
        "lines": F.size(lines).cast("double") / (words + 1),
        "new_lines": F.size(F.array_distinct(lines)).cast("double") / F.size(lines),
        "new_words": F.size(F.array_distinct(F.split(text, " "))).cast("double") / (words + 1),
    }


FEATURES = ("words", "word_length", "letter_runs", "upper", "upper_pairs", "digits", "symbols", "bars", "shouts", "stops", "lines", "new_lines", "new_words")

Condition = tuple[int, bool, float]  # feature, whether above, threshold


@dataclass(frozen=True)
class RuleModel:
    intercept: float
    rules: list[tuple[tuple[Condition, ...], float]]

    def column(self) -> Column:
        """The score as an expression over the statistics' columns."""
        z = F.lit(float(self.intercept))
        for conditions, weight in self.rules:
            holds = F.lit(True)
            for feature, above, threshold in conditions:
                x = F.col(FEATURES[feature])
                holds = holds & ((x > threshold) if above else (x <= threshold))
            z = z + F.when(holds, F.lit(float(weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))

    def score(self, X: np.ndarray) -> np.ndarray:
        z = np.full(len(X), self.intercept)
        for conditions, weight in self.rules:
            z += weight * _holds(X, conditions)
        return 1 / (1 + np.exp(-z))


def _holds(X: np.ndarray, conditions: tuple[Condition, ...]) -> np.ndarray:
    out = np.ones(len(X), dtype=bool)
    for feature, above, threshold in conditions:
        out &= X[:, feature] > threshold if above else X[:, feature] <= threshold
    return out


def _grow(X: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray, rows: np.ndarray, path: tuple[Condition, ...], out: list, add: np.ndarray) -> None:
    """Adds this node's rule and its children's; ``add`` gets the leaves' values."""
    if path:
        out.append(path)
    value = -g[rows].sum() / (h[rows].sum() + 1.0)
    best = (1e-6, None)
    if len(path) < DEPTH and len(rows) >= 2 * LEAF:
        G, H = g[rows].sum(), h[rows].sum()
        for j, edges in enumerate(cuts):
            if not len(edges):
                continue
            at = np.searchsorted(edges, X[rows, j], side="left")
            n = np.cumsum(np.bincount(at, minlength=len(edges) + 1))[:-1]
            gl = np.cumsum(np.bincount(at, weights=g[rows], minlength=len(edges) + 1))[:-1]
            hl = np.cumsum(np.bincount(at, weights=h[rows], minlength=len(edges) + 1))[:-1]
            gain = gl**2 / (hl + 1) + (G - gl) ** 2 / (H - hl + 1) - G**2 / (H + 1)
            gain[(n < LEAF) | (n > len(rows) - LEAF)] = -1
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], (j, float(edges[k])))
    if best[1] is None:
        add[rows] += SHRINK * value
        return
    j, edge = best[1]
    above = X[rows, j] > edge
    _grow(X, cuts, g, h, rows[~above], (*path, (j, False, edge)), out, add)
    _grow(X, cuts, g, h, rows[above], (*path, (j, True, edge)), out, add)


def _simple(path: tuple[Condition, ...]) -> tuple[Condition, ...]:
    """Of several bounds on one side of a feature only the tightest."""
    tight: dict[tuple[int, bool], float] = {}
    for j, above, edge in path:
        old = tight.get((j, above))
        tight[j, above] = edge if old is None else (max(old, edge) if above else min(old, edge))
    return tuple(sorted((j, above, edge) for (j, above), edge in tight.items()))


def _lasso_logistic(R: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Mean logistic loss plus penalty times the absolute weights, by accelerated proximal gradients; free intercept."""
    n, k = R.shape
    A = np.column_stack((np.ones(n), R))
    lipschitz = 0.25 * np.linalg.norm(A, 2) ** 2 / n
    w = np.zeros(k + 1)
    w[0] = np.log(y.mean() / (1 - y.mean()))
    v, t = w.copy(), 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(A @ v)))
        new = v - A.T @ (p - y) / n / lipschitz
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - penalty / lipschitz, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v = new + (t - 1) / t_new * (new - w)
        w, t = new, t_new
    return float(w[0]), w[1:]


def train(X: np.ndarray, y: np.ndarray, penalty: float = LASSO) -> RuleModel:
    if len(y) == 0:
        return RuleModel(0.0, [])
    if y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return RuleModel(float(np.log(share / (1 - share))), [])
    cuts = []
    for j in range(X.shape[1]):
        values = np.unique(X[:, j])
        middles = (values[1:] + values[:-1]) / 2
        # evenly spread, and denser at both ends, where rare defects lie
        q = np.concatenate((np.linspace(0, 1, THRESHOLDS), np.geomspace(1e-3, 0.1, 8), 1 - np.geomspace(1e-3, 0.1, 8)))
        cuts.append(np.unique(middles[(q * (len(middles) - 1)).astype(int)]) if len(middles) else middles)
    paths: list[tuple[Condition, ...]] = []
    z = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        _grow(X, cuts, p - y, p * (1 - p), np.arange(len(y)), (), paths, z)
    rules = sorted({_simple(p) for p in paths})
    R = np.column_stack([_holds(X, r) for r in rules]).astype(np.float64) if rules else np.zeros((len(y), 0))
    intercept, weights = _lasso_logistic(R, y.astype(np.float64), penalty)
    return RuleModel(intercept, [(r, float(w)) for r, w in zip(rules, weights, strict=True) if abs(w) > 1e-4])


def with_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, statistics), checkpointed: texts are read once for learning and scoring."""
    got = statistics(F.col("_text"))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("_text"))
    return cut(base.select("doc_id", held_out().alias("held_out"), *[got[f].alias(f) for f in FEATURES]))


def fit_quality(stats: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> RuleModel:
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("quality in (0, 1)")
    rows = stats.where(~F.col("held_out")).join(marks, "doc_id")
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "quality", *FEATURES).limit(sample)
    table = rows.select("quality", *FEATURES).toArrow()
    X = np.column_stack([np.asarray(table[f], dtype=np.float64) for f in FEATURES])
    return train(X, np.asarray(table["quality"], dtype=np.int64))


def score_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    stats = with_statistics(docs)
    model = fit_quality(stats, labels, sample)
    return stats.select("doc_id", "held_out", model.column().alias("score")).withColumn("predicted", (F.col("score") >= GOOD).cast("int"))


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    return score_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
