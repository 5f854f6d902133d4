"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text's subwords are its n-grams of 1 to 3 code points (lower-cased; anything but letters is a boundary, which an n-gram may
have at its ends only). Each is hashed to one of ``BUCKETS`` embeddings; their mean goes through a linear softmax. Embeddings
and softmax are trained by stochastic gradient descent in numpy on segments of a bounded sample: ``PER_LANGUAGE`` documents of
each language, the first by hash of their ids. A fifth of the sample's documents are kept for calibration: a temperature for
the probabilities, and the rejection limits: a score, and a share of known n-grams, that all but ``REJECT_SHARE`` of them reach.
Scoring is linear in the embeddings, so each bucket's logits are computed once and whole texts are averages of these.

Edge cases: a null text and a text without letters are ``und`` with score 0, and rejected; equal texts get equal results;
documents without lang are predicted but not learned from; with nothing to learn from every document is ``und``; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm.common import held_out, read, small
from orrery.llm.shingles import mix

UNKNOWN = "und"
BUCKETS = 1 << 15
DIMENSIONS = 12
ORDERS = (1, 2, 3)
#: Documents of each language that are learned from at most.
PER_LANGUAGE = 400
SEGMENT, SHORT = 300, 40
EPOCHS = 4
RATE = 4.0
REJECT_SHARE = 0.001
#: No text with a score of this much is rejected for its score.
SURE = 0.5
GROUP_CHARS = 1 << 19
_MULTIPLIERS = [np.uint64(2 * k + 0x9E3779B97F4A7C15) for k in (0, 0x1234567, 0x7654321)]
_letter_table: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _letter_table:
        _letter_table.append(np.array([chr(c).isalpha() for c in range(0x110000)], dtype=bool))
    return _letter_table[0]


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts with 0 for what is no letter, a 0 before and after each; where each text begins."""
    low = [t.lower() for t in texts]
    data = np.frombuffer(("\0" + "".join(t + "\0" for t in low)).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    starts = np.concatenate(([0], np.cumsum([len(t) + 1 for t in low])))
    return np.where(_letters()[data], data, 0), starts


def _windows(codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: where n-grams begin, and their buckets."""
    letter = codes != 0
    wide = codes.astype(np.uint64)
    for n in ORDERS:
        size = len(codes) - n + 1
        if size <= 0:
            continue
        ok = letter[:size].copy() if n == 1 else (letter[:size] | letter[1 : 1 + size] if n == 2 else np.ones(size, dtype=bool))
        for j in range(1, n - 1):
            ok &= letter[j : j + size]
        at = np.flatnonzero(ok)
        h = np.full(len(at), n, dtype=np.uint64)
        for j in range(n):
            h += wide[at + j] * _MULTIPLIERS[j]
        yield at, (mix(h) >> np.uint64(64 - 15)).astype(np.int32)


def _groups(texts: list[str]) -> Iterator[tuple[int, int]]:
    lo = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > GROUP_CHARS:
            yield lo, i
            lo, size = i, 0
        size += len(t)
    if lo < len(texts):
        yield lo, len(texts)


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    logits: np.ndarray  # (BUCKETS, languages): what a bucket adds to the mean
    bias: np.ndarray
    known: np.ndarray  # (BUCKETS,): seen in training
    temperature: float
    least_score: float
    least_known: float

    def evidence(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Mean logits, share of known n-grams, and number of n-grams of each text."""
        n = len(self.languages)
        table = np.column_stack((self.logits, self.known)).astype(np.float32)
        sums, counts = np.zeros((len(texts), n + 1)), np.zeros(len(texts), dtype=np.int64)
        for lo, hi in _groups(texts):
            codes, starts = _codes(texts[lo:hi])
            for at, buckets in _windows(codes):
                edges = np.searchsorted(at, starts)
                full = np.flatnonzero(edges[1:] > edges[:-1])
                if len(full):
                    sums[lo + full] += np.add.reduceat(table[buckets], edges[full], axis=0, dtype=np.float64)
                    counts[lo:hi] += edges[1:] - edges[:-1]
        mean = sums / np.maximum(counts, 1)[:, None]
        return mean[:, :n] + self.bias, mean[:, n], counts

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and whether it is rejected, for each text."""
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), dtype=bool)
        logits, known, counts = self.evidence(texts)
        p = _softmax(logits / self.temperature)
        best = p.argmax(axis=1)
        score = np.where(counts > 0, p[np.arange(len(texts)), best], 0.0)
        rejected = (counts == 0) | (score < self.least_score) | (known < self.least_known)
        return [self.languages[b] if c else UNKNOWN for b, c in zip(best, counts, strict=True)], score, rejected


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _bags(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text its distinct buckets and their shares."""
    out = []
    for t in texts:
        ids = np.concatenate([b for _, b in _windows(_codes([t])[0])] or [np.zeros(0, dtype=np.int32)])
        at, n = np.unique(ids, return_counts=True)
        out.append((at, n / max(n.sum(), 1)))
    return out


def train(rows: list[tuple[str, str]], seed: int = 7) -> LanguageModel:
    """rows: (language, text), in an order that does not depend on how they were stored."""
    rows = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    languages = sorted({r[0] for r in rows})
    classes = {x: i for i, x in enumerate(languages)}
    L = len(languages)
    rng = np.random.default_rng(seed)
    calibration = [r for i, r in enumerate(rows) if i % 5 == 4]
    learned = [r for i, r in enumerate(rows) if i % 5 != 4]
    pieces, labels = [], []
    for lang, text in learned:
        # segments spread over the whole text, and a short one, so that short texts are known too
        cuts = rng.integers(0, max(len(text) - SEGMENT, 0) + 1, size=4)
        for k, c in enumerate(cuts):
            pieces.append(text[c : c + (SEGMENT if k < 3 else SHORT)])
            labels.append(classes[lang])
    bags = _bags(pieces)
    E = (rng.random((BUCKETS, DIMENSIONS)) - 0.5) / DIMENSIONS
    W, b, known = np.zeros((DIMENSIONS, L)), np.zeros(L), np.zeros(BUCKETS)
    total, step = max(1, EPOCHS * len(bags)), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(bags)):
            at, share = bags[i]
            rate = RATE * (1 - step / total)
            step += 1
            if not len(at):
                continue
            x = share @ E[at]
            z = x @ W + b
            g = np.exp(z - z.max())
            g /= g.sum()
            g[labels[i]] -= 1
            gx = W @ g
            W -= rate * np.outer(x, g)
            b -= rate * 0.02 * g
            E[at] -= np.outer(rate * share, gx)
    for at, _ in bags:
        known[at] = 1
    plain = LanguageModel(languages, (E @ W).astype(np.float32), b, known, 1.0, 0.0, 0.0)
    if L == 0 or not calibration:
        return plain
    # whole texts, and a short piece of each, so that the limits suit short texts too
    held = [(lang, part) for lang, text in calibration for part in (text, text[len(text) // 2 :][:SHORT]) if any(c.isalpha() for c in part)]
    y = np.array([classes[lang] for lang, _ in held])
    logits, share, _ = plain.evidence([part for _, part in held])
    # smoothed targets: without an error in the calibration set its probabilities still stay below 1
    sure = (len(y) + 1) / (len(y) + 2)
    target = np.full((len(y), L), (1 - sure) / max(L - 1, 1))
    target[np.arange(len(y)), y] = sure
    temperatures = np.geomspace(0.05, 10, 60)
    losses = [-(target * np.log(np.maximum(_softmax(logits / t), 1e-12))).sum(axis=1).mean() for t in temperatures]
    temperature = float(temperatures[int(np.argmin(losses))])
    # what it gets wrong may be wrongly labelled; the limits are set on the rest
    right = logits.argmax(axis=1) == y
    scores = _softmax(logits / temperature).max(axis=1)[right]
    least_score = float(min(SURE, np.quantile(scores, REJECT_SHARE))) if right.any() else 0.0
    least_known = float(0.5 * np.quantile(share[right], REJECT_SHARE)) if right.any() else 0.0
    return LanguageModel(languages, plain.logits, b, known, temperature, least_score, least_known)


def fit_languages(docs: DataFrame, per_language: int = PER_LANGUAGE) -> LanguageModel:
    """Learns from rows with text and lang that are not held out. At most per_language documents of each language are read.

    Which ones is decided on the id and language columns alone. Of an id that stands in several rows the least (lang, text) is read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text").where(F.col("lang").isNotNull() & ~held_out())
    ids = training_ids(rows.select("doc_id", "lang"), per_language)
    if not ids:
        return train([])
    picked = rows.join(F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in ids], "doc_id long")), "doc_id")
    least = picked.where("text is not null").groupBy("doc_id").agg(F.min(F.struct("lang", "text")).alias("row"))
    found = least.select("doc_id", "row.*").collect()
    found.sort(key=lambda r: (hash_order(r["doc_id"]), r["lang"], r["text"]))
    return train([(r["lang"], r["text"]) for r in found])


def training_ids(rows: DataFrame, per_language: int) -> list[int]:
    """Of each language the per_language ids of least hash.

    Only hashes below a bound, chosen by the language's number of rows, are sorted: some four times as many as are wanted, whatever
    the number of rows. A language with too few below its bound (equal ids have equal hashes) is done again without one.
    """
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    order = F.xxhash64("doc_id")
    first = Window.partitionBy("lang").orderBy(order, "doc_id")

    def chosen(bounds: dict[str, float]) -> list[tuple[str, int | None]]:
        known = rows.sparkSession.createDataFrame(list(bounds.items()), "lang string, bound double")
        below = rows.join(F.broadcast(known), "lang").where(order / F.lit(2.0**64) + 0.5 <= F.col("bound"))
        numbered = below.withColumn("n", F.row_number().over(first)).where(F.col("n") <= per_language)
        return [(r["lang"], r["doc_id"]) for r in numbered.select("lang", "doc_id").collect()]

    if not sizes:
        return []
    bounds = {lang: min((4 * per_language + 64) / n, 1.0) for lang, n in sizes.items()}
    found = chosen(bounds)
    have = Counter(lang for lang, _ in found)
    short = {lang: 1.0 for lang, n in sizes.items() if bounds[lang] < 1 and have[lang] < min(per_language, n)}
    if short:
        found = [(lang, i) for lang, i in found if lang not in short] + chosen(short)
    return sorted({i for _, i in found if i is not None})


def hash_order(doc_id: int) -> int:
    return int(mix(np.array([doc_id], dtype=np.int64).view(np.uint64))[0])


def predict_languages(docs: DataFrame, model: LanguageModel | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model or fit_languages(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            lang, score, rejected = shared.value.predict([t or "" for t in batch.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def keep_identified(docs: DataFrame, model: LanguageModel | None = None) -> DataFrame:
    """The documents whose language is identified and not rejected, columns as given."""
    shared = docs.sparkSession.sparkContext.broadcast(model or fit_languages(docs))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            rejected = shared.value.predict([t or "" for t in batch.column(at).to_pylist()])[2]
            yield batch.filter(pa.array(~rejected))

    return docs.mapInArrow(run, docs.schema)


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    return predict_languages(read(spark, sf_dir, "documents"))
