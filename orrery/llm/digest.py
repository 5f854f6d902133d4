"""Improbable-feature digests: rare byte windows in chained Bloom filters.

Every window of ``WINDOW`` bytes has a Shannon entropy. How rare an entropy is among all windows of the corpus ranks the
windows (one histogram of ``BINS`` counts over all documents). Among ``reach`` consecutive windows the rarest (the first of
equals) gets a vote; windows with enough votes are the text's features. Their hashes go, in order and each once, into Bloom
filters of ``BITS`` bits with ``HASHES`` bits a feature; after ``FEATURES`` features the next filter begins. Two digests are
compared filter by filter: the overlap of set bits beyond what chance gives, over the most it could be, best partner first,
averaged by the features of the digest with fewer of them.

Entropies are sums of integers that slide along all texts at once, so a window's value does not depend on its surroundings.
Short texts vote among fewer neighbours, so that they get some features too; a text shorter than a window is one feature.

Edge cases: null and empty texts have an empty fingerprint; two empty fingerprints are alike (1), an empty one is unlike any
other (0); equal texts have equal fingerprints; rows are ordered by id descending, equal ids by text; null ids come last;
repeated rows are kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import read, small
from orrery.llm.shingles import mix

WINDOW = 16
BINS = 1024
BITS = 2048
HASHES = 5
FEATURES = 160
#: Windows among which one gets a vote, at most and at least; a text has about TEXT_PART times this at least.
REACH, LEAST_REACH, TEXT_PART = 48, 4, 16
#: Share of REACH in votes that makes a feature.
VOTES = 0.25
#: Overlap below this share of the possible range counts as chance.
CHANCE = 0.1
#: Texts are processed in groups of about so many bytes.
GROUP_BYTES = 1 << 20
#: Bytes of text in one partition of the ordered table, about.
PARTITION_BYTES = 32 << 20
_SCALE = 1 << 16
_counts = np.arange(WINDOW + 1, dtype=np.float64)
_XLOGX = np.rint(np.where(_counts > 0, _counts * np.log2(np.maximum(_counts, 1)), 0) * _SCALE).astype(np.int64)
_GAIN = np.concatenate(([0], np.diff(_XLOGX)))


def window_entropies(data: np.ndarray) -> np.ndarray:
    """Bin of the entropy of each window of ``data``, 0 to BINS - 1."""
    n = len(data)
    if n < WINDOW:
        return np.zeros(0, dtype=np.int64)
    after, before = np.ones(n, dtype=np.uint8), np.ones(n, dtype=np.uint8)
    for d in range(1, WINDOW):
        same = (data[:-d] == data[d:]).view(np.uint8)
        after[:-d] += same
        before[d:] += same
    first = _XLOGX[np.bincount(data[:WINDOW], minlength=256)].sum()
    total = first + np.concatenate(([0], np.cumsum(_GAIN[before[WINDOW:]] - _GAIN[after[: n - WINDOW]])))
    # sum of c log c runs from 0 (all different) to WINDOW log WINDOW (all equal)
    return np.minimum((_XLOGX[WINDOW] - total) * BINS // (_XLOGX[WINDOW] + 1), BINS - 1)


@dataclass(frozen=True)
class Rarity:
    """rank[bin]: 0 for the entropy that is rarest among all windows; bins never seen rank first."""

    rank: np.ndarray

    @staticmethod
    def of_counts(counts: np.ndarray) -> Rarity:
        rank = np.empty(BINS, dtype=np.int64)
        rank[np.lexsort((np.arange(BINS), counts))] = np.arange(BINS)
        return Rarity(rank)


def fit_rarity(docs: DataFrame) -> Rarity:
    """Counts the entropies of all windows of all texts; only BINS sums reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BINS, dtype=np.int64)
        for batch in small(batches):
            for group in _groups([x or b"" for x in batch.column(0).cast(pa.binary()).to_pylist()]):
                data, starts, sizes = _joined(group)
                bins = window_entropies(data)
                counts += np.bincount(bins[_inside(len(bins), starts, sizes)], minlength=BINS)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["bin", "n"])

    rows = docs.select("text").mapInArrow(run, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(BINS, dtype=np.int64)
    for r in rows:
        counts[r["bin"]] = r["n"]
    return Rarity.of_counts(counts)


def _groups(texts: list[bytes]) -> Iterator[list[bytes]]:
    group, size = [], 0
    for t in texts:
        if size and size + len(t) > GROUP_BYTES:
            yield group
            group, size = [], 0
        group.append(t)
        size += len(t)
    if group:
        yield group


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    return np.frombuffer(b"".join(texts), dtype=np.uint8), np.cumsum(sizes) - sizes, sizes


def _inside(n: int, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which of the n windows over the joined texts lie within one text."""
    edge = np.zeros(n + 1, dtype=np.int32)
    long = sizes >= WINDOW
    np.add.at(edge, starts[long], 1)
    np.add.at(edge, starts[long] + sizes[long] - WINDOW + 1, -1)
    return np.cumsum(edge[:-1]) > 0


def _reach(windows: int) -> int:
    return int(min(REACH, max(LEAST_REACH, windows // TEXT_PART)))


def _votes(key: np.ndarray, reach: int) -> np.ndarray:
    """Least key of every ``reach`` consecutive ones, by doubling."""
    low, span = key, 1
    while 2 * span <= reach:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    return np.minimum(low[: len(key) - reach + 1], low[reach - span :]) if span < reach else low


def feature_hashes(texts: list[bytes], rarity: Rarity) -> list[np.ndarray]:
    """For each text the hashes of its features, in order of first occurrence."""
    out: list[np.ndarray] = []
    for group in _groups(texts):
        data, starts, sizes = _joined(group)
        bins = window_entropies(data)
        key = (rarity.rank[bins] << 32) + np.arange(len(bins))
        chosen = []
        for text, start, size in zip(group, starts, sizes, strict=True):
            if size < WINDOW:
                chosen.append(None)
                continue
            windows = size - WINDOW + 1
            reach = min(_reach(windows), windows)
            at = (_votes(key[start : start + windows], reach) & 0xFFFFFFFF) - start
            votes = np.bincount(at, minlength=windows)
            chosen.append(start + np.flatnonzero(votes >= min(max(1, int(reach * VOTES)), votes.max())))
        found = [c for c in chosen if c is not None]
        if found:
            rows = np.lib.stride_tricks.sliding_window_view(data, WINDOW)[np.concatenate(found)].copy().view("<u8")
            hashes = np.zeros(len(rows), dtype=np.uint64)
            for j in range(WINDOW // 8):
                hashes = mix(hashes * np.uint64(3) + rows[:, j] + np.uint64(j + 1))
        at = 0
        for text, c in zip(group, chosen, strict=True):
            if c is None:
                out.append(np.frombuffer(hashlib.blake2b(text, digest_size=8).digest(), dtype=np.uint64) if text else np.zeros(0, dtype=np.uint64))
                continue
            own = hashes[at : at + len(c)]
            at += len(c)
            _, first = np.unique(own, return_index=True)
            out.append(own[np.sort(first)])
    return out


@dataclass(frozen=True)
class Digest:
    filters: np.ndarray  # (k, BITS / 8) bytes
    features: np.ndarray  # features in each filter

    @staticmethod
    def of(hashes: np.ndarray) -> Digest:
        k = -(-len(hashes) // FEATURES)
        bits = np.zeros((k, BITS), dtype=np.uint8)
        which = np.arange(len(hashes)) // FEATURES
        for j in range(HASHES):
            bits[which, (hashes >> np.uint64(11 * j) & np.uint64(BITS - 1)).astype(np.int64)] = 1
        return Digest(np.packbits(bits, axis=1), np.bincount(which, minlength=k))

    def text(self) -> str:
        return ",".join(f"{n}:{row.tobytes().hex()}" for n, row in zip(self.features, self.filters, strict=True))

    @staticmethod
    def parse(text: str) -> Digest:
        parts = [p.split(":") for p in text.split(",")] if text else []
        filters = np.array([np.frombuffer(bytes.fromhex(b), dtype=np.uint8) for _, b in parts], dtype=np.uint8)
        return Digest(filters.reshape(-1, BITS // 8), np.array([int(n) for n, _ in parts], dtype=np.int64))

    def likeness(self, other: Digest) -> float:
        if not len(self.filters) or not len(other.filters):
            return float(len(self.filters) == len(other.filters))
        if np.array_equal(self.filters, other.filters):
            return 1.0
        few, many = sorted((self, other), key=lambda d: (int(d.features.sum()), d.filters.tobytes()))
        a, b = few.filters.view(np.uint64), many.filters.view(np.uint64)
        set_b = np.bitwise_count(b).sum(axis=1, dtype=np.int64)
        total = 0.0
        for row, n in zip(a, few.features, strict=True):
            set_a = int(np.bitwise_count(row).sum())
            common = np.bitwise_count(row & b).sum(axis=1, dtype=np.int64)
            most = np.minimum(set_a, set_b)
            least = set_a * set_b / BITS
            floor = least + CHANCE * (most - least)
            total += int(n) * max(0.0, float(np.max((common - floor) / np.maximum(most - floor, 1e-9))))
        return min(1.0, total / int(few.features.sum()))


def digests(texts: list[bytes], rarity: Rarity) -> list[Digest]:
    return [Digest.of(h) for h in feature_hashes(texts, rarity)]


def digest_documents(docs: DataFrame, rarity: Rarity | None = None) -> DataFrame:
    """The operator by itself: docs with doc_id and text -> doc_id, fingerprint."""
    shared = docs.sparkSession.sparkContext.broadcast(rarity or fit_rarity(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            texts = [x or b"" for x in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([d.text() for d in digests(texts, shared.value)], pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fingerprint string")


def in_descending_order(docs: DataFrame) -> DataFrame:
    """(doc_id, text, donor) such that, within a partition, each row's next document is the next row.

    Ids are dealt into ranges by quantiles of the id column; the first document of each range is also put, as a donor, at the
    end of the range before it. Only the range bounds and these first ids reach the driver; texts are shuffled once.
    """
    ids = docs.select(F.col("doc_id").cast("double").alias("id"), F.length("text").alias("n"))
    size, low, high = ids.agg(F.sum("n"), F.min("id"), F.max("id")).first()
    parts = int(min(10_000, max(docs.sparkSession.sparkContext.defaultParallelism, (size or 0) // PARTITION_BYTES + 1)))
    inner = sorted({q for q in ids.approxQuantile("id", [i / parts for i in range(1, parts)], 0.1 / parts) if low < q} if low is not None else ())
    bounds = [-float("inf"), *inner, float("inf")]
    # bucket 0 has the largest ids; null ids form the last one. No bucket is empty, for the bounds are ids.
    number = F.coalesce(F.col("doc_id").cast("double"), F.lit(float("nan")))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", number.alias("_id"))
    if inner:
        keyed = Bucketizer(splits=bounds, inputCol="_id", outputCol="_b", handleInvalid="keep").transform(keyed)
    else:
        keyed = keyed.withColumn("_b", F.lit(0.0))
    last = len(bounds) - 1
    bucket = F.when(F.col("doc_id").isNull(), last).otherwise(last - 1 - F.col("_b")).cast("int")
    keyed = keyed.withColumn("bucket", bucket).select("doc_id", "text", "bucket")
    heads = [r["head"] for r in keyed.groupBy("bucket").agg(F.max("doc_id").alias("head")).collect()]
    gives = (F.col("bucket") > 0) & F.coalesce(F.col("doc_id").isin([h for h in heads if h is not None]), F.lit(True))
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("donor"))
    other = F.struct((F.col("bucket") - 1).alias("bucket"), F.lit(True).alias("donor"))
    places = F.when(gives, F.array(own, other)).otherwise(F.array(own))
    rows = keyed.withColumn("place", F.explode(places)).select("doc_id", "text", "place.bucket", "place.donor")
    return rows.repartitionById(last + 1, "bucket").sortWithinPartitions("bucket", "donor", F.col("doc_id").desc_nulls_last(), "text")


def edited_text(text: str, following: str) -> str:
    """The last third of the code points replaced by as many first ones (or all) of the following text."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def digest_edits(docs: DataFrame, rarity: Rarity | None = None) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    shared = docs.sparkSession.sparkContext.broadcast(rarity or fit_rarity(docs))
    # after the last document comes the first: the one with the largest id, of equals the one with the least text
    top = docs.agg(F.max(F.col("doc_id").cast("long"))).first()[0]
    first = docs.where(F.col("doc_id").eqNullSafe(F.lit(top))).select("text").orderBy(F.col("text").asc_nulls_first()).limit(1).collect()
    first_text = (first[0]["text"] or "") if first else ""
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = [x.split()[0] for x in schema.split(", ")]

    def rows(pending: list[tuple], rarity: Rarity) -> pa.RecordBatch:
        """pending: (doc_id, text, digest) in order; each but the last is finished by the one after it."""
        here = pending[:-1]
        edited = [edited_text(a[1], b[1]).encode() for a, b in zip(here, pending[1:], strict=True)]
        new = digests(edited, rarity)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([a[0] for a in here], pa.int64()),
                pa.array([len(a[1]) for a in here], pa.int64()),
                pa.array([hashlib.sha256(e).hexdigest() for e in edited], pa.string()),
                pa.array([a[2].text() for a in here], pa.string()),
                pa.array([d.text() for d in new], pa.string()),
                pa.array([a[2].likeness(d) for a, d in zip(here, new, strict=True)], pa.float64()),
                pa.array([a[2].likeness(b[2]) for a, b in zip(here, pending[1:], strict=True)], pa.float64()),
            ],
            names=names,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarity, waiting = shared.value, []
        for batch in small(batches):
            ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            donors = batch.column(2).to_pylist()
            step = 256
            for lo in range(0, len(ids), step):
                part = slice(lo, lo + step)
                found = digests([t.encode() for t in texts[part]], rarity)
                for i, t, d, donor in zip(ids[part], texts[part], found, donors[part], strict=True):
                    if donor and not waiting:  # of equal first ids only the first row follows
                        continue
                    waiting.append((i, t, d))
                    if donor:
                        yield rows(waiting, rarity)
                        waiting = []
                if len(waiting) > 1:
                    yield rows(waiting, rarity)
                    waiting = waiting[-1:]
        if waiting:  # the last of all
            yield rows([*waiting, (None, first_text, digests([first_text.encode()], rarity)[0])], rarity)

    return in_descending_order(docs).select("doc_id", "text", "donor").mapInArrow(run, schema)


def op2_improbable_features(spark, sf_dir: str) -> DataFrame:
    return digest_edits(read(spark, sf_dir, "documents"))
