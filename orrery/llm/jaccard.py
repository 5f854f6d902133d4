"""Exact Jaccard join of word-shingle sets by a token-group matrix.

Two documents link when ``den * |x & y| >= num * |x | y|`` over their distinct shingles. The result has one row per document:
its set size and its component (smallest doc_id that is reachable by links).

How it goes, with nothing that holds one row per pair of a group of copies:

1. Documents with equal sets are one *class*; from here on classes stand for their copies.
2. Which classes can link at all, losslessly: linked sets of a size level differ in at most ``H`` tokens. Tokens are dealt by
   hash into ``H + 1 + E`` parts; at most H parts differ, so linked sets agree in a whole non-empty part unless both have more
   than E empty parts, and sets with so many emit their prefix tokens besides (prefix filtering). A signature is the hash of one
   part's tokens. A class also signs at the level above if it can have partners there. Every task reduces equal signatures to
   one leader before the shuffle, so a signature that a third of all rows share has one row per task.
3. Token-group matrix with one group: a class's overlap with any other class is at most its overlap with the union of all
   others. Classes whose bound misses the threshold are done; that is most of those which share passages or are edited further.
4. Classes that are left and share signatures, connected, form *clusters*; all links lie within clusters. A cluster is dealt
   into blocks of bounded size, with a few pivot classes in each; a block is solved in memory (5). Most clusters are one block.
   Of larger ones, what has been linked so far (over the pivots, usually all of a cluster of near copies) becomes the groups:
   blocks of one component, or of several small ones. Each block stores the union of its tokens as a bit map. Every class is
   bounded against the bit maps of the cluster's blocks, except those of its own component only; blocks that qualify are
   opened for it, and its overlaps with their classes of other components are counted.
5. Within a block the same in small: classes with an equal least token (a min-hash) form groups, the matrix of groups and tokens
   bounds each class's overlap with each group, and only qualifying groups are opened, for classes not yet in its component.

The result of 4 and 5 is a spanning forest of the links, never all pairs; its connected components are the result.

The tokens of classes with candidates are computed anew from the texts; a Bloom filter of at most ``BLOOM_BITS`` bits (fixed,
16 MB) tells the tasks which classes are needed. When it fills up it lets more classes through; it never loses one.

A class is known by a hash of 64 bits while links are sought and by another 64 bits besides where documents join it, so two
different sets are taken for one only if 128 bits agree. Of two sets that agree in the first 64 bits alone (one pair is expected
among some 4 * 10**9 sets) one is left without links.

Edge cases: null and empty texts and texts of white space have empty sets, size 0, and are their own component; texts with
fewer words than a shingle have one shingle; a text of any length is one set in memory (8 bytes a shingle); repeated rows of an
id get one row each; a null id is carried (its component is the least id of its component or null); an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import cut, read, release, small, tidy
from orrery.llm.components import connected_components
from orrery.llm.shingles import mix, second_hash, set_hash, shingle_sets

#: Most bits of the filter that tells which classes have candidates.
BLOOM_BITS = 1 << 27
#: Signatures that a task reduces at a time.
CHUNK = 1 << 19
#: Extent of a block of a cluster: bytes of tokens, and classes.
BLOCK_BYTES, BLOCK_CLASSES = 4 << 20, 4096
#: Classes of a cluster that stand in each of its blocks.
PIVOTS = 8
#: Bits of a block's map for each of its tokens, and most bits of a map.
MAP_SPREAD, MAP_BITS = 8, 1 << 23
#: Queries that a task holds against one block.
QUERIES = 4096
#: Sizes of consecutive levels grow by this factor; it must exceed den / num.
LEVEL_RATIO = 1.5


@dataclass(frozen=True)
class Threshold:
    num: int
    den: int
    width: int

    def __post_init__(self) -> None:
        if not 0 < self.num <= self.den or self.den / self.num >= LEVEL_RATIO:
            raise ValueError("the threshold must lie above 2/3 and be at most 1")


#: Three words and 0.9 are what the query is asked for; five words and 0.8 are the default of near-duplicate stages.
QUERY = Threshold(90, 100, 3)
NEAR_DUPLICATES = Threshold(80, 100, 5)


class Signer:
    """Signatures of sorted token sets."""

    def __init__(self, t: Threshold):
        self.t = t
        self.lows = [1]

    def level(self, n: int) -> int:
        while self.lows[-1] <= n:
            self.lows.append(max(self.lows[-1] + 1, int(self.lows[-1] * LEVEL_RATIO)))
        return int(np.searchsorted(self.lows, n, side="right")) - 1

    def parts(self, level: int) -> tuple[int, int]:
        """Number of parts at a level, and how many of them may be empty."""
        self.level(self.lows[min(level, len(self.lows) - 1)])
        while len(self.lows) <= level + 1:
            self.level(self.lows[-1])
        high = self.lows[level + 1] - 1
        most = 2 * high * (self.t.den - self.t.num) // (self.t.den + self.t.num)
        if not most:
            return 0, 0
        slack = 1 + math.ceil(1.5 * most * math.exp(-self.lows[level] / (most + 1)))
        return most + 1 + slack, slack

    def sign(self, tokens: np.ndarray) -> np.ndarray:
        n = len(tokens)
        if not n:
            return np.zeros(0, dtype=np.int64)
        own = self.level(n)
        levels = [own]
        if n * self.t.den // self.t.num >= self.lows[own + 1]:
            levels.append(own + 1)
        weights = mix(tokens ^ np.uint64(0xD6E8FEB86659FD93))
        out = []
        for level in levels:
            parts, slack = self.parts(level)
            if not parts:
                continue
            part = (tokens >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
            at = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
            salt = np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
            out.append(mix(np.add.reduceat(weights, at) ^ mix(part[at] + salt)))
            if parts - len(at) > slack:
                prefix = n - -(-n * self.t.num // self.t.den) + 1
                out.append(mix(tokens[:prefix] + salt))
        return np.concatenate(out).view(np.int64) if out else np.zeros(0, dtype=np.int64)


def _bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def document_classes(docs: DataFrame, t: Threshold) -> DataFrame:
    """(doc_id, n_shingles, cls, chk); cls and chk are hashes of the set, null if it is empty."""
    names = ["doc_id", "n_shingles", "cls", "chk"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            sizes, classes, checks = [], [], []
            for tokens in shingle_sets(_bytes(batch.column(1)), t.width):
                sizes.append(len(tokens))
                classes.append(set_hash(tokens) if len(tokens) else None)
                checks.append(second_hash(tokens) if len(tokens) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (sizes, classes, checks))], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), "doc_id long, n_shingles long, cls long, chk long")


def _runs(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (key, value) pairs in order, and the index of the first pair of each pair's key."""
    order = np.lexsort((value, key))
    key, value = key[order], value[order]
    if not len(key):
        return key, value, np.zeros(0, dtype=np.int64)
    new = np.concatenate(([True], (key[1:] != key[:-1]) | (value[1:] != value[:-1])))
    key, value = key[new], value[new]
    head = np.concatenate(([True], key[1:] != key[:-1]))
    return key, value, np.maximum.accumulate(np.where(head, np.arange(len(key)), 0))


_SIGNATURE, _EDGE = 0, 1


def candidate_edges(source: DataFrame, t: Threshold, texts: bool) -> DataFrame:
    """(a, b): class a shares a signature with class b < a. Every class that shares one is an a or a b.

    The sets come from a column of texts, or else from one of tokens.
    """
    names = ["kind", "key", "cls"]

    def emit(kind: int, key: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, dtype=np.int8)), pa.array(key), pa.array(value)], names=names)

    def flush(signatures: list[np.ndarray], classes: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, value, head = _runs(np.concatenate(signatures), np.concatenate(classes))
        first = head == np.arange(len(key))
        yield emit(_SIGNATURE, key[first], value[first])
        a, b, _ = _runs(value[~first], value[head[~first]])
        yield emit(_EDGE, a, b)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer, signatures, classes, held = Signer(t), [], [], 0
        for batch in small(batches):
            sets = shingle_sets(_bytes(batch.column(0)), t.width) if texts else (np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in batch.column(0))
            for tokens in sets:
                if len(got := signer.sign(tokens)):
                    signatures.append(got)
                    classes.append(np.full(len(got), set_hash(tokens), dtype=np.int64))
                    held += len(got)
                if held >= CHUNK:
                    yield from flush(signatures, classes)
                    signatures, classes, held = [], [], 0
        if held:
            yield from flush(signatures, classes)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key = last_head = None
        for batch in batches:
            kind, key, value = (np.asarray(batch.column(i)) for i in range(3))
            ends = [(key[kind == _EDGE], value[kind == _EDGE])]
            key, value = key[kind == _SIGNATURE], value[kind == _SIGNATURE]
            if len(key):
                start = np.maximum.accumulate(np.where(np.concatenate(([True], key[1:] != key[:-1])), np.arange(len(key)), 0))
                head = value[start]
                if last_key is not None and key[0] == last_key:
                    head[key == last_key] = last_head
                last_key, last_head = key[-1], head[-1]
                ends.append((value[head != value], head[head != value]))
            a, b, _ = _runs(*(np.concatenate([x[k] for x in ends]) for k in (0, 1)))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    rows = source.select("text" if texts else "tokens").mapInArrow(tidy(sign), "kind byte, key long, cls long")
    pairs = rows.repartition("key").sortWithinPartitions("kind", "key", "cls").mapInArrow(tidy(link), "a long, b long")
    return pairs.distinct()


class Bloom:
    """A bit map of classes; ``may_hold`` errs on one side only."""

    def __init__(self, words: np.ndarray):
        self.words, self.mask = words, np.uint64(64 * len(words) - 1)

    def may_hold(self, cls: int) -> bool:
        x = np.array([cls], dtype=np.int64).view(np.uint64)
        at = np.concatenate((x & self.mask, (x >> np.uint64(32)) & self.mask))
        return bool((self.words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).all())


def bloom_of(classes: DataFrame, count: int) -> Bloom:
    bits = 1 << 16
    while bits < min(32 * count, BLOOM_BITS):
        bits *= 2
    at = F.explode(F.array(F.col("cls").bitwiseAND(bits - 1), F.shiftrightunsigned("cls", 32).bitwiseAND(bits - 1)))
    words = classes.select(at.alias("at")).select(F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, cast(at & 63 as int))").alias("bit"))
    table = words.groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
    out = np.zeros(bits // 64, dtype=np.uint64)
    out[np.asarray(table["word"])] = np.asarray(table["bit"]).view(np.uint64)
    return Bloom(out)


def _needed_sets(batches: Iterator[pa.RecordBatch], t: Threshold, needed: Bloom) -> Iterator[tuple[int, np.ndarray]]:
    """(class, tokens) of the classes in the filter, each once, from batches whose first column is the text."""
    seen: set[int] = set()
    for batch in small(batches):
        for tokens in shingle_sets(_bytes(batch.column(0)), t.width):
            if len(tokens) and (cls := set_hash(tokens)) not in seen and needed.may_hold(cls):
                seen.add(cls)
                yield cls, tokens


def class_tokens(docs: DataFrame, t: Threshold, needed: Bloom) -> DataFrame:
    """(cls, chk, tokens) of the classes in the filter, one row for each task that has them; tokens are sorted little-endian 64-bit numbers."""
    shared = docs.sparkSession.sparkContext.broadcast(needed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, int, bytes]] = []
        held = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.binary()))], names=["cls", "chk", "tokens"])

        for cls, tokens in _needed_sets(batches, t, shared.value):
            rows.append((cls, second_hash(tokens), tokens.tobytes()))
            held += len(tokens)
            if held >= CHUNK // 2:
                yield out()
                rows.clear()
                held = 0
        yield out()

    return docs.select("text").mapInArrow(tidy(run), "cls long, chk long, tokens binary")


def shared_tokens(docs: DataFrame, t: Threshold, needed: Bloom, total: int) -> DataFrame:
    """(cls, bound, n) of the classes in the filter: at least as many as a class has tokens that some other such class has too, and its size.

    A task takes its classes in chunks. It counts what the classes of a chunk share, and sends each token once, with its class's
    number in the chunk, or with ``nobody`` if it was counted: 6 bytes a token, in packed arrays of a chunk and a bucket of tokens.
    Buckets are as many as keep each to about 2**20 of ``total`` tokens. Only 32 bits are kept of a token besides its bucket; tokens
    that then look alike, like a class that several chunks have, only raise a bound.
    """
    shared = docs.sparkSession.sparkContext.broadcast(needed)
    depth = max(4, (max(total, 1) >> 20).bit_length())
    nobody, most = 0xFFFF, 0xFFF0
    schema = "bucket long, chunk long, left binary, right binary"
    names = [x.split()[0] for x in schema.split(", ")]

    def emit(rows: list[tuple[int | None, int, bytes, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=names)

    def flush(chunk: int, sets: list[np.ndarray], classes: list[int]) -> pa.RecordBatch:
        """The chunk's own row (no bucket): classes, and pairs of what they share here and their size; then a row for each bucket."""
        who = np.repeat(np.arange(len(sets), dtype=np.int32), [len(x) for x in sets])
        token, first, which, times = np.unique(np.concatenate(sets), return_index=True, return_inverse=True, return_counts=True)
        own = np.bincount(who[times[which] > 1], minlength=len(sets))
        cls = np.array(classes, dtype="<i8")
        number = np.where(times > 1, nobody, who[first]).astype("<u2")
        short = (token >> np.uint64(32 - depth) & np.uint64(0xFFFFFFFF)).astype("<u4")
        bucket = (token >> np.uint64(64 - depth)).astype(np.int64)
        at = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
        sizes = np.array([len(x) for x in sets], dtype="<i8")
        return emit([(None, chunk, cls.tobytes(), np.concatenate((own.astype("<i8"), sizes)).tobytes())] + [(int(bucket[lo]), chunk, short[lo:hi].tobytes(), number[lo:hi].tobytes()) for lo, hi in zip(at[:-1], at[1:], strict=True)])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, classes, held, chunk = [], [], 0, TaskContext.get().partitionId() << 32
        for cls, tokens in _needed_sets(batches, t, shared.value):
            sets.append(tokens)
            classes.append(cls)
            held += len(tokens)
            if held >= CHUNK or len(sets) >= most:
                yield flush(chunk, sets, classes)
                sets, classes, held, chunk = [], [], 0, chunk + 1
        if sets:
            yield flush(chunk, sets, classes)

    def in_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Chunks' own rows as they are; of each bucket and chunk the classes' numbers and how many tokens they share."""

        def solve(rows: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
            parts = [np.frombuffer(r[1], dtype="<u4") for r in rows]
            _, which, times = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
            ends, out = np.cumsum([len(x) for x in parts]), []
            for (chunk, _, number), x, end in zip(rows, parts, ends, strict=True):
                numbers = np.frombuffer(number, dtype="<u2")
                found, n = np.unique(numbers[(times[which[end - len(x) : end]] > 1) & (numbers != nobody)], return_counts=True)
                if len(found):
                    out.append((0, chunk, found.astype("<u2").tobytes(), n.astype("<u4").tobytes()))
            return emit(out)

        here, rows = None, []
        for batch in batches:
            heads = []
            for bucket, chunk, left, right in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket is None:
                    heads.append((None, chunk, left, right))
                    continue
                if bucket != here:
                    if rows:
                        yield solve(rows)
                    here, rows = bucket, []
                rows.append((chunk, left, right))
            if heads:
                yield emit(heads)
        if rows:
            yield solve(rows)

    def in_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each chunk first its own row, then what its classes share in buckets."""

        def out(cls: np.ndarray, bound: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (cls, bound, sizes)], names=["cls", "bound", "n"])

        here, cls, bound, sizes = None, None, None, None
        for batch in batches:
            for bucket, chunk, left, right in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket is None:
                    if cls is not None:
                        yield out(cls, bound, sizes)
                    here, cls = chunk, np.frombuffer(left, dtype="<i8")
                    bound, sizes = np.frombuffer(right, dtype="<i8").reshape(2, -1).copy()
                elif chunk == here:
                    bound[np.frombuffer(left, dtype="<u2")] += np.frombuffer(right, dtype="<u4")
        if cls is not None:
            yield out(cls, bound, sizes)

    rows = docs.select("text").mapInArrow(tidy(local), schema)
    place = F.when(F.col("bucket").isNull(), F.col("chunk")).otherwise(F.col("bucket"))
    rows = rows.repartition(place).sortWithinPartitions("bucket").mapInArrow(tidy(in_buckets), schema)
    rows = rows.repartition("chunk").sortWithinPartitions("chunk", F.col("bucket").asc_nulls_first()).mapInArrow(tidy(in_chunks), "cls long, bound long, n long")
    return rows.groupBy("cls").agg(F.sum("bound").alias("bound"), F.max("n").alias("n"))


def _spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices starts[k] .. starts[k] + lengths[k] - 1 of all k, one after the other."""
    before = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    return np.repeat(starts - before, lengths) + np.arange(lengths.sum())


def _overlaps(hit: np.ndarray, tokens: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """How many of tokens[starts[k] : starts[k] + lengths[k]] are hit, for each k; no length is 0."""
    at = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    return np.add.reduceat(hit[tokens[_spans(starts, lengths)]], at, dtype=np.int64)


def block_components(sets: list[np.ndarray], t: Threshold) -> np.ndarray:
    """For each of the sorted sets the first one of its component; a token-group matrix in memory."""
    n = len(sets)
    _, gid = np.unique(np.array([x[0] for x in sets], dtype=np.uint64), return_inverse=True)
    order = np.argsort(gid, kind="stable")
    gid, sets = gid[order], [sets[i] for i in order]
    groups = int(gid[-1]) + 1
    sizes = np.array([len(x) for x in sets])
    _, token, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    who = np.repeat(np.arange(n), sizes)
    common = times[token] > 1  # what only one set has is in no overlap
    token, who = token[common], who[common]
    of = np.searchsorted(who, np.arange(n + 1))
    kept = np.diff(of)
    # the matrix: of each token the groups whose union holds it
    pairs = np.unique(token * groups + gid[who])
    group_of, starts = pairs % groups, np.searchsorted(pairs, np.arange(len(times) + 1) * groups)
    first, last = np.searchsorted(gid, np.arange(groups)), np.searchsorted(gid, np.arange(groups), side="right")
    component, hit = np.arange(n), np.zeros(len(times), dtype=bool)
    for x in range(n):
        need = -(-t.num * sizes[x] // t.den)
        if kept[x] < need:
            continue
        own = token[of[x] : of[x + 1]]
        bound = np.bincount(group_of[_spans(starts[own], starts[own + 1] - starts[own])], minlength=groups)
        opened = np.flatnonzero(bound >= need)
        members = _spans(first[opened], last[opened] - first[opened])
        members = members[(members > x) & (component[members] != component[x]) & (kept[members] >= need) & (t.num * sizes[members] <= t.den * sizes[x])]
        if not len(members):
            continue
        hit[own] = True
        both = _overlaps(hit, token, of[members], kept[members])
        hit[own] = False
        linked = members[t.den * both >= t.num * (sizes[members] + sizes[x] - both)]
        if len(linked):
            merged = np.unique(np.append(component[linked], component[x]))
            component[np.isin(component, merged)] = merged[0]
    out = np.empty(n, dtype=np.int64)
    out[order] = order[component]
    return out


def _solved_blocks(placed: DataFrame, t: Threshold) -> DataFrame:
    """placed: (cls, block, tokens, many) -> (cls, root, many), root being a class of the same block that links reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(classes: list[int], sets: list[np.ndarray], many: bool) -> pa.RecordBatch:
            cls = np.array(classes, dtype=np.int64)
            root = cls[block_components(sets, t)] if len(sets) > 1 else cls
            return pa.RecordBatch.from_arrays([pa.array(cls), pa.array(root), pa.array(np.full(len(cls), many))], names=["cls", "root", "many"])

        block, classes, sets, many = None, [], [], False
        for batch in batches:
            for cls, key, x, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
                if key != block:
                    if classes:
                        yield solve(classes, sets, many)
                    block, classes, sets, many = key, [], [], m
                if not classes or classes[-1] != cls:  # a pivot stands in its own block already
                    classes.append(cls)
                    sets.append(np.frombuffer(x.as_buffer(), dtype=np.uint64))
        if classes:
            yield solve(classes, sets, many)

    ordered = placed.select("cls", "block", "tokens", "many").repartition("block").sortWithinPartitions("block", "cls")
    return ordered.mapInArrow(tidy(run), "cls long, root long, many boolean")


def _extent(groups: str) -> list:
    """Aggregates of a group's blocks: their number follows from bytes and classes."""
    return [F.ceil(F.greatest(F.sum("bytes") / BLOCK_BYTES, F.count("*") / BLOCK_CLASSES)).cast("int").alias(groups)]


def cluster_components(tokens: DataFrame, clusters: DataFrame, t: Threshold) -> DataFrame:
    """(cls, component) of the classes; clusters: (cls, grp), and all links lie within a grp."""
    sized = cut(tokens.select("cls", F.length("tokens").alias("bytes")).join(clusters, "cls"))
    slot = F.pmod(F.xxhash64("cls"), F.lit(PIVOTS))
    pivots = F.array_compact(F.array(*[F.min(F.when(slot == k, F.col("cls"))) for k in range(PIVOTS)]))
    extent = cut(sized.groupBy("grp").agg(*_extent("blocks"), pivots.alias("pivots")))
    many = F.col("blocks") > 1
    at = lambda k: F.xxhash64("grp", k)
    placed = sized.join(extent.select("grp", "blocks"), "grp").select("cls", at(F.pmod(F.xxhash64("cls", F.lit(1)), "blocks").cast("int")).alias("block"), many.alias("many"))
    repeated = extent.where(many).select("grp", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("k"), "pivots")
    repeated = repeated.select(F.explode("pivots").alias("cls"), at(F.col("k")).alias("block"), F.lit(True).alias("many"))
    solved = cut(_solved_blocks(placed.union(repeated).join(tokens.select("cls", "tokens"), "cls"), t))
    small_ones = solved.where("not many").select("cls", F.col("root").alias("component"))
    large = solved.where("many")
    if large.isEmpty():
        return small_ones
    within = _components_of(large.select("cls").distinct(), large.select(F.col("cls").alias("a"), F.col("root").alias("b")))
    members = cut(sized.join(within, "cls").select("cls", "grp", "component", "bytes"))
    torn = members.groupBy("grp").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("grp")
    several = cut(members.join(torn, "grp", "left_semi").select(*members.columns))
    if several.isEmpty():
        return small_ones.union(within)
    across = cut(group_links(tokens, several, t))
    over = _components_of(members.select(F.col("component").alias("cls")).distinct(), across)
    joined = members.select("cls", "component").join(over.select(F.col("cls").alias("component"), F.col("component").alias("whole")), "component")
    return small_ones.union(joined.select("cls", F.col("whole").alias("component")))


def _components_of(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(cls, component) of all nodes; those without edges are their own component."""
    found = connected_components(edges).select(F.col("node").alias("cls"), F.col("label").alias("component"))
    return cut(nodes.join(found, "cls", "left").select("cls", F.coalesce("component", "cls").alias("component")))


def _bits(tokens: np.ndarray, bits: int) -> np.ndarray:
    return (tokens >> np.uint64(20)) & np.uint64(bits - 1)


def _in_map(tokens: np.ndarray, packed: np.ndarray) -> np.ndarray:
    at = _bits(tokens, 8 * len(packed))
    return packed[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1


def group_links(tokens: DataFrame, members: DataFrame, t: Threshold) -> DataFrame:
    """(a, b) components that a link joins. members: (cls, grp, component, bytes) of large clusters with several components.

    Groups are blocks of one component, or of several small ones. Each stores its token union as a bit map; classes are bounded
    against the maps of their cluster, and only blocks that qualify are opened.
    """
    sizes = cut(members.groupBy("grp", "component").agg(*_extent("own"), F.sum("bytes").alias("bytes"), F.count("*").alias("n")))
    rest = sizes.where("own = 1").groupBy("grp").agg(F.ceil(F.greatest(F.sum("bytes") / BLOCK_BYTES, F.sum("n") / BLOCK_CLASSES)).cast("int").alias("mixed"))
    plan = cut(sizes.select("grp", "component", "own").join(rest, "grp", "left"))
    single = F.col("own") > 1
    number = F.when(single, F.pmod(F.xxhash64("cls"), "own")).otherwise(F.pmod(F.xxhash64("component"), F.coalesce("mixed", F.lit(1))))
    block = F.xxhash64("grp", F.when(single, F.col("component")), number)
    placed = members.join(plan, ["grp", "component"]).select("cls", "grp", "component", block.alias("block"), F.when(single, F.col("component")).alias("only"))
    placed = cut(placed.join(tokens.select("cls", "tokens"), "cls"))

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(sets: list[np.ndarray]) -> bytes:
            union = np.unique(np.concatenate(sets))
            bits = 1 << 10
            while bits < min(MAP_SPREAD * len(union), MAP_BITS):
                bits *= 2
            table = np.zeros(bits, dtype=np.uint8)
            table[_bits(union, bits).astype(np.int64)] = 1
            return np.packbits(table, bitorder="little").tobytes()

        def row(key: tuple, sets: list[np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([k], pa.int64()) for k in key] + [pa.array([packed(sets)], pa.binary())], names=["block", "grp", "only", "map"])

        last, sets = None, []
        for batch in batches:
            for *key, x in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3), strict=True):
                if last is not None and key != last:
                    yield row(last, sets)
                    sets = []
                last = key
                sets.append(np.frombuffer(x.as_buffer(), dtype=np.uint64))
        if sets:
            yield row(last, sets)

    matrix = cut(placed.select("block", "grp", "only", "tokens").repartition("block").sortWithinPartitions("block").mapInArrow(tidy(maps), "block long, grp long, only long, map binary"))

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each block first its classes (no map), then the maps of its cluster's later blocks."""
        here, classes, components, sets, flat = None, [], [], [], None
        for batch in batches:
            for block, other, cls, component, only, x, m in zip(*(batch.column(k).to_pylist() for k in range(5)), batch.column(5), batch.column(6), strict=True):
                if block != here:
                    here, classes, components, sets, flat = block, [], [], [], None
                if other is None:
                    classes.append(cls)
                    components.append(component)
                    sets.append(np.frombuffer(x.as_buffer(), dtype=np.uint64))
                    continue
                if flat is None:
                    flat, sizes = np.concatenate(sets), np.array([len(s) for s in sets])
                    at = np.concatenate(([0], np.cumsum(sizes)[:-1]))
                    of, own = np.array(classes, dtype=np.int64), np.array(components, dtype=np.int64)
                bound = np.add.reduceat(_in_map(flat, np.frombuffer(m.as_buffer(), dtype=np.uint8)), at, dtype=np.int64)
                opened = t.den * bound >= t.num * sizes
                if only is not None:
                    opened &= own != only
                yield pa.RecordBatch.from_arrays([pa.array(of[opened]), pa.array(np.full(int(opened.sum()), other, dtype=np.int64))], names=["cls", "block"])

    nothing = F.lit(None)
    queries = placed.select("block", nothing.cast("long").alias("other"), "cls", "component", nothing.cast("long").alias("only"), "tokens", nothing.cast("binary").alias("map"))
    theirs = matrix.select("grp", F.col("block").alias("other"), "only", "map")
    against = matrix.select("grp", "block").join(theirs, "grp").where("other >= block")  # a link is found from either end
    against = against.select("block", "other", nothing.cast("long").alias("cls"), nothing.cast("long").alias("component"), "only", nothing.cast("binary").alias("tokens"), "map")
    asked = queries.union(against).repartition("block").sortWithinPartitions("block", F.col("other").asc_nulls_first())
    opened = cut(asked.mapInArrow(tidy(bounds), "cls long, block long"))
    parts = cut(opened.groupBy("block").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("parts")))
    asking = opened.join(parts, "block").select("cls", F.xxhash64("block", F.pmod(F.xxhash64("cls"), "parts").cast("int")).alias("unit"))
    asking = asking.join(placed.select("cls", "component", "tokens"), "cls").select("unit", F.lit(True).alias("asks"), "component", "tokens")
    held = placed.join(parts, "block").select(F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "block", "component", "tokens")
    held = held.select(F.xxhash64("block", "part").alias("unit"), F.lit(False).alias("asks"), "component", "tokens")

    def overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each unit first the classes of the block, then those that ask."""
        here, components, sets, known = None, [], [], None
        for batch in batches:
            found: set[tuple[int, int]] = set()
            for unit, asks, component, x in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3), strict=True):
                if unit != here:
                    here, components, sets, known = unit, [], [], None
                tokens = np.frombuffer(x.as_buffer(), dtype=np.uint64)
                if not asks:
                    components.append(component)
                    sets.append(tokens)
                    continue
                if known is None:
                    known, which = np.unique(np.concatenate(sets), return_inverse=True)
                    sizes, own, hit = np.array([len(s) for s in sets]), np.array(components, dtype=np.int64), np.zeros(len(known), dtype=bool)
                    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
                mine = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
                mine = mine[known[mine] == tokens]
                others = np.flatnonzero((own != component) & (t.num * sizes <= t.den * len(tokens)) & (t.num * len(tokens) <= t.den * sizes))
                if not len(others):
                    continue
                hit[mine] = True
                both = _overlaps(hit, which, starts[others], sizes[others])
                hit[mine] = False
                linked = own[others[t.den * both >= t.num * (sizes[others] + len(tokens) - both)]]
                found |= {(component, int(c)) for c in np.unique(linked)}
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    units = held.union(asking).repartition("unit").sortWithinPartitions("unit", "asks")
    return units.mapInArrow(tidy(overlaps), "a long, b long").distinct()


def class_components(docs: DataFrame, t: Threshold, total: int) -> DataFrame:
    """(cls, chk, component class) of the classes that may link with another one. total: all documents' shingles."""
    spark = docs.sparkSession
    edges = cut(candidate_edges(docs, t, texts=True))
    classes = cut(edges.select(F.explode(F.array("a", "b")).alias("cls")).distinct())
    release(spark)
    bounds = shared_tokens(docs, t, bloom_of(classes, classes.count()), total)
    opened = cut(bounds.where(F.col("bound") * t.den >= F.col("n") * t.num).select("cls"))
    release(spark)
    again = class_tokens(docs, t, bloom_of(opened, opened.count()))
    tokens = cut(again.join(opened, "cls", "left_semi").groupBy("cls").agg(F.min(F.struct("chk", "tokens")).alias("x")).select("cls", "x.*"))
    clusters = connected_components(candidate_edges(tokens, t, texts=False)).select(F.col("node").alias("cls"), F.col("label").alias("grp"))
    release(spark)
    found = cluster_components(tokens, clusters, t)
    return found.join(tokens.select("cls", "chk"), "cls").select("cls", "chk", "component")


def jaccard_components(docs: DataFrame, t: Threshold = NEAR_DUPLICATES) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    classed = cut(document_classes(docs, t))
    total = classed.agg(F.sum("n_shingles")).first()[0] or 0
    linked = cut(class_components(docs, t, total))
    # one row per class before anything is joined; documents whose class is theirs alone are not looked up
    classes = classed.where("cls is not null").groupBy("cls", "chk").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"))
    named = cut(classes.join(linked, ["cls", "chk"], "left").where("copies > 1 or component is not null"))
    least = named.where("component is not null").groupBy("component").agg(F.min("first").alias("least"))
    lookup = cut(named.join(least, "component", "left").select(F.col("cls"), F.col("chk"), F.when(F.col("component").isNull(), F.col("first")).otherwise(F.col("least")).alias("component_id")))
    found = classed.join(lookup, ["cls", "chk"], "left")
    return found.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def op3_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents"), QUERY)


#: The same rows by brute force: all pairs of different sets that share a shingle, and everything that their links reach.
OP3_SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)] END)) AS s FROM w),
c AS MATERIALIZED (SELECT min(doc_id) AS c, s, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY s),
t AS MATERIALIZED (SELECT c, n, unnest(s) AS t FROM c),
e AS MATERIALIZED (SELECT a.c AS a, b.c AS b FROM t a JOIN t b ON a.t = b.t AND a.c <> b.c GROUP BY a.c, b.c HAVING 100 * count(*) >= 90 * (any_value(a.n) + any_value(b.n) - count(*))),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
l AS (SELECT a, min(b) AS b FROM r GROUP BY a)
SELECT doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(least(c.c, l.b), c.c, doc_id) AS component_id FROM s LEFT JOIN c ON s.s = c.s LEFT JOIN l ON l.a = c.c"""
