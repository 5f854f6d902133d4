"""Best-fit packing by length-histogram planning.

Documents become token pieces of at most ``capacity`` ids. Only the histogram of piece lengths, which has at most
``capacity`` rows at any corpus size, reaches the driver. Best-fit decreasing runs there over *counts*: bins are kept as
(free space -> runs of equal bins), so the plan is a list of runs "pieces of length L with ranks a..b go to bins
s..s+(b-a) at offset o". Pieces then take their slots by their rank within their length.

Ranks need no global sort and no task per length: a piece is numbered within its task and length while it is written to the
checkpoint, and the tasks' counts per length are added up (one row per task and length).

Edge cases: a null text is an empty one; an empty text is the end id alone (one piece of length 1); repeated rows are packed
as often as they occur; null ids are carried through; a text of any length is tokenized whole, its ids in memory at once; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm.common import cut, read, small, tidy

CAPACITY = 2048
END_ID = 0
VOCABULARY = "word_bpe_49k.json"
#: Words whose ids a worker remembers at most.
CACHE_WORDS = 200_000
#: Punctuation that may follow a word; the tokenizer always separates it from letters before it.
_TAIL = ".,;:!?|#$%&*"
_RUN_COLUMNS = ("length", "rank", "count", "bin", "offset")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_characters() -> list[str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


class WordIds(dict):
    """White-space separated word -> its ids as little-endian 32-bit bytes.

    The vocabulary's pre-tokenizer never joins text across white space, so a text's ids are its words' ids in order. Words of
    letters only go to the BPE model directly; everything else goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.alphabet = _byte_characters()

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _ids(self, word: str) -> bytes:
        low = word.lower()
        if low.isalpha() and max(low) < "ɐ":
            spelled = low if low.isascii() else "".join(map(self.alphabet.__getitem__, low.encode()))
            return np.asarray([t.id for t in self.model.tokenize(spelled)], dtype="<u4").tobytes()
        return self.whole(word)

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        core = word.rstrip(_TAIL)
        if core and core != word and core.isalpha() and core.lower().isalpha():  # İ becomes a letter and a mark, which binds what follows
            ids = self[core] + self[word[len(core) :]]
        else:
            ids = self._ids(word)
        self[word] = ids
        return ids

    def text(self, text: str) -> bytes:
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # str.split takes these for white space, the tokenizer doesn't
            return self.whole(text)
        return b"".join([self[w] for w in text.split()])


_words: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _words:
        _words[path] = WordIds(path)
    return _words[path]


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, emit_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, ids (null unless asked for), row, task, task_rank.

    task and task_rank number the pieces of equal length within a task, row the documents' rows, so that copies of a document
    can be told apart; they hold only once the result is checkpointed.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, row long, task long, task_rank long"
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen, task = word_ids(vocabulary_path(vocabulary)), Counter(), TaskContext.get().partitionId()
        step, number = 4 * capacity, task << 40
        for batch in small(batches):
            rows: list[list] = [[] for _ in names]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = words.text(text.as_py() or "") + END_ID.to_bytes(4, "little")
                for piece, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    n = len(part) // 4
                    row = (doc_id, piece, at // 4, n, zlib.crc32(part), part if emit_ids else None, number, task, seen[n])
                    seen[n] += 1
                    for column, value in zip(rows, row, strict=True):
                        column.append(value)
                number += 1
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds, strict=True)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), schema)


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Best-fit decreasing over counts. Returns runs (length, rank, count, bin, offset), sorted by length and rank.

    Lengths go from long to short. Pieces of a length fill the bins with the least sufficient free space first; what is left
    opens new bins, each of which takes as many pieces of this length as fit.
    """
    free: dict[int, list[tuple[int, int]]] = {}
    levels: set[int] = set()
    runs: list[tuple[int, int, int, int, int]] = []
    bins = 0

    def keep(space: int, first: int, count: int) -> None:
        if space and count:
            free.setdefault(space, []).append((first, count))
            levels.add(space)

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left and (fit := min((x for x in levels if x >= length), default=0)):
            first, count = free[fit].pop()
            if not free[fit]:
                del free[fit]
                levels.discard(fit)
            take = min(left, count)
            runs.append((length, rank, take, first, capacity - fit))
            keep(fit, first + take, count - take)
            keep(fit - length, first, take)
            rank, left = rank + take, left - take
        if left:
            each = capacity // length
            full, rest = divmod(left, each)
            for j in range(each):
                if full:
                    runs.append((length, rank, full, bins, j * length))
                    rank += full
            for j in range(rest):
                runs.append((length, rank, 1, bins + full, j * length))
                rank += 1
            keep(capacity - each * length, bins, full)
            keep(capacity - rest * length, bins + full, int(rest > 0))
            bins += full + (rest > 0)
    return np.array(sorted(runs), dtype=np.int64).reshape(-1, len(_RUN_COLUMNS))


def take_slots(ranked: DataFrame, plan: np.ndarray) -> DataFrame:
    """Adds sequence_id and offset to rows with length and rank (of a piece within its length, from 0)."""
    shared = ranked.sparkSession.sparkContext.broadcast(plan)  # its rows are bounded by the lengths, not by the documents
    out = ranked.drop("rank").schema.add("sequence_id", "long").add("offset", "long")
    kept = ranked.drop("rank").columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = shared.value
        starts = (runs[:, 0] << 48) + runs[:, 1]
        for batch in batches:
            table = dict(zip(batch.schema.names, batch.columns, strict=True))
            length, rank = (np.asarray(table[k], dtype=np.int64) for k in ("length", "rank"))
            at = np.searchsorted(starts, (length << 48) + rank, side="right") - 1
            sequence = runs[at, 3] + rank - runs[at, 1]
            yield pa.RecordBatch.from_arrays([*(table[k] for k in kept), pa.array(sequence), pa.array(runs[at, 4])], names=[*kept, "sequence_id", "offset"])

    return ranked.mapInArrow(run, out)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, emit_ids: bool = False) -> DataFrame:
    """Pieces with the sequence and offset they go to, and the row they come from. With emit_ids, ``ids`` has each piece's ids
    (little-endian, 32 bits)."""
    pieces = cut(token_pieces(docs, capacity, vocabulary, emit_ids))
    counts = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = cut(counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))))
    histogram = {r["length"]: r["n"] for r in bases.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    ranked = pieces.join(bases.drop("n"), ["task", "length"]).withColumn("rank", F.col("base") + F.col("task_rank"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if emit_ids else []), "row"]
    return take_slots(ranked.select(*columns, "rank"), plan_bins(histogram, capacity))


def op4_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"))
