"""FLAC media columns: encode and decode the lossless audio format, frame by frame, for whole batches at a time.

Streams are FLAC as published: stream information with the MD5 of the samples, a seek table with every frame, and frames of
``BLOCK`` samples with their own checksums. Subframes are constant, verbatim, fixed predictors or linear predictors with Rice-coded
residuals; the encoder takes the smallest. The decoder also reads stereo (all channel modes), 4 to 24 bits, wasted bits, both
Rice methods with escapes, and files without a seek table; it verifies the checksums of frame headers, frames and the stream.

Speed without native code: frames don't depend on each other, so all frames of a batch are parsed, and their predictors run, in
lock-step; one numpy step does one sample (or one code) of every frame.

Edge cases: a null text is an empty one, which is stored as 64 zero bytes; equal texts give equal streams; a damaged or null
stream keeps its row, with null results and an ``error`` that names its place (``decode_streams`` raises ``FlacError``); a text of any
length is one stream, held in memory whole; repeated rows are kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import read, small, tidy

RATE = 8000
BLOCK = 1024
ALIGN = 64
#: Order and precision of the encoder's linear predictors, and how its residuals are parted.
ORDER, PRECISION, PARTITIONS = 8, 9, 4
#: Streams are handled in groups of about so many bytes.
GROUP_BYTES = 2 << 20


class FlacError(ValueError):
    pass


def _crc_table(poly: int, bits: int) -> np.ndarray:
    top, mask = 1 << (bits - 1), (1 << bits) - 1
    table = []
    for i in range(256):
        c = i << (bits - 8)
        for _ in range(8):
            c = (c << 1 ^ poly if c & top else c << 1) & mask
        table.append(c)
    return np.array(table, dtype=np.uint32)


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)
_CRC8_LIST = _CRC8.tolist()


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = _CRC8_LIST[c ^ b]
    return c


def crc16_many(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Checksums of the parts [start, end) of data, all in step."""
    order = np.argsort(starts - ends, kind="stable")
    at, left = starts[order].copy(), (ends - starts)[order]
    c = np.zeros(len(order), dtype=np.uint32)
    steps = int(left[0]) if len(left) else 0
    active = np.searchsorted(-left, -np.arange(steps), side="left")
    for i in range(steps):
        n = active[i]
        c[:n] = (c[:n] << 8 & 0xFFFF) ^ _CRC16[(c[:n] >> 8) ^ data[at[:n] + i]]
    out = np.empty(len(order), dtype=np.uint32)
    out[order] = c
    return out


def _utf8_number(n: int) -> bytes:
    if n < 0x80:
        return bytes([n])
    out = []
    lead = 0x3F
    while n > lead:
        out.append(0x80 | n & 0x3F)
        n >>= 6
        lead >>= 1
    return bytes([(~lead << 1) & 0xFF | n, *reversed(out)])


# --- encoder ---------------------------------------------------------------------------------------------------------


def _levinson(autoc: np.ndarray) -> np.ndarray:
    """Predictor coefficients (frames, ORDER) from autocorrelations (frames, ORDER + 1)."""
    f = len(autoc)
    a = np.zeros((f, ORDER))
    err = autoc[:, 0].copy()
    ok = err > 0
    err[~ok] = 1
    for i in range(ORDER):
        acc = autoc[:, i + 1] - (a[:, :i] * autoc[:, i:0:-1]).sum(axis=1)
        k = np.where(ok, acc / err, 0.0)
        old = a[:, :i].copy()
        a[:, i] = k
        a[:, :i] = old - k[:, None] * old[:, ::-1]
        err = np.maximum(err * (1 - k * k), 1e-9)
    return a


def _rice_cost(folded: np.ndarray, parts: int, skip: int, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A parameter for each frame's partitions, from their means, and the bits that the residual takes. Rows end with zeros."""
    f, width = folded.shape
    size = lengths // parts
    edges = size[:, None] * np.arange(parts + 1)[None, :]

    def sums(x: np.ndarray) -> np.ndarray:
        run = np.zeros((f, width + 1), dtype=np.int64)
        np.cumsum(x, axis=1, out=run[:, 1:])
        return np.diff(np.take_along_axis(run, edges, axis=1), axis=1)

    count = np.repeat(size[:, None], parts, axis=1)
    count[:, 0] -= skip
    mean = sums(folded) / np.maximum(count, 1)
    parameter = np.clip(np.floor(np.log2(np.maximum(mean * 0.7, 1))), 0, 14).astype(np.int64)
    each = np.take_along_axis(parameter, np.minimum(np.arange(width)[None, :] // np.maximum(size, 1)[:, None], parts - 1), axis=1)
    return parameter, (sums(folded >> each) + (1 + parameter) * count + 4).sum(axis=1)


Codes = tuple[np.ndarray, np.ndarray]  # values of up to 32 bits, and in how many bits each is written


def _codes(*pairs: tuple[int, int]) -> Codes:
    return np.array([v for v, _ in pairs], dtype=np.int64), np.array([n for _, n in pairs], dtype=np.int64)


def _encode_frames(samples: np.ndarray, lengths: np.ndarray, parts: int) -> list[list[Codes]]:
    """Subframes of 8-bit mono frames (rows, zero beyond their lengths) as codes; every frame has ``parts`` partitions."""
    f, width = samples.shape
    x = samples
    inside = np.arange(width)[None, :] < lengths[:, None]
    candidates = []  # (order, residuals, coefficients, shift)
    d = x
    for order in range(3):
        candidates.append((order, d, None, None))
        d = np.concatenate((np.zeros((f, 1), dtype=np.int64), d[:, 1:] - d[:, :-1]), axis=1)
    level = np.where(inside, x, 0).astype(np.float64)
    autoc = np.stack([np.einsum("ij,ij->i", level[:, : width - k], level[:, k:]) for k in range(ORDER + 1)], axis=1)
    coefficients = _levinson(autoc)
    largest = np.abs(coefficients).max(axis=1)
    shift = np.clip(PRECISION - 2 - np.floor(np.log2(np.maximum(largest, 1e-6))).astype(np.int64), 0, 14)
    q = np.clip(np.rint(coefficients * (1 << shift)[:, None]), -(1 << PRECISION - 1), (1 << PRECISION - 1) - 1).astype(np.int64)
    predicted = np.zeros((f, width), dtype=np.int64)
    for j in range(ORDER):
        predicted[:, ORDER:] += q[:, j : j + 1] * x[:, ORDER - 1 - j : width - 1 - j]
    candidates.append((ORDER, x - (predicted >> shift[:, None]), q, shift))

    costs, parameters, folds = [], [], []
    for order, residual, coefs, _ in candidates:
        r = np.where(inside, residual, 0)
        r[:, :order] = 0
        folded = (r << 1) ^ (r >> 63)
        parameter, bits = _rice_cost(folded, parts, order, lengths)
        usable = lengths // parts > order
        costs.append(np.where(usable, bits + 8 * order + (9 + PRECISION * ORDER if coefs is not None else 0) + 14, 1 << 40))
        parameters.append(parameter)
        folds.append(folded)
    costs.append(8 * lengths + 8)  # verbatim
    choice = np.argmin(np.stack(costs), axis=0)
    constant = (np.where(inside, x, x[:, :1]) == x[:, :1]).all(axis=1)

    out = []
    for i in range(f):
        n = int(lengths[i])
        if constant[i]:
            out.append([_codes((0, 8), (int(x[i, 0]) & 0xFF, 8))])
            continue
        c = int(choice[i])
        if c == len(candidates):
            out.append([_codes((2, 8)), (x[i, :n] & 0xFF, np.full(n, 8))])
            continue
        order, _, coefs, shifts = candidates[c]
        head = [((32 | order - 1 if coefs is not None else 8 | order) << 1, 8), *((int(v) & 0xFF, 8) for v in x[i, :order])]
        if coefs is not None:
            head += [(PRECISION - 1, 4), (int(shifts[i]), 5), *((int(v) & (1 << PRECISION) - 1, PRECISION) for v in coefs[i])]
        head.append((parts.bit_length() - 1, 6))
        codes, size = [_codes(*head)], n // parts
        for p in range(parts):
            k = int(parameters[c][i, p])
            v = folds[c][i, max(p * size, order) : (p + 1) * size]
            codes += [_codes((k, 4)), (v & (1 << k) - 1 | 1 << k, (v >> k) + (1 + k))]
        out.append(codes)
    return out


def _pack(frames: list[list[Codes]]) -> list[bytes]:
    """The bytes of each frame's codes, filled up to whole bytes. All codes are laid out at once, 32 bits each, then added."""
    for codes in frames:
        codes.append(_codes((0, -int(sum(n.sum() for _, n in codes)) % 8)))
    values = np.concatenate([v for codes in frames for v, _ in codes]).astype(np.uint64)
    ends = np.cumsum(np.concatenate([n for codes in frames for _, n in codes]))
    word, shift = ends >> 5, (32 - (ends & 31)).astype(np.uint64)
    placed = values << shift
    size = int(ends[-1] >> 5) + 2
    total = np.bincount(word, weights=(placed >> np.uint64(32)).astype(np.float64), minlength=size)
    total += np.bincount(word + 1, weights=(placed & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=size)
    data = total.astype(np.uint32).astype(">u4").tobytes()[4:]
    cuts = np.concatenate(([0], np.cumsum([sum(int(n.sum()) for _, n in codes) // 8 for codes in frames])))
    return [data[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def encode_streams(payloads: list[bytes]) -> list[bytes]:
    """8-bit mono FLAC streams; sample values are the bytes less 128. Every payload's length is a positive multiple of ALIGN."""
    frames: list[list[bytes]] = [[] for _ in payloads]
    places = [(p, at, min(BLOCK, len(payload) - at)) for p, payload in enumerate(payloads) for at in range(0, len(payload), BLOCK)]
    raw = [np.frombuffer(p, dtype=np.uint8) for p in payloads]
    kinds = {True: [k for k, x in enumerate(places) if x[2] >= ALIGN * PARTITIONS], False: [k for k, x in enumerate(places) if x[2] < ALIGN * PARTITIONS]}
    coded: list[bytes | None] = [None] * len(places)
    for long, which in kinds.items():
        for lo in range(0, len(which), 512):
            part = which[lo : lo + 512]
            lengths = np.array([places[k][2] for k in part], dtype=np.int64)
            matrix = np.zeros((len(part), int(lengths.max())), dtype=np.int64)
            for row, k in enumerate(part):
                p, at, n = places[k]
                matrix[row, :n] = raw[p][at : at + n].astype(np.int64) - 128
            for k, body in zip(part, _pack(_encode_frames(matrix, lengths, PARTITIONS if long else 1)), strict=True):
                number, n = places[k][1] // BLOCK, places[k][2]
                # sync, fixed block size; size in 16 bits at the end of the header; rate as in the stream; mono; 8 bits
                header = b"\xff\xf8" + bytes([0x70, 0x02]) + _utf8_number(number) + (n - 1).to_bytes(2, "big")
                coded[k] = header + bytes([crc8(header)]) + body
    joined = np.frombuffer(b"".join(coded), dtype=np.uint8)
    ends = np.cumsum([len(c) for c in coded])
    sums = crc16_many(joined, ends - np.array([len(c) for c in coded], dtype=np.int64), ends) if coded else []
    for (p, _, _), c, s in zip(places, coded, sums, strict=True):
        frames[p].append(c + int(s).to_bytes(2, "big"))
    return [_stream(payload, own) for payload, own in zip(payloads, frames, strict=True)]


def _stream(payload: bytes, frames: list[bytes]) -> bytes:
    sizes = [len(f) for f in frames]
    signed = (np.frombuffer(payload, dtype=np.uint8) ^ 0x80).tobytes()
    n = len(payload)
    packed = RATE << 44 | 0 << 41 | 7 << 36 | n
    info = BLOCK.to_bytes(2, "big") * 2 + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big") + packed.to_bytes(8, "big") + hashlib.md5(signed).digest()
    seek, at = [], 0
    for i, f in enumerate(frames):
        seek.append((i * BLOCK).to_bytes(8, "big") + at.to_bytes(8, "big") + min(BLOCK, n - i * BLOCK).to_bytes(2, "big"))
        at += len(f)
    table = b"".join(seek)
    return b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(table).to_bytes(3, "big") + table + b"".join(frames)


# --- decoder ---------------------------------------------------------------------------------------------------------


@dataclass
class Stream:
    rate: int
    channels: int
    bits: int
    total: int
    md5: bytes
    seeks: dict[int, int]  # sample number -> byte of its frame, counted from the first frame
    first_frame: int  # byte at which frames begin


@dataclass
class Frame:
    stream: int
    start: int  # first byte, in the stream
    body: int  # first byte after the header
    end: int  # byte after the checksum
    sample: int
    length: int
    assignment: int
    bits: int


def parse_stream(data: bytes) -> Stream:
    if data[:4] != b"fLaC":
        raise FlacError("not a FLAC stream")
    at, info = 4, None
    seeks: dict[int, int] = {}
    while True:
        if at + 4 > len(data):
            raise FlacError("the stream ends within its metadata")
        last, kind, size = data[at] >> 7, data[at] & 0x7F, int.from_bytes(data[at + 1 : at + 4], "big")
        block = data[at + 4 : at + 4 + size]
        if kind == 0:
            packed = int.from_bytes(block[10:18], "big")
            info = (packed >> 44, (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & (1 << 36) - 1, block[18:34])
        elif kind == 3:
            points = [(int.from_bytes(block[k : k + 8], "big"), int.from_bytes(block[k + 8 : k + 16], "big")) for k in range(0, size - size % 18, 18)]
            seeks = {n: place for n, place in points if n != (1 << 64) - 1}
        at += 4 + size
        if last:
            break
    if info is None:
        raise FlacError("no stream information")
    return Stream(*info, seeks, at)


def _read_header(data: bytes, at: int, s: Stream) -> tuple[int, int, int, int, int, bool] | None:
    """(body, number, length, assignment, bits, variable) of a frame header with a right checksum, or None."""
    if at + 6 > len(data) or data[at] != 0xFF or data[at + 1] & 0xFE != 0xF8:
        return None
    size, rate, assignment, depth = data[at + 2] >> 4, data[at + 2] & 15, data[at + 3] >> 4, data[at + 3] >> 1 & 7
    if size == 0 or rate == 15 or assignment > 10 or depth == 3 or data[at + 3] & 1:
        return None
    p = at + 4
    lead = data[p]
    more = 0
    while lead & 0x80 >> more:
        more += 1
    if more == 1 or more > 7 or p + max(more, 1) > len(data):
        return None
    number = lead & 0x7F >> more if more else lead
    for b in data[p + 1 : p + max(more, 1)]:
        if b & 0xC0 != 0x80:
            return None
        number = number << 6 | b & 0x3F
    p += max(more, 1)
    if size == 6:
        length, p = data[p] + 1, p + 1
    elif size == 7:
        length, p = int.from_bytes(data[p : p + 2], "big") + 1, p + 2
    else:
        length = 192 if size == 1 else 576 << size - 2 if size < 6 else 256 << size - 8
    p += {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if p >= len(data) or crc8(data[at:p]) != data[p]:
        return None
    bits = {0: s.bits, 1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}[depth]
    return p + 1, number, length, assignment, bits, bool(data[at + 1] & 1)


def _ends(data: bytes, start: int, end: int) -> bool:
    """Whether the bytes from start to end close with their own checksum, as a frame does."""
    if end - start < 3:
        return False
    buffer = np.frombuffer(data, dtype=np.uint8)
    return int(crc16_many(buffer, np.array([start]), np.array([end - 2]))[0]) == int.from_bytes(data[end - 2 : end], "big")


def find_frames(data: bytes, s: Stream, index: int) -> list[Frame]:
    """Frames by the seek table; where it names none, by sync codes, header checksums and consecutive numbers, and only where
    the frame before ends with a right checksum. The other frame checksums are verified when decoding."""
    found: list[Frame] = []
    at, expected, blocks, known = s.first_frame, 0, 0, True
    while 0 <= at < len(data):
        header = _read_header(data, at, s)
        body, number, length, assignment, bits, variable = header if header else (0, -1, 0, 0, 0, False)
        good = header is not None and number == (expected if variable else blocks)
        if not found and not good:
            raise FlacError(f"no frame at byte {at}")
        if not good or not (known or _ends(data, found[-1].start, at)):
            # a wrong point of the table is no place to go on from
            at, known = data.find(b"\xff", (found[-1].body if known else at) + 1), False
            continue
        if found:
            found[-1].end = at
        found.append(Frame(index, at, body, len(data), expected, length, assignment, bits))
        expected, blocks = expected + length, blocks + 1
        if s.total and expected >= s.total:
            break
        at = s.first_frame + s.seeks.get(expected, -1 - s.first_frame)
        known = body < at < len(data)
        if not known:
            at = data.find(b"\xff", body + 1)
    return found


class _Bits:
    """Bit positions in one buffer, many readers at once."""

    def __init__(self, data: bytes):
        padded = np.frombuffer(data + b"\0" * 16, dtype=np.uint8)
        self.windows = np.lib.stride_tricks.as_strided(padded[:8].view(">u8"), shape=(len(padded) - 8,), strides=(1,))

    def peek(self, at: np.ndarray) -> np.ndarray:
        """At least 57 bits from each position, left-aligned."""
        return self.windows[at >> 3].astype(np.uint64) << (at & 7).astype(np.uint64)

    def read(self, at: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        """n bits (up to 32) at each position."""
        n = np.asarray(n, dtype=np.uint64)
        return np.where(n > 0, self.peek(at) >> (np.uint64(64) - np.maximum(n, np.uint64(1))), 0).astype(np.int64)

    def signed(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        n = np.asarray(n, dtype=np.int64)
        v = self.read(at, n)
        return np.where((n > 0) & (v >> np.maximum(n - 1, 0) > 0), v - (np.int64(1) << n), v)

    def zeros(self, at: np.ndarray) -> np.ndarray:
        """Number of zero bits before the next one bit at each position."""
        out = np.zeros(len(at), dtype=np.int64)
        todo = np.arange(len(at))
        while len(todo):
            high = (self.peek(at[todo] + out[todo]) >> np.uint64(32)).astype(np.float64)
            lead = np.where(high > 0, 1054 - (high.view(np.int64) >> 52), 32)
            out[todo] += lead
            todo = todo[lead == 32]
        return out


_FIXED = np.array([[0, 0, 0, 0], [1, 0, 0, 0], [2, -1, 0, 0], [3, -3, 1, 0], [4, -6, 4, -1]], dtype=np.int64)


def _decode_subframes(b: _Bits, at: np.ndarray, length: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Samples (frames, longest) of one subframe each, and the positions after them."""
    f, width = len(at), int(length.max())
    kind = b.read(at, 7)
    wasted = np.zeros(f, dtype=np.int64)
    has = b.read(at + 7, 1) == 1
    at = at + 8
    if has.any():
        z = b.zeros(at[has])
        wasted[has] = z + 1
        at[has] += z + 1
    bits = bits - wasted
    x = np.zeros((f, width), dtype=np.int64)
    linear, fixed = kind >= 32, (kind >= 8) & (kind <= 12)
    if ((kind > 1) & ~linear & ~fixed).any():
        raise FlacError("reserved kind of subframe")
    same = np.flatnonzero(kind == 0)
    if len(same):
        x[same] = b.signed(at[same], bits[same])[:, None]
        at[same] += bits[same]
    plain = np.flatnonzero(kind == 1)
    for i in range(int(length[plain].max()) if len(plain) else 0):
        use = plain[length[plain] > i]
        x[use, i] = b.signed(at[use], bits[use])
        at[use] += bits[use]
    coded = np.flatnonzero(linear | fixed)
    if len(coded):
        order = np.where(linear, kind - 31, kind - 8)
        top = int(order[coded].max())
        for i in range(top):
            use = coded[order[coded] > i]
            x[use, i] = b.signed(at[use], bits[use])
            at[use] += bits[use]
        shift, taps = np.zeros(f, dtype=np.int64), np.zeros((f, max(top, 4)), dtype=np.int64)
        taps[fixed, :4] = _FIXED[order[fixed]]
        lin = np.flatnonzero(linear)
        if len(lin):
            precision = b.read(at[lin], 4) + 1
            shift[lin] = b.signed(at[lin] + 4, np.full(len(lin), 5))
            at[lin] += 9
            if (precision == 16).any() or (shift[lin] < 0).any():
                raise FlacError("reserved precision or shift of a predictor")
            for i in range(int(order[lin].max())):
                use = order[lin] > i
                taps[lin[use], i] = b.signed(at[lin[use]], precision[use])
                at[lin[use]] += precision[use]
        _residuals(b, x, at, length, order, coded)
        _restore(x, length, order, taps, shift, coded)
    return x << wasted[:, None], at


def _residuals(b: _Bits, x: np.ndarray, at: np.ndarray, length: np.ndarray, order: np.ndarray, coded: np.ndarray) -> None:
    """Rice codes of the coded frames into x, beyond their warm-up samples; moves ``at``."""
    method = b.read(at[coded], 2)
    if (method > 1).any():
        raise FlacError("reserved coding of residuals")
    parts = np.int64(1) << b.read(at[coded] + 2, 4)
    at[coded] += 6
    size = length[coded] // parts
    if (size * parts != length[coded]).any() or (size < order[coded]).any():
        raise FlacError("partitions don't fit the block")
    width = np.where(method == 1, 5, 4)
    # frames with the most samples first: those that still run are a prefix
    by = np.argsort(-length[coded], kind="stable")
    frames, width, size = coded[by], width[by], size[by]
    n, first, pos = length[frames], order[frames], at[frames]
    k, raw = np.zeros(len(frames), dtype=np.int64), np.full(len(frames), -1, dtype=np.int64)
    boundary = np.zeros(len(frames), dtype=np.int64)
    running = np.searchsorted(-n, -np.arange(int(n.max())), side="left")
    least = int(first.min())
    for i in range(least, int(n.max())):
        m = running[i]
        at_edge = np.flatnonzero((boundary[:m] <= i) & (first[:m] <= i))
        while len(at_edge):
            k[at_edge] = b.read(pos[at_edge], width[at_edge])
            pos[at_edge] += width[at_edge]
            escape = at_edge[k[at_edge] == (1 << width[at_edge]) - 1]
            raw[at_edge] = -1
            raw[escape] = b.read(pos[escape], 5)
            pos[escape] += 5
            boundary[at_edge] = np.where(boundary[at_edge] == 0, size[at_edge], boundary[at_edge] + size[at_edge])
            at_edge = at_edge[boundary[at_edge] <= i]
        p = pos[:m]
        window = b.peek(p)
        high = (window >> np.uint64(32)).astype(np.float64)
        q = 1054 - (high.view(np.int64) >> 52)
        kk = k[:m]
        # most codes lie within one window; the rest is read step by step
        odd = (high == 0) | (q + 1 + kk > 56) | (raw[:m] >= 0) | (first[:m] > i)
        rest = np.where(kk > 0, (window << (q + 1).astype(np.uint64) & np.uint64(0xFFFFFFFFFFFFFFFF)) >> (64 - np.maximum(kk, 1)).astype(np.uint64), 0).astype(np.int64)
        v = (q << kk) | rest
        value = (v >> 1) ^ -(v & 1)
        step = q + 1 + kk
        if odd.any():
            o = np.flatnonzero(odd)
            start, esc = first[o] > i, raw[o] >= 0
            value[o[start]], step[o[start]] = x[frames[o[start]], i], 0
            e = o[esc & ~start]
            value[e], step[e] = b.signed(p[e], raw[e]), raw[e]
            c = o[~esc & ~start]
            z = b.zeros(p[c])
            v = (z << kk[c]) | b.read(p[c] + z + 1, kk[c])
            value[c], step[c] = (v >> 1) ^ -(v & 1), z + 1 + kk[c]
        x[frames[:m], i] = value
        pos[:m] += step
    at[frames] = pos


def _restore(x: np.ndarray, length: np.ndarray, order: np.ndarray, taps: np.ndarray, shift: np.ndarray, coded: np.ndarray) -> None:
    """Residuals to samples, one sample of every frame at a time."""
    for o in np.unique(order[coded]):
        if o == 0:
            continue
        rows = coded[order[coded] == o]
        rows = rows[np.argsort(-length[rows], kind="stable")]
        running = np.searchsorted(-length[rows], -np.arange(int(length[rows].max())), side="left")
        columns = np.ascontiguousarray(x[rows].T)
        weights = np.ascontiguousarray(taps[rows, :o].T[::-1])
        s = shift[rows]
        for i in range(int(o), int(length[rows].max())):
            m = running[i]
            columns[i, :m] += (weights[:, :m] * columns[i - o : i, :m]).sum(axis=0) >> s[:m]
        x[rows] = columns.T


def decode_streams(streams: list[bytes]) -> list[tuple[Stream, np.ndarray, list[Frame]]]:
    """Of each stream its information, samples (n, channels) and frames. All checksums are verified."""
    infos = [parse_stream(d) for d in streams]
    frames = [f for i, (d, s) in enumerate(zip(streams, infos, strict=True)) for f in find_frames(d, s, i)]
    data = b"".join(streams)
    base = np.cumsum([len(d) for d in streams]) - np.array([len(d) for d in streams], dtype=np.int64) if streams else np.zeros(0, dtype=np.int64)
    parts: list[list[np.ndarray]] = [[] for _ in streams]
    if frames:
        buffer = np.frombuffer(data, dtype=np.uint8)
        offset = base[[f.stream for f in frames]]
        start, end = offset + [f.start for f in frames], offset + [f.end for f in frames]
        want = buffer[end - 2].astype(np.uint32) << 8 | buffer[end - 1]
        bad = np.flatnonzero(crc16_many(buffer, start, end - 2) != want)
        if len(bad):
            f = frames[bad[0]]
            raise FlacError(f"wrong checksum in the frame at byte {f.start} of stream {f.stream}")
        b = _Bits(data)
        at = 8 * (offset + [f.body for f in frames])
        length = np.array([f.length for f in frames], dtype=np.int64)
        mode = np.array([f.assignment for f in frames])
        depth = np.array([f.bits for f in frames], dtype=np.int64)
        count = np.where(mode < 8, mode + 1, 2)
        channels = []
        for c in range(int(count.max())):
            use = np.flatnonzero(count > c)
            # the difference channel has one bit more
            extra = ((c == 1) & ((mode[use] == 8) | (mode[use] == 10))) | ((c == 0) & (mode[use] == 9))
            got = np.zeros((len(frames), int(length.max())), dtype=np.int64)
            for lo in range(0, len(use), 2048):
                part = use[lo : lo + 2048]
                x, after = _decode_subframes(b, at[part], length[part], depth[part] + extra[lo : lo + 2048])
                got[part, : x.shape[1]] = x
                at[part] = after
            channels.append(got)
        for i, f in enumerate(frames):
            own = [channels[c][i, : f.length] for c in range(count[i])]
            if mode[i] == 8:
                own[1] = own[0] - own[1]
            elif mode[i] == 9:
                own[0] = own[0] + own[1]
            elif mode[i] == 10:
                mid = own[0] << 1 | own[1] & 1
                own = [(mid + own[1]) >> 1, (mid - own[1]) >> 1]
            parts[f.stream].append(np.stack(own, axis=1))
    out = []
    by_stream: list[list[Frame]] = [[] for _ in streams]
    for f in frames:
        by_stream[f.stream].append(f)
    for i, s in enumerate(infos):
        samples = np.concatenate(parts[i]) if parts[i] else np.zeros((0, s.channels), dtype=np.int64)
        if s.total and len(samples) != s.total:
            raise FlacError(f"stream {i} has {len(samples)} samples instead of {s.total}")
        if any(s.md5) and hashlib.md5(pcm_bytes(samples, s.bits)).digest() != s.md5:
            raise FlacError(f"the samples of stream {i} don't have the stream's checksum")
        out.append((s, samples, by_stream[i]))
    return out


def pcm_bytes(samples: np.ndarray, bits: int) -> bytes:
    """Interleaved signed little-endian samples of whole bytes."""
    width = -(-bits // 8)
    if width == 1:
        return samples.astype(np.int8).tobytes()
    return samples.astype("<i4").view(np.uint8).reshape(-1, 4)[:, :width].tobytes()


def feature(samples: np.ndarray) -> str:
    """Level, peak, crossings of the middle and mean step of a decoded 8-bit signal, in integers."""
    x = samples.reshape(-1).astype(np.int64)
    step = np.abs(np.diff(x)).sum()
    crossings = np.count_nonzero((x[1:] >= 0) != (x[:-1] >= 0))
    return f"energy={int((x * x).sum())};peak={int(np.abs(x).max()) if len(x) else 0};crossings={crossings};steps={int(step)};dc={int(x.sum())}"


# --- DataFrames ------------------------------------------------------------------------------------------------------


def padded(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + b"\0" * (-len(raw) % ALIGN or (0 if raw else ALIGN))


def _groups(items: list[bytes | None]) -> Iterator[tuple[int, int]]:
    lo = size = 0
    for i, x in enumerate(items):
        n = len(x or b"")
        if size and size + n > GROUP_BYTES:
            yield lo, i
            lo, size = i, 0
        size += n
    if lo < len(items):
        yield lo, len(items)


def encode_media(docs: DataFrame) -> DataFrame:
    """docs with doc_id and text -> doc_id, n_bytes (of the text), media (a FLAC stream of the padded text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            texts = batch.column(1).to_pylist()
            payloads = [padded(t) for t in texts]
            for lo, hi in _groups(payloads):
                media = encode_streams(payloads[lo:hi])
                sizes = [len((t or "").encode()) for t in texts[lo:hi]]
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), "doc_id long, n_bytes long, media binary")


def decoded_blocks(streams: list[bytes | None]) -> list[tuple[list[tuple[int, int, int, bytes]], str | None]]:
    """Of each stream its blocks (sample_offset, n_samples, byte_offset, pcm), or none and what is wrong with it."""

    def blocks(decoded: tuple[Stream, np.ndarray, list[Frame]]) -> list[tuple[int, int, int, bytes]]:
        s, samples, frames = decoded
        return [(f.sample, f.length, f.start, pcm_bytes(samples[f.sample : f.sample + f.length], s.bits)) for f in frames]

    try:
        return [(blocks(x), None) for x in decode_streams(streams)]
    except (FlacError, IndexError, ValueError, TypeError):  # one at a time, to tell the damaged ones from the rest
        out = []
        for data in streams:
            try:
                out.append((blocks(decode_streams([data])[0]), None))
            except (FlacError, IndexError, ValueError, TypeError) as e:
                out.append(([], str(e) if isinstance(e, FlacError) else "no stream" if data is None else f"not readable: {e}"))
        return out


def pcm_blocks(media: DataFrame) -> DataFrame:
    """media with doc_id and media -> one row per frame: doc_id, block, sample_offset, n_samples, byte_offset, pcm, error.

    A damaged stream has one row, with an error and without a block.

    A sample is found without decoding others: its block is the last one whose sample_offset is not above it, and byte_offset
    is where that frame stands in the stream.
    """
    names = ["doc_id", "block", "sample_offset", "n_samples", "byte_offset", "pcm", "error"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            ids, streams = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo, hi in _groups(streams):
                rows = []
                for doc_id, (blocks, error) in zip(ids[lo:hi], decoded_blocks(streams[lo:hi]), strict=True):
                    rows += [(doc_id, i, *block, None) for i, block in enumerate(blocks)] if error is None else [(doc_id, None, None, None, None, None, error)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)

    return media.select("doc_id", "media").mapInArrow(tidy(run), "doc_id long, block int, sample_offset long, n_samples long, byte_offset long, pcm binary, error string")


def media_digests(media: DataFrame) -> DataFrame:
    """Digests of media columns whose samples are the bytes of a payload, read back from the stored streams block by block."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def digest(stream: bytes | None, blocks: list[tuple[int, int, int, bytes]], error: str | None) -> tuple:
        stored = (None, None) if stream is None else (len(stream), hashlib.sha256(stream).hexdigest())
        if error is not None:
            return (None, None, None, *stored, None, error)
        signed = np.frombuffer(b"".join(pcm for *_, pcm in blocks), dtype=np.int8)
        payload = (signed.astype(np.int16) + 128).astype(np.uint8).tobytes()
        return (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ALIGN:]), *stored, feature(signed), None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            streams = batch.column(2).to_pylist()
            for lo, hi in _groups(streams):
                rows = [digest(x, *got) for x, got in zip(streams[lo:hi], decoded_blocks(streams[lo:hi]), strict=True)]
                columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], batch.column(1)[lo:hi], *columns], names=names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(tidy(run), schema)


def op1_flac_media(spark, sf_dir: str) -> DataFrame:
    return media_digests(encode_media(read(spark, sf_dir, "documents")))
