"""Vectorised byte kernels that the corpus operators share.

Everything works on the UTF-8 buffers of Arrow string columns, so a batch of documents is cut into words or lines and hashed
with a handful of numpy passes instead of a Python loop over words. Words are runs of bytes other than 0x20 and 0x09-0x0D,
which is the class ``[^\\x20\\x09-\\x0D]+`` because those bytes never occur inside a multi-byte sequence.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U64 = np.uint64
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Odd multipliers that spread lengths and places over a word.
BYTE_BASE, TOKEN_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
#: The prime of the rolling hash, its base, and tokens hashed in one pass.
PRIME, ROLL, STEP = (1 << 61) - 1, 0x0B4E0EF37BC32127, 1 << 15
#: Bytes hashed in one pass; bounds the working memory of a pass.
PASS_BYTES = 2 << 20
#: Spans of more bytes are hashed one by one.
LONG = 512
#: Masks that keep the first k bytes of a little-endian word.
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=U64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit over the word."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of at most limit text bytes; a longer row comes alone."""
    _, off = utf8(batch.column(column))
    at, n = 0, batch.num_rows
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and per-row offsets of the maximal runs of True that do not cross rows."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:n]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | edge[1:n]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and per-row offsets of words."""
    return runs(~SPACE[data], offsets)


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    r"""Starts, ends and per-row offsets of the pieces between \n; an empty row has one empty piece."""
    brk = np.flatnonzero(data == 10)
    row = np.searchsorted(offsets, brk, "right") - 1
    count = np.bincount(row, minlength=len(offsets) - 1) + 1
    off = np.concatenate(([0], np.cumsum(count)))
    starts, ends = np.empty(off[-1], np.int64), np.empty(off[-1], np.int64)
    first = np.zeros(off[-1], dtype=bool)
    first[off[:-1]] = True
    last = np.zeros(off[-1], dtype=bool)
    last[off[1:] - 1] = True
    starts[first], starts[~first] = offsets[:-1], brk + 1
    ends[last], ends[~last] = offsets[1:], brk
    return starts, ends, off


def lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes that begin at each place, as a little-endian number; zeros follow the data."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


def _span_pass(data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    lane = lanes(data)
    h = mix(mix(size.astype(U64) * U64(TOKEN_BASE)) ^ (lane[starts] & _KEEP[np.minimum(size, 8)]))
    at, live = 8, np.flatnonzero(size > 8)
    while len(live):
        if at >= LONG:
            for i in live.tolist():
                h[i] = xxhash.xxh3_64_intdigest(data[starts[i] : starts[i] + size[i]].tobytes(), LONG)
            break
        h[live] = mix(h[live] * U64(BYTE_BASE) ^ (lane[starts[live] + at] & _KEEP[np.minimum(size[live] - at, 8)]))
        at += 8
        live = live[size[live] > at]
    return h


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span; spans are in order and do not overlap.

    Eight bytes at a time are mixed in, which is a bijection for spans of equal length up to eight bytes: those never collide.
    """
    out = np.empty(len(starts), U64)
    at = 0
    while at < len(starts):
        lo = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, lo + PASS_BYTES, "right")))
        out[at:to] = _span_pass(data[lo : int(ends[to - 1])], starts[at:to] - lo, ends[at:to] - starts[at:to])
        at = to
    return out


def same_spans(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """True where size bytes of lanes a from a_at are those of lanes b from b_at."""
    out = (a[a_at] ^ b[b_at]) & _KEEP[np.minimum(size, 8)] == 0
    at, live = 8, np.flatnonzero(out & (size > 8))
    while len(live):
        equal = (a[a_at[live] + at] ^ b[b_at[live] + at]) & _KEEP[np.minimum(size[live] - at, 8)] == 0
        out[live[~equal]] = False
        live = live[equal]
        at += 8
        live = live[size[live] > at]
    return out


def _fold(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME."""
    x = (x & U64(PRIME)) + (x >> U64(61))
    return np.where(x >= PRIME, x - U64(PRIME), x)


def _times(a: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """a * (high * 2**32 + low) modulo PRIME, for numbers below PRIME."""
    a1, a0 = a >> U64(32), a & U64(0xFFFFFFFF)
    middle = a1 * low + a0 * high
    least = a0 * low
    return _fold((a1 * high << U64(3)) + (middle >> U64(29)) + ((middle & U64((1 << 29) - 1)) << U64(32)) + (least & U64(PRIME)) + (least >> U64(61)))


@lru_cache(maxsize=8)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**0 .. base**(n-1) modulo PRIME, as high and low halves."""
    out, x = [], 1
    for _ in range(n):
        out.append(x)
        x = x * base % PRIME
    full = np.array(out, U64)
    return full >> U64(32), full & U64(0xFFFFFFFF)


def window_hash(tokens: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rabin-Karp modulo 2**61 - 1 over token hashes: row, place in the row and (mixed) hash of every run of width tokens inside a
    row. For a base without regard to the texts, two different windows have the same hash with a chance of width / 2**61 at most."""
    count = np.maximum(np.diff(offsets) - width + 1, 0)
    total = int(count.sum())
    row = np.repeat(np.arange(len(count)), count)
    if not total:
        return row, np.zeros(0, np.int64), np.zeros(0, U64)
    place = np.arange(total) - np.repeat(np.cumsum(count) - count, count)
    at = np.repeat(offsets[:-1], count) + place
    out = np.empty(total, U64)
    up, down = _powers(ROLL, STEP + width), _powers(pow(ROLL, -1, PRIME), STEP + width)
    cut = np.searchsorted(at, np.arange(0, int(at[-1]) + STEP + 1, STEP))
    for lo, i, j in zip(range(0, int(at[-1]) + 1, STEP), cut[:-1].tolist(), cut[1:].tolist(), strict=False):
        if i == j:
            continue
        part = _fold(tokens[lo : lo + STEP + width - 1])
        n = len(part)
        term = _times(part, up[0][:n], up[1][:n])
        high, low = np.zeros(n + 1, U64), np.zeros(n + 1, U64)
        np.cumsum(term >> U64(32), out=high[1:])
        np.cumsum(term & U64(0xFFFFFFFF), out=low[1:])
        s = at[i:j] - lo
        high, low = high[s + width] - high[s], low[s + width] - low[s]
        sums = _fold((high >> U64(29)) + ((high & U64((1 << 29) - 1)) << U64(32)) + low)
        out[i:j] = mix(_times(sums, down[0][s], down[1][s]))
    return row, place, out


def row_hash(tokens: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One hash of each row's whole token sequence: the sum of its tokens, each mixed with its place."""
    size = np.diff(offsets)
    place = np.arange(len(tokens)) - np.repeat(offsets[:-1], size)
    pre = np.zeros(len(tokens) + 1, U64)
    np.cumsum(mix(tokens ^ mix(place.astype(U64) * U64(TOKEN_BASE) + U64(BYTE_BASE))), out=pre[1:])
    return mix(pre[offsets[1:]] - pre[offsets[:-1]] + size.astype(U64) * U64(BYTE_BASE))


def line_word_hash(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    r"""Lines with a word, normalised: hash over their lower-cased (A-Z) words, number of words, index among all the row's
    \n-split lines, and per-row offsets."""
    low = data.copy()
    upper = (low >= 65) & (low <= 90)
    low[upper] += 32
    ls, le, lo = lines(data, offsets)
    ws, we, _ = words(low, offsets)
    wh = span_hash(low, ws, we)
    inner = np.append(np.searchsorted(ws, ls), len(ws))
    inner = np.maximum.accumulate(inner)
    h, size = row_hash(wh, inner), np.diff(inner)
    keep = size > 0
    index = np.arange(len(ls)) - np.repeat(lo[:-1], np.diff(lo))
    kept = np.concatenate(([0], np.cumsum(keep)))
    return h[keep], size[keep], index[keep], kept[lo]


def planes(a: np.ndarray) -> bytes:
    """The bytes of an array, all first bytes before all second ones: small or slowly growing numbers then compress well."""
    a = np.ascontiguousarray(a)
    return a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() if len(a) else b""


def unplanes(raw: bytes | memoryview, kind: type, n: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size).reshape(size, n).T).view(kind).reshape(n)
