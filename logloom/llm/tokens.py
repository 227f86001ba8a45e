"""Encoding of whole texts with the tokenizers library, each different stretch of text once per worker.

A text is cut at places where the tokenizer's own pre-tokenizer must cut as well, so the ids of a text are the ids of its
stretches in a row:

* ``spaced`` (byte-level BPE): before an ASCII white space that follows a visible character, and before one of ``.,;:!?`` that
  follows a letter (as far as characters of one or two bytes can be told to be such, see ``solid`` and ``letter``). The
  pre-tokenizer takes white space only at the front of a stretch, and a run of letters ends at such a mark.
* ``marked`` (SentencePiece models whose pieces have the metaspace marker in front only): before a space after another character.
* ``bare`` (white space is dropped, letters lower-cased): at ASCII spaces, which are left out, and at the same marks; stretches
  of plain ASCII are folded to lower case before they are looked up.

Stretches are looked up by a 64-bit hash in an open-addressing table, vectorised, and compared byte by byte with the stretch that
is kept there; one that differs is encoded for itself. The library encodes new stretches: those that can stand in a row are
joined to texts of some thousand bytes, whose ids are cut again at the bytes that each id stands for; the others go one by one.
The cache lives in the Python worker, for one run of one operator, and starts anew beyond ``CACHE`` entries.
"""

from __future__ import annotations

import os
import threading
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa

from . import kernels as K

#: Stretches that are kept at most, and seconds that an encoder stays without use.
CACHE, IDLE = 2_000_000, 2.0
#: Stretches that are joined to one text for the library.
JOIN = 256
#: Bytes of the longest stretch that is kept; longer ones are encoded each time.
KEPT = 256
_VISIBLE = np.zeros(256, dtype=bool)
_VISIBLE[0x21:0x7F] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True
_MARK = np.zeros(256, dtype=bool)
_MARK[[ord(c) for c in ".,;:!?"]] = True
#: Not folded: other alphabets, and what could become the name of a special token.
_UNFOLDED = np.zeros(256, dtype=bool)
_UNFOLDED[128:] = True
_UNFOLDED[ord("|")] = True


def tokenizer_path(name: str) -> str:
    """The place of a vocabulary file: name itself if it is a path, else that file of the installed public_tokenizers."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def _lead(data: np.ndarray) -> np.ndarray:
    """For the last byte of a character of two bytes its first byte, else 0."""
    out = np.zeros(len(data), np.uint8)
    if len(data) and data.max() >= 0xC3:
        out[1:] = np.where((data[:-1] >= 0xC3) & (data[:-1] <= 0xDF), data[:-1], 0)
    return out


def solid(data: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """True for the last byte of visible ASCII characters and of those from U+00C0 to U+07FF, none of which is white space."""
    return _VISIBLE[data] | (lead > 0)


def letter(data: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """True for the last byte of ASCII letters and of those from U+00C0 to U+00FF, which stay letters in lower case."""
    return _LETTER[data] | ((lead == 0xC3) & (data != 0x97) & (data != 0xB7))


def spaced(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    cut = np.zeros(len(data) + 1, dtype=bool)
    if len(data):
        lead = _lead(data)
        cut[1:-1] = (K.SPACE[data[1:]] & solid(data, lead)[:-1]) | (_MARK[data[1:]] & letter(data, lead)[:-1])
    cut[offsets] = True
    at = np.flatnonzero(cut)
    return at[:-1], at[1:], np.searchsorted(at, offsets)


def bare(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    inside = ~K.SPACE[data]
    n = len(data)
    if not n:
        return K.runs(inside, offsets)
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    edge[1:n] |= _MARK[data[1:]] & letter(data, _lead(data))[:-1]
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:n]
    end[:-1] &= ~inside[1:] | edge[1:n]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def folded(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    other = np.concatenate(([0], np.cumsum(_UNFOLDED[data])))
    plain = other[ends] == other[starts]
    flag = np.zeros(len(data) + 1, np.int8)
    flag[starts[plain]] = 1
    flag[ends[plain]] -= 1
    inside = np.cumsum(flag[:-1]) > 0
    out = data.copy()
    out[inside & (data >= 65) & (data <= 90)] += 32
    return out


def marked(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cut before a space that follows neither a space nor (the last byte of) a metaspace marker, and around line feeds, which no
    piece may hold."""
    cut = np.zeros(len(data) + 1, dtype=bool)
    if len(data):
        after, before = data[1:], data[:-1]
        cut[1:-1] = ((after == 32) & (before != 32) & (before != 0x81)) | (after == 10) | (before == 10)
    cut[offsets] = True
    at = np.flatnonzero(cut)
    return at[:-1], at[1:], np.searchsorted(at, offsets)


CUTS = {"spaced": spaced, "bare": bare, "marked": marked}


class Table:
    """Places of 64-bit hashes, by open addressing."""

    def __init__(self) -> None:
        self.count = 0
        self._room(1 << 17)

    def _room(self, size: int) -> None:
        self.mask, self.shift = size - 1, K.U64(64 - (size - 1).bit_length())
        self.slot = np.full(size, -1, np.int32)
        self.key = np.zeros(size, K.U64)

    def _slots(self, h: np.ndarray) -> np.ndarray:
        return (h * K.U64(K.BYTE_BASE) >> self.shift).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash, -1 if it isn't there."""
        at = self._slots(h)
        out = self.slot[at]
        live = np.flatnonzero((out >= 0) & (self.key[at] != h))
        while len(live):
            at[live] = (at[live] + 1) & self.mask
            out[live] = self.slot[at[live]]
            live = live[(out[live] >= 0) & (self.key[at[live]] != h[live])]
        return out

    def add(self, h: np.ndarray) -> None:
        """New, different hashes get the next places."""
        place = np.arange(self.count, self.count + len(h), dtype=np.int32)
        self.count += len(h)
        if 3 * self.count > 2 * self.mask:
            used = self.slot >= 0
            h, place = np.concatenate((self.key[used], h)), np.concatenate((self.slot[used], place))
            self._room(1 << (3 * self.count).bit_length())
        at = self._slots(h)
        live = np.arange(len(h))
        while len(live):
            free = live[self.slot[at[live]] < 0]
            self.slot[at[free]] = place[free]
            won = free[self.slot[at[free]] == place[free]]
            self.key[at[won]] = h[won]
            live = live[self.slot[at[live]] != place[live]]
            at[live] = (at[live] + 1) & self.mask


class Pool:
    """Runs of numbers, kept one after another; arrays grow by half."""

    def __init__(self, kind: type, spare: int = 0) -> None:
        self.flat, self.ends, self.count, self.spare = np.zeros(1 << 16, kind), np.zeros(1 << 12, np.int64), 0, spare

    @staticmethod
    def _grown(a: np.ndarray, used: int, need: int) -> np.ndarray:
        if need <= len(a):
            return a
        out = np.zeros(max(need, len(a) + len(a) // 2), a.dtype)
        out[:used] = a[:used]
        return out

    def add(self, flat: np.ndarray, size: np.ndarray) -> None:
        used = int(self.ends[self.count])
        self.flat = self._grown(self.flat, used, used + len(flat) + self.spare)
        self.flat[used : used + len(flat)] = flat
        self.ends = self._grown(self.ends, self.count + 1, self.count + 1 + len(size))
        self.ends[self.count + 1 : self.count + 1 + len(size)] = used + np.cumsum(size, dtype=np.int64)
        self.count += len(size)

    def where(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and size of the runs at these places."""
        begin = self.ends[at]
        return begin, self.ends[at + 1] - begin


def gather(flat: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs of flat that begin at starts, one after another."""
    total = np.concatenate(([0], np.cumsum(size)))
    return flat[np.repeat(starts - total[:-1], size) + np.arange(total[-1])]


def token_bytes(tokenizer, mode: str) -> np.ndarray:
    """For each id the bytes of text that it stands for."""
    out = np.zeros(tokenizer.get_vocab_size(with_added_tokens=True), np.int64)
    for token, i in tokenizer.get_vocab(with_added_tokens=True).items():
        if mode == "bare":
            token = token.removesuffix("</w>")
        elif mode == "marked":
            token = "x" if len(token) == 6 and token.startswith("<0x") else token.replace("\u2581", " ").encode()
        out[i] = len(token)
    return out


class StretchEncoder:
    def __init__(self, tokenizer, mode: str) -> None:
        self.tokenizer = tokenizer
        self.mode = mode
        self.bytes = token_bytes(tokenizer, mode)
        self.clear()

    def clear(self) -> None:
        self.table = Table()
        self.ids = Pool(np.uint32)
        self.texts = Pool(np.uint8, 8)

    def library(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def alone(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row and how many each stretch has, each encoded for itself."""
        found = []
        for i in range(0, len(starts), 20_000):
            found += self.library([data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(starts[i : i + 20_000].tolist(), ends[i : i + 20_000].tolist(), strict=True)])
        size = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(size.sum())), size

    def joined(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``alone``, for stretches that can stand in a row."""
        gap = 1 if self.mode == "bare" else 0
        size = ends - starts
        texts, groups = [], []
        for group in np.array_split(np.arange(len(starts)), -(-len(starts) // JOIN)):
            if gap:
                flat = np.full(int(size[group].sum()) + len(group), 32, np.uint8)
                at = np.cumsum(size[group] + 1) - size[group] - 1
                flat[gather(np.arange(len(flat)), at, size[group])] = gather(data, starts[group], size[group])
            else:
                flat = gather(data, starts[group], size[group])
            texts.append(flat.tobytes().decode("utf-8"))
            groups.append(group)
        ids, counts = [], []
        for group, found in zip(groups, self.library(texts), strict=True):
            own = np.array(found, np.uint32)
            ends_at = np.cumsum(self.bytes[own])
            want = np.cumsum(size[group])
            cut = np.searchsorted(ends_at, want)
            if len(own) and cut[-1] == len(own) - 1 and (ends_at[cut] == want).all():
                ids.append(own)
                counts.append(np.diff(cut, prepend=-1))
            else:  # an id reaches over the end of a stretch: not a model whose stretches stand for themselves
                own, count = self.alone(data, starts[group], ends[group])
                ids.append(own)
                counts.append(count)
        return np.concatenate(ids), np.concatenate(counts)

    def _joinable(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Stretches that begin where a stretch must begin after the last character of any other of them, and whose bytes the
        normaliser doesn't change in number; those that could hold the name of a special token aren't."""
        if not len(data):
            return np.zeros(len(starts), dtype=bool)
        if self.mode == "bare":
            lead = _lead(data)
            odd = (data == 124) | ((data >= 128) & (data != 0xC3) & (lead != 0xC3)) | (data < 33) | (data == 127)
            last = ends > starts
        else:
            odd = data == 124 if self.mode == "spaced" else (data == 10) | (data == 0x81)
            last = (data[starts] == 32 if self.mode == "marked" else K.SPACE[data[starts]]) & (solid(data, _lead(data)) if self.mode == "spaced" else data != 32)[ends - 1]
        total = np.concatenate(([0], np.cumsum(odd)))
        return last & (ends > starts) & (total[ends] == total[starts])

    def fresh(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``alone``; in a row where that gives the same ids."""
        ok = self._joinable(data, starts, ends)
        which = np.flatnonzero(ok)
        if len(which) < 2:
            return self.alone(data, starts, ends)
        rest = np.flatnonzero(~ok)
        a, n = self.joined(data, starts[which], ends[which])
        b, m = self.alone(data, starts[rest], ends[rest])
        size = np.empty(len(starts), np.int64)
        size[which], size[rest] = n, m
        begin = np.empty(len(starts), np.int64)
        begin[which], begin[rest] = np.cumsum(n) - n, len(a) + np.cumsum(m) - m
        return gather(np.concatenate((a, b)), begin, size), size

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and per-row offsets into them."""
        starts, ends, off = CUTS[self.mode](data, offsets)
        if self.mode == "bare":
            data = folded(data, starts, ends)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        if self.table.count > CACHE:
            self.clear()
        h, size = K.span_hash(data, starts, ends), ends - starts
        at = self.table.find(h)
        new = np.flatnonzero((at < 0) & (size <= KEPT))
        if len(new):
            one, first = np.unique(h[new], return_index=True)
            first = new[first]
            self.table.add(one)
            self.texts.add(gather(data, starts[first], size[first]), size[first])
            self.ids.add(*self.fresh(data, starts[first], ends[first]))
            at[new] = self.table.find(h[new])
        there = at >= 0
        at = np.where(there, at, 0) if self.table.count else np.zeros(len(at), np.int64)
        if not self.table.count:
            return self._mended(np.zeros(0, np.uint32), np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), np.arange(len(at)), data, starts, ends, off)
        kept, kept_size = self.texts.where(at)
        same = there & (kept_size == size)
        same &= K.same_spans(K.lanes(data), starts, self._kept_lanes(), kept, np.where(same, size, 0))
        begin, count = self.ids.where(at)
        if same.all():
            return gather(self.ids.flat, begin, count), np.concatenate(([0], np.cumsum(count)))[off]
        return self._mended(self.ids.flat, begin, count, np.flatnonzero(~same), data, starts, ends, off)

    def _kept_lanes(self) -> np.ndarray:
        flat = self.texts.flat
        return np.ndarray(len(flat) - 7, "<u8", flat, strides=(1,))

    def _mended(self, flat: np.ndarray, begin: np.ndarray, count: np.ndarray, bad: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of runs of flat, but of the bad stretches those that the library gives for each itself."""
        own, size = self.alone(data, starts[bad], ends[bad])
        begin, count = begin.copy(), count.copy()
        begin[bad], count[bad] = 0, 0
        total = np.concatenate(([0], np.cumsum(count)))
        flat = np.concatenate((gather(flat, begin, count), own))
        begin, count = total[:-1].copy(), count
        begin[bad], count[bad] = total[-1] + np.cumsum(size) - size, size
        return gather(flat, begin, count), np.concatenate(([0], np.cumsum(count)))[off]


class _Held:
    """The worker's encoder of one run. One that nothing has used for ``IDLE`` seconds is dropped, so that a worker that Spark
    keeps for other stages doesn't hold its cache through them."""

    def __init__(self) -> None:
        self.lock, self.key, self.encoder, self.users, self.timer = threading.Lock(), None, None, 0, None

    def take(self, path: str, mode: str, run: str) -> StretchEncoder:
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        with self.lock:
            if self.timer:
                self.timer.cancel()
            if self.key != (path, mode, run):
                self.key, self.encoder = (path, mode, run), StretchEncoder(Tokenizer.from_file(path), mode)
            self.users += 1
            return self.encoder

    def give_back(self) -> None:
        with self.lock:
            self.users -= 1
            self.timer = threading.Timer(IDLE, self.drop)
            self.timer.daemon = True
            self.timer.start()

    def drop(self) -> None:
        with self.lock:
            if not self.users:
                self.key = self.encoder = None
        pa.default_memory_pool().release_unused()


_held = _Held()


def encoded(batches: Iterator[pa.RecordBatch], path: str, mode: str, run: str, end: int | None) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, ids, per-row offsets) for slices of batches with a text column ``body``; each row's ids end with end, if given."""
    code = _held.take(path, mode, run)
    try:
        for batch in batches:
            for part in K.slices(batch, "body"):
                ids, off = code.encode(*K.utf8(part.column("body")))
                if end is not None:
                    ids = np.insert(ids, off[1:], end)
                    off = off + np.arange(len(off))
                yield part, ids, off
    finally:
        _held.give_back()
