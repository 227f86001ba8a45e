"""Packing of tokenised documents into sequences of at most ``capacity`` tokens.

A document's ids end with an end id; only a longer document is cut, into pieces of capacity tokens (the last one may be
shorter). Full pieces are sequences of their own. The others are dealt by hash of (doc_id, piece, checksum) to groups of about
``GROUP`` pieces, so a task's work has a bound and a group wastes a bin at most; each group is packed by

1. best fit in the order of the pieces' hashes, a simple start that leaves up to some percent of the bins to be emptied, then
2. swap-based local search between underfull bins: an item of the emptiest bin moves to another bin, or changes places with a
   smaller one there, or two items change places with one, whenever the other bin (which is at least as full) gains, that is,
   the sum of squared fills rises. Of all exchanges with all partners the one that moves most is made first. A bin that nothing
   can be taken from is left, and tried again after others have changed. The search ends when the lower bound
   ceil(tokens / capacity) is reached or a whole round changes nothing; there is no other limit.
3. Where the result is above the lower bound, the same search runs once more from best fit decreasing, and the better one stays.

Only lengths and checksums are shuffled; ids are made again from the texts by whoever needs them (``pieces(with_ids=True)``).

Edge cases: null and empty texts are one piece that holds the end id alone; rows that repeat are packed each for itself, in an
order that their checksums break; null doc_ids are packed like others; no rows give no sequences.
"""

from __future__ import annotations

import bisect
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import checkpoint
from .tokens import encoded, tokenizer_path

GROUP = 16_384


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of places in sizes: each item in turn goes to the fullest bin that has room for it."""
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # by room left
    rooms: list[int] = []  # the rooms that some bin has, ascending
    bins: list[list[int]] = []
    for i, size in enumerate(sizes):
        at = bisect.bisect_left(rooms, size)
        if at < len(rooms):
            room = rooms[at]
            b = open_bins[room].pop()
            if not open_bins[room]:
                del rooms[at]
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        left = room - size
        if left:
            if not open_bins[left]:
                bisect.insort(rooms, left)
            open_bins[left].append(b)
    return bins


class Search:
    """Bins under local search. For each size of an item, and for size 0 (no item), ``rooms`` has the most room of the bins that
    hold one and may take part."""

    def __init__(self, bins: list[list[int]], sizes: list[int], capacity: int) -> None:
        self.bins, self.sizes, self.capacity = [list(b) for b in bins], np.array(sizes, np.int64), capacity
        self.bin_of = np.zeros(len(sizes), np.int64)
        for k, b in enumerate(self.bins):
            self.bin_of[b] = k
        self.fill = np.array([sum(sizes[i] for i in b) for b in self.bins], np.int64)
        self.order = np.argsort(self.sizes, kind="stable")
        self.distinct, self.first = np.unique(self.sizes[self.order], return_index=True)

    def rooms(self, source: int) -> np.ndarray:
        """By size, the most room of the bins at least as full as source, itself and full ones left out; -1 where there is none."""
        may = (self.fill >= self.fill[source]) & (self.fill < self.capacity) & (self.fill > 0)
        may[source] = False
        room = np.where(may, self.capacity - self.fill, -1)
        out = np.full(self.capacity + 1, -1, np.int64)
        out[self.distinct] = np.maximum.reduceat(room[self.bin_of[self.order]], self.first)
        out[0] = max(out[0], int(room.max(initial=-1)))
        return out

    def partner(self, source: int, size: int, gain: int) -> tuple[int, int | None]:
        """The fullest bin that has room for gain and an item of that size (None for size 0)."""
        room = self.capacity - self.fill
        if size:
            lo, hi = np.searchsorted(self.sizes, (size, size + 1), sorter=self.order)
            items = self.order[lo:hi]
            owner = self.bin_of[items]
            ok = (owner != source) & (self.fill[owner] >= self.fill[source]) & (room[owner] >= gain)
            items, owner = items[ok], owner[ok]
            k = int(np.lexsort((items, room[owner]))[0])
            return int(owner[k]), int(items[k])
        bins = np.flatnonzero((self.fill >= self.fill[source]) & (self.fill > 0) & (room >= gain))
        bins = bins[bins != source]
        return int(bins[np.lexsort((bins, room[bins]))[0]]), None

    def step(self, source: int) -> bool:
        """Makes the exchange that takes most from source; False if none raises the sum of squared fills."""
        rooms = self.rooms(source)
        there = np.flatnonzero(rooms >= 0)
        if not len(there):
            return False
        own = self.bins[source]
        first = {int(self.sizes[i]): i for i in own}
        gives = np.array(sorted(first), np.int64)
        gain, give, take = self._best(gives, rooms, there)
        pair: tuple[int, ...] = (first[give],) if gain else ()
        if not gain or gain < self.fill[source]:
            two = self._pairs(own)
            least = there[there > 0][:1]
            if two and len(least):  # two for one, never for none: a move of one item comes first
                more, total, other = self._best(np.array(sorted(two), np.int64), rooms, there[there > 0])
                if more > gain:
                    gain, take, pair = more, other, two[total]
        if not gain:
            return False
        target, item = self.partner(source, take, gain)
        for i in pair:
            own.remove(i)
            self.bins[target].append(i)
            self.bin_of[i] = target
        if item is not None:
            self.bins[target].remove(item)
            own.append(item)
            self.bin_of[item] = source
        self.fill[source] -= gain
        self.fill[target] += gain
        return True

    def _pairs(self, own: list[int]) -> dict[int, tuple[int, int]]:
        """A pair of items for each sum that two of them have."""
        size = self.sizes[own]
        order = np.unique(size, return_index=True)[1]
        again = [int(np.flatnonzero(size == size[k])[1]) for k in order if (size == size[k]).sum() > 1]
        some = sorted([*order.tolist(), *again])
        a, b = np.triu_indices(len(some), 1)
        some = np.array(some)
        sums, at = np.unique(size[some[a]] + size[some[b]], return_index=True)
        return {int(s): (own[some[a[k]]], own[some[b[k]]]) for s, k in zip(sums, at, strict=True)}

    @staticmethod
    def _best(gives: np.ndarray, rooms: np.ndarray, takes: np.ndarray) -> tuple[int, int, int]:
        """The largest gain = give - take that the take's rooms allow, with both; (0, 0, 0) if there is none."""
        best = (0, 0, 0)
        for i in range(0, len(gives), 256):
            gain = gives[i : i + 256, None] - takes[None, :]
            gain[gain > rooms[takes][None, :]] = 0
            k = int(gain.argmax())
            if gain.flat[k] > best[0]:
                best = (int(gain.flat[k]), int(gives[i + k // len(takes)]), int(takes[k % len(takes)]))
        return best


def local_search(bins: list[list[int]], sizes: list[int], capacity: int) -> list[list[int]]:
    """bins with fewer or fuller members; every exchange raises the sum of squared fills."""
    search = Search(bins, sizes, capacity)
    bound = -(-sum(sizes) // capacity)
    left = sum(1 for b in search.bins if b)
    changed = True
    while changed and left > bound:
        changed, done = False, np.zeros(len(search.bins), dtype=bool)
        while left > bound:
            open_ = np.flatnonzero((search.fill > 0) & (search.fill < capacity) & ~done)
            if not len(open_):
                break
            source = int(open_[np.argmin(search.fill[open_])])
            while search.bins[source] and search.step(source):
                changed = True
            done[source] = True
            left -= not search.bins[source]
    return [b for b in search.bins if b]


def pack_sizes(sizes: list[int], capacity: int) -> list[list[int]]:
    """The search from a start in the order given; where that stays above the lower bound, also from one in decreasing order."""
    found = local_search(best_fit(sizes, capacity), sizes, capacity)
    if len(found) > -(-sum(sizes) // capacity):
        order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
        start = [[order[i] for i in b] for b in best_fit([sizes[i] for i in order], capacity)]
        found = min(found, local_search(start, sizes, capacity), key=len)
    return found


def pieces(docs: DataFrame, capacity: int = 2048, tokenizer: str = "word_bpe_49k.json", end: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, with with_ids, the ids of each piece."""
    path, run = tokenizer_path(tokenizer), uuid.uuid4().hex
    src = docs.select(docs[id_col].alias("id"), docs[text_col].alias("body"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, ids, off in encoded(batches, path, "bare", run, end):
            raw = ids.astype("<u4").tobytes()
            size = np.diff(off)
            count = -(-size // capacity)
            row = np.repeat(np.arange(len(size)), count)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            start = piece * capacity
            length = np.minimum(capacity, size[row] - start)
            begin = (off[row] + start) * 4
            crc = [zlib.crc32(raw[a : a + n]) for a, n in zip(begin.tolist(), (length * 4).tolist(), strict=True)]
            columns = [rows.column("id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array([ids[a : a + n].astype(np.int32) for a, n in zip((begin // 4).tolist(), length.tolist(), strict=True)], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = dict(src.dtypes)["id"]
    return src.mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def _pack_group(capacity: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if not sum(b.num_rows for b in got):
            return
        table = pa.Table.from_batches(got).sort_by([("ids_crc32", "ascending"), ("doc_id", "ascending"), ("piece", "ascending"), ("length", "ascending")])
        group = table.column("to")[0].as_py()
        sizes = table.column("length").to_pylist()
        sequence, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        for k, members in enumerate(pack_sizes(sizes, capacity)):
            at = 0
            for i in members:
                sequence[i], offset[i] = group << 32 | k, at
                at += sizes[i]
        out = table.drop_columns(["to"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))
        yield from out.combine_chunks().to_batches(max_chunksize=10_000)

    return go


def pack(found: DataFrame, capacity: int = 2048) -> DataFrame:
    """Pieces (as of ``pieces``) with sequence_id and offset."""
    found = checkpoint(found)
    full = found.where(F.col("length") == capacity)
    rest = found.where(F.col("length") < capacity)
    groups = max(1, -(-rest.count() // GROUP))
    dealt = rest.withColumn("to", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)).cast("int"))
    kind = ", ".join(f"{c} {t}" for c, t in found.dtypes) + ", sequence_id long, offset long"
    packed = dealt.repartitionById(groups, "to").mapInArrow(_pack_group(capacity), kind)
    # Full pieces: ids below zero, which groups don't use.
    alone = full.withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    return packed.unionByName(alone)


def best_fit_packing(docs: DataFrame, capacity: int = 2048, tokenizer: str = "word_bpe_49k.json", end: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(pieces(docs, capacity, tokenizer, end, id_col, text_col), capacity)
