r"""Benchmark decontamination by a positional inverted index: passages of benchmark items inside training documents.

Words are runs of 0-9, a-z and everything beyond ASCII, A-Z in lower case. A window is ``width`` consecutive words of an item, or the
whole item if it has fewer (but not none). Words of a document that an occurrence of a window covers are hit.

1. ``build_index`` (``mapInArrow``) cuts the corpus into shards of some megabytes of text. A shard's row holds its documents and, for
   each term, its postings: the places where it stands, counted through the shard with a gap between documents, so that no phrase crosses
   from one to the next. The index is a table in the shared folder, of all words, whatever will be searched; no text is shuffled. A shard
   is a row group, and goes to Python by itself: a task holds one shard, however many its partition has.
2. ``find`` sends the items' distinct windows to the shards in blocks of ``BLOCK`` words, which bounds what is broadcast; each block is a
   pass over the index, whose hits are written before the next one begins. A block holds its words once, and windows are places in them. In a shard, windows with a term that it doesn't have are out. For the others the terms are taken from the rarest
   in the shard to the most frequent: places of the first one, less its offset in the window, are candidates, and each further term leaves
   those where its own postings, less its offset, have the same place. Postings lie in order of (term, place), so a step is one binary
   search for all windows' candidates at once.
3. With ``slack`` a second search finds proximity matches: places of a window where each of its terms stands at most so many words before or
   after its own place. Candidates are then all places within slack of those that the rarest term gives.
4. A document's spans merge, and its items are counted. Documents meet their spans of several blocks by a group of one row a block.

No cap, no sample: a term that stands in every document only makes its own list long, and is used last.

Words are compared by 64-bit hashes (words of up to eight bytes never collide with others of their length), so a false hit needs collisions in every place
of a window at once.

Edge cases: null and empty texts have no words and are not hit; items without words are never found; equal items are all counted,
each by its id; repeated item ids count once; repeated documents are rows of their own; a null item_id is left out of the list of items
but its words are hit; an empty benchmark hits nothing, an empty corpus gives no rows; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .shared import small_batches, written

WIDTH = 10
#: Places left free between documents; words of windows in a block; candidates of one step.
GAP, BLOCK, STEP = 64, 1_000_000, 2_000_000
#: Windows that are laid out as a table of their terms at once.
SLICE = 50_000
#: Bytes of text in a shard; a longer document is a shard of its own.
SHARD = 4 << 20
#: Documents that come to Python at once.
DOCUMENTS = 1000

#: Byte to word byte; 0 where it is none. A-Z become a-z.
WORD = np.zeros(256, np.uint8)
WORD[48:58] = np.arange(48, 58)
WORD[97:123] = np.arange(97, 123)
WORD[65:91] = np.arange(97, 123)
WORD[128:] = np.arange(128, 256)

INDEX = "ids array<{}>, sizes array<int>, terms binary, lengths binary, places binary, n_terms int, n_words int"


def hashed_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, and per-row offsets."""
    low = WORD[data]
    starts, ends, off = K.runs(low != 0, offsets)
    return K.span_hash(low, starts, ends), off


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents in runs of at most SHARD text bytes, across batches; a longer document comes alone."""
    held, size = [], 0
    for batch in batches:
        for part in K.slices(batch, "body", SHARD):
            more = len(K.utf8(part.column("body"))[0])
            if held and size + more > SHARD:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
            held.append(part)
            size += more
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in _shards(batches):
        words, off = hashed_words(*K.utf8(part.column("body")))
        sizes = np.diff(off)
        place = np.arange(len(words)) + GAP * np.repeat(np.arange(len(sizes)), sizes)
        order = np.argsort(words, kind="stable")
        words, steps = words[order], place[order]
        new = np.ones(len(words), dtype=bool)
        new[1:] = words[1:] != words[:-1]
        first = np.flatnonzero(new)
        terms, lengths = words[first], np.diff(np.append(first, len(words)))
        steps[1:] -= np.where(new[1:], 0, steps[:-1])
        ids = part.column("id")
        yield pa.RecordBatch.from_arrays(
            [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.ListArray.from_arrays(pa.array([0, len(sizes)], pa.int32()), pa.array(sizes.astype(np.int32))),
             *[pa.array([x], pa.binary()) for x in (K.planes(terms), K.planes(lengths.astype(np.int32)), K.planes(steps))], pa.array([len(terms)], pa.int32()), pa.array([len(words)], pa.int32())],
            ["ids", "sizes", "terms", "lengths", "places", "n_terms", "n_words"],
        )


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored index of all words: a row for each shard, with its number in ``shard``."""
    src = docs.select(docs[id_col].alias("id"), docs[text_col].alias("body"))
    found = src.mapInArrow(_index, INDEX.format(dict(src.dtypes)["id"]))
    with small_batches(docs.sparkSession, DOCUMENTS):
        return written(found.withColumn("shard", F.monotonically_increasing_id()), "postings", group_rows=1)


class Postings:
    """A shard's index in memory: ``keys`` are (term number, place), in order."""

    def __init__(self, row: dict) -> None:
        n, m = row["n_terms"], row["n_words"]
        self.sizes = np.array(row["sizes"], np.int64)
        self.terms = K.unplanes(row["terms"], np.uint64, n)
        self.lengths = K.unplanes(row["lengths"], np.int32, n).astype(np.int64)
        self.first = np.cumsum(self.lengths) - self.lengths
        steps = np.cumsum(K.unplanes(row["places"], np.int64, m))
        # Steps are counted from the list's own beginning: what came before the list is taken off.
        before = np.where(self.first > 0, steps[np.maximum(self.first, 1) - 1], 0) if n else np.zeros(0, np.int64)
        self.places = steps - np.repeat(before, self.lengths)
        off = np.concatenate(([0], np.cumsum(self.sizes)))
        self.begin = off[:-1] + GAP * np.arange(len(self.sizes))
        self.span = int(off[-1] + GAP * (len(self.sizes) + 1))
        self.keys = np.repeat(np.arange(n), self.lengths) * self.span + self.places

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The shard's number of each term; -1 where it doesn't have it."""
        if not len(self.terms):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return np.where(self.terms[at] == hashes, at, -1)

    def near(self, term: np.ndarray, place: np.ndarray, slack: int) -> np.ndarray:
        """True where a term stands at most slack words from a place."""
        low = term * self.span + np.maximum(place - slack, 0)
        at = np.minimum(np.searchsorted(self.keys, low), len(self.keys) - 1)
        return (self.keys[at] >= low) & (self.keys[at] <= term * self.span + np.minimum(place + slack, self.span - 1))


class Windows:
    """Distinct windows of some items: where each begins in the items' joined words, its length, and which items have it.

    Nothing is kept ten times over: a table of the windows' words is made for SLICE of them at a time, where they are searched.
    """

    def __init__(self, rows: list[tuple[str | None, bytes]], width: int) -> None:
        self.width = width
        self.items = sorted({i for i, _ in rows if i is not None})
        number = {i: k for k, i in enumerate(self.items)}
        size = np.array([len(raw) // 8 for _, raw in rows], np.int64)
        words = np.frombuffer(b"".join(raw for _, raw in rows), np.uint64)
        count = np.where(size > 0, np.maximum(1, size - width + 1), 0)
        run = np.repeat(np.arange(len(rows)), count)
        at = np.arange(len(run)) + np.repeat(np.cumsum(size) - size - np.cumsum(count) + count, count)
        length = np.minimum(size, width)[run]
        self.distinct, back = np.unique(words, return_inverse=True)
        # The number of each of the joined words, and some more places, so that a short last window has a row of the full width.
        self.number = np.append(back.astype(np.int32), np.full(width, -1, np.int32))
        _, first, window = np.unique(self._ranks(at, length), return_index=True, return_inverse=True)
        order = np.argsort(first)
        self.starts, self.lengths = at[first[order]], length[first[order]]
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        item = np.array([-1 if i is None else number[i] for i, _ in rows], np.int64)[run]
        pair = np.unique(place[window][item >= 0] * max(1, len(self.items)) + item[item >= 0])
        self.item_of = pair % max(1, len(self.items))
        self.item_off = np.searchsorted(pair, np.arange(len(self.starts) + 1) * max(1, len(self.items)))

    def _ranks(self, at: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Equal numbers for equal windows: ranks by one word after another, with 0 behind a window's end."""
        rank = np.zeros(len(at), np.int64)
        for k in range(self.width if len(at) else 0):
            word = np.where(k < length, self.number[at + np.minimum(k, length - 1)].astype(np.int64) + 1, 0)
            _, rank = np.unique(rank * (len(self.distinct) + 1) + word, return_inverse=True)
        return rank

    def terms(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """For windows lo to hi the numbers of their words, a row of the width for each, and which of them are words of the window."""
        inside = np.arange(self.width) < self.lengths[lo:hi, None]
        return self.number[self.starts[lo:hi, None] + np.arange(self.width)], inside


def occurrences(p: Postings, w: Windows, slack: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(window, place of its first word) of every occurrence, by intersecting postings from the rarest term on."""
    found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    known = p.numbers(w.distinct) if len(p.terms) else None
    for first in range(0, len(w.starts) if len(p.terms) else 0, SLICE):
        number, inside = w.terms(first, first + SLICE)
        term = known[number]
        live = np.flatnonzero(np.all((term >= 0) | ~inside, axis=1))
        if not len(live):
            continue
        term, lengths = term[live], w.lengths[first + live]
        often = np.where(inside[live], p.lengths[np.maximum(term, 0)], np.iinfo(np.int64).max)
        rarest = np.argsort(often, axis=1, kind="stable")
        count = often[np.arange(len(live)), rarest[:, 0]]
        cut = np.concatenate(([0], np.cumsum(count)))
        lo = 0
        while lo < len(live):
            hi = max(lo + 1, int(np.searchsorted(cut, cut[lo] + STEP, "right")) - 1)
            which = np.repeat(np.arange(lo, hi), count[lo:hi])
            at = np.arange(len(which)) - np.repeat(cut[lo:hi] - cut[lo], count[lo:hi])
            place = p.places[p.first[term[which, rarest[which, 0]]] + at] - rarest[which, 0]
            if slack:
                which, place = np.repeat(which, 2 * slack + 1), (place[:, None] + np.arange(-slack, slack + 1)).ravel()
            for step in range(1, w.width):
                more = step < lengths[which]
                offset = rarest[which, step]
                ok = ~more
                ok[more] = p.near(term[which[more], offset[more]], place[more] + offset[more], slack)
                which, place = which[ok], place[ok]
            found.append((first + live[which], place))
            lo = hi
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def _merged(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of some spans as maximal ones."""
    order = np.argsort(begin, kind="stable")
    begin, reach = begin[order], np.maximum.accumulate(end[order])
    new = np.flatnonzero(np.concatenate(([True], begin[1:] > reach[:-1])))
    return begin[new], reach[np.append(new[1:], len(begin)) - 1]


HITS = "shard long, row int, id {}, n_words long, begin array<int>, end array<int>, items array<string>, near array<string>"


def _items(w: Windows, doc: np.ndarray, window: np.ndarray, rows: int) -> list[list[str]]:
    """Of each document the items whose windows it has."""
    size = np.diff(w.item_off)[window]
    item = w.item_of[np.repeat(w.item_off[window], size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)]
    pair = np.unique(np.repeat(doc, size) * max(1, len(w.items)) + item)
    cut = np.searchsorted(pair, np.arange(rows + 1) * max(1, len(w.items)))
    return [[w.items[i] for i in (pair[a:b] % max(1, len(w.items))).tolist()] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


def _search(windows, slack: int | None):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w: Windows = windows.value
        for batch in batches:
            for at in range(batch.num_rows):
                one = batch.slice(at, 1)
                p = Postings({c: one.column(c)[0].as_buffer() if c in ("terms", "lengths", "places") else one.column(c)[0].as_py() for c in ("sizes", "terms", "lengths", "places", "n_terms", "n_words")})
                rows = len(p.sizes)
                window, place = occurrences(p, w)
                doc = np.searchsorted(p.begin, place, "right") - 1
                begin, end = place - p.begin[doc], place - p.begin[doc] + w.lengths[window]
                order = np.argsort(doc, kind="stable")
                cut = np.searchsorted(doc[order], np.arange(rows + 1))
                spans = [_merged(begin[order[a:b]], end[order[a:b]]) if b > a else (begin[:0], end[:0]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
                items = near = _items(w, doc, window, rows)
                if slack:
                    window, place = occurrences(p, w, slack)
                    # A place may be up to slack words before its document; the gap before that is wider.
                    near = _items(w, np.searchsorted(p.begin, place + slack, "right") - 1, window, rows)
                arrays = [
                    pa.array(np.full(rows, one.column("shard")[0].as_py(), np.int64)), pa.array(np.arange(rows, dtype=np.int32)), one.column("ids").flatten(), pa.array(p.sizes),
                    *[pa.array([x[k].astype(np.int32) for x in spans], pa.list_(pa.int32())) for k in (0, 1)], pa.array(items, pa.list_(pa.string())), pa.array(near, pa.list_(pa.string())),
                ]
                yield pa.RecordBatch.from_arrays(arrays, ["shard", "row", "id", "n_words", "begin", "end", "items", "near"])

    return go


OUT = "id {}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, n_near_items long, begin array<int>, end array<int>, items array<string>"


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans and items of all blocks together."""
    for batch in batches:
        rows = []
        for n, begin, end, items, near in zip(*(batch.column(c).to_pylist() for c in ("n_words", "begin", "end", "items", "near")), strict=True):
            b, e = _merged(np.array(begin, np.int64), np.array(end, np.int64)) if begin else ([], [])
            names = sorted(set(items))
            hit = int(np.sum(e) - np.sum(b)) if begin else 0
            rows.append((n, hit, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), hit > 0, len(set(near)), list(b), list(e), names))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string()))
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([batch.column("id"), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], [x.split()[0] for x in OUT.split(", ")])


def _item_words(width: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Items as runs of words, a long one in pieces that overlap by a window less one word."""
        for batch in batches:
            words, off = hashed_words(*K.utf8(batch.column("body")))
            which, runs = [], []
            for i, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
                for k in range(a, max(b - width + 1, a + 1) if b > a else a, 4096):
                    which.append(i)
                    runs.append(words[k : min(b, k + 4096 + width - 1)].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("item").take(pa.array(which, pa.int64())), pa.array(runs, pa.binary())], ["item", "words"])

    return go


def spans(index: DataFrame, items: DataFrame, width: int = WIDTH, slack: int | None = None, item_col: str = "item_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """Of each document: ``id``, ``n_words``, ``n_hit``, ``n_items``, ``items_sha256``, ``contaminated``, ``n_near_items`` (items with a proximity match), and what
    they come from: ``begin`` and ``end`` of the hit spans (in words), ``items``."""
    if not 0 < width < GAP // 2 or not 0 <= (slack or 0) < GAP // 4:
        raise ValueError(f"width must be below {GAP // 2}, slack below {GAP // 4}")
    spark = index.sparkSession
    asked = written(items.select(items[item_col].cast("string").alias("item"), items[text_col].alias("body")).mapInArrow(_item_words(width), "item string, words binary"), "benchmark-words")
    total = asked.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    blocks = max(1, -(-total // (8 * block)))
    place = F.pmod(F.xxhash64("item", "words"), F.lit(blocks))
    kind = dict(index.dtypes)["ids"].removeprefix("array<").removesuffix(">")
    hits = None
    for k in range(blocks):
        rows = [(r.item, bytes(r.words)) for r in asked.where(place == k).toLocalIterator()]
        sent = spark.sparkContext.broadcast(Windows(rows, width))
        with small_batches(spark, 1):
            got = written(index.mapInArrow(_search(sent, slack), HITS.format(kind)), "benchmark-hits")
        sent.destroy()
        hits = got if hits is None else hits.unionByName(got)
    if blocks > 1:
        joined = [F.flatten(F.collect_list(c)).alias(c) for c in ("begin", "end", "items", "near")]
        hits = hits.groupBy("shard", "row").agg(F.first("id").alias("id"), F.max("n_words").alias("n_words"), *joined)
    return hits.select("id", "n_words", "begin", "end", "items", "near").mapInArrow(_finish, OUT.format(kind))


def find(index: DataFrame, items: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``spans`` as numbers and digests of each document; n_near_items only where a slack is given."""
    out = spans(index, items, **options).drop("begin", "end", "items").withColumnRenamed("id", id_col)
    return out if options.get("slack") else out.drop("n_near_items")


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents that hold no passage of an item. Rows are told apart by id_col; those with a null one stay only if none of these is hit."""
    bad = spans(build_index(docs, id_col), items, **options).where("contaminated").select(F.col("id").alias("_bad")).distinct()
    return docs.join(bad, docs[id_col].eqNullSafe(F.col("_bad")), "left_anti")
